"""Periodic runs: stretches of words that repeat with a smallest period, and the text without the repeats.

A run is a maximal stretch of words in which words ``q`` apart are identical, ``q`` being its smallest
period, of at least ``LEAST_WORDS`` words and two periods. Found by internal pattern matching over
words, for many documents at once in numpy arrays:

- a suffix array by prefix doubling, which also names every block of a power of two words;
- a wavelet tree over the part of it whose suffixes share ``SHORTEST`` words with another one. By a
  range successor it tells where a block occurs next in a window, and by ranks how often it does;
- queries: ``dyadic`` blocks of ``b`` words, ``b`` apart (``SHORTEST`` words: half of that apart), look into the
  neighbouring windows for occurrences at distances ``2b - 1`` to ``4b - 2`` (``SHORTEST``: from 1 on).
  A run of period ``q`` and two periods holds such a block whose copy lies ``q`` further on within
  the run, as ``q >= 2b - 1`` leaves room for a block at one of the places ``b`` apart. A window has
  ``b`` starting places, so its occurrences form one arithmetic progression: the first, the second and
  their number give all of them, and each distance is a candidate period;
- a candidate is extended to both sides by the block names, longest first. Of candidates with the
  same stretch the least period counts. Distances that lie within a run of the progression's own
  difference are multiples of a smaller period and are left out beforehand.

Every document is worked on by itself (memory grows with one document, or about a megabyte of many),
so nothing is shuffled.

Results: a null text is empty; texts without words have no runs, null run columns, and the digest of
the empty text; very long texts go through the same way whole; rows that repeat each get their own
result; among longest runs the one that starts first counts, then the least period; a row without a
doc_id keeps its words unchanged when the query plants repeats by ids; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changetrail.llm.shipping import ship_code
from changetrail.llm.text_arrays import SPACE, ragged, row_chunks, utf8

LEAST_WORDS = 12
SHORTEST = 4
SHORT_REACH = 14  # distances that blocks of SHORTEST words look at; longer blocks look from 15 on


class Words:
    """The words of some rows behind one another: their bytes, exact ids and places."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        text, bounds = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        inside = ~SPACE[text]
        edge = np.zeros(len(text) + 1, dtype=bool)
        edge[bounds] = True
        outside = np.concatenate([[True], ~inside, [True]])
        starts = np.flatnonzero(inside & (outside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside & (outside[2:] | edge[1:])) + 1
        self.bytes = text[inside]
        self.bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        spelled = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts),
            [None, pa.py_buffer(self.bounds.astype(np.int64)), pa.py_buffer(self.bytes)])
        self.ids = spelled.dictionary_encode().indices.to_numpy().astype(np.int64)
        self.rows = np.searchsorted(starts, bounds)  # the first word of each row, and the end

    def joined(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``words``, a space behind each, and the ends of words therein."""
        sizes = np.diff(self.bounds)[words]
        ends = np.cumsum(sizes + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
        out[ragged(ends - sizes - 1, sizes)] = self.bytes[ragged(self.bounds[:-1][words], sizes)]
        return out, ends


def doubled(ids: np.ndarray, row_of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list, list]:
    """The suffix array of all rows, and per power of two the name and group size of every block.

    ``ends`` is the end of each place's row. Equal blocks have equal names: the place in the suffix
    array at which their group starts. A block that would leave its row equals no other.
    """
    n = len(ids)
    key = row_of * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    names, sizes, length = [], [], 1
    name = np.empty(n, dtype=np.int64)
    slots = np.arange(n)
    while True:
        at = np.maximum.accumulate(np.where(first, slots, 0))
        members = order[slots]
        name[members] = at
        size = np.diff(np.append(np.flatnonzero(first), len(slots)))
        many = np.repeat(size, size) > 1
        names.append(name.astype(np.int32))
        group = np.ones(n, dtype=np.int32)
        group[members] = np.repeat(size, size)
        sizes.append(group)
        slots = slots[many]
        if not len(slots):
            return order, names, sizes
        members = order[slots]
        later = members + length
        inside = later < ends[members]
        second = np.where(inside, name[np.where(inside, later, 0)] + 1, 0)
        key = name[members] * (n + 2) + second
        by = np.argsort(key, kind="stable")
        order[slots] = members[by]
        ordered = key[by]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        length *= 2


class WaveletTree:
    """Counts and order statistics of value ranges within index ranges, for arrays of queries."""

    def __init__(self, values: np.ndarray, below: int):
        self.bits = max(int(below).bit_length(), 1)
        self.n = len(values)
        self.levels = []
        for shift in range(self.bits - 1, -1, -1):
            one = ((values >> shift) & 1).astype(bool)
            zeros_before = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((shift, zeros_before, int(zeros_before[-1])))
            values = np.concatenate([values[~one], values[one]])

    def less(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values of [low, high) are smaller than ``value``."""
        found = np.zeros(len(low), dtype=np.int64)
        for shift, zeros, total in self.levels:
            one = ((value >> shift) & 1).astype(bool)
            low0, high0 = zeros[low], zeros[high]
            found += np.where(one, high0 - low0, 0)
            low = np.where(one, total + low - low0, low0)
            high = np.where(one, total + high - high0, high0)
        return found

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest value, from 0, of [low, high)."""
        value = np.zeros(len(low), dtype=np.int64)
        for shift, zeros, total in self.levels:
            low0, high0 = zeros[low], zeros[high]
            one = n >= high0 - low0
            n = np.where(one, n - (high0 - low0), n)
            value |= np.where(one, 1 << shift, 0)
            low = np.where(one, total + low - low0, low0)
            high = np.where(one, total + high - high0, high0)
        return value


def common_after(names: list, x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many words from ``x`` and from ``y`` > ``x`` on, in the same row, are the same."""
    found = np.zeros(len(x), dtype=np.int64)
    limit = ends[y]
    for level in range(len(names) - 1, -1, -1):
        name, at = names[level], y + found
        fits = at < limit
        at = np.where(fits, at, 0)
        found += np.where(fits & (name[np.where(fits, x + found, 0)] == name[at]), 1 << level, 0)
    return found


def common_before(names: list, x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many words right before ``x`` and before ``y`` > ``x``, in the same row, are the same."""
    found = np.zeros(len(x), dtype=np.int64)
    limit = starts[x]
    for level in range(len(names) - 1, -1, -1):
        name, at = names[level], x - found - (1 << level)
        fits = at >= limit
        same = name[np.where(fits, at, 0)] == name[np.where(fits, y - found - (1 << level), 1)]
        found += np.where(fits & same, 1 << level, 0)
    return found


def candidates(order: np.ndarray, names: list, sizes: list, starts: np.ndarray,
               ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and distances of dyadic blocks that occur again in a neighbouring window."""
    least = SHORTEST.bit_length() - 1
    if len(names) <= least:
        return
    n = len(order)
    repeated = sizes[least][order] > 1
    place = np.concatenate([[0], np.cumsum(repeated)])
    tree = WaveletTree(order[repeated], n)
    for level in range(least, len(names)):
        b = 1 << level
        step = b // 2 if b == SHORTEST else b
        blocks = np.arange(n) if step == 1 else np.flatnonzero((np.arange(n) - starts) % step == 0)
        blocks = blocks[sizes[level][blocks] > 1]
        if not len(blocks):
            continue
        low = place[names[level][blocks]]
        high = low + sizes[level][blocks]
        nearest, farthest = (1, SHORT_REACH) if b == SHORTEST else (2 * b - 1, 4 * b - 2)
        for begin in range(nearest, farthest + 1, b):
            first_at = np.minimum(blocks + begin, n)
            behind = np.minimum(blocks + min(begin + b, farthest + 1), n)
            smaller = tree.less(low, high, first_at)
            count = tree.less(low, high, behind) - smaller
            hit = np.flatnonzero(count > 0)
            if not len(hit):
                continue
            at, lo, hi, k, c = blocks[hit], low[hit], high[hit], smaller[hit], count[hit]
            first = tree.nth(lo, hi, k)
            second = tree.nth(lo, hi, np.where(c > 1, k + 1, k))
            apart = second - first
            yield at, first - at
            more = np.flatnonzero(c > 1)
            if len(more):
                # The rest of each progression, but for distances within a run of its difference.
                place_of, gap, total = at[more], apart[more], c[more]
                repeats = np.where(first[more] + gap < ends[place_of], gap, 0)
                shared = common_after(names, place_of, place_of + repeats, ends)
                run_end = place_of + repeats + shared
                index = np.repeat(np.arange(len(more)), total - 1)
                turn = ragged(np.ones(len(more), dtype=np.int64), total - 1)
                distance = (first[more] - place_of)[index] + turn * gap[index]
                inside = place_of[index] + distance + b <= run_end[index]
                keep = ~(inside & (distance != gap[index]))
                yield place_of[index][keep], distance[keep]


def runs_of(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All runs of rows of words as a matrix (row, start in it, length, period), in that order.

    ``rows`` are the bounds of the rows within ``ids``.
    """
    counts = np.diff(rows)
    if not counts.sum():
        return np.zeros((0, 4), dtype=np.int64)
    row_of = np.repeat(np.arange(len(counts)), counts)
    starts, ends = rows[:-1][row_of], rows[1:][row_of]
    order, names, sizes = doubled(ids, row_of, ends)
    found = []
    for at, distance in candidates(order, names, sizes, starts, ends):
        other = at + distance
        begin = at - common_before(names, at, other, starts)
        end = other + common_after(names, at, other, ends)
        long = end - begin >= np.maximum(LEAST_WORDS, 2 * distance)
        found.append(np.unique(np.stack([begin[long], end[long], distance[long]], 1), axis=0))
    if not found:
        return np.zeros((0, 4), dtype=np.int64)
    found = np.unique(np.concatenate(found), axis=0)
    least = np.ones(len(found), dtype=bool)
    least[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    begin, end, period = found[least].T
    row = row_of[begin]
    out = np.stack([row, begin - rows[row], end - begin, period], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """From which word on, and with which period, a document's words are made to repeat, if at all."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def with_repeats(doc_ids: list, rows: np.ndarray) -> np.ndarray:
    """For each word's place the place whose word stands there, when repeats are planted."""
    source = np.arange(int(rows[-1]))
    for row, doc_id in enumerate(doc_ids):
        repeat = planted(doc_id, int(rows[row + 1] - rows[row]))
        if repeat:
            a, period = repeat
            tail = source[rows[row] + a:rows[row + 1]]
            tail[:] = rows[row] + a + (np.arange(len(tail)) % period)
    return source


RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False,
              with_text: bool = True) -> DataFrame:
    """Per row its runs, their digest, the longest one, and the text without the repeats.

    ``runs`` lists start, length and period of every run by start, and ``collapsed`` holds the words
    left when each run keeps its first period only, joined by one space; both only ``with_text``.
    ``plant`` first makes the words of some documents repeat, as ``planted`` says.
    """
    ship_code(docs.sparkSession)
    schema = RESULT + (", runs array<struct<start:long,length:long,period:long>>, collapsed string"
                       if with_text else "")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for begin, end in row_chunks(offsets):
                ids = batch.column(0).slice(begin, end - begin).to_pylist()
                yield described(ids, Words(data, offsets[begin:end + 1]), plant, with_text)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(scan, schema)


def described(doc_ids: list, words: Words, plant: bool, with_text: bool) -> pa.RecordBatch:
    """The result rows of some documents."""
    rows, n = words.rows, len(doc_ids)
    source = with_repeats(doc_ids, rows) if plant else np.arange(int(rows[-1]))
    runs = runs_of(words.ids[source], rows)
    kept = np.ones(len(source), dtype=bool)
    if len(runs):
        # Words of a run behind its first period, as differences of a running count.
        after = rows[runs[:, 0]] + runs[:, 1] + runs[:, 3]
        until = rows[runs[:, 0]] + runs[:, 1] + runs[:, 2]
        change = np.zeros(len(source) + 1, dtype=np.int64)
        np.add.at(change, after, 1)
        np.add.at(change, until, -1)
        kept = np.cumsum(change[:-1]) == 0
    text, ends = words.joined(source[kept])
    left = np.concatenate([[0], np.cumsum(kept)])[rows]
    ends = np.concatenate([[0], ends])
    of_row = np.searchsorted(runs[:, 0], np.arange(n + 1))
    best: list[list] = [[], [], [], []]
    digests, collapsed, texts, listed = [], [], [], []
    for row in range(n):
        own = runs[of_row[row]:of_row[row + 1], 1:]
        if len(own):
            start, length, period = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist()
            longest = (start, length, period, 1000 * length // period)
        else:
            longest = (None,) * 4
        for column, value in zip(best, longest):
            column.append(value)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in own.tolist())
        digests.append(hashlib.sha256(lines.encode()).hexdigest())
        low, high = ends[left[row]], max(ends[left[row]], ends[left[row + 1]] - 1)
        body = text[low:high].tobytes()
        collapsed.append(hashlib.sha256(body).hexdigest())
        if with_text:
            texts.append(body.decode())
            listed.append([{"start": s, "length": k, "period": q} for s, k, q in own.tolist()])
    columns = [pa.array(doc_ids, pa.int64()), pa.array(np.diff(of_row), pa.int64()),
               *[pa.array(column, pa.int64()) for column in best],
               pa.array(digests, pa.string()), pa.array(collapsed, pa.string())]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
             "collapsed_sha256"]
    if with_text:
        kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))
        columns += [pa.array(listed, kind), pa.array(texts, pa.string())]
        names += ["runs", "collapsed"]
    return pa.RecordBatch.from_arrays(columns, names)
