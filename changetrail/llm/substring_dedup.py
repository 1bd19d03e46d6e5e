"""Substring deduplication over sliding runs of sentences.

A sentence ends at any of ``ENDS`` (commas and line breaks too, so that a passage pasted into the
middle of a sentence still has whole sentences inside), the marks of unspaced scripts included. Where no
mark has come for ``FAR`` words, a word that its own hash chooses (one in ``EVERY``) begins a sentence too:
such cuts depend on the words of a passage only, not on what it is pasted into. From every sentence a
run of consecutive ones, ``LEAST_SENTENCES`` at least, goes on until its words have ``LEAST_BYTES`` bytes.
All runs are hashed, over all documents. A run that occurs again later, by doc_id and place, is removed
there: every sentence that any such non-first run covers goes.

A run may occur in any share of all documents: its first place is a minimum that is formed before
the shuffle, and only runs that do occur again are joined back.

Results: null and empty texts stay as they are; case, white space and empty sentences don't matter to a
run; a run that repeats within one document counts too; very long texts are cut whole; rows that repeat
a doc_id (or lack one) and text fare alike; rows without a doc_id come last, by a hash of the text, as do
texts of one doc_id among themselves; an empty table gives an empty table; other columns are carried, but
for those named like the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changetrail.llm.line_dedup import packed, without
from changetrail.llm.shipping import ship_code
from changetrail.llm.storage import small_side, written
from changetrail.llm.text_arrays import (FACTOR, INVERSE, SPACE, mix, powers, row_chunks, utf8,
                                         word_hashes)

LEAST_SENTENCES = 2
LEAST_BYTES = 160
FAR, EVERY = 8, 6
# Marks at which sentences end.
ENDS = ".!?,;:\n"
OTHER_ENDS = "。．！？，、；：…।॥؟،؛۔"
PLACE_BITS = 28
IS_END = np.zeros(256, dtype=bool)
IS_END[list(ENDS.encode())] = True


def end_marks(text: np.ndarray) -> np.ndarray:
    """Which bytes belong to an end mark."""
    marks = IS_END[text]
    for mark in (char.encode() for char in OTHER_ENDS):
        at = np.flatnonzero(text[:len(text) - len(mark) + 1] == mark[0])
        for j, byte in enumerate(mark):
            at = at[text[at + j] == byte]
        for j in range(len(mark)):
            marks[at + j] = True
    return marks


def sentence_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte bounds of all sentences of the rows: each ends behind the last of its end marks, or, far
    from any, where a chosen word begins."""
    text, begin = data[offsets[0]:offsets[-1]], offsets[0]
    if not len(text):
        return np.unique(offsets)
    marks = end_marks(text)
    last = np.append(marks[:-1] & ~marks[1:], False)
    bounds = np.union1d(np.flatnonzero(last) + 1 + begin, offsets)
    inside = ~SPACE[text]
    edge = np.zeros(len(text) + 1, dtype=bool)
    edge[bounds - begin] = True
    outside = np.concatenate([[True], ~inside])
    starts = np.flatnonzero(inside & (outside[:-1] | edge[:-1]))
    words, counts = word_hashes(data, bounds)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    chosen = (place >= FAR) & (mix(words) % np.uint64(EVERY) == 0)
    return np.union1d(bounds, starts[chosen] + begin)


def sentence_runs(data: np.ndarray, offsets: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bounds of all sentences of some rows, and of every run its hash, its row, and the numbers
    within the row of its first sentence and of the one behind its last."""
    bounds = sentence_bounds(data, offsets)
    words, counts = word_hashes(data, bounds)
    ends = np.cumsum(counts)
    place = np.arange(len(words), dtype=np.int64) - np.repeat(ends - counts, counts)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words ^ mix(place.astype(np.uint64))),
                                                             dtype=np.uint64)])
    # Sentences without words don't count.
    own = np.flatnonzero(counts)
    n = len(own)
    hashed = mix((sums[ends] - sums[ends - counts])[own] ^ counts[own].astype(np.uint64))
    row = np.searchsorted(offsets, bounds[own], side="right") - 1
    number = own - np.searchsorted(bounds, offsets[:-1])[row]
    inside = np.concatenate([[0], np.cumsum(~SPACE[data[offsets[0]:offsets[-1]]])])
    size = np.diff(inside[bounds - offsets[0]])[own]
    total = np.concatenate([[0], np.cumsum(size)])
    # The first sentence behind each run, which must lie in one row.
    stop = np.searchsorted(total, total[:-1] + LEAST_BYTES, side="left")
    stop = np.maximum(stop, np.arange(n) + LEAST_SENTENCES)
    fits = stop <= n
    last = np.minimum(stop, n) - 1
    fits &= row[last] == row if n else fits
    at, last = np.flatnonzero(fits), last[fits]
    chain = np.concatenate([np.zeros(1, np.uint64),
                            np.cumsum(hashed * powers(FACTOR, n + 1)[:n], dtype=np.uint64)])
    value = (chain[last + 1] - chain[at]) * powers(INVERSE, n + 1)[at]
    value = mix(value ^ mix((last - at).astype(np.uint64)))
    return bounds, value, row[at], number[at], number[last] + 1


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and ``n_sentences, n_removed``.

    Columns of ``docs`` with these names give way.
    """
    carried = without(docs, "n_sentences", "n_removed")
    ship_code(docs.sparkSession)
    numbered = packed(docs, key, text)
    body = F.col(f"row.`{text}`").alias("text")

    def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for begin, end in row_chunks(offsets):
                _, value, row, number, _ = sentence_runs(data, offsets[begin:end + 1])
                place = (ids[begin:end][row] << PLACE_BITS) + np.minimum(number, 2**PLACE_BITS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(place)],
                                                 ["run", "place"])

    runs = numbered.select("_id", body).mapInArrow(hash_runs, "run long, place long")
    runs = written(runs, "runs")
    again = written(runs.groupBy("run").agg(F.min("place").alias("first"), F.max("place").alias("last"))
                    .where("first < last").drop("last"), "again")
    # Repeated runs grow with the input, so they are joined the same way at every size: by their hash.
    later = runs.join(again, "run").where("place > first")
    gone = written(later.groupBy(F.shiftright("place", PLACE_BITS).alias("_id")).agg(
        F.collect_set(F.col("place").bitwiseAND(2**PLACE_BITS - 1).cast("int")).alias("_gone")), "gone")
    joined = numbered.join(small_side(gone, 128), "_id", "left")
    schema = docs.select(*[F.col(f"`{name}`") for name in carried]).schema
    schema = schema.add("n_sentences", "long").add("n_removed", "long")
    at = carried.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            data, offsets = utf8(columns[at])
            for begin, end in row_chunks(offsets):
                own = [column.slice(begin, end - begin) for column in columns]
                texts, sentences, removed = cut_rows(data, offsets[begin:end + 1], own[at], own[-1])
                yield pa.RecordBatch.from_arrays(
                    [*own[:at], pa.array(texts, pa.string()), *own[at + 1:-1],
                     pa.array(sentences, pa.int64()), pa.array(removed, pa.int64())], schema.names)

    own = [F.col(f"row.`{name}`").alias(name) for name in carried]
    return joined.select(*own, F.col("_gone").alias("__gone")).mapInArrow(cut, schema)


def cut_rows(data: np.ndarray, offsets: np.ndarray, texts: pa.Array, gone: pa.Array
             ) -> tuple[list, np.ndarray, np.ndarray]:
    """Some rows' texts without the runs that begin at the sentences in ``gone``, how many sentences
    each has, and how many went."""
    bounds, _, row, number, stop = sentence_runs(data, offsets)
    first = np.searchsorted(bounds, offsets[:-1])
    sentences = np.searchsorted(bounds, offsets[1:]) - first
    kept, covered = texts.to_pylist(), np.zeros(len(bounds), dtype=np.int64)
    some = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
    for i in some:
        begin, end = np.searchsorted(row, [i, i + 1])
        hit = begin + np.flatnonzero(np.isin(number[begin:end], gone[i].as_py()))
        np.add.at(covered, first[i] + number[hit], 1)
        np.add.at(covered, first[i] + stop[hit], -1)
    left = np.cumsum(covered) == 0
    before = np.concatenate([[0], np.cumsum(~left)])
    removed = before[first + sentences] - before[first]
    for i in some:
        own = slice(first[i], first[i] + sentences[i])
        stay = np.repeat(left[own], np.diff(bounds[first[i]:first[i] + sentences[i] + 1]))
        kept[i] = data[offsets[i]:offsets[i + 1]][stay].tobytes().decode()
    return kept, sentences, removed
