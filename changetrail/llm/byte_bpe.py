"""Byte-level BPE encoding and decoding in padded numpy matrices.

A text is cut by the tokenizer's pattern; every distinct piece of a batch is encoded once. Pieces
of one length class form a padded matrix with a row per piece. In each round every row merges its
leftmost pair of the least rank; the rank of a pair comes from an open-addressing hash table, only
the two pairs beside a merge are looked up anew, and finished rows leave the matrix. A piece longer
than ``MATRIX_BYTES`` is a row of its own, and merges all places of its least rank in one round, those
that don't overlap from the left on. One after the other they would be merged next anyway, unless a merge
makes a pair of a still lesser rank: then the leftmost alone is merged in that round.

Texts are taken in chunks of about ``CHUNK_CHARS`` characters, so a task's memory doesn't grow with its rows.

Results: null and empty texts give no ids; any text, however long, is encoded whole; rows that
repeat are encoded alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from changetrail.llm.shipping import ship_code

NO_RANK = np.int32(2**31 - 1)
HASH_FACTOR = np.uint64(0x9E3779B97F4A7C15)
MATRIX_BYTES = 256
LENGTH_CLASSES = (4, 8, 12, 16, 24, 32, 64, 128, MATRIX_BYTES)
MATRIX_CELLS = 1 << 17
CHUNK_CHARS = 1 << 19


def read_ranks(path: str) -> bytes:
    """The rank file (base64 token, rank), read on the driver and sent to the tasks as it is."""
    with open(path, "rb") as file:
        return file.read()


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class PairTable:
    """(left id, right id) -> rank of the joined token, in arrays with linear probing."""

    def __init__(self, ids: dict[bytes, int]):
        pairs = [(ids[token[:cut]], ids[token[cut:]], rank)
                 for token, rank in ids.items() for cut in range(1, len(token))
                 if token[:cut] in ids and token[cut:] in ids]
        self.bits = max(4, int(2 * len(pairs) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, dtype=np.int32)
        columns = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        keys, ranks = (columns[:, 0] << 32) | columns[:, 1], columns[:, 2].astype(np.int32)
        slots, self.probes = self._slots(keys), 1
        while len(keys):
            free = np.flatnonzero(self.keys[slots] == -1)
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]], self.ranks[slots[placed]] = keys[placed], ranks[placed]
            rest = np.ones(len(keys), dtype=bool)
            rest[placed] = False
            keys, ranks = keys[rest], ranks[rest]
            slots = (slots[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(keys))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * HASH_FACTOR
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a negative id stands for no token, and such a pair has no rank."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        found = np.full(len(keys), NO_RANK, dtype=np.int32)
        rows = np.flatnonzero((left >= 0) & (right >= 0))
        slots = self._slots(keys[rows])
        for _ in range(self.probes):
            at = self.keys[slots]
            hit = at == keys[rows]
            found[rows[hit]] = self.ranks[slots[hit]]
            rest = ~hit & (at != -1)
            if not rest.any():
                break
            rows, slots = rows[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)
        return found


class Codec:
    """The vocabulary of one rank file: its pairs, its bytes and the ids of single bytes."""

    def __init__(self, rank_file: bytes, pattern: str):
        ids = {base64.b64decode(token): int(rank)
               for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        self.ids = ids
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(ids)
        self.single = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int32)
        size = max(ids.values()) + 1
        tokens = [b""] * size
        for token, rank in ids.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    # --- encoding ------------------------------------------------------------------------
    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces behind one another, and how many each piece has."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        coded: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lower = 0
        for upper in LENGTH_CLASSES:
            rows = np.flatnonzero((lengths > lower) & (lengths <= upper))
            step = max(1, MATRIX_CELLS // upper)
            for begin in range(0, len(rows), step):
                part = rows[begin:begin + step]
                ids, counts = self._merge_matrix([pieces[i] for i in part], lengths[part], upper)
                coded.append((part, ids, counts))
            lower = upper
        for row in np.flatnonzero(lengths > MATRIX_BYTES):
            ids = self._merge_long(pieces[row])
            coded.append((np.array([row]), ids, np.array([len(ids)])))
        counts = np.zeros(len(pieces), dtype=np.int64)
        for rows, _, own in coded:
            counts[rows] = own
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int32)
        for rows, ids, own in coded:
            out[ragged(starts[rows], own)] = ids
        return out, counts

    def _merge_matrix(self, pieces: list[bytes], lengths: np.ndarray,
                      width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(piece.ljust(width, b"\0") for piece in pieces),
                            dtype=np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.single[raw], np.int32(-1))
        ids = np.hstack([ids, np.full((n, 1), -1, dtype=np.int32)])
        ranks = self.pairs.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        done = np.full((n, width + 1), -1, dtype=np.int32)
        rows = np.arange(n)
        columns = np.arange(width + 1)
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == NO_RANK
            if over.any():
                done[rows[over]] = ids[over]
                live = ~over
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
            if not len(rows):
                break
            every = np.arange(len(rows))
            ids[every, at] = best
            shift = np.minimum(columns + (columns > at[:, None]), width)
            ids = np.take_along_axis(ids, shift, axis=1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], width - 1), axis=1)
            ranks[:, -1] = NO_RANK
            ranks[every, at] = self.pairs.look_up(ids[every, at], ids[every, at + 1])
            inner = np.flatnonzero(at > 0)
            before = at[inner] - 1
            ranks[inner, before] = self.pairs.look_up(ids[inner, before], ids[inner, before + 1])
        kept = done >= 0
        return done[kept], kept.sum(axis=1)

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)]
        ranks = np.append(self.pairs.look_up(ids[:-1], ids[1:]), NO_RANK)
        while (best := ranks.min()) != NO_RANK:
            at = np.flatnonzero(ranks == best)
            # Adjacent places overlap: of each run of them every other one is merged.
            first = np.concatenate([[True], np.diff(at) > 1])
            turn = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[turn % 2 == 0]
            merged = self._merged_at(ids, ranks, at, best)
            if len(at) > 1:
                # Pairs that a merge makes with what follows, which may be merged itself just after.
                after = at[at + 2 < len(ids)]
                right = self.pairs.look_up(np.full(len(after), best), ids[after + 2])
                if min(merged[1].min(), right.min(initial=NO_RANK)) < best:
                    merged = self._merged_at(ids, ranks, at[:1], best)
            ids, ranks = merged
        return ids

    def _merged_at(self, ids: np.ndarray, ranks: np.ndarray, at: np.ndarray,
                   best: np.int32) -> tuple[np.ndarray, np.ndarray]:
        """A row in which the pairs at some places are merged, and the ranks of its pairs."""
        kept = np.ones(len(ids), dtype=bool)
        kept[at + 1] = False
        ids = ids.copy()
        ids[at] = best
        ids, ranks = ids[kept], ranks[kept]
        here = at - np.arange(len(at))
        changed = np.unique(np.concatenate([here, here - 1]))
        changed = changed[(changed >= 0) & (changed < len(ids) - 1)]
        ranks[changed] = self.pairs.look_up(ids[changed], ids[changed + 1])
        ranks[-1] = NO_RANK
        return ids, ranks

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and how many each text has."""
        known = Numbers()
        order = array("q")
        pieces_of = np.zeros(len(texts), dtype=np.int64)
        for row, text in enumerate(texts):
            found = self.pattern.findall(text)
            pieces_of[row] = len(found)
            order.extend(map(known.__getitem__, found))
        ids, counts = self.encode_pieces([piece.encode() for piece in known])
        starts = np.cumsum(counts) - counts
        which = np.frombuffer(order, dtype=np.int64) if order else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(counts[which])])
        bounds = ends[np.concatenate([[0], np.cumsum(pieces_of)])]
        return ids[ragged(starts[which], counts[which])], np.diff(bounds)

    # --- decoding ------------------------------------------------------------------------
    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ..., then the same for every other run, in one array."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


@functools.lru_cache(maxsize=2)
def codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def chunks_by_length(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Chunks of texts of at most CHUNK_CHARS characters, or one longer text, and where each begins."""
    lengths = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    begin = 0
    while begin < len(column):
        before = ends[begin] - lengths[begin]
        end = max(begin + 1, int(np.searchsorted(ends, before + CHUNK_CHARS, side="right")))
        yield begin, [text or "" for text in column.slice(begin, end - begin).to_pylist()]
        begin = end


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True,
                     text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``key``, ``n_tokens``, ``ids`` (if ``with_ids``), ``ids_sha256`` of
    the ids as little-endian unsigned 32-bit integers, and ``decoded_sha256`` of their bytes."""
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key_type = docs.schema[key].dataType.simpleString()
    schema = (f"`{key}` {key_type}, n_tokens long" + ", ids array<int>" * with_ids
              + ", ids_sha256 string, decoded_sha256 string")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        for batch in batches:
            for begin, texts in chunks_by_length(batch.column(1)):
                ids, counts = coder.encode_texts(texts)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                own = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                columns = [batch.column(0).slice(begin, len(texts)), pa.array(counts, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()),
                                                            pa.array(ids, pa.int32())))
                columns.append(pa.array(hashlib.sha256(part.astype("<u4").tobytes()).hexdigest()
                                        for part in own))
                columns.append(pa.array(hashlib.sha256(coder.decode(part)).hexdigest()
                                        for part in own))
                names = [key, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(key, text).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str,
                     key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` of rows with ``ids``; bytes that are not UTF-8 become U+FFFD."""
    ship_code(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key_type = encoded.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        for batch in batches:
            texts = [coder.decode(np.array(ids or [], dtype=np.int64)).decode("utf-8", "replace")
                     for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             [key, "text"])

    return encoded.select(key, "ids").mapInArrow(decode, f"`{key}` {key_type}, text string")
