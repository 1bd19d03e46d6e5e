"""Similarity join of documents on word n-grams, by count vectors in R-trees.

A document's set holds its distinct shingles of ``WORDS`` words. Two documents link if the sets have a
Jaccard similarity of ``NUMERATOR / DENOMINATOR`` or more; components are what links reach.

Counts. The shingles of a set are hashed into groups, and the numbers per group are the coordinates of
a point. Two sets share at most the sum, over the groups, of the smaller of both counts. Points are
packed into an R-tree by splitting along the widest coordinate. For a node the largest count
per group and the least size bound what any set in it shares with the query, so whole branches are passed
over; pairs that survive at the leaves are verified on their full sets.

Shards. A linked pair of sizes x and y differs in at most (x + y) / 19 shingles. With more groups than
that, at least one group of shingles is the same in both. So documents meet in the shards named by the
contents of one of their groups, and every shard has a tree of its own. ``SPARE`` extra groups let each document
leave out its lightest ones: of the groups that a pair has in common the heaviest is kept by both. Sizes
are divided into classes, each with its own number of groups; a document also enters the lower class if a
partner may be there. Shards with the same documents are one shard.

Hot groups. Equal sets are one point. A shard is dealt into chunks of about ``CHUNK`` documents. First
each document is compared with its ``NEAREST`` best partners of its chunk only, and what links is
contracted to components. Then documents of one shard in different components meet, chunk by
chunk: nodes that hold the query's component alone are passed over as well. Nothing is left out.

Results: null and empty texts, and texts without words, have no shingles and link with nothing; a text
with fewer than ``WORDS`` words is one shingle; very long texts are taken whole; equal texts link; rows
that share a doc_id are one node, whatever their texts; rows without a doc_id take no part
(component null); ties of bounds go to the earlier row, and change no component; an empty
table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changetrail.llm.components import connected_components
from changetrail.llm.shipping import ship_code
from changetrail.llm.storage import small_side, written
from changetrail.llm.text_arrays import column_shingles, mix, ragged

WORDS = 3
NUMERATOR, DENOMINATOR = 9, 10
GROWTH = 3 / 2       # of the largest size of a class to that of the class before
SPARE = 4            # one extra group, and another one for so many that a pair may differ in
FINER = 4            # coordinates for each group
LEAST_COORDINATES, MOST_COORDINATES = 16, 256
LEAF, FANOUT = 16, 8
CHUNK = 1024
NEAREST = 2
BLOCK = 1 << 21      # numbers compared at once


def class_tops() -> list[int]:
    """The largest size of each class, up to 2^40 shingles."""
    tops = [1]
    while tops[-1] < 2**40:
        tops.append(max(tops[-1] + 1, int(tops[-1] * GROWTH)))
    return tops


TOPS = np.array(class_tops())


def most_different(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many shingles linked sets of these sizes may differ."""
    return (DENOMINATOR - NUMERATOR) * (x + y) // (DENOMINATOR + NUMERATOR)


# Per class: how many shingles may differ, spare groups, groups, coordinates.
DIFFER = most_different(TOPS, TOPS * DENOMINATOR // NUMERATOR)
EXTRA = DIFFER // SPARE + 1
GROUPS = DIFFER + 1 + EXTRA
COORDINATES = np.clip(2 ** np.ceil(np.log2(GROUPS * FINER)).astype(np.int64),
                      LEAST_COORDINATES, MOST_COORDINATES)


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, class) for every class that a set of each size enters."""
    own = np.searchsorted(TOPS, sizes)
    rows, classes = [np.arange(len(sizes))], [own]
    lower = own - 1
    live = np.arange(len(sizes))
    while len(live):
        reached = (lower >= 0) & (TOPS[np.maximum(lower, 0)] * DENOMINATOR >= sizes[live] * NUMERATOR)
        live, lower = live[reached], lower[reached]
        rows.append(live)
        classes.append(lower)
        lower = lower - 1
    rows, classes = np.concatenate(rows), np.concatenate(classes)
    useful = DIFFER[classes] > 0  # else equal sets alone can link
    return rows[useful], classes[useful]


def grouped(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray, classes: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and coordinates of sets in classes: flat keys, their number each, flat coordinates, likewise."""
    sizes = np.diff(bounds)[rows]
    tokens = values[ragged(bounds[rows], sizes)]
    groups, differ, coordinates = GROUPS[classes], DIFFER[classes], COORDINATES[classes]
    base = np.cumsum(groups) - groups
    group = (mix(tokens) % np.repeat(groups, sizes).astype(np.uint64)).astype(np.int64)
    at = np.repeat(base, sizes) + group
    total = int(groups.sum())
    counts = np.bincount(at, minlength=total)
    digest = np.zeros(total, dtype=np.uint64)
    np.add.at(digest, at, mix(tokens ^ np.uint64(0xA0761D6478BD642F)))
    owner = np.repeat(np.arange(len(rows)), groups)
    index = ragged(np.zeros(len(rows), dtype=np.int64), groups)
    name = mix((classes[owner] << 40 | index).astype(np.uint64))
    keys = mix(digest ^ mix(counts.astype(np.uint64) ^ name))
    # Each set leaves out its lightest groups; a group's own number breaks ties.
    by = np.lexsort((index, counts, owner))
    left = by[ragged(base + groups - differ - 1, differ + 1)]
    # Coordinates split each group further where there are enough of them.
    fine = mix(tokens ^ np.uint64(0xE7037ED1A0B428DB)) % np.repeat(coordinates, sizes).astype(np.uint64)
    start = np.cumsum(coordinates) - coordinates
    points = np.bincount(np.repeat(start, sizes) + fine.astype(np.int64), minlength=int(coordinates.sum()))
    return keys[left].view(np.int64), differ + 1, points.astype(np.int32), coordinates


def list_column(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                    pa.array(flat))


def sketch_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, n, set_a, set_b`` (a digest of the set) and ``filed``: per class its keys and coordinates."""
    schema = ("id long, n long, set_a long, set_b long, "
              "filed array<struct<class:int,keys:array<long>,point:array<int>>>")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, values, sizes in column_shingles(batch.column(1), WORDS):
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                digests = []
                for part in (values, mix(values ^ np.uint64(0x5851F42D4C957F2D))):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
                    digests.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
                some = np.flatnonzero(sizes)
                rows, classes = places(sizes[some])
                by = np.argsort(some[rows], kind="stable")
                rows, classes = some[rows][by], classes[by]
                keys, n_keys, points, n_points = grouped(values, bounds, rows, classes)
                entries = pa.StructArray.from_arrays(
                    [pa.array(classes, pa.int32()), list_column(keys, n_keys),
                     list_column(points, n_points)], ["class", "keys", "point"])
                per_row = np.bincount(rows, minlength=end - begin)
                filed = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), entries)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(sizes, pa.int64()),
                     pa.array(digests[0]), pa.array(digests[1]), filed],
                    ["id", "n", "set_a", "set_b", "filed"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(sketch, schema)


# --- R-tree ------------------------------------------------------------------------------------
def may_link(shared: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of sizes x and y that share at most ``shared`` shingles may link."""
    return (DENOMINATOR + NUMERATOR) * shared >= NUMERATOR * (x + y)


class RTree:
    """Points packed into leaves of neighbours, with the largest counts and least size of every node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, components: np.ndarray):
        order = np.arange(len(points))
        segments, leaves = [(0, len(points))], []
        while segments:
            begin, end = segments.pop()
            if end - begin <= LEAF:
                leaves.append(begin)
                continue
            own = order[begin:end]
            part = np.concatenate([points[own], sizes[own, None]], axis=1)
            widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            order[begin:end] = own[np.argsort(part[:, widest], kind="stable")]
            middle = (begin + end) // 2
            segments += [(begin, middle), (middle, end)]
        self.order, self.size = order, len(points)
        self.starts = np.sort(np.array(leaves))
        self.levels = []
        most = np.maximum.reduceat(points[order], self.starts, axis=0)
        least = np.minimum.reduceat(sizes[order], self.starts)
        low = np.minimum.reduceat(components[order], self.starts)
        high = np.maximum.reduceat(components[order], self.starts)
        self.levels.append((most, least, low, high))
        while len(most) > FANOUT:
            at = np.arange(0, len(most), FANOUT)
            most = np.maximum.reduceat(most, at, axis=0)
            least, low, high = (np.minimum.reduceat(least, at), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(high, at))
            self.levels.append((most, least, low, high))

    def search(self, points: np.ndarray, sizes: np.ndarray, components: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) wherever no node on the way rules the pair out, nor a common component."""
        most = self.levels[-1][0]
        query = np.repeat(np.arange(len(points)), len(most))
        node = np.tile(np.arange(len(most)), len(points))
        for level in range(len(self.levels) - 1, -1, -1):
            most, least, low, high = self.levels[level]
            own = components[query]
            same = (own == low[node]) & (own == high[node])
            query, node = query[~same], node[~same]
            shared = overlap(points, query, most, node)
            keep = (may_link(shared, sizes[query], least[node])
                    & (DENOMINATOR * sizes[query] >= NUMERATOR * least[node]))
            query, node = query[keep], node[keep]
            if level:
                below = len(self.levels[level - 1][0])
                counts = np.minimum(FANOUT, below - node * FANOUT)
                query, node = np.repeat(query, counts), ragged(node * FANOUT, counts)
        ends = np.append(self.starts[1:], self.size)
        counts = ends[node] - self.starts[node]
        return np.repeat(query, counts), self.order[ragged(self.starts[node], counts)]


def overlap(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The sum of the smaller counts of ``a[i]`` and ``b[j]``, row by row."""
    out = np.empty(len(i), dtype=np.int64)
    rows = max(1, BLOCK // a.shape[1])
    for begin in range(0, len(i), rows):
        part = slice(begin, begin + rows)
        out[part] = np.minimum(a[i[part]], b[j[part]]).sum(axis=1)
    return out


def surviving(points: np.ndarray, sizes: np.ndarray, components: np.ndarray, left: np.ndarray,
              right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i of ``left``, j of ``right``) that counts and sizes allow, and what they may share."""
    tree = RTree(points[right], sizes[right], components[right])
    pairs = [[], [], []]
    step = max(1, BLOCK // (max(len(right), 1) * 8))
    for begin in range(0, len(left), step):
        some = left[begin:begin + step]
        query, point = tree.search(points[some], sizes[some], components[some])
        i, j = some[query], right[point]
        apart = components[i] != components[j]
        fits = (DENOMINATOR * np.minimum(sizes[i], sizes[j]) >= NUMERATOR * np.maximum(sizes[i], sizes[j]))
        i, j = i[apart & fits], j[apart & fits]
        shared = overlap(points, i, points, j)
        keep = may_link(shared, sizes[i], sizes[j])
        for column, found in zip(pairs, (i, j, shared)):
            column.append(found[keep])
    i, j, shared = (np.concatenate(column) if column else np.zeros(0, np.int64) for column in pairs)
    return i, j, shared


def nearest(i: np.ndarray, j: np.ndarray, shared: np.ndarray, sizes: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """Of each ``i`` the ``NEAREST`` partners by the bound of their similarity."""
    bound = shared / (sizes[i] + sizes[j] - shared)
    by = np.lexsort((j, -bound, i))
    i, j = i[by], j[by]
    first = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
    keep = np.arange(len(i)) - start < NEAREST
    return i[keep], j[keep]


MEMBER = "id long, n long, side int, component long, point array<int>"


def shard_pairs(members: DataFrame, shard: list[str], best_only: bool) -> DataFrame:
    """Candidate pairs ``a < b`` of every shard of ``members``.

    ``side`` is 0 for documents on both sides, 1 and 2 for two chunks that meet.
    """
    dealt = (members.repartition(*shard).sortWithinPartitions(*shard)
             .select(F.xxhash64(*shard).alias("shard"), *[part.split()[0] for part in MEMBER.split(", ")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_shards(batches):
            found = list(pairs_in(table, best_only))
            if found:
                a, b = np.unique(np.concatenate(found), axis=0).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(search, "a long, b long")


def whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, cut where a shard ends: a shard has one chunk or two, so it is small."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        shard = table.column("shard").to_numpy()
        last = len(shard) and int(np.flatnonzero(shard != shard[-1])[-1] + 1 if (shard != shard[-1]).any() else 0)
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def pairs_in(table: pa.Table, best_only: bool) -> Iterator[np.ndarray]:
    """Candidates of some whole shards as rows (a, b), in one go for all shards of few documents."""
    table = table.combine_chunks()
    shard, ids, sizes, side, components = (
        table.column(name).to_numpy() for name in ("shard", "id", "n", "side", "component"))
    column = table.column("point").chunk(0)
    widths = np.diff(column.offsets.to_numpy())
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    ends = np.append(starts[1:], len(shard))
    for width in np.unique(widths[starts]):
        own = widths[starts] == width
        few = own & (ends - starts <= LEAF)
        if few.any():
            rows = ragged(starts[few], (ends - starts)[few])
            left = np.repeat(np.arange(len(rows)), np.repeat((ends - starts)[few], (ends - starts)[few]))
            first = np.repeat(np.cumsum((ends - starts)[few]) - (ends - starts)[few], (ends - starts)[few])
            right = ragged(first, np.repeat((ends - starts)[few], (ends - starts)[few]))
            points = flat[ragged(offsets[rows], widths[rows])].reshape(len(rows), width)
            n, part, kind = sizes[rows], components[rows], side[rows]
            ok = ((part[left] != part[right]) & ((kind[left] == 0) | (kind[left] != kind[right]))
                  & (DENOMINATOR * np.minimum(n[left], n[right]) >= NUMERATOR * np.maximum(n[left], n[right])))
            left, right = left[ok], right[ok]
            shared = overlap(points, left, points, right)
            ok = may_link(shared, n[left], n[right])
            # Of different shards no best ones are mixed up: a row is in one of them.
            yield from ordered(ids[rows], left[ok], right[ok], shared[ok], n, best_only)
        for begin, end in zip(starts[own & ~few], ends[own & ~few]):
            points = flat[offsets[begin]:offsets[end]].reshape(end - begin, width)
            kind = side[begin:end]
            left, right = np.flatnonzero(kind != 2), np.flatnonzero(kind != 1)
            if len(left) and len(right):
                found = surviving(points, sizes[begin:end], components[begin:end], left, right)
                yield from ordered(ids[begin:end], *found, sizes[begin:end], best_only)


def ordered(ids: np.ndarray, i: np.ndarray, j: np.ndarray, shared: np.ndarray, sizes: np.ndarray,
            best_only: bool) -> Iterator[np.ndarray]:
    if best_only:
        i, j = nearest(i, j, shared, sizes)
    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    if (a < b).any():
        yield np.unique(np.stack([a, b], 1)[a < b], axis=0)


# --- join --------------------------------------------------------------------------------------
def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``a, b, linked`` by the full shingle sets of both texts."""
    needed = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    texts = written(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
                    .join(small_side(needed, 16), "id", "left_semi"), "texts")
    both = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, values, sizes in column_shingles(column, WORDS):
            yield from np.split(values, np.cumsum(sizes)[:-1])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                united = len(x) + len(y) - common
                linked.append(united > 0 and DENOMINATOR * common >= NUMERATOR * united)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return both.mapInArrow(compare, "a long, b long, linked boolean")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``."""
    ship_code(docs.sparkSession)
    sketched = written(sketch_sets(docs, key, text), "sets")
    same = ["set_a", "set_b", "n"]
    copies = written(sketched.where("n > 0 and id is not null").groupBy(*same)
                     .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"))
                     .where("rows > 1").drop("rows"), "copies")
    members = written(sketched.drop("filed").join(small_side(copies, 48), same, "left").select(
        "id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "members")
    # One row for each class of equal sets: not those of other ids, nor repeated rows.
    whole = ["id", *same]
    rows = sketched.where("n > 0 and id is not null")
    others = written(rows.select(*whole).join(small_side(copies, 48), same).where("id <> rep")
                     .select(*whole).distinct(), "others")
    repeated = written(rows.groupBy(*whole).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
                       .select(*whole), "repeated")
    firsts = rows.join(small_side(others, 48), whole, "left_anti")
    once = firsts.join(small_side(repeated, 48), whole, "left_anti").select(*whole, "filed")
    again = (firsts.join(small_side(repeated, 48), whole, "left_semi").groupBy(*whole)
             .agg(F.first("filed").alias("filed")))
    filed = written(once.unionByName(again).select("id", "n", F.explode("filed").alias("f"))
                    .select("id", "n", "f.*"), "filed")
    keyed = filed.select("id", "class", F.explode("keys").alias("key"))
    # Shards of two documents or more; of those with the same documents, one.
    half = F.lit(2**32 - 1)
    people = [F.count(F.lit(1)).alias("members"), F.min("id").alias("low"), F.max("id").alias("high"),
              F.sum(F.xxhash64("id").bitwiseAND(half)).alias("x"),
              F.sum(F.shiftrightunsigned(F.xxhash64("id"), 32)).alias("y")]
    shards = written(keyed.groupBy("key", "class").agg(*people).where("low <> high")
                     .groupBy("class", "members", "low", "high", "x", "y").agg(F.min("key").alias("key"))
                     .select("class", "key", F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks")),
                     "shards")
    placed = written(keyed.join(small_side(shards, 40), ["class", "key"]).select(
        "id", "class", "key", "chunks", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk")), "placed")
    points = filed.select("id", "class", "n", "point")

    alone = F.col("id").alias("component")
    first = placed.join(points, ["id", "class"]).select(
        "key", "class", "chunk", "id", "n", F.lit(0).alias("side"), alone, "point")
    tried = written(verified(written(shard_pairs(first, ["class", "key", "chunk"], True).distinct(), "nearest"),
                             docs, key, text), "tried")
    # The classes of one id's different texts are one node.
    several = written(members.where("rep is not null").groupBy("id")
                      .agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").drop("z"), "several")
    joint = members.join(small_side(several, 24), "id").select("a", F.col("rep").alias("b"))
    edges = written(tried.where("linked").select("a", "b").union(joint.where("a <> b").distinct()), "links")
    roots = connected_components(edges)
    # Shards that still hold documents of different components.
    where = placed.join(small_side(roots, 24), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    where = written(where, "where")
    split = written(where.groupBy("class", "key").agg(F.min("component").alias("p"), F.max("component").alias("q"))
                    .where("p <> q").select("class", "key"), "split")
    apart = where.join(small_side(split, 24), ["class", "key"]).join(points, ["id", "class"])
    # Every chunk meets itself and each later one of its shard.
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    meeting = apart.withColumn("other", other).select(
        "key", "class", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"),
        "id", "n", F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1)
        .otherwise(2).alias("side"), "component", "point")
    rest = (shard_pairs(meeting, ["class", "key", "left", "right"], False).distinct()
            .join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    more = written(verified(written(rest, "rest"), docs, key, text).where("linked").select("a", "b"), "more")
    if not more.isEmpty():
        roots = connected_components(edges.union(more))
    return (members.join(roots.select(F.col("id").alias("rep"), "component"), "rep", "left")
            .select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "rep").alias("component_id")))
