"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

Sketch. A document's shingle hashes are thrown into ``BINS`` bins in rounds. In each of the first
``BINS`` rounds every shingle picks a bin at random; in round ``BINS + j`` all go to bin ``j``. A bin
keeps its least (round, hash), and a document stops after the first round that leaves no bin empty.
So every coordinate is filled, however small the set, two sets agree in a coordinate with the
probability of their Jaccard similarity, and the share of agreeing coordinates is concentrated
around it. Bands of ``BAND_ROWS`` coordinates make candidates: at a similarity of 0.75 a pair has
no band in common with probability (1 - 0.75^5)^48 < 3e-6.

No pairs within a group. Equal sets become one class first. In a bucket (the classes with one
band in common) each class is compared with the bucket's least id only; the links found are
contracted to components. Classes of one bucket that are then in different components are compared
too, so no link between different texts is lost, but for pairs that can't be linked because
- the sizes of their sets are too different, or
- their exact distances to the bucket's leader differ by more than the allowed distance (Jaccard
  distance is a metric), or
- both sets are large and their sketches, cut to ``SIGN_PLANES`` bits a coordinate, agree in fewer
  than ``SIGN_AGREE`` of ``BINS`` coordinates: 4.4 standard deviations below what a similarity of
  0.75 gives, so such a pair is passed over with a probability of about 5e-6.
A pair is made in the first of its common buckets only.

Results: null and empty texts, and texts without words, have no shingles, are linked with nothing
and kept; a text with fewer than five words is one shingle; equal texts are linked; rows that share
a doc_id are one node, and each gets the component of its own text; rows without a doc_id take no
part (component null, kept); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetrail.llm.components import connected_components
from changetrail.llm.shipping import ship_code
from changetrail.llm.storage import small_side, written
from changetrail.llm.text_arrays import column_shingles, mix, ragged

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4
BAND_ROWS, BANDS = 5, 48
BINS = 512
SIGN_PLANES = 4
SIGN_WORDS = BINS // 64
SIGN_AGREE = 350
SIGN_LEAST_SET = 64
EMPTY = np.uint64(2**64 - 1)


def sketches(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of BINS filled coordinates per set; ``sizes`` must be positive."""
    table = np.full((len(sizes), BINS), EMPTY, dtype=np.uint64)
    flat = table.ravel()
    live = np.arange(len(sizes))
    base = np.repeat(live * BINS, sizes)
    for turn in range(2 * BINS):
        if not len(live):
            break
        hashed = mix(values ^ mix(np.array([turn + 1], dtype=np.uint64)))
        bins = ((hashed >> np.uint64(40)) % np.uint64(BINS)).astype(np.int64) if turn < BINS \
            else turn - BINS
        low = (hashed & np.uint64(2**40 - 1)) | (np.uint64(turn) << np.uint64(40))
        np.minimum.at(flat, base + bins, low)
        open_rows = (table[live] == EMPTY).any(axis=1)
        if not open_rows.all():
            keep = np.repeat(open_rows, sizes)
            values, base = values[keep], base[keep]
            live, sizes = live[open_rows], sizes[open_rows]
    return table


def band_keys(table: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, its number included."""
    parts = table[:, :BANDS * BAND_ROWS].reshape(len(table), BANDS, BAND_ROWS)
    keys = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(BAND_ROWS):
        keys = mix(keys ^ parts[:, :, j])
    return keys.view(np.int64)


def low_bits(table: np.ndarray) -> np.ndarray:
    """SIGN_PLANES mixed bits of every coordinate, plane by plane in SIGN_WORDS numbers each."""
    mixed = mix(table).reshape(len(table), 1, SIGN_WORDS, 64)
    planes = (mixed >> np.arange(SIGN_PLANES, dtype=np.uint64)[:, None, None]) & np.uint64(1)
    packed = (planes << np.arange(64, dtype=np.uint64)).sum(axis=3, dtype=np.uint64)
    return packed.reshape(len(table), -1).view(np.int64)


def agreeing(x: str, y: str) -> Column:
    """Coordinates in which two columns of ``low_bits`` agree."""
    agree = F.lit(BINS)
    for word in range(SIGN_WORDS):
        differ = F.lit(0).cast("long")
        for plane in range(SIGN_PLANES):
            at = plane * SIGN_WORDS + word
            differ = differ.bitwiseOR(F.col(x)[at].bitwiseXOR(F.col(y)[at]))
        agree = agree - F.bit_count(differ)
    return agree


def sketch_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_shingles, set_a, set_b`` (a 128-bit digest of the set), ``bands`` and ``signs``."""
    schema = "id long, n_shingles long, set_a long, set_b long, bands array<long>, signs array<long>"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, values, sizes in column_shingles(batch.column(1), WORDS):
                n = end - begin
                rows = np.flatnonzero(sizes)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                digest = []
                for part in (values, mix(values ^ np.uint64(0x5851F42D4C957F2D))):
                    sums = np.zeros(len(part) + 1, dtype=np.uint64)
                    np.cumsum(part, out=sums[1:])
                    digest.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
                table = sketches(values, sizes[rows])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, n), pa.array(sizes, pa.int64()),
                    pa.array(digest[0]), pa.array(digest[1]),
                    lists(band_keys(table), rows, n), lists(low_bits(table), rows, n),
                ], ["id", "n_shingles", "set_a", "set_b", "bands", "signs"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(sketch, schema)


def lists(table: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """Rows of a matrix as a list column of ``n`` rows; rows not named get the empty list."""
    counts = np.zeros(n, dtype=np.int64)
    counts[rows] = table.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                    pa.array(table.ravel()))


def compare_texts(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``a, b, common, united``: exact sizes over the full shingle sets of every pair's texts."""
    needed = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    texts = written(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
                    .join(small_side(needed, 16), "id", "left_semi"), "texts")
    both = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for column in (2, 3):
                sets.append([part for _, _, values, sizes in column_shingles(batch.column(column), WORDS)
                             for part in np.split(values, np.cumsum(sizes)[:-1])])
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)]
            united = [len(x) + len(y) - c for x, y, c in zip(*sets, common)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(common, pa.int64()),
                 pa.array(united, pa.int64())], ["a", "b", "common", "united"])

    return both.mapInArrow(compare, "a long, b long, common long, united long")


def linked() -> Column:
    return (DENOMINATOR * F.col("common") >= NUMERATOR * F.col("united")) & (F.col("united") > 0)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``."""
    ship_code(docs.sparkSession)
    sketched = written(sketch_documents(docs, key, text), "sketches")
    # Classes of equal sets; only sets that occur more than once are joined back.
    same = ["set_a", "set_b", "n_shingles"]
    copies = written(sketched.where("n_shingles > 0").groupBy(*same)
                     .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"))
                     .where("rows > 1").drop("rows"), "copies")
    members = sketched.join(small_side(copies, 48), same, "left").withColumn("rep", F.coalesce("rep", "id"))
    single = F.col("id") == F.col("rep")
    members = written(members.select("id", "n_shingles", "rep",
                                     F.when(single, F.col("bands")).alias("bands"),
                                     F.when(single, F.col("signs")).alias("signs")), "members")
    classes = members.where("id = rep and n_shingles > 0")
    # Buckets of two classes or more, each with its least id as leader.
    buckets = written(classes.select("id", F.explode("bands").alias("band"))
                      .groupBy("band").agg(F.min("id").alias("leader"), F.max("id").alias("last"))
                      .where("leader <> last").drop("last"), "buckets")
    filed = written(classes.select("id", F.explode("bands").alias("band"))
                    .join(small_side(buckets, 32), "band"), "filed")
    stars = (filed.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
             .distinct())
    first = written(compare_texts(written(stars, "stars"), docs, key, text), "compared")
    edges = first.where(linked()).select("a", "b")
    roots = connected_components(edges)
    # Buckets whose classes are still apart.
    near = first.groupBy(F.col("a").alias("leader"), F.col("b").alias("id")).agg(
        F.max(F.col("common") / F.col("united")).alias("similarity"))
    placed = (filed.join(near, ["leader", "id"], "left").join(roots, "id", "left")
              .withColumn("component", F.coalesce("component", "id"))
              .withColumn("away", F.when(F.col("id") == F.col("leader"), 0.0)
                          .otherwise(1 - F.coalesce("similarity", F.lit(0.0)))))
    placed = written(placed.drop("similarity"), "placed")
    split = written(placed.groupBy("band").agg(F.min("component").alias("low"),
                                               F.max("component").alias("high"))
                    .where("low <> high").select("band"), "split")
    apart = placed.join(small_side(split, 24), "band").join(
        classes.select("id", F.col("n_shingles").alias("n"), "signs", "bands"), "id")
    apart = written(apart, "apart")
    x, y = apart.alias("x"), apart.alias("y")
    share = NUMERATOR / DENOMINATOR
    rest = (x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id"))
                   & (F.col("x.component") != F.col("y.component"))
                   & (F.col("x.id") != F.col("x.leader"))
                   & (F.least("x.n", "y.n") * DENOMINATOR >= F.greatest("x.n", "y.n") * NUMERATOR)
                   & (F.abs(F.col("x.away") - F.col("y.away")) <= 1 - share + 1e-9)
                   & ((F.least("x.n", "y.n") < SIGN_LEAST_SET) | (agreeing("x.signs", "y.signs") >= SIGN_AGREE))
                   & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band")))
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    second = written(compare_texts(written(rest, "rest"), docs, key, text).where(linked())
                     .select("a", "b"), "more")
    if not second.isEmpty():
        roots = connected_components(edges.union(second))
    done = (members.select("id", "n_shingles", "rep")
            .join(roots.select(F.col("id").alias("rep"), "component"), "rep", "left")
            .select(F.col("id").alias(key), "n_shingles",
                    F.coalesce("component", "rep").alias("component_id")))
    return done.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component left: that with the least id.

    Of rows that share this id, the one with the least text stays (any one of equal rows).
    """
    found = written(near_duplicates(docs, key, text), "near")
    gone = found.where("not kept").select(key).distinct()
    repeated = written(found.where(F.col(key).isNotNull() & F.col("kept")).groupBy(key).count()
                       .where("count > 1").select(key), "repeated")
    other = written(gone.union(repeated), "other")
    left = docs.join(small_side(other, 16), key, "left_anti")
    again = docs.join(small_side(repeated, 16), key, "left_semi")
    columns = [F.col(f"row.`{name}`").alias(name) for name in docs.columns]
    first = F.min_by(F.struct(*[F.col(f"`{name}`") for name in docs.columns]), F.struct(text))
    return (left.select(*docs.columns)
            .unionByName(again.groupBy(key).agg(first.alias("row")).select(*columns)))
