"""Mixes sources to target weights along a curriculum whose weights change during training.

Every source has a share of all words by its weight, at most ``REPEATS`` times its own words; what
it can't take goes to the others by weight until none is above. Each source also has a schedule,
a line through (time, weight) points over training time 0 to 1. The integral of the schedule is
the source's cumulative demand. The documents of a source stand in the order of a hash, one pass
after another, until its target is met; the last document is cut at the target. The place of a
document's first word in that sequence, as a share of the target, is put into the inverse of the
demand, and the time so found is its training position. Documents are range-sorted by position.

A source may hold any share of all rows: cumulative sizes come from sums over leaves of about
``LEAF_ROWS`` rows, by hash, and over groups of ``LEAF_ROWS`` leaves, never from one window over a
source. Everything is DataFrame functions.

Results: null and empty texts have size 0 and are not taken; a null source is a source, and ranks
last; a repeated row counts as often as it occurs; rows equal in id and text become one document
with all the copies in ``mixed_documents``; an empty table gives an empty table. Other columns are
carried by ``mixed_documents`` and ignored by ``assign``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changetrail.llm.ranking import ranked
from changetrail.llm.storage import written

WORD = r"[^\x20\x09-\x0D]+"
WORDS_WITH_GAPS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
REPEATS = 3
# The sources' schedules, repeating in the same way as the weights.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)),
             ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)))
LEAF_ROWS = 512
Schedule = tuple[tuple[float, float], ...]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def segments(schedule: Schedule) -> Column:
    """The pieces of a schedule scaled to area 1: begin, weight there, slope, area before."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
    pieces, before = [], 0.0
    for (t0, v0), (t1, v1) in zip(schedule, schedule[1:]):
        pieces.append(F.struct(F.lit(t0).alias("t"), F.lit(v0 / area).alias("v"),
                               F.lit((v1 - v0) / (t1 - t0) / area).alias("slope"),
                               F.lit(before).alias("before")))
        before += (t1 - t0) * (v0 + v1) / 2 / area
    return F.array(*pieces)


def time_of(share: Column, pieces: Column) -> Column:
    """The time at which a schedule has asked for ``share`` of its demand."""
    piece = F.element_at(F.filter(pieces, lambda x: x["before"] <= share), -1)
    rest = share - piece["before"]
    root = F.sqrt(F.greatest(piece["v"] * piece["v"] + 2 * piece["slope"] * rest, F.lit(0.0)))
    step = F.when(piece["slope"] == 0, rest / F.nullif(piece["v"], F.lit(0.0))).otherwise(
        (root - piece["v"]) / piece["slope"])
    return F.least(piece["t"] + F.coalesce(step, F.lit(0.0)), F.lit(1.0))


def cycle(values: list[Column], rank: str) -> Column:
    return F.element_at(F.array(*values), (F.col(rank) % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source_key, rank, source_size, target`` of every source."""
    sources = sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    sources = ranked(sources, [F.col("source").isNull(), F.col("source")]).withColumn(
        "weight", cycle([F.lit(float(w)) for w in weights], "rank"))
    sources = written(sources, "sources")
    total, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)),
                                F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    full = REPEATS * F.col("source_size")
    level, capped_before = total / weight, -1
    while True:  # each turn caps at least one source more
        capped = F.col("weight") * level >= full
        number, words, free = sources.agg(
            F.count(F.when(capped, 1)), F.coalesce(F.sum(F.when(capped, full)), F.lit(0)),
            F.sum(F.when(~capped, F.col("weight")))).first()
        if number == capped_before or not free:
            break
        level, capped_before = (total - words) / free, number
    return sources.withColumn("target", F.least(F.col("weight") * level, full.cast("double")))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
           schedules: tuple[Schedule, ...] = SCHEDULES) -> DataFrame:
    """One row per input row: ``key, draw`` (a hash of id and text), ``size, source_size, target,
    taken`` and ``copies``: an array of (position, words) with an entry for each pass."""
    sized = written(docs.select(
        F.col(key).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("source_key"),
        F.xxhash64(key, text).alias("draw")), "sized")
    targets = source_targets(sized)
    leaves = max(1, -(-sized.count() // LEAF_ROWS))
    place = F.shiftrightunsigned("draw", 11) / F.lit(float(2**53))
    sized = sized.withColumn("leaf", F.floor(place * leaves).cast("long"))
    group = F.floor(F.col("leaf") / LEAF_ROWS).cast("long")
    earlier = (Window.unboundedPreceding, -1)
    by_leaf = (sized.groupBy("source_key", "leaf").agg(F.sum("size").alias("words"))
               .withColumn("branch", group))
    by_branch = by_leaf.groupBy("source_key", "branch").agg(F.sum("words").alias("words"))
    in_source = Window.partitionBy("source_key").orderBy("branch").rowsBetween(*earlier)
    in_branch = Window.partitionBy("source_key", "branch").orderBy("leaf").rowsBetween(*earlier)
    by_branch = by_branch.select("source_key", "branch", F.coalesce(
        F.sum("words").over(in_source), F.lit(0)).alias("branch_before"))
    plan = (by_leaf.withColumn("leaf_before", F.coalesce(F.sum("words").over(in_branch), F.lit(0)))
            .join(by_branch, ["source_key", "branch"])
            .join(targets.select("source_key", "rank", "source_size", "target"), "source_key")
            .select("source_key", "leaf", (F.col("branch_before") + F.col("leaf_before")).alias("base"),
                    "source_size", "target", "rank"))
    in_leaf = (Window.partitionBy("source_key", "leaf").orderBy("draw", "id", "size")
               .rowsBetween(*earlier))
    placed = (sized.withColumn("start", F.coalesce(F.sum("size").over(in_leaf), F.lit(0)))
              .join(written(plan, "plan"), ["source_key", "leaf"])
              .withColumn("start", F.col("start") + F.col("base"))
              .withColumn("words", F.round("target").cast("long"))
              .withColumn("pieces", cycle([segments(s) for s in schedules], "rank")))
    passes = F.transform(F.array(*[F.lit(i) for i in range(REPEATS)]), lambda i: F.struct(
        (i * F.col("source_size") + F.col("start")).alias("at"),
        F.greatest(F.least(F.col("words") - (i * F.col("source_size") + F.col("start")),
                           F.col("size")), F.lit(0)).alias("words")))
    copies = F.transform(F.filter(passes, lambda x: x["words"] > 0), lambda x: F.struct(
        time_of(x["at"] / F.col("words").cast("double"), F.col("pieces")).alias("position"),
        x["words"].alias("words")))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["words"])
    return (placed.withColumn("copies", copies)
            .select(F.col("id").alias(key), "draw", "size", "source_size", "target",
                    taken.alias("taken"), "copies"))


def training_order(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``assign`` by the position of their first copy; rows not taken come first."""
    return (assigned.withColumn("position", F.get("copies", F.lit(0))["position"])
            .orderBy("position", key, "draw"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    source: str = "source") -> DataFrame:
    """The training sequence: a row of ``docs`` for each copy, sorted by training position.

    The one copy of a source that its target cuts keeps its first words; ``n_chars`` follows.
    """
    assigned = assign(docs, key, text, source)
    chosen = assigned.groupBy(F.col(key).alias("id"), F.col("draw").alias("chosen_draw")).agg(
        F.flatten(F.collect_list("copies")).alias("copies"), F.first("size").alias("size"))
    # The whole row in one column: no name of docs can clash with ours.
    drawn = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
                        F.col(key).alias("key"), F.xxhash64(key, text).alias("draw"))
    same = F.col("key").eqNullSafe(F.col("id")) & (F.col("draw") == F.col("chosen_draw"))
    joined = drawn.join(chosen.where(F.size("copies") > 0), same).dropDuplicates(["key", "draw"])
    copies = joined.select("row", "key", "draw", "size", F.explode("copies").alias("copy"))
    whole = F.col("copy.words") >= F.col("size")
    body = F.col(f"row.`{text}`")
    first = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORDS_WITH_GAPS), F.lit(0)),
                                 F.lit(1), F.col("copy.words").cast("int")), "")
    order = [F.col("copy.position"), F.col("key"), F.col("draw")]
    columns = []
    for name in docs.columns:
        column = F.col(f"row.`{name}`")
        if name == text:
            column = F.when(whole, body).otherwise(first)
        elif name == "n_chars":
            length = F.length(first).cast(docs.schema["n_chars"].dataType)
            column = F.when(whole, column).otherwise(length)
        columns.append(column.alias(name))
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)
