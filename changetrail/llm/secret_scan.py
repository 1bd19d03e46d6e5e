"""Secret scans: three fixed patterns, and Markov models for other strings that look random.

The models are two tables of character transitions. One is trained on strings labelled secret: the
values that the fixed patterns find anywhere in the table, at most ``SECRET_SAMPLE`` of them by
hash; the other on strings labelled ordinary: the runs of word characters outside these findings
in ``ORDINARY_DOCS`` documents, by hash of the id. A run of ``RUN`` characters or more is reported
if the log-likelihood ratio of its transitions is at least ``LEAST_RATIO`` in all and
``LEAST_PER_STEP`` per transition, and it overlaps no finding of the patterns.

Positions count code points, end exclusive. Java's expressions find leftmost matches that don't
overlap; the places follow from the lengths of matches and of the text between them.

Results: null and empty texts have no spans; texts are scanned whole, whatever their length; without
any labelled secret no run is reported; repeated rows are scanned alike; an empty table gives an
empty table; other columns are ignored. Everything is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetrail.llm.storage import written

# Names and patterns of the findings.
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{12,}"  # what AKIA[A-Z0-9]+ finds of 16 characters or more
HEX = r"[0-9a-f]{32,}"  # what [0-9a-f]+ finds of 32 characters or more
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_VALUE = 8

RUN = 20
RUNS = "[A-Za-z0-9+/_=-]"
SECRET_SAMPLE = 20_000
ORDINARY_DOCS = 2_000
ORDINARY_RUN = 4
LEAST_RATIO = 12.0
LEAST_PER_STEP = 0.6
SMOOTHING = 0.5
FIRST, SYMBOLS = 33, 94  # printable ASCII


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(values: Column) -> Column:
    """For each place of an array of numbers the sum of those before it, by blocks of about the
    square root of its length."""
    def of_block(block: Column) -> Column:
        zero = F.lit(0).cast("long")
        add = lambda total, x: total + x
        blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(values, b * block + 1, block), zero, add))
        return let(sums, lambda own: let(
            F.transform(blocks, lambda b: F.aggregate(F.slice(own, F.lit(1), b), zero, add)),
            lambda before: F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.get(
                before, F.floor(i / block).cast("int")) + F.aggregate(
                F.slice(values, F.floor(i / block).cast("int") * block + 1, F.pmod(i, block)), zero, add))))

    return F.when(F.size(values) > 0, let(F.ceil(F.sqrt(F.size(values))).cast("int"), of_block)) \
        .otherwise(F.array().cast("array<bigint>"))


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """``(start, kind, end)`` of all matches for which ``keep(match, number)`` holds."""
    def located(matches: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
        sizes = F.transform(matches, lambda x: F.length(x).cast("long"))
        return let(gaps, lambda g: let(sizes, lambda s: let(
            sums_before(F.zip_with(F.slice(g, F.lit(1), F.size(s)), s, lambda a, b: a + b)),
            lambda before: F.transform(matches, lambda m, i: F.struct(
                (F.get(before, i) + F.get(g, i)).alias("start"), F.lit(kind).alias("kind"),
                (F.get(before, i) + F.get(g, i) + F.get(s, i)).alias("end"), m.alias("match"))))))

    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    if keep is not None:
        found = F.filter(found, keep)
    plain = F.transform(found, lambda x: F.struct(x["start"], x["kind"], x["end"]))
    return F.when(text.rlike(pattern), plain).otherwise(empty)


def assign_spans(text: Column) -> Column:
    """Matches of ASSIGN whose value is long enough."""
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)),
                              lambda value: F.length(value) >= ASSIGN_VALUE)
    every = spans(text, ASSIGN, 0)
    return F.when(text.rlike(ASSIGN), let(long_enough, lambda ok: F.filter(
        every, lambda x, i: F.get(ok, i)))).otherwise(every)


def span_text(found: Column) -> Column:
    name = lambda x: F.element_at(F.array(*[F.lit(kind) for kind in KINDS]), x["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(
        ":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


# --- models ------------------------------------------------------------------------------
def steps(run: Column) -> Column:
    """The transitions of a run of printable characters, as numbers below SYMBOLS squared."""
    codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)
    return let(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))),
                                           F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))),
                                           lambda a, b: a * SYMBOLS + b))


def transition_counts(runs: DataFrame) -> list[float]:
    """Counts of all transitions of ``runs(run)``: at most SYMBOLS squared numbers."""
    counts = [0.0] * (SYMBOLS * SYMBOLS)
    for row in runs.select(F.explode(steps(F.col("run"))).alias("step")).groupBy("step").count().collect():
        counts[row["step"]] = float(row["count"])
    return counts


def log_ratios(secret: list[float], ordinary: list[float]) -> list[float]:
    """log P(next | this, secret) - log P(next | this, ordinary), both smoothed."""
    ratios = []
    for a in range(SYMBOLS):
        rows = [table[a * SYMBOLS:(a + 1) * SYMBOLS] for table in (secret, ordinary)]
        totals = [sum(row) + SMOOTHING * SYMBOLS for row in rows]
        ratios += [math.log((x + SMOOTHING) / totals[0]) - math.log((y + SMOOTHING) / totals[1])
                   for x, y in zip(*rows)]
    return ratios


def train(docs: DataFrame, key: str, text: str) -> list[float] | None:
    """Log ratios of all transitions; none without labelled secrets."""
    body = F.coalesce(F.col(text), F.lit(""))
    values = F.concat(F.filter(F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)),
                               lambda x: F.length(x) >= ASSIGN_VALUE),
                      F.regexp_extract_all(body, F.lit(ACCESS), F.lit(0)),
                      F.regexp_extract_all(body, F.lit(HEX), F.lit(0)))
    found = body.rlike(f"{ASSIGN}|{ACCESS}|{HEX}")
    secrets = written(docs.where(found).select(F.explode(values).alias("run")).distinct()
                      .orderBy(F.xxhash64("run"), "run").limit(SECRET_SAMPLE), "secrets")
    if secrets.isEmpty():
        return None
    chosen = written(docs.select(F.col(key).alias("_chosen")).distinct()
                     .orderBy(F.xxhash64("_chosen"), "_chosen").limit(ORDINARY_DOCS), "ordinary")
    # Broadcast: at most ORDINARY_DOCS ids.
    texts = docs.join(F.broadcast(chosen), F.col(key).eqNullSafe(F.col("_chosen")), "left_semi")
    rest = F.regexp_replace(body, F.lit(f"{ASSIGN}|{ACCESS}|{HEX}"), F.lit(" "))
    ordinary = texts.select(F.explode(F.regexp_extract_all(
        rest, F.lit(f"{RUNS}{{{ORDINARY_RUN},}}"), F.lit(0))).alias("run"))
    return log_ratios(transition_counts(secrets), transition_counts(ordinary))


def markov_spans(text: Column, base: Column, ratios: list[float] | None) -> Column:
    if ratios is None:
        return F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")

    def random(run: Column) -> Column:
        ratio = F.aggregate(steps(run), F.lit(0.0), lambda total, step: total + F.element_at(table, step + 1))
        return let(ratio, lambda r: (r >= LEAST_RATIO) & (r >= LEAST_PER_STEP * (F.length(run) - 1)))

    found = spans(text, f"{RUNS}{{{RUN},}}", 3, lambda x: random(x["match"]))
    return F.filter(found, lambda x: ~F.exists(
        base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row ``key, n_assign, n_access, n_hex, n_markov, base_sha256, spans`` and
    ``found``: the spans as an array of (start, kind, end), kinds numbered as in KINDS."""
    docs = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ratios = train(docs, key, "_text")
    rows = docs
    body = F.col("_text")
    kinds = rows.select(key, "_text", assign_spans(body).alias("_assign"),
                        spans(body, ACCESS, 1).alias("_access"), spans(body, HEX, 2).alias("_hex"))
    base = kinds.withColumn("_base", F.concat("_assign", "_access", "_hex"))
    marked = base.withColumn("_markov", markov_spans(body, F.col("_base"), ratios))
    size = lambda name: F.size(name).cast("long")
    return marked.select(
        key, size("_assign").alias("n_assign"), size("_access").alias("n_access"),
        size("_hex").alias("n_hex"), size("_markov").alias("n_markov"),
        F.sha2(span_text(F.col("_base")), 256).alias("base_sha256"),
        span_text(F.concat("_base", "_markov")).alias("spans"),
        F.array_sort(F.concat("_base", "_markov")).alias("found"))
