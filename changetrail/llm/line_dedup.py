"""Line deduplication by an exact set-similarity join, in DataFrame functions.

A line's tokens are its distinct five-word shingles as 64-bit hashes; fewer words are one token.
Frequencies of all tokens are counted in ``SLOTS`` slots by hash, and the tokens of a line stand in
the order of their slot's frequency, rarest first. Between the passes a 32-bit hash of each token is
kept, and of these only the prefixes once they are known; that can only make more candidates, as
similarities are taken from the texts of the candidates again. Two lines of Jaccard similarity 0.75 or
more share a token among the first floor(n / 4) + 1 of each (prefix filter), their sizes differ by a
factor of 3/4 at most (length filter), and from the place of a shared token on they have enough tokens
left (positional filter). Lines of the same words, by a 64-bit digest, are one class from the start.

A line is removed if any earlier line, by doc_id and line number, is similar, whether that one
stays or not. So not all pairs are needed: of the lines with a common prefix token each is compared
with the earliest first; only lines still unmatched are compared with the other earlier ones. All three
filters come before any text is read again.

Results: blank lines, null and empty texts stay as they are; case and the kind of white space
between words don't matter; rows that repeat a doc_id (or lack one) and text fare alike; rows
without a doc_id come last, by a hash of the text, as do texts of one doc_id among themselves; an empty table gives an empty table; other columns are carried by
``dedup_lines``, but for those named like its counts; very long texts are split whole; more than 2^35
different texts are an error.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetrail.llm.ranking import ranked
from changetrail.llm.storage import BROADCAST_BYTES, Scratch, small_side, written

WORDS = 5
SLOTS = 1 << 16
LINE_BITS = 28
ID_BITS = 35
SPACES = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_words(lines: DataFrame) -> DataFrame:
    """``lines`` with ``line`` in lower case and one space between words. Only lines with other
    white space are rewritten by a regular expression."""
    own = lines.withColumn("line", F.btrim(F.lower("line"), F.lit(BLANKS)))
    other = functools.reduce(Column.__or__, [F.contains("line", F.lit(blank)) for blank in ("  ", "\t", "\x0b", "\x0c", "\r")])
    return own.withColumn("line", F.when(other, F.regexp_replace("line", SPACES, " ")).otherwise(F.col("line")))


def shingles(line: Column) -> Column:
    """64-bit hashes of the runs of WORDS words of a line of ``with_words``; of all its words if fewer."""
    def of_words(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.slice(w, F.lit(1), n - WORDS + 1),
                           lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WORDS)]))
        return F.when(n >= WORDS, runs).otherwise(F.array(F.xxhash64(w)))

    return let(F.split(line, " "), of_words)


def with_line_order(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """``docs`` with ``_id``: a number of ID_BITS bits in the order of ``key``, nulls last.

    Rows without a key, or of the same key, are ordered by a hash of their text, and only those of
    the same text share a number.
    """
    last = 2**ID_BITS - 1
    rows = docs.select(F.col(key).alias("_key"))
    low, high = rows.agg(F.min("_key"), F.max("_key")).first()
    alone = rows.groupBy("_key").count().where("_key is null or count > 1").isEmpty()
    if alone and (low is None or (low >= 0 and high <= last)):
        return docs.withColumn("_id", F.col(key).cast("long"))
    # Two hashes, as rows without a key may be many.
    own = docs.withColumns({"_key": F.col(key), "_digest": F.xxhash64(text), "_check": F.xxhash64(text, F.lit(1))})
    names = ["_key", "_digest", "_check"]
    ids = ranked(own.select(*names).distinct(),
                 [F.col("_key").asc_nulls_last(), F.col("_digest"), F.col("_check")], "_id")
    ids = ids.select(*[F.col(name).alias(f"_of{name}") for name in names], "_id")
    same = [own[name].eqNullSafe(ids[f"_of{name}"]) for name in names]
    return own.join(ids, same[0] & same[1] & same[2], "left").select(*docs.columns, "_id")


def slot(half: Column) -> Column:
    return half.bitwiseAND(SLOTS - 1)


def slot_ranks(lines: DataFrame) -> Column:
    """An array literal: the place of every slot by the number of its tokens, times 2^32.

    A token's half added to its slot's entry is a code that orders by rank, and by the half within a rank.
    """
    counted = (lines.select(F.explode("halves").alias("half")).groupBy(slot(F.col("half")).alias("slot"))
               .agg(F.count(F.lit(1)).alias("n")).collect())  # at most SLOTS rows
    counts = [0] * SLOTS
    for row in counted:
        counts[row["slot"]] = row["n"]
    ranks = [0] * SLOTS
    for rank, slot_number in enumerate(sorted(range(SLOTS), key=counts.__getitem__)):
        ranks[slot_number] = rank
    return F.split(F.lit(",".join(str(rank << 32) for rank in ranks)), ",").cast("array<bigint>")


def low_half(code: Column) -> Column:
    """What names the half in a code: its bits as a number of 32 bits, in another order."""
    return (code.bitwiseAND(2**32 - 1) - 2**31).cast("int")


def prefix_size(n: Column) -> Column:
    return F.floor(n / 4).cast("int") + 1


def similar_sizes(a: str, b: str) -> Column:
    return F.least(a, b) * 4 >= F.greatest(a, b) * 3


def tokens_left(n_a: str, at_a: str, n_b: str, at_b: str) -> Column:
    """Whether two lines can still share enough tokens, the first shared one included."""
    most = 1 + F.least(F.col(n_a) - F.col(at_a) - 1, F.col(n_b) - F.col(at_b) - 1)
    return most * 7 >= (F.col(n_a) + F.col(n_b)) * 3


def split_lines(docs: DataFrame, text: str) -> DataFrame:
    """``ord, line`` of every line that has words; ``docs`` comes from ``with_line_order``."""
    split = (docs.select("_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
             .where(F.btrim("line", F.lit(BLANKS)) != ""))
    number = F.when(F.col("_id") < 2**ID_BITS, F.col("_id")).otherwise(
        F.raise_error(F.lit(f"more than 2^{ID_BITS} texts")).cast("long"))
    place = F.shiftleft(number, LINE_BITS) + F.least("line_no", F.lit(2**LINE_BITS - 1))
    return split.select(place.alias("ord"), "line")


def chosen_lines(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``ord, line`` of the lines of ``wanted(ord)``; only texts that have some are split."""
    by_doc = written(wanted.groupBy(F.shiftright("ord", LINE_BITS).alias("_id")).agg(
        F.collect_list(F.col("ord").bitwiseAND(2**LINE_BITS - 1).cast("int")).alias("numbers")), "wanted")
    chosen = let(F.split(text, "\n"), lambda own: F.transform(
        "numbers", lambda i: F.struct(i.alias("line_no"), F.get(own, i).alias("line"))))
    # A text may have any number of lines, so these are counted.
    small = (by_doc.agg(F.sum(F.size("numbers"))).first()[0] or 0) * 64 <= BROADCAST_BYTES
    lines = docs.join(F.broadcast(by_doc) if small else by_doc, "_id").select("_id", F.inline(chosen))
    return lines.select((F.shiftleft("_id", LINE_BITS) + F.col("line_no")).alias("ord"), "line")


def later_of(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``ord`` of the later lines of those ``pairs(a, b)``, a before b, that are similar.

    The tokens of these lines are taken from the texts again, all 64 bits of them.
    """
    lines = chosen_lines(docs, text, pairs.select(F.col("a").alias("ord")).union(pairs.select("b")).distinct())
    sets = written(with_words(lines).select("ord", F.array_distinct(shingles(F.col("line"))).alias("tokens")), "sets")
    both = (pairs.join(sets.select(F.col("ord").alias("a"), F.col("tokens").alias("x")), "a")
            .join(sets.select(F.col("ord").alias("b"), F.col("tokens").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    sizes = F.size("x") + F.size("y")
    return (both.select("b", common.alias("common"), sizes.alias("total"))
            .where("common * 4 >= (total - common) * 3").select(F.col("b").alias("ord")).distinct())


def possible_pairs(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """``a, b``: lines of a common token, a of ``earlier`` before b of ``later``, that may be similar yet."""
    a = earlier.select("token", F.col("ord").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    b = later.select("token", F.col("ord").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    return b.join(a, (a["token"] == b["token"]) & (F.col("a") < F.col("b")) & similar_sizes("n_a", "n_b")
                  & tokens_left("n_a", "at_a", "n_b", "at_b")).select("a", "b").distinct()


def prefixes(docs: DataFrame, text: str) -> DataFrame:
    """``ord, n, same, prefix`` of every line: the number of its tokens, a digest of its words, its rarest tokens."""
    lines = with_words(split_lines(docs, text)).select(
        "ord", F.xxhash64("line").alias("same"), let(F.array_distinct(shingles(F.col("line"))), lambda t: F.struct(
            F.size(t).alias("n"), F.transform(t, lambda x: F.hash(x)).alias("halves"))).alias("own"))
    # The halves of all tokens are the largest table, so they go as soon as the prefixes are known.
    with Scratch(docs.sparkSession) as scratch:
        lines = written(lines.select("ord", "same", "own.*"), "lines")
    ranks = slot_ranks(lines)
    # Two tokens of a line may have one code: it counts twice then, as their number does. No entry
    # is null, and an array that says so is sorted as plain numbers.
    code = F.sort_array(F.transform("halves", lambda t: F.coalesce(F.get(ranks, slot(t)), F.lit(0)) + t))
    first = F.transform(F.slice(code, F.lit(1), prefix_size(F.col("n"))), low_half)
    coded = written(lines.select("ord", "n", "same", first.alias("prefix")), "coded")
    scratch.delete()
    return coded


def removed_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``ord`` of every line to remove; ``docs`` comes from ``with_line_order``."""
    coded = prefixes(docs, text)
    # Lines of equal words: all but the first go.
    firsts = written(coded.groupBy("same", "n").agg(F.min("ord").alias("first"),
                                                    F.max("ord").alias("last"))
                     .where("first < last").drop("last"), "firsts")
    marked = coded.join(small_side(firsts, 40), ["same", "n"], "left")
    repeats = marked.where("ord > first").select("ord")
    single = marked.where("first is null or ord = first")
    # Prefix tokens that several classes share.
    postings = single.select("ord", "n", F.posexplode("prefix").alias("at", "token"))
    shared = written(postings.groupBy("token").agg(F.min("ord").alias("leader"), F.max("ord").alias("last"))
                     .where("leader < last").drop("last"), "shared")
    filed = written(postings.join(small_side(shared, 16), "token"), "filed")
    later = filed.where("ord > leader")
    pairs = written(possible_pairs(later, filed.where("ord = leader")), "pairs")
    matched = written(later_of(pairs, docs, text), "matched")
    # Lines not matched so far against the other earlier lines of their tokens.
    rest = written(possible_pairs(later.join(small_side(matched, 16), "ord", "left_anti"), later), "rest")
    more = later_of(rest, docs, text)
    return repeats.union(matched).union(more).distinct()


def without(docs: DataFrame, *names: str) -> list[str]:
    """The columns of ``docs`` that a result of columns ``names`` carries: those of the same name give way."""
    taken = {name.lower() for name in names}
    return [name for name in docs.columns if name.lower() not in taken]


def packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row``, the whole row, and ``key`` and ``_id``: no name of ``docs`` can clash with ours."""
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
                       F.col(key).alias("key"))
    return with_line_order(rows, "key", F.col(f"row.`{text}`")).drop("key")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with later similar lines taken out of ``text``, and two ``counts``: lines, removed ones.

    Columns of ``docs`` with the names of the counts give way to them.
    """
    carried = without(docs, *counts)
    numbered = packed(docs, key, text)
    body = F.col(f"row.`{text}`")
    gone = removed_lines(numbered.select("_id", body.alias("text")))
    by_doc = written(gone.groupBy(F.shiftright("ord", LINE_BITS).alias("_id")).agg(
        F.collect_list(F.col("ord").bitwiseAND(2**LINE_BITS - 1).cast("int")).alias("_gone")), "gone")
    joined = numbered.join(small_side(by_doc, 64), "_id", "left")
    kept = let(F.split(body, "\n"), lambda own: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("_gone")), lambda i: F.get(own, i)))
    return joined.select(
        *[F.when(F.col("_gone").isNull(), body).otherwise(F.array_join(kept, "\n")).alias(text)
          if name == text else F.col(f"row.`{name}`").alias(name) for name in carried],
        F.coalesce(F.size(F.split(body, "\n")), F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(counts[1]))
