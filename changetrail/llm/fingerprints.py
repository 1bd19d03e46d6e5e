"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame functions.

A text is cut at line breaks into paragraphs and every paragraph into pieces, short ones first and
then of ``PIECE`` code points, so that an edit inside a paragraph still shows where it starts. The
digests of pieces make that of the paragraph, the digests of ``SECTION`` paragraphs that of the
section, and those of all sections the root. A fingerprint is the text

    root / section : piece piece . piece piece . ... ; section : ...

with the root as SHA-256, a section's digest and, for each of its paragraphs, the short digests of
its pieces. Equal texts have equal fingerprints; unequal roots mean unequal texts; sections and
paragraphs that differ are those that were edited. The likeness of two fingerprints is twice the
number of piece digests that both have, over the number of each (a multiset, 1 for equal ones).

The next document is the one with the next greater doc_id; after the last comes the first. Only
ids are ranked globally. Texts move by doc_id once; of the next one its fingerprint and as many code
points as the edit takes are sent on.

Results: null counts as empty; the empty text has a fingerprint of its own; rows that repeat a
doc_id are all fingerprinted, and the one of them with the least text is the neighbour of
the document before (and has the same next document); a missing doc_id sorts first; one document
alone is its own next; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetrail.llm.ranking import ranked
from changetrail.llm.storage import written

SECTION = 8
HEAD_PIECES = (8, 8, 16)
PIECE = 32
PIECE_DIGITS = 6
SECTION_DIGITS = 16
NO_ID = -(2**63)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(paragraph: Column) -> Column:
    """The paragraph in pieces whose bounds depend on the distance from its start only."""
    parts, at = [], 1
    for size in HEAD_PIECES:
        parts.append(F.substring(paragraph, at, size))
        at += size
    rest = F.regexp_extract_all(F.substring(paragraph, at, 2**31 - 1), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.filter(F.concat(F.array(*parts), rest), lambda x: x != "")


def piece_digests(paragraph: Column) -> Column:
    return F.array_join(F.transform(pieces(paragraph), lambda x: F.right(
        F.lpad(F.lower(F.hex(F.xxhash64(x))), 16, "0"), F.lit(PIECE_DIGITS))), "")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text that is not null."""
    paragraphs = F.transform(F.split(text, "\n"), lambda x: F.struct(
        piece_digests(x).alias("pieces"), F.xxhash64(x).alias("digest")))

    def tree(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(own), F.lit(SECTION))
        sections = F.transform(starts, lambda at: let(F.slice(own, at, F.lit(SECTION)), lambda part: F.concat(
            F.substring(F.sha2(F.array_join(F.transform(part, lambda p: p["digest"].cast("string")), ","), 256),
                        1, SECTION_DIGITS),
            F.lit(":"), F.array_join(F.transform(part, lambda p: p["pieces"]), "."))))
        return let(F.array_join(sections, ";"), lambda body: F.concat(F.sha2(F.concat(body, F.sha2(text, 256)), 256), F.lit("/"), body))

    return let(paragraphs, tree)


def _digests(print_: Column) -> Column:
    """All piece digests of a fingerprint, those that repeat numbered apart."""
    body = F.substring_index(print_, "/", -1)
    plain = F.regexp_replace(body, F.lit(r"[0-9a-f]{16}:|[.;]"), F.lit(""))
    return F.array_sort(F.regexp_extract_all(plain, F.lit(f".{{{PIECE_DIGITS}}}"), F.lit(0)))


def _numbered(sorted_: Column) -> Column:
    """A sorted array with every repeat told apart: the n-th of equal entries gets the suffix n.

    The first place of an entry comes from a running maximum over the places where entries change.
    """
    changes = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | (
        F.get(sorted_, i) != F.get(sorted_, i - 1)))
    return F.when(F.size(sorted_) == F.size(F.array_distinct(sorted_)), sorted_).otherwise(
        let(changes, lambda c: F.flatten(F.transform(c, lambda start, k: let(
            F.coalesce(F.get(c, k + 1), F.size(sorted_)) - start, lambda n: F.transform(
                F.sequence(F.lit(1), n), lambda j: F.concat(F.get(sorted_, start), j.cast("string"))))))))


def numbered_digests(print_: Column) -> Column:
    numbered = let(_digests(print_), lambda d: F.when(F.size(d) == 0, d).otherwise(_numbered(d)))
    # The first of equal entries has no suffix in one branch and 1 in the other.
    return F.transform(numbered, lambda x: F.when(F.length(x) == PIECE_DIGITS, F.concat(x, F.lit("1"))).otherwise(x))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, from 0 to 1."""
    both = let(numbered_digests(a), lambda x: let(numbered_digests(b), lambda y: F.when(
        F.size(x) + F.size(y) > 0, 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(0.0)))
    return F.when(a == b, 1.0).otherwise(F.least(both, F.lit(1.0)))


def edited_sections(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the sections of ``a`` whose branch is not at the same place in ``b``."""
    parts = lambda x: F.split(F.substring_index(x, "/", -1), ";")
    return let(parts(a), lambda x: let(parts(b), lambda y: F.filter(
        F.sequence(F.lit(0), F.size(x) - 1), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))))


def neighbours(docs: DataFrame) -> DataFrame:
    """``id, next_id, half`` from ``docs(id, text)``: the next id and the code points that the
    edit of the longest text of this id takes from it."""
    ids = docs.groupBy("id").agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("half"))
    places = written(ranked(ids, [F.col("id")], "place"), "places")
    total = places.count()
    before = places.select(F.pmod(F.col("place") - 1, F.lit(max(total, 1))).alias("place"),
                           F.col("id").alias("next_id"))
    return written(places.join(before, "place").select("id", "next_id", "half"), "neighbours")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` and ``edited``: the numbers of the sections that the edit changes."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    near = neighbours(rows)
    sent = rows.join(near.select(F.col("next_id").alias("id"), F.col("id").alias("to"), "half"), "id")
    sent = (sent.select("to", F.struct(F.expr("substring(text, 1, half)").alias("head"),
                                       fingerprint(F.col("text")).alias("print"),
                                       F.xxhash64("text").alias("order")).alias("next")))
    repeated = written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated")
    if not repeated.isEmpty():
        sent = sent.groupBy("to").agg(F.min_by("next", "next.order").alias("next"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"),
                      F.substring(F.col("next.head"), F.lit(1), half))
    joined = (rows.join(sent.withColumnRenamed("to", "id"), "id")
              .select("id", n.cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint"),
                      edited.alias("edited_text"), F.col("next.print").alias("next_print"))
              .withColumn("edited_fingerprint", fingerprint(F.col("edited_text"))))
    return joined.select(
        F.when(F.col("id") != NO_ID, F.col("id")).cast(docs.schema[key].dataType).alias(key), "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
        edited_sections(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited"))
