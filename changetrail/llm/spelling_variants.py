"""Spelling variants: the words of a corpus, each led to the frequent word that it is a variant of.

Words are runs of letters with A-Z in lower case, and of these the ones of at least ``LEAST_LENGTH``
code points that occur at least ``LEAST_COUNT`` times. Two words are near if one inserted, deleted or
replaced code point turns one into the other. Found with pivotal grams:

- the bigrams of a word, each with its place, are ordered from rare to frequent by the number of
  words that hold them. The prefix of a word is its ``PREFIX`` rarest bigrams and all that are as
  frequent and spelled like the last of them; its last bigram in that order ends the prefix;
- the pivots of a word are two bigrams of its prefix that share no letter, of the least total
  frequency; dynamic programming over the places picks them. ``PREFIX`` bigrams always hold two such;
- one edit spoils at most one of two disjoint bigrams. So of two near words, the one whose prefix ends
  no later has a pivot that the other has too, and has in its prefix;
- one edit moves it by one place at most, and only in words of different lengths, in the direction of
  the difference. Pivots look up prefixes by bigram, place and length, five combinations each;
- one edit changes which letters a word has by two at most. Pairs that pass are compared by edit
  distance.

Only words and their bigrams are joined: the corpus is reduced to counted words by a grouping with
partial sums first, so a word that makes up much of the text is one row per task before it moves.

``form`` of a word is its near word of the largest count (ties: the first in code-point order), if that
is at least ``FORM_RATIO`` times the word's own; ``root`` is what forms lead to in the end. Counts at
least double from form to form, so pointer doubling needs few rounds.

Results: null and empty texts have no words; very long texts are taken whole; a row that repeats
counts again; words of equal counts are not each other's form; a row without a doc_id takes part with
its words as they are; an empty table or one without such words gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changetrail.llm.storage import small_side, written

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LENGTH = 5
LEAST_COUNT = 3
FORM_RATIO = 2
PREFIX = 3           # 2 letters x 1 edit + 1
PAIR_BYTES = 120
# The alphabet has 26 + 64 letters, so there are at most 8,100 bigrams: their table may be broadcast.
GRAMS_BYTES = 8_100 * 64


def with_typos(run: Column, doc_id: Column) -> Column:
    """``run`` without one letter in about one of 97 cases, by the CRC of ``<doc_id>:<run>``."""
    at = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    place = (at % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), place),
                       F.substring(run, place + 2, F.char_length(run)))
    return F.when(at % 97 == 0, shorter).otherwise(run)


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text",
                plant: bool = False) -> DataFrame:
    """``word, n``: the words of all texts that are long and frequent enough.

    ``plant`` drops a letter of some runs first, as ``with_typos`` says.
    """
    runs = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(
        F.translate(F.col(text), UPPER, UPPER.lower()), F.lit(RUN), F.lit(0))).alias("word"))
    if plant:
        runs = runs.withColumn("word", F.coalesce(with_typos(F.col("word"), F.col("key")), "word"))
    return (runs.where(F.char_length("word") >= LEAST_LENGTH)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT))


def cheapest_pair(grams: Column) -> Column:
    """Two entries (place, gram, words) of ``grams`` whose places differ by two at least, of the least
    total frequency; ``grams`` is sorted by place.

    One pass by dynamic programming: ``open`` is the cheapest entry that ends before the current
    one begins, ``last`` the entry right before it, ``best`` the cheapest pair so far.
    """
    gram = "struct<place:int,gram:string,words:bigint>"
    nothing = F.struct(F.lit(None).cast(gram).alias("open"), F.lit(None).cast(gram).alias("last"),
                       F.lit(None).cast(f"struct<cost:bigint,a:{gram},b:{gram}>").alias("best"))

    def cheaper(x: Column, y: Column) -> Column:
        return F.when(x.isNull() | (y["words"] < x["words"]), y).otherwise(x)

    def step(state: Column, entry: Column) -> Column:
        # The entry before may be adjacent, so that it opens only now, or already be apart.
        last, apart = state["last"], entry["place"] - state["last"]["place"] >= 2
        opened = F.when(last.isNotNull() & apart, cheaper(state["open"], last)).otherwise(state["open"])
        cost = opened["words"] + entry["words"]
        better = opened.isNotNull() & (state["best"].isNull() | (cost < state["best"]["cost"]))
        best = F.when(better, F.struct(cost.alias("cost"), opened.alias("a"), entry.alias("b"))
                      ).otherwise(state["best"])
        later = F.when(last.isNotNull(), cheaper(opened, last)).otherwise(opened)
        return F.struct(later.alias("open"), entry.alias("last"), best.alias("best"))

    return F.aggregate(grams, nothing, step, lambda state: F.array(state["best"]["a"], state["best"]["b"]))


def letters(word: Column) -> Column:
    """A bit for each letter that a word has; some accented letters share one."""
    def with_letter(mask: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        bit = F.when(code < 128, code - 97).otherwise(26 + code % 38)
        return mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), with_letter)


def prefixes(words: DataFrame) -> DataFrame:
    """``word, size, letters, prefix, pivots, last``: entries (place, gram, words), and the place in
    the order of bigrams at which the prefix ends."""
    places = F.sequence(F.lit(1), F.col("size") - 1)
    grams = words.select("word", F.char_length("word").alias("size")).select(
        "word", "size", F.explode(places).alias("place")).withColumn(
        "gram", F.substring("word", F.col("place"), F.lit(2)))
    counts = written(grams.select("word", "gram").distinct().groupBy("gram")
                     .agg(F.count(F.lit(1)).alias("words")), "grams")
    # The window is over the bigrams of a fixed alphabet.
    ordered = counts.withColumn("rank", F.row_number().over(Window.orderBy("words", "gram")))
    entry = F.struct("rank", "place", "gram", "words")
    # A word has as many bigrams as letters: the list of one word is as long as the word.
    listed = (grams.join(small_side(ordered, GRAMS_BYTES // 8_100), "gram")
              .groupBy("word", "size").agg(F.sort_array(F.collect_list(entry)).alias("ranked")))
    within = listed.withColumn("last", F.col("ranked")[PREFIX - 1]["rank"])
    by_place = F.sort_array(F.transform(
        F.filter("ranked", lambda g: g["rank"] <= F.col("last")),
        lambda g: F.struct(g["place"].cast("int").alias("place"), g["gram"].alias("gram"),
                           g["words"].alias("words"))))
    return within.select("word", "size", letters(F.col("word")).alias("letters"), by_place.alias("prefix"),
                         "last").withColumn("pivots", cheapest_pair(F.col("prefix")))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: all pairs of near words, each once, ``a`` before ``b``."""
    known = written(prefixes(words), "prefixes")
    indexed = known.select("word", "size", "letters", "last", F.explode("prefix").alias("g")).select(
        F.col("word").alias("other"), F.col("last").alias("other_last"),
        F.col("letters").alias("other_letters"), F.col("g.gram").alias("gram"),
        F.col("g.place").alias("place"), "size")
    # (difference of lengths, shift of the place): an edit of the same length moves nothing.
    moves = F.array(*[F.struct(F.lit(size).alias("longer"), F.lit(shift).alias("shift"))
                      for size, shift in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))])
    probes = known.select("word", "size", "letters", "last", F.explode("pivots").alias("g")).select(
        "word", "letters", "last", "size", "g", F.explode(moves).alias("m")).select(
        "word", "letters", "last", F.abs("m.longer").alias("longer"), F.col("g.gram").alias("gram"),
        (F.col("g.place") + F.col("m.shift")).alias("place"), (F.col("size") + F.col("m.longer")).alias("size"))
    changed = F.bit_count(F.col("letters").bitwiseXOR(F.col("other_letters")))
    near = (probes.join(indexed, ["gram", "place", "size"])
            .where((F.col("last") <= F.col("other_last")) & (changed <= 2 - F.col("longer")))
            .where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)))
    return near.select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word that has a form: each round doubles the steps taken."""
    led = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(led.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        led = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return led


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word that is long and frequent enough."""
    words = written(count_words(docs, key, text, plant), "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.withColumnRenamed("word", "b").withColumnRenamed("n", "n_b"), "b")
    # The largest count, and of equal ones the first word.
    largest = F.max(F.struct(F.col("n_b"))).alias("top")
    best = counted.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), largest,
                                    F.min_by("b", F.struct(-F.col("n_b"), "b")).alias("b"))
    judged = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    is_form = F.col("top.n_b") >= FORM_RATIO * F.col("n")
    judged = written(judged.select(
        "word", F.when(is_form, F.col("b")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("top.n_b")).alias("form_n")), "forms")
    led = roots(judged.where("form is not null"))
    return judged.join(small_side(led, PAIR_BYTES), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
