"""Rows of a small table that every operator must take: nulls, empty and long texts, ties, repeats."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Names that operators use inside, as columns of the input.
CLASHES = ["id", "_id", "row", "key", "draw", "size", "copies", "terms", "score", "rank", "band",
           "_gone", "n_removed", "text_a", "place"]
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def make_texts(seed=7, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghiklmnoprstuvwé") for _ in range(rnd.randint(2, 9)))
                  for _ in range(400)]
    say = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage = say(30) + ", " + say(12) + ". " + say(14) + ", " + say(9) + "."
    texts = []
    for i in range(n):
        lines = [say(rnd.randint(1, 40)).capitalize() + "." for _ in range(rnd.randint(1, 6))]
        if i % 5 == 0:
            at = rnd.randrange(len(lines))
            lines[at] = lines[at] + " " + passage + " " + say(5)
        texts.append("\n".join(lines))
    for i in (3, 9, 9, 17):
        texts.append(texts[i])  # exact copies
        own = texts[i].split(" ")
        own[len(own) // 2] = "changed"
        texts.append(" ".join(own))  # near copies
    texts += [None, "", "  \n\t ", "one", "One two", "x" * 3000, "a b c d e f " * 4000,
              "\n\n", "\U0001f600 é\U0001f600 zz", texts[5].upper()]
    return texts


def make_rows(**kw):
    rows = [(3 * i, text, "en", [None, "s1", "s2", "s1", "s10"][i % 5], len(text or ""))
            for i, text in enumerate(make_texts(**kw))]
    rows.append(rows[4])  # the same row again
    rows.append((rows[6][0], "other text under the same id, of nine words", "en", "s1", 43))
    rows.append((None, "a row without an id but with some words", None, None, None))
    return rows
