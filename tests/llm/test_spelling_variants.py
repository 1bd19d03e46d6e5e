"""Spelling variants against all edits of every word."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from changetrail.llm import spelling_variants
from llm_rows import DOCS, LOWER

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, plant):
    found = Counter()
    for doc_id, text, *_ in rows:
        for word in RUN.findall(text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if plant and doc_id is not None and h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def edits(word, alphabet):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in alphabet}
        if i < len(word):
            out |= {word[:i] + c + word[i + 1:] for c in alphabet} | {word[:i] + word[i + 1:]}
    return out - {word}


def expected(words):
    alphabet = set("".join(words))
    near = {w: [x for x in edits(w, alphabet) if x in words] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None)
            for w, n in words.items()}


def make_docs(seed):
    """Texts of few stems with typos of every kind, some of them over chains of forms."""
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abeéÿÀst") for _ in range(rnd.randint(4, 9))) for _ in range(25)]
    stems += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "babab", "ababa", "aabaa", "Ärger", "ärger"]
    for _ in range(120):
        word = rnd.choice(stems)
        at, kind = rnd.randrange(len(word)), rnd.randrange(3)
        stems.append(word[:at] + (rnd.choice("abé") if kind else "") + word[at + (kind < 2):])
    weights = [2 ** rnd.randint(0, 6) for _ in stems]
    texts = [" ".join(rnd.choices(stems, weights, k=rnd.randint(0, 200))) for _ in range(60)]
    texts += [None, "", "1234 -- ...", "AAAAA,aaaaa;Aaaaa", "x" * 5000]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None),
                                                                 (0, texts[0], "en", "s", 0)]


@pytest.mark.parametrize("seed, plant", [(1, False), (2, True), (3, True)])
def test_variants_are_those_of_all_edits(spark, seed, plant):
    rows = make_docs(seed)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    words = counted(rows, plant)
    assert {(r["word"], r["n"]) for r in spelling_variants.count_words(docs, plant=plant).collect()} \
        == set(words.items())
    found = spelling_variants.variants(docs, plant=plant).collect()
    assert len(found) == len(words)
    assert {tuple(r) for r in found} == expected(words)
    assert any(r["form"] for r in found)


def test_forms_are_followed_to_the_last(spark):
    chain = ["abcdef", "abcdeh", "abcxeh", "abyxeh", "Abyxeh", "abyxehz"]
    counts = [3, 6, 12, 24, 30, 108]
    text = " ".join(" ".join([w] * n) for w, n in zip(chain, counts))
    found = spelling_variants.variants(spark.createDataFrame([(1, text, "", "", 0)], DOCS)).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == {
        "abcdef": ("abcdeh", "abyxehz", 3, 1, 6), "abcdeh": ("abcxeh", "abyxehz", 6, 2, 12),
        "abcxeh": ("abyxeh", "abyxehz", 12, 2, 54), "abyxeh": ("abyxehz", "abyxehz", 54, 2, 108),
        "abyxehz": (None, "abyxehz", 108, 1, None)}


def test_pivots_are_disjoint_bigrams_of_least_frequency(spark):
    rows = [(["ab", "bc", "cd", "de"], [5, 1, 1, 4]), (["ab", "bc", "cd"], [1, 1, 9]),
            (["aa", "aa", "aa", "ab"], [7, 7, 7, 2])]
    for grams, weights in rows:
        entries = [(i + 1, g, w) for i, (g, w) in enumerate(zip(grams, weights))]
        frame = spark.createDataFrame([(entries,)], "g array<struct<place:int,gram:string,words:bigint>>")
        a, b = frame.select(spelling_variants.cheapest_pair(F.col("g")).alias("p")).first()["p"]
        least = min(x[2] + y[2] for x in entries for y in entries if y[0] - x[0] >= 2)
        assert b["place"] - a["place"] >= 2 and a["words"] + b["words"] == least


def test_odd_tables(docs, clashing, empty):
    assert spelling_variants.variants(empty).count() == 0
    plain = {tuple(r) for r in spelling_variants.variants(docs).collect()}
    assert {tuple(r) for r in spelling_variants.variants(clashing).collect()} == plain and plain
