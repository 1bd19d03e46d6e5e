import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import DOCS

from changetrail.llm import toxicity

LABELS = "doc_id long, quality int, toxic int, score string"


def labelled(n=600):
    rnd = random.Random(8)
    plain = [f"word{i}" for i in range(300)]
    bad = ["vilefool", "vilerag", "nastything", "nastyone", "grimbeast"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        own = [rnd.choice(plain) for _ in range(rnd.randint(5, 80))]
        if toxic:
            for _ in range(max(2, len(own) // 20)):
                own[rnd.randrange(len(own))] = rnd.choice(bad)
        rows.append((i, " ".join(own), "en", "s", 1))
        labels.append((i, 0, int(toxic), "x"))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = labelled()
    found = toxicity.score_documents(spark.createDataFrame(rows, DOCS),
                                     spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: y for i, _, y, _ in labels}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    learned = {i for i in truth if zlib.crc32(str(i).encode()) % 3 != 1}
    assert all(set(r["evidence"]) <= learned for r in found)


def test_odd_rows(spark, docs, clashing, rows, empty):
    labels = spark.createDataFrame(
        [(0, 1, 0, ""), (3, 1, 1, ""), (3, 1, 0, ""), (6, None, None, ""), (10**9, 1, 1, ""),
         (None, 1, 1, ""), (12, 0, 1, "")], LABELS)
    plain = toxicity.score_documents(docs, labels).collect()
    assert len(plain) == len(rows) and all(0 <= r["score"] <= 1 for r in plain)
    again = toxicity.score_documents(clashing, labels).collect()
    assert sorted(map(str, again)) == sorted(map(str, plain))
    assert toxicity.score_documents(empty, labels).count() == 0
    none = toxicity.score_documents(docs, labels.where("false")).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}


def test_neighbours_are_those_of_the_full_cosine():
    rnd = np.random.default_rng(3)
    vectors = []
    for i in range(700):
        terms = np.sort(rnd.choice(60, size=rnd.integers(0, 8), replace=False))
        # As if half of each vector's length were of terms that aren't known.
        vectors.append((i, int(rnd.integers(0, 2)), terms, rnd.integers(1, 5, len(terms)).astype(float),
                        float(rnd.uniform(8, 40))))
    frequency = rnd.integers(1, 300, 60).astype(float)
    index = toxicity.build_index(vectors, 1000, frequency, (400, 300))
    dense = np.zeros((len(index.ids), 60))
    by_id = {v[0]: v for v in vectors}
    for n, i in enumerate(index.ids):
        dense[n, by_id[i][2]] = index.vector(*by_id[i][2:])
    for query in range(60):
        terms = np.sort(rnd.choice(60, size=rnd.integers(1, 6), replace=False))
        weights = index.vector(terms, np.ones(len(terms)), 12.0)
        found, scores = index.nearest(terms, weights)
        full = dense[:, terms] @ weights
        best = np.sort(full[full > 0])[::-1][:toxicity.NEIGHBOURS]
        assert scores == pytest.approx(best) and full[found] == pytest.approx(scores)
        vote, close = index.votes(found, scores)
        labels = np.array([by_id[i][1] for i in index.ids])[found]
        share = 300 / 700
        assert vote == pytest.approx((sum(s * y for s, y in zip(scores, labels)) + share) / (sum(scores) + 1))
        assert close == pytest.approx(sum(scores) / len(scores))


def test_weights_are_of_all_terms_of_the_text(spark):
    """Vectors by dictionaries: every word and stem, frequencies over all rows."""
    rows, labels = labelled(200)
    docs = spark.createDataFrame(rows, DOCS)
    documents, frequency = toxicity.document_frequencies(docs, "text")
    assert documents == 200
    terms = ["vilefool", "nast*", "word7", "word1*"]
    idf = toxicity.idf_of(documents, frequency)
    found = {r["id"]: r for r in toxicity.document_vectors(docs, terms, idf, "doc_id", "text").collect()}
    everything = [toxicity.text_terms(row[1]) for row in rows]
    seen = Counter(term for own in everything for term in own)
    slots = Counter(toxicity.slot(term) for term in seen)
    alone = {term for term in seen if slots[toxicity.slot(term)] == 1}
    assert len(alone) > 0.99 * len(seen)
    assert all(frequency[toxicity.slot(term)] == seen[term] for term in alone)
    for row, own in zip(rows, everything):
        got = found[row[0]]
        assert dict(zip(got["terms"], got["counts"])) == {i: own[t] for i, t in enumerate(terms) if t in own}
        if got["terms"] and alone >= set(own):
            whole = sum(((1 + math.log(n)) * (math.log(201 / (1 + seen[t])) + 1))**2 for t, n in own.items())
            assert got["norm"] == pytest.approx(math.sqrt(whole))


def test_one_bad_word_in_a_long_clean_text(spark):
    rows, labels = labelled()
    rnd = random.Random(9)
    clean = " ".join(f"word{rnd.randrange(300)}" for _ in range(3000))
    rows += [(10_000, clean + " vilefool", "en", "s", 1), (10_001, "vilefool vilerag you nastyone", "en", "s", 1),
             (10_002, clean, "en", "s", 1)]
    found = {r["doc_id"]: r for r in toxicity.score_documents(
        spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert found[10_001]["predicted"] == 1 and found[10_002]["predicted"] == 0
    assert found[10_000]["score"] < found[10_001]["score"]
    assert found[10_000]["predicted"] == 0


def test_an_id_with_many_texts_is_one_example(spark):
    rows, labels = labelled(80)
    first = next(i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    rows += [(first, f"another text {k} of the same id", "en", "s", 1) for k in range(300)]
    docs, own = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    examples = toxicity.sample_texts(docs, toxicity.learned_labels(own), "doc_id", "text")
    assert examples.groupBy("id").count().agg({"count": "max"}).first()[0] == 1
