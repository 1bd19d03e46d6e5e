"""Periodic runs against a search of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from changetrail.llm import periodic_runs
from llm_rows import WORD


def every_run(words):
    """(start, length, period) of all runs: each period in turn, the least one of a stretch counts."""
    codes = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0)
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist()):
            if e - s >= max(12, 2 * q):
                found.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted_words(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    return words


def expected(doc_id, text, plant):
    words = planted_words(doc_id, text) if plant else WORD.findall(text or "")
    runs = every_run(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(left.encode()).hexdigest()), runs, left


def random_words(rnd):
    kinds, n = rnd.choice([1, 2, 2, 3, 5, 50]), rnd.choice([0, 1, 5, 11, 12, 13, 30, 60, 120, 300])
    words = [rnd.randrange(kinds) for _ in range(n)]
    for _ in range(rnd.randrange(4) if n >= 14 else 0):
        a = rnd.randrange(n)
        p, k = rnd.randint(1, max(1, (n - a) // 2)), rnd.randint(0, n - a)
        for i in range(a, a + k):
            words[i] = words[a + (i - a) % p]
    return words


def test_runs_of_random_words_are_those_of_every_period():
    rnd = random.Random(3)
    for _ in range(150):
        docs = [random_words(rnd) for _ in range(rnd.randint(1, 6))]
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        ids = np.array([w for d in docs for w in d], dtype=np.int64)
        found = [tuple(run) for run in periodic_runs.runs_of(ids, bounds).tolist()]
        assert found == [(i, *run) for i, d in enumerate(docs) for run in every_run(d)]


def test_words_without_structure_and_of_much_structure():
    fibonacci, last = [0, 1], [0]
    while len(fibonacci) < 1500:
        fibonacci, last = fibonacci + last, fibonacci
    for words in (fibonacci, [7] * 1500, list(range(1500))):
        found = periodic_runs.runs_of(np.array(words), np.array([0, len(words)]))
        assert [tuple(run) for run in found[:, 1:].tolist()] == every_run(words)


@pytest.mark.parametrize("plant", [False, True])
def test_documents(spark, docs, rows, plant):
    found = periodic_runs.find_runs(docs, plant=plant).collect()
    assert len(found) == len(rows)
    key = lambda r: str((r[0], r[-1]))
    wanted = []
    for doc_id, text, *_ in rows:
        columns, runs, left = expected(doc_id, text, plant)
        wanted.append((doc_id, *columns, [tuple(r) for r in runs], left))
    got = [(*tuple(r)[:8], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found]
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert any(r["n_runs"] for r in found)


def test_case_counts_and_odd_tables(spark, clashing, empty, docs):
    text = "a b A b " * 6
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r) for r in periodic_runs.find_runs(one).first()["runs"]] == [(0, 24, 4)]
    assert periodic_runs.find_runs(empty).count() == 0
    assert periodic_runs.find_runs(clashing).count() == docs.count()


def test_a_long_text_among_short_ones(spark):
    phrase = [f"w{i}" for i in range(3000)]
    words = ["x"] * 5 + phrase * 3 + phrase[:7] + ["y"]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, "z z"), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in periodic_runs.find_runs(frame).collect()}
    assert [tuple(r) for r in rows[1]["runs"]] == [(5, 9007, 3000)]
    assert rows[1]["collapsed"] == " ".join(["x"] * 5 + phrase + ["y"])
    assert (rows[3]["n_runs"], rows[3]["start"], rows[3]["collapsed"]) == (0, None, "")
