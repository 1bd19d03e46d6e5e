import random
from collections import defaultdict

from llm_rows import DOCS, words

import numpy as np
from pyspark.sql import functions as F

from changetrail.llm import near_dedup
from changetrail.llm.components import connected_components


def shingle_set(text, k=5):
    w = words(text)
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_components_equal_brute_force(unique_docs, unique_rows):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
             for r in near_dedup.near_duplicates(unique_docs).collect()}
    assert found == brute(unique_rows)


def test_group_of_near_copies_loses_no_link(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rnd.randint(1, 5)):
            own[rnd.randrange(len(own))] = f"v{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own), None, None, None))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
             for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == brute(rows)


def test_odd_rows(docs, rows, clashing, empty):
    plain = near_dedup.near_duplicates(docs).collect()
    assert len(plain) == len(rows)
    assert all(r["kept"] and r["component_id"] is None for r in plain if r["doc_id"] is None)
    blank = {r[0] for r in rows if not words(r[1])}
    assert all(r["n_shingles"] == 0 and r["kept"] for r in plain if r["doc_id"] in blank)
    assert sorted(map(str, near_dedup.near_duplicates(clashing).collect())) == sorted(map(str, plain))
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted({r["doc_id"] for r in plain if r["kept"]}, key=str)
    assert near_dedup.keep_one_of_each(empty).count() == 0


def test_every_coordinate_is_filled_and_estimates_similarity():
    rnd = np.random.default_rng(1)
    values = rnd.integers(0, 2**63, 400).astype(np.uint64)
    for n in (1, 2, 40, 400):
        a, b = values[:n], values[n // 4:n]
        table = near_dedup.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert (table != near_dedup.EMPTY).all()
        assert abs((table[0] == table[1]).mean() - len(b) / len(a)) < 0.12


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7)]
    found = {r["id"]: r["component"] for r in
             connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(40)}}
    none = connected_components(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0 and none.columns == ["id", "component"]


def test_equal_sets_share_a_digest(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(i, "filler words " * i + "\n", None, None, None) for i in range(50)]
    rows += [(100 + i, text, None, None, None) for i in range(20)]
    found = (near_dedup.sketch_documents(spark.createDataFrame(rows, DOCS)).where("id >= 100")
             .agg(F.countDistinct("set_a", "set_b").alias("n")).first())
    assert found["n"] == 1
