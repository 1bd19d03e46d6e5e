"""The n-gram join against all pairs of shingle sets."""

import random

import numpy as np
import pytest

from changetrail.llm import ngram_join
from llm_rows import DOCS, words


def shingles(text):
    own = words(text)
    if len(own) < 3:
        return frozenset([tuple(own)] if own else [])
    return frozenset(tuple(own[i:i + 3]) for i in range(len(own) - 2))


def expected(rows):
    """(doc_id, size, component) per row, by the full sets of all pairs of rows."""
    known = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    parent = {i: i for i, _ in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                a_root, b_root = find(a), find(b)
                parent[max(a_root, b_root)] = min(a_root, b_root)
    return sorted([(r[0], len(shingles(r[1])), None if r[0] is None else
                    find(r[0]) if shingles(r[1]) else r[0]) for r in rows], key=str)


def result(frame):
    return sorted([tuple(r) for r in ngram_join.similar_components(frame).collect()], key=str)


def near_copies(seed):
    """Groups of texts of many sizes with a few words changed, dropped or added in each."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for size in (3, 5, 9, 10, 11, 12, 13, 20, 21, 30, 45, 80, 160, 400, 900):
        base = [rnd.choice(vocabulary) for _ in range(size + 2)]
        for _ in range(9):
            own = list(base)
            for _ in range(rnd.randint(0, 1 + size // 40)):
                at, kind = rnd.randrange(len(own)), rnd.randrange(3)
                own[at:at + (kind < 2)] = [rnd.choice(vocabulary)] if kind else []
            texts.append(" ".join(own))
            if rnd.random() < 0.2:   # a chain: an edit of an edit
                base = own
    ids = rnd.sample(range(-500, 5000), len(texts))
    return [(i, t, "en", "s", 0) for i, t in zip(ids, texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = near_copies(seed)
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    wanted = expected(rows)
    assert result(frame) == wanted
    linked = [r for r in wanted if r[0] != r[2]]
    assert 20 < len(linked) < len(rows) - 20


def test_a_large_group_of_near_copies_over_many_chunks(spark, monkeypatch):
    """Copies of one text that differ among themselves about as much as linked texts may."""
    monkeypatch.setattr(ngram_join, "CHUNK", 40)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(260):
        own = list(base)
        for _ in range(rnd.choice([0, 1, 2, 2, 3])):
            own[rnd.randrange(len(own))] = f"v{rnd.randrange(40)}"
        rows.append((i, " ".join(own), "en", "s", 0))
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    wanted = expected(rows)
    assert result(frame) == wanted
    assert len({r[2] for r in wanted}) > 5


def test_odd_rows(spark, docs, rows, clashing, empty):
    wanted = expected(rows)
    assert result(docs) == wanted
    assert result(clashing) == wanted
    assert result(empty) == []


def test_rows_of_one_id_with_different_texts_and_many_equal_rows(spark):
    text, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, text), (5, text), (5, other), (9, other + " b40"), (9, other + " b40"), (11, "c d e f")]
    rows = [(i, t, None, None, None) for i, t in rows + [(7, other + " b41")] * 200]
    wanted = sorted([(3, 38, 3), (5, 38, 3), (5, 38, 3), (9, 39, 3), (9, 39, 3), (11, 2, 11)]
                    + [(7, 39, 3)] * 200, key=str)
    found = result(spark.createDataFrame(rows, DOCS))
    # The two rows of id 5 are one node, which links both texts.
    assert [r for r in found if r[0] != 7] == [r for r in wanted if r[0] != 7]
    assert {r for r in found if r[0] == 7} == {(7, 39, 3)}


def test_every_linked_pair_of_sizes_shares_a_class():
    sizes = np.arange(1, 3000)
    rows, classes = ngram_join.places(sizes)
    entered = {}
    for row, c in zip(rows.tolist(), classes.tolist()):
        entered.setdefault(int(sizes[row]), set()).add(c)
    for x in range(1, 2600):
        for y in (x, x + 1, x * 10 // 9):
            differ = int(ngram_join.most_different(np.int64(x), np.int64(y)))
            if y * 9 > x * 10 or not differ:
                continue
            shared = entered[x] & entered[y]
            assert shared and max(ngram_join.DIFFER[list(shared)]) >= differ, (x, y)


def test_the_tree_passes_over_no_pair_that_counts_allow():
    rnd = np.random.default_rng(4)
    centres = rnd.poisson(4, (12, 16))
    points = np.concatenate([np.maximum(c + rnd.integers(-1, 2, (40, 16)), 0) for c in centres]).astype(np.int32)
    sizes = points.sum(axis=1).astype(np.int64)
    components = rnd.integers(0, 3, len(points))
    every = np.arange(len(points))
    i, j, shared = ngram_join.surviving(points, sizes, components, every, every)
    least = np.minimum(points[:, None], points[None]).sum(axis=2)
    x, y = sizes[:, None], sizes[None]
    wanted = ((19 * least >= 9 * (x + y)) & (10 * np.minimum(x, y) >= 9 * np.maximum(x, y))
              & (components[:, None] != components[None]))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*[a.tolist() for a in np.nonzero(wanted)]))
    assert (shared == least[i, j]).all() and 0 < len(i) < len(points) ** 2 / 4
