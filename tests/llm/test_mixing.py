from collections import defaultdict

import pytest
from llm_rows import DOCS, words

from changetrail.llm import mixing


def targets(sizes):
    """Targets of the sources by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        level = (total - sum(capped.values())) / free if free else 0
        above = [s for s in names if s not in capped and weight[s] * level > 3 * sizes[s]]
        if not above:
            return {s: capped.get(s, weight[s] * level) for s in names}
        capped.update({s: 3 * sizes[s] for s in above})


def test_targets_and_takings(docs, rows):
    found = mixing.assign(docs).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += len(words(row[1]))
    expected = targets(sizes)
    source = {(row[0], len(words(row[1]))): row[3] for row in rows}
    taken = defaultdict(int)
    for r in found:
        own = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[own]
        assert r["target"] == pytest.approx(expected[own])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(c["words"] for c in r["copies"])
        assert all(0 <= c["position"] <= 1 for c in r["copies"])
        taken[own] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 0.5 for s in sizes)


def test_small_source_is_capped_and_reruns_agree(spark):
    rows = [(i, "w " * 50, None, "big", 1) for i in range(30)] + [(100, "v " * 4, None, "tiny", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r for r in mixing.assign(docs).collect()}
    assert found[100]["target"] == 12 and found[100]["taken"] == 12
    again = {r["doc_id"]: r for r in mixing.assign(docs.repartition(5)).collect()}
    assert found == again


def test_sequence_follows_the_takings(docs, clashing, rows, empty):
    assigned = mixing.assign(docs).collect()
    mixed = mixing.mixed_documents(clashing)
    assert mixed.columns == clashing.columns
    sequence = mixed.collect()
    per_id = defaultdict(int)
    for r in sequence:
        assert r["draw"] == "draw" and r["size"] == "size"
        per_id[r["doc_id"]] += len(words(r["text"]))
    expected = defaultdict(int)
    for r in assigned:
        expected[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in per_id.items() if v} == {k: v for k, v in expected.items() if v}
    whole = {row[1] for row in rows}
    cut = [r["text"] for r in sequence if r["text"] not in whole]
    assert len(cut) <= 4 and all(any(t and t.startswith(c) for t in whole) for c in cut)
    assert mixing.assign(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_schedules_invert_their_demand(spark):
    from pyspark.sql import functions as F

    for schedule in mixing.SCHEDULES + (((0.0, 0.0), (0.5, 2.0), (1.0, 0.0)),):
        shares = spark.createDataFrame([(i / 50,) for i in range(51)], "share double")
        times = [r["t"] for r in shares.select("share", mixing.time_of(
            F.col("share"), mixing.segments(schedule)).alias("t")).orderBy("share").collect()]
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))

        def demand(t):
            done = 0.0
            for (t0, v0), (t1, v1) in zip(schedule, schedule[1:]):
                x = min(max(t, t0), t1) - t0
                done += v0 * x + (v1 - v0) / (t1 - t0) * x * x / 2
            return done / area

        assert all(abs(demand(t) - i / 50) < 1e-6 for i, t in enumerate(times))


def test_positions_are_sorted(docs):
    ordered = [r["position"] for r in mixing.training_order(mixing.assign(docs)).collect()]
    taken = [p for p in ordered if p is not None]
    assert taken == sorted(taken) and ordered[len(ordered) - len(taken):] == taken
