import hashlib
import re
import tempfile

from llm_rows import DOCS, make_rows, words

import __spark_entry__ as driver
import corpus_pipeline
from changetrail.llm.queries import ORACLE, REGISTRY


def test_queries_are_registered():
    names = set(driver.queries())
    assert {f"op{n}" for n in range(1, 14)} == {re.match(r"op\d+", n)[0] for n in REGISTRY}
    assert set(REGISTRY) | {"pipeline"} <= names
    assert set(ORACLE) <= set(REGISTRY)


def test_stages_follow_one_another(spark):
    folder = tempfile.mkdtemp(prefix="changetrail-pipeline-")
    rows = make_rows(n=40)
    bad = [(1000 + i, "vile grimy kindless " * 3 + f"nasty vile nasty slur{i}", "en", "s1", 9)
           for i in range(40)]
    docs = spark.createDataFrame(rows + bad, DOCS)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows if r[0] is not None] + [(r[0], 0, 1) for r in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").distinct().write.parquet(
        f"{folder}/labels.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash_near_dedup", "mixing", "byte_bpe"]
    tables = [docs.collect()]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, frame, folder)
        result.write.parquet(f"{folder}/{name}")
        frame = spark.read.parquet(f"{folder}/{name}")
        if name != "byte_bpe":
            assert frame.columns == DOCS.fieldNames(), name
        tables.append(frame.collect())
    clean, lines, single, mixed, encoded = tables[1:]
    stayed = {r["doc_id"] for r in clean}
    assert stayed >= {r[0] for r in rows}, {r[0] for r in rows} - stayed
    assert len(stayed - {r[0] for r in rows}) <= 4, stayed - {r[0] for r in rows}
    texts = {}
    for r in clean:
        texts.setdefault(r["doc_id"], set()).add(r["text"])
    assert all(r["text"] is None or any(t is not None and set(r["text"].split("\n")) <= set(t.split("\n"))
                                        for t in texts[r["doc_id"]]) for r in lines)
    assert all(r["n_chars"] == len(r["text"] or "") for r in lines if r["doc_id"] is not None
               and r["doc_id"] != 18)
    assert len(single) <= len(lines) and {r["doc_id"] for r in single} <= {r["doc_id"] for r in lines}
    taken = sum(len(words(r["text"])) for r in mixed)
    assert abs(taken - sum(len(words(r["text"])) for r in single)) <= 5
    assert sorted(r["decoded_sha256"] for r in encoded) == sorted(
        hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in mixed)


def test_empty_tables(spark):
    folder = tempfile.mkdtemp(prefix="changetrail-pipeline-")
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_toxic_rows_go_by_their_text(spark):
    folder = tempfile.mkdtemp(prefix="changetrail-pipeline-")
    bad = [(1000 + i, "vile grimy kindless " * 3 + f"nasty vile nasty slur{i}", "en", "s1", 9) for i in range(40)]
    good = [(i, f"plain words about the weather of day{i} and more", "en", "s1", 9) for i in range(40)]
    docs = spark.createDataFrame([*bad, *good, (None, bad[0][1], None, None, None), (0, bad[1][1], None, None, None),
                                  (None, good[0][1], None, None, None)], DOCS)
    spark.createDataFrame([(r[0], 1, int(r[0] >= 1000)) for r in bad + good],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, folder).collect()
    assert sorted(map(str, left)) == sorted(
        str(r) for r in docs.collect() if "weather" in r["text"])


def test_clashing_columns_are_carried(spark, clashing):
    """Columns named like those that the line stage counts in."""
    from pyspark.sql import functions as F

    docs = clashing.withColumn("n_lines", F.lit("mine"))
    out = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert out.columns == docs.columns
    assert {(r["n_lines"], r["n_removed"]) for r in out.collect()} == {("mine", "n_removed")}
