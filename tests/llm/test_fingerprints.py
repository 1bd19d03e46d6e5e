import hashlib

from llm_rows import DOCS

from pyspark.sql import functions as F

from changetrail.llm import fingerprints


def test_edits_and_fingerprints(unique_docs, unique_rows):
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(unique_docs).collect()}
    order = sorted((row[0], row[1] or "") for row in unique_rows)
    by_text, by_print = {}, {}
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[1][:half]
        r = found[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for own, print_ in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert by_text.setdefault(own, print_) == print_
            assert by_print.setdefault(print_, own) == own
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_edited"] == 1) == (text == edited)
        assert (r["near_next"] == 1) == (text == after[1])
        assert bool(r["edited"]) == (text != edited)
        if len(text) > 200 and "x" * 99 not in text and "a b c" not in text:
            assert 0.25 < r["near_edited"] < 0.8


def test_likeness_is_that_of_multisets(spark):
    texts = [("a" * 32 + "b" * 32, "a" * 32 + "c" * 32), ("same", "same"), ("", "x"), ("\n\n", "\n"),
             ("x" * 3200, "x" * 1600)]
    frame = spark.createDataFrame(texts, "a string, b string")
    found = [r[0] for r in frame.select(fingerprints.likeness(
        fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b")))).collect()]
    assert found[0] == 2 * 3 / 8 and found[1] == 1 and found[2] == 0 and found[3] == 0
    assert 0.6 < found[4] < 0.7


def test_sections_that_differ(spark):
    a = "\n".join(f"paragraph {i} of the text" for i in range(40))
    b = a.replace("paragraph 20 of", "paragraph 20 off")
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    found = frame.select(fingerprints.edited_sections(
        fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b")))).first()[0]
    assert found == [2]


def test_odd_rows(spark, docs, clashing, rows, empty):
    plain = fingerprints.fingerprint_documents(docs).collect()
    assert len(plain) == len(rows)
    assert sorted(map(str, fingerprints.fingerprint_documents(clashing).collect())) == sorted(map(str, plain))
    assert fingerprints.fingerprint_documents(empty).count() == 0
    alone = spark.createDataFrame([(5, "abcdef", None, None, None)], DOCS)
    r = fingerprints.fingerprint_documents(alone).first()
    assert r["near_next"] == 1 and r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
