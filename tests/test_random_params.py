"""Random parameter documents against a plain Python account of the same rules."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from changetrail.functions import params as P

KEYS = ["id", "10", "9", "a b", "päss", "passport", "PHRASES", "header", "Header", "__csrf_magic",
        "phr", "x|y", "", "drp_action", "Compass", "k:1", "#", "-x", "-5", "100", "1a", "9a", "007", "0"]
SCALARS = ["", "0", "true", "[x", "{", "a%b", 'say "hi"', "back\\slash", "é😀", "tab\t", True, False,
           None, 0, -7, 1.5, 12345678901]


def random_value(rng):
    kind = rng.random()
    if kind < 0.7:
        return rng.choice(SCALARS)
    if kind < 0.95:
        return [rng.choice(SCALARS) for _ in range(rng.randrange(5))]
    return {"k": rng.choice(SCALARS), "password": "inner"}


def random_pairs(rng):
    """Pairs of an object, sometimes with a repeated key."""
    return [(rng.choice(KEYS), random_value(rng)) for _ in range(rng.randrange(1, 12))]


def as_text(pairs):
    body = ",".join(f"{json.dumps(k)}:{json.dumps(v, ensure_ascii=False)}" for k, v in pairs)
    return "{" + body + "}"


def scalar(value):
    if value is None or value is False:
        return ""
    if value is True:
        return "1"
    if isinstance(value, (dict, list)):
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return str(value)


def text(value, separator):
    if isinstance(value, list):
        return separator.join(map(scalar, value))
    return scalar(value)


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(2024)
    pairs = [random_pairs(rng) for _ in range(400)]
    df = spark.createDataFrame([(i, as_text(p)) for i, p in enumerate(pairs)],
                               "id int, post string")
    return {i: dict(p) for i, p in enumerate(pairs)}, df


def test_flatten(documents):
    docs, df = documents
    got = {r["id"]: r["flat"] for r in
           df.select("id", P.flatten_post(F.col("post")).alias("flat")).collect()}
    assert got == {i: "|".join(f"{k}:{text(v, '%')}" for k, v in d.items())
                   for i, d in docs.items()}


def key_order(keys):
    """Whole numbers by value; a text before the first of them whose digits come behind it."""
    numbers = sorted((k for k in keys if re.fullmatch(r"0|-?[1-9]\d*", k)), key=int)

    def place(key):
        if key in numbers:
            return numbers.index(key), 1, b""
        behind = [i for i, number in enumerate(numbers) if number.encode() > key.encode()]
        return min(behind, default=len(numbers)), 0, key.encode()

    return sorted(keys, key=place)


def test_attributes(documents):
    docs, df = documents
    got = {r["id"]: [(a["attribute"], a["value"]) for a in r["rows"]] for r in
           df.select("id", P.sorted_attributes(F.col("post")).alias("rows")).collect()}
    assert got == {i: [(k, text(d[k], ",")) for k in key_order(d)] for i, d in docs.items()}
    plain = {r["id"]: [a["attribute"] for a in r["rows"]] for r in
             df.select("id", P.sorted_attributes(F.col("post"), numeric_keys=False).alias("rows")).collect()}
    assert plain == {i: sorted(d, key=str.encode) for i, d in docs.items()}


def test_pairs_of_keys_keep_their_order_wherever_they_run_in_no_circle():
    def before(a, b):
        whole = [re.fullmatch(r"0|-?[1-9]\d*", k) for k in (a, b)]
        return int(a) < int(b) if all(whole) else a.encode() < b.encode()

    assert key_order(["b", "9", "A", "10", "-x", "", "#"]) == ["", "#", "-x", "9", "10", "A", "b"]
    for a in KEYS:
        for b in KEYS:
            if a != b:
                assert (key_order([a, b]) == [a, b]) == before(a, b)


def test_redaction(documents):
    docs, df = documents
    got = {r["id"]: json.loads(r["post"]) for r in df.select("id", P.encode_params(
        P.redact(P.parse_params(F.col("post")))).alias("post")).collect()}

    def kept(key):
        low = key.lower()
        return not ("pass" in low or "phrase" in low or key in ("header", "__csrf_magic"))

    assert got == {i: {k: v for k, v in d.items() if kept(k)} or [] for i, d in docs.items()}
