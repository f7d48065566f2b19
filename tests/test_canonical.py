"""Canonical documents against a plain writer; numbers by the shortest-text rule."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from rasterledger.operators import texts as tx

NUMBERS = {
    "1.0": "1", "-0": "0", "-0.0": "0", "0.0": "0", "1e2": "100", "1.50": "1.5", "100": "100", "-12.25": "-12.25", "0.1": "0.1", "1E-7": "1e-7", "1.5e-7": "1.5e-7", "0.000001": "0.000001", "0.00000123": "0.00000123",
    "1e21": "1e+21", "1e20": "100000000000000000000", "123456789012345678901234567890": "1.2345678901234568e+29", "9007199254740993": "9007199254740992", "12345678.9": "12345678.9", "2.5E-300": "2.5e-300", "1.7976931348623157e308": "1.7976931348623157e+308", "0.3": "0.3", "10": "10", "10000000": "10000000",
}


def written(value):
    if isinstance(value, dict):
        return "{" + ",".join(f"{written(k)}:{written(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(written, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def shuffled(value, rnd):
    if isinstance(value, dict):
        return {k: shuffled(value[k], rnd) for k in rnd.sample(list(value), len(value))}
    return [shuffled(v, rnd) for v in value] if isinstance(value, list) else value


def some(rnd, depth):
    if depth and rnd.random() < 0.7:
        if rnd.random() < 0.5:
            return [some(rnd, depth - 1) for _ in range(rnd.randrange(4))]
        return {k: some(rnd, depth - 1) for k in rnd.sample(["a", "B", "é", "🙂", "�", "z\n", '"', "-1", ""], rnd.randrange(5))}
    return rnd.choice([None, True, False, 3, -17, 0.5, "x", "", "1.0", "-3e2", 'q"\\/', "\x01\x0b\x1f\x7f\t", "\\u001F", "\\\x1f", "é🙂 ", "{[,:]}"])


def _forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["c"] for r in df.select("i", tx.canonical_document(F.col("t")).alias("c")).orderBy("i").collect()]


def test_numbers(spark):
    assert _forms(spark, NUMBERS) == list(NUMBERS.values())


def test_any_depth(spark):
    rnd = random.Random(2)
    docs = [some(rnd, 5) for _ in range(300)]
    want = [written(d) for d in docs]
    assert _forms(spark, [json.dumps(d) for d in docs]) == want
    assert _forms(spark, [json.dumps(shuffled(d, rnd), ensure_ascii=False, indent=1) for d in docs]) == want


def test_no_form(spark):
    assert _forms(spark, ["bad", "", None, '{"a":1', '{"a":1,"a":2}', " [1 , 2] "]) == [None, None, None, None, None, "[1,2]"]


@pytest.mark.parametrize("other", ['{"m":{"b":[1,{"y":2,"x":1.0}],"a":null}}', '{"m" : {"a":null, "b":[1.0, {"x":1, "y":2e0}]}}'])
def test_hashes(spark, other):
    want = hashlib.sha256(b'{"m":{"a":null,"b":[1,{"x":1,"y":2}]}}').hexdigest()
    df = spark.createDataFrame([(other,)], "t string")
    assert tx.document_hash(df, "t").first()["fingerprint"] == want
    nested = df.select(F.expr("named_struct('b', array(named_struct('y', 2, 'x', 1.0D)), 'a', cast(null as string), 'k', map('q', 1, 'p', 2))").alias("m"))
    assert tx.nested_hash(nested, ["m"]).first()["fingerprint"] == hashlib.sha256(b'{"m":{"a":null,"b":[{"x":1,"y":2}],"k":{"p":2,"q":1}}}').hexdigest()


def test_order_of_lists_counts(spark):
    assert len(set(_forms(spark, ["[1,2]", "[2,1]"]))) == 2
