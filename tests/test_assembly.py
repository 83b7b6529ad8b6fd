"""Digests, redaction and joins along time against plain Python."""

import hashlib
import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rillstone.functions import hashing, text
from rillstone.operators.timelines import asof_join


def test_digests_equal_those_of_sorted_json(spark):
    schema = "id string, z int, parts array<struct<kind:string,id:string>>, deep struct<b:array<string>,a:struct<y:int,x:string>>, note string"
    rows = [
        {"id": 'q"\\uote', "z": 1, "parts": [{"kind": "k", "id": None}, None], "deep": {"b": ["é漢", None], "a": {"y": 2, "x": "tab\t\n"}}, "note": "clash"},
        {"id": None, "z": None, "parts": None, "deep": None, "note": ""},
        {"id": "", "z": -5, "parts": [], "deep": {"b": None, "a": None}, "note": None},
    ]
    df = spark.createDataFrame(rows, schema)
    columns = ("id", "z", "parts", "deep")
    got = [r[0] for r in df.select(hashing.canonical_digest(df, columns)).collect()]
    plain = [json.dumps({c: r[c] for c in columns}, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for r in rows]
    assert [r[0] for r in df.select(hashing.canonical_json(df, columns)).collect()] == plain
    assert got == [hashlib.sha256(p.encode()).hexdigest() for p in plain]


def test_redaction(spark):
    df = spark.createDataFrame([({"API_KEY": "x", "name": "y", "aToken": None},), (None,), ({},)], "m map<string,string>")
    assert [r[0] for r in df.select(text.redacted("m")).collect()] == [{"API_KEY": "<redacted>", "name": "y", "aToken": "<redacted>"}, None, {}]


def test_asof_join_equals_brute_force(spark):
    """A key with most of the rows, ties, nulls on both sides, columns of one name."""
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    when = lambda: None if rng.random() < 0.02 else start + timedelta(minutes=rng.randrange(3000))
    key = lambda: rng.choice(["hot"] * 6 + ["b", "c", "d", None])
    left = [(i, key(), when()) for i in range(800)]
    right = [(rng.randrange(10**6), key(), when(), rng.random()) for _ in range(500)]
    right += right[:20]
    a = spark.createDataFrame(left, "n int, k string, t timestamp")
    b = spark.createDataFrame(right, "n int, k string, t timestamp, v double")
    got = {r.n: r.asof for r in asof_join(a, b, "k", "t").collect()}
    assert len(got) == len(left)
    for n, k, t in left:
        held = [r for r in right if k is not None and t is not None and r[1] == k and r[2] is not None and r[2] <= t]
        best = max(held, key=lambda r: (r[2], r[0], r[3]), default=None)
        assert (got[n] is None) == (best is None)
        if best:
            assert (got[n].n, got[n].v, got[n].t) == (best[0], best[3], best[2])
    assert asof_join(a.limit(0), b, "k", "t").count() == 0
    assert asof_join(a, b.where(F.lit(False)), "k", "t").where("asof is not null").count() == 0
