"""Token round trips, safe splits, and mixes that keep their shares and caps."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rillstone.llm import tokens
from rillstone.llm.mixing import mix_sources


@pytest.fixture(scope="module")
def enc():
    return tokens.encoding(tokens.read_ranks())


TEXTS = ["", None, "plain words", "  two  blanks\r\n\ttabs ", "Ärger über 漢字 und 😀👩‍👩‍👧", "it's we'll I'd", "a" * 3000, " ​\xa0", "x1y22 z-3.14!?"]


def test_ids_round_trip(spark, enc):
    df = spark.createDataFrame([Row(doc_id=i, text=t, ids="clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r.ids for r in tokens.token_ids(df).collect()}
    for i, t in enumerate(TEXTS):
        assert rows[i] == (enc.encode_ordinary(t) if t else [])
        assert tokens.decode_bytes(enc, rows[i]) == (t or "").encode()
    back = tokens.decoded(tokens.token_ids(df)).collect()
    assert all(bytes(r.raw) == (TEXTS[r.doc_id] or "").encode() for r in back)


def test_safe_splits_change_nothing(enc):
    rng = random.Random(1)
    pieces = ["word", " word", "  ", "\n\n", "12", "'s", "'", "漢字", "。", " ", "\t", "é", "-", "don't", " 'll", "\x1c", "　"]
    for _ in range(60):
        text = "".join(rng.choice(pieces) for _ in range(400))
        parts = tokens.split_safely(text, 40)
        assert "".join(parts) == text and len(parts) > 1
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    long = "no" * 60_000 + " " + "漢" * 60_000
    assert tokens.encode(enc, long) == enc.encode_ordinary(long)


def test_mix_keeps_shares_caps_and_reports_shortfalls(spark):
    rng = random.Random(2)
    rows = [Row(doc_id=i, text=" ".join(["word"] * rng.randint(5, 30)), source=s, rank="clash") for i, s in enumerate(["big"] * 1500 + ["mid"] * 300 + ["tiny"] * 10 + [None] * 50)]
    rows += [Row(doc_id=9001, text=None, source="mid", rank=""), Row(doc_id=9002, text="", source="mid", rank="")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank string")
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 0.4), ("m", "mid", 0.3, 3, 0.4), ("m", "tiny", 0.1, 4, 0.4), ("m", "absent", 0.1, 9, 0.4)], "mix_id string, source string, target_share double, max_repeats int, budget_share double")
    mix = mix_sources(docs, targets)
    report = {r.source: r for r in mix.report().collect()}
    enc = tokens.encoding(tokens.read_ranks())
    total = sum(tokens.encode(enc, r.text).__len__() for r in rows)
    for name, r in report.items():
        have = sum(len(tokens.encode(enc, x.text)) for x in rows if x.source == name)
        assert r.available_tokens == have and abs(r.wanted_tokens - r.target_share * 0.4 * total) < 1e-6
        assert r.short == (have * r.max_repeats < r.wanted_tokens)
        assert r.most_repeats <= r.max_repeats
        if not r.short:
            assert abs(r.drawn_tokens - r.wanted_tokens) <= max(len(tokens.encode(enc, x.text)) for x in rows if x.source == name)
    assert report["tiny"].short and report["absent"].short and report["absent"].drawn_tokens == 0
    assert all(r.cap_kept and r.share_kept for r in mix.checks().collect())
    drawn = mix.draws.groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    assert not {r.doc_id for r in drawn} & {9001, 9002}
    tiny = [r for r in mix.draws.where("source = 'tiny'").collect()]
    assert len(tiny) == 10 and all(r.copies == 4 for r in tiny)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 0.5, 1, 0.4)], "mix_id string, source string, target_share double, max_repeats int, budget_share double")
    assert tokens.token_ids(docs).count() == 0
    rows = mix_sources(docs, targets).report().collect()
    assert len(rows) == 1 and rows[0].drawn_tokens == 0 and rows[0].actual_share == 0.0


def test_length_report_counts_repeated_rows_and_null_ids(spark):
    rows = [(1, "one two", "a"), (1, "one two", "a"), (None, "three", "a"), (2, None, "b"), (3, "", None)]
    got = {r.source: r for r in tokens.length_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got["a"].documents == 3 and got["b"].documents == 1 and got[None].documents == 1
    assert got["a"].tokens == 5 and abs(got["a"].tokens_per_char - 5 / 19) < 1e-9 and got["b"].tokens_per_char is None
