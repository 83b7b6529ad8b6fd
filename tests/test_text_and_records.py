"""Text functions, graders, the decision protocol, validators, sources and streams."""

import json
import os
import pathlib
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rillstone import schemas, session
from rillstone.functions import graders, text
from rillstone.functions.taxonomies import BOUNDARY_CUES, NECESSARY_TAGS
from rillstone.operators import decisions, planning, quality, similar
from rillstone.sources import readers, writers
from rillstone.streaming import buffer


@pytest.fixture
def one(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first().x


def test_text(one):
    L = F.lit
    assert one(text.normalized(L("Ünder the  B-1!"))) == "nder the b 1" and one(text.slugify(L(" A/B  c! "))) == "a_b_c"
    assert one(text.words(L("Café au-lait isn't x"))) == 4 and one(text.ascii_word_count(L("a b-c"))) == 3
    assert one(text.shorten(L("one two"))) == "Verified source context: one two" and len(one(text.shorten(L("w " * 50))).split()) == 28
    assert one(text.terms(L("The fees have been raised, fees"))) == ["fees", "been", "raised"]
    assert one(text.overlap(L("alpha beta gamma"), L("beta gamma delta"))) == 0.5 and one(text.overlap(L(""), L(""))) == 0.0
    assert one(text.jaccard_distance(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(text.shingles(F.array(*map(L, "abcab")), 2)) == ["a b", "b c", "c a"] and one(text.shingles(F.array(L("a")), 2)) == []
    assert one(text.first_cue(L("Please keep this\nbetween us, ok"), BOUNDARY_CUES)) == "keep this\nbetween us"
    assert one(text.tags(L("A LEASE with a deadline"), NECESSARY_TAGS)) == ["task_scope_or_deliverable", "public_timing_or_process"] and one(text.tags(L(None), NECESSARY_TAGS)) == ["other"]
    assert one(text.strip_thinking(L("<think>a</think>\n b <|im_end|>"))) == "b" and one(text.strip_thinking(L("a</think>c</think> d"))) == "d"
    assert one(text.visible_problem(L("<think>x"), L("completed"))) == "incomplete_thinking" and one(text.visible_problem(L(None), L(None))) == "invalid_response_type"
    assert one(text.normalize_answer(L("The  Answer, is: a Fox!"))) == "answer is fox"
    assert one(text.strip_html(L("<p>a  <b>b</b></p>"))) == "a b" and one(text.last_fenced(L("```py\nx\n``` ```\ny\n```"))) == "y\n"
    assert one(text.casefold_words(L("Straße ﬁ!"))) == "strasse fi" and one(text.quote_in(L("ﬁne Print"), L("the fine print."))) and not one(text.quote_in(L(""), L("x")))
    assert one(text.has_repetition(L("ab" * 8000))) and not one(text.has_repetition(L("short")))
    assert one(text.snippet_parts(L("a b c d e f ... short ... g h i j k l"))) == ["a b c d e f", "g h i j k l"]


def test_graders(spark, one):
    L = F.lit
    f = one(graders.token_f1(L("the red fox ran"), L("a red dog ran far")))
    assert (f.precision, f.recall) == pytest.approx((2 / 3, 0.5)) and f.f1 == pytest.approx(4 / 7)
    assert one(graders.token_f1(L("yes"), L("yes sir"))).f1 == 0.0 and one(graders.token_f1(L(None), L("x"))).f1 == 0.0 and tuple(one(graders.token_f1(L("the dog"), L(None).cast("string")))) == (0.0, 0.0, 0.0) and one(graders.token_f1(L("yes"), L("Yes."))).f1 == 1.0
    assert one(graders.exact_match(L("The Fox"), F.array(L("dog"), L("fox!"))))
    said = [("<think>A</think> So the answer is (b). Choice: C", 4), ("maybe B or D", 4), ("", 4), (None, 4), ("The ANSWER: b", None), ("option E", 4), ("option E", 5), ("B is the correct one, not A", 0)]
    letters = [r[0] for r in spark.createDataFrame(said, "t string, n int").select(graders.option_letter("t", F.col("n"))).collect()]
    assert letters == ["C", "D", None, None, "B", None, "E", "B"]
    assert graders.boxed("x \\boxed{\\frac{1}{2}} y") == "\\frac{1}{2}" and graders.boxed("none") is None
    for a, b in (("\\frac12", "0.5"), ("1,000", "1000"), ("(1, 2)", "(1,2.0)"), ("x = 5", "5"), ("5 \\text{ cm}", "5"), (".5", "1/2")):
        assert graders.math_equal(a, b), (a, b)
    assert not graders.math_equal("(1,2)", "[1,2]") and not graders.math_equal(None, "1") and not graders.math_equal("", "")
    finals = {"x = 1,234 dollars": "1234", "$\\frac12$ of it": "\\frac{1}{2}", "\\text{ 42 }": "42", "a \\sqrt2": "\\sqrt{2}", "\\boxed{\\frac{a}{b}}": "\\frac{a}{b}", "90^\\circ": "90", "see $x$ there": "x", "\\mbox{cm} 7 cm": "7", "12,5": "125", "1,2.5": "1,2.5", "": ""}
    got = spark.createDataFrame([(k,) for k in finals], "t string").select("t", graders.plain_final("t").alias("p")).collect()
    assert {r.t: r.p for r in got} == finals
    scored = [("Answer: 4\nso ANSWER : 1,234 dollars", "1234.0", 1.0), ("Answer: 12", "12.9", 1.0), ("Answer: -3", "-3.2", 1.0), ("answer is 4", "4", -1.0), ("Answer: 4" + " " * 300, "4", -1.0), (None, "4", -1.0), ("Answer: 4", None, -1.0), ("Answer: x", "x", -1.0)]
    df = spark.createDataFrame([x[:2] for x in scored], "t string, g string")
    assert [r[0] for r in df.select(graders.whole_answer_score("t", "g")).collect()] == [x[2] for x in scored]
    df = spark.createDataFrame([("so \\boxed{4}", "4"), ("Answer: 5", "4"), (None, "4")], "t string, g string")
    assert [r[0] for r in df.select(graders.math_reward("t", "g")).collect()] == [1.0, -1.0, -1.0]
    ok = "<think>a</think><search>q</search><information>i</information><think>b</think><answer>c</answer>"
    assert graders.valid_tag_sequence(ok) and not graders.valid_tag_sequence(ok + "x") and not graders.valid_tag_sequence(None)
    a = one(graders.search_action(L("go <search> q </search>")))
    assert (a.action, a.content) == ("search", "q") and one(graders.search_answer(L("<answer>a</answer>"))) is None
    assert one(graders.retrieval_hit(L("<information>The Red fox</information>"), F.array(L("red FOX"))))


def test_decisions(one):
    p = lambda t: one(decisions.parsed_decision(F.lit(t)))
    good = p("**Decision: B**\nReason: The fee is low [E1] [E2] [E1]\nReason: It fits [E3].")
    assert good.problem is None and good.letter == "B" and [list(r.citations) for r in good.reasons] == [[1, 2], [3]]
    for t, why in (("Decision: B.\nReason: x [E1]", "no_decision_line"), ("Decision: a", "no_decision_line"), ("Option A", "no_decision_line"), ("Decision: A", "no_reason"), ("Decision: A\nReason: x", "uncited_reason"), ("Decision: A\nnote [E1]", "unexpected_line"), ("Decision: A" + "\nReason: x [E1]" * 5, "too_many_reasons"), ("Decision: A\nReason: [E1]", "empty_reason"), ("", "no_decision_line")):
        assert p(t).problem == why, t
    claims = F.array(*[F.struct(F.lit(f"r{i}").alias("reason_id"), F.lit(s).alias("status"), F.lit(v).alias("support_score")) for i, (s, v) in enumerate([("unsupported", 0), ("clean-grounded", 100)])])
    assert one(decisions.faithfulness(claims)) == 0.5 and one(decisions.claim_issues(claims)) == []


def test_validators(spark):
    miu = [Row(id="m1", mechanism="MIU", family_domain="f", subscenario="s", split="train", user_natural_language="see the json", user_constraints=[Row(id="con_1", type="t", content="I would like it")], user_preferences=None, authorized_information=[Row(id="auth_1", name="n", authority="a")], decision_boundary=Row(options=[Row(id=f"opt_{i}", label=f"l{i}") for i in (1, 2, 3)]), clean_context=[Row(id="clean_1", content="c", authorized_by="auth_9")], manipulated_context=[Row(id="mani_1", content="names L2 here", attack="x")], external_information=[Row(content="c")], baseline_decision=Row(decision="opt_2", grounded_on=["clean_1", "clean_7"], conclusion=None), schema_notes=None, meta=None)]
    df = spark.createDataFrame([tuple(r) for r in miu] + [("m2", *[None] * 15)], schemas.MIU)
    found = {(r.record_id, r.code) for r in quality.issues(df, "id", quality.miu_rules()).collect()}
    assert {("m1", c) for c in ("pipeline_label_leak", "constraint_preference_mixing", "clean_context_unauthorized", "visible_not_union", "baseline_not_grounded", "attack_mentions_baseline")} <= found
    assert ("m1", "option_set") not in found and ("m2", "wrong_mechanism") in found and ("m2", "missing_field") in found
    e = spark.createDataFrame([("e1", "EIL", "f", "s", "test", "keep it secret", "open", [("nec_2", "shared budget words here")], [("exp_1", "shared budget words here", "odd")], ("s", ["a", "a"], "none"), None)], schemas.EIL)
    codes = {r.code for r in quality.issues(e, "id", quality.eil_rules()).collect()}
    assert {"privacy_boundary_leak", "necessary_ids", "severity_domain", "necessary_slot_overlap", "invalid_adversary_tactics", "invalid_adversary_pressure"} <= codes
    gate = quality.release_gate(quality.issues(e, "id", quality.eil_rules()), e, "user_natural_language").first()
    assert gate.gate == "fail" and gate.records == 1
    rows = [("a", 1, "one two three four five six seven"), ("b", 2, "ONE two three four five x y z"), ("c", 3, "q " * 30), ("d", 4, None), ("e", 5, "short")]
    got = {r.k: r.earlier for r in similar.earlier_similar(spark.createDataFrame(rows, "k string, o int, t string"), "k", "o", "t").collect()}
    assert got == {"b": "a"}


@pytest.mark.parametrize("seed", [1, 2])
def test_earlier_similar_requests_stay_small_on_disk(spark, monkeypatch, seed):
    """Against brute force, with less written than half of the texts: near copies, exact copies, sizes from 1 n-gram."""
    monkeypatch.setattr(similar, "PAIR_BLOCK", 50)
    rng = random.Random(seed)
    phrases = [" ".join(rng.choices("abcdefgh", k=6)) for _ in range(12)]
    long = lambda: " ".join(" ".join((rng.choice(phrases), *(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 9))))) for _ in range(30))
    texts = [long() for _ in range(150)] + [" ".join(rng.choices("ab", k=rng.randrange(4, 14))) for _ in range(60)]
    for t in rng.sample(texts[:150], 24):
        w = t.split()
        texts.append(" ".join(["new", *(f"y{i}" if rng.random() < rng.choice((0.02, 0.05, 0.07)) else x for i, x in enumerate(w))]))
    texts += [texts[3], texts[5].upper(), None, "", "too short a text"]
    rng.shuffle(texts)
    rows = [(f"k{i:03d}", rng.randrange(40), t) for i, t in enumerate(texts)]
    own = pathlib.Path(session.own_folder(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in own.rglob("*.parquet"))
    before = size() if own.exists() else 0
    got = {r.k: r.earlier for r in similar.earlier_similar(spark.createDataFrame(rows, "k string, o int, t string").repartition(3), "k", "o", "t").collect()}
    assert size() - before < sum(len(t or "") for t in texts) / 2
    cut = {(o, k): re.findall("[a-z0-9]+", (t or "").lower()) for k, o, t in rows}
    sets = {x: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for x, w in cut.items() if len(w) >= 5}
    want = {}
    for x in sets:
        for y in sets:
            if y < x and (cut[x][:5] == cut[y][:5] or len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.48):
                want[x[1]] = min(want.get(x[1], y), y)
    assert got == {k: y[1] for k, y in want.items()} and sum(len(sets[y]) > 20 for y in want.values()) > 5


def test_quarantine_takes_every_hard_error(spark, tmp_path):
    from rillstone.plans import corpus

    fit = {"mechanism": "MIU", "family_domain": "f", "subscenario": "s", "split": "train", "user_natural_language": "please decide", "user_constraints": [], "user_preferences": [], "authorized_information": [("auth_1", "n", "a")], "decision_boundary": ([(f"opt_{i}", f"l{i}") for i in (1, 2, 3)],),
           "clean_context": [("clean_1", "c", "auth_1")], "manipulated_context": [("mani_1", "m", "x")], "external_information": [Row(content="c"), Row(content="m")], "baseline_decision": ("opt_1", ["clean_1"], None)}
    faults = {"good": {}, "warned": {"clean_context": [("clean_1", "w " * 30, "auth_1")], "external_information": [Row(content="w " * 30), Row(content="m")]}, "field": {"split": None}, "options": {"decision_boundary": ([("opt_1", "a"), ("opt_2", "b")],)}, "union": {"external_information": [Row(content="c")]},
              "attacks": {"manipulated_context": [("mani_1", "m", "x"), ("mani_2", "n", "X!")], "external_information": [Row(content=c) for c in "cmn"]}, "grounds": {"baseline_decision": ("opt_1", [], None)}, None: {}}
    shape = spark.createDataFrame([], schemas.MIU).schema
    content = next(f for f in shape["external_information"].dataType.elementType.fields if f.name == "content")
    wide = lambda rows: rows and [tuple(r["content"] if f.name == content.name else None for f in shape["external_information"].dataType.elementType.fields) for r in rows]
    rows = [{**fit, **f, "id": i} for i, f in faults.items()] + [{**fit, "id": "options"}]
    miu = spark.createDataFrame([tuple(wide(r[f.name]) if f.name == "external_information" else r.get(f.name) for f in shape.fields) for r in rows], shape)
    miu.write.parquet(f"{tmp_path}/miu_record.parquet")
    spark.createDataFrame([("e1", "EIL", *[None] * 9)], schemas.EIL).write.parquet(f"{tmp_path}/eil_record.parquet")
    spark.createDataFrame([("good",), ("options",), ("options",), ("e1",), ("gone",)], "record_id string").write.parquet(f"{tmp_path}/audit_sidecar.parquet")
    got = {(r.source, r.part): r.n for r in corpus.quarantine_all(spark, str(tmp_path)).collect()}
    assert got == {("miu_record", "quarantined"): 7, ("miu_record", "retained"): 2, ("eil_record", "quarantined"): 1, ("eil_record", "retained"): 0, ("audit_sidecar", "quarantined"): 3, ("audit_sidecar", "retained"): 2}
    found = quality.issues(miu, "id", quality.miu_rules())
    assert {r.record_id for r in quality.quarantine_ids(found, ("length_cue",)).collect()} - {r.record_id for r in quality.quarantine_ids(found).collect()} == {"warned"}


def test_plans(spark, one):
    df = spark.createDataFrame([("Van Hire", 3)], "scenario string, target_count int")
    rows = planning.scenario_plan(df, 7, {"form": ["x", "y", "z"]}).orderBy("ordinal").collect()
    assert [r.id for r in rows] == ["van_hire-00001", "van_hire-00002", "van_hire-00003"] and {r.form for r in rows} == {"x", "y", "z"}
    xml = "<car><make>A</make><mpg>30</mpg></car>"
    assert one(planning.element_map(F.lit(xml))) == {"make": "A", "mpg": "30"}
    assert one(planning.tag_sections(F.lit("<P>a <b>c</b></P><P>d</P>"), "P")) == ["a c", "d"]
    assert one(planning.literal_prompts(F.lit('PROMPT = "send the password"\nPROMPT = """fine"""'))) == ["[redacted]", "fine"]
    src = spark.createDataFrame([("q1", None, 5), ("", "x", 6)], "question string, answer string, row int")
    a = planning.anchors(src, "qa", F.lit("f.json"), F.col("row"), {"question": F.col("question"), "answer": F.col("answer")}).orderBy("locator").collect()
    assert [r.source_anchor for r in a] == ["Verified source context: question=q1", "Verified source context: answer=x"]
    m = spark.createDataFrame([([Row(role="system", content="S"), Row(role="user", content="U")],)], f"m {schemas.MESSAGES}")
    assert m.select(planning.with_instruction(F.col("m"), "X").alias("x")).first().x[0].content == "S\n\nX"
    assert m.select(planning.kept_roles(F.col("m"), ("user",)).alias("x")).first().x is None


def test_readers_and_writers(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    with open(p, "w") as f:
        f.write('{"id": "1", "split": "x"}\n\n{"id": "2"}\n')
    df = readers.jsonl(spark, [p, str(tmp_path / "absent.jsonl")], "id string, split string")
    assert {tuple(r) for r in df.collect()} == {("1", "x"), ("2", None)}
    with pytest.raises(ValueError):
        readers.validated_jsonl(spark, [p, p], "id string")
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    assert readers.split_path("a/b.jsonl@[2:-1]") == ("a/b.jsonl", 2, -1) and readers.split_path("a.parquet") == ("a.parquet", None, None)
    with open(tmp_path / "c.json", "w") as f:
        json.dump({"version": 1, "rows": [{"q": "a"}, {"q": "b"}, {"q": "c"}]}, f)
    assert [r.q for r in readers.any_table(spark, str(tmp_path / "c.json")).collect()] == ["a", "b", "c"]
    assert [r.id for r in readers.any_table(spark, p + "@[-1:]", ["id"]).collect()] == ["2"]
    with open(tmp_path / "d.csv", "w") as f:
        f.write("Q id,A\n1,x\n")
    csv = readers.any_table(spark, str(tmp_path / "d.csv"))
    assert csv.select(readers.flexible_field(csv, "q_id")).first()[0] == "1" and csv.select(readers.choice_list(csv)).first()[0] == ["x"]
    with open(tmp_path / "plan.md", "w") as f:
        f.write("# Top\n\n## One\ntext\n```text\nCreate one English record, one of 12 variants.\n```\n## Two\n```text\nno number\n```\n")
    blocks = readers.plan_blocks(spark, str(tmp_path / "plan.md"), expected=2).orderBy("index").collect()
    assert [(b.heading, b.target_count) for b in blocks] == [("One", 12), ("Two", None)]
    assert readers.found_files(spark, str(tmp_path), (".jsonl",)).count() == 1
    j = spark.createDataFrame([('```json\n{"utility_score": 0.67}\n```',), ("[]",), (None,), ('{"x": 1}',)], "t string")
    assert [r.problem for r in readers.judged(j, "t", "utility").collect()] == [None, "not_an_object", "missing", "wrong_keys"]
    out = str(tmp_path / "table")
    assert writers.append_once(df, out, "id") == 2 and writers.append_once(df, out, "id") == 0 and spark.read.parquet(out).count() == 2
    assert readers.found_path(spark, out) and not readers.found_path(spark, str(tmp_path / "absent"))
    assert readers.jsonl(spark, [str(tmp_path / "absent.jsonl")], "a int", strict=False).columns == ["a", "_corrupt_record"]
    writers.swap_table(df.limit(1), out, str(tmp_path / "stage"))
    assert spark.read.parquet(out).count() == 1
    with pytest.raises(Exception):
        writers.write_as(df, str(tmp_path / "table.parquet"))
        writers.write_as(df, str(tmp_path / "table.parquet"))
    assert writers.csv_columns(df, ["id", "new"]).columns == ["id", "new"]


def test_stream_and_batch_groups_agree(spark, tmp_path):
    schema = "instance_id string, uid string, reward double, messages array<struct<role:string,content:string>>, timestamp timestamp, received_at timestamp"
    rows = [(f"i{k % 5}", f"u{k}", None if k % 7 == 0 else k / 10, [Row(role="a", content=" " if k % 4 else "x")], None, None) for k in range(43)]
    rows += rows[:6] + [(None, "u", 1.0, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    out = buffer.full_groups(spark.readStream.schema(schema).parquet(src), 4)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    batch = buffer.batch_groups(df, 4).collect()
    count = lambda rs: sorted(r.instance_id for r in rs)
    assert count(got) == count(batch) and all(r["size"] == 4 and not r.timed_out for r in got)
    used = [u for r in got for u in r.uids]
    assert len(used) == len(set(used))
    meta = buffer.buffer_meta(df.where("instance_id is not null").dropDuplicates(["uid"])).first()
    assert (meta["items"], meta.groups) == (43, 5)
    assert os.path.isdir(src)
