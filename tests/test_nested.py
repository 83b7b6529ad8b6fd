"""Nested payloads in every shape as child rows, and the pivoted tables."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.operators.nested import MIU_COLUMNS, MIU_TABLES, Nodes, child_rows, flat_tables

CARD = {"id": "clean_1", "content": "x", "provenance": {"source_ref": {"dataset": "d"}, "spans": [{"from": 1, "to": 2}, None, {"from": 3, "to": 4}]}}
RECORD = {
    "id": "r", "subscenario": "s", "decision_boundary": {"options": [{"id": "opt_1", "label": "a"}, None, {"label": "b"}, {"id": None, "label": "c"}]}, "clean_context": [CARD, {"content": "y"}],
    "manipulated_context": {"mani_1": {"content": "m", "attack": "z"}, "mani_2": None}, "baseline_decision": {"decision": "opt_1", "grounded_on": ["clean_1", None, "clean_2"], "per_constraint": [{"id": "con_1", "status": "met", "evidence": ["clean_1"]}, {"status": "unknown", "evidence": None}]},
}
WANT = {
    ("options", "", "opt_1"), ("options", "", "#3"), ("options", "", "#4"), ("clean_context", "", "clean_1"), ("clean_context", "", "#2"), ("clean_context.spans", "clean_1", "#1"), ("clean_context.spans", "clean_1", "#3"),
    ("manipulated_context", "", "mani_1"), ("grounded_on", "", "clean_1"), ("grounded_on", "", "clean_2"), ("per_constraint", "", "con_1"), ("per_constraint", "", "#2"), ("per_constraint.evidence", "con_1", "clean_1"),
}


def rows(spark, payloads):
    df = spark.createDataFrame([(i, p, "clash", "clash") for i, p in enumerate(payloads)], "raw_id long, payload string, child_ref string, path string")
    out = {}
    for r in child_rows(df).collect():
        out.setdefault(r.raw_id, []).append((r.child_table, r.parent_ref, r.child_ref))
    return out


def test_shapes_agree(spark):
    wrapped = dict(RECORD, clean_context={"cards": RECORD["clean_context"]}, decision_boundary=RECORD["decision_boundary"]["options"])
    texts = dict(RECORD, clean_context=json.dumps(RECORD["clean_context"]), baseline_decision=json.dumps(RECORD["baseline_decision"]), decision_boundary={"options": json.dumps(RECORD["decision_boundary"]["options"])})
    payloads = [json.dumps(RECORD), json.dumps(json.dumps(RECORD)), json.dumps({"type": "record", "record": RECORD}), json.dumps({"data": json.dumps(RECORD)}), json.dumps(wrapped), json.dumps(texts), json.dumps([RECORD])]
    got = rows(spark, payloads)
    for i in range(len(payloads)):
        assert len(got[i]) == len(WANT) and set(got[i]) == WANT, i


def test_single_elements_and_missing_parts(spark):
    payloads = [
        json.dumps({"subscenario": "s", "clean_context": {"id": "clean_1", "content": "x"}, "baseline_decision": {"grounded_on": "clean_4"}}), json.dumps({"subscenario": "s", "clean_context": [], "manipulated_context": None}),
        None, "", "null", "[]", "12", '{"subscenario": "s", "clean_context": [{"content": "cut', "[" * 100_000, json.dumps({"subscenario": "s", "clean_context": [{"id": "a", "content": "1"}, {"id": "a", "content": "2"}]}),
        json.dumps({"subscenario": "s", "clean_context": {"content": "alone"}, "manipulated_context": {"only": {"content": "m"}}}), json.dumps({"subscenario": "s", "clean_context": [{"content": "long " * 200_000}]}),
    ]
    got = rows(spark, payloads)
    assert set(got[0]) == {("clean_context", "", "clean_1"), ("grounded_on", "", "clean_4")}
    assert set(got) == {0, 9, 10, 11}
    assert got[9] == [("clean_context", "", "a")] * 2
    assert set(got[10]) == {("clean_context", "", "#1"), ("manipulated_context", "", "only")}


def test_tables_keep_links_and_values(spark):
    tables = flat_tables(spark.createDataFrame([(7, json.dumps(RECORD))], "raw_id long, payload string"))
    assert {(r.child_ref, r.content) for r in tables["clean_context"].collect()} == {("clean_1", "x"), ("#2", "y")}
    assert {(r.parent_ref, r.child_ref, r.span_from, r.span_to) for r in tables["clean_context.spans"].collect()} == {("clean_1", "#1", "1", "2"), ("clean_1", "#3", "3", "4")}
    assert tables["record"].first()["decision"] == "opt_1"
    assert {r.status for r in tables["per_constraint"].collect()} == {"met", "unknown"}


def test_many_envelopes_and_encodings(spark):
    deep, often = {"record": RECORD}, json.dumps(RECORD)
    for _ in range(60):
        deep = {"payload": deep}
    for _ in range(12):
        often = json.dumps(often)
    got = rows(spark, [json.dumps(deep), often, json.dumps({"data": [{"body": [often]}]})])
    assert [set(got[i]) for i in range(3)] == [WANT] * 3


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=25)


@given(JSON, st.integers(0, 3), st.integers(0, 200), st.sampled_from(['"', "{", "}", "[", "]", ",", ":", "1", "-", ".", "null", "\\", "\n", "\x01", " ", "e5"]))
@settings(max_examples=400, deadline=None)
def test_reader_agrees_with_the_library(value, indent, at, edit):
    text = json.dumps(value, indent=indent or None, ensure_ascii=bool(indent % 2))
    for t in (text, text[:at], text[:at] + edit + text[at:], text[:at] + text[at + 1 :]):
        try:
            want = json.loads(t)
        except ValueError:
            want = ValueError
        nodes = Nodes()
        root = nodes.read(t)
        assert (root is None) == (want is ValueError), t
        if root is not None:
            got = nodes.written(root)
            assert json.loads("null" if got is None else json.dumps(got) if nodes.kind[root] == "s" else got) == want, t


def leaves_of(value, path=()):
    """Every scalar below a value, with its path and places."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves_of(v, (*path, k))
    elif isinstance(value, list) and value:
        for n, v in enumerate(value, 1):
            yield from leaves_of(v, (*path, n))
    else:
        yield path, value


def test_unknown_lists_make_tables_and_no_leaf_is_lost(spark):
    record = dict(RECORD, meta={"seed": 5, "empty": {}, "none": [], "notes": [{"by": "x", "marks": [1, 2, None, 4]}, {"by": "y", "deep": {"er": [[1, 2], "z"]}}]}, extra=[None, "v"])
    tables = flat_tables(spark.createDataFrame([(7, json.dumps(record)), (8, json.dumps({"subscenario": "s"}))], "raw_id long, payload string"), found=True)
    assert set(tables) == {*MIU_COLUMNS, "meta.notes", "meta.notes.marks", "meta.notes.deep.er", "extra"}
    got = []
    for name, t in tables.items():
        named = {v: k for k, v in MIU_COLUMNS.get(name, {}).items()}
        for r in (x.asDict() for x in t.where("raw_id = 7").collect()):
            got += [(name, tuple(r["ordinals"]), p, v) for p, v in {**{named[c]: r[c] for c in named if r[c] is not None}, **{p: v for p, v in r["other"].items() if v is not None}}.items()]
    known = {"decision_boundary.options": "options", "baseline_decision.grounded_on": "grounded_on", "baseline_decision.per_constraint": "per_constraint"}
    want = []
    for path, value in leaves_of(record):
        if value is None:
            continue
        places = [i for i, s in enumerate(path) if isinstance(s, int)]
        if "er" in path:  # a list inside a list is one leaf
            path, places = path[: places[1] + 1], places[:2]
            value = [1, 2] if path[-1] == 1 else value
        if "manipulated_context" in path:
            places = [1]
        name = ".".join(s for s in path[: places[-1] if places else 0] if isinstance(s, str)) or "record"
        for k, v in (*known.items(), ("clean_context.provenance.spans", "clean_context.spans")):
            name = name.replace(k, v) if name.startswith(k) else name
        name = "manipulated_context" if "manipulated_context" in path else name
        rest = path[places[-1] + 1 :] if places else path
        at = (1,) if "manipulated_context" in path else tuple(path[i] for i in places)
        want.append((name, at, ".".join(rest) or "value", value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))))
    assert len(got) == len(set(got)) and set(got) == set(want)
    links = {(tuple(r.ordinals), r.parent_ref, r.child_ref) for r in tables["meta.notes.marks"].collect()}
    assert links == {((1, 1), "#1", "1"), ((1, 2), "#1", "2"), ((1, 4), "#1", "4")}


def test_any_depth_is_read(spark):
    deep = '{"subscenario": "s", "x": ' + "[" * 50_000 + "]" * 50_000 + ', "clean_context": ["c"]}'
    assert rows(spark, [deep]) == {0: [("clean_context", "", "c")]}
    assert len(list(Nodes().triples(deep, MIU_TABLES))) > 3


def test_empty_table(spark):
    assert child_rows(spark.createDataFrame([], "raw_id long, payload string")).count() == 0
