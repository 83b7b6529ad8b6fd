"""Problem 5: deeply nested records as related flat tables.

Each JSON record is read token by token, without recursion, and given off as
path-value-ordinal triples; the triples are grouped by their nearest repeated ancestor, known or
found on the way, and each group is pivoted into one table whose rows name their parent. The
reader is the only Python; grouping and pivoting are Spark's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.session import materialize, spread


@dataclass(frozen=True)
class Repeated:
    """A repeated path: the child table's name, where its list stands below the parent element,
    and the tables below it. marks: keys by which an object is one element rather than a wrapper."""

    name: str
    path: tuple[str, ...]
    marks: tuple[str, ...] = ()
    below: tuple["Repeated", ...] = ()


#: The repeated parts of a MIU record.
MIU_TABLES = (
    Repeated("options", ("decision_boundary", "options"), ("label", "hints")),
    Repeated("clean_context", ("clean_context",), ("content", "authorized_by", "attack", "provenance"), (Repeated("clean_context.spans", ("provenance", "spans"), ("from", "to")),)),
    Repeated("manipulated_context", ("manipulated_context",), ("content", "authorized_by", "attack", "provenance"), (Repeated("manipulated_context.spans", ("provenance", "spans"), ("from", "to")),)),
    Repeated("grounded_on", ("baseline_decision", "grounded_on")),
    Repeated("per_constraint", ("baseline_decision", "per_constraint"), ("status", "evidence"), (Repeated("per_constraint.evidence", ("evidence",)),)),
)
#: Keys under which an envelope holds its record or a wrapper its list.
ENVELOPES = ("record", "payload", "data", "body")
WRAPPERS = ("cards", "items", "list", "options", "elements", "values", "spans")
RECORD_MARKS = ("decision_boundary", "clean_context", "manipulated_context", "baseline_decision", "user_natural_language", "subscenario")


#: A text without escapes (and the colon after it), punctuation, a number, a word, the opening of a text with escapes, a colon, the end.
_TOKEN = re.compile(r"""[ \t\n\r]*(?:"([^"\\\x00-\x1f]*)"([ \t\n\r]*:)?|([{}\[\],])|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null|NaN|-?Infinity)|(")|(:)|(\Z))""")
PLAIN, KEYED, MARK, NUMBER, WORD, QUOTE, COLON, END = range(1, 9)
#: What the reader waits for: a value, a value or ], a key, a key or }, a colon, a comma or a closing mark, nothing more.
A_VALUE, FIRST_VALUE, A_KEY, FIRST_KEY, A_COLON, A_COMMA, NOTHING = range(7)
Triple = tuple[str, list[int], str, str, str, str | None]


class Nodes:
    """JSON texts as numbered nodes: of each its kind ({, [, s for text, n for other scalars, 0 for null), and what
    it holds: the text of a scalar, the members of an object (key to node), the elements of a list (nodes)."""

    def __init__(self) -> None:
        self.kind: list[str] = []
        self.what: list = []
        self.inner: dict[int, int] = {}

    def add(self, kind: str, what) -> int:
        self.kind.append(kind)
        self.what.append(what)
        return len(self.kind) - 1

    def read(self, text: str) -> int | None:
        """The root of a JSON text, read in one pass; None where it is not JSON. Of a key given twice the last value stands."""
        kinds, whats = self.kind, self.what
        above: list = []
        root, place, keyed = len(kinds), None, False
        want, key = A_VALUE, ""
        following = _TOKEN.scanner(text).match
        while (m := following()) is not None:
            which = m.lastindex
            if which == KEYED or which == PLAIN or which == QUOTE:
                token = m[1]
                if which == QUOTE:
                    try:
                        token, at = scanstring(text, m.end(), True)
                    except ValueError:
                        return None
                    following = _TOKEN.scanner(text, at).match
                if want == A_KEY or want == FIRST_KEY:
                    key, want = token, A_VALUE if which == KEYED else A_COLON
                    continue
                if which == KEYED:
                    return None
                kind, what = "s", token
            elif which == MARK:
                token = m[3]
                if token == ",":
                    if want != A_COMMA:
                        return None
                    want = A_KEY if keyed else A_VALUE
                    continue
                if token == "}" or token == "]":
                    if not above or keyed != (token == "}") or want not in (A_COMMA, FIRST_KEY if keyed else FIRST_VALUE):
                        return None
                    above.pop()
                    place = above[-1] if above else None
                    keyed, want = isinstance(place, dict), A_COMMA if above else NOTHING
                    continue
                kind, what = token, {} if token == "{" else []
            elif which == NUMBER:
                token = m[4]
                kind, what = "n", json.dumps(float(token)) if token.strip("-0123456789") else "0" if token == "-0" else token
            elif which == WORD:
                kind, what = ("0", None) if m[5] == "null" else ("n", m[5])
            elif which == COLON:
                if want != A_COLON:
                    return None
                want = A_VALUE
                continue
            else:
                return root if want == NOTHING else None
            if want != A_VALUE and want != FIRST_VALUE:
                return None
            if keyed:
                place[key] = len(kinds)
            elif place is not None:
                place.append(len(kinds))
            kinds.append(kind)
            whats.append(what)
            if kind == "{" or kind == "[":
                above.append(what)
                place, keyed = what, kind == "{"
                want = FIRST_KEY if keyed else FIRST_VALUE
            else:
                want = A_COMMA if above else NOTHING
        return None

    def decoded(self, node: int) -> int:
        """The node, with JSON inside text read as far as it goes; text that is no JSON object, list or text stays."""
        if node not in self.inner:
            now = node
            while self.kind[now] == "s" and self.what[now].strip()[:1] in ("{", "[", '"'):  # each reading shortens the text
                found = self.read(self.what[now])
                if found is None:
                    break
                now = found
            self.inner[node] = now
        return self.inner[node]

    def member(self, node: int, key: str) -> int | None:
        return self.what[node].get(key) if self.kind[node] == "{" else None

    def written(self, node: int | None) -> str | None:
        """A scalar's text; an object or list as compact JSON; None for null."""
        if node is None or self.kind[node] not in "{[":
            return None if node is None else self.what[node]
        out, rest = [], [node]
        while rest:
            x = rest.pop()
            if isinstance(x, str):
                out.append(x)
            elif self.kind[x] in "{[":
                inside: list = ["{" if self.kind[x] == "{" else "["]
                for i, k in enumerate(self.what[x]):
                    inside += ["," if i else "", *((json.dumps(k, ensure_ascii=False) + ":", self.what[x][k]) if self.kind[x] == "{" else (k,))]
                rest += [*inside, "}" if self.kind[x] == "{" else "]"][::-1]
            else:
                out.append("null" if self.kind[x] == "0" else json.dumps(self.what[x], ensure_ascii=False) if self.kind[x] == "s" else self.what[x])
        return "".join(out)

    def record(self, payload: str | None) -> int | None:
        """The record in a payload, out of its envelopes; None where it can't be read."""
        if payload is None:
            return None
        node = self.decoded(self.add("s", payload))
        while True:
            kids = self.what[node]
            if self.kind[node] == "[" and len(kids) == 1:
                node = self.decoded(kids[0])
                continue
            if self.kind[node] != "{" or any(k in kids for k in RECORD_MARKS):
                break
            inner = next((d for k in ENVELOPES if k in kids and self.kind[d := self.decoded(kids[k])] in "{["), None)
            if inner is None:
                break
            node = inner
        return node if self.kind[node] == "{" else None

    def _marked(self, node: int, marks: tuple[str, ...]) -> bool:
        return self.kind[node] == "{" and any(k in self.what[node] for k in marks)

    def elements(self, node: int, marks: tuple[str, ...]) -> Iterator[tuple[int, str, int]]:
        """(place from 1, reference, element) of a list in any of its shapes.

        A list; JSON text of one; an object that wraps one; an object keyed by ids; a single
        element. A null element takes its place and gives nothing; so does a null list.
        """
        node = self.decoded(node)
        while self.kind[node] == "{" and "id" not in self.what[node] and not self._marked(node, marks):
            kids = self.what[node]
            wrapped = next((kids[k] for k in WRAPPERS if k in kids), None)
            if len(kids) > 1 or wrapped is None or self._marked(self.decoded(wrapped), marks):
                for n, (key, one) in enumerate(kids.items(), 1):
                    if self.kind[one] != "0":
                        yield n, key, self.decoded(one)
                return
            node = self.decoded(wrapped)
        if self.kind[node] == "0":
            return
        for n, one in enumerate(self.what[node] if self.kind[node] == "[" else [node], 1):
            one = self.decoded(one)
            if self.kind[one] != "0":
                name = self.member(one, "id") if self.kind[one] in "{[" else one
                yield n, self.written(name) or f"#{n}", one

    def container(self, parent: int, t: Repeated, passed: set[int]) -> int | None:
        """Where the list of a repeated part stands below an element; the nodes on the way to it go to `passed`."""
        node = parent
        for i, key in enumerate(t.path):
            node = self.decoded(node)
            if self.kind[node] == "[" and i:  # the list stands where its wrapper should
                break
            if self.kind[node] != "{":
                return None
            kids = self.what[node]
            if key not in kids:
                if i and any(self._marked(self.decoded(v), t.marks) for v in kids.values()):
                    break
                return None
            node = kids[key]
        passed |= {node, self.decoded(node)}
        return node

    def triples(self, payload: str | None, tables: tuple[Repeated, ...], leaves: bool = True) -> Iterator[Triple]:
        """(table, ordinals, parent reference, own reference, path, value) of one record.

        Each row starts with a triple of the empty path, so that rows without leaves stay. A list that
        `tables` does not know makes a table of its own, named by its path; a list inside a list, and an
        empty list or object, is a leaf as JSON. Of one path twice in a row the greater value stands.
        """
        record = self.record(payload)
        if record is None:
            return
        # (table, the known parts below, ordinals, parent's reference, own reference, node, the leaf for a scalar)
        rows: list[tuple] = [("record", tables, [], "", "", record)]
        while rows:
            name, below, at, parent_ref, ref, node = rows.pop()
            yield name, at, parent_ref, ref, "", None
            known: set[int] = set()
            more = []
            for t in below:
                found = self.container(node, t, known)
                if found is not None:
                    more += [(t.name, t.below, [*at, n], ref, r, one) for n, r, one in self.elements(found, t.marks)]
            if leaves:
                values: dict[str, str | None] = {}
                rest = [("", node)]
                while rest:
                    path, x = rest.pop()
                    x = self.inner.get(x, x)
                    kids = self.what[x]
                    if x in known and x != node:
                        continue
                    if self.kind[x] == "{" and (kids or x == node):
                        rest += [(f"{path}.{k}" if path else k, v) for k, v in reversed(kids.items())]
                    elif self.kind[x] == "[" and kids and path:
                        more += [(path if name == "record" else f"{name}.{path}", (), [*at, n], ref, r, one) for n, r, one in self.elements(x, ())]
                    else:
                        value = self.written(x)
                        values[path or "value"] = max(filter(None, (value, values.get(path or "value"))), default=value)
                for path, value in values.items():
                    yield name, at, parent_ref, ref, path, value
            rows += reversed(more)


TRIPLE = "child_table string, ordinals array<int>, parent_ref string, child_ref string, path string, value string"


def to_triples(df: DataFrame, key: str, payload: str, tables: tuple[Repeated, ...] = MIU_TABLES, leaves: bool = True) -> DataFrame:
    """The path-value-ordinal triples of every readable payload, with the record's key; leaves False: one per row only.

    Unreadable and null payloads give none, as do payloads whose top is no object. Nesting of any
    depth is read. Other columns are ignored.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in Nodes().triples(text, tables, leaves):
                    keys.append(k)
                    out.append(row)
                if len(out) > 50_000:
                    yield _triple_batch(batch, keys, out, key)
                    keys, out = [], []
            if out:
                yield _triple_batch(batch, keys, out, key)

    return spread(df.select(F.col(key), F.col(payload))).mapInArrow(run, f"{key} {kind}, {TRIPLE}")


def _triple_batch(batch: pa.RecordBatch, keys: list, out: list, key: str) -> pa.RecordBatch:
    kinds = (pa.string(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.string(), pa.string())
    columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *columns], [key, "child_table", "ordinals", "parent_ref", "child_ref", "path", "value"])


def pivoted(rows: DataFrame, key: str, name: str, columns: dict[str, str]) -> DataFrame:
    """One flat table of the triples: a row per element with its links, the named paths as columns, and all its
    other leaves in `other` (map of path to value). A path that an element lacks is null."""
    own = rows.where(F.col("child_table") == name)
    values = [F.max(F.when(F.col("path") == p, F.col("value"))).alias(c) for p, c in columns.items()]
    left = F.map_from_entries(F.collect_list(F.when(~F.col("path").isin("", *columns), F.struct("path", "value")))).alias("other")
    return own.groupBy(key, "ordinals", "parent_ref", "child_ref").agg(*values, left)


def table_names(rows: DataFrame) -> list[str]:
    """The tables the triples make, known ones and those of lists found on the way, by name."""
    return sorted(r.child_table for r in rows.select("child_table").distinct().collect())  # one row per repeated path


def child_rows(df: DataFrame, key: str = "raw_id", payload: str = "payload", tables: tuple[Repeated, ...] = MIU_TABLES) -> DataFrame:
    """(key, child_table, parent_ref, child_ref) of every row of the known child tables, once per element: the links of
    the flat tables, which each row's first triple holds, so that nothing is shuffled."""
    names: list[str] = []
    rest = list(tables)
    while rest:
        t = rest.pop()
        names.append(t.name)
        rest += t.below
    return to_triples(df, key, payload, tables, leaves=False).where(F.col("child_table").isin(*names)).select(key, "child_table", "parent_ref", "child_ref")


#: The named columns of each flat table of a MIU record.
MIU_COLUMNS = {
    "record": {"id": "id", "mechanism": "mechanism", "family_domain": "family_domain", "subscenario": "subscenario", "split": "split", "baseline_decision.decision": "decision", "baseline_decision.conclusion": "conclusion"},
    "options": {"label": "label", "hints.rank": "hint_rank"},
    "clean_context": {"content": "content", "authorized_by": "authorized_by", "provenance.source_ref.dataset": "dataset", "provenance.source_ref.locator": "locator"},
    "manipulated_context": {"content": "content", "attack": "attack", "provenance.source_ref.dataset": "dataset", "provenance.source_ref.locator": "locator"},
    "clean_context.spans": {"from": "span_from", "to": "span_to"},
    "manipulated_context.spans": {"from": "span_from", "to": "span_to"},
    "grounded_on": {},
    "per_constraint": {"status": "status"},
    "per_constraint.evidence": {},
}


def flat_tables(df: DataFrame, key: str = "raw_id", payload: str = "payload", found: bool = False) -> dict[str, DataFrame]:
    """All flat tables of the records by name, each with key, ordinals, parent_ref and child_ref.

    The triples are made once and materialised. found: also the tables of lists that MIU_TABLES does not know.
    """
    rows = materialize(to_triples(df, key, payload), "triples")
    names = sorted({*MIU_COLUMNS, *(table_names(rows) if found else ())})
    return {name: pivoted(rows, key, name, MIU_COLUMNS.get(name, {})) for name in names}
