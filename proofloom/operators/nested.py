"""Nested documents into related flat tables, by a deterministic tree automaton over object shapes.

Bottom-up pass: while a document is parsed, every object gets a state from its keys and its children's states; the
rules (RULES) are tried in order and the states of shapes already seen are kept, so a shape is classified once per
task. There are finitely many states. Top-down pass: from a source's start role, a transition (role, key, state) of
STEPS gives each node its own role and routes it to a structural variant or lets it go. Both passes are iterative, so
no document is too deep.

Each variant has a typed table (``typed``): its own columns and the common ones of all variants, source_table,
parent_key, child_path, parent_path and position. ``common`` is the union of the typed tables over the common columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.operators.skew import spread_out

#: Keys whose value is an array; a single value there is an array of one.
ARRAYS = frozenset(["members", "bound_conditions", "evidence", "raw_text"])
#: Shapes whose state a task remembers.
_SHAPES = 100_000
#: Characters of paths and values after which a task sends its rows on.
_BATCH_CHARS = 8 << 20

SCALARS = frozenset(["text", "blank", "number", "real", "flag"])
_KINDS = {str: "text", int: "number", float: "real", bool: "flag", type(None): "null"}
#: States of objects under which an agent stands somewhere.
HOLDERS = frozenset(["agent", "binding", "statement", "holder"])


class Node(dict):
    """A JSON object with its state."""

    __slots__ = ("state",)
    state: str


Shape = dict[str, "str | frozenset[str]"]


def _inner(shape: Shape) -> set[str]:
    """The states of an object's children, those of a list's items among them."""
    out: set[str] = set()
    for s in shape.values():
        out |= s if isinstance(s, frozenset) else {s}
    return out


#: State of an object, and when it has it: the first rule that holds counts.
RULES: list[tuple[str, Callable[[Shape], bool]]] = [
    ("evidence", lambda s: "source_hash" in s),
    ("agent", lambda s: "name" in s),
    ("binding", lambda s: s.get("agent") == "agent" and "type" not in s),
    ("statement", lambda s: "type" in s and bool(_inner(s) & HOLDERS)),
    ("holder", lambda s: bool(_inner(s) & HOLDERS)),
    ("identified", lambda s: "id" in s),
    ("record", lambda s: bool(s)),
    ("empty", lambda s: True),
]
OBJECTS = frozenset(name for name, _ in RULES)

#: The role of a document's root.
START = {"statement": "statement", "evidence": "evidence document", "db_refs": "namespaces"}
#: (role, key or None for all others) -> the states let through, the role they get (None: go no further), the variant.
STEPS: dict[tuple[str, str | None], list[tuple[frozenset[str], str | None, str | None]]] = {
    ("statement", "evidence"): [(frozenset(["evidence"]), None, "evidence")],
    ("statement", None): [(frozenset(["agent"]), "agent", "agent"), (HOLDERS - {"agent"}, "statement", None)],
    ("agent", None): [(frozenset(["agent"]), "agent", "agent"), (HOLDERS - {"agent"}, "agent", None)],
    ("evidence document", "text_refs"): [(OBJECTS, "references", None)],
    ("evidence document", "annotations"): [(OBJECTS, "annotations", None)],
    ("annotations", "agents"): [(OBJECTS, "annotated agents", None)],
    ("annotated agents", "raw_text"): [(SCALARS, None, "raw_text")],
    ("references", None): [(SCALARS, None, "text_ref")],
    ("namespaces", None): [(SCALARS | {"scored", "list"} | OBJECTS, None, "db_id")],
}
#: The typed columns of every variant: name, type, and the column of the flat rows it comes from.
TYPED: dict[str, list[tuple[str, str, str]]] = {
    "agent": [("role", "string", "label"), ("name", "string", "child_value")],
    "evidence": [("source_hash", "string", "child_value")],
    "text_ref": [("ref_type", "string", "label"), ("ref_id", "string", "child_value")],
    "raw_text": [("raw_text", "string", "child_value")],
    "db_id": [("namespace", "string", "label"), ("db_id", "string", "child_value"), ("score", "double", "score")],
}
COMMON = ["source_table", "parent_key", "child_path", "parent_path", "position"]
SCHEMA = "source_table string, parent_key string, child_path string, child_value string, variant string, parent_path string, position int, label string, score double"
_FIELDS = [x.strip().split(" ") for x in SCHEMA.split(",")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in _FIELDS])


class Automaton:
    """The bottom-up states of JSON nodes; ``node`` is called for every object after the objects inside it."""

    def __init__(self) -> None:
        self.shapes: dict[tuple, str] = {}

    def node(self, pairs: list[tuple[str, object]]) -> Node:
        n = Node(pairs)
        shape = tuple([(k, self.state(v)) for k, v in n.items()])
        s = self.shapes.get(shape)
        if s is None:
            d = dict(shape)
            s = next(name for name, holds in RULES if holds(d))
            if len(self.shapes) < _SHAPES:
                self.shapes[shape] = s
        n.state = s
        return n

    def state(self, x: object) -> str | frozenset[str]:
        """The state of a node; a list has the set of its items' states, but for an id with its score."""
        if isinstance(x, Node):
            return x.state
        if isinstance(x, list):
            return "scored" if _scored(x) else frozenset([self.item(y) for y in x])
        return "blank" if x == "" else _KINDS[type(x)]

    def item(self, x: object) -> str:
        """The state of a list's item, where lists inside lists are told apart no further."""
        return ("scored" if _scored(x) else "list") if isinstance(x, list) else self.state(x)

    def document(self, text: str | None) -> object | None:
        """The document of a text with all states; one inside a JSON string counts as itself. None if not valid."""
        try:
            x = self._parse(text) if text else None
            while isinstance(x, str):
                x = self._parse(x)
            return x
        except ValueError:
            return None

    def _parse(self, text: str) -> object:
        try:
            return json.loads(text, parse_constant=_no_constant, object_pairs_hook=self.node)
        except RecursionError:
            return parse_deep(text, self.node)


def _scored(x: list) -> bool:
    return len(x) == 2 and isinstance(x[0], str) and isinstance(x[1], float)


def _no_constant(name: str) -> None:
    raise ValueError(name)


# The grammar of JSON's blanks, numbers and names.
_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_NAMES = {"true": True, "false": False, "null": None}


def parse_deep(text: str, hook: Callable[[list[tuple[str, object]]], object]) -> object:
    """The value of a JSON text of any depth, with an explicit stack; ValueError if it is not valid as a whole."""
    skip = lambda i: _BLANK.match(text, i).end()
    open_: list[tuple[list, list[str] | None]] = []

    def key(i: int) -> int:
        if text[i : i + 1] != '"':
            raise ValueError("key")
        k, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("colon")
        open_[-1][1].append(k)
        return skip(i + 1)

    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c == "{" or c == "[":
            i = skip(i + 1)
            if text[i : i + 1] == ("}" if c == "{" else "]"):
                value, i = hook([]) if c == "{" else [], i + 1
            else:
                open_.append(([], [] if c == "{" else None))
                i = key(i) if c == "{" else i
                continue
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif name := next((n for n in _NAMES if text.startswith(n, i)), None):
            value, i = _NAMES[name], i + len(name)
        elif m := _NUMBER.match(text, i):
            whole, part, power = m.groups()
            value, i = float(m.group()) if part or power else int(whole), m.end()
        else:
            raise ValueError("value")
        while True:
            i = skip(i)
            if not open_:
                if i != len(text):
                    raise ValueError("rest")
                return value
            items, keys = open_[-1]
            items.append(value if keys is None else (keys[-1], value))
            c, i = text[i : i + 1], i + 1
            if c == ",":
                i = skip(i)
                i = i if keys is None else key(i)
                break
            if c != ("]" if keys is None else "}"):
                raise ValueError("end")
            open_.pop()
            value = items if keys is None else hook(items)


def scalar(x: object) -> str | None:
    """A scalar as text; null, empty strings and what is no scalar have none."""
    if x is None or isinstance(x, (dict, list)):
        return None
    s = ("true" if x else "false") if isinstance(x, bool) else str(x)
    return s.encode("utf-8", "replace").decode("utf-8") or None


def _value(variant: str, y: object) -> tuple[str | None, float | None]:
    """A routed node's value and score."""
    if variant == "agent":
        return scalar(y["name"]), None
    if variant == "evidence":
        return scalar(y["source_hash"]), None
    if isinstance(y, list):
        return (scalar(y[0]) if y else None), (y[1] if _scored(y) else None)
    return scalar(y.get("id") if isinstance(y, dict) else y), None


Path = tuple["Path", str] | None


def _text(path: Path, stop: Path = None) -> str:
    out = []
    while path is not stop:
        path, piece = path
        out.append(piece)
    return ".".join(reversed(out))


def routed(doc: object, source: str, auto: Automaton) -> Iterator[tuple]:
    """(path, value, variant, parent path, position, label, score) of every node of ``doc`` that STEPS routes.

    The parent of a bound agent is the agent it is bound to, of a database id its namespace, of all others the object
    they stand in; the root's path is empty. The label is the key under which the node stands.
    """
    if not isinstance(doc, Node):
        return
    todo: list[tuple[Path, object, str, Path]] = [(None, doc, START[source], None)]
    while todo:
        at, o, role, owner = todo.pop()
        for k, v in o.items():
            steps = STEPS.get((role, k)) or STEPS.get((role, None))
            if not steps:
                continue
            many = k in ARRAYS or role == "namespaces"
            alone = not isinstance(v, list) or (role == "namespaces" and _scored(v))
            path = (at, k)
            items: list[tuple[Path, object, int]] = [((path, "0") if many else path, v, 0)] if alone else [((path, str(i)), y, i) for i, y in enumerate(v)]
            while items:
                p, y, i = items.pop()
                s = auto.item(y)
                step = next((x for x in steps if s in x[0]), None)
                if step is None:
                    if s == "list":
                        items.extend(((p, str(j)), z, j) for j, z in enumerate(y))
                    continue
                _, then, variant = step
                if variant:
                    value, score = _value(variant, y)
                    if value is not None:
                        above = owner if variant == "agent" else path if role == "namespaces" else at
                        yield _text(p), value, variant, _text(above), i, k, score
                if then:
                    todo.append((p, y, then, p if variant else owner))


def flatten(df: DataFrame, source_table: str, parent_key: Column | str, json_col: str, source: str) -> DataFrame:
    """One row (SCHEMA) per nested item of the documents in ``json_col``; ``source`` is statement, evidence or db_refs.

    Rows without a key, and documents that are null, empty or not valid JSON as a whole, give no rows; a document of
    any depth gives all of its rows. Null and empty values give no row, but positions count them. Repeated rows give
    repeated items; other columns are ignored. Only the key and the document leave the JVM, in Arrow batches; a scan
    with fewer partitions than cores is dealt out first. Rows are sent on by size, so a deep document's long paths
    never fill a task.
    """
    if source not in START:
        raise ValueError(f"source must be one of {sorted(START)}")

    def batch(key_and_row: Iterable[tuple[str, tuple]]) -> pa.RecordBatch:
        rows = [(source_table, k, *r) for k, r in key_and_row]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_ARROW)], schema=_ARROW)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton()
        for b in batches:
            out: list[tuple[str, tuple]] = []
            size = 0
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in routed(auto.document(text), source, auto):
                    out.append((k, row))
                    size += len(row[0]) + len(row[1]) + len(row[3])
                    if size > _BATCH_CHARS:
                        yield batch(out)
                        out, size = [], 0
            yield batch(out)

    k = F.col(parent_key) if isinstance(parent_key, str) else parent_key
    docs = df.select(k.cast("string").alias("k"), F.col(json_col).alias("j")).filter("k is not null and j is not null")
    return spread_out(docs).mapInArrow(rows, SCHEMA)


def typed(nodes: DataFrame, variant: str) -> DataFrame:
    """The typed table of one structural variant: the common columns and the variant's own (TYPED)."""
    own = [F.col(c).cast(t).alias(name) for name, t, c in TYPED[variant]]
    return nodes.filter(F.col("variant") == variant).select(*COMMON, *own)


def common(tables: dict[str, DataFrame]) -> DataFrame:
    """The union of typed tables over the common columns, with the variant and its value as ``child_value``."""
    value = {v: next(name for name, _, c in own if c == "child_value") for v, own in TYPED.items()}
    parts = [t.select(*COMMON, F.col(value[v]).alias("child_value"), F.lit(v).alias("variant")) for v, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)
