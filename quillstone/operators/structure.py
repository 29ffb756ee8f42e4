"""Deeply nested semi-structured bodies as related flat tables.

A deterministic top-down tree automaton reads each body once. Its rules (`Shape`) say, for every
state, which keys lead to which child state and what a node of that state gives; the shape of a node
(object, list, lone object in the place of a list, text that holds JSON, null, absent) picks the
transition. Every node that gives a row is routed to the typed subtype table of its state; all
subtype tables share the supertype columns (child, record key, positions of the parents, code), so
that each row keeps its key and its link to its parent.

Defined cases: a null, empty, cut-off or otherwise unreadable body gives no row; keys without a rule
are skipped, however deep what they hold; text that holds JSON is read through however often it is wrapped; of equal
keys in one object the last counts; an element that is no object keeps its
place in its list but gives no row; records delivered more than once count once, and an id that is delivered with
different bodies has the rows of all of them; an empty table
gives empty tables. Columns of the input other than the key and the body are not read, so clashing
names do no harm.
"""

from __future__ import annotations

import json
import re
import unicodedata
import xml.parsers.expat
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the supertype table.
NODE_SCHEMA = "child string, record_id bigint, pos1 int, pos2 int, pos3 int, code string, shape string"
_ARROW = pa.schema(
    [("child", pa.string()), ("record_id", pa.int64()), ("pos1", pa.int32()), ("pos2", pa.int32()), ("pos3", pa.int32()), ("code", pa.string()), ("shape", pa.string())]
)


@dataclass(frozen=True)
class Shape:
    """A state of the automaton.

    steps: key -> state of the child. repeated: the node stands in a list; its place is a position.
    child: name of the subtype table its nodes go to, or None. code: path of keys to the code;
    code_required: a missing code gives no row, else it is read as ''.
    """

    steps: dict[str, str] = field(default_factory=dict)
    repeated: bool = False
    child: str | None = None
    code: tuple[str, ...] = ()
    code_required: bool = False


_SCALAR = re.compile(r"\s*(?:(null|true|false|NaN|-?Infinity)|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?))")
_BLANK = re.compile(r"[ \t\n\r]*")
_FIXED = {"null": None, "true": True, "false": False, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def _read_deep(text: str) -> object:
    """JSON of any depth, without recursion; ValueError if it isn't any."""
    at, n = 0, len(text)
    stack: list[object] = []
    key: list[str | None] = []  # the key under which the next value of each open object goes
    root: list[object] = []

    def blank(i: int) -> int:
        return _BLANK.match(text, i).end()

    def put(value: object) -> None:
        if not stack:
            root.append(value)
        elif isinstance(stack[-1], list):
            stack[-1].append(value)
        else:
            stack[-1][key[-1]] = value

    def read_key(i: int) -> int:
        i = blank(i)
        if text[i : i + 1] != '"':
            raise ValueError("no key")
        key[-1], i = json.decoder.scanstring(text, i + 1, True)
        i = blank(i)
        if text[i : i + 1] != ":":
            raise ValueError("no colon")
        return i + 1

    while True:
        at = blank(at)
        c = text[at : at + 1]
        if c in ("{", "["):
            opened: object = {} if c == "{" else []
            put(opened)
            after = blank(at + 1)
            if text[after : after + 1] == ("}" if c == "{" else "]"):
                at = after + 1
            else:
                stack.append(opened)
                key.append(None)
                at = read_key(at + 1) if c == "{" else at + 1
                continue
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
            put(value)
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise ValueError("no value")
            number = m.group(2)
            put(_FIXED[m.group(1)] if m.group(1) else float(number) if re.search("[.eE]", number) else int(number))
            at = m.end()
        # What follows a value: the end of what is open, or a comma.
        while True:
            at = blank(at)
            if not stack:
                if at != n:
                    raise ValueError("more than one value")
                return root[0]
            c, closing = text[at : at + 1], "]" if isinstance(stack[-1], list) else "}"
            at += 1
            if c == ",":
                if closing == "}":
                    at = read_key(at)
                break
            if c != closing:
                raise ValueError("no end")
            stack.pop()
            key.pop()


def _loads(text: str) -> object:
    """The JSON value of a text, of any depth; ValueError if it isn't any."""
    try:
        return json.loads(text)
    except RecursionError:
        return _read_deep(text)


def unwrap(value: object) -> object:
    """The value itself; text that holds JSON is read through, as often as it is wrapped, and None if it can't be read."""
    while isinstance(value, str):  # each reading leaves a shorter text
        try:
            value = _loads(value)
        except ValueError:
            return None
    return value


def _scalar(value: object) -> str | None:
    if value is None or isinstance(value, (dict, list)):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else str(value)


def _code_of(node: dict, path: tuple[str, ...]) -> str | None:
    at: object = node
    for depth, key in enumerate(path):
        if depth:
            at = unwrap(at) if isinstance(at, str) else at
        if not isinstance(at, dict):
            return None
        at = at.get(key)
    return _scalar(at)


def run_automaton(shapes: dict[str, Shape], start: str, root: object, code_of: Callable = _code_of) -> Iterator[tuple[str, tuple[int, ...], str, str]]:
    """Yields (child, positions, code, shape of the node's place) of each node that gives a row; code_of reads the code off a node."""
    todo: list[tuple[str, object, tuple[int, ...]]] = [(start, root, ())]
    while todo:
        state, value, places = todo.pop()
        shape = shapes[state]
        if isinstance(value, str):
            value = unwrap(value)
            seen = "text>"
        else:
            seen = ""
        if shape.repeated:
            if isinstance(value, list):
                nodes, seen = list(enumerate(value)), seen + "list"
            else:
                nodes, seen = [(0, value)], seen + "lone"
        elif isinstance(value, list):
            nodes, seen = [(None, x) for x in value], seen + "objects"
        else:
            nodes, seen = [(None, value)], seen + "object"
        for place, node in nodes:
            if isinstance(node, str):
                node = unwrap(node)
            if not isinstance(node, dict):
                continue
            at = places if place is None else (*places, place)
            if shape.child is not None:
                code = code_of(node, shape.code)
                if code is not None or not shape.code_required:
                    yield shape.child, at, code or "", seen
            for key, after in shape.steps.items():
                if node.get(key) is not None:
                    todo.append((after, node[key], at))


def read_json(body: str | None) -> object:
    """The JSON value of a body, or None if it can't be read."""
    if not body:
        return None
    try:
        return _loads(body)
    except ValueError:
        return None


_SPACE = re.compile(r"\s+")
#: Key under which the text of an XML element stands.
TEXT = "#text"


def read_xml(body: str | None) -> object:
    """An element tree as objects: children by local name, each a list in document order; the text of
    an element, with runs of white space as one space, under '#text' if there is any. Prefixes of
    names are dropped; attributes are not kept. None if the text can't be read to its end."""
    if not body:
        return None
    root: dict[str, object] = {}
    stack: list[tuple[dict, list[str]]] = [(root, [])]

    def begin(name: str, _: object) -> None:
        node: dict[str, object] = {}
        stack[-1][0].setdefault(name.rpartition(":")[2], []).append(node)
        stack.append((node, []))

    def end(_: str) -> None:
        node, text = stack.pop()
        if joined := _SPACE.sub(" ", "".join(text)).strip():
            node[TEXT] = joined

    p = xml.parsers.expat.ParserCreate()
    p.StartElementHandler, p.EndElementHandler = begin, end
    p.CharacterDataHandler = lambda s: stack[-1][1].append(s)
    try:
        p.Parse(body.encode("utf-8", "surrogatepass") if not body.lstrip().startswith("<?xml") else re.sub(r"^\s*<\?xml.*?\?>", "", body, count=1, flags=re.S).encode("utf-8", "surrogatepass"), True)
    except xml.parsers.expat.ExpatError:
        return None
    return root


def nodes(df: DataFrame, key: str, body: str, shapes: dict[str, Shape], start: str, fmt: str = "json") -> DataFrame:
    """The supertype table of all nodes that give a row: (child, record_id, pos1, pos2, pos3, code, shape).

    One narrow pass over key and body, no shuffle of bodies; what a record delivered twice gives twice is
    dropped afterwards on the narrow rows, with a partial distinct before the shuffle. Unused positions are -1.
    """
    read = {"json": read_json, "xml": read_xml}[fmt]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            child_, id_, p1, p2, p3, code_, shape_ = (c.append for c in cols)
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if record is None or text is None:
                    continue
                for child, at, code, seen in run_automaton(shapes, start, read(text)):
                    a = (*at, -1, -1, -1)
                    child_(child), id_(record), p1(a[0]), p2(a[1]), p3(a[2]), code_(code), shape_(seen)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

    slim = df.select(F.col(key).cast("bigint").alias("record_id"), F.col(body).cast("string").alias("body")).where("body is not null and record_id is not null")
    return slim.mapInArrow(scan, NODE_SCHEMA).distinct()


def subtype(tree: DataFrame, child: str, **names: Column) -> DataFrame:
    """The typed table of one child: its rows of the supertype table under names of one's own."""
    return tree.where(F.col("child") == child).select(*[c.alias(n) for n, c in names.items()])


#: Lookup bodies of the register of signing rules.
LOOKUP_SHAPES = {
    "body": Shape(steps={"signeringsGrunnlag": "basis", "signeringsKombinasjon": "combinations"}),
    "basis": Shape(child="grunnlag", code=("kode",), code_required=True),
    "combinations": Shape(steps={"kombinasjon": "combination"}),
    "combination": Shape(steps={"personRolleKombinasjon": "person"}, repeated=True, child="kombinasjon", code=("kode",)),
    "person": Shape(repeated=True, child="kombinasjon_person", code=("rolle", "kode")),
}
#: All places of lookup bodies that name people: the two lists of the basis and the combinations.
HOLDER_SHAPES = {
    "body": Shape(steps={"signeringsGrunnlag": "basis", "signeringsKombinasjon": "combinations"}),
    "basis": Shape(steps={"muligeSigneringsRoller": "people", "signaturProkuraRoller": "people"}),
    "people": Shape(steps={"personRolleGrunnlag": "person"}),
    "combinations": Shape(steps={"kombinasjon": "combination"}),
    "combination": Shape(steps={"personRolleKombinasjon": "person"}, repeated=True),
    "person": Shape(repeated=True, child="person", code=("rolle", "kode")),
}
#: Extract bodies: representation texts of each function.
EXTRACT_SHAPES = {
    "document": Shape(steps={"AUSZUG_V2_RESPONSE": "response", "Envelope": "document", "Body": "document"}),
    "response": Shape(steps={"FUN": "function"}),
    "function": Shape(steps={"FU_DKZ10": "entry"}, repeated=True),
    "entry": Shape(steps={"TXTVERTR": "wording"}, repeated=True),
    "wording": Shape(repeated=True, child="txtvertr", code=(TEXT,), code_required=True),
}


def lookup_nodes(lookups: DataFrame) -> DataFrame:
    """Child rows of the lookup table (lookup_id, body)."""
    return nodes(lookups, "lookup_id", "body", LOOKUP_SHAPES, "body", "json")


def holders(lookups: DataFrame) -> DataFrame:
    """Distinct (orgnr, name, role) of the people named in lookup bodies; the name composed, with single spaces, or null; a missing role is '?'."""

    def name_and_role(node: dict, path: tuple[str, ...]) -> tuple[str | None, str]:
        name, role = _scalar(node.get("navn")), _code_of(node, path)
        return None if name is None else unicodedata.normalize("NFC", " ".join(name.split())), role or "?"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, *nr) for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for _, _, nr, _ in run_automaton(HOLDER_SHAPES, "body", read_json(text), name_and_role)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["orgnr", "name", "role"])

    return lookups.where("body is not null").select("orgnr", "body").mapInArrow(scan, "orgnr string, name string, role string").distinct()


def extract_nodes(extracts: DataFrame) -> DataFrame:
    """Child rows of the extract table (extract_id, body)."""
    return nodes(extracts, "extract_id", "body", EXTRACT_SHAPES, "document", "xml")


def bodies_to_tables(lookups: DataFrame, extracts: DataFrame) -> DataFrame:
    """All child tables as one: (child, record_id, pos1, pos2, pos3, code)."""
    return lookup_nodes(lookups).drop("shape").unionByName(extract_nodes(extracts).drop("shape"))
