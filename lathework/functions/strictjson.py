"""Strict JSON and response checks as Arrow functions: what the built-in parsers let pass is refused here."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Failure labels in their order, the wording of diagnostics, the response contract, and the form of a fenced answer.
LABELS = (
    "markdown_fence", "surrounding_text", "duplicate_key", "json_syntax", "wrong_top_level_type", "missing_field", "unexpected_field",
    "wrong_field_type", "ingredient_count", "method_count", "null_value", "blank_string", "non_positive_amount", "generation_failure",
)
DETAILS = {
    "empty": "Output does not contain a JSON value.",
    "constant": "JSON contains an invalid numeric constant.",
    "syntax": "JSON syntax error at character {}.",
    "several": "Output contains multiple complete JSON values.",
    "markdown_fence": "Output is wrapped in a Markdown code fence.",
    "surrounding_text": "A complete JSON object or array has non-whitespace text outside it.",
    "duplicate_key": "Object key occurs more than once.",
    "wrong_top_level_type": "Expected {} at root; observed {}.",
    "missing_field": "Required field is missing.",
    "unexpected_field": "Field is not permitted.",
    "wrong_field_type": "Expected {}; observed {}.",
    "count": "Expected {}–{} items; observed {}.",
    "null_value": "Null is not permitted.",
    "blank_string": "String must contain a non-whitespace character.",
    "non_positive_amount": "Amount must be greater than zero.",
}
FIELDS = {"title": "string", "ingredients": "array", "method": "array", "garnish": "string"}
INGREDIENT = {"amount": "number", "unit": "string", "name": "string"}
COUNTS = {"ingredients": (3, 8, "ingredient_count"), "method": (2, 5, "method_count")}
_FENCE = re.compile(r"\A```(?:[ \t]*[A-Za-z0-9][A-Za-z0-9._+-]*)?[ \t]*(?:\r\n|\n)(?:(?P<body>.*)(?:\r\n|\n))?```[ \t]*\Z", re.S)

_BLANK = " \t\n\r"
_BLANKS = re.compile(r"[ \t\n\r]*")


class Number:
    """A number by its digits: valid and of a sign however large or small it is."""

    __slots__ = ("lexeme",)

    def __init__(self, lexeme: str):
        self.lexeme = lexeme

    def positive(self) -> bool:
        return self.lexeme[0] != "-" and any(c in "123456789" for c in re.split("[eE]", self.lexeme)[0])


class Members(list):
    """An object's members as they stand, repeated keys and all."""


class Broken(ValueError):
    """Why no value could be read: empty, constant, or syntax at a character."""

    def __init__(self, kind: str, at: int = 0):
        super().__init__(kind)
        self.kind, self.at = kind, at

    def detail(self) -> str:
        return DETAILS[self.kind].format(self.at)


def _constant(_name):
    raise Broken("constant")


_DECODER = json.JSONDecoder(object_pairs_hook=Members, parse_constant=_constant, parse_float=Number, parse_int=Number)


def _value(text: str, at: int):
    """(value, end) of the one that starts at a character."""
    try:
        return _DECODER.raw_decode(text, at)
    except json.JSONDecodeError as e:
        raise Broken("syntax", e.pos) from None
    except RecursionError:
        raise Broken("syntax", at) from None


def _only(text: str):
    """The value of a text that is one value and blanks."""
    at = _BLANKS.match(text).end()
    if at == len(text):
        raise Broken("empty")
    value, end = _value(text, at)
    rest = _BLANKS.match(text, end).end()
    if rest < len(text):
        raise Broken("syntax", rest)
    return value


def _pointer(path: str, key) -> str:
    return f"{path}/{str(key).replace('~', '~0').replace('/', '~1')}"


def _plain(value, path: str, repeated: list[str]):
    """The value with dicts for members; the pointers of keys that occur again are added to ``repeated``. However deep the value is."""
    root = [None]
    todo = [(value, path, root, 0)]
    while todo:
        node, at, into, k = todo.pop()
        if isinstance(node, Members):
            into[k] = out = {}
            last = {key: i for i, (key, _) in enumerate(node)}
            for i, (key, v) in enumerate(node):
                own = _pointer(at, key)
                if key in out:
                    repeated.append(own)
                out[key] = None
                # values that a repeated key replaces are looked through, and left
                todo.append((v, own, out, key) if last[key] == i else (v, own, [None], 0))
        elif isinstance(node, list):
            into[k] = out = [None] * len(node)
            todo += [(v, _pointer(at, i), out, i) for i, v in enumerate(node)]
        else:
            into[k] = node
    return root[0]


def parse(text: str):
    """The value of strict JSON: one value and nothing else, no byte order mark, repeated key, NaN or infinity; else Broken."""
    if text.startswith("\ufeff"):
        raise Broken("syntax", 0)
    repeated: list[str] = []
    value = _plain(_only(text), "", repeated)
    if repeated:
        raise Broken("syntax", 0)
    return value


_LONE = re.compile("[\ud800-\udfff]")


def escaped(text: str) -> str:
    """A text with its lone surrogates, which no encoding holds, as JSON escapes."""
    return text if text.isascii() else _LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


class _Mark(str):
    """A piece of output, told from string values."""


def canonical(value) -> str | None:
    """Sorted keys, no blanks, characters as they are, lone surrogates escaped; integers by their digits, other numbers as the nearest double.

    None where a number is beyond all doubles, as JSON has no infinity.
    """
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, _Mark):
            out.append(x)
        elif isinstance(x, dict):
            out.append("{")
            todo.append(_Mark("}"))
            for n, k in enumerate(sorted(x, reverse=True)):
                todo += [*([_Mark(",")] if n else []), x[k], _Mark(json.dumps(k, ensure_ascii=False) + ":")]
        elif isinstance(x, list):
            out.append("[")
            todo.append(_Mark("]"))
            for n, v in enumerate(reversed(x)):
                todo += [*([_Mark(",")] if n else []), v]
        elif isinstance(x, Number):
            whole = not any(c in x.lexeme for c in ".eE")
            if not whole and math.isinf(float(x.lexeme)):
                return None
            out.append(("0" if x.lexeme == "-0" else x.lexeme) if whole else repr(float(x.lexeme)))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return escaped("".join(out))


def _diagnose(text: str):
    """(value or None, diagnostics): what keeps a text from being one strict value, by the first reading that fits."""
    try:
        repeated: list[str] = []
        value = _plain(_only(text), "", repeated)
        return (None if repeated else (value,)), _repeats(repeated)
    except Broken as e:
        first = e
    core = text.strip(_BLANK)
    fence = _FENCE.match(core)
    if fence:
        body, out = fence.group("body") or "", [("markdown_fence", "", DETAILS["markdown_fence"])]
        try:
            repeated = []
            _plain(_only(body), "", repeated)
            return None, out + _repeats(repeated)
        except Broken as e:
            several, _ = _sequence(body)
            return None, [*out, ("json_syntax", "", DETAILS["several"] if several and e.kind == "syntax" else e.detail())]
    several, repeated = _sequence(text)
    if several:
        return None, [*_repeats(repeated), ("json_syntax", "", DETAILS["several"])]
    found = _embedded(core)
    if found is not None:
        return None, [("surrounding_text", "", DETAILS["surrounding_text"]), *_repeats(found)]
    return None, [("json_syntax", "", first.detail())]


def _repeats(pointers: list[str]) -> list[tuple[str, str, str]]:
    return [("duplicate_key", p, DETAILS["duplicate_key"]) for p in pointers]


def _sequence(text: str) -> tuple[bool, list[str]]:
    """Whether a text is two values or more with blanks between, and the repeated keys in them."""
    at, n, repeated = _BLANKS.match(text).end(), 0, []
    while at < len(text):
        try:
            value, end = _value(text, at)
        except Broken:
            return False, []
        _plain(value, "", repeated)
        n += 1
        at = _BLANKS.match(text, end).end()
        if at == end and at < len(text):
            return False, []
    return n >= 2, repeated


def _embedded(core: str) -> list[str] | None:
    """The repeated keys of the one object or array inside prose; null unless there is just one, and no bracket before it."""
    opening = [i for i, c in enumerate(core) if c in "{["]
    found, reach = [], 0
    for at in opening:
        if at >= reach:
            try:
                value, reach = _value(core, at)
                found.append((at, value))
            except Broken:
                continue
    if len(found) != 1 or found[0][0] != opening[0]:
        return None
    repeated: list[str] = []
    _plain(found[0][1], "", repeated)
    return repeated


def _kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {Number: "number", str: "string", list: "array", dict: "object"}[type(value)]


def _expect(value, kind: str, path: str, out: list) -> bool:
    """Whether a value is of a kind; if not, why is noted."""
    if value is None:
        out.append(("null_value", path, DETAILS["null_value"]))
    elif _kind(value) != kind:
        label = "wrong_field_type" if path else "wrong_top_level_type"
        out.append((label, path, DETAILS[label].format(kind, _kind(value))))
    else:
        return True
    return False


def _closed(value: dict, fields: dict, path: str, out: list) -> None:
    out += [("missing_field", _pointer(path, f), DETAILS["missing_field"]) for f in fields if f not in value]
    out += [("unexpected_field", _pointer(path, f), DETAILS["unexpected_field"]) for f in value if f not in fields]


def _text(value, path: str, out: list) -> None:
    if _expect(value, "string", path, out) and not value.strip():
        out.append(("blank_string", path, DETAILS["blank_string"]))


def _contract(value) -> list[tuple[str, str, str]]:
    """Everything a parsed response breaks in the contract."""
    out: list = []
    if not _expect(value, "object", "", out):
        return out
    _closed(value, FIELDS, "", out)
    for f in ("title", "garnish"):
        if f in value:
            _text(value[f], f"/{f}", out)
    for f, (lo, hi, label) in COUNTS.items():
        if f in value and _expect(value[f], "array", f"/{f}", out):
            if not lo <= len(value[f]) <= hi:
                out.append((label, f"/{f}", DETAILS["count"].format(lo, hi, len(value[f]))))
            for i, x in enumerate(value[f]):
                (_text if f == "method" else _ingredient)(x, f"/{f}/{i}", out)
    return out


def _ingredient(value, path: str, out: list) -> None:
    if not _expect(value, "object", path, out):
        return
    _closed(value, INGREDIENT, path, out)
    for f in ("unit", "name"):
        if f in value:
            _text(value[f], f"{path}/{f}", out)
    if "amount" in value and _expect(value["amount"], "number", f"{path}/amount", out) and not value["amount"].positive():
        out.append(("non_positive_amount", f"{path}/amount", DETAILS["non_positive_amount"]))


def check(text: str) -> dict:
    """Whether a raw response is strict JSON and keeps the contract; all diagnostics, by label, path and detail."""
    read, found = _diagnose(text)
    if read:
        found += _contract(read[0])
    found.sort(key=lambda x: (LABELS.index(x[0]), x[1], x[2]))
    value = read[0] if read else None
    size = lambda f: len(value[f]) if isinstance(value, dict) and isinstance(value.get(f), list) else None
    present = {x[0] for x in found}
    return {
        "json_valid": read is not None,
        "schema_valid": read is not None and not found,
        "failure_labels": [x for x in LABELS if x in present],
        "diagnostics": [dict(zip(("label", "path", "detail"), map(escaped, x))) for x in found],
        "characters": len(text),
        "top_level_keys": sorted(map(escaped, value)) if isinstance(value, dict) else None,
        "ingredients": size("ingredients"),
        "method_steps": size("method"),
        "canonical": canonical(value) if read else None,
    }


_STRING, _FLAG = T.StringType(), T.BooleanType()
CHECKED = (
    T.StructType()
    .add("json_valid", _FLAG)
    .add("schema_valid", _FLAG)
    .add("failure_labels", T.ArrayType(_STRING))
    .add("diagnostics", T.ArrayType(T.StructType().add("label", _STRING).add("path", _STRING).add("detail", _STRING)))
    .add("characters", T.LongType())
    .add("top_level_keys", T.ArrayType(_STRING))
    .add("ingredients", T.IntegerType())
    .add("method_steps", T.IntegerType())
    .add("canonical", _STRING)
)
_MISSING = dict.fromkeys(CHECKED.fieldNames()) | {"json_valid": False, "schema_valid": False, "failure_labels": ["generation_failure"], "diagnostics": []}


@F.pandas_udf(CHECKED)
def checked_response(text: pd.Series) -> pd.DataFrame:
    """check() of every text; a null text is a generation failure."""
    return pd.DataFrame([_MISSING if t is None else check(t) for t in text], columns=CHECKED.fieldNames()).astype(object)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The canonical form of strict JSON, null for anything else."""

    def one(t):
        try:
            return None if t is None else canonical(parse(t))
        except Broken:
            return None

    return text.map(one)
