"""Renderings of parsed responses: the reading form, the similarity view, templates and packet names."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .strictjson import FIELDS, INGREDIENT, Broken, Number, check, escaped, parse


class _Digits(int):
    """A whole number that prints as its digits, however many."""

    def __new__(cls, lexeme: str):
        self = super().__new__(cls, 0)
        self.lexeme = "0" if lexeme == "-0" else lexeme
        return self

    def __repr__(self) -> str:
        return self.lexeme

    __str__ = __repr__


def _number(n: Number):
    if not n.lexeme.lstrip("-").isdigit():
        return float(n.lexeme)
    return int(n.lexeme) if len(n.lexeme) < 4000 else _Digits(n.lexeme)


def _line(text: str) -> str:
    """One composed, folded line."""
    return " ".join(unicodedata.normalize("NFC", text).casefold().split())


def ordered(value: dict) -> dict:
    """A response that keeps the contract, its fields and those of its ingredients in the contract's order."""
    one = lambda i: {k: _number(i[k]) if isinstance(i[k], Number) else i[k] for k in INGREDIENT}
    return {k: [one(i) for i in value[k]] if k == "ingredients" else value[k] for k in FIELDS}


def reading_form(value: dict) -> str:
    """Indented JSON in the contract's order, with a final line feed."""
    return _dumped(ordered(value), indent=2) + "\n"


def target_form(value: dict) -> str:
    """Compact JSON in the contract's order: what a model is trained to answer."""
    return _dumped(ordered(value), separators=(",", ":"))


def _dumped(value: dict, **form) -> str:
    """JSON; numbers of any length by their digits, which the library's writer refuses."""
    held: list[str] = []

    def stand_in(x):
        if isinstance(x, _Digits):
            held.append(x.lexeme)
            return f"\x00{len(held) - 1}\x00"
        if isinstance(x, dict):
            return {k: stand_in(v) for k, v in x.items()}
        return [stand_in(v) for v in x] if isinstance(x, list) else x

    text = json.dumps(stand_in(value), ensure_ascii=False, **form)
    for k, digits in enumerate(held):
        text = text.replace(f'"\\u0000{k}\\u0000"', digits)
    return escaped(text)


def similarity_view(value: dict) -> str:
    """Labelled parts in one normalised line."""
    v = ordered(value)
    parts = [f"title: {v['title']}", *(f"ingredient: {i['amount']} {i['unit']} {i['name']}" for i in v["ingredients"]), *(f"method: {m}" for m in v["method"]), f"garnish: {v['garnish']}"]
    return escaped(_line("\n".join(parts)))


RENDERED = T.StructType().add("reading", T.StringType()).add("view", T.StringType()).add("target", T.StringType())


@F.pandas_udf(RENDERED)
def rendered(raw: pd.Series) -> pd.DataFrame:
    """Reading form, similarity view and training target of responses that keep the contract; of others the view alone: the text normalised."""

    def one(t):
        if t is None:
            return None, None, None
        try:
            if check(t)["schema_valid"]:
                value = parse(t)
                return reading_form(value), similarity_view(value), target_form(value)
        except Broken:
            pass
        return None, escaped(_line(t)), None

    return pd.DataFrame([one(t) for t in raw], columns=["reading", "view", "target"])


def filled(template: str, **columns: Column) -> Column:
    """A template with its {names} replaced by columns, each place once and no value read as template again."""
    parts, rest = [], template
    while rest:
        at = min((rest.find("{" + k + "}") for k in columns if "{" + k + "}" in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = next(k for k in columns if rest.startswith("{" + k + "}", at))
        parts += [F.lit(rest[:at]), columns[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def packet_name(prefix: str, namespace: str, *parts: Column, digits: int = 24) -> Column:
    """A name from the digest of a namespace and the parts: prefix, a dash and the first digits."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", F.lit(namespace), *parts), 256), 1, digits))
