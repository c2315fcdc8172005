"""Text columns: normal forms, identities, tokens, shingles, overlaps. All but exact_normalize stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.split sees it, which Java's class misses in part.
SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"
_EDGE = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"


def fold(text: Column) -> Column:
    """Case folding of Latin text; exact_normalize folds all scripts."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def normalize(text: Column) -> Column:
    """Line ends unified, case folded, white space collapsed and trimmed; for text in composed form."""
    return trim(F.regexp_replace(fold(text), SPACE, " "))


@F.pandas_udf(StringType())
def exact_normalize(text: pd.Series) -> pd.Series:
    """As normalize, with canonical composition and full case folding of any script."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().split()))


def word_tokens(text: Column) -> Column:
    """Distinct ASCII words and numbers in lower case, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def spoken_tokens(text: Column) -> Column:
    """Words with inner apostrophes, in order, repeated as they are."""
    return F.regexp_extract_all(normalize(text), F.lit(r"[a-z0-9]+(?:'[a-z0-9]+)?"), 0)


def shingles(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by blanks; none for shorter lists."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def phrases(df: DataFrame, keys: list[str], text: str, n: int, name: str = "phrase") -> DataFrame:
    """The distinct n-word phrases of each row's keys. Words are cut once for each text, before phrases are formed."""
    worded = df.select(*keys, spoken_tokens(F.col(text)).alias("__w"))
    return worded.select(*keys, F.explode(shingles(F.col("__w"), n)).alias(name)).distinct()


def opening(tokens: Column, n: int) -> Column:
    """The first n tokens joined by blanks; null for shorter lists."""
    return F.when(F.size(tokens) >= n, F.array_join(F.slice(tokens, 1, n), " "))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def matches_of(normal: Column, patterns: list[str]) -> Column:
    """Sorted distinct matches of any of the patterns in a text, given in normal form in a column of its own."""
    found = F.flatten(F.array(*[F.regexp_extract_all(normal, F.lit(p), F.lit(0)) for p in patterns]))
    return F.array_sort(F.array_distinct(found))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_order(namespace: str, seed: int, *parts: Column) -> Column:
    """The key by which seeded draws and orders sort: a digest of namespace, seed and parts."""
    return F.sha2(F.concat_ws("|", F.lit(namespace), F.lit(str(seed)), *parts), 256)


def derive_seed(namespace: str, *parts: Column) -> Column:
    """The first 64 bits, unsigned, of the digest of canonical JSON with the namespace and the parts, given as JSON."""
    text = F.concat(F.lit('{"namespace":"' + namespace + '","parts":['), F.concat_ws(",", *parts), F.lit("]}"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def json_string(text: Column) -> Column:
    """A string as JSON, for text without control characters."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
