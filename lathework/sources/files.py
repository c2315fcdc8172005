"""Small declared files: one JSON object, configurations, instruction texts, prompt sets; and sinks that replace or publish as a whole."""

from __future__ import annotations

import hashlib
import tomllib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strictjson import Broken, canonical, parse
from ..operators.records import IDENTIFIER
from .jsonl import scan_lines


class Refused(ValueError):
    """A file that isn't what it must be; says where and why."""


def _bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").take(2)
    if len(rows) != 1:
        raise Refused(f"{path}: expected one file")
    return bytes(rows[0]["content"])


def _text(spark: SparkSession, path: str) -> tuple[str, bytes]:
    raw = _bytes(spark, path)
    try:
        return raw.decode("utf-8"), raw
    except UnicodeDecodeError as e:
        raise Refused(f"{path}: not UTF-8 at byte {e.start}") from None


def strict_json_file(spark: SparkSession, path: str):
    """(value, sha256 of the bytes) of a file that is one strict JSON value."""
    text, raw = _text(spark, path)
    try:
        return parse(text), hashlib.sha256(raw).hexdigest()
    except Broken as e:
        raise Refused(f"{path}: {e.detail()}") from None


def canonical_object(spark: SparkSession, path: str) -> dict:
    """The object of a file that is its canonical form and a line feed, byte for byte."""
    text, _ = _text(spark, path)
    value, _ = strict_json_file(spark, path)
    if not isinstance(value, dict) or text != f"{canonical(value)}\n":
        raise Refused(f"{path}: not a canonical object")
    return value


def _same(a, b) -> bool:
    """Equal in value and kind: true is not 1, and 1 is not 1.0."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def toml_config(spark: SparkSession, path: str, expected: dict | None = None) -> dict:
    """A TOML file's tables; where they must be ``expected``, in value and kind, anything else is refused."""
    text, _ = _text(spark, path)
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise Refused(f"{path}: {e}") from None
    if expected is not None and not _same(found, expected):
        raise Refused(f"{path}: differs from the pinned configuration")
    return found


def instruction_text(spark: SparkSession, path: str) -> str:
    """A text with line feeds only, trimmed but for one at its end."""
    text, _ = _text(spark, path)
    body = text[:-1]
    if "\r" in text or not text.endswith("\n") or not body or body != body.strip():
        raise Refused(f"{path}: not a trimmed text with one final line feed")
    return body


def prompt_set(spark: SparkSession, path: str) -> DataFrame:
    """``prompt_id, prompt, metadata`` (metadata as JSON, ``{}`` if absent) of canonical JSON lines with just these keys, and ``problem``.

    A prompt's problem is null, or the first of: its line's, missing or unexpected keys, a bad identifier, a blank prompt,
    an identifier that occurs again.
    """
    lines = scan_lines(spark, path)
    keys = F.json_object_keys("raw")
    rows = lines.select(
        "path", "line", F.col("problem").alias("of_line"), keys.alias("keys"), F.get_json_object("raw", "$.prompt_id").alias("prompt_id"), F.get_json_object("raw", "$.prompt").alias("prompt"), F.coalesce(F.get_json_object("raw", "$.metadata"), F.lit("{}")).alias("metadata")
    )
    again = rows.where("prompt_id is not null").groupBy("prompt_id").agg(F.count("*").alias("times"))
    wanted, extra = F.array(F.lit("prompt_id"), F.lit("prompt")), F.array(F.lit("prompt_id"), F.lit("prompt"), F.lit("metadata"))
    problem = F.coalesce(
        "of_line",
        F.when(F.size(F.array_except(wanted, "keys")) > 0, "missing key"),
        F.when(F.size(F.array_except("keys", extra)) > 0, "unexpected key"),
        F.when(~F.col("prompt_id").rlike(IDENTIFIER), "bad identifier"),
        F.when(F.trim("prompt") == "", "blank prompt"),
        F.when(F.col("times") > 1, "repeated identifier"),
    )
    return rows.join(again, "prompt_id", "left").select("path", "line", "prompt_id", "prompt", "metadata", problem.alias("problem"))


def batches(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of the files a pattern matches, with ``batch``, their folder's name, and ``ord``, the rank of file and line in the order of names."""
    lines = scan_lines(spark, pattern).withColumn("batch", F.element_at(F.split("path", "/"), -2))
    # a row for each file
    files = lines.groupBy("path").agg(F.max("line").alias("n")).orderBy("path").collect()
    at, start = 0, []
    for r in files:
        start.append((r["path"], at))
        at += r["n"]
    offsets = spark.createDataFrame(start, "path string, start long")
    return lines.join(F.broadcast(offsets), "path").withColumn("ord", F.col("start") + F.col("line")).drop("start")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Several tables as one folder of JSON lines that appears whole or not at all; an existing folder is refused."""
    jvm, target, fs = _file_system(spark, path)
    if fs.exists(target):
        raise Refused(f"{path}: exists")
    draft = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    temporary = jvm.org.apache.hadoop.fs.Path(draft)
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{draft}/{name}")
        if fs.exists(target) or not fs.rename(temporary, target):
            raise Refused(f"{path}: can't be published")
    except BaseException:
        fs.delete(temporary, True)
        raise


def replace_if(spark: SparkSession, df: DataFrame, path: str, expected_sha256: str) -> None:
    """Replaces a folder of JSON lines, if its tree digest is still the expected one."""
    from .jsonl import tree_digest

    jvm, target, fs = _file_system(spark, path)
    if tree_digest(spark, path).first()["sha256"] != expected_sha256:
        raise Refused(f"{path}: has changed")
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}") for _ in range(2))
    try:
        df.write.mode("errorifexists").option("ignoreNullFields", "false").json(new.toString())
        if not fs.rename(target, old):
            raise Refused(f"{path}: can't be replaced")
        if not fs.rename(new, target):
            fs.rename(old, target)
            raise Refused(f"{path}: can't be replaced")
        fs.delete(old, True)
    finally:
        fs.delete(new, True)
