"""JSON lines as a source with diagnostics, and write-once sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.strictjson import Broken, canonical, parse
from ..plans.materialize import cut

LINES = "path string, line int, raw string, canonical string, problem string"


def scan_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``path, line, raw, canonical, problem`` of every line: exact line numbers, and what is wrong with a line or its file.

    strict: the file has no byte order mark and no carriage return, ends in a line feed and has no blank lines, and every
    line is its own canonical form; what is wrong with a file stands at line 0. Else blank lines are skipped, and lines need
    only be strict JSON objects. A line that isn't UTF-8 has neither text. An empty file has no lines and no problem.

    Files are read in splits, however large: a first pass counts the lines of each split, from which the second numbers
    them. Both read the same splits, as they read the same files under the same settings.
    """
    m = F.col("_metadata")
    split = [m["file_path"].alias("path"), m["file_block_start"].alias("start"), m["file_size"].alias("size")]
    rows = spark.read.option("lineSep", "\n").text(path).select(*split, F.monotonically_increasing_id().alias("id"), "value")
    held = rows.groupBy("path", "start").agg(
        F.min("id").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"), F.max("size").alias("size"), F.max(F.instr("value", "\r") > 0).alias("cr"), F.max(F.col("value").startswith("\ufeff")).alias("mark")
    )
    # a row for each split; they are numbered file by file
    held = cut(held)
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select("path", "start", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    valid = F.is_valid_utf8("value")
    numbered = rows.join(starts, ["path", "start"]).select("path", (F.col("id") + F.col("shift")).cast("int").alias("line"), F.when(valid, F.col("value")).alias("raw"))

    def check(batches):
        for batch in batches:
            paths, lines, texts = (batch.column(k).to_pylist() for k in range(3))
            out = [(p, *row) for p, n, t in zip(paths, lines, texts) for row in _line(n, t, strict)]
            cols = list(zip(*out)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.string()) for c in cols[2:])], ["path", "line", "raw", "canonical", "problem"])

    found = numbered.mapInArrow(check, LINES)
    if not strict:
        return found
    # what a file's bytes have beyond its lines and their ends
    per = held.groupBy("path").agg((F.max("size") - F.sum("bytes") - F.sum("n")).alias("more"), F.max("cr").alias("cr"), F.max("mark").alias("mark"))
    plain = ~F.lower("path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$")
    wrong = F.array_compact(F.array(F.when(F.col("mark") | (plain & (F.col("more") >= 2)), "byte order mark"), F.when(F.col("cr"), "carriage return"), F.when(plain & F.col("more").isin(-1, 2), "no final line feed")))
    null = F.lit(None).cast("string")
    return found.unionByName(per.select("path", F.lit(0).alias("line"), null.alias("raw"), null.alias("canonical"), F.explode(wrong).alias("problem")))


def _line(n: int, raw: str | None, strict: bool) -> list[tuple]:
    """(line, raw, canonical, problem) of a line; none for a blank one that is skipped."""
    if raw is None:
        return [(n, None, None, "not UTF-8")]
    raw = raw.removeprefix("\ufeff") if n == 1 else raw
    if not raw.strip():
        return [(n, raw, None, "blank line")] if strict else []
    try:
        value = parse(raw)
    except Broken as e:
        return [(n, raw, None, e.detail())]
    form = canonical(value)
    problem = "not an object" if not isinstance(value, dict) else "not canonical" if strict and form != raw else None
    return [(n, raw, form, problem)]


def read_records(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """The records of clean JSON lines with ``path`` and ``line``; a problem in any line is an error that names it."""
    scanned = scan_lines(spark, path, strict)
    place = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("problem"))
    checked = scanned.withColumn("raw", F.when(F.col("problem").isNull(), F.col("raw")).otherwise(F.raise_error(place)))
    return checked.select("path", "line", F.from_json("raw", schema).alias("r")).select("path", "line", "r.*")


def write_once(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines at a path that must not exist yet; with an order, sorted over all files by range."""
    lines = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    lines.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys are not done yet: how an interrupted run goes on."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def tree_digest(spark: SparkSession, path: str) -> DataFrame:
    """``files, bytes, sha256`` of a folder: the digest of its files' sorted paths inside it, sizes and digests."""
    root = path.rstrip("/").split("://")[-1].split("file:")[-1]
    name = F.substring_index("path", root.rstrip("/") + "/", -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(name.alias("name"), "length", F.sha2("content", 256).alias("d"))
    line = F.concat_ws(" ", "name", F.col("length").cast("string"), "d")
    return files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"))
