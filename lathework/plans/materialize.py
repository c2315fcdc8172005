"""Cutting lineage in a way that survives lost executors: tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the setting is absent, as in tests, a temporary one of our own, but never on a cluster."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _OWN.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="lathework-shared-"))
    return folder.rstrip("/")


class Cuts:
    """Tables written for one computation, so that those no longer read can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/lathework-{uuid.uuid4().hex}", []

    def cut(self, df: DataFrame, file_rows: int = 0) -> DataFrame:
        """df, written once and read from there; ``file_rows``: the most rows of a file, 0 for any number."""
        path = f"{self.folder}/{len(self.made)}"
        schema = df.schema
        df.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
        self.made.append(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, first: int, keep: int) -> None:
        """Deletes the tables from number ``first`` on, but for the last ``keep``; nothing may read them any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for k in range(first, len(self.made) - keep):
            if self.made[k]:
                p = jvm.org.apache.hadoop.fs.Path(self.made[k])
                p.getFileSystem(conf).delete(p, True)
                self.made[k] = ""


def cut(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """df, written once to the shared folder and read from there; it stays as long as the folder does."""
    return Cuts(df.sparkSession).cut(df, file_rows)
