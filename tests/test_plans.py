from pyspark.sql import functions as F

from lathework.plans.materialize import Cuts, shared_folder
from lathework.plans.sketch import sketch_filter
from lathework.plans.skew import join_hot


def test_cut_tables_are_read_from_the_shared_folder_and_dropped(spark):
    cuts = Cuts(spark)
    a, b, c = (cuts.cut(spark.range(k)) for k in (1, 2, 3))
    assert cuts.folder.startswith(shared_folder(spark)) and (a.count(), b.count(), c.count()) == (1, 2, 3)
    assert all(shared_folder(spark) in f for f in c.inputFiles())
    cuts.drop(1, keep=1)
    assert a.count() == 1 and c.count() == 3 and cuts.made[1] == ""


def test_sketch_filter_keeps_all_that_is_needed_and_little_else(spark):
    df = spark.range(100_000).withColumn("h", F.xxhash64("id"))
    needed = df.where("id % 1000 = 7")
    kept = sketch_filter(df, F.col("h"), needed, F.col("h"))
    assert kept.where("id % 1000 = 7").count() == 100 and kept.count() < 600
    assert sketch_filter(df, F.col("h"), needed.limit(0), F.col("h")).count() == 0


def test_join_hot_is_a_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), "id")
    sides = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = {tuple(r) for r in join_hot(rows, sides, "k", "n", 3000).select("k", "id", "top").collect()}
    assert got == {tuple(r) for r in rows.join(sides.drop("n"), "k").select("k", "id", "top").collect()} and len(got) == 3000
