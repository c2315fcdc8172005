"""Contracts as data: named violations, coverage, quotas, projections, overlays, chains and run logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with ``violations``: the names of the rules a row breaks, in the rules' order. A rule that is unknown is broken."""
    each = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*each)))


def assert_none(df: DataFrame) -> None:
    """An error that names the first violations, if any row has some."""
    broken = df.where(F.size("violations") > 0).limit(5).collect()
    if broken:
        raise ValueError("; ".join(str(r.asDict()) for r in broken))


def coverage(df: DataFrame, dimensions: dict[str, Column], registry: DataFrame | None = None) -> DataFrame:
    """``dimension, value, n`` of every value of every dimension, nulls as 'null'; with a registry (dimension, value), also its values without rows.

    One pass and one shuffle, however many dimensions.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(c.cast("string"), F.lit("null")).alias("value")) for k, c in dimensions.items()])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
    if registry is None:
        return counts
    return registry.join(counts, ["dimension", "value"], "full_outer").select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n"))


def quota_gaps(actual: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """``by, wanted, n, gap`` where counts and targets (``by, wanted``) differ; what either side lacks counts as 0."""
    counts = actual.groupBy(*by).agg(F.count("*").alias("n"))
    both = target.join(counts, by, "full_outer").select(*by, F.coalesce("wanted", F.lit(0)).cast("long").alias("wanted"), F.coalesce("n", F.lit(0)).alias("n"))
    return both.withColumn("gap", F.col("n") - F.col("wanted")).where("gap != 0")


def missing_combinations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Combinations of the columns' values that no row has; for columns of few different values, as categories are.

    The product of the distinct values is built from one row of sets, so it is as large as the result and the data's
    own combinations, and no join of tables makes it.
    """
    sets = df.agg(*[F.collect_set(c).alias(c) for c in columns])
    expected = reduce(lambda d, c: d.withColumn(c, F.explode(c)), columns, sets)
    return expected.join(df.select(*columns).distinct(), columns, "left_anti")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``side`` and the columns of every row one side has more often than the other, as often as it has it more."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def overlay(base: DataFrame, amendments: DataFrame, key: str, replaces: str) -> DataFrame:
    """base without the rows amendments replace, and the amendments: the replaced rows leave, no row changes."""
    gone = amendments.where(F.col(replaces).isNotNull()).select(F.col(replaces).alias(key)).distinct()
    return base.join(gone, key, "left_anti").unionByName(amendments.drop(replaces))


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order, all columns kept."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, lacks``: keys that only one side has, and the side that lacks them; null keys are no keys."""
    a = left.where(F.col(key).isNotNull()).select(key).distinct().withColumn("l", F.lit(1))
    b = right.where(F.col(key).isNotNull()).select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "left").otherwise("right").alias("lacks"))


def chain_report(events: DataFrame, key: str, order: list[str], kind: str, at: str, terminal: list[str]) -> DataFrame:
    """``key, events, after_terminal, repeats, reversals, last``: what breaks the chain of each key's events.

    Events after a terminal one, events of the same kind as the one before, and steps back in time, in the order given. A
    chain is read in its order by one task, spilling what memory doesn't hold; keys are meant to have chains of a bounded
    length, as the steps of one record or one user have.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.col(kind).isin(*terminal).cast("int")).over(before)
    marked = events.select(
        key,
        kind,
        F.struct(*order).alias("place"),
        F.coalesce(ended, F.lit(0)).alias("late"),
        F.coalesce((F.lag(kind).over(w) == F.col(kind)).cast("int"), F.lit(0)).alias("same"),
        F.coalesce((F.lag(at).over(w) > F.col(at)).cast("int"), F.lit(0)).alias("back"),
    )
    return marked.groupBy(key).agg(
        F.count("*").alias("events"), F.sum("late").alias("after_terminal"), F.sum("same").alias("repeats"), F.sum("back").alias("reversals"), F.max_by(kind, "place").alias("last")
    )


def run_report(attempts: DataFrame, run: str, index: str) -> DataFrame:
    """``run, attempts, expected, missing, repeated``: attempts are numbered from 1 to the largest index that occurs."""
    per = attempts.where(F.col(run).isNotNull() & F.col(index).isNotNull()).groupBy(run, index).agg(F.count("*").alias("c"))
    return per.groupBy(run).agg(F.sum("c").alias("attempts"), F.max(index).cast("long").alias("expected"), (F.max(index) - F.count("*")).cast("long").alias("missing"), F.sum(F.when(F.col("c") > 1, 1).otherwise(0)).alias("repeated"))


def conflicting_identities(df: DataFrame, identity: str, value: str) -> DataFrame:
    """``identity, values``: identities with more than one distinct value."""
    return df.where(F.col(identity).isNotNull()).groupBy(identity).agg(F.countDistinct(value).alias("values")).where("values > 1")


def collection_digest(lines: DataFrame, order: str, line: str, block: int = 4096) -> DataFrame:
    """``lines, sha256`` of a collection in its order: the digest of the digests of its blocks of lines.

    Blocks are runs of ``block`` order numbers; only their digests, one for each block, meet in one task.
    """
    blocks = lines.select(F.floor(F.col(order) / block).alias("b"), F.struct(F.col(order).alias("o"), F.col(line).alias("l")).alias("x")).groupBy("b").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(x["l"], F.lit("\n"))), ""), 256).alias("d"))
    return blocks.agg(F.sum("n").alias("lines"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("sha256"))


def ledger(entries: DataFrame, chain: str, order: str, content: str) -> DataFrame:
    """entries with ``previous_sha256`` and ``entry_sha256``: each entry's digest covers its content and the entry before, within its chain.

    A fold along each chain; chains are folded apart, each in one task, as its definition demands.
    """
    import hashlib

    import pandas as pd

    schema = f"{chain} {entries.schema[chain].dataType.simpleString()}, {order} {entries.schema[order].dataType.simpleString()}, {content} string, previous_sha256 string, entry_sha256 string"

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        previous, before, own = "0" * 64, [], []
        for c in frame[content]:
            before.append(previous)
            previous = hashlib.sha256(f"{previous}|{c or ''}".encode()).hexdigest()
            own.append(previous)
        return frame.assign(previous_sha256=before, entry_sha256=own)

    return entries.select(chain, order, content).groupBy(chain).applyInPandas(fold, schema)


def ledger_breaks(entries: DataFrame, chain: str, order: str, content: str = "content") -> DataFrame:
    """Entries of a ledger whose previous digest isn't that of the entry before, or whose own digest doesn't cover their content.

    ``problem`` says which: ``previous``, ``entry``, or both, and ``expected`` is the entry before's digest; a sound ledger
    has no rows.
    """
    w = Window.partitionBy(chain).orderBy(order)
    before = F.coalesce(F.lag("entry_sha256").over(w), F.lit("0" * 64))
    own = F.sha2(F.concat(F.coalesce("previous_sha256", F.lit("")), F.lit("|"), F.coalesce(F.col(content), F.lit(""))), 256)
    wrong = F.array_compact(F.array(F.when(~F.col("previous_sha256").eqNullSafe(before), "previous"), F.when(~F.col("entry_sha256").eqNullSafe(own), "entry")))
    return entries.withColumns({"expected": before, "problem": F.array_join(wrong, ",")}).where("problem != ''")


def crossed_quotas(df: DataFrame, quotas: dict[str, tuple[list[str], dict[tuple, tuple[int, int]]]]) -> DataFrame:
    """``quota, value, n, least, most`` of every cell of every quota whose count is out of its bounds.

    quotas: by name the columns that cross and, for each tuple of their values, least and most; a cell without bounds may
    hold nothing. All quotas are counted in one pass and one shuffle; value joins a cell's values by '|', nulls as 'null'.
    """
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    cells = F.array(*[F.struct(F.lit(q).alias("quota"), F.concat_ws("|", *[label(c) for c in by]).alias("value")) for q, (by, _) in quotas.items()])
    counts = df.select(F.explode(cells).alias("c")).groupBy("c.quota", "c.value").agg(F.count("*").alias("n"))
    wanted = [(q, "|".join("null" if v is None else str(v) for v in cell), lo, hi) for q, (_, bounds) in quotas.items() for cell, (lo, hi) in bounds.items()]
    target = df.sparkSession.createDataFrame(wanted, "quota string, value string, least long, most long")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = counts.join(target, ["quota", "value"], "full_outer").select("quota", "value", zero("n"), zero("least"), zero("most"))
    return both.where("n < least or n > most")


def concentration(df: DataFrame, dimensions: dict[str, Column], above: int) -> DataFrame:
    """``dimension, value, n`` of the values that occur more than ``above`` times."""
    return coverage(df, dimensions).where(F.col("n") > above)


def outside_registry(df: DataFrame, registry: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose values of the columns are no row of the registry; null is in no registry."""
    return df.join(registry.select(*on).distinct(), on, "left_anti")


def linked_chain(df: DataFrame, id_: str, prior: str, target: str) -> DataFrame:
    """``id, problem`` of rows whose prior is no proper one: ``missing``, ``itself``, ``other target``, or ``shared`` with another row.

    Rows without a prior begin a chain; a row with several problems has the first.
    """
    rows = df.select(F.col(id_).alias("id"), F.col(prior).alias("prior"), F.col(target).alias("target"))
    heads = rows.select(F.col("id").alias("prior"), F.col("target").alias("prior_target"), F.lit(1).alias("there")).dropDuplicates(["prior"])
    cited = rows.where("prior is not null").groupBy("prior").agg(F.count("*").alias("cited"))
    met = rows.where("prior is not null").join(heads, "prior", "left").join(cited, "prior")
    problem = F.when(F.col("prior") == F.col("id"), "itself").when(F.col("there").isNull(), "missing").when(~F.col("prior_target").eqNullSafe(F.col("target")), "other target").when(F.col("cited") > 1, "shared")
    return met.select("id", problem.alias("problem")).where("problem is not null")


def expected_differences(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, problem``: expected rows that are missing, and actual ones that are unexpected or repeated."""
    e, a = expected.select(*keys).distinct().withColumn("__e", F.lit(1)), actual.groupBy(*keys).agg(F.count("*").alias("__n"))
    both = e.join(a, keys, "full_outer")
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("__n") > 1, "repeated")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def adjudicate(reviews: DataFrame, subject: str, decision: str, stage: str) -> DataFrame:
    """``subject, primary, second, adjudicated, outcome``: two reviews that agree decide; else the adjudication does, and without one it stays open.

    ``stage`` is 1 for the primary review, 2 for the second, 3 for the adjudication; of several reviews of a stage the least decision counts.
    """
    at = lambda k: F.min(F.when(F.col(stage) == k, F.col(decision)))
    per = reviews.groupBy(subject).agg(at(1).alias("primary"), at(2).alias("second"), at(3).alias("adjudicated"))
    outcome = F.when(F.col("primary") == F.col("second"), F.col("primary")).otherwise(F.coalesce(F.col("adjudicated"), F.lit("open")))
    return per.withColumn("outcome", outcome)
