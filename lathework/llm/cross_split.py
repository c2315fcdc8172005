"""Records of evaluation splits that recur in the training split, by a suffix array over all texts in canonical order.

Each text is written with its word occurrences in one order for all texts, rarest first, so that texts with the same words
in another order have the same suffixes. If two texts' overlap reaches the threshold, the first word they share stands
among the first n - ceil(threshold * n) + 1 of either; so the array holds the suffixes that begin there. It is
partitioned by the suffixes' first word and sorted within a partition; where suffixes of an evaluation and a training text
meet, where they stand, their texts' lengths and the length of their common prefix bound the overlap from above. Prefixes
that many suffixes share are split into blocks, each pair of blocks a task of its own. The common prefixes of a pair that
passes are merged into the words they cover, and the pair is decided by comparing all its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import cut
from ..plans.skew import join_hot
from .exact import shared_words
from .grams import canonical, occurrence_slots
from .near_dup import chunks, word_counts
from .text import BUCKETS, Words, may_overlap, mix, outlines

TRAIN = "train"
#: Suffixes of one side that are compared with those of the other at a time.
TILE = 1024


def suffixes(w: Words, count: np.ndarray, threshold: float, depth: int):
    """(document, position, first word, tail) of the suffixes kept; the tail holds the ``depth`` words after the first, four bytes each."""
    doc, h, _, rank = canonical(w, count)
    n = w.sizes()[doc]
    at = np.flatnonzero(rank < n - np.ceil(threshold * n - 1e-9) + 1)
    padded = np.concatenate([(h >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(depth + 1, np.uint32)])
    index = at[:, None] + np.arange(1, depth + 1)[None]
    end = (np.arange(len(h)) + n - rank)[at]
    tail = np.where(index < end[:, None], padded[np.minimum(index, len(padded) - 1)], 0).astype(">u4")
    return doc[at], rank[at], mix(h[at]), tail


def cross_split_overlaps(train: DataFrame, evaluation: DataFrame, threshold: float = 0.75, depth: int = 6, block: int = 4096) -> DataFrame:
    """Evaluation records whose word overlap with a training record reaches the threshold.

    train: ``id, text``; evaluation: ``field, id, text``; other columns are ignored. Result: ``field, id, train_id, words,
    covered``: a row for each evaluation record and training record; ``covered`` is how many of the evaluation text's
    ``words`` the training text has too, each as often as both have it. Null ids and texts and texts without words take no
    part; repeated rows count once; an empty side gives no rows. The result is complete; ``depth``, the words of a suffix
    beyond its first that are kept, and ``block`` change the cost only.
    """
    spark = train.sparkSession
    one_side = evaluation.select("field", F.col("id").cast("string").alias("id"), "text")
    other = train.select(F.lit(TRAIN).alias("field"), F.col("id").cast("string").alias("id"), "text").withColumn("is_train", F.lit(True))
    docs = other.unionByName(one_side.withColumn("is_train", F.lit(False))).where("text is not null and id is not null and field is not null")
    docs = docs.withColumn("exact", F.xxhash64("text"))
    counts, n_docs = word_counts(docs.select("text"), occurrence_slots)
    # 4 MB of fixed size
    shared = spark.sparkContext.broadcast(counts.astype(np.float32))
    width = 4 * depth

    def features(batches):
        for batch in batches:
            cols = batch.to_pydict()
            for who, texts in chunks(list(zip(cols["field"], cols["id"], cols["is_train"], cols["exact"])), cols["text"]):
                w = Words(texts)
                n = w.sizes()
                doc, at, head, tail = suffixes(w, shared.value, threshold, depth)
                offsets = pa.array(np.searchsorted(doc, np.arange(len(who) + 1)), pa.int32())
                flat = pa.StructArray.from_arrays(
                    [pa.array(at.astype(np.int32)), pa.array(head.view(np.int64)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(at), [None, pa.py_buffer(tail.tobytes())]).cast(pa.binary())],
                    ["at", "head", "tail"],
                )
                outline = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BUCKETS), len(who), [None, pa.py_buffer(outlines(w).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in who]), pa.array([x[1] for x in who]), pa.array([x[2] for x in who]), pa.array([x[3] for x in who], pa.int64()), pa.array(w.bags().view(np.int64)), pa.array(n.astype(np.int32)), outline, pa.ListArray.from_arrays(offsets, flat)],
                    ["field", "id", "is_train", "exact", "key", "n", "outline", "suffixes"],
                ).take(pa.array(np.flatnonzero(n > 0)))

    schema = "field string, id string, is_train boolean, exact long, key long, n int, outline binary, suffixes array<struct<at int, head long, tail binary>>"
    rows = cut(docs.select("field", "id", "is_train", "text", "exact").mapInArrow(features, schema))
    # texts with the same words have the same suffixes, so one of them stands for all
    one = rows.groupBy("key").agg(
        F.bool_or("is_train").alias("t"), F.bool_or(~F.col("is_train")).alias("e"), F.first("n").alias("n"), F.first("outline").alias("outline"), F.first("suffixes").alias("suffixes")
    )
    entry = one.select("key", "t", "e", "n", "outline", F.explode("suffixes").alias("s")).select("key", "t", "e", "n", "outline", "s.*").withColumnRenamed("head", "cell")
    entry = cut(entry)
    count = lambda c: F.count(F.when(F.col(c), 1))
    cells = entry.groupBy("cell").agg(count("e").alias("evals"), count("t").alias("trains")).where("evals > 0 and trains > 0")
    cells = cut(cells.withColumn("size", F.col("evals") + F.col("trains")))
    met = join_hot(entry, cells, "cell", "size", entry.count())
    spans = meet(met, threshold, block)
    merged = spans.groupBy("e", "t").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(at, at + span - 1)"))))).alias("seen"))
    pairs = cut(merged.select(F.col("e").alias("a"), F.col("t").alias("b"), "seen"))
    counted = shared_words(pairs, rows.select("key", "exact"), docs.select("exact", "text"), n_docs)
    near = cut(counted.where(F.col("shared") >= threshold * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9))
    ids = rows.select("field", "id", "is_train", "key").distinct()
    left = ids.where("not is_train").select("field", "id", F.col("key").alias("a"))
    right = ids.where("is_train").select(F.col("key").alias("b"), F.col("id").alias("train_id"))
    found = near.join(left, "a").join(right, "b")
    # an id may have several texts
    return found.groupBy("field", "id", "train_id").agg(F.max(F.struct(F.col("shared") / F.col("na"), "na", "shared")).alias("m")).select("field", "id", "train_id", F.col("m.na").alias("words"), F.col("m.shared").alias("covered"))


def meet(met: DataFrame, threshold: float, block: int) -> DataFrame:
    """Common prefixes ``e, t, at, span`` of an evaluation text's suffix, from word ``at`` of its canonical order, and a training text's.

    met: key, t, e, n, outline, cell, at, tail, evals, trains. Only of pairs that the bounds leave, some span of each such
    pair at the least: where two texts share no word before, they share no more than the common prefix and what either
    has left behind it, and one of the two has another word right after it.
    """
    slot = lambda many: F.pmod(F.xxhash64("key", F.lit(7)), F.greatest(F.lit(1), F.ceil(F.col(many) / block))).cast("int")
    others = lambda many: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col(many) / block)).cast("int") - 1))
    columns = ["key", "n", "outline", "at", "tail"]
    e = met.where("e").withColumns({"eb": slot("evals"), "side": F.lit(0)}).withColumn("tb", others("trains")).select("cell", "eb", "tb", "side", *columns)
    t = met.where("t").withColumns({"tb": slot("trains"), "side": F.lit(1)}).withColumn("eb", others("evals")).select("cell", "eb", "tb", "side", *columns)

    def walk(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            cell = np.stack([held.column(k).to_numpy() for k in range(3)])
            change = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0))
            if len(change):
                yield from within(held.slice(0, change[-1] + 1), cell[:, : change[-1] + 1])
                held = held.slice(change[-1] + 1)
        if held is not None:
            yield from within(held, np.stack([held.column(k).to_numpy() for k in range(3)]))

    def within(batch, cell):
        side, key, n = (batch.column(k).to_numpy() for k in range(3, 6))
        n, at = n.astype(np.int64), batch.column(7).to_numpy().astype(np.int64)
        tail = np.frombuffer(b"".join(batch.column(8).to_pylist()), ">u4").astype(np.uint32).reshape(len(key), -1)
        outline = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, BUCKETS)
        share, depth = threshold / (1 + threshold), tail.shape[1]
        # with at words before and none of them shared, a partner can't be longer than this
        longest = (n - at) / share - n + 1e-6
        edge = np.concatenate([[0], np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1, [len(key)]])
        middle = edge[:-1] + np.add.reduceat((side == 0).astype(np.int64), edge[:-1])
        out = []
        for lo, mid, hi in zip(edge[:-1].tolist(), middle.tolist(), edge[1:].tolist()):
            for a in range(lo, mid, TILE):
                x = np.arange(a, min(a + TILE, mid))
                for b in range(mid, hi, TILE):
                    y = np.arange(b, min(b + TILE, hi))
                    i, j = np.nonzero((n[y][None] <= longest[x][:, None]) & (n[x][:, None] <= longest[y][None]))
                    i, j = x[i], y[j]
                    span = 1 + np.cumprod((tail[i] == tail[j]) & (tail[i] != 0), axis=1).sum(axis=1)
                    # behind a common prefix that ends within the tails, one of the two texts has a word the other lacks
                    left, right = n[i] - at[i] - span, n[j] - at[j] - span
                    apart = (span <= depth) & (left == right) & (left > 0)
                    keep = span + np.minimum(left, right) - apart >= share * (n[i] + n[j]) - 1e-6
                    i, j, span = i[keep], j[keep], span[keep]
                    keep = may_overlap(outline[i], n[i], outline[j], n[j], threshold)
                    if keep.any():
                        out.append((i[keep], j[keep], span[keep]))
        if out:
            i, j, span = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(key[j]), pa.array(at[i].astype(np.int32)), pa.array(span.astype(np.int32))], ["e", "t", "at", "span"])

    return e.unionByName(t).repartition("cell", "eb", "tb").sortWithinPartitions("cell", "eb", "tb", "side", "tail").mapInArrow(walk, "e long, t long, at int, span int")


def overlap_report(found: DataFrame, evaluation: DataFrame) -> DataFrame:
    """``field, source, records, overlapping, pairs, coverage`` per evaluation field and source, from cross_split_overlaps' rows.

    evaluation: ``field, id, source``; a null source is a source of its own. ``coverage`` is the mean over the overlapping
    records of the greatest share of a record's words that one training record covers; null where none overlaps.
    """
    per = found.groupBy("field", "id").agg(F.count("*").alias("pairs"), F.max(F.col("covered") / F.col("words")).alias("most"))
    all_ = evaluation.where("id is not null").select("field", F.col("id").cast("string").alias("id"), "source").distinct()
    return (
        all_.join(per, ["field", "id"], "left")
        .groupBy("field", "source")
        .agg(F.count("*").alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.avg("most"), 6).alias("coverage"))
    )
