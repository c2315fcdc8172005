"""Near-duplicate records by a blocked product of the document by word incidence matrix.

The product is A Aᵀ with a row for each document and a column for each occurrence of a word (its first, its second, ...):
n-grams of one word, as texts may be reordered. Any two documents whose overlap reaches the threshold share a column
among the rarest of both (grams.prefixes), so no other columns take part. The product runs column by column where columns
hold at most ``block`` documents, and the counts of shared columns are accumulated pair by pair. Documents with a larger
column among their rarest are multiplied with each other as a whole, in blocks of like sizes, each pair of blocks a task
of its own: all words are multiplied, put together in columns so that words which occur together share one. Sizes,
accumulated counts and word outlines bound each pair's overlap from above; pairs below the bound are discarded where they
arise, the rest are compared word by word.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import cut
from ..plans.sketch import sketch_filter
from .components import components
from .exact import shared_words
from .grams import SKETCH, occurrence_slots, prefixes, slots
from .text import BUCKETS, Words, may_overlap, mix, outlines

#: Texts hashed together: bounds a worker's memory to a few times their bytes.
CHUNK_BYTES = 4 << 20
#: The most columns multiplied in the dense product, each a byte; documents, and their words, in one of its blocks, about;
#: documents multiplied at a time; steps of size from one block to those still compared with it.
DENSE, DENSE_ROWS, DENSE_WORDS, TILE, STEPS = 256, 16384, 1 << 22, 512, 2
#: Numbers of columns tried, fewest first; the share of the pairs that a column's product costs as much as to compare further.
WIDTHS, WORTH = (96, 160, DENSE), 1e-4
#: Texts, and characters of each, by which words are put together in columns; the most frequent words placed by them, over
#: and over; times its own cost that a word in a column with others may cost while columns are empty.
SAMPLE, SAMPLE_CHARS, PLACED, SWEEPS, LOSS = 1024, 4096, 1024, 3, 1.2


def chunks(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list]]:
    """The texts of a batch in runs of about CHUNK_BYTES."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_BYTES or k == len(texts) - 1:
            yield ids[at : k + 1], texts[at : k + 1]
            at, size = k + 1, 0


def word_counts(texts: DataFrame, slots=slots) -> tuple[np.ndarray, int]:
    """The sketch of word counts (or of what ``slots`` gives) over all rows of ``texts`` (one column), and the number of rows.

    SKETCH counters come to the driver, whatever the rows.
    """

    def count(batches):
        total, rows = np.zeros(SKETCH, np.int64), 0
        for batch in batches:
            column = batch.column(0).to_pylist()
            rows += len(column)
            for part, _ in chunks(column, column):
                total += np.bincount(slots(Words(part)), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["slot", "n"])

    got = texts.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SKETCH, np.int64)
    inner = got[got["slot"] >= 0]
    out[inner["slot"].to_numpy()] = inner["n"].to_numpy()
    return out, int(got.loc[got["slot"] < 0, "n"].sum())


def dense_columns(count: np.ndarray, n_docs: int, w: Words, threshold: float) -> tuple[np.ndarray, int]:
    """The column of each sketch slot in the dense product, -1 for those that no text has, and the number of columns.

    The product of the roots of two documents' counts in a column is at least the words they share there, whichever words
    it holds, so the columns' choice, by the texts of w, decides the cost and never the result. Few columns cost little
    and leave many pairs to be compared further; taken are the fewest of WIDTHS that leave no more than is worth it.
    """
    doc, slot, n = w.occurrences()[0], occurrence_slots(w), w.sizes()
    bound = threshold / (1 + threshold) * np.add.outer(n, n)
    able = np.minimum.outer(n, n) >= bound
    np.fill_diagonal(able, False)
    for width in WIDTHS:
        place = together(count, n_docs, doc, slot, width)
        known = place[slot] >= 0
        root = np.sqrt(np.bincount(doc[known] * width + place[slot[known]], minlength=len(n) * width).reshape(-1, width))
        if (able & (root @ root.T >= bound)).sum() <= WORTH * width * able.sum():
            break
    return place, width


def together(count: np.ndarray, n_docs: int, doc: np.ndarray, slot: np.ndarray, width: int) -> np.ndarray:
    """Columns for the sketch slots that keep the product of two documents' roots small; doc, slot: those of some documents.

    Over pairs of documents that product is, in each column, the square of the mean root on average. Words that always
    occur together add no more to it in one column than in two.
    """
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    place = np.full(len(count), -1, np.int16)
    top = np.full(len(count), -1)
    top[order[:PLACED]] = np.arange(len(order[:PLACED]))
    docs = max(int(doc[-1]) + 1 if len(doc) else 0, 1)
    held, word = doc[top[slot] >= 0], top[slot[top[slot] >= 0]]
    by_word = np.argsort(word, kind="stable")
    rows = np.split(held[by_word], np.searchsorted(word[by_word], np.arange(1, len(order[:PLACED]))))
    x, mean, size = np.zeros((docs, width), np.int64), np.zeros(width), np.zeros(width, np.int64)
    # what one more word adds to a document's root
    more = np.ones((docs, width))

    def put(at: np.ndarray, c: int, by: int) -> None:
        new = x[at, c] + by
        mean[c] += (np.sqrt(new) - np.sqrt(x[at, c])).sum() / docs
        x[at, c] = new
        more[at, c] = np.sqrt(new + 1) - np.sqrt(new)
        size[c] += by

    for _ in range(SWEEPS):
        for k, at in enumerate(rows):
            # a word of none of these documents is placed below
            if not len(at):
                continue
            if place[order[k]] >= 0:
                put(at, place[order[k]], -1)
            add = more[at].sum(axis=0) / docs
            cost = np.where(size > 0, add * (2 * mean + add), np.inf)
            c = int(np.argmin(cost))
            if cost[c] > LOSS * (len(at) / docs) ** 2 and not size.all():
                c = int(np.argmin(size))
            put(at, c, 1)
            place[order[k]] = c
    # the rest as if independent of the others
    rest, add = order[place[order] < 0], more.mean(axis=0)
    load = [(mean[c] * add[c], c) for c in range(width)]
    heapq.heapify(load)
    for s, share in zip(rest.tolist(), (count[rest] / max(n_docs, 1)).tolist()):
        cost, c = heapq.heappop(load)
        place[s] = c
        heapq.heappush(load, (cost + share * add[c] ** 2, c))
    return place


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.7,
    min_words: int = 50,
    block: int = 512,
    expand_copies: int = 32,
) -> DataFrame:
    """Pairs of records of one collection whose word overlap reaches the threshold.

    docs: ``collection, id, text``; further columns are ignored. Result: ``collection, id_a, id_b`` with id_a < id_b,
    each pair once. The overlap of two texts is the words they share over the words in either, each as often as it
    occurs. Texts under ``min_words`` words, null texts and null ids take no part; repeated rows count once; one id with
    two texts is compared by both, and never paired with itself. An empty input gives no pairs.

    The first ``expand_copies`` records of one text, by id, are paired with each other and with those of all texts near
    it; each further copy is paired with the first of its text, through which all its other pairs follow. So a group of
    copies never becomes the square of its size; links between different texts are all given.

    The result is complete. ``block`` only says from which size on a column counts as large.
    """
    return expand(*near_classes(docs, threshold, min_words, block), expand_copies)


def near_classes(docs: DataFrame, threshold: float = 0.7, min_words: int = 50, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """Near classes ``a, b`` of near_duplicates, and their members ``collection, id, key, exact``.

    A class, by ``key``, are the records with the same bag of words; ``exact`` is a hash of the text itself.
    """
    spark = docs.sparkSession
    docs = docs.select("collection", "id", "text", F.xxhash64("text").alias("exact")).where("text is not null and id is not null and collection is not null")
    sketch, n_docs = word_counts(docs.select("text"), occurrence_slots)
    if not n_docs:
        return spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "collection string, id string, key long, exact long")
    step = -np.log(threshold * (1 - 1e-9)) / STEPS
    # some SAMPLE texts, to choose columns only
    own = F.xxhash64("id", "exact")
    some = docs.where(F.pmod(own, F.lit(n_docs // SAMPLE + 1)) == 0).select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), own.alias("own")).orderBy("own").limit(SAMPLE)
    place, width = dense_columns(sketch, n_docs, Words([r["text"] for r in some.collect()]), threshold)
    # 6 MB of fixed size
    shared = spark.sparkContext.broadcast((sketch.astype(np.float32), place))

    def features(batches):
        for batch in batches:
            cols = batch.to_pydict()
            for who, texts in chunks(list(zip(cols["collection"], cols["id"], cols["exact"])), cols["text"]):
                w = Words(texts)
                n = w.sizes()
                count, at = shared.value
                doc, gram, seen = prefixes(w, count, threshold)
                salt = np.fromiter((hash_text(x[0]) for x in who), np.uint64, len(who))
                key = mix(w.bags() + salt).view(np.int64)
                large = np.bincount(doc[seen > block], minlength=len(who)) > 0
                doc, gram = doc[seen <= block], gram[seen <= block]
                gram = mix(gram + salt[doc]).view(np.int64)
                keep = np.flatnonzero(n >= min_words)
                grams = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(who) + 1)), pa.int32()), pa.array(gram))
                column, held = at[occurrence_slots(w)], w.occurrences()[0]
                column, held = column[column >= 0].astype(np.uint8), held[column >= 0]
                ends = np.searchsorted(held, np.arange(len(who) + 1)).astype(np.int32)
                columns = pa.BinaryArray.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(column.tobytes())])
                level = pa.array(np.floor(np.log(np.maximum(n, 1)) / step).astype(np.int32))
                outline = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BUCKETS), len(who), [None, pa.py_buffer(outlines(w).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in who]), pa.array([x[1] for x in who]), pa.array(key), pa.array(n.astype(np.int32)), outline, grams, pa.array(large), level, columns, pa.array([x[2] for x in who], pa.int64())],
                    ["collection", "id", "key", "n", "outline", "grams", "large", "level", "columns", "exact"],
                ).take(pa.array(keep))

    schema = "collection string, id string, key long, n int, outline binary, grams array<long>, large boolean, level int, columns binary, exact long"
    rows = cut(docs.mapInArrow(features, schema))
    one = rows.drop("id", "exact").dropDuplicates(["key"])
    entries = one.select("key", "large", F.explode("grams").alias("gram"))
    # pairs of two documents with large columns are the dense product's
    entries = sketch_filter(entries, F.col("gram"), entries.where("not large"), F.col("gram"), 16 * n_docs).select("key", "gram")
    # the sketch never undercounts, so a window holds at most ``block`` documents
    column = entries.withColumn("size", F.count("*").over(Window.partitionBy("gram"))).where("size > 1")
    met = product(column.join(one.select("key", "n", "outline"), "key"), threshold, block)
    sparse = met.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common")).where(reachable(threshold)).select("a", "b")
    pairs = cut(sparse.unionByName(dense_product(one.where("large"), threshold, width)).distinct())
    counted = shared_words(pairs, rows.select("key", "exact"), docs.select("exact", "text"), n_docs)
    near = cut(counted.where(F.col("shared") >= threshold * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9).select("a", "b"))
    return near, rows.select("collection", "id", "key", "exact")


def reachable(threshold: float) -> Column:
    """Whether ``common`` columns shared among the rarest of two texts of ``na`` and ``nb`` words leave the threshold possible.

    Up to where the first of the two rarest parts ends, in the one order of words, all shared words are counted; from
    there on it can only be as many as that text has left.
    """
    left = lambda n: F.ceil(threshold * F.col(n) - 1e-9) - 1
    return F.col("common") + F.greatest(left("na"), left("nb")) >= F.ceil(threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9)


def few(mask: np.ndarray) -> np.ndarray:
    """The places where a mask holds, found eight at a time where it seldom does."""
    if np.count_nonzero(mask) * 64 > len(mask):
        return np.flatnonzero(mask)
    whole = len(mask) // 8 * 8
    at = (np.flatnonzero(mask[:whole].view(np.uint64) != 0)[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[mask[at]], np.flatnonzero(mask[whole:]) + whole])


def hash_text(text: str) -> int:
    import zlib

    return (zlib.crc32(text.encode()) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def product(column: DataFrame, threshold: float, block: int) -> DataFrame:
    """``a, b, na, nb, common``: pairs of keys with common columns that sizes and outlines leave, and how many columns a task saw.

    column: key, gram, size, n, outline. Larger columns than ``block`` are split into blocks, each pair of blocks a cell.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("int")
    own = F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int")
    placed = (
        column.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("gram", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "key", "n", "outline")
    )

    def multiply(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            cell = np.stack([held.column(k).to_numpy() for k in range(3)])
            change = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0))
            if not len(change):
                continue
            yield from within(held.slice(0, change[-1] + 1))
            held = held.slice(change[-1] + 1)
        if held is not None:
            yield from within(held)

    def within(batch):
        if batch.num_rows < 2:
            return
        gram, lo, hi, own, key, n = (batch.column(k).to_numpy() for k in range(6))
        outline = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, BUCKETS)
        n = n.astype(np.int64)
        out_a, out_b, live = [], [], np.arange(len(key))
        for d in range(1, len(key)):
            live = live[live + d < len(key)]
            live = live[(gram[live] == gram[live + d]) & (lo[live] == lo[live + d]) & (hi[live] == hi[live + d])]
            if not len(live):
                break
            i = live[(key[live] != key[live + d]) & ((lo[live] == hi[live]) | (own[live] != own[live + d]))]
            i = i[may_overlap(outline[i], n[i], outline[i + d], n[i + d], threshold)]
            x, y = np.where(key[i] < key[i + d], i, i + d), np.where(key[i] < key[i + d], i + d, i)
            out_a.append(x)
            out_b.append(y)
        if out_a:
            x, y = np.concatenate(out_a), np.concatenate(out_b)
            _, first, common = np.unique(np.stack([key[x], key[y]]), axis=1, return_index=True, return_counts=True)
            x, y = x[first], y[first]
            yield pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(key[y]), pa.array(n[x]), pa.array(n[y]), pa.array(common)], ["a", "b", "na", "nb", "common"])

    return placed.repartition("gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi").mapInArrow(multiply, "a long, b long, na long, nb long, common long")


def dense_product(docs: DataFrame, threshold: float, width: int = DENSE) -> DataFrame:
    """Pairs of keys within a collection that the bounds leave, of all pairs. docs: collection, key, n, outline, level, columns.

    columns: a byte below ``width`` for each of a text's words that has a column.

    Collections of more than a block are packed into blocks once, a row and a file each. Tasks then read the pairs of
    blocks from there, so that the shuffle and the folder hold every document once, whatever the number of blocks.
    """
    docs = docs.select("collection", "level", "key", "n", "outline", "columns")
    sizes = docs.groupBy("collection", "level").agg((F.count("*") / DENSE_ROWS).alias("by_rows"), (F.sum("n") / DENSE_WORDS).alias("by_words"))
    most = F.greatest(*(F.sum(c).over(Window.partitionBy("collection")) for c in ("by_rows", "by_words")))
    # a row for each level of a collection that fills a block at least, so few
    several = sizes.withColumn("most", most).where("most > 1").select("collection", "level", F.ceil(F.greatest("by_rows", "by_words")).cast("int").alias("blocks"))
    placed = docs.join(F.broadcast(several), ["collection", "level"], "left")
    place = F.shiftleft(F.col("level").cast("long"), 32) + F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks"))
    fields = ["keys", "sizes", "outlines", "ends", "columns"]
    share = threshold / (1 + threshold)

    def packed(cell: pa.Table) -> list[bytes]:
        cell = cell.sort_by("n")
        columns = cell.column("columns").to_pylist()
        ends = np.cumsum(np.fromiter(map(len, columns), np.int64, len(columns)))
        return [cell.column("key").to_numpy().tobytes(), cell.column("n").to_numpy().astype(np.int64).tobytes(), b"".join(cell.column("outline").to_pylist()), ends.tobytes(), b"".join(columns)]

    def pack(cell: pa.Table) -> pa.Table:
        first = [cell.column(c)[0].as_py() for c in ("collection", "level", "place")]
        return pa.table([pa.array([x]) for x in first[:1]] + [pa.array(first[1:2], pa.int32()), pa.array(first[2:], pa.int64())] + [pa.array([x], pa.binary()) for x in packed(cell)], ["collection", "level", "place", *fields])

    def unpacked(block: list):
        """Keys, sizes, outlines, words outside all columns, and both factors of the product."""
        key, n, outline, ends, columns = (np.frombuffer(x, kind) for x, kind in zip(block, (np.int64, np.int64, np.uint8, np.int64, np.uint8)))
        size = np.diff(ends, prepend=0)
        at = np.repeat(np.arange(len(key)), size) * width + columns
        # the product of two roots is at least the lesser count, and less than that of the counts
        m = np.sqrt(np.bincount(at, minlength=len(key) * width).reshape(-1, width).astype(np.float32))
        rest = n - size
        # two more columns, so that the product is a bound of the shared words, plus a's others, less the words needed
        left = np.column_stack([m, rest - share * n, np.ones(len(n))]).astype(np.float32)
        right = np.column_stack([m, np.ones(len(n)), -share * n]).astype(np.float32)
        return key, n, outline.reshape(-1, BUCKETS), rest, left, right

    def multiply(one: list, two: list | None) -> pa.RecordBatch:
        """Pairs of two blocks, each sorted by size, or within one."""
        key, n, outline, rest, left, right = unpacked(one)
        key_b, n_b, outline_b, rest_b, _, right = unpacked(two) if two else (key, n, outline, rest, left, right)
        slack = 1 + 1e-5 * float(max(n[-1], n_b[-1]))
        out, room = [], np.empty(TILE * TILE, np.float32)
        for k in range(0, len(key), TILE):
            for l in range(0 if two else k, len(key_b), TILE):
                a, b = slice(k, min(k + TILE, len(key))), slice(l, min(l + TILE, len(key_b)))
                # sorted by size, so whole tiles fall below the bound
                if n[a.stop - 1] < threshold * n_b[b.start] * (1 - 1e-9) or n_b[b.stop - 1] < threshold * n[a.start] * (1 - 1e-9):
                    continue
                product = room[: (a.stop - a.start) * (b.stop - b.start)]
                np.matmul(left[a], right[b].T, out=product.reshape(a.stop - a.start, -1))
                at = few(product >= -slack)
                x, y = np.divmod(at, b.stop - b.start)
                x, y = x + k, y + l
                # the same bound by the other words of b
                ok = product[at] + rest_b[y] - rest[x] >= -slack
                if not two:
                    ok &= x < y
                x, y = x[ok], y[ok]
                for at in range(0, len(x), 1 << 16):
                    i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                    ok = may_overlap(outline[i], n[i], outline_b[j], n_b[j], threshold)
                    i, j = key[i[ok]], key_b[j[ok]]
                    out.append(np.stack([np.minimum(i, j), np.maximum(i, j)]))
        a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def alone(cell: pa.Table) -> pa.Table:
        return pa.Table.from_batches([multiply(packed(cell), None)])

    def meet(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                lo, hi, *block = (batch.column(c)[k] for c in range(batch.num_columns))
                one, two = ([x.as_buffer() for x in part] for part in (block[: len(fields)], block[len(fields) :]))
                yield multiply(one, None if lo == hi else two)

    schema = "collection string, level int, place long, " + ", ".join(f"{c} binary" for c in fields)
    blocks = placed.where("blocks is not null").withColumn("place", place).groupBy("collection", "level", "place").applyInArrow(pack, schema)
    blocks = cut(blocks, 1)
    other = blocks.select(*[F.col(c).alias(f"{c}_b") for c in blocks.columns])
    near = (F.col("collection") == F.col("collection_b")) & (F.col("place") <= F.col("place_b")) & (F.col("level_b") - F.col("level") <= STEPS)
    # both sides are read from the folder for each pair of their splits; nothing is shuffled or broadcast
    pairs = blocks.join(other.hint("shuffle_replicate_nl"), near)
    pairs = pairs.select("place", "place_b", *fields, *[f"{c}_b" for c in fields]).mapInArrow(meet, "a long, b long")
    return pairs.unionByName(placed.where("blocks is null").groupBy("collection").applyInArrow(alone, "a long, b long"))


def expand(near: DataFrame, members: DataFrame, first: int = 32) -> DataFrame:
    """Pairs of classes as pairs of ids; see near_duplicates for the copies of a text beyond the first."""
    ends = near.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sizes = members.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("tail"))
    several = sizes.where("head != tail").select("key", F.lit(True).alias("several"))
    # few classes have copies or neighbours, so what follows is cut down to their members
    wanted = several.join(ends, "key", "full_outer")
    kept = cut(sketch_filter(members, F.col("key"), wanted, F.col("key")).join(wanted, "key").distinct())
    rank = F.row_number().over(Window.partitionBy("key", "exact").orderBy("id"))
    leading = cut(kept.withColumn("rank", rank).where(F.col("rank") <= first))
    a = leading.select(F.col("key").alias("a"), F.col("collection"), F.col("id").alias("x"))
    b = leading.select(F.col("key").alias("b"), F.col("id").alias("y"))
    across = near.join(a, "a").join(b, "b").where("x != y").select("collection", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    copies = leading.where("several")
    left = copies.select("collection", "key", F.col("id").alias("id_a"))
    right = copies.select("key", F.col("id").alias("id_b"))
    inside = left.join(right, "key").where("id_a < id_b").select("collection", "id_a", "id_b")
    text = ["key", "exact"]
    heads = leading.where(F.col("rank") == 1).select(*text, F.col("id").alias("head"))
    last = leading.where(F.col("rank") == first).select(*text, F.col("id").alias("last"))
    rest = kept.where("several").join(last, text).where("id > last").join(heads, text).select("collection", F.col("head").alias("id_a"), F.col("id").alias("id_b"))
    return across.unionByName(inside).unionByName(rest).distinct()


def link_counts(near: DataFrame, members: DataFrame) -> DataFrame:
    """``collection, id, links``: how many other records each is a near duplicate of, from the classes' sizes.

    An id with several texts is linked to what any of them is; a record that is near by several of its texts counts once.
    """
    held = F.count("*").over(Window.partitionBy("collection", "id"))
    ids = members.select("collection", "id", "key").distinct().withColumn("held", held)
    ids = cut(ids.withColumn("g", F.when(F.col("held") == 1, F.col("key")).otherwise(F.xxhash64("collection", "id", F.lit("several")))))
    keys = ids.select("key").distinct()
    close = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(keys.select(F.col("key").alias("a"), F.col("key").alias("b")))
    reach = ids.select("g", F.col("key").alias("a")).distinct().join(close, "a").select("g", F.col("b").alias("key")).distinct()
    total = reach.join(ids.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("g").agg(F.sum("n").alias("total"))
    twice = reach.join(ids.where("held > 1").select("collection", "id", "key"), "key").groupBy("g", "collection", "id").agg((F.count("*") - 1).alias("more"))
    twice = twice.groupBy("g").agg(F.sum("more").alias("more"))
    rows = ids.select("collection", "id", "g").distinct().join(total, "g").join(twice, "g", "left")
    return rows.select("collection", "id", (F.col("total") - F.coalesce("more", F.lit(0)) - 1).alias("links"))


def duplicate_groups(docs: DataFrame, pairs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``collection, id, group, links``: a row for each record of docs; records linked by pairs, also through others, share a group.

    docs: ``collection, id``; pairs: near_duplicates of them. ``group`` is a number, the same for a group's records;
    ``links`` counts a record's pairs, or is taken from ``links`` (``collection, id, links``), as pairs spare copies. Records without a pair are groups of their own; null ids are left out.
    """
    node = lambda i: F.xxhash64("collection", i)
    both = pairs.select(node("id_a").alias("u"), node("id_b").alias("v"))
    if links is None:
        links = both.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    else:
        links = links.select(node("id").alias("node"), "links")
    found = components(both).join(links, "node")
    rows = docs.where("id is not null and collection is not null").select("collection", "id").distinct().withColumn("node", node("id"))
    return rows.join(found, "node", "left").select("collection", "id", F.coalesce("component", "node").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
