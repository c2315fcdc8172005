"""Retrieval: exact and lexical neighbours, metadata overlap, vector neighbours, and the merge of their signals."""

from __future__ import annotations

import difflib
from bisect import insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import normalize


def top_k(scored: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group, equal scores by ``tie``; ``rank`` from 1. Ranks are cut before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_matches(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``qid, id`` of equal normalised texts. queries: qid, text; corpus: id, text; blank texts match nothing."""
    key = lambda df: df.withColumn("key", normalize(F.col("text"))).where("key != ''")
    return key(queries).select("qid", "key").join(key(corpus).select("id", "key"), "key").select("qid", "id").distinct()


#: Queries and corpus rows that meet in one task at most.
QUERY_BLOCK, CORPUS_BLOCK = 512, 20_000


def in_blocks(queries: DataFrame, corpus: DataFrame, kernel, schema: str, block: int = QUERY_BLOCK, rows: int | None = None) -> DataFrame:
    """The rows of kernel(queries, corpus) (pandas frames) of every pair of a block of queries and a block of corpus rows.

    queries has ``qid``, corpus ``id``. A stated query set meets all rows: the corpus is copied once for each ``block``
    queries, the queries once for each block of the corpus, and each pair of blocks is a task of bounded size. ``rows``:
    for kernels whose time counts more than their bytes, a smaller corpus block; its pairs of blocks aren't put together.
    """
    n, m = queries.count(), corpus.count()
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    qs, cs = max(1, -(-n // block)), max(1, -(-m // min(CORPUS_BLOCK, rows or CORPUS_BLOCK)), min(cores, m // 500))
    q = queries.withColumns({"__q": F.pmod(F.xxhash64("qid"), F.lit(qs)).cast("int"), "__c": F.explode(F.sequence(F.lit(0), F.lit(cs - 1)))})
    # other names than the queries', as both sides may come from one table
    c = corpus.select(*[F.col(x).alias(f"{x}_of_row") for x in corpus.columns], F.pmod(F.xxhash64("id"), F.lit(cs)).cast("int").alias("__c")).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(qs - 1))))
    columns = [x.split()[0] for x in schema.split(", ")]
    if rows:
        q, c = (df.repartition(3 * qs * cs, "__q", "__c") for df in (q, c))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({k: [] for k in columns}).cast(_arrow(schema))
        rows = right.to_pandas().rename(columns=lambda x: x.removesuffix("_of_row"))
        return pa.Table.from_pandas(kernel(left.to_pandas(), rows)[columns], schema=_arrow(schema), preserve_index=False)

    return q.groupBy("__q", "__c").cogroup(c.groupBy("__q", "__c")).applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _kind(df: DataFrame, column: str) -> str:
    return {"bigint": "long"}.get(df.schema[column].dataType.simpleString(), df.schema[column].dataType.simpleString())


def shared_counts(left, right) -> np.ndarray:
    """How many elements any two of two series of arrays of distinct numbers share, counted over the elements queries have."""
    size = np.fromiter(map(len, left), np.int64, len(left))
    flat = np.concatenate(list(left)) if size.sum() else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(flat, kind="stable")
    words, first = np.unique(flat[order], return_index=True)
    owner, ends = owner[order], np.append(first, len(flat))
    other = np.fromiter(map(len, right), np.int64, len(right))
    tokens = np.concatenate(list(right)) if other.sum() else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(other)), other)
    out = np.zeros(len(size) * len(other), np.int32)
    if len(words) and len(tokens):
        at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
        hit = words[at] == tokens
        at, doc = at[hit], doc[hit]
        many = ends[at + 1] - ends[at]
        # the queries that hold each token, in runs of bounded size
        for lo in range(0, len(at), 1 << 16):
            a, d, k = at[lo : lo + (1 << 16)], doc[lo : lo + (1 << 16)], many[lo : lo + (1 << 16)]
            inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            pair = owner[np.repeat(ends[a], k) + inner] * len(other) + np.repeat(d, k)
            if len(pair) * 4 > len(out):
                out += np.bincount(pair, minlength=len(out)).astype(np.int32)
            else:
                np.add.at(out, pair, 1)
    return out.reshape(len(size), len(other))


def _best(score: np.ndarray, allowed: np.ndarray, k: int):
    """Places of each row's k best allowed scores, with all that equal the k-th, so that ties fall by id later."""
    score = np.where(allowed, score, -np.inf)
    keep = min(k, score.shape[1])
    bar = -np.partition(-score, keep - 1, axis=1)[:, keep - 1 : keep]
    return np.nonzero(allowed & (score >= bar))


def _none(q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    return np.ones((len(q), len(c)), bool)


def earlier(q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    """Rows before the query in the order of ids."""
    return c["id"].to_numpy()[None] < q["qid"].to_numpy()[:, None]


def others(q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    """All rows but the query itself."""
    return c["id"].to_numpy()[None] != q["qid"].to_numpy()[:, None]


def authored_before(q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    """Rows of an index (``at``) below the query's; null is before nothing."""
    return c["at"].to_numpy(float)[None] < q["at"].to_numpy(float)[:, None]


def same_group(q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    """Other rows of the query's ``group``; null is no group."""
    a, b = q["group"].to_numpy(object), c["group"].to_numpy(object)
    known = np.array([x is not None for x in a])
    return others(q, c) & known[:, None] & (a[:, None] == b[None])


def jaccard_neighbours(queries: DataFrame, corpus: DataFrame, tokens: Column, k: int, digits: int = 6, eligible=_none) -> DataFrame:
    """``qid, id, shared, score, rank``: the k eligible corpus rows with the greatest token overlap of each query, among those that share a token.

    queries: qid, text; corpus: id, text; further columns are for ``eligible`` to decide by, which says of a block of
    queries and one of rows which may meet. Tokens are counted in blocks as hashes, so a token that every row has costs
    no more than others, and only each block's best are shuffled.
    """
    hashed = F.coalesce(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))), F.array().cast("array<bigint>"))
    q, c = (df.where("text is not null").withColumn("t", hashed).drop("text") for df in (queries, corpus))

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shared = shared_counts(left["t"], right["t"])
        a, b = left["t"].map(len).to_numpy(), right["t"].map(len).to_numpy()
        score = np.round(shared / np.maximum(a[:, None] + b[None] - shared, 1), digits)
        i, j = _best(score, (shared > 0) & eligible(left, right), k)
        return pd.DataFrame({"qid": left["qid"].to_numpy()[i], "id": right["id"].to_numpy()[j], "shared": shared[i, j].astype(np.int64), "score": score[i, j]})

    found = in_blocks(q, c, kernel, f"qid {_kind(queries, 'qid')}, id {_kind(corpus, 'id')}, shared long, score double")
    return top_k(found.withColumn("score", F.round("score", digits)), ["qid"], "score", "id", k)


def metadata_neighbours(queries: DataFrame, corpus: DataFrame, fields: list[str], k: int) -> DataFrame:
    """``qid, id, score, rank``: in how many of the fields two rows have a value in common; each field holds an array of values.

    Blank and null values are none; rows without a common value aren't neighbours. In blocks, so that a value most rows
    have pairs nothing.
    """

    def hashed(df: DataFrame, key: str) -> DataFrame:
        clean = lambda f: F.array_compact(F.transform(F.coalesce(f, F.array().cast("array<string>")), lambda v: F.when(normalize(v) != "", F.xxhash64(normalize(v)))))
        return df.select(key, *[F.array_distinct(clean(F.col(f))).alias(f) for f in fields]).distinct()

    def bounded(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # several rows of one id count as one, by any of them
        masks = [shared_counts(left[f], right[f]) > 0 for f in fields]
        qids, qi = np.unique(left["qid"].to_numpy().astype(str), return_inverse=True)
        ids, ii = np.unique(right["id"].to_numpy().astype(str), return_inverse=True)
        score = np.zeros((len(qids), len(ids)), np.int64)
        for m in masks:
            by_query = np.zeros((len(qids), m.shape[1]), bool)
            np.logical_or.at(by_query, qi, m)
            both = np.zeros((len(ids), len(qids)), bool)
            np.logical_or.at(both, ii, by_query.T)
            score += both.T
        i, j = _best(score.astype(float), score > 0, k)
        return pd.DataFrame({"qid": qids[i], "id": ids[j], "score": score[i, j]})

    found = in_blocks(hashed(queries, "qid"), hashed(corpus, "id"), bounded, "qid string, id string, score long")
    return top_k(found, ["qid"], "score", "id", k)


def vector_neighbours(queries: DataFrame, corpus: DataFrame, k: int, block: int = QUERY_BLOCK, digits: int = 6) -> DataFrame:
    """``qid, id, score, rank``: the k rows with the greatest cosine for every query vector, itself left out.

    queries: qid, vector; corpus: id, vector. Blocks of both meet as one matrix product, whose best alone are shuffled.
    Vectors without length are left out.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = np.stack(left["vector"]).astype(np.float64), np.stack(right["vector"]).astype(np.float64)
        n, m = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        some = (n > 0)[:, None] & (m > 0)[None]
        score = np.round((a / np.maximum(n, 1e-300)[:, None]) @ (b / np.maximum(m, 1e-300)[:, None]).T, digits)
        i, j = _best(score, some & others(left, right), k)
        return pd.DataFrame({"qid": left["qid"].to_numpy()[i], "id": right["id"].to_numpy()[j], "score": score[i, j]})

    q, c = queries.select("qid", "vector").where("vector is not null"), corpus.select("id", "vector").where("vector is not null")
    return top_k(in_blocks(q, c, kernel, "qid long, id long, score double", block), ["qid"], "score", "id", k)


#: Characters of the rows whose ratios are computed together, about, and tokens whose places among them are held.
LEXICAL_BITS, LEXICAL_HELD = 1 << 18, 1024
#: Rows that meet a block of queries in one task.
LEXICAL_BLOCK = 4000


def lexical_neighbours(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6, eligible=_none) -> DataFrame:
    """``qid, id, score, rank``: the k eligible rows with the greatest token_ratio (0 to 100) of each query, of those above 0.

    queries: qid, text; corpus: id, text, in normal form; further columns are for ``eligible``. In each pair of blocks all
    ratios are computed, a query's with many rows at once: their characters are the bits of one long number.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        may = eligible(left, right)
        asked = [sorted(t.split()) for t in left["text"]]
        letters, known = {" "}.union(*map(" ".join, asked)), set().union(*asked)
        texts = [sorted(t.split()) for t in right["text"]]
        sizes = np.fromiter((sum(map(len, t)) + len(t) for t in texts), np.int64, len(texts))
        # rows of like lengths meet, so that little of their common width is empty
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        best, found = [[] for _ in asked], [[] for _ in asked]
        while len(order):
            many = max(1, LEXICAL_BITS // int(sizes[order[0]]))
            at, order = order[:many], order[many:]
            rows = _Rows([texts[j] for j in at], letters, known)
            for i, own in enumerate(asked):
                allowed = np.flatnonzero(may[i][at])
                if not own or not len(allowed):
                    continue
                score = rows.ratios(own)[allowed]
                top = np.append(best[i], score)
                bar = np.partition(top, len(top) - k)[len(top) - k] - 1e-5 if len(top) > k else 0.0
                for j in np.flatnonzero((score > 0) & (score >= bar)).tolist():
                    if (r := round(float(score[j]), digits)) > 0:
                        found[i].append((at[allowed[j]], r))
                        insort(best[i], r, key=lambda x: -x)
                del best[i][k:]
        qids, ids = left["qid"].to_numpy(), right["id"].to_numpy()
        out = [(qids[i], ids[j], r) for i, rows in enumerate(found) for j, r in rows if len(best[i]) < k or r >= best[i][-1]]
        return pd.DataFrame(out, columns=["qid", "id", "score"])

    clean = lambda df: df.where("text is not null")
    found = in_blocks(clean(queries), clean(corpus), kernel, f"qid {_kind(queries, 'qid')}, id {_kind(corpus, 'id')}, score double", rows=LEXICAL_BLOCK)
    return top_k(found, ["qid"], "score", "id", k)


class _Rows:
    """Rows of sorted tokens, a blank after each, as the bits of long numbers: one field for each row, whose top bit takes carries.

    letters, known: the characters and the tokens that queries have; only their places are needed.
    """

    def __init__(self, tokens: list[list[str]], letters: set[str], known: set[str]):
        joined = [" ".join(t) + " " for t in tokens]
        self.size = np.fromiter(map(len, joined), np.int64, len(joined))
        self.width = (int(self.size.max()) + 8) // 8 * 8
        self.places: dict[str, list[int]] = {}
        again, self.distinct = [], np.zeros(len(tokens), np.int64)
        for row, own in enumerate(tokens):
            at, last = row * self.width, None
            for t in own:
                if t == last:
                    again.append(np.arange(at, at + len(t) + 1))
                else:
                    self.distinct[row] += len(t) + 1
                if t in known:
                    self.places.setdefault(t, []).append(at)
                at, last = at + len(t) + 1, t
        whole = np.ones((len(joined), self.width), bool)
        whole[:, -1] = False
        self.full = self.number(whole)
        #: without further places of a row's token
        self.once = self.full ^ self.number(np.concatenate(again)) if again else self.full
        code = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(self.size) - self.size
        flat = np.arange(len(code)) + np.repeat(np.arange(len(joined)) * self.width - begin, self.size)
        self.bits = {c: self.number(flat[code == ord(c)]) for c in letters}
        self.held: dict[str, tuple[np.ndarray, int, int]] = {}

    def number(self, at: np.ndarray) -> int:
        """A number with the bits at these places, or where the mask is true."""
        if at.dtype != bool:
            mask = np.zeros(len(self.size) * self.width, bool)
            mask[at] = True
            at = mask
        return int.from_bytes(np.packbits(at, bitorder="little").tobytes(), "little")

    def token(self, t: str) -> tuple[np.ndarray, int, int] | None:
        """The rows that have a token, its places, and all places of the rows that don't have it."""
        if t not in self.places:
            return None
        if t not in self.held:
            if len(self.held) >= LEXICAL_HELD:
                self.held.clear()
            at = self.places[t]
            rows = np.unique(np.array(at) // self.width)
            span, field = (1 << len(t) + 1) - 1, (1 << self.width - 1) - 1
            if len(at) <= 4:
                places, having = 0, 0
                for x in at:
                    places |= span << x
                    having |= field << x // self.width * self.width
            else:
                places = self.number((np.array(at)[:, None] + np.arange(len(t) + 1)).ravel())
                mask = np.zeros((len(self.size), self.width), bool)
                mask[rows, :-1] = True
                having = self.number(mask)
            self.held[t] = rows, places, self.full ^ having
        return self.held[t]

    def common(self, steps) -> np.ndarray:
        """Lengths of the longest common subsequences of all rows and a text; steps: for each of its characters, the places that equal it."""
        full = s = self.full
        for m in steps:
            u = s & m
            s = ((s + u) | (s ^ u)) & full
        data = np.frombuffer(s.to_bytes(len(self.size) * self.width // 8, "little"), np.uint8).reshape(len(self.size), -1)
        return self.width - 1 - np.bitwise_count(data).sum(axis=1, dtype=np.int64)

    def ratios(self, own: list[str]) -> np.ndarray:
        """token_ratio of sorted tokens and each row."""
        mine = sorted(set(own))
        distinct = sum(map(len, mine)) + len(mine)
        shared, gone, others = np.zeros(len(self.size), np.int64), 0, {}
        for t in mine:
            if (held := self.token(t)) is not None:
                rows, places, others[t] = held
                shared[rows] += len(t) + 1
                gone |= places
        rest = self.once & (self.full ^ gone)

        def unshared():
            for t in mine:
                if at := rest & others[t] if t in others else rest:
                    for c in t + " ":
                        yield self.bits[c] & at

        # both end with a blank, which counts once more than in the strings
        text = " ".join(own)
        plain = 200.0 * (self.common(self.bits[c] for c in text + " ") - 1) / (len(text) + self.size - 1)
        either = 200.0 * (shared + self.common(unshared()) - 1) / (distinct + self.distinct - 2)
        both, less = shared - 1, np.minimum(distinct, self.distinct)
        alone = np.where(shared > 0, 200.0 * both / np.maximum(both + less - 1, 1), 0.0)
        return np.where((shared > 0) & (shared == less), 100.0, np.maximum(np.maximum(plain, either), alone))


def recall_at(found: DataFrame, expected: DataFrame) -> DataFrame:
    """``queries, hits, recall``: of the expected rows (qid, id) how many are among the found ones; null without any."""
    hit = expected.join(found.select("qid", "id", F.lit(1).alias("hit")).distinct(), ["qid", "id"], "left")
    return hit.agg(F.count("*").alias("queries"), F.count("hit").alias("hits"), F.round(F.try_divide(F.count("hit"), F.count("*")), 6).alias("recall"))


def merge_signals(signals: dict[str, DataFrame]) -> DataFrame:
    """``qid, id, signals`` with all rows of all signals (each with qid, id) and, sorted, the names of those that found them."""
    rows = None
    for name, df in signals.items():
        named = df.select("qid", "id", F.lit(name).alias("signal"))
        rows = named if rows is None else rows.unionByName(named)
    return rows.groupBy("qid", "id").agg(F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))


def decide(*conditions: Column) -> Column:
    """Three-valued: uncertain where any condition is unknown, reject where all hold, else allow."""
    unknown, every = F.lit(False), F.lit(True)
    for c in conditions:
        unknown, every = unknown | c.isNull(), every & c
    return F.when(unknown, "uncertain").when(every, "reject").otherwise("allow")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, carry: str) -> DataFrame:
    """left with ``last``, the ``carry`` value of the latest right row of the same key at or before ``at``, and ``earlier``, how many there are.

    Both sides are put in one order and read once, whatever their sizes. Rows without key or time have nothing earlier;
    of right rows at one time the greatest value is the latest. A key's rows pass through one task in order, never gathered
    in memory; a key with a third of all rows costs one task a third of the sort.
    """
    columns = left.columns
    a = left.select(F.struct(*columns).alias("row"), F.col(key).alias("k"), F.col(at).alias("t"), F.lit(None).alias("v"), F.lit(1).alias("side"))
    b = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.lit(None).alias("row"), F.col(key).alias("k"), F.col(at).alias("t"), F.col(carry).alias("v"), F.lit(0).alias("side"))
    w = Window.partitionBy("k").orderBy("t", "side", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lone = a.where("k is null or t is null").select("row.*", F.lit(None).cast(right.schema[carry].dataType).alias("last"), F.lit(0).cast("long").alias("earlier"))
    met = a.where("k is not null and t is not null").unionByName(b)
    met = met.withColumns({"last": F.last("v", ignorenulls=True).over(w), "earlier": F.sum(1 - F.col("side")).over(w)})
    return met.where("side = 1").select("row.*", "last", F.col("earlier").cast("long").alias("earlier")).unionByName(lone)


def _indel_similarity(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, in per cent; 100 for two empty strings."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    return 200.0 * _common(a, b) / (len(a) + len(b))


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def token_ratio(a: str, b: str) -> float:
    """The greater of the similarities of the sorted tokens and of the shared tokens with either rest, 0 to 100.

    Where one side's distinct tokens are all shared and there is a shared token, 100; without tokens on a side, 0.
    """
    x, y = sorted(a.split()), sorted(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(set(x) & set(y)))
    only_x, only_y = " ".join(sorted(set(x) - set(y))), " ".join(sorted(set(y) - set(x)))
    best = _indel_similarity(" ".join(x), " ".join(y))
    if both and (not only_x or not only_y):
        return 100.0
    one, two = (both + " " + only_x).strip(), (both + " " + only_y).strip()
    best = max(best, _indel_similarity(one, two))
    if both:
        best = max(best, _indel_similarity(both, one), _indel_similarity(both, two))
    return best


@F.pandas_udf(DoubleType())
def token_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks of the sorted distinct tokens, over both lengths."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, sorted(set(x.split())), sorted(set(y.split()))).ratio() for x, y in zip(a, b)], dtype="float64")
