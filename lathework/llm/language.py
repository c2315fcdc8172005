"""Languages of documents and of the stretches inside them, by a mixture over sentences.

A model of each language, words and letter n-grams, is fitted on a bounded sample of the labelled documents and cleaned
of wrong labels by fitting it again on the sentences it gives to each language. Of every document all sentences are
scored under every language; expectation-maximisation estimates the proportions of the languages, and a language stays
in the document's set only while the likelihood it adds exceeds a penalty that grows with the document's length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words

# Notations of language labels besides two-letter codes, with or without a region.
NOTATIONS = {
    "en": ["eng", "english", "englisch", "anglais", "inglés", "inglês", "engels"],
    "de": ["deu", "ger", "german", "deutsch", "allemand", "alemán", "alemão", "duits"],
    "fr": ["fra", "fre", "french", "français", "francais", "französisch", "francés", "francês", "frans"],
    "es": ["spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "espanhol", "spaans"],
    "pt": ["por", "portuguese", "português", "portugues", "portugiesisch", "portugais", "portugués", "portugees"],
    "nl": ["nld", "dut", "dutch", "nederlands", "niederländisch", "néerlandais", "neerlandés", "holandés", "neerlandês"],
    "it": ["ita", "italian", "italiano", "italienisch", "italien"],
    "pl": ["pol", "polish", "polski", "polnisch"],
    "sv": ["swe", "swedish", "svenska", "schwedisch"],
    "da": ["dan", "danish", "dansk", "dänisch"],
}
UNKNOWN = ["und", "mul", "zxx", "xx", "na", "no", "unknown", "none", "null"]
_BY_NAME = {n: c for c, ns in NOTATIONS.items() for n in ns}

_BREAK = re.compile(r"\s(?:(?<=[.!?…]\s)|(?<=[.!?…][\"'”’»)\]*_]\s))")
_QUOTED = re.compile(r"(?<=[\"'\]}])\s*,\s*(?=[\"'\[{])|[\]}]\s*")
_KEYS = re.compile(r"\"\w+\"\s*:|'\w+'\s*:|</?\w+[^<>]{0,200}>|https?://\S+|`{3}\w*|\"unit\":\s*\"\w+\"")
_ENDED = re.compile(r"[.!?…][\"'”’»)\]}*_,\s]*$")
_MARKS = "“”„‘’‚«»‹›–—…¿¡·•×÷°º§¶†\u00a0\u2009\u200b"
#: A word's likelihood: half from the words seen in training, half from its letters.
_SEEN = 0.5
ORDER = 4
TABLE = 1 << 18


def code(label: Column) -> Column:
    """The two-letter code a label names, in whatever notation; null if it names none."""
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    head = F.regexp_extract(plain, r"^([\p{L}]+)", 1)
    named = F.create_map(*[x for k, v in _BY_NAME.items() for x in (F.lit(k), F.lit(v))])
    two = (F.length(head) == 2) & ~head.isin(*UNKNOWN)
    return F.when(head.isin(*UNKNOWN), F.lit(None)).when(F.get(F.array(named[head]), F.lit(0)).isNotNull(), named[head]).when(two, head)


def sentences(text: str) -> list[str]:
    """A text's sentences, headings, list items and quoted values, without markup, keys and links."""
    if "{" in text or "<" in text or "://" in text or "`" in text:
        text = _QUOTED.sub("\n", _KEYS.sub(" ", text))
    return [s for line in text.split("\n") for s in _BREAK.split(line) if s and not s.isspace()]


def full(sentence: str) -> bool:
    return bool(_ENDED.search(sentence))


def _loose(text: str) -> str:
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    for c in _MARKS:
        if c in text:
            text = text.replace(c, " ")
    return text.lower()


class LooseWords(Words):
    """Words for scoring: as Words, but with bytes of any script taken as letters after a few marks are blanked."""

    def __init__(self, texts):
        super().__init__(texts, plain=lambda t: _loose(t).encode(errors="replace") if t else b"")


class Model:
    """Word and letter likelihoods of some languages, in tables of fixed size."""

    def __init__(self, languages: list[str], bags: list[Counter]):
        """bags: for each language, how often each word (bytes) occurs."""
        self.languages = languages
        k = len(languages)
        self.grams = np.zeros((TABLE, k), np.float32)
        self.contexts = np.zeros((TABLE, k), np.float32)
        # the tables hold the words of a bounded sample
        self.words: dict[bytes, np.ndarray] = {}
        totals = [max(1, sum(b.values())) for b in bags]
        for j, bag in enumerate(bags):
            for w, n in bag.items():
                self.words.setdefault(w, np.zeros(k))[j] = n / totals[j]
                g, c = _letters(w)
                np.add.at(self.grams[:, j], g, np.float32(n))
                np.add.at(self.contexts[:, j], c, np.float32(n))

    def score(self, word: bytes) -> np.ndarray:
        """log P(word) under each language."""
        g, c = _letters(word)
        by_letter = np.log((self.grams[g] + 0.02) / (self.contexts[c] + 0.02 * 40)).sum(axis=0)
        seen = self.words.get(word)
        if seen is None:
            return by_letter + np.log(1 - _SEEN)
        return np.logaddexp(by_letter + np.log(1 - _SEEN), np.log(seen * _SEEN + 1e-300))


def _letters(word: bytes) -> tuple[list[int], list[int]]:
    padded = b"\x01\x01\x01" + word + b"\x02"
    grams = [hash_bytes(padded[i : i + ORDER]) for i in range(len(padded) - ORDER + 1)]
    return grams, [hash_bytes(padded[i : i + ORDER - 1] + b"\x03\x04") for i in range(len(padded) - ORDER + 1)]


def hash_bytes(b: bytes) -> int:
    h = 2166136261
    for c in b:
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) & (TABLE - 1)


class Scorer:
    """Scores of words by their hash, kept between batches up to a bound."""

    LIMIT = 300_000

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((1024, len(model.languages)), np.float32)

    def __call__(self, w: Words) -> np.ndarray:
        """For each text of w, its words' log likelihood under each language, and for no words zeros."""
        unique, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.rows) + len(unique) > self.LIMIT:
            self.rows.clear()
        index = np.empty(len(unique), np.int64)
        for k, h in enumerate(unique.tolist()):
            row = self.rows.get(h)
            if row is None:
                row = self.rows[h] = len(self.rows)
                if row >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[row] = self.model.score(w.word(first[k]))
            index[k] = row
        each = self.table[index[back]]
        total = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0, dtype=np.float64)])
        return total[w.start[1:]] - total[w.start[:-1]]


def fit(rows: list[tuple[str, str]], rounds: int = 2) -> Model:
    """A model from (language, text) rows, refitted ``rounds`` times on the sentences it gives to each language."""
    languages = sorted({l for l, _ in rows})
    parts, labels = [], []
    for l, t in rows:
        for s in sentences(t):
            parts.append(s)
            labels.append(languages.index(l))
    w = LooseWords(parts)
    held = [[w.word(k) for k in range(w.start[i], w.start[i + 1])] for i in range(len(parts))]
    labels = np.array(labels)
    for k in range(rounds + 1):
        bags = [Counter() for _ in languages]
        for ws, j in zip(held, labels.tolist()):
            bags[j].update(ws)
        model = Model(languages, bags)
        if k < rounds:
            labels = np.where(w.sizes() >= 4, Scorer(model)(w).argmax(axis=1), labels)
    return model


def mixture(score: np.ndarray, doc: np.ndarray, n_docs: int, words: np.ndarray, penalty: float, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, shares, posterior): each document's languages and their shares by words, each sentence's posterior.

    score: sentence by language log likelihoods; doc: each sentence's document, sorted; words: each sentence's words.
    """
    k = score.shape[1]
    kept = np.ones((n_docs, k), bool)
    start = np.searchsorted(doc, np.arange(n_docs))
    some = np.diff(np.append(start, len(doc))) > 0

    def per_doc(x):
        total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
        ends = np.append(start, len(doc))
        return total[ends[1:]] - total[ends[:-1]]

    size = np.maximum(per_doc(words[:, None].astype(float)), 1)
    cost = penalty + 0.5 * np.log(size[:, 0])
    peak = score.max(axis=1, keepdims=True)
    share = kept / k
    while True:
        share = np.where(kept, np.maximum(share, 1e-3), 0)
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-12)
        for _ in range(rounds):
            weight = np.exp(score - peak) * share[doc] + 1e-290 * kept[doc]
            post = weight / weight.sum(axis=1, keepdims=True)
            share = per_doc(post * words[:, None]) / size
            share = np.where(kept, np.maximum(share, 1e-9), 0)
        weight = np.exp(score - peak) * share[doc] + 1e-290 * kept[doc]
        whole = weight.sum(axis=1, keepdims=True)
        without = np.maximum(whole - weight, 1e-290)
        gain = per_doc(np.log(whole) - np.log(without))
        gain = np.where(kept, gain, np.inf)
        least = gain.argmin(axis=1)
        drop = some & (kept.sum(axis=1) > 1) & (gain[np.arange(n_docs), least] < cost)
        if not drop.any():
            return kept, share, weight / whole
        kept[np.flatnonzero(drop), least[drop]] = False


def decide(score: np.ndarray, doc: np.ndarray, n_docs: int, words: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares, each sentence's language, its posterior) by mixture().

    Where all sentences of a document are likeliest under one language, that language alone has the greatest likelihood
    any proportions can reach, so only the others are estimated.
    """
    best = score.argmax(axis=1)
    first = np.full(n_docs, -1)
    first[doc[::-1]] = best[::-1]
    several = np.zeros(n_docs, bool)
    several[doc[best != first[doc]]] = True
    share = np.zeros((n_docs, score.shape[1]))
    share[np.flatnonzero(first >= 0), first[first >= 0]] = 1.0
    top = score.max(axis=1)
    sure = 1 / np.exp(score - top[:, None]).sum(axis=1)
    if several.any():
        m = np.flatnonzero(several[doc])
        renumbered = np.cumsum(several)[doc[m]] - 1
        _, some, post = mixture(score[m], renumbered, int(several.sum()), words[m], penalty)
        share[several] = some
        best[m] = post.argmax(axis=1)
        sure[m] = post[np.arange(len(m)), best[m]]
    return share, best, sure


def _sample(docs: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each language, those with the smallest hashes of id.

    Every label that names a language takes part, however rare; there are no more than two-letter codes.
    """
    labelled = docs.where("text is not null and code is not null and id is not null").select("code", "id", "text")
    counts = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    # twice the expected share, so that the bound is reached; the driver keeps the smallest
    bound = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(int((1 << 30) * min(1.0, 2 * per_language / n))))])
    rows = labelled.where(h <= bound[F.col("code")]).select("code", h.alias("h"), "text")
    chosen: dict[str, list] = {}
    for r in rows.toLocalIterator():
        held = chosen.setdefault(r["code"], [])
        held.append((r["h"], r["text"]))
        if len(held) > 4 * per_language:
            held.sort()
            del held[per_language:]
    return [(c, t) for c, held in sorted(chosen.items()) for _, t in sorted(held)[:per_language]]


def identify(docs: DataFrame, per_language: int = 300, penalty: float = 7.0, temper: float = 0.8, least_words: int = 4) -> DataFrame:
    """Every text's languages and stretches.

    docs: ``id, text, code`` (code null or wrong as it may be); other columns are ignored, repeated rows stay. Result:
    ``id, code, languages array<struct<language, share, confidence, sentences>>, segments array<struct<begin, sentences,
    language, confidence>>``: share by words; confidence the mean posterior of the sentences given to the language;
    sentences those that end as such and have ``least_words`` words (where a text has none at all, its longest piece
    counts as one). A segment is a run of pieces of one language, begin the number of its first piece. Null and wordless
    texts have empty arrays. Without a single labelled row nothing can be learnt, and all arrays are empty.
    """
    spark = docs.sparkSession
    docs = docs.select("id", "text", "code")
    rows = _sample(docs, per_language)
    shared = spark.sparkContext.broadcast(fit(rows) if rows else None)
    schema = "id long, code string, languages array<struct<language string, share double, confidence double, sentences int>>, segments array<struct<begin int, sentences int, language string, confidence double>>"

    def run(batches):
        model = shared.value
        scorer = Scorer(model) if model else None
        for batch in batches:
            ids, texts, codes = (batch.column(k).to_pylist() for k in range(3))
            langs, segs = [[] for _ in ids], [[] for _ in ids]
            if scorer:
                for lo in range(0, len(ids), 2000):
                    _documents(scorer, texts[lo : lo + 2000], langs, segs, lo, penalty, temper, least_words)
            lt = pa.list_(pa.struct([("language", pa.string()), ("share", pa.float64()), ("confidence", pa.float64()), ("sentences", pa.int32())]))
            st = pa.list_(pa.struct([("begin", pa.int32()), ("sentences", pa.int32()), ("language", pa.string()), ("confidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.string()), pa.array(langs, lt), pa.array(segs, st)], ["id", "code", "languages", "segments"])

    return docs.mapInArrow(run, schema)


def _documents(scorer: Scorer, texts: list, langs: list, segs: list, at: int, penalty: float, temper: float, least_words: int) -> None:
    pieces, doc = [], []
    for k, t in enumerate(texts):
        own = sentences(t) if t else []
        pieces += own
        doc += [k] * len(own)
    if not pieces:
        return
    w = LooseWords(pieces)
    n = w.sizes()
    keep = np.flatnonzero(n > 0)
    if not len(keep):
        return
    doc = np.array(doc)[keep]
    score = scorer(w)[keep] * temper
    n = n[keep]
    ended = np.fromiter((full(pieces[i]) for i in keep.tolist()), bool, len(keep)) & (n >= least_words)
    share, pick, sure = decide(score, doc, len(texts), n, penalty)
    names = scorer.model.languages
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        a, b = bounds[k], bounds[k + 1]
        if a == b:
            continue
        e = ended[a:b]
        if not e.any():
            e = np.zeros(b - a, bool)
            e[n[a:b].argmax()] = True
        own, conf = pick[a:b], sure[a:b]
        for l in np.unique(own).tolist():
            m = own == l
            langs[at + k].append({"language": names[l], "share": float(share[k, l]), "confidence": float(conf[m].mean()), "sentences": int((m & e).sum())})
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for i, j in zip(edge.tolist(), [*edge[1:].tolist(), b - a]):
            segs[at + k].append({"begin": i, "sentences": j - i, "language": names[int(own[i])], "confidence": float(conf[i:j].mean())})
