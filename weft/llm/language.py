"""Language identification by interpolated Kneser-Ney character models.

One model per language, of character n-grams up to ``ORDER`` in lower case.
The highest order counts n-grams, the lower orders count distinct left
neighbours (continuation counts), each discounted absolutely and interpolated
with the next lower order, down to a uniform distribution.  A model is held in
arrays sorted by 64-bit n-gram hash; a text's language has the least
cross-entropy per character.

Training takes a bounded sample: of each language the texts of smallest hash,
``sample_docs`` in expectation, from the rows that the caller labels.  The
n-gram counts that reach the driver are bounded by that sample, and so is the
broadcast model.  A tenth of the sample calibrates rejection: the bound of a
language and length is a high quantile of the cross-entropies that its texts of
that length or longer have, plus a margin, so that texts like the labelled ones
stay and a few bad texts don't open it; ``false_rejection`` tells which share
of the calibration texts is rejected.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and rejected; ties go to the least language; without a labelled row everything
is ``und``; texts are scored whole, repeated rows alike; extra columns are
never read.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.textops import mix, modest_batches, tidy

ORDER = 4
#: Texts of each language that a model is fitted on, in expectation, and the
#: share of the sample that calibrates.
SAMPLE_DOCS = 1500
CALIBRATION = 0.1
#: Characters of texts joined for scoring at once.
CHUNK_CHARS = 1 << 17
#: Distinct n-grams outside all models whose scores a worker keeps.
CACHE = 1 << 19
UNDETERMINED = "und"
#: Rejection: quantile of the calibration texts, texts that a quantile needs, what the quantile is multiplied by,
#: bits a character added, and more of them for short texts, over the square root of the length.
QUANTILE, FEW, MARGIN, SLACK, SHORT = 0.99, 100, 1.15, 0.5, 8.0
#: Classes of length, by powers of two.
LENGTHS = 32
_LETTER = regex.compile(r"\p{L}")
_U = np.uint64
_START = 0x110000  # precedes each text


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; runs of white space are one space."""
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le"), np.uint32)


def _padded(codes: np.ndarray, order: int) -> np.ndarray:
    return np.concatenate([np.full(order - 1, _START, np.uint32), codes])


def _hashes(padded: np.ndarray, order: int, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each character after the padding.

    Code points take 21 bits: three fit a word, longer n-grams are folded.
    """
    m = len(padded) - (order - 1)
    h = np.zeros(m, _U)
    for k in range(n):
        part = padded[order - n + k : order - n + k + m].astype(_U)
        if k == 3:
            h = mix(h)
        h = (h << _U(21)) + part + _U(1)
    return mix(h + _U(n))


def _count(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(arrays) if arrays else np.zeros(0, _U), return_counts=True)


@dataclass
class Model:
    """Kneser-Ney model: for each order, sorted n-gram hashes with discounted
    probabilities, and sorted context hashes with back-off weights."""

    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float

    def score(self, keys: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Negative log2 probability; keys[n-1]: hashes of the n-grams, contexts[n-1] of their first n-1."""
        p = np.full(len(keys[0]), self.floor)
        for n in range(1, self.order + 1):
            weight = _lookup(*self.contexts[n - 1], contexts[n - 1], 1.0)
            p = _lookup(*self.grams[n - 1], keys[n - 1], 0.0) + weight * p
        return -np.log2(p)


def _lookup(table: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), default)
    k = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[k] == keys, values[k], default)


def fit(tables: list[dict[str, np.ndarray]], alphabet: int) -> Model:
    """tables[n-1]: distinct n-grams with their own hash, the hash of their
    context (first n-1), of their tail (last n-1), and count."""
    order = len(tables)
    grams, contexts = [], []
    for n in range(1, order + 1):
        t = tables[n - 1]
        if n == order:
            own, ctx, count = t["own"], t["context"], t["count"].astype(float)
        else:  # distinct left neighbours of each n-gram
            tails, left = np.unique(tables[n]["tail"], return_counts=True)
            k = np.minimum(np.searchsorted(tails, t["own"]), max(len(tails) - 1, 0))
            hit = tails[k] == t["own"] if len(tails) else np.zeros(len(t["own"]), bool)
            own, ctx, count = t["own"][hit], t["context"][hit], left[k[hit]].astype(float)
        ones, twos = float((count == 1).sum()), float((count == 2).sum())
        discount = min(0.95, ones / (ones + 2 * twos)) if ones else 0.5
        ctxs, inverse, kinds = np.unique(ctx, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, weights=count, minlength=len(ctxs))
        p = np.maximum(count - discount, 0) / total[inverse]
        order_ = np.argsort(own)
        grams.append((own[order_], p[order_]))
        contexts.append((ctxs, discount * kinds / total))
    return Model(order, grams, contexts, 1.0 / max(2, alphabet))


@dataclass
class Identifier:
    """The fitted models, with the scores of all their n-grams side by side."""

    languages: list[str]
    models: list[Model]
    table: np.ndarray  # sorted hashes of highest order
    scores: np.ndarray  # one row each, a column per language
    bounds: np.ndarray  # of cross-entropy, by language and log2 of length
    false_rejection: float = 0.0  # of the calibration texts

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character of each text in each language, lengths)."""
        order = self.models[0].order
        pads = [_padded(_codes(t), order) for t in texts]
        lengths = np.array([len(p) - order + 1 for p in pads])
        joined = np.concatenate(pads)
        # n-grams across texts are dropped: each text brings its own padding
        keep = np.ones(len(joined) - order + 1, bool)
        ends = np.cumsum([len(p) for p in pads])[:-1]
        for k in range(order - 1):
            keep[ends - order + 1 + k] = False
        h = _hashes(joined, order, order)[keep]
        owner = np.repeat(np.arange(len(texts)), lengths)
        by = np.argsort(h)
        s = h[by]
        new = np.append(True, s[1:] != s[:-1])
        kinds = s[new]
        rows = self._rows(kinds, joined, np.flatnonzero(keep)[by[new]])
        place = np.empty(len(h), np.int64)
        place[by] = np.cumsum(new) - 1
        total = np.stack([np.bincount(owner, weights=rows[place, k], minlength=len(texts)) for k in range(len(self.languages))], 1)
        return total / np.maximum(lengths, 1)[:, None], lengths

    def _rows(self, kinds: np.ndarray, joined: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of distinct n-grams; at: where each begins in joined."""
        k = np.minimum(np.searchsorted(self.table, kinds), len(self.table) - 1)
        out = self.scores[k].astype(float)
        miss = np.flatnonzero(self.table[k] != kinds)
        if len(miss):
            order = self.models[0].order
            grams = joined[at[miss][:, None] + np.arange(order)]
            fresh = _score_grams(grams, self.models)
            out[miss] = fresh
            if len(self.table) + len(miss) < CACHE:
                place = np.searchsorted(self.table, kinds[miss])
                self.table = np.insert(self.table, place, kinds[miss])
                self.scores = np.insert(self.scores, place, fresh, axis=0)
        return out

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        n = len(texts)
        lang, score, entropy, rejected = [UNDETERMINED] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        able = [i for i, t in enumerate(texts) if t is not None and self.languages and _LETTER.search(t)]
        i = 0
        while i < len(able):
            j, size = i, 0
            while j < len(able) and (j == i or size + len(texts[able[j]]) <= CHUNK_CHARS):
                size += len(texts[able[j]])
                j += 1
            h, lengths = self.entropies([texts[k] for k in able[i:j]])
            best = h.argmin(1)
            low = h[np.arange(len(h)), best]
            # posterior of the best under equal priors, from the whole text
            gap = (h - low[:, None]) * lengths[:, None]
            p = 1.0 / np.exp2(-np.minimum(gap, 60.0)).sum(1)
            bound = self.bounds[best, _length_class(lengths)]
            for r, k in enumerate(able[i:j]):
                lang[k] = self.languages[best[r]]
            score[able[i:j]], entropy[able[i:j]], rejected[able[i:j]] = p, low, low > bound
            i = j
        return lang, score, entropy, rejected


def _score_grams(grams: np.ndarray, models: list[Model]) -> np.ndarray:
    """Scores of n-grams given as rows of code points."""
    order = grams.shape[1]
    flat = np.zeros(len(grams), _U)

    def h(a: np.ndarray) -> np.ndarray:
        out = flat.copy()
        for k in range(a.shape[1]):
            if k == 3:
                out = mix(out)
            out = (out << _U(21)) + a[:, k].astype(_U) + _U(1)
        return mix(out + _U(a.shape[1]))

    keys = [h(grams[:, order - n :]) for n in range(1, order + 1)]
    contexts = [h(grams[:, order - n : order - 1]) for n in range(1, order + 1)]
    return np.stack([m.score(keys, contexts) for m in models], 1)


def _tables(texts: list[str], order: int) -> list[dict[str, np.ndarray]]:
    """Distinct n-grams of each order with hashes of their parts, and counts."""
    out = []
    for n in range(1, order + 1):
        own, ctx, tail = [], [], []
        for t in texts:
            padded = _padded(_codes(t), order)
            own.append(_hashes(padded, order, n))
            ctx.append(_context(padded, order, n))
            tail.append(_hashes(padded, order, n - 1) if n > 1 else np.zeros(len(own[-1]), _U))
        keys = np.concatenate(own) if own else np.zeros(0, _U)
        kinds, first, count = np.unique(keys, return_index=True, return_counts=True)
        out.append({"own": kinds, "context": np.concatenate(ctx)[first] if own else kinds, "tail": np.concatenate(tail)[first] if own else kinds, "count": count})
    return out


def _context(padded: np.ndarray, order: int, n: int) -> np.ndarray:
    """Hash of the first n-1 characters of each n-gram of _hashes(padded, order, n)."""
    m = len(padded) - (order - 1)
    h = np.zeros(m, _U)
    for k in range(n - 1):
        if k == 3:
            h = mix(h)
        h = (h << _U(21)) + padded[order - n + k : order - n + k + m].astype(_U) + _U(1)
    return mix(h + _U(n - 1))


def train(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_key: Column, sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> Identifier:
    """Fits a model per language of the labelled rows given.

    sample_key: a column that spreads the rows, such as an identifier; its hash
    picks the sample.  Texts are counted on the executors; what reaches the
    driver are counts of distinct n-grams of the sample.
    """
    spark = documents.sparkSession
    modest_batches(spark)
    rows = documents.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), (F.pmod(F.xxhash64(sample_key.cast("string")), F.lit(1 << 40)) / float(1 << 40)).alias("u")).where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row per language
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample_docs / n)).otherwise(share)
    sample = rows.withColumn("share", share).where("u < share").select("lang", "text", (F.col("u") < F.col("share") * CALIBRATION).alias("held"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "n", "own", "context", "tail", "count"]
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text, held in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not held:
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for n, t in enumerate(_tables(texts, order), 1):
                    if len(t["own"]):
                        whole = [pa.array(t[c].astype(np.uint64).view(np.int64), pa.int64()) for c in names[2:5]]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t["own"])), pa.array(np.full(len(t["own"]), n), pa.int32()), *whole, pa.array(t["count"], pa.int64())], names=names)

    counts = sample.mapInArrow(tidy(count), "lang string, n int, own long, context long, tail long, count long")
    counts = counts.groupBy("lang", "n", "own").agg(F.first("context").alias("context"), F.first("tail").alias("tail"), F.sum("count").alias("count")).toArrow()
    held = sample.where("held").select("text").toArrow()["text"].to_pylist()

    langs_col, n_col = np.array(counts["lang"].to_pylist(), object), counts["n"].to_numpy()
    cols = {c: counts[c].to_numpy() for c in ("own", "context", "tail", "count")}
    languages = sorted(set(langs_col.tolist()))
    alphabet = len(np.unique(cols["own"][n_col == 1])) + 1
    models, tops = [], []
    for lang in languages:
        tables = []
        for n in range(1, order + 1):
            at = np.flatnonzero((langs_col == lang) & (n_col == n))
            at = at[np.argsort(cols["own"][at].view(_U))]
            tables.append({c: (v[at].view(_U) if c != "count" else v[at]) for c, v in cols.items()})
        models.append(fit(tables, alphabet))
        tops.append(tables)
    if not models:
        return Identifier([], [], np.zeros(0, _U), np.zeros((0, 0), np.float32), np.zeros((0, LENGTHS)))
    found = Identifier(languages, models, np.zeros(1, _U), np.zeros((1, len(models)), np.float32), np.full((len(models), LENGTHS), np.inf))
    # The side-by-side table starts from the calibration texts and grows by what workers meet.
    texts = [t for t in held if _LETTER.search(t)]
    if texts:
        parts = [found.entropies(texts[k : k + 64]) for k in range(0, len(texts), 64)]
        h, lengths = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        found.bounds = rejection_bounds(h.min(1), lengths, h.argmin(1), len(languages))
        found.false_rejection = float((h.min(1) > found.bounds[h.argmin(1), _length_class(lengths)]).mean())
    return found


def _length_class(lengths: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(lengths, 1)).astype(int), LENGTHS - 1)


def rejection_bounds(entropy: np.ndarray, lengths: np.ndarray, language: np.ndarray, languages: int) -> np.ndarray:
    """(language, length class) greatest cross-entropy of a text that stays, from calibration texts.

    A class takes the quantile of its own texts, or of all that are as long or
    longer, or of the language, or of all languages: the first of these with
    ``FEW`` texts; and no less than a longer class takes.  Short texts vary
    more, by the square root of their length.
    """
    at = _length_class(lengths)
    out = np.empty((languages, LENGTHS))
    for k in range(languages):
        own = language == k
        for c in range(LENGTHS):
            some = next((m for m in (own & (at == c), own & (at >= c), own) if m.sum() >= FEW), np.ones(len(own), bool))
            out[k, c] = np.quantile(entropy[some], QUANTILE, method="lower")
    out = np.maximum.accumulate(out[:, ::-1], axis=1)[:, ::-1]
    return out * MARGIN + SLACK + SHORT / np.sqrt(2.0 ** np.arange(LENGTHS))


def identify(documents: DataFrame, model: Identifier, *, id_col: str = "doc_id", text_col: str = "text", text_in_id: bool = False) -> DataFrame:
    """One row per document: id, lang_pred, score, entropy (bits a character), rejected.

    text_in_id: the id is a struct and text_col one of its fields, so that a
    caller that carries whole rows as ids sends each text once.
    """
    spark = documents.sparkSession
    modest_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(0).field(text_col) if text_in_id else batch.column(1)
            lang, score, entropy, rejected = own.identify(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(entropy), pa.array(rejected)], names=["id", "lang_pred", "score", "entropy", "rejected"])

    docs = documents.select(F.col(id_col).alias("id")) if text_in_id else documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([docs.schema["id"]]).add("lang_pred", "string").add("score", "double").add("entropy", "double").add("rejected", "boolean")
    return docs.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
