"""Languages of a document as a mixture, by expectation-maximisation over words with n-gram likelihoods.

A word's likelihood in a language is the product of its byte trigrams' probabilities, edges included. A document
is a mixture of languages over its words. Its language set is the one of the nested sets (strongest language,
two strongest, ...) with the best likelihood less ``penalty`` for each language beyond the first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MUL = np.uint32(2654435761)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words; the place of each word's first; each text's first word, with the end.

    Letters are lower-cased; everything but letters (ASCII) and other scripts' bytes separates words.
    """
    raw = [(t or "").lower().encode("utf-8", "replace").translate(_FOLD) for t in texts]
    b = np.frombuffer(b" " + b" ".join(raw) + b"  ", np.uint8)
    letter = b != 32
    at = np.flatnonzero(letter[1:-1]) + 1
    x = b.astype(np.uint32)
    bucket = (((x[at - 1] << 16) | (x[at] << 8) | x[at + 1]) * _MUL) >> np.uint32(16)
    begin = ~letter[at - 1]
    first = np.flatnonzero(begin)
    ends = np.cumsum([0] + [len(r) + 1 for r in raw]) + 1
    return bucket.astype(np.int64), first, np.searchsorted(at[first], ends)


class Mixture:
    def __init__(self, languages: list[str], logp: np.ndarray, steps: int = 8, penalty: float = 8.0):
        self.languages, self.logp, self.steps, self.penalty = languages, logp.astype(np.float32), steps, penalty

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its share and the number of languages for each text."""
        n, k = len(texts), len(self.languages)
        bucket, first, at = grams(texts)
        counts = np.diff(at)
        lit = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool) & (counts > 0)
        pred, score, size = ["und"] * n, np.zeros(n), np.zeros(n, np.int64)
        if not k or not lit.any():
            return pred, score, size
        ll = np.stack([np.add.reduceat(self.logp[i][bucket], first) for i in range(k)])
        top = ll.max(axis=0)
        like = np.exp(np.maximum(ll - top, -60))
        rows = np.flatnonzero(counts)
        starts, c = at[:-1][rows], counts[rows].astype(np.float32)
        of = np.repeat(np.arange(len(rows)), counts[rows])
        share = self._steps(np.full((k, len(rows)), 1 / k, np.float32), like, of, starts, c)
        order = np.argsort(-share, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(k)[:, None], axis=0)
        best, kept, number = np.full(len(rows), -np.inf), share, np.ones(len(rows), np.int64)
        for s in range(1, k + 1):
            some = np.where(rank < s, np.maximum(share, 1e-6), 0)
            some = (some / some.sum(axis=0)).astype(np.float32)
            if s > 1:
                some = self._steps(some, like, of, starts, c, 3)
            value = np.add.reduceat(np.log((some[:, of] * like).sum(axis=0) + 1e-30, dtype=np.float64), starts) - self.penalty * (s - 1)
            better = value > best
            kept, best, number = np.where(better, some, kept), np.where(better, value, best), np.where(better, s, number)
        winner = kept.argmax(axis=0)
        for j, r in enumerate(rows.tolist()):
            if lit[r]:
                pred[r], score[r], size[r] = self.languages[winner[j]], min(1.0, float(kept[winner[j], j])), number[j]
        return pred, score, size

    def _steps(self, share, like, of, starts, c, steps=None):
        for _ in range(steps or self.steps):
            r = share[:, of] * like
            r /= r.sum(axis=0) + np.float32(1e-30)
            share = np.add.reduceat(r, starts, axis=1) / c
        return share


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most_docs: int = 3000, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of trigram buckets.

    Fitted on about ``most_docs`` documents of each language, chosen by a hash of the id, or all where there are
    fewer: that bound is what keeps the model's cost fixed. Their texts are read whole. The driver gets the
    summed counts: languages times ``BUCKETS`` numbers.
    """
    common.ship(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}
    if not sizes:
        return [], np.zeros((0, BUCKETS))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, most_docs / n))).otherwise(share)
    some = rows.where(F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1_000_000)) < share * 1_000_000)
    languages = sorted(sizes)
    index = {x: i for i, x in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
                for lang in set(langs):
                    total[index[lang]] += np.bincount(grams([t for t, x in zip(texts, langs) if x == lang])[0], minlength=BUCKETS)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], names=["l", "b", "n"])

    counted = some.select(text_col, lang_col).mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    total = np.full((len(languages), BUCKETS), smooth)
    total[counted["l"], counted["b"]] += counted["n"]
    return languages, np.log(total / total.sum(axis=1, keepdims=True))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_languages for each row.

    Learns from rows that are not held out by a checksum of the id and have text and language; language, source and id
    play no part in a prediction. A text that is null or has no letter is ``und`` with score 0, as is every
    text when nothing was learned. Rows with a null id count as not held out, but as they have no checksum they are
    not learned from. Repeated rows get equal results; other columns are not read. Of languages that fit equally well the first in
    order counts. An empty table gives no rows. A text of any length is read whole; memory grows with its distinct words times the languages.
    """
    spark = docs.sparkSession
    languages, logp = fit(docs.where(F.crc32(F.col(id_col).cast("string")) % 4 != 2), text_col, lang_col, id_col)
    model = spark.sparkContext.broadcast(Mixture(languages, logp))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                pred, score, size = model.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(size)], names=["doc_id", "held_out", "lang_pred", "score", "n_languages"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_languages long")


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose strongest language holds at least ``least`` of the words, all columns kept.

    Null texts and those without a letter go. On a tie the language that comes first by name is the strongest. Where nothing could be learned
    every row goes. Repeated rows stay or go together; an empty table gives no rows.
    """
    languages, logp = fit(docs.where(F.crc32(F.col(id_col).cast("string")) % 4 != 2), text_col, lang_col, id_col)
    model = docs.sparkSession.sparkContext.broadcast(Mixture(languages, logp))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                pred, score, _ = model.value.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score)], pa.bool_()))
        common.release()

    return docs.mapInArrow(run, docs.schema)
