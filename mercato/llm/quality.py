"""Quality by weak supervision: rules vote good or bad or abstain, and a latent class weighs them.

The vote model: a document is good or bad; a rule that does not abstain votes bad on bad documents with
probability ``sens`` and good on good ones with probability ``spec``; abstentions carry no evidence.
Expectation-maximisation runs over vote patterns with their counts, of which there are at most ``3 ** len(RULES)``,
so every document counts and the driver never holds more than that table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
_SPACE = " \t\n\r\x0b\x0c"
_WINDOW = 8
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))
_END_MARKS = b"!?"
_NOT_END_MARKS = bytes(set(range(256)) - set(_END_MARKS))

GOOD, BAD, ABSTAIN = 0, 1, 2


def _share(a, b):
    return a / np.maximum(b, 1)


@dataclass(frozen=True)
class Rule:
    """Bad above (below, if ``bad > good`` is false) ``bad``, good on the other side of ``good``, else no vote."""

    name: str
    measure: Callable[[dict], np.ndarray]
    bad: float
    good: float | None
    least_words: int = 0

    def votes(self, m: dict) -> np.ndarray:
        x = self.measure(m)
        high = self.good is None or self.bad > self.good
        out = np.full(len(x), ABSTAIN, np.int64)
        if self.good is not None:
            out[x <= self.good if high else x >= self.good] = GOOD
        out[x > self.bad if high else x < self.bad] = BAD
        out[m["n_words"] < self.least_words] = ABSTAIN
        return out


RULES = (
    Rule("length", lambda m: m["n_words"], 20, 60),
    Rule("repeats", lambda m: _share(m["n_repeat_words"], m["n_words"]), 0.30, 0.10, 8),
    Rule("symbols", lambda m: _share(m["n_symbols"], m["word_chars"]), 0.08, 0.01, 1),
    Rule("copied_lines", lambda m: _share(m["n_dup_lines"], m["n_lines"]), 0.50, 0.10, 1),
    Rule("marked_words", lambda m: _share(m["n_symbol_words"], m["n_words"]), 0.25, 0.03, 1),
    Rule("letters", lambda m: _share(m["n_letters"], m["word_bytes"]), 0.75, 0.85, 40),
    Rule("capitals", lambda m: _share(m["n_upper"], m["n_letters"]), 0.40, 0.15, 1),
    Rule("variety", lambda m: _share(m["n_distinct"], np.minimum(m["n_words"], 2000)), 0.18, 0.30, 30),
    Rule("stutter", lambda m: _share(m["n_echoes"], m["n_words"]), 0.30, 0.05, 1),
    Rule("exclaimed", lambda m: _share(m["n_marks"], m["n_words"]), 0.25, 0.05, 1),
)
_POWERS = 3 ** np.arange(len(RULES))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts for each text; null is empty."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    flat, starts = common.words_of(texts)
    counts = np.diff(starts)
    doc = np.repeat(np.arange(n), counts)
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=n).astype(np.int64)
    out = {"n_words": counts, "word_chars": per_doc(pc.utf8_length(flat).to_numpy(zero_copy_only=False)), "word_bytes": per_doc(pc.binary_length(flat).to_numpy(zero_copy_only=False))}
    out["n_symbol_words"] = per_doc(pc.match_substring_regex(flat, "[#*$%&|<>]").to_numpy(zero_copy_only=False))
    h = common.word_hashes(flat)
    salt = common.mix64(np.arange(1, n + 1, dtype=np.uint64))[doc]
    own = np.sort(common.mix64(h ^ salt))
    # A word hash with its document's salt is the document's own: distinct ones are counted where they come first.
    order = np.argsort(common.mix64(h ^ salt), kind="stable")
    fresh = np.ones(len(h), bool)
    fresh[order[1:]] = own[1:] != own[:-1]
    out["n_distinct"] = per_doc(fresh)
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out["n_echoes"] = per_doc(echo)
    m = max(0, len(h) - _WINDOW + 1)
    full = np.zeros(m, np.uint64)
    for j in range(_WINDOW):
        full += h[j : j + m] * common._SHINGLE[j]
    inside = doc[:m] == doc[_WINDOW - 1 :] if m else np.empty(0, bool)
    at = np.flatnonzero(inside)
    full = common.mix64(full[at] ^ salt[at])
    order = np.argsort(full, kind="stable")
    same = full[order][1:] == full[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + _WINDOW, -1)
    out["n_repeat_words"] = per_doc(np.cumsum(cover)[:-1] > 0)
    rest = np.zeros((6, n), np.int64)
    for i, text in enumerate(texts.to_pylist()):
        raw = text.encode()
        lines = [x for x in text.split("\n") if x.strip(_SPACE)]
        rest[:, i] = len(raw) - len(raw.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), len(raw) - len(raw.translate(None, _LETTERS)), len(raw) - len(raw.translate(None, _UPPER)), len(raw.translate(None, _NOT_END_MARKS))
    return out | dict(zip(("n_symbols", "n_lines", "n_dup_lines", "n_letters", "n_upper", "n_marks"), rest))


def base_failed(m: dict) -> np.ndarray:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def patterns(m: dict) -> np.ndarray:
    return sum(r.votes(m) * p for r, p in zip(RULES, _POWERS))


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern int"


def _measured(run_id: str):
    def run(batches):
        common.only(run_id)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                m = measure(part.column(1))
                cols = [part.column(0), *(pa.array(m[f]) for f in _FIELDS), pa.array(base_failed(m)), pa.array(patterns(m).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *_FIELDS, "base_failed", "pattern"])
        common.release()

    return run


def fit(counts: dict[int, int], rounds: int = 200, prior: float = 0.1, strength: float = 0.02) -> dict:
    """Accuracies of the rules and the posterior of being good for each pattern.

    A rule knows some kinds of bad text only, so its good vote is weak evidence (``sens`` stays at most 0.5) and its bad
    vote is precise (``spec`` at least 0.97); without these bounds the largest kind of bad text would become the bad class
    alone. Beta priors worth ``strength`` of all documents keep "bad" the class that the rules' bad votes mean, also where a
    rule never votes. Without documents the priors are returned.
    """
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[c] for c in codes.tolist()], float)
    votes = codes[:, None] // _POWERS[None, :] % 3
    is_bad, is_good = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    total = n.sum()
    weight = max(1.0, strength * total)
    sens, spec, rate = np.full(len(RULES), 0.4), np.full(len(RULES), 0.98), prior
    bad = np.zeros(len(codes))
    for _ in range(rounds):
        lb = np.log(rate) + is_bad @ np.log(sens) + is_good @ np.log1p(-sens)
        lg = np.log1p(-rate) + is_bad @ np.log1p(-spec) + is_good @ np.log(spec)
        new = 1 / (1 + np.exp(np.clip(lg - lb, -700, 700)))
        done, bad = np.abs(new - bad).max(initial=0) < 1e-9, new
        wb, wg = n * bad, n * (1 - bad)
        sens = np.clip((wb @ is_bad + 0.4 * weight) / (wb @ (is_bad + is_good) + weight), 0.05, 0.5)
        spec = np.clip((wg @ is_good + 0.98 * weight) / (wg @ (is_bad + is_good) + weight), 0.97, 0.9999)
        rate = float(np.clip((wb.sum() + prior * weight) / (total + weight), 1e-4, 0.5))
        if done:
            break
    return {"bad_rate": rate, "sens": dict(zip((r.name for r in RULES), sens.tolist())), "spec": dict(zip((r.name for r in RULES), spec.tolist())), "good": dict(zip(codes.tolist(), (1 - bad).tolist()))}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base_failed and the vote pattern of each row; null is empty, repeated rows are rows, other columns are not read. A text is
    measured whole: memory grows with the longest one."""
    common.ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_measured(common.new_run()), _MEASURED)


def fit_table(rows: DataFrame) -> dict:
    """The model of a measured table; the driver gets a count for each vote pattern, at most ``3 ** len(RULES)`` rows."""
    return fit({r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.count("*").alias("n")).collect()})


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """A row per document: its counts, base_failed, quality (posterior of being good) and kept.

    A document goes if it fails the base test or its posterior is under ``least``.

    A null text counts as empty: no words, so it fails the base test. Repeated rows count as often as they
    come and get equal results. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = common.table(measured(docs, id_col, text_col), "quality")
    good = fit_table(rows)["good"]
    look = spark.createDataFrame(sorted(good.items()), "pattern int, quality double")
    out = rows.join(F.broadcast(look), "pattern", "left").drop("pattern")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def keep_good(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. The texts are read twice: to fit and to filter.

    A null text has no words and goes. Repeated rows count as often as they come and stay or go together; ids play no part. An empty table
    gives no rows. A posterior of exactly ``least`` is kept.
    """
    numbered = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    good = fit_table(measured(numbered))["good"]
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                m = measure(part.column(at))
                quality = np.array([good.get(p, 0.0) for p in patterns(m).tolist()])
                yield part.filter(pa.array(~base_failed(m) & (quality >= least)))
        common.release()

    return docs.mapInArrow(run, docs.schema)
