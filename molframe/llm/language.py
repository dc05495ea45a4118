"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

Features are n-grams of one to three characters of the lower-cased text, hashed to a fixed number of slots. Training runs
follow-the-regularised-leader with elastic-net penalties over a bounded sample of labelled texts, then fits one
temperature on the part of the sample held back for it. Prediction is one pass over the texts in Arrow batches; the
model is a small matrix of fixed size that travels with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._runtime import bound_batches, bounded_sample

SLOTS = 1 << 14
#: Labelled texts per language, and languages (those with the most labelled texts), that training may use.
PER_LANGUAGE, LANGUAGES = 400, 256
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-4, 1e-4
UNDETERMINED = "und"
#: Characters hashed at a time; it bounds memory, not the text.
BLOCK = 1 << 20



_TABLE: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point -> its lower-case letter, or 32 for what is no letter."""
    global _TABLE
    if _TABLE is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE = table
    return _TABLE


def ngram_counts(text: str, slots: int = SLOTS) -> np.ndarray | None:
    """Counts per slot over a whole text; None if it has no letter. Runs of non-letters count as one space."""
    counts = np.zeros(slots, np.int64)
    table, some = _fold_table(), False
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), BLOCK):
        codes = table[np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters = codes != 32
        some |= bool(letters.any())
        joined = np.concatenate([tail, codes])
        keep = np.ones(len(joined), bool)
        keep[1:] = (joined[1:] != 32) | (joined[:-1] != 32)
        keep[: len(tail)] = True
        joined = joined[keep].astype(np.uint64)
        h = np.zeros(len(joined), np.uint64)
        skip = len(tail) - 1  # n-grams that end inside the tail were counted with the block before
        for n in (1, 2, 3):
            # hash of the n characters ending at each place, from that of the n - 1 before it
            h = (np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if n > 1 else h) * np.uint64(0x9E3779B97F4A7C15) + joined + np.uint64(n)
            first = max(n - 1, skip + 1)
            if first < len(h):
                mixed = h[first:] * np.uint64(0xD6E8FEB86659FD93)
                counts += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % slots, minlength=slots)
        tail = joined[-2:].astype(np.uint32)
    return counts if some else None


def _weights(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF weights of one text, given its slots and their counts."""
    w = np.log1p(counts) * idf[at]
    return w / (np.linalg.norm(w) or 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages (sorted), idf per slot, weights (slots x languages) and temperature."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; undetermined, 0 for a null text, one without letters, or an empty model."""
        counts = ngram_counts(text, len(self.idf)) if text and self.languages else None
        if counts is None:
            return UNDETERMINED, 0.0
        at = np.flatnonzero(counts)
        p = _softmax(_weights(at, counts[at], self.idf) @ self.weights[at] / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def train(texts: list[str], labels: list[str], **options) -> LanguageModel:
    """``fit`` over texts; without usable ones the model knows no language."""
    rows = []
    for t, y in zip(texts, labels):
        counts = ngram_counts(t, options.get("slots", SLOTS)) if y is not None and t else None
        if counts is not None:
            at = np.flatnonzero(counts)
            rows.append((at, counts[at], y))
    return fit(rows, **options)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = EPOCHS, l1: float = L1, l2: float = L2, slots: int = SLOTS) -> LanguageModel:
    """Follow-the-regularised-leader (proximal, per-coordinate rates) over rows (slots, counts, label), in a fixed order.

    Every fifth row is held back for the temperature. Without rows the model knows no language.
    """
    languages = tuple(sorted({y for *_, y in rows}))
    if not rows:
        return LanguageModel((), np.zeros(slots), np.zeros((slots, 0)), 1.0)
    df = np.bincount(np.concatenate([at for at, *_ in rows]), minlength=slots)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    data = [(at, _weights(at, counts, idf), languages.index(y)) for at, counts, y in rows]
    order = np.random.default_rng(7).permutation(len(data))
    back = [i for k, i in enumerate(order) if k % 5 == 4]
    fit = [i for k, i in enumerate(order) if k % 5 != 4]
    z = np.zeros((slots, len(languages)))
    n = np.zeros_like(z)

    def leader(at: np.ndarray | slice) -> np.ndarray:
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((BETA + np.sqrt(nn)) / ALPHA + l2))

    for _ in range(epochs):
        for i in fit:
            at, x, y = data[i]
            w = leader(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    weights = leader(slice(None))
    logits = np.array([data[i][1] @ weights[data[i][0]] for i in (back or fit)])
    truth = np.array([data[i][2] for i in (back or fit)])
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min(np.geomspace(0.02, 5.0, 120), key=loss)
    return LanguageModel(languages, idf, weights, float(temperature))


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of the id, as text, leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Slots and counts of texts as bytes, which cost the driver a fraction of what lists of numbers do."""
    for texts in parts:
        rows = []
        for t in texts:
            counts = ngram_counts(t)
            at = np.flatnonzero(counts) if counts is not None else np.zeros(0, np.int64)
            rows.append(np.array([at, counts[at] if len(at) else at], "<i8").tobytes())
        yield pd.Series(rows, dtype=object)


def fit_language_model(
    docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language: int = PER_LANGUAGE, languages: int = LANGUAGES
) -> LanguageModel:
    """Trains on at most ``per_language`` texts of each language, chosen by hash among rows not held out.

    If there are more than ``languages`` languages, those with the most labelled texts are learned. Whole texts are counted
    where they lie; the driver gets their counts, SLOTS at most for each, and no text.
    """
    bound_batches(docs.sparkSession)
    labelled = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    plain = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id"))
    sample = bounded_sample(plain, ["id", "text"], per_language, within="lang", values=languages)
    counted = sample.select("lang", F.xxhash64("text").alias("h"), F.pandas_udf(_counted, T.BinaryType())("text").alias("c")).collect()
    counted.sort(key=lambda r: (r["lang"], r["h"]))
    return fit([(*np.frombuffer(r["c"], "<i8").reshape(2, -1), r["lang"]) for r in counted if len(r["c"])])


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict_column(model: LanguageModel, text: Column) -> Column:
    """(lang_pred, score) of a text column."""

    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return F.pandas_udf(predict, _RESULT)(text)


def identify_language(
    docs: DataFrame, model: LanguageModel | None = None, id_col="doc_id", text_col="text", lang_col="lang"
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; only the text enters a prediction.

    A null or empty text, one without letters, and any text where nothing could be learned are ``und`` with score 0.
    Equal texts get equal results; repeated rows are predicted one by one. An empty table gives no rows. Only the named
    columns are read, so other columns may have any name.
    """
    bound_batches(docs.sparkSession)
    model = model or fit_language_model(docs, id_col, text_col, lang_col)
    read = docs.select(F.col(id_col).alias("doc_id"), predict_column(model, F.col(text_col)).alias("p"))
    return read.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang_pred").alias("lang_pred"), F.col("p.score").alias("score")
    )
