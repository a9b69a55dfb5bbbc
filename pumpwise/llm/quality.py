"""Quality scores by Bradley-Terry ranking: logistic loss on feature differences of preference pairs, cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.llm.common import read_table, text_or_empty

#: Most labelled documents that the model is fitted on (those with the least CRC-32 of their ids), and partners of the other label drawn
#: for each of them.
MAX_FIT_ROWS, PARTNERS = 20_000, 10
RIDGE, STEPS, SEED = 1e-3, 30, 42
#: Characters and capitals that a text is taken to have besides its own, so that one short sentence says little.
PRIOR_CHARS, PRIOR_CAPITALS = 40, 1.2
#: Classes of characters; characters from _TABLE on count as letters.
_SPACE, _LETTER, _UPPER, _DIGIT, _STOP, _SHOUT, _SYMBOL = range(7)
_TABLE = 0x2000


def _classes() -> np.ndarray:
    def of(c: str) -> int:
        if c.isspace():
            return _SPACE
        if c.isalpha():
            return _UPPER if c.isupper() else _LETTER
        return _DIGIT if c.isdigit() else _STOP if c in ".,;:?'\"()-" else _SHOUT if c == "!" else _SYMBOL

    return np.array([*(of(chr(i)) for i in range(_TABLE)), _LETTER], dtype=np.uint8)


def features(text: str, classes: np.ndarray) -> list[float]:
    """Shares of character classes, word shape and repetition of a text; the same few numbers at any length, zeros if it has no words."""
    words = text.split()
    if not words:
        return [0.0] * 14
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    count = np.bincount(classes[np.minimum(codes, _TABLE)], minlength=7)
    n, filled = len(words), int(count.sum() - count[_SPACE])
    lines = [x for x in text.split("\n") if x.strip()]
    letters = int(count[_LETTER] + count[_UPPER])
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    distinct = len(set(words))
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:?\"')" for w in words) / n
    return [
        (count[_UPPER] + PRIOR_CAPITALS) / (letters + PRIOR_CHARS),
        *(count[k] / (filled + PRIOR_CHARS) for k in (_DIGIT, _STOP, _SHOUT, _SYMBOL)),
        (filled + PRIOR_CHARS) / (n + PRIOR_CHARS / 6), again, marked, np.log(distinct + 1.0) / np.log(n + 1.0), np.log(n),
        len(set(lines)) / len(lines),
        np.log(n / len(lines)), sum(w.isupper() and len(w) > 1 for w in words) / n, float(n > 0),
    ]


@dataclass(frozen=True)
class Ranking:
    """A fitted scorer: standardised features times weights, minus the cut, through the logistic function."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = _standard(x, self.mean, self.scale) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def pair_differences(z: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Features of a good document minus those of a bad one: every document with PARTNERS of the other label, drawn with a fixed seed."""
    rng = np.random.default_rng(SEED)
    ups, downs = np.flatnonzero(good), np.flatnonzero(~good)
    first = np.concatenate((np.repeat(ups, PARTNERS), rng.choice(ups, PARTNERS * len(downs))))
    second = np.concatenate((rng.choice(downs, PARTNERS * len(ups)), np.repeat(downs, PARTNERS)))
    return z[first] - z[second]


def fit_ranking(x: np.ndarray, good: np.ndarray) -> Ranking | None:
    """Bradley-Terry strengths from pairs of a good and a bad document, PARTNERS drawn for each; None if either kind is missing.

    The loss of a pair is log(1 + exp(-(s_good - s_bad))), minimised by Newton steps with a ridge.  The cut is
    the quantile of the fitted scores that best separates the labels: of all quantiles, the one with the highest mean
    of both kinds' accuracy, halfway to the next score.
    """
    if len(x) == 0 or good.all() or not good.any():
        return None
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = _standard(x, mean, scale)
    diff = pair_differences(z, good)
    n = len(diff)
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
        grad = diff.T @ p / n - RIDGE * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / n + RIDGE * np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    s = z @ w
    order = np.argsort(s, kind="stable")
    s, g = s[order], good[order]
    bad_below = np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    good_above = 1 - np.concatenate(([0], np.cumsum(g))) / g.sum()
    edges = np.concatenate(([s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]))
    return Ranking(mean, scale, w, float(edges[np.argmax(bad_below + good_above)]))


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of an id's text leaves the remainder; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Ranking | None:
    """Fit on labelled documents that are not held out (CRC-32 of the id mod 3 is not 1), at most MAX_FIT_ROWS of them.

    Of several labels of one id the least counts, of several texts the least in byte order, so that at most MAX_FIT_ROWS rows of a few
    numbers reach the driver.  Null ids and other labels than 0 and 1 are left out; without labels of both kinds the result is None.
    """
    chosen = labels.select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")
    ).where("id IS NOT NULL AND label IN (0, 1)")
    chosen = chosen.where(~held_out(F.col("id"), 3, 1)).groupBy("id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.crc32(F.col("id").cast("string").cast("binary")), "id").limit(MAX_FIT_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes()
        for batch in batches:
            x = [features(t, classes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    got = rows.select("label", "text").mapInArrow(of_batches, "label int, x array<double>").toPandas()
    if got.empty:
        return None
    # Sorted, so that the fit does not depend on the order of tasks.
    got = got.assign(key=[tuple(v) for v in got["x"]]).sort_values(["key", "label"])
    return fit_ranking(np.array(got["x"].tolist(), dtype=float), got["label"].to_numpy() == 1)


def quality_score(model: Ranking | None, text: Column) -> Column:
    """The score of a text, 0 to 1, from the whole text alone; 0.5 without a model (no labels of both kinds)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        classes = _classes()
        x = np.array([features(t, classes) for t in texts], dtype=float)
        return pd.Series(model.score(x) if model and len(x) else np.full(len(x), 0.5))

    return score(text)


def quality_scores(docs: DataFrame, model: Ranking | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1), predicted (1 from 0.5 on).

    Null texts count as empty and get the score of a text without words.  Rows with one id are scored one by one, a very long text in
    one piece, an empty table gives no rows; other columns are ignored.
    """
    scored = docs.select(F.col(id_col).alias("id"), quality_score(model, text_or_empty(text_col)).alias("score"))
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Ranking | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores 0.5 or more, all columns as they are.

    Null texts are scored as empty ones, repeated rows one by one; a score of just 0.5 stays, so without a model all do.  An empty table
    gives an empty one.
    """
    return docs.where(quality_score(model, text_or_empty(text_col)) >= 0.5)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, from a ranking learned on labels outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    scores = quality_scores(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
