"""Periodic runs of words: a dictionary of basic factors proposes periods, direct comparison extends them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.llm.common import by_characters, read_table, text_or_empty

#: A run has at least so many words and at least so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4

Run = tuple[int, int, int]
Planted = Callable[[object, list[bytes]], list[bytes]]


def words_of_text(text: str) -> list[bytes]:
    """The words of a text in UTF-8; bytes.split() cuts at space and \\t \\n \\v \\f \\r, no other white space."""
    return text.encode().split()


def _named(pairs: np.ndarray) -> np.ndarray:
    """Equal numbers for equal entries, from 0."""
    return np.unique(pairs, return_inverse=True)[1].reshape(-1)


def _successors(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of the rising positions at the distance to the next one with the same name, 0 for none."""
    order = np.argsort(names, kind="stable")
    follows = names[order[1:]] == names[order[:-1]]
    gaps = np.zeros(len(at), np.int64)
    gaps[order[:-1][follows]] = (at[order[1:]] - at[order[:-1]])[follows]
    return gaps


def _extended(ids: np.ndarray, start: int, stop: int, period: int) -> tuple[int, int]:
    """The longest stretch around [start, stop) in which words a period apart are equal; looks at twice as many words each time."""
    n, step = len(ids), 16
    while stop < n:
        same = ids[stop : stop + step] == ids[stop - period : stop - period + len(ids[stop : stop + step])]
        stop += len(same) if same.all() else int(same.argmin())
        if not same.all():
            break
        step *= 2
    step = 16
    while start > 0:
        low = max(0, start - step)
        same = (ids[low:start] == ids[low + period : start + period])[::-1]
        start -= len(same) if same.all() else int(same.argmin())
        if not same.all():
            break
        step *= 2
    return start, stop


def periodic_runs(ids: np.ndarray, min_words: int = MIN_WORDS) -> list[Run]:
    """(start, length, period) of all maximal runs of at least four periods and min_words words, by start and then period.

    The factors of a power-of-two length 2^k get equal names where they are equal; those of the next length are named by
    the names of their halves, and only where both halves occur again.  Inside a run of period q at most 2^k long each factor occurs next after
    exactly q words, so successors at one distance form an arithmetic progression of positions; 4 q words leave at least
    3 q - 2^k + 1 of them in a row.  A progression proposes its distance as period, is extended both ways by comparing words, and one
    that other lengths have found already is dropped.  A smaller period of the same stretch would have been a nearer
    successor, so periods are the smallest ones.
    """
    n, found, width = len(ids), set(), 1
    at, names = np.arange(n), _named(np.asarray(ids))
    while len(at) and width <= max(1, n // 2):
        gaps = _successors(names, at)
        # Rows of neighbouring positions with one gap of at most twice the width.
        near = np.where(gaps <= 2 * width, gaps, 0)
        edge = np.flatnonzero(np.r_[True, (near[1:] != near[:-1]) | (at[1:] != at[:-1] + 1)])
        count = np.diff(np.r_[edge, len(at)])
        gap = near[edge]
        real = (gap > 0) & (count >= np.maximum(1, (MIN_PERIODS - 1) * gap - width + 1))
        for i, q, c in zip(at[edge[real]].tolist(), gap[real].tolist(), count[real].tolist()):
            start, stop = _extended(ids, i, i + c - 1 + width + q, q)
            if stop - start >= max(min_words, MIN_PERIODS * q):
                found.add((start, stop - start, q))
        # Only factors that occur again can be halves of longer ones that do.
        again = np.bincount(names)[names] > 1
        where = np.full(n + width, -1)
        where[at[again]] = names[again]
        left = at[again]
        left = left[where[left + width] >= 0]
        names = _named(where[left] * (n + 1) + where[left + width])
        at, width = left, 2 * width
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay if of every run only its first period does."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def most_periodic(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; of equal ones the first, then that of the smallest period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def repeat_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten (by the CRC-32 of its id) with a tail made periodic; a null id changes nothing."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


def find_periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Planted | None = None, min_words: int = MIN_WORDS
) -> DataFrame:
    """One row per row of docs: id, runs (array of start, length, period), best (the most periodic run or null), collapsed (text).

    A run is a stretch of words with a smallest period q, at least min_words and 4 q words long, that no neighbouring word continues.
    collapsed are the words left, joined by a space, when every run keeps its first period only. prepare may replace a document's words, given its
    id.  A null or empty text has no words and no runs; null ids and repeated rows give a row each; an empty table gives none; a very long text is
    handled whole, in memory that grows with its words.  Ties of best go to the smaller start, then period.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_row = lambda r: None if r is None else {"start": r[0], "length": r[1], "period": r[2]}
        for batch in batches:
            for part in by_characters(batch):
                all_runs, best, collapsed = [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = words_of_text(text)
                    words = prepare(doc_id, words) if prepare else words
                    ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
                    runs = periodic_runs(ids, min_words)
                    stay = kept_words(len(words), runs)
                    all_runs.append([as_row(r) for r in runs])
                    best.append(as_row(most_periodic(runs)))
                    collapsed.append(b" ".join(w for w, k in zip(words, stay.tolist()) if k).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(all_runs, pa.list_(run)), pa.array(best, run), pa.array(collapsed, pa.string())],
                    names=["id", "runs", "best", "collapsed"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    of_run = "struct<start: bigint, length: bigint, period: bigint>"
    return rows.mapInArrow(of_batches, f"id {kind}, runs array<{of_run}>, best {of_run}, collapsed string").withColumnRenamed("id", id_col)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of runs, the most periodic one, digests of all runs and of the text without repetitions.

    One document in ten gets a periodic tail first, as its id decides.
    """
    found = find_periodic_runs(read_table(spark, sf_dir, "documents"), prepare=repeat_tail)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = {c: F.col(f"best.{c}") for c in ("start", "length", "period")}
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(c.alias(k) for k, c in best.items()),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
