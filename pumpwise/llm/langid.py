"""Language identification: scripts narrow the candidates, Viterbi over word scores with a switching penalty labels spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.llm.common import by_characters, checkpoint, read_table, text_or_empty
from pumpwise.llm.quality import held_out

#: Letters by script, as Unicode block ranges (fixed values); any other letter is of the last, unnamed script.
SCRIPT_RANGES = (
    (0x0041, 0x024F), (0x0370, 0x03FF), (0x0400, 0x052F), (0x0530, 0x058F), (0x0590, 0x05FF), (0x0600, 0x06FF),
    (0x0900, 0x097F), (0x0980, 0x09FF), (0x0B80, 0x0BFF), (0x0E00, 0x0E7F), (0x10A0, 0x10FF), (0x3040, 0x30FF),
    (0x4E00, 0x9FFF), (0xAC00, 0xD7AF),
)
#: Character n-grams of words are counted in so many hash buckets; the model has 4 bytes for each bucket and language.
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Languages counted at once in a task; numbers (code points x languages) that a slice of texts, or of a text's words, may take in an array.
LANGUAGES_AT_ONCE, SLICE = 16, 8_000_000
#: Log-probability lost by a change of language between words; least share of a language's words for a script to be its own.
SWITCH_PENALTY, SCRIPT_SHARE = 8.0, 0.01
#: Score of a word for a language that does not use its script, and of documents walked at once.
OFF_SCRIPT, BLOCK = -50.0, 256
#: All code points; the categories of marks (accents, vowel signs), which continue a word but open none, and what the letter table holds for them.
_CODES, _MARKS, _MARK = 0x110000, ("Mn", "Mc"), 255


@dataclass(frozen=True)
class Words:
    """The words (runs of letters) of several texts, and the n-gram buckets that end at each code point of the joined texts."""

    buckets: tuple[np.ndarray, ...]  # one array per n; BUCKETS where no n-gram ends
    first: np.ndarray  # of each word: its first code point, and the one after its last
    last: np.ndarray
    script: np.ndarray
    start: np.ndarray  # code point in its text
    text: np.ndarray  # the text of each word

    @property
    def length(self) -> np.ndarray:
        return self.last - self.first


def _letters() -> np.ndarray:
    """Of each code point: 1 + the script of a letter, _MARK for a mark, 0 for anything else.  The driver makes it once for a job: 1.1 MB."""
    plain = 1 + len(SCRIPT_RANGES)
    kinds = (unicodedata.category(chr(i)) for i in range(_CODES))
    table = np.fromiter((plain if c[0] == "L" else _MARK if c in _MARKS else 0 for c in kinds), dtype=np.uint8, count=_CODES)
    for k, (a, b) in enumerate(SCRIPT_RANGES):
        part = table[a : b + 1]
        part[part == plain] = 1 + k
    return table


def words_of_texts(texts: list[str], letters: np.ndarray) -> Words:
    """Cut lower-cased texts into words and their 2- and 3-grams, a blank being before and after each word."""
    lowered = [t.lower() for t in texts]
    joined = "\n".join([*lowered, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lowered])))
    kind = letters[codes]
    marks, inside = kind == _MARK, kind > 0
    if marks.any():  # a mark is in a word if what its run of marks follows is a letter
        base = np.maximum.accumulate(np.where(marks, 0, np.arange(len(codes))))
        inside &= ~marks[base] & (kind[base] > 0)
    after = np.concatenate(([False], inside[:-1]))  # the blank after a word ends its last n-grams
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    here = np.where(inside, codes, np.uint32(32))
    padded = np.concatenate((np.full(2, 32, dtype=np.uint32), here))
    two = here * np.uint32(0x9E3779B1) + padded[1:-1] * np.uint32(0x85EBCA6B)
    three = two + padded[:-2] * np.uint32(0xC2B2AE35) + np.uint32(3)
    buckets = tuple(
        np.where(ends, (h ^ (h >> 15)) * np.uint32(0x2C1B3C6D) >> (32 - BUCKET_BITS), np.uint32(BUCKETS)).astype(np.int32)
        for h, ends in ((two, inside | after), (three, after))
    )
    text = np.searchsorted(offsets, first, side="right") - 1
    return Words(buckets, first, last, kind[first].astype(np.int64) - 1, first - offsets[text], text)


@dataclass(frozen=True)
class Languages:
    """Log-probabilities of n-gram buckets and the scripts of each learned language."""

    names: tuple[str, ...]
    weights: np.ndarray  # buckets x languages
    scripts: np.ndarray  # scripts x languages

    def word_scores(self, words: Words) -> np.ndarray:
        """The score of each word in each language: its n-grams' log-probabilities, or OFF_SCRIPT a letter in another script."""
        k, count = len(self.names), len(words.first)
        padded = np.vstack((self.weights, np.zeros((1, k), dtype=np.float32)))
        sums = np.zeros((count, k), dtype=np.float32)
        at = 0
        while at < count:  # so many words that their code points times languages stay within a slice; one word at least
            end = max(at + 1, int(np.searchsorted(words.last, words.first[at] + SLICE // max(1, k), side="right")))
            a, b = int(words.first[at]), int(words.last[end - 1]) + 1
            each = sum(padded[x[a:b]] for x in words.buckets)
            # From a word's first letter to the blank after it; a line end follows every text, so last is inside.
            bounds = np.stack((words.first[at:end], words.last[at:end] + 1), axis=1).ravel() - a
            sums[at:end] = np.add.reduceat(np.vstack((each, padded[-1:])), bounds, axis=0)[::2]
            at = end
        allowed = self.scripts[words.script]
        # A script that no language uses leaves all candidates.
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), sums, OFF_SCRIPT * (1 + words.length[:, None]))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best path (texts x words) through scores (texts x words x languages), a change of language costing the penalty."""
    texts, steps, k = scores.shape
    kind = np.min_scalar_type(k)
    best, back = scores[:, 0].copy(), np.zeros((texts, steps, k), dtype=kind)
    stay, ends = np.arange(k, dtype=kind), np.zeros((texts, k), dtype=scores.dtype)
    rows = np.arange(texts)
    ends[lengths == 1] = best[lengths == 1]
    for t in range(1, steps):
        top = best.argmax(axis=1)
        switched = best[rows, top] - penalty
        moves = switched[:, None] > best
        back[:, t] = np.where(moves, top[:, None].astype(kind), stay)
        best = np.where(moves, switched[:, None], best) + scores[:, t]
        done = lengths == t + 1
        if done.any():
            ends[done] = best[done]
    path, state = np.zeros((texts, steps), dtype=kind), ends.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        inside = t < lengths
        path[inside, t] = state[inside]
        if t:
            state = np.where(inside, back[rows, t, state], state)
    return path


def label_words(model: Languages, words: Words, count: int, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The language number of each word, texts of like length walked together."""
    scores = model.word_scores(words)
    out = np.zeros(len(scores), dtype=np.min_scalar_type(len(model.names)))
    n = np.bincount(words.text, minlength=count) if len(words.text) else np.zeros(count, dtype=int)
    heads = np.concatenate(([0], np.cumsum(n)))
    order = [i for i in np.argsort(n, kind="stable") if n[i]]
    while order:
        # At most BLOCK texts, fewer of very long ones.
        size = max(1, min(BLOCK, SLICE // (4 * int(n[order[-1]]) * len(model.names))))
        chosen, order = np.array(order[-size:]), order[:-size]
        grid = np.zeros((len(chosen), int(n[chosen].max()), len(model.names)), dtype=np.float32)
        for r, i in enumerate(chosen):
            grid[r, : n[i]] = scores[heads[i] : heads[i + 1]]
        path = viterbi(grid, n[chosen], penalty)
        for r, i in enumerate(chosen):
            out[heads[i] : heads[i + 1]] = path[r, : n[i]]
    return out


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Count n-gram buckets and scripts by language over all documents that are not held out (CRC-32 of the id mod 4 is not 2).

    The counts are summed in each task, LANGUAGES_AT_ONCE at once, then by language and bucket; the driver gets the
    counts that are not zero and makes the model of BUCKETS numbers a language, 0.26 MB each: with so many languages that this exceeds memory
    the job cannot run.  Every counted language weighs the same.  Null texts count as empty, repeated rows each; an empty table, or one
    without languages, gives a model without languages.
    """
    rows = docs.select(
        F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text"), held_out(F.col(id_col), 4, 2).alias("out")
    )
    rows = rows.where("lang IS NOT NULL AND NOT out").select("lang", "text")
    scripts = len(SCRIPT_RANGES) + 1
    table = docs.sparkSession.sparkContext.broadcast(_letters())

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, counts = table.value, {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, into in counts.items():
                slot = np.flatnonzero(into)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(into[slot])], names=["lang", "slot", "n"]
                )
            counts.clear()

        for batch in batches:
            for part in by_characters(batch):
                texts = pa.table({"lang": part.column(0), "text": part.column(1)}).to_pandas().groupby("lang")["text"]
                for lang, own in texts:
                    if lang not in counts and len(counts) == LANGUAGES_AT_ONCE:
                        yield from counted()
                    words = words_of_texts(list(own), letters)
                    into = counts.setdefault(lang, np.zeros(BUCKETS + scripts, dtype=np.int64))
                    for b in words.buckets:
                        into[:BUCKETS] += np.bincount(b, minlength=BUCKETS + 1)[:BUCKETS]
                    into[BUCKETS:] += np.bincount(words.script, minlength=scripts)
        yield from counted()

    summed = checkpoint(rows.mapInArrow(of_batches, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    got = summed.toPandas()
    names = tuple(sorted(got["lang"].unique()))
    counts = np.zeros((BUCKETS + scripts, len(names)), dtype=np.int64)
    counts[
        got["slot"].to_numpy(dtype=int), np.searchsorted(np.array(names, dtype=object), got["lang"].to_numpy(dtype=object))
    ] = got["n"].to_numpy()
    grams, used = counts[:BUCKETS], counts[BUCKETS:]
    weights = np.log(
        (grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)
    ).astype(np.float32) if names else np.zeros((BUCKETS, 0), np.float32)
    return Languages(names, weights, used >= SCRIPT_SHARE * np.maximum(1, used.sum(axis=0)))


def identify_languages(
    docs: DataFrame, model: Languages, penalty: float = SWITCH_PENALTY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, lang_pred, score, spans (lang:start:end in code points of the lower-cased text, comma-joined).

    Each word (run of letters, with the marks that follow them) scores its n-grams in the languages that use its script; the best path over the words, a
    change of language costing the penalty, labels them, and words of one language in a row form a span.
    lang_pred is the language with most letters (ties: the first in alphabetical order), score its share of the letters.  Without a letter
    (null and empty texts too), or if nothing was learned, they are 'und' and 0.
    The whole text is the only input; a very long one needs memory for its words times languages.  Rows are labelled one by one, repeated
    ones alike; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # BUCKETS numbers a language.
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.scripts))
    table = docs.sparkSession.sparkContext.broadcast(_letters())

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, model = table.value, Languages(*shared.value)
        for batch in batches:
            for part in by_characters(batch, most=max(10_000, SLICE // max(4, len(model.names)))):
                n, k = part.num_rows, len(model.names)
                words = words_of_texts(part.column(1).to_pylist(), letters)
                labels = label_words(model, words, n, penalty) if k else np.zeros(0, dtype=int)
                share = np.zeros((n, max(1, k)))
                if k and len(labels):
                    np.add.at(share, (words.text, labels), words.length)
                total, top = share.sum(axis=1), share.argmax(axis=1)
                spans = [[] for _ in range(n)]
                if len(labels):
                    opens = np.concatenate(([True], (np.diff(labels) != 0) | (np.diff(words.text) != 0)))
                    at = np.flatnonzero(opens)
                    ends = np.concatenate((at[1:], [len(labels)])) - 1
                    for a, b in zip(at, ends):
                        spans[words.text[a]].append(f"{model.names[labels[a]]}:{words.start[a]}:{words.start[b] + words.length[b]}")
                known = total > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([model.names[j] if ok else "und" for j, ok in zip(top, known)], pa.string()),
                        pa.array(share.max(axis=1) / np.maximum(1, total)), pa.array([",".join(s) for s in spans], pa.string()),
                    ],
                    names=["id", "lang_pred", "score", "spans"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(of_batches, f"id {kind}, lang_pred string, score double, spans string").withColumnRenamed("id", id_col)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, its share of the letters, and the spans of all languages in it."""
    docs = read_table(spark, sf_dir, "documents")
    found = identify_languages(docs, learn_languages(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "spans")
