"""Secret scans: three fixed patterns, and random strings found by their token efficiency."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import islice, takewhile

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.llm.common import by_characters, read_table, text_or_empty

#: Kinds in the order of ties: pattern, group whose length counts, least length.
BASE_KINDS = {
    "assign": (
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2,
        8
    ),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    # A run of 32 or more: the same as the runs of any length, less the shorter ones.
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
RANDOM_KIND = "random"
#: A random string has at least so many characters, and at most so many of them per token.
MIN_CHARS, MAX_CHARS_PER_TOKEN = 20, 2.0
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NUMBER = re.compile(r"[0-9+/_=-]+")
#: Parts of an identifier: words and short numbers between separators.
_IDENTIFIER = re.compile(r"([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})([_/=+-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[_/=+-]*")
_SEPARATORS = re.compile(r"[_/=+-]+")
#: Letters of a part that can speak for or against an identifier: numbers and shorter parts take about a token whatever they are.
_PART_LETTERS = 3
#: Where the vocabulary's file is on every executor, and how its tokenizer cuts a text before merging (fixed by the vocabulary).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Span = tuple[int, int, str]


def load_encoding(path: str, pattern: str = PRETOKENS) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns: leftmost, non-overlapping within a kind, too short matches dropped."""
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE_KINDS.items()):
        if kind == "assign" and ":" not in text and "=" not in text:
            continue
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def _of_words(s: str, encoding: tiktoken.Encoding) -> bool:
    """Whether a string is an identifier whose parts are plausible words, by more characters per token than a random string has.

    The longer parts are judged together if they make up half the string, and each that is as long as a random string by itself.
    """
    if not _IDENTIFIER.fullmatch(s):
        return False
    parts = [x for x in _SEPARATORS.split(s) if len(x) >= _PART_LETTERS and x.isalpha()]
    tokens = [len(encoding.encode_ordinary(x)) for x in parts]
    letters = sum(map(len, parts))
    if 2 * letters >= len(s) and letters <= MAX_CHARS_PER_TOKEN * sum(tokens):
        return False
    return not any(len(x) >= MIN_CHARS and len(x) <= MAX_CHARS_PER_TOKEN * n for x, n in zip(parts, tokens))


def random_spans(text: str, taken: list[Span], encoding: tiktoken.Encoding) -> list[Span]:
    """(start, end, kind) of strings that the vocabulary cuts into unusually short tokens.

    Known digests, UUIDs, plain numbers and identifiers made of words are left out,
    so are strings that touch a span in taken.
    """
    found, last = [], 0
    for m in _CANDIDATE.finditer(text):
        s, (a, b) = m[0], m.span()
        while last < len(taken) and taken[last][1] <= a:
            last += 1
        # Spans before the last one end before this string; those that start after it do not touch it, nor do later ones.
        touching = (x[1] > a for x in takewhile(lambda x: x[0] < b, islice(taken, last, None)))
        if any(touching) or _NUMBER.fullmatch(s) or _UUID.fullmatch(s):
            continue
        if len(s) in DIGEST_LENGTHS and _DIGEST.fullmatch(s) or _of_words(s, encoding):
            continue
        if _IDENTIFIER.fullmatch(s) or len(s) <= MAX_CHARS_PER_TOKEN * len(encoding.encode_ordinary(s)):
            found.append((a, b, RANDOM_KIND))
    return found


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, n_random, base_spans, spans.

    spans are kind:start:end in code points, end exclusive, by start and then kind,
    comma-joined; base_spans has the fixed patterns only.  A null or empty text has none. vocabulary is the path of a tiktoken rank file
    that every executor can read.  Rows are scanned one by one, very long texts whole: repeated rows give repeated results, an empty
    table none; of spans that start together the kinds' order decides.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kinds = [*BASE_KINDS, RANDOM_KIND]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        for batch in batches:
            encoding = encoding or load_encoding(vocabulary)
            for part in by_characters(batch):
                counts, base, spans = {k: [] for k in kinds}, [], []
                for text in part.column(1).to_pylist():
                    own = base_spans(text)
                    more = random_spans(text, sorted(own), encoding)
                    both = sorted([*own, *more], key=lambda x: (x[0], kinds.index(x[2])))
                    base.append(_joined(own))
                    spans.append(_joined(both))
                    for k in kinds:
                        counts[k].append(sum(x[2] == k for x in both))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), *(pa.array(counts[k], pa.int64()) for k in kinds), pa.array(base, pa.string()),
                        pa.array(spans, pa.string())
                    ],
                    names=["id", *(f"n_{k}" for k in kinds), "base_spans", "spans"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    columns = ", ".join(f"n_{k} bigint" for k in kinds)
    return rows.mapInArrow(of_batches, f"id {kind}, {columns}, base_spans string, spans string").withColumnRenamed("id", id_col)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and a digest of the fixed patterns' spans, and all spans with those the method adds."""
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_random", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
