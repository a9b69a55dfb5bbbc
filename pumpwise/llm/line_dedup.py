"""Line deduplication by winnowing: window minima of line hashes are selected and joined, matches extended both ways, later runs deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.llm.common import checkpoint, read_table, text_or_empty, words_of

#: Words of a repeated run of lines from which it is deleted.
MIN_WORDS = 50
BLANKS = " \t\r\v\f"


def _words(s: Column) -> Column:
    """The words of a trimmed line: one more than its blanks if all are single spaces, as in most lines; else they are cut and counted."""
    other = s.contains("  ")
    for c in BLANKS[1:]:
        other = other | s.contains(c)
    return F.when(other, F.size(words_of(s))).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1).cast("long")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The non-blank lines of each document: id, th, pos (0-based among all lines), h and digest of the trimmed line, upto (words so far), w.

    th (128 bits of the text) and id name the document; rows equal in both are one.  Rows of a document are in one partition.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # The text's digest is taken below the explosion: in one projection with it, it would be taken again for every line.
    rows = rows.withColumn("th", F.unhex(F.md5("text")))
    parts = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x, F.lit(BLANKS)).alias("s")))
    full = F.filter(parts, lambda x: x["s"] != "")
    lines = rows.select("id", "th", F.explode(full).alias("x"))
    lines = lines.select(
        "id", "th", "x.pos", F.xxhash64("x.s").alias("h"), F.unhex(F.md5("x.s")).alias("digest"), _words(F.col("x.s")).alias("w")
    )
    lines = lines.repartition("id", "th").distinct()
    return lines.withColumn("upto", F.expr("sum(w) OVER (PARTITION BY id, th ORDER BY pos)"))


def _onward(min_words: int) -> str:
    """The frame of a line's window: the shortest run of lines from it onward that has min_words words (or all that are left)."""
    return f"OVER (PARTITION BY id, th ORDER BY upto - w RANGE BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING)"


def _back(min_words: int) -> str:
    """The same up to and with the line."""
    return f"OVER (PARTITION BY id, th ORDER BY upto RANGE BETWEEN {min_words - 1} PRECEDING AND CURRENT ROW)"


def selected_lines(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Winnowing: of each window the line with the least hash (of equal ones the first), each position once: id, th, pos, h.

    A window is the shortest run of lines with min_words words from some line onward.  Any run of min_words words holds a whole window, and
    equal windows select the same of their lines, so a run that stands in two places has a selected line at the same place in both.
    """
    frame = _onward(min_words)
    windows = lines.select("id", "th", F.expr(f"sum(w) {frame}").alias("words"), F.expr(f"min(struct(h, pos)) {frame}").alias("least"))
    return windows.where(F.col("words") >= min_words).select("id", "th", "least.pos", "least.h").distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal runs of lines that repeat earlier ones: id, th (MD5 of the text), first, last (line numbers from 0).

    A run is a sequence of lines, blank ones aside and edges trimmed, of min_words
    words or more in all.  Of equal runs the one with the smallest
    (id, line) stays; the others are returned, merged where they touch.

    Selected lines (see selected_lines) are joined on their hashes, and only lines with a hash that is selected in several places go on.  A match
    is extended both ways: around such a line, the shortest runs of min_words words that hold it, onward from and up to every line, are compared by
    the 128-bit digests of all their lines, each with the earliest equal one, so that a passage in a
    third of all documents gives one pair per copy, not all pairs.  Runs that overlap or touch are one.
    """
    lines = checkpoint(_lines(docs, id_col, text_col))
    selected = selected_lines(lines, min_words)
    # Written out, so that Spark may split the rows of a frequent line in the join.
    again = checkpoint(selected.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    near = lines.join(again.withColumn("hit", F.lit(1)), "h", "left")
    near = near.withColumn("any", F.expr("max(hit) OVER (PARTITION BY id, th)")).where("any = 1")
    onward, back = _onward(min_words), _back(min_words)

    def one(frame: str, ends: str) -> Column:
        body = f"md5(array_join(collect_list(hex(digest)) {frame}, ''))"
        return F.expr(f"struct(sum(w) {frame} AS words, max(hit) {frame} AS hits, unhex({body}) AS body, {ends})")

    both = near.select(
        "id", "th",
        one(onward, f"pos AS first, max(pos) {onward} AS last").alias("a"),
        one(back, f"min(pos) {back} AS first, pos AS last").alias("b"),
    )
    each = F.filter(F.array("a", "b"), lambda x: (x["words"] >= min_words) & (x["hits"] == 1))
    runs = both.select("id", "th", F.explode(F.array_distinct(each)).alias("x")).select("id", "th", "x.body", "x.first", "x.last")
    runs = checkpoint(runs.withColumn("at", F.struct("id", "th", "first")))
    anchors = checkpoint(runs.groupBy("body").agg(F.min("at").alias("anchor"), F.max("at").alias("latest")).where("anchor < latest"))
    later = runs.join(anchors.select(F.col("body").alias("same"), "anchor"), F.col("body") == F.col("same"))
    later = later.where("at > anchor").select("id", "th", "first", "last")
    reach = "max(last) OVER (PARTITION BY id, th ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    marked = later.withColumn("opens", F.expr(f"CASE WHEN first <= {reach} + 1 THEN 0 ELSE 1 END"))
    numbered = marked.withColumn("run", F.expr("sum(opens) OVER (PARTITION BY id, th ORDER BY first, last ROWS UNBOUNDED PRECEDING)"))
    return numbered.groupBy("id", "th", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, text without later repeated runs, n_lines, removed_lines (numbers from 0).

    See repeated_runs for what a run is.  Blank lines inside a run go with it.
    A deleted line always has an equal line (by 128-bit digest) at an earlier place.  A null text counts as empty and stays '';
    a null id comes before all others; rows equal in id and text are one
    document and get the same result; of texts with one id the order is that of their MD5.  The lines of a very long text are handled in one
    task, row by row.  An empty table gives no rows; other columns are ignored.
    """
    runs = repeated_runs(docs, min_words, id_col, text_col).groupBy("id", "th").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    runs = runs.select(F.col("id").alias("run_id"), F.col("th").alias("run_th"), "runs")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("th", F.unhex(F.md5("text")))
    joined = rows.join(runs, F.col("id").eqNullSafe(F.col("run_id")) & (F.col("th") == F.col("run_th")), "left")
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))))
    joined = joined.withColumn("removed_lines", F.coalesce(gone, F.array().cast("array<int>")))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.exists("runs", lambda r: i.between(r["first"], r["last"])))
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(F.col("id").alias(id_col), text.alias("text"), F.size(F.split("text", "\n")).alias("n_lines"), "removed_lines")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its lines, those removed as later repeats of runs of MIN_WORDS words, and the SHA-256 of what is left."""
    return line_dedup(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines",
        F.size("removed_lines").alias("n_removed"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"),
        F.sha2("text", 256).alias("text_sha256"),
    )


_LINE_WORDS = r"len(list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda w: w <> ''))"
SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), c AS (
  SELECT doc_id, pos, s, w, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto
  FROM (SELECT doc_id, pos, s, {_LINE_WORDS} AS w FROM (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s FROM l) WHERE s <> '')
), win AS (
  SELECT doc_id, pos AS first, max(pos) OVER f AS last, list(s) OVER f AS body, sum(w) OVER f AS words
  FROM c WINDOW f AS (PARTITION BY doc_id ORDER BY upto - w RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
  UNION
  SELECT doc_id, min(pos) OVER b, pos, list(s) OVER b, sum(w) OVER b
  FROM c WINDOW b AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)
), m AS (
  SELECT doc_id, first, last, min(doc_id) OVER (PARTITION BY body) AS doc0,
         first_value(first) OVER (PARTITION BY body ORDER BY doc_id, first) AS first0
  FROM win WHERE words >= {MIN_WORDS}
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM m JOIN l ON l.doc_id = m.doc_id AND l.pos BETWEEN m.first AND m.last
  WHERE m.doc_id > m.doc0 OR m.first > m.first0
)
SELECT l.doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(gone.pos) AS INTEGER) AS n_removed,
       coalesce(string_agg(CAST(gone.pos AS VARCHAR), ',' ORDER BY l.pos) FILTER (gone.pos IS NOT NULL), '') AS removed_lines,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '')) AS text_sha256
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id
"""
