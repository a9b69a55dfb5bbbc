"""Ordered keyword rules, too many for one expression: texts are joined to an index that holds each keyword under its rarest piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pumpwise.staging import staged

#: Characters of a piece, and of the blocks that a text is cut into, so that a long text's pieces are never one array.
WIDTH, BLOCK = 4, 8192


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def _pieces(text: Column) -> Column:
    """What of up to WIDTH characters begins at each place of a text, each once."""
    full = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{WIDTH}}}))"), F.lit(1)))
    begun = F.transform(full, lambda g: F.array(*(F.substring(g, 1, n) for n in range(1, WIDTH)), g))
    return F.array_distinct(F.flatten(begun))


def _text_pieces(texts: DataFrame) -> DataFrame:
    """digest, piece of texts (digest, text); a piece may come once for each block that holds it."""
    block = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{1,{BLOCK + WIDTH - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    return texts.select("digest", F.explode(block).alias("block")).select("digest", F.explode(_pieces(F.col("block"))).alias("piece"))


def _indexed(rules: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rules with the one of their keyword's pieces that fewest texts hold; a keyword with a piece that no text holds goes.

    A keyword shorter than a piece is its own piece.  Written out, as are the rules' pieces, so that Spark knows their size when it plans the joins with texts.
    """
    length = F.length("keyword")
    own = F.when(length < WIDTH, F.array("keyword")).otherwise(F.filter(_pieces(F.col("keyword")), lambda g: F.length(g) == WIDTH))
    of_rule = staged(rules.where(length > 0).select("keyword", "first", F.size(own).alias("n"), F.explode(own).alias("piece")))
    held = pieces.join(of_rule.select("piece"), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("texts"))
    rarest = of_rule.join(held, "piece").groupBy("keyword").agg(
        F.min_by("piece", F.struct("texts", "piece")).alias("piece"), F.first("first").alias("first"), F.first("n").alias("n"),
        F.count(F.lit(1)).alias("found")
    )
    return staged(rarest.where("found = n").select("keyword", "first", "piece"))


def by_keyword_table(
    df: DataFrame, text: str, rules: DataFrame, name: str, keyword: str = "keyword", value: str = "value", order: str = "rule_ord"
) -> DataFrame:
    """df with name: the value of the first rule, by order, whose keyword occurs in the text, upper and lower case alike; null without one.

    The same as lookup.by_keyword for a table of any number of rules.  A keyword that occurs in a text has all its pieces there, so texts and rules are joined on
    the keyword's rarest piece, counted over all texts; whether the whole keyword occurs decides then.  Texts are read once to count, once to
    find candidates (their digests and pieces travel, not they; with an index below the broadcast threshold only those that it holds) and once to decide; equal
    texts are looked up as one.  The index is built while the plan is.

    A null text has no value; the empty keyword occurs in every other.  Rules without a keyword or an order are none; of rules with one
    order the least keyword counts, of equal rules the least value.  No rules, no values; all rows and columns of df stay, but for one called name.
    """
    df = df.select(*(f"`{c}`" for c in df.columns if c != name or c == text))
    digest = _free(df, "__digest")
    lowered = F.lower(F.col(f"`{text}`"))
    keyed = df.withColumn(digest, F.unhex(F.sha2(lowered, 256)))
    texts = df.where(F.col(f"`{text}`").isNotNull()).select(F.unhex(F.sha2(lowered, 256)).alias("digest"), lowered.alias("text"))
    first = F.struct(F.col(f"`{order}`").alias("ord"), F.lower(F.col(f"`{keyword}`")).alias("keyword"), F.col(f"`{value}`").alias("value"))
    usable = rules.where(F.col(f"`{keyword}`").isNotNull() & F.col(f"`{order}`").isNotNull()).select(first.alias("first"))
    distinct = usable.groupBy(F.col("first.keyword").alias("keyword")).agg(F.min("first").alias("first"))
    pieces = _text_pieces(texts)
    index = _indexed(distinct, pieces)
    # A semi-join first: it never builds on the side of the texts, whose pieces are many times what Spark expects of their file.
    candidates = pieces.join(index.select("piece"), "piece", "left_semi").join(index, "piece").select("digest", "keyword", "first").distinct()
    hits = texts.join(candidates, "digest").where(F.contains("text", "keyword")).groupBy("digest").agg(F.min("first").alias("hit"))
    always = distinct.where("keyword = ''").agg(F.min("first").alias("__always"))  # one row
    out = keyed.join(hits.select(F.col("digest").alias("__hit_digest"), F.col("hit").alias("__hit")), F.col(digest) == F.col("__hit_digest"), "left")
    out = out.join(F.broadcast(always), F.lit(True))
    found = F.when(F.col(digest).isNotNull(), F.least("__hit", "__always"))
    return out.select(*(f"`{c}`" for c in df.columns if c != name), found["value"].alias(name))
