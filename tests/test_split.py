"""One large document read by several tasks equals the document read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pumpwise.sources import raw as R
from pumpwise.sources.split import split_json_list

ELEMENT = "struct<id: bigint, s: string, sub: struct<a: int, b: array<struct<c: string>>>, tags: array<string>>"
TEXTS = ["plain", "a}b", "{", "}{", '"', '\\"}', "\\", "[{]", "é\U0001f600", ",{", "", "x" * 300, '":[{', "\n}\n"]


def element(rng, i):
    out = {"id": i, "s": "".join(rng.choices(TEXTS, k=rng.randint(0, 3)))}
    if rng.random() < 0.6:
        out["sub"] = {"a": i % 7, "b": [{"c": rng.choice(TEXTS)} for _ in range(rng.randint(0, 3))]}
    if rng.random() < 0.4:
        out["tags"] = rng.choices(TEXTS, k=2)
    return out


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("key, indent", [(None, None), (None, 2), ("value", None), ("value", 1)])
def test_split_equals_whole(spark, tmp_path, small_blocks, key, indent):
    rng = random.Random(1)
    for n, count in enumerate((700, 1, 0, 60)):
        listed = [element(rng, 1000 * n + i) for i in range(count)]
        other = {"note": 'a "value": [{ }', "meta": {"value": "no", "x": {"y": [{"c": 1}]}}, "before": [element(rng, -i) for i in range(5)]}
        doc = listed if key is None else {**other, key: listed, "after": [{"id": -1}], "end": {}}
        (tmp_path / f"d{n}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=n % 2 == 0))
    path = str(tmp_path / "*.json")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))
    want = R.json_list(whole, ELEMENT, [key] if key else [], root=key is None)
    show = lambda df: sorted((r["path"], r["row_ord"], str(r["x"])) for r in df.collect())
    got = split_json_list(spark, path, ELEMENT, key)
    assert show(got) == show(want) and len(show(want)) == 761
    tasks = spark.read.option("lineSep", "}").text(path).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 20


def test_edges(spark, tmp_path):
    for n, text in enumerate(("", "[]", "{}", '{"value": []}', "[1, 2]", "no json", '{"value": {"id": 1}}')):
        (tmp_path / f"{n}.json").write_text(text)
    assert split_json_list(spark, str(tmp_path), ELEMENT, "value").count() == 0
    assert split_json_list(spark, [str(tmp_path / f"{n}.json") for n in (0, 1, 4, 5)], ELEMENT).count() == 0
