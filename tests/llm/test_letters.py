"""What is a letter to the language operator: code points above the basic plane, marks; executors without this package."""

import os
import subprocess
import sys
import unicodedata
from pathlib import Path

import pytest

from pumpwise.llm import langid
from pumpwise.llm.common import read_table

SF = "/root/testdata/sf0.01"


def test_emoji_and_marks_alone_have_no_language(spark):
    model = langid.learn_languages(read_table(spark, SF, "documents"))
    en = "the and of hendor thionin stereding"
    texts = [(1, "\U0001f600 12 \U0001f680\U0001f680"), (2, "́ ́̈ 7"), (3, f"\U0001f600{en}\U0001f680"), (4, "\U00020000\U0001d400")]
    rows = langid.identify_languages(spark.createDataFrame(texts, "doc_id int, text string"), model).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["spans"]) for r in rows}
    assert got[1] == got[2] == ("und", 0.0, "")
    assert got[3] == ("en", 1.0, f"en:1:{1 + len(en)}")
    assert got[4][0] in model.names and got[4][2].endswith(":0:2")


def test_marks_continue_words_only():
    words = langid.words_of_texts(["́ab é̈t ́ x", "̈ý"], langid._letters())
    assert list(zip(words.text, words.start, words.start + words.length)) == [(0, 1, 3), (0, 4, 8), (0, 11, 12), (1, 1, 3)]


@pytest.mark.parametrize("text", ["हिन्दी में लिखा है", "தமிழ் மொழி எழுத்து", "ภาษาไทยที่นี่ สวัสดี", "İstanbul x\u0301y \u0301 कि1की"])
def test_words_with_vowel_signs(text):
    """Runs of letters with the marks after them, by a plain loop."""
    text, words, at = text.lower(), [], None
    for i, c in enumerate([*text, "\n"]):
        kind = unicodedata.category(c)
        if kind[0] == "L" or at is not None and kind in ("Mn", "Mc"):
            at = i if at is None else at
        elif at is not None:
            words, at = [*words, (at, i)], None
    got = langid.words_of_texts([text], langid._letters())
    assert list(zip(got.start, got.start + got.length)) == words


ON_BARE_EXECUTORS = """
import sys
sys.path.append({repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.memory", "2g").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
def lacks(_):
    try:
        import pumpwise
    except ImportError:
        return 1
    return 0
print("lacking", spark.sparkContext.parallelize([0], 1).map(lacks).sum())
from pumpwise.llm.queries import QUERIES
for name in {names!r}:
    print(name, QUERIES[name](spark, {sf!r}).count())
import corpus_pipeline
print("pipeline", corpus_pipeline.run(spark, {sf!r}).count())
"""


def test_executors_without_the_package(tmp_path):
    """Python of all operators is pickled by value: with the repository on the driver's path only, from another folder, they run."""
    names = ["op2_quality", "op3_secrets", "op5_simhash", "op7_langid", "op11_html_text", "op12_hard_negatives", "op13_periodic_runs"]
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = ON_BARE_EXECUTORS.format(repo=repo, names=names, sf="/root/testdata/sf0.001")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    got = dict(line.split() for line in done.stdout.splitlines() if line)
    assert got["lacking"] == "1" and {*names, "pipeline"} < set(got) and all(int(n) > 0 for n in got.values())
