import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobloom.functions import clean_text, text
from jobloom.sources import readers

PIECES = [
    *"abZ09_ \t\n\r\x0b\f.!?<>,;-'",
    "wörter ", "naïve été ", "ΣΑΣ ", "İstanbul ", "слово ", "中文字 ", "عربي ", "é ", " ", " ", "½ ", "Ⅷ ",
    "\U0001f600", "\U00020000 ", "\U0001f130", "ࡰ", "\U0002ebf0", "￾", "one two three four. ", "<b>", "</b>", "x.<i>", "a.\n\n b", "...  ",
]


def both(spark, values, min_tokens):
    """What the cleaner makes of each text, and what the regular expressions that state the rule make of it."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").coalesce(2)
    found = df.select("i", text.cleaner(min_tokens)(F.col("x")).alias("a"), text._cleaned(F.lower("x"), min_tokens).alias("b"))
    return [(r["a"], r["b"]) for r in found.orderBy("i").collect()]


@pytest.mark.parametrize("min_tokens", [0, 1, 2, 4])
def test_batches_are_cleaned_by_the_rule(spark, min_tokens):
    random.seed(min_tokens)
    values = ["".join(random.choices(PIECES, k=random.randrange(40))) for _ in range(3000)]
    values += [None, "", " ", "<", ">", "<>", "a<", "a>b", "<a><b>c", "< a\n. b > c d e f", "a b c d.", ". a b c d", "a b c d\te f g h\n", "ab" * 300_000, "a b c d. " * 60_000]
    random.shuffle(values)
    found = both(spark, values, min_tokens)
    assert [a for a, _ in found] == [b for _, b in found]
    assert any(a for a, _ in found) and any(a is None for a, _ in found)


def test_every_character_is_classed_as_spark_does(spark):
    points = [p for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000]
    values = ["".join(f"a{chr(p)}b " for p in points[k : k + 64]) for k in range(0, len(points), 64)]
    assert [a for a, b in both(spark, values, 1) if a != b] == []


def test_chunks_and_slices():
    texts = pa.array(["skipped", None, "a b.", "", "c d\ne", "é f", "ŧࡰ"])[1:]
    assert clean_text.clean_batch(texts, 1).to_pylist() == [None, "a b", None, "c d\te", "é f", clean_text.UNSURE]
    assert clean_text.clean_batch(texts[:0], 1).to_pylist() == []
    assert clean_text.clean_batch(pa.array([None, None], pa.string()), 1).to_pylist() == [None, None]
    whole = pa.array([f"w{i} x. y <z> é" * (i % 7) for i in range(200)])
    want, clean_text.CHUNK = clean_text.clean_batch(whole, 2), 50
    try:
        assert clean_text.clean_batch(whole, 2).equals(want)
    finally:
        clean_text.CHUNK = 1 << 18


def test_records_clean_each_text_once_and_in_batches(spark):
    raw = spark.createDataFrame(
        [("u?jk=1", "t", "Four words <b>stand</b> here! no. ", "c", "1", ["a", "b"]), ("v", "t", "too short", "c", "2", ["a"]), ("w", "t", None, "c", "3", None)],
        readers.RAW_JOB_SCHEMA,
    )
    out = readers.job_records(raw, text.cleaner(4)).withColumn("content", F.md5("content"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    kept = readers.job_records(raw, text.cleaner(4)).select("url", "content", "category", "section").collect()
    assert [tuple(r) for r in kept] == [("u?jk=1", "four words stand here", "a", "b")]
