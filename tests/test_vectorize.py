"""Counts of n-grams in Arrow kernels, and partitions of narrow tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from merchlens.operators import vectorize as V
from merchlens.plans import standins

TEXTS = ["le petit chat et le chat", None, "", "a b", "Été_1 été_1  ½x \U0001f600ab \U0001f600ab", "ab  ab\n\nab", "le petit chien"]


def grams(text: str, analyzer: str, lo: int, hi: int) -> list[str]:
    if analyzer == "word":
        units, sep = re.findall(r"\w{2,}", text), " "
    else:
        units, sep = list(re.sub(r"\s\s+", " ", text)), ""
    return [sep.join(units[i : i + n]) for n in range(lo, hi + 1) for i in range(len(units) - n + 1)]


@pytest.mark.parametrize("analyzer, sizes", [("word", (1, 3)), ("word", (2, 2)), ("char", (3, 5))])
@pytest.mark.parametrize("chunk, most", [(8, 2), (1 << 20, 1 << 20)])
def test_counts_and_vectors_equal_brute_force(spark, monkeypatch, analyzer, sizes, chunk, most):
    monkeypatch.setattr(V, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(V, "MOST_TERMS", most)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").coalesce(1)
    made = [Counter(grams(t or "", analyzer, *sizes)) for t in TEXTS]
    vectorizer = V.Vectorizer(kind="count", analyzer=analyzer, ngram_range=sizes, min_df=1, max_df=1.0, max_features=1000)
    stats = vectorizer.term_statistics(df, "text")
    assert "Generate" not in stats._jdf.queryExecution().toString()  # no row per n-gram
    tf, holds = sum(made, Counter()), Counter(t for m in made for t in m)
    assert {r["term"]: (r["tf"], r["df"]) for r in stats.collect()} == {t: (n, holds[t]) for t, n in tf.items()}
    fitted = vectorizer.fit(df, "text")
    for r in fitted.transform(df, "text", "v").collect():
        assert r["v"].size == len(fitted.terms)
        assert {fitted.terms[i]: x for i, x in zip(r["v"].indices, r["v"].values)} == made[r["id"]]


def test_tasks_of_narrow_tables_have_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(standins, "TASK_ROWS", 100)
    spark.range(5000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    part = standins.table(spark, str(tmp_path), "part")
    sizes = part.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 50 and max(r["count"] for r in sizes) <= 200 and sum(r["count"] for r in sizes) == 5000
