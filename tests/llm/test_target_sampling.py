"""Resampling towards a target against a plain computation, and its edge cases."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulario.llm import target_sampling as T

SMALL = T.Settings(buckets=97, least_words=3, percent=30)


def plain(docs, target, s):
    """Every (id, n_features, weight, score, rank) computed in one process."""
    def features(t):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out = [" ".join(ws[i:i + n]) for n in range(1, s.longest + 1) for i in range(len(ws) - n + 1)]
        return [zlib.crc32(f.encode()) % s.buckets for f in out], len(ws)

    raw, good = Counter(), Counter()
    for _, t in docs:
        raw.update(features(t)[0])
    for t in target:
        good.update(features(t)[0])
    gain = lambda b: math.floor(1000 * math.log((good[b] + 1) * (raw.total() + s.buckets) / ((raw[b] + 1) * (good.total() + s.buckets))))
    rows = []
    for i, t in docs:
        f, n = features(t)
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, n >= s.least_words and i is not None])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0], r[1]))
    k = len(able) * s.percent // 100
    rank = {id(r): p + 1 for p, r in enumerate(able[:k])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TARGET = ["red fox jumps", "the red red fox", None, ""]


@pytest.mark.parametrize("longest", [1, 3])
def test_against_plain(spark, longest):
    words = ["red", "Fox", "jumps", "over", "ñandú", "x1", "日本", "the"]
    docs = [(i * 7 % 101, " ".join(words[(i * j + j) % 8] + "-," for j in range(i % 11))) for i in range(101)]
    s = T.Settings(longest=longest, buckets=97, least_words=3, percent=30)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert got(T.report(df, target, s)) == plain(docs, TARGET, s)


def test_odd_texts(spark, odd_docs):
    """Null, empty, very long and repeated texts, a null id, clashing columns: `score` and `rank` are columns already."""
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    df = odd_docs.withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    out = T.report(df, target, SMALL)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert got(out) == plain(docs, TARGET, SMALL)


def test_ties_and_repeated_rows(spark):
    """Copies of one row share a score; as many as fit are drawn, in successive ranks."""
    docs = [(5, "red fox the end")] * 40 + [(6, "other words in it")] * 3
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    out = T.report(spark.createDataFrame(docs, "doc_id long, text string"), target, SMALL).where("rank is not null")
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 43 * 30 // 100 + 1))


def test_cutoff_by_bisection_among_equal_scores(spark):
    """With scores that nearly all tie, the smaller ids are drawn."""
    rows = spark.range(1000).select(F.col("id").alias("_id"), F.lit(3).cast("long").alias("n_features"),
                                    F.when(F.col("id") >= 990, 8).otherwise(7).cast("long").alias("score"), F.lit(True).alias("able"))
    out = {r["_id"]: r["rank"] for r in T.draw(rows, 25, T.Settings()).where("rank is not null").collect()}
    assert out == {i: n + 1 for n, i in enumerate([*range(990, 1000), *range(15)])}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert T.report(none, some, SMALL).count() == 0
    assert got(T.report(some, none, SMALL)) == plain([(1, "a b c d e")], [], SMALL)
