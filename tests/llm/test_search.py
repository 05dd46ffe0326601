import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulario.llm import near_duplicates as N
from tabulario.llm import permutation_index as P
from tabulario.llm import url_rules as U

# --- url rules


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):], re.S).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1, -1, "", ""), (len(rule), len(h), rule, verdict))
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules_against_all_pairs(spark):
    rng = random.Random(1)
    label, segment = ["a", "b", "ab", "com", "org", "x-y"], ["", "e", "en", "en/1", "é", "%20"]
    host = lambda: ".".join(rng.choice(label) for _ in range(rng.randint(1, 5)))
    rules = list({r: v for r, v in (((host() + rng.choice(["", "/", "/en", "/en/1", "/e"])), rng.choice(["allow", "block"])) for _ in range(80))}.items())
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{host().upper() if i % 3 else host()}{rng.choice(['', '/'])}{rng.choice(segment)}{rng.choice(['', '?q=/en', '#/en'])}"
            for i in range(400)] + [None, "", "no scheme/a", "://", "http://", "http:///en", "a://b://c/en"] + ["http://hot.a.com/en/1"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("old")).withColumn("_host", F.lit(1))
    table = spark.createDataFrame(rules + [(None, "block"), ("a/", None)], "rule string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in U.report(pages, table).collect()}
    assert got == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}


def test_url_rules_ties_empty_tables_and_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", 5), (1, "http://a.b/c", 6)], "page_id long, url string, url_verdict int")
    rules = spark.createDataFrame([("b/", "allow"), ("b/", "block")], "rule string, verdict string")
    out = U.judge(pages, rules)
    assert out.columns == pages.columns and [r["url_verdict"]["verdict"] for r in out.collect()] == ["block", "block"]
    none = rules.limit(0)
    assert {r["verdict"] for r in U.report(pages, none, default="block").collect()} == {"block"}
    assert U.report(pages.limit(0), rules).count() == 0


# --- near duplicates

WORDS = [f"w{i}" for i in range(5000)]


def edited(words, share, rng):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


def plain_components(docs):
    sets = []
    for _, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        n = min(5, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and docs[i][0] is not None and docs[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = collections.defaultdict(lambda: 10 ** 9)
    for i, (k, _) in enumerate(docs):
        least[find(i)] = min(least[find(i)], 10 ** 9 if k is None else k)
    return [(k, len(s), None if k is None else least[find(i)], k is None or least[find(i)] == k) for i, ((k, _), s) in enumerate(zip(docs, sets))]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(2)
    docs = []
    for _ in range(25):  # groups of copies, near copies and chains
        base = [rng.choice(WORDS) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 6)):
            docs.append(" ".join(edited(base, rng.choice([0, 0.01, 0.02, 0.04]), rng)))
            if rng.random() < 0.3:
                docs.append(docs[-1].upper())
    passage = [rng.choice(WORDS) for _ in range(80)]
    docs += [" ".join(passage + [rng.choice(WORDS) for _ in range(60)]) for _ in range(60)]  # share much, are no copies
    docs += ["", "   ", None, "one two", "One  two", "one two three", "a", "b"]
    rng.shuffle(docs)
    rows = [(i, t) for i, t in enumerate(docs)] + [(None, docs[0]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("rep", F.lit(1)).repartition(6)
    got = sorted((tuple(r) for r in N.find(df).collect()), key=str)
    assert got == sorted(plain_components(rows), key=str)


@pytest.mark.parametrize("rounds, block", [(0, 4000), (2, 1 << 20)])
def test_a_large_group_with_outliers(spark, rounds, block):
    """Many like and some unlike documents in one cluster, in one block or in many: no two similar ones stay apart."""
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(150)]
    docs = [(i, " ".join(edited(base, 0.01, rng))) for i in range(120)] + [(500 + i, " ".join(edited(base, 0.05, rng))) for i in range(40)]
    got = sorted(tuple(r) for r in N.find(spark.createDataFrame(docs, "doc_id long, text string"), N.Settings(rounds=rounds, block=block)).collect())
    assert got == sorted(plain_components(docs))


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.find(empty).count() == 0
    twice = spark.createDataFrame([(1, "same words here now yes"), (1, "same words here now yes"), (2, "other")], "doc_id long, text string")
    assert sorted(tuple(r) for r in N.find(twice).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True)]


def test_registers_merge_and_estimate():
    s = N.Settings()
    rng = np.random.default_rng(0)
    both, left, right = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (600, 200, 100))
    a, b = np.union1d(both, left), np.union1d(both, right)
    r = N.sketch([a, b, np.union1d(a, b), np.zeros(0, np.uint64)], s)
    assert (np.maximum(r[0], r[1]) == r[2]).all() and not r[3].any()
    estimate, error = N.joint_estimate(r[:1], r[1:2], np.array([len(a)], float), np.array([len(b)], float), s.base)
    assert abs(estimate[0] - 600 / 900) < 4 * error[0]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {k: v for k, v in root.items() if k != v}


# --- nearest neighbours


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:160] = x[100]  # copies tie
    rows = [(i, v.tolist(), "old") for i, v in enumerate(x)]
    rows += [(9000, None, ""), (9001, [0.0] * 16, ""), (9002, [1.0] * 15 + [None], ""), (9003, [float("nan")] * 16, ""), (9004, [1.0], ""), (9020, [float("inf")] * 16, "")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_recall_and_exact_scores(vectors):
    asked = vectors.where("vec_id % 20 = 0")
    rows = P.nearest(vectors, asked, settings=P.Settings(pivots=64, places=16, share=0.35, least=40, block=400, queries=30)).collect()
    good = {r["vec_id"]: np.array(r["embedding"]) for r in vectors.where("vec_id < 9000").collect()}
    ids, x = np.array(list(good)), np.stack(list(good.values()))
    found = collections.defaultdict(list)
    for r in rows:
        found[r["query_id"]].append(r)
    assert set(found) == {i for i in good if i % 20 == 0}
    hits = 0
    for q, answers in found.items():
        answers.sort(key=lambda r: r["rank"])
        score = (x * good[q]).sum(1)
        others = ids != q
        order = ids[others][np.lexsort((ids[others], -score[others]))][:20]
        assert [r["rank"] for r in answers] == list(range(1, 21)) and q not in {r["vec_id"] for r in answers}
        assert all(r["score"] == score[r["vec_id"]] for r in answers)
        assert [(-r["score"], r["vec_id"]) for r in answers] == sorted((-r["score"], r["vec_id"]) for r in answers)
        hits += len(set(order) & {r["vec_id"] for r in answers})
    assert hits / (20 * len(found)) > 0.9
    copies = [r["vec_id"] for r in found[100]]
    assert copies == list(range(101, 121))  # ties go to smaller ids


def recalls(df, asked, k=20):
    """Of each query the share of its k nearest that is found at production settings."""
    ids, x = map(np.array, zip(*((r["vec_id"], r["embedding"]) for r in df.collect())))
    found = collections.defaultdict(set)
    for r in P.nearest(df, asked, k).collect():
        found[r["query_id"]].add(r["vec_id"])
    out = []
    for q in np.flatnonzero(np.isin(ids, [r["vec_id"] for r in asked.collect()])):
        score = (x * x[q]).sum(1)
        order = [i for i in ids[np.lexsort((ids, -score))] if i != ids[q]][:k]
        out.append(len(found[ids[q]] & set(order)) / k)
    return np.array(out)


def test_recall_at_production_settings(spark):
    x = np.random.default_rng(4).normal(size=(2000, 64))  # as near to uniform as the given vectors: the hardest case
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = recalls(df, df.where("vec_id % 20 = 0"))
    assert len(found) == 100 and found.mean() >= 0.9 and found.min() >= 0.7


def test_recall_beside_a_hot_vector(spark):
    """Copies and near copies of one vector take no places from others, and are told apart among themselves."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:800] = x[0]
    x[800:1200] = x[0] + rng.normal(size=(400, 64)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    others = recalls(df, df.where("vec_id >= 1200 AND vec_id % 12 = 0"))
    assert others.mean() >= 0.9 and others.min() >= 0.7
    assert recalls(df, df.where("vec_id < 1200 AND vec_id % 60 = 0")).min() == 1
    hot = df.where("vec_id < 800").unionByName(df.where("vec_id = 5"))  # a key twice, a query that is itself a copy
    assert [r["vec_id"] for r in P.nearest(hot, df.where("vec_id = 3")).orderBy("rank").collect()] == [0, 1, 2, 4, 5, 5, *range(6, 20)]


def test_every_block_meets_every_query_in_many_partitions(spark, vectors):
    df = vectors.where("vec_id < 1500")
    asked = df.where("vec_id % 25 = 0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = P.nearest(df, asked, settings=P.Settings(block=300, queries=20)).collect()  # every block is ranked whole or nearly
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()])
    found = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        found[r["query_id"]].append(r["score"])
    for q in range(0, 1500, 25):
        assert found[q] == pytest.approx(np.sort(np.delete(x @ x[q], q))[::-1][:20])


def test_few_candidates_and_none(vectors):
    few = vectors.where("vec_id < 5")
    rows = P.nearest(few, few.where("vec_id = 0")).collect()
    assert sorted(r["vec_id"] for r in rows) == [1, 2, 3, 4]
    assert P.nearest(few.limit(0), few).count() == 0 and P.nearest(few, few.limit(0)).count() == 0


def test_footrule_of_files_orders_rows_as_the_definition():
    rng = np.random.default_rng(8)
    orders = np.stack([rng.permutation(40)[:25] for _ in range(60)])
    where = np.full((60, 40), 25)
    for row, order in zip(where, orders):
        row[order] = np.arange(25)
    files = P.posted(orders, 40)
    for q in (0, 7):
        want = np.abs(where - where[q]).sum(1)
        got = P.footrule(files, orders[q]).astype(int)
        assert len(set((2 * got - want).tolist())) == 1  # equal but for a constant of the query
