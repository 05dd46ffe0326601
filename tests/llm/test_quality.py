import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulario.llm import compression_rules as C
from tabulario.llm import importance as I
from tabulario.llm import toxicity as T

VOCABULARY = ["".join(random.Random(i).choices("abcdefghij", k=random.Random(i).randint(2, 9))) for i in range(900)]


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def plain_facts(text):
    """The base columns, written the slow way."""
    words = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f\x85\xa0") else [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if __import__("re").search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_base_columns(spark, odd_docs):
    texts = ["a b c a b c", "x\nx\n \nx\ny", "a a a a", "#*$ %&|<> ", "one two three four", prose(1, 60)]
    short = odd_docs.where("length(coalesce(text, '')) < 1000").unionByName(
        spark.createDataFrame([(100 + i, t, "n", 0) for i, t in enumerate(texts)], odd_docs.schema))
    rows = C.report(short).collect()
    for r, source in zip(rows, short.collect()):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_facts(source["text"] or "")
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
        assert r["doc_id"] == source["doc_id"]


def test_bands_reject_repetition_and_noise_only(spark):
    rng = random.Random(9)
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(9)) for _ in range(400))
    texts = {"clean": prose(2), "long": prose(3, 5000), "noise": noise,
             "list": "".join(f"{a} and {b} " for a in range(40) for b in ("item", "entry", "row")) * 1,
             "tail": prose(4, 700) + " " + " ".join(f"x{i % 2}{i // 90}" for i in range(6000))}
    rows = {r["doc_id"]: r for r in C.report(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert rows["clean"]["kept"] and rows["long"]["kept"] and rows["long"]["n_chunks"] > 3
    assert not rows["noise"]["kept"] and not rows["noise"]["base_failed"]
    assert not rows["tail"]["kept"]
    judged = C.judge(spark.createDataFrame([(1, texts["clean"], "q")], "doc_id long, text string, quality string"))
    assert judged.columns == ["doc_id", "text", "quality"] and judged.where("quality.kept").count() == 1


@pytest.mark.parametrize("size", [1_100, 10_000, 50_000])
def test_incompressible_words_are_rejected_beside_clean_ones(spark, size):
    rng = random.Random(size)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = lambda alphabet: " ".join("".join(rng.choices(alphabet, k=rng.randint(4, 12))) for _ in range(size // 9))
    clean = prose(size, size // 6)
    texts = {"clean": clean, "base64": words(letters + letters.upper() + "0123456789+/"), "letters": words(letters)}
    texts["part"] = clean + " " + words(letters)[:len(clean) // 4]  # a fifth of a long text is noise
    rows = {r["doc_id"]: r for r in C.report(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert rows["clean"]["kept"] and not any(r["base_failed"] for r in rows.values())
    assert not rows["base64"]["kept"] and not rows["letters"]["kept"]
    assert size < 10_000 or not rows["part"]["kept"]


@pytest.fixture(scope="module")
def corpus(spark):
    good = [(i, prose(i)) for i in range(300)]
    bad = [(1000 + i, " ".join(f"{w}*** $$$ |" for w in prose(2000 + i, 80).split())) for i in range(60)]
    return spark.createDataFrame(good + bad, "doc_id long, text string").repartition(5)


def test_importance_keeps_good_and_drops_bad(spark, corpus):
    good = spark.range(0, 150).withColumnRenamed("id", "doc_id")
    s = I.Settings()
    rows = I.report(corpus, good, s).collect()
    assert len(rows) == 360
    assert all(r["selected"] for r in rows if r["doc_id"] < 1000) and not any(r["selected"] for r in rows if r["doc_id"] >= 1000)
    k = sum(r["log_ratio"] >= s.floor for r in rows)
    assert sum(r["selected"] for r in rows) == k
    sampler = I.fit_sampler(corpus, good, s)
    kept = sampler.weigh(corpus.withColumn("importance", F.lit(1))).where("importance.selected")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["selected"])


def test_the_floor_follows_the_weights_of_good_texts(spark):
    """Junk above the least floor but far under all good texts is not drawn."""
    weights = [(i, 5 + random.Random(i).gauss(0, 1)) for i in range(400)] + [(1000 + i, -12.0 + i / 50) for i in range(100)]
    weighed = spark.createDataFrame(weights, "_key long, log_ratio double").withColumn("perturbed", F.col("log_ratio"))
    s = I.Settings()
    fitting, held = I.split(spark.range(0, 300).withColumnRenamed("id", "doc_id"), s)
    assert fitting.count() + held.count() == 300 and 30 <= held.count() <= 90 and fitting.join(held, "doc_id").count() == 0
    floor = I.floor_of(weighed, held, s, "_key")
    assert -5 < floor < 2 and I.draw(weighed, floor) == min(w for _, w in weights[:400])
    assert I.draw(weighed, s.floor) == -math.inf  # the constant keeps all of them
    assert I.floor_of(weighed, held.limit(0), s, "_key") == s.floor


def test_every_labelled_text_counts(spark):
    """More labels than any bound of old: the model counts each good text, the floor each one held back."""
    n = 120_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("text"))
    s = I.Settings(buckets=50, prior=10)
    keys = df.select("doc_id")
    model = I.fit(df, keys.where("doc_id % 3 > 0"), s)
    count = {side: np.bincount(np.r_[I.grams(["a"], 50)[0], I.grams(["b"], 50)[0]], [m, m], 50) for side, m in (("raw", n / 2), ("good", n / 3))}
    raw = (count["raw"] + 1) / (n + 50)
    assert model == pytest.approx(np.log((count["good"] + 10 * raw) / (2 * n / 3 + 10) / raw), rel=1e-12)
    fitting, held = I.split(keys, s)
    assert fitting.count() + held.count() == n and held.count() > 20_000
    weighed = df.select(F.col("doc_id").alias("_key"), F.rand(3).alias("log_ratio"))
    own = [r[0] for r in weighed.join(held, F.col("_key") == F.col("doc_id")).select("log_ratio").collect()]
    low, middle = np.quantile(own, [s.low, 0.5])
    assert I.floor_of(weighed, held, s, "_key") == pytest.approx(2 * low - middle, rel=1e-12)


def test_importance_by_hand(spark):
    """Counts and ratios against a plain computation."""
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (None, ""), (1, "a b a")], "doc_id long, text string")
    s = I.Settings(buckets=50, prior=10, temper=1, pad=0.5)
    model = I.fit(df, spark.createDataFrame([(1,)], "doc_id long"), s)
    counts = np.zeros((2, 50))
    for text, side in (("a b a", 1), ("a b a", 1), ("b c", 0)):
        for g in I.grams([text], 50)[0]:
            counts[1, g] += side
            counts[0, g] += 1
    raw = (counts[0] + 1) / (counts[0].sum() + 50)
    assert model == pytest.approx(np.log((counts[1] + 10 * raw) / (counts[1].sum() + 10) / raw))
    rows = I.report(df, spark.createDataFrame([(1,)], "doc_id long"), s).collect()
    got = sorted((r["log_ratio"] for r in rows), reverse=True)
    grams = I.grams(["a b a"], 50)[0]
    assert len(rows) == 5 and sorted(got)[0] <= 0 and model[grams].sum() / (len(grams) + 0.5) == pytest.approx(max(got))
    assert I.report(df.limit(0), df.select("doc_id"), s).count() == 0
    assert all(r["log_ratio"] == 0 for r in I.report(df, df.limit(0).select("doc_id"), s).collect())


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_kth_largest_is_exact(spark, k):
    rng = random.Random(k)
    values = [rng.choice([1.5, rng.random(), rng.random() * 1e9, 1e-9 * rng.random()]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert I.kth_largest(df, "v", k, bins=16, few=20) == sorted(values, reverse=True)[k - 1]


def test_gumbel_depends_on_the_key_alone(spark):
    df = spark.range(20_000).withColumn("g", I.gumbel("id", 7))
    mean, low = df.agg(F.avg("g"), F.min("g")).head()
    assert abs(mean - 0.5772) < 0.05 and low > -4
    assert df.repartition(7).agg(F.sum("g")).head()[0] == pytest.approx(df.agg(F.sum("g")).head()[0])


def test_toxicity_learns_words_and_beginnings(spark):
    bad = ["vilblox", "nastyrag", "grimtod"]
    docs, labels = [], []
    for i in range(900):
        words = prose(i, 60).split()
        toxic = i % 5 == 0
        if toxic:  # some words are toxic by their beginning alone
            words[random.Random(i).randrange(len(words))] = bad[i % 3] if i % 2 else f"krumpf{VOCABULARY[i]}"
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(5000, None), (5001, ""), (None, "x"), (5002, "vilblox " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    s = T.Settings(steps=150, buckets=1 << 15)
    rows = {r["doc_id"]: r for r in T.report(df, spark.createDataFrame(labels + labels[:9], "doc_id long, toxic int"), s).collect()}
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    held = [(rows[i]["predicted"], y) for i, y in labels if rows[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert rows[5002]["predicted"] == 1 and rows[5000]["predicted"] == rows[5001]["predicted"] == 0
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in rows.items() if k is not None)


def test_toxicity_without_labels_and_without_rows(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.report(df, none).head()["predicted"] in (0, 1) and T.report(df.limit(0), none).count() == 0


def test_filters_see_the_whole_text_and_no_neighbours():
    s = T.Settings(width=2, filters=1, spans=(1, 2), buckets=64)
    net = T.Network(s, np.full(64, 0), np.array([[1, 0], [0, 0]], np.float32), [np.ones((w, 2, 1), np.float32) for w in s.spans],
                    [np.zeros(1, np.float32)] * 2, np.ones(2, np.float32), 0.0)
    vectors = np.array([[1, 0], [3, 0], [-9, 0]], np.float32)
    code, sizes = np.array([0, 1, 2, 1, 0]), np.array([2, 0, 2, 1])
    top, where = net.maxima(vectors, code, sizes, places=True)
    assert top.tolist() == [[3, 4], [0, 0], [3, 3], [1, 1]]
    assert where[0].ravel().tolist() == [1, -1, 3, 4] and math.isclose(where[1][0][0], 0)


def test_toxicity_learns_from_all_labelled_rows(spark):
    """A toxic word that 1 in 500 labelled texts holds is known however many rows there are; none of them is left out."""
    docs = spark.range(4_000).selectExpr("id AS doc_id", "concat('word', id % 97, ' and word', id % 89, IF(id % 10 = 0, IF(id % 500 = 0, ' rarebad', ' vilblox'), ' fine')) AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 10 = 0) AS toxic")
    s = T.Settings(steps=20, buckets=1 << 12, rounds=2)  # more rows than one task takes
    rows = T.labelled(docs, labels, s, "doc_id", "text")
    assert rows.count() == 4_000 and 0 < rows.where("_held").count() < 2_000
    net, n = T.prepare(rows, s)
    assert n.tolist() == [rows.where(f"NOT _held AND _label = {k}").count() for k in (0, 1)]
    assert net.row_of[T.parts("rarebad", s)[0]] < len(net.embedding) - 1
    long = docs.withColumn("text", F.when(F.col("doc_id") == 10, F.repeat(F.lit("vilblox "), 20_000)).otherwise(F.col("text")))
    assert T.labelled(long, labels, s, "doc_id", "text").where("_key = 10").count() == 1  # long texts train as well
    held = T.report(docs, labels, s).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.97


def test_toxicity_cut_offs_over_many_ranges(spark):
    """The cut-off is the one with the best F1 over all held-back rows, wherever the ranges of logits end."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["bad", "mild", "good", "the", "le"], 6)) for _ in range(400)]
    y = [int(rng.random() < 0.2 * t.count("bad")) for t in texts]
    s = T.Settings(width=1, filters=1, spans=(1,), buckets=1 << 10)
    row_of = np.full(s.buckets, 3)
    for i, w in enumerate(("bad", "mild", "good")):
        row_of[T.parts(w, s)[0]] = i
    net = T.Network(s, row_of, np.array([[3], [2], [1], [0]], np.float32), [np.ones((1, 1, 1), np.float32)], [np.zeros(1, np.float32)], np.ones(1, np.float32), 0.0)
    rows = spark.createDataFrame([(i, t, v, True) for i, (t, v) in enumerate(zip(texts, y))], "_key long, _text string, _label int, _held boolean").repartition(5)
    T.calibrate(rows, net)
    logit, spoken = net.read([t.split() for t in texts])
    y = np.array(y)
    for i in range(2):
        own, hit = logit[spoken == i], y[spoken == i]
        levels = np.unique(own)[::-1]
        f1 = [2 * hit[own >= v].sum() / ((own >= v).sum() + hit.sum()) for v in levels]
        k = max(range(len(levels)), key=lambda j: (f1[j], j))
        want = (levels[k] + (levels[k + 1] if k + 1 < len(levels) else levels[k] - 1)) / 2
        if hit.sum() >= 3:
            assert math.isclose(math.log(0.7 / 0.3) - net.shift[i], want, abs_tol=1e-6)
