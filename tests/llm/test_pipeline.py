import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP

VOCABULARY = ["".join(random.Random(i).choices("abcdefghij", k=random.Random(i).randint(2, 9))) for i in range(900)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    def prose(seed, n=120):
        rng = random.Random(seed)
        return " ".join(rng.choice(VOCABULARY) for _ in range(n))

    rows = [(i, prose(i)) for i in range(200)]
    rows += [(300 + i, prose(i) + " end") for i in range(20)]  # near copies
    rows += [(400, "too short"), (401, None), (402, ""), (403, "spam " * 300), (404, prose(7777) + " mail joe@corp.org or 81.92.3.4")]
    rows += [(500 + i, " ".join(w + "*#%&"[len(w) * j % 4] * 3 for j, w in enumerate(prose(900 + i, 80).split()))) for i in range(30)]
    rows += [(1, prose(1)), (1, prose(1))]  # repeated rows
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x") for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept string")
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(CP.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            seen[name] = sorted(r["doc_id"] for r in docs.collect())
    clean = [*range(200), 1, 1, *range(300, 320), 404]
    assert set(seen["quality rules"]) == {*clean, *range(500, 530)} and len(seen["quality rules"]) == len(clean) + 30
    assert seen["quality classifier"] == sorted(clean)
    assert seen["near deduplication"] == [*range(200), 404]
    masked = spark.read.parquet(f"{tmp_path}/3").where("doc_id = 404").head()
    assert masked["text"].endswith("mail <email> or <ip>") and masked["n_chars"] == len(masked["text"])
    pieces = spark.read.parquet(f"{tmp_path}/4")
    assert {r["doc_id"] for r in pieces.collect()} == {*range(200), 404}
    ran = CP.run(spark, folder)
    assert sorted(map(tuple, ran.drop("sequence_id", "offset").collect())) == sorted(map(tuple, pieces.drop("sequence_id", "offset").collect()))
    assert ran.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


def test_an_empty_corpus(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert CP.run(spark, str(tmp_path)).count() == 0
