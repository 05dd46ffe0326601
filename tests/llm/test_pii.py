import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulario.llm import pii

STATED = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(STATED) for m in re.finditer(p, text or "") if passes(k, m.group())]
    return [s for _, _, s in sorted(found)]


TEXTS = [None, "", "a@b.c@d.e x_y@z-1.co.uk", "😀 é me@x.org, 1.2.3.4.5.6.7.8 999.1.1.1 0001.02.003.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
         "+1 (614) 555-8001 +12 +1234567890123456", "1.2.3 4@5.6", "+4111111111111111 mail a@b.cd", "4111111111111111@x.yz",
         "n 1 2 3 4 5 6 7 8 9 0 1 2 3 4", "a" * 5000 + "@" + "b." * 3000 + "c", "1 " * 20_000, "1." * 20_000 + "1", "+1" + " " * 20_000, " x@y.zz" * 700]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, spans string").repartition(3)
    rows = pii.report(df).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        want = base(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), TEXTS[r["doc_id"]][:60]
        assert [r[f"n_{k}"] for k, _ in STATED] == [sum(s.startswith(k) for s in want) for k, _ in STATED]
        assert set(want) <= set(r["spans"].split(",")) | {""}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("1234567890.+-@ a()é😀_\n", max_size=60), min_size=20, max_size=20))
def test_any_text(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", pii.written(F.array_sort(F.filter(pii.all_candidates(F.col("t")), lambda c: c.strict & (c.form == 1)))).alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {i: ",".join(base(t)) for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def mixed(spark):
    rows = []
    for i in range(60):
        rows += [f"please call +1 (614) 555-{1000 + i} or mail a{i}@x.org today", f"host 81.92.3.{i} answers", f"version 3.{i} of order 12{i}4567890123456",
                 f"phone 614-555-{2000 + i} for more", f"write to ann{i} [at] shop [dot] com soon", f"card 4111.1111.1111.{1000 + i} was used",
                 f"serial=700-200-{3000 + i}x"]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_the_method_adds_spans_and_leaves_numbers_alone(mixed):
    rows = {r["doc_id"]: r["spans"] for r in pii.report(mixed).collect()}
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for i, spans in rows.items():
        kinds = [s.split(":")[0] for s in spans.split(",") if s]
        want = [["phone", "email"], ["ip"], [], ["phone"], ["email"], ["card"], []][i % 7]
        if i % 7 == 2:  # a passing check digit makes one in ten a base card
            assert spans == ",".join(base(texts[i]))
        else:
            assert kinds == want, (texts[i], spans)
    start, end = map(int, rows[4].split(":")[1:])
    assert texts[4][start:end] == "ann0 [at] shop [dot] com"


def test_reliabilities_tell_good_labelers_from_bad():
    rows = [(3, (0, 1, 1, 1), 80), (3, (0, 1, 0, 1), 10), (3, (-1, -1, -1, -1), 90), (3, (-1, 1, -1, -1), 10)]
    reliability, posterior = pii.expectation(rows)
    assert posterior[3, (0, 1, 1, 1)] > 0.9 > 0.1 > posterior[3, (-1, -1, -1, -1)]
    assert reliability[3, 2, 1, 1] > reliability[3, 2, 0, 1]
    assert all(abs(sum(reliability[3, j, y, v] for v in (-1, 0, 1)) - 1) < 1e-9 for j in range(4) for y in (0, 1))


def test_redaction(spark, mixed):
    model = pii.fit(mixed)
    df = spark.createDataFrame([(1, "é +1 (614) 555-8001, a@b.org!", 3), (2, None, 4), (3, "", 5), (4, "nothing", 6), (5, "4111111111111111@x.yz end", 7)], "doc_id long, text string, start int")
    assert [r["text"] for r in pii.redact(df, model).orderBy("doc_id").collect()] == ["é <phone>, <email>!", None, "", "nothing", "<email> end"]
    assert pii.redact(df, model).columns == df.columns and pii.report(df.limit(0)).count() == 0


def test_running_sums_are_right_beyond_a_block(spark):
    sizes = [i % 7 for i in range(1000)]
    got = spark.createDataFrame([(sizes,)], "s array<int>").select(pii.running(F.col("s"), 16).alias("r")).head()["r"]
    assert got == [sum(sizes[:i]) for i in range(1000)]


HEX = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(200)]


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}


@pytest.mark.parametrize("size", [1, 12, 200])
def test_secrets_are_taken_alike_at_every_size(spark, size):
    texts = [f'é words token = "{HEX[i]}" more' if i % 2 else f"api_key={HEX[i].upper()}" for i in range(size)]
    others = [f"commit {HEX[0]} and {HEX[1]} alone", "token " + "a" * 40, "token " + "1" * 40, "token " + "ab12" * 10, f"secret /{HEX[2]}/x", "",
              "key AKIA" + "A1B2C3D4E5F6G7H8", f"token {HEX[3]}z"]
    got = spans_of(spark, texts + others)
    for i in range(size):
        start = texts[i].lower().index(HEX[i])
        assert f"secret:{start}:{start + 40}" in got[i].split(","), (texts[i], got[i])
    rest = [got[size + i] for i in range(len(others))]
    assert [r for i, r in enumerate(rest) if i != 6 and "secret" in r] == []


def test_failed_check_digits_need_a_cue(spark):
    failed = [n for n in (f"4{i:015d}" for i in range(7 * 10**14, 7 * 10**14 + 40)) if not passes("card", n)][:20]
    for texts in (["number " + n for n in failed], ["number " + n for n in failed] + ["visa card " + n for n in failed]):
        got = spans_of(spark, texts)
        assert all(got[i] == "" for i in range(len(failed)))


def test_redaction_of_secrets(spark):
    df = spark.createDataFrame([(i, f'x token = "{h}" y') for i, h in enumerate(HEX)], "doc_id long, text string")
    assert {r["text"] for r in pii.redact(df, pii.fit(df)).collect()} == {'x token = "<secret>" y'}
