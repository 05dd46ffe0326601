import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import q_source
from tabulario.sources import delimited as D
from tabulario.sources import sinks as S


def test_title_lines_semicolons_latin1(spark, tmp_path):
    body = "".join(f"{d:02d}/02/2024;Norte;{d},50\n" for d in range(3, 12))
    text = "Reporte de ventas\n\nGenerado ayer\nFecha;Región;Monto\n01/02/2024;Bajío;1.234,50\n;;\n02/02/2024;\"Norte; alto\";5\n" + body + "1;2;3;4\n9/2/2024\n"
    (tmp_path / "v.csv").write_bytes(text.encode("latin-1"))
    got = D.read_delimited(spark, str(tmp_path / "v.csv"))
    assert (got.encoding, got.separator, got.header_row) == ("cp1252", ";", 2)
    assert got.table.columns == ["Fecha", "Región", "Monto"] and got.table.count() == 12
    found = {r["Fecha"]: (r["Región"], r["Monto"]) for r in got.table.collect()}
    assert found["01/02/2024"] == ("Bajío", "1.234,50") and found["02/02/2024"] == ("Norte; alto", "5") and found["9/2/2024"] == (None, None)
    assert any("fila 3" in n for n in got.notes) and any(n.startswith("1 filas") for n in got.notes)
    assert [r["record"] for r in got.rejected.collect()] == ["1;2;3;4"]


@pytest.mark.parametrize("data, encoding", [
    ("a,b\nñ,1\n".encode(), "utf-8"), ("a,b\nñ,1\n".encode("utf-8-sig"), "utf-8"), ("a,b\n€ñ,1\n".encode("cp1252"), "cp1252"),
    (b"a,b\n\x81\xf1,1\n", "latin-1")])
def test_encodings(spark, tmp_path, data, encoding):
    (tmp_path / "x.csv").write_bytes(data)
    assert D.encodings(spark, str(tmp_path / "x.csv")).head()["encoding"] == encoding
    got = D.read_delimited(spark, str(tmp_path / "x.csv"))
    assert got.table.columns == ["a", "b"] and got.table.head()["a"].endswith("ñ")


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separators(spark, tmp_path, sep):
    (tmp_path / "x.csv").write_text("\n".join(sep.join([f"c{j}" if i == 0 else str(i * j) for j in range(4)]) for i in range(9)))
    got = D.read_delimited(spark, str(tmp_path / "x.csv"))
    assert got.separator == sep and got.table.count() == 8 and got.table.columns == ["c0", "c1", "c2", "c3"]


def test_many_files_each_with_its_head(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"p{k}.csv").write_text("Titulo\na,b\n" + "".join(f"{k},{i}\n" for i in range(10)))
    got = D.read_delimited(spark, str(tmp_path))
    assert got.header_row == 1 and got.table.count() == 50 and got.table.where("a = 'a'").isEmpty()


def test_names():
    assert D.repaired_names(["a", "a", "", None, "Unnamed: 3", " b "])[0] == ["a", "a_1", "columna_3", "columna_4", "columna_5", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"ñ{i}") for i in range(30)], "i long, s string")
    S.write_csv(df, str(tmp_path / "c"))
    part = next((tmp_path / "c").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbf")
    assert D.read_delimited(spark, str(tmp_path / "c")).table.count() == 30
    S.save_bundle({"a": df}, str(tmp_path / "b"))
    assert S.load_bundle(spark, str(tmp_path / "b"), ["a"])["a"].count() == 30
    shown, notice = S.preview(df, 10, "i")
    assert shown.count() == 10 and notice and S.preview(df, 30)[1] == ""


def test_every_file_by_its_own_layout(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Titulo\nNombre,Monto\nñandú,1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Nombre;Monto\nñu;2\n\"uno\ndos; tres\";10\n", encoding="cp1252")
    (tmp_path / "c.csv").write_text("T\n\nU\nNombre|Monto\nx|3\ny|4\n")
    got = D.read_delimited(spark, str(tmp_path))
    assert sorted(map(tuple, got.table.collect())) == [("uno\ndos; tres", "10"), ("x", "3"), ("y", "4"), ("ñandú", "1"), ("ñu", "2")]
    assert got.rejected.isEmpty() and len(got.notes) == 4 and sorted(r["header"] for r in got.files.collect()) == [0, 1, 2]


def test_different_columns_are_refused_and_short_files_noted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError, match="a, b; a, c"):
        D.read_delimited(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text("solo\n")
    (tmp_path / "a.csv").write_text("x\na,b\n1,2\n")
    got = D.read_delimited(spark, str(tmp_path), header_row=1)
    assert got.table.count() == 1 and any("antes del encabezado" in n and "b.csv" in n for n in got.notes)


def test_open_quotes_are_noted_and_lines_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;b\n5" tubo;1\nx;2\ny;3\n')
    got = D.read_delimited(spark, str(tmp_path / "a.csv"))
    assert got.table.count() == 3 and any("comillas sin cerrar" in n for n in got.notes)


def test_heads_are_cut_before_the_shuffle(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n" * 50)
    text = D.records(spark, str(tmp_path), D.splits(spark, str(tmp_path)))
    assert "WindowGroupLimit" in D.head(text, 3)._jdf.queryExecution().toString()


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that records straddle them."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(kept, ("150", "0")):
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def quoted_rows(path):
    import csv
    with open(path, newline="") as f:
        return sorted(tuple(r) for r in list(csv.reader(f))[1:])


@pytest.mark.parametrize("seed", range(2))
def test_records_that_straddle_splits(spark, tmp_path, small_splits, seed):
    import random
    rng = random.Random(seed)
    for k in range(2):
        rows = []
        for i in range(25):
            lines = ["x" * rng.randrange(1, 12) + str(j) for j in range(rng.choice([1, 1, 1, 2, 3, 40]))]
            rows.append(f'{k}-{i},"' + "\n".join(lines) + '"' if len(lines) > 1 or rng.random() < 0.3 else f"{k}-{i},{lines[0]}")
        (tmp_path / f"f{k}.csv").write_text("a,b\n" + "\n".join(rows) + "\n")
    layout = D.splits(spark, str(tmp_path))
    assert layout.where("inside").count() > 2 and layout.where("inside AND open AND odd = 0").count() > 0
    got = D.read_delimited(spark, str(tmp_path))
    want = sorted(quoted_rows(tmp_path / "f0.csv") + quoted_rows(tmp_path / "f1.csv"))
    assert sorted(map(tuple, got.table.collect())) == want and got.rejected.isEmpty()


def test_lines_are_not_shuffled(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("a,b\n" + '1,"x\ny"\n' * 30)
    (tmp_path / "b.csv").write_text("a,b\n" + "1,2\n" * 30)
    got = D.read_delimited(spark, str(tmp_path))
    plan = got.table._jdf.queryExecution().executedPlan().toString()
    assert got.table.count() == 60 and "Exchange hashpartitioning" not in plan and "Exchange range" not in plan and "SortMergeJoin" not in plan


def test_an_open_quote_in_one_file_leaves_others_alone(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("a,b\n" + '1,"x\ny"\n' * 10)
    (tmp_path / "b.csv").write_text("a,b\n" + "1,z\n" * 20 + '5" tubo,2\n' + "1,z\n" * 20)
    got = D.read_delimited(spark, str(tmp_path))
    assert got.table.where("b = 'x\ny'").count() == 10 and got.table.count() == 51 and any("b.csv" in n for n in got.notes)


def test_first_lines_are_found_without_sorting_a_split(spark, tmp_path):
    for name, n in (("a", 60), ("b", 4)):
        (tmp_path / f"{name}.csv").write_text("\n\n" + "".join(f"{name}{i}\n" for i in range(n)))
    text = D.records(spark, str(tmp_path), D.splits(spark, str(tmp_path)))
    plan = D.head(text, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("MapInArrow")
    got = sorted((r["row"], r["value"]) for r in D.head(text, 5).collect())
    assert got == sorted([(i, f"a{i}") for i in range(5)] + [(i, f"b{i}") for i in range(4)])
    assert sorted((r["row"], r["value"]) for r in D.head(text, 3, blank=True).collect()) == [(0, ""), (0, ""), (1, ""), (1, ""), (2, "a0"), (2, "b0")]


def test_first_rows_of_batches_in_any_order():
    rows = [(f"f{i * 7 % 3}", i * 37 % 101, str(i)) for i in range(101)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("file", "id", "value"), r)) for r in rows[i:i + 9]]) for i in range(0, 101, 9)]
    got = [tuple(r.values()) for b in D._first(4)(iter(batches)) for r in b.to_pylist()]
    assert got == [r for f in ("f0", "f1", "f2") for r in sorted(x for x in rows if x[0] == f)[:4]]
    assert list(D._first(4)(iter([]))) == []


def test_more_orders_make_more_files_not_longer_ones(spark, monkeypatch):
    monkeypatch.setattr(q_source, "_FILE_ORDERS", 100)
    sf = "/root/testdata/sf0.001"
    path = q_source._files(spark, sf)
    monkeypatch.setattr(q_source, "_files", lambda *_: path)
    sizes = [r["n"] for r in spark.read.text(path).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 200
    assert [tuple(r) for r in q_source.src_02(spark, sf).orderBy("p").collect()] == [(i, s, True) for i, s in enumerate([";", "|", ",", "\t"])]
    assert [r["header"] for r in q_source.src_03(spark, sf).orderBy("p").collect()] == [0, 1, 2, 3]
    assert [r["encoding"] for r in q_source.src_04(spark, sf).orderBy("p").collect()] == ["utf-8", "cp1252"] * 2
    assert q_source.src_01(spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()
