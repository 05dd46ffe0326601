"""Delimited text files: find each file's encoding, separator and header row, then read all columns as text.

Every step is a job over the lines of all files at once. Spark splits large files; the position of
a line is the start of its split and its place in it. Whether a split begins inside a quoted field
follows from the quotes of the splits before it, so a table with one row per split tells every task
how to read its own lines; only records that straddle two splits are moved.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulario.functions import fixed
from tabulario.session import materialize

# --- fixed values ------------------------------------------------------------------------
SEPARATORS = [",", ";", "\t", "|"]
SNIFFED_LINES = 25
SCANNED_ROWS = 8
WIDTH_LINES = 40
ENCODINGS = ["utf-8", "cp1252", "latin-1"]
# -----------------------------------------------------------------------------------------

#: Splits (rows of about 100 bytes) whose layout may be broadcast to the lines; beyond it Spark joins them as it sees fit.
BROADCAST = 200_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at_start, id, raw): the bytes of every line; (block, id) rises along a file."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        (F.col("_metadata.file_block_start") == 0).alias("at_start"),
        F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("raw"))


_C1 = "".join(chr(b) for b in range(0x80, 0xA0))
_CP1252 = "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xA0))
_NOT_CP1252 = "[" + "".join(chr(b) for b in range(0x80, 0xA0) if not bytes([b]).decode("cp1252", errors="ignore")) + "]"


def splits(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(file, block, encoding, odd, broken, inside, open, origin): how each split of each file is to be read, one row each.

    `encoding` is utf-8, cp1252 or latin-1, the first that reads every line of the file, unless one is given. The line
    reader takes a byte order mark away, so UTF-8 with and without it are the same here. `odd` counts lines with an odd
    number of quotes; a split starts `inside` a quoted field where those before it hold an odd number, and is `open` where
    its last record goes on in the next split. `origin` is the split that began the record a split starts inside of. In a
    `broken` file the last quote stays open, so nothing can be told and its lines stay single.
    """
    text = F.col("raw").cast("string")
    latin = F.decode(F.col("raw"), "ISO-8859-1")
    per = lines(spark, path).groupBy("file", "block").agg(
        F.bool_and(F.is_valid_utf8(text)).alias("utf8"), F.bool_and(~latin.rlike(_NOT_CP1252)).alias("cp1252"),
        F.sum(odd_quotes(text)).alias("odd"))
    file = W.partitionBy("file")  # one row per split
    before = file.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    utf8, cp1252 = F.min("utf8").over(file), F.min("cp1252").over(file)
    read = F.lit(encoding) if encoding else F.when(utf8, "utf-8").when(cp1252, "cp1252").otherwise("latin-1")
    placed = per.select(
        "file", "block", read.alias("encoding"), "odd", (F.sum("odd").over(file) % 2 == 1).alias("broken"),
        (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    placed = placed.withColumn("inside", F.col("inside") & ~F.col("broken")).withColumn(
        "open", ~F.col("broken") & (F.col("inside") != (F.col("odd") % 2 == 1)))
    # an open split without any odd line that starts inside only passes the record on
    begins = F.col("open") & ~(F.col("inside") & (F.col("odd") == 0))
    return placed.withColumn("origin", F.last(F.when(begins, F.col("block")), ignorenulls=True).over(before))


def odd_quotes(text: Column) -> Column:
    """1 where a line has an odd number of quotes; a quote is the same byte in all encodings."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit('"'), F.lit("")))) % 2


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding): utf-8, cp1252 or latin-1, the first that reads every line of the file."""
    return splits(spark, path).groupBy("file").agg(F.first("encoding").alias("encoding"))


def decoded(raw: Column, encoding: str) -> Column:
    if encoding == "utf-8":
        return raw.cast("string")
    latin = F.decode(raw, "ISO-8859-1")
    return F.translate(latin, _C1, _CP1252) if encoding == "cp1252" else latin


_RECORD = "file string, block long, at_start boolean, id long, value string, origin long"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, in order, as records. A record that its split does not hold whole comes as a piece with `origin`."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at_start", pa.bool_()), ("id", pa.int64()),
                        ("value", pa.string()), ("origin", pa.int64())])
    done: list[tuple] = []
    record: list | None = None  # file, block, at_start, id, lines, origin where it began in an earlier split
    split, inside = None, False

    def close(origin: int | None) -> None:
        done.append((*record[:4], "\n".join(record[4]), origin))

    for batch in batches:
        if not batch.num_rows:
            continue
        odd, block = batch.column("odd").to_numpy(), batch.column("block").to_numpy()
        file = batch.column("file").dictionary_encode()
        code = file.indices.to_numpy()
        edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(code) != 0)) + 1
        single = np.zeros(batch.num_rows, bool)
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            here = (file.dictionary[code[a]].as_py(), int(block[a]))
            if here != split:
                if record is not None:  # the split before ended inside a field
                    close(record[1] if record[5] is None else record[5])
                    record = None
                split, inside = here, bool(batch.column("inside")[a].as_py())
            after = (np.cumsum(odd[a:b]) + inside) % 2 == 1
            before = np.concatenate([[inside], after[:-1]])
            single[a:b] = ~(before | after)
            joined = np.flatnonzero(before | after)
            for i, line in zip(joined, batch.column("value").take(pa.array(a + joined)).to_pylist()):
                if record is None:
                    origin = batch.column("origin")[a].as_py() if before[i] else None
                    record = [*here, batch.column("at_start")[a].as_py(), batch.column("id")[a + int(i)].as_py(), [], origin]
                record[4].append(line)
                if not after[i]:
                    close(record[5])
                    record = None
            inside = bool(after[-1])
        plain = batch.filter(pa.array(single)).select(["file", "block", "at_start", "id", "value"])
        yield pa.RecordBatch.from_arrays([*plain.columns, pa.nulls(plain.num_rows, pa.int64())], schema=schema)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), schema.types)], schema=schema)
            done = []
    if record is not None:
        close(record[1] if record[5] is None else record[5])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), schema.types)], schema=schema)


def records(spark: SparkSession, path: str, layout: DataFrame) -> DataFrame:
    """(file, block, at_start, id, value): the records of all files as text, each file read as `layout` (of `splits`) tells.

    Where no line has an odd number of quotes the lines are the records. Otherwise each task joins the lines of its own
    splits, and records that straddle splits are put together apart: a piece per split and record is all that is shuffled.
    """
    total = layout.agg(F.count("*").alias("n"), F.coalesce(F.bool_or((F.col("odd") > 0) & ~F.col("broken")), F.lit(False)).alias("joins"),
                       F.coalesce(F.bool_or("inside"), F.lit(False)).alias("straddles")).head()
    known = F.broadcast(layout) if total["n"] <= BROADCAST else layout
    both = lines(spark, path).join(known, ["file", "block"], "left")
    # files or splits that changed since the layout was taken must not pass in silence
    encoding = F.coalesce("encoding", F.raise_error(F.lit("los archivos cambiaron mientras se leían")).cast("string"))
    text = F.coalesce(*[F.when(encoding == e, decoded(F.col("raw"), e)) for e in ENCODINGS])
    plain = ["file", "block", "at_start", "id"]
    if not total["joins"]:
        return both.select(*plain, text.alias("value"))
    odd = F.when(F.col("broken"), 0).otherwise(odd_quotes(F.col("raw").cast("string"))).cast("int").alias("odd")
    marked = both.select(*plain, text.alias("value"), odd, "inside", "open", "origin")
    fed = [*plain, "value", "odd", "inside", "origin"]
    own = marked.select(*fed).mapInArrow(_whole, _RECORD).where("origin IS NULL").select(*plain, "value")
    if not total["straddles"]:
        return own
    pieces = marked.where("inside OR open").select(*fed).mapInArrow(_whole, _RECORD).where("origin IS NOT NULL")
    moved = pieces.groupBy("file", "origin").agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("x")).select(
        "file", F.col("origin").alias("block"), (F.col("origin") == 0).alias("at_start"), F.col("x")[0]["id"].alias("id"),
        F.array_join(F.transform("x", lambda piece: piece["value"]), "\n").alias("value"))
    return own.unionByName(materialize(moved))  # at most one record per split


def cells(value: Column, separator: Column, width: int) -> Column:
    """The fields of a record as an array of `width`, null where the record is shorter."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = F.coalesce(*[F.when(separator == s, F.from_csv(value, schema, {"sep": s, "multiLine": "true"})) for s in SEPARATORS])
    return F.transform(F.array(*[parsed[f"c{i}"] for i in range(width)]), lambda x: x)


def _first(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each file's rows that a task reads, the k with the smallest ids; no more than these and a batch are held."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        last: dict[str, int] = {}  # of files with k rows, the largest id among them
        for batch in batches:
            file = batch.column("file").dictionary_encode()
            bound = np.array([last.get(f, np.iinfo(np.int64).max) for f in file.dictionary.to_pylist()], np.int64)
            near = batch.column("id").to_numpy() < bound[file.indices.to_numpy()]
            if not near.any():
                continue
            few = pa.Table.from_batches([batch.filter(pa.array(near))])
            few = (few if kept is None else pa.concat_tables([kept, few])).sort_by([("file", "ascending"), ("id", "ascending")])
            code = few.column("file").combine_chunks().dictionary_encode().indices.to_numpy()
            begin = np.searchsorted(code, np.arange(code[-1] + 1))  # sorted, so codes rise
            rank = np.arange(len(code)) - begin[code]
            kept = few.filter(pa.array(rank < k))
            full = few.filter(pa.array(rank == k - 1))
            last.update(zip(full.column("file").to_pylist(), full.column("id").to_pylist()))
        if kept is not None:
            yield from kept.to_batches(1000)

    return first


def head(text: DataFrame, k: int, blank: bool = False) -> DataFrame:
    """(file, row, id, value): the first k lines of each file, blank ones skipped unless asked for."""
    start = text.where("at_start") if blank else text.where("at_start").where(F.trim("value") != "")
    # a window alone would sort all lines of the split, as Spark can't tell that they come in order
    few = start.select("file", "id", "value").mapInArrow(_first(k), "file string, id long, value string")
    row = F.row_number().over(W.partitionBy("file").orderBy("id"))
    return few.withColumn("row", row).where(F.col("row") <= k).select("file", (F.col("row") - 1).alias("row"), "id", "value")


def separators(text: DataFrame) -> DataFrame:
    """(file, separator, score): the separator with the highest count times consistency over the first lines.

    Consistency is the share of lines with as many of it as the first line. A file without any gets a comma.
    """
    counted = head(text, SNIFFED_LINES, blank=True).where(F.trim("value") != "").select("file", "row", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(s).alias("separator"),
                 (F.length("value") - F.length(F.replace("value", F.lit(s), F.lit("")))).alias("n"))
        for i, s in enumerate(SEPARATORS)])).alias("x")).select("file", "row", "x.*")
    first = F.min_by("n", "row")
    per = counted.groupBy("file", "i", "separator").agg(
        F.max("n").alias("top"), F.collect_list("n").alias("all"), first.alias("first"))  # at most 25 counts
    same = F.size(F.filter("all", lambda n: n == F.col("first")))
    scored = per.withColumn("score", F.when(F.col("top") > 0, F.col("top") * same / F.size("all")).otherwise(F.lit(0.0)))
    return scored.groupBy("file").agg(
        F.max_by("separator", F.struct("score", -F.col("i"))).alias("separator"), F.max("score").alias("score"))


def first_records(text: DataFrame, own: DataFrame, k: int = WIDTH_LINES) -> DataFrame:
    """(file, separator, row, id, value): the first records of each file that are not blank, kept for the steps that look at them."""
    return materialize(head(text, k).join(own, "file"))


def scored_rows(first: DataFrame) -> DataFrame:
    """(file, header, score) from `first_records`, see `header_rows`."""
    separator = F.col("separator")
    width = (first.agg(F.max(F.length("value") - F.length(F.replace("value", separator, F.lit(""))))).head()[0] or 0) + 1
    parsed = first.where(F.col("row") < SCANNED_ROWS).select(
        "file", "row", F.filter(cells(F.col("value"), separator, width), lambda x: x.isNotNull()).alias("c"))
    filled = F.filter("c", lambda x: F.trim(x) != "")
    score = F.size(filled) * 1.5 + F.size(F.array_distinct(filled)) * 0.5
    scored = parsed.select("file", "row", F.when(F.size(filled) >= 2, score).otherwise(F.lit(-1.0)).alias("score"))
    return scored.groupBy("file").agg(F.max_by("row", F.struct("score", -F.col("row"))).alias("header"), F.max("score").alias("score"))


def header_rows(text: DataFrame, own: DataFrame) -> DataFrame:
    """(file, header, score): which of the first rows is the header, counting from 0 without blank lines.

    A row scores its filled cells, plus half its text cells and half its distinct cells; it needs two
    filled cells. The first best row wins; row 0 when none qualifies. `own` gives each file's separator.
    """
    return scored_rows(first_records(text, own))


def repaired_names(names: list[str | None]) -> tuple[list[str], list[str]]:
    """Names without blanks or repeats, and notes on what was changed."""
    seen: dict[str, int] = {}
    out, notes = [], []
    for i, name in enumerate(names):
        bare = (name or "").strip()
        base = f"columna_{i + 1}" if bare == "" or bare.lower().startswith("unnamed") else bare
        n = seen[base] = seen.get(base, -1) + 1
        if n:
            notes.append(f"nombre repetido: {base}")
        out.append(f"{base}_{n}" if n else base)
    if any(m in name for name in out for m in fixed.MOJIBAKE_MARKERS):
        notes.append("los encabezados traen acentos rotos")
    return out, notes


@dataclass
class Loaded:
    """A delimited source: its rows as text columns, how each file was read, notes, and the records left out.

    `separator`, `encoding` and `header_row` are those of most files, of equally many the one of the first path; `files` has
    every file's own.
    """

    table: DataFrame
    separator: str
    encoding: str
    header_row: int
    notes: list[str] = field(default_factory=list)
    files: DataFrame | None = None
    rejected: DataFrame | None = None


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None,
                   header_row: int | None = None) -> Loaded:
    """Read one file or a directory of files with the same columns; whatever is not given is found per file.

    Lines above the header are dropped in every file. A quoted field may hold separators and line
    breaks. Short rows are padded and rows without any value are dropped; rows with too many fields are
    counted in the notes and kept in `rejected`. Files whose headers differ are refused.
    """
    notes = []
    layout = materialize(splits(spark, path, encoding))
    text = records(spark, path, layout)
    how = layout.groupBy("file").agg(F.first("encoding").alias("encoding"), F.first("broken").alias("broken"))
    own = materialize(separators(text).select("file", "separator")) if separator is None else how.select("file", F.lit(separator).alias("separator"))
    first = first_records(text, own, max(WIDTH_LINES, (header_row or 0) + 1))
    titles = scored_rows(first).select("file", "header") if header_row is None else how.select("file", F.lit(header_row).alias("header"))
    top = first.join(titles, "file").where("row = header").select("file", F.col("id").alias("_header"), F.col("value").alias("title"))
    how = materialize(how.join(own, "file").join(titles, "file").join(top, "file", "left"))
    separator_count = F.length("title") - F.length(F.replace("title", F.col("separator"), F.lit("")))
    total = how.agg(F.count("*").alias("n"), F.max(separator_count).alias("width")).head()
    if not total["n"]:
        raise ValueError(f"no hay líneas en {path}")
    for condition, what in (("broken", "archivos con comillas sin cerrar"), ("title IS NULL", "archivos terminan antes del encabezado")):
        some = how.where(condition)
        n = some.count()
        if n:
            notes.append(f"{n} {what}: {', '.join(r['file'] for r in some.orderBy('file').limit(5).collect())}")
    layouts = [tuple(r["names"]) for r in how.where("title IS NOT NULL").select(
        F.filter(cells(F.col("title"), F.col("separator"), (total["width"] or 0) + 1), lambda x: x.isNotNull()).alias("names")
    ).distinct().orderBy("names").limit(5).collect()]
    if not layouts:
        raise ValueError(f"ningún archivo de {path} llega al encabezado")
    if len(layouts) > 1:
        raise ValueError("los archivos tienen encabezados distintos: " + "; ".join(", ".join(x) for x in layouts))
    names, repairs = repaired_names(list(layouts[0]))
    kinds = how.groupBy("encoding", "separator", "header").agg(F.count("*").alias("n"), F.min("file").alias("file")).orderBy("file").collect()  # few ways
    found = {}
    for what, key in (("codificaciones", "encoding"), ("separadores", "separator"), ("filas de encabezado", "header")):
        of = Counter()
        for kind in kinds:
            of[kind[key]] += kind["n"]
        found[key] = of.most_common(1)[0][0]
        if len(of) > 1:
            notes.append(f"{what} por archivo: {', '.join(map(repr, sorted(map(str, of))))}")
    if any(kind["encoding"] == "latin-1" for kind in kinds):
        notes.append("el texto no es UTF-8; se leyó como latin-1")
    if found["header"]:
        notes.append(f"encabezado en la fila {found['header'] + 1}")
    notes += repairs
    heads = how.select("file", "separator", "_header").where("_header IS NOT NULL")
    body = text.join(F.broadcast(heads) if total["n"] <= BROADCAST else heads, "file").where(
        (~F.col("at_start") | (F.col("id") > F.col("_header"))) & (F.trim("value") != ""))
    width = len(names)
    fields = cells(F.col("value"), F.col("separator"), width + 1)  # one more to see long rows
    # a record with a field too many has as many separators as there are columns; others need not be parsed to be told
    marks = F.octet_length("value") - F.octet_length(F.replace("value", F.col("separator"), F.lit("")))
    rejected = body.where(marks >= width).select("file", F.col("value").alias("record"), fields.alias("x")).where(
        F.col("x")[width].isNotNull()).select("file", "record")
    n = rejected.count()
    if n:
        notes.append(f"{n} filas con demasiados campos quedaron fuera")
    table = body.select(fields.alias("x")).where(F.col("x")[width].isNull()).select(
        *[F.col("x")[i].alias(name) for i, name in enumerate(names)]).na.drop("all")
    return Loaded(table, found["separator"], found["encoding"], found["header"], notes,
                  how.select("file", "encoding", "separator", "header"), rejected)
