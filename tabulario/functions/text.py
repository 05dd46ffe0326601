"""Text functions. All of them are native expressions; null stays null."""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulario.functions import fixed

_EDGE_SPACE = r"(?U)^\s+|\s+$"


def _accent_table() -> tuple[str, str]:
    """Every BMP letter that decomposes into one base character plus combining marks."""
    marked, plain = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        bases = [c for c in parts if unicodedata.category(c) != "Mn"]
        if len(parts) > 1 and len(bases) == 1:
            marked.append(chr(code))
            plain.append(bases[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accent_table()


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def is_padded(c: Column) -> Column:
    return c.rlike(r"(?U)^\s|\s$")


def collapse_spaces(c: Column) -> Column:
    """Trimmed, inner runs of white space reduced to one space."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"\p{Mn}+", "")


def norm_key(c: Column) -> Column:
    """Comparison key: spellings that differ only in case, accents or spaces share it."""
    return collapse_spaces(F.lower(strip_accents(c.cast("string"))))


def slug(c: Column) -> Column:
    words = F.regexp_replace(F.lower(strip_accents(c.cast("string"))), r"(?U)[^\w]+", "_")
    bare = F.regexp_replace(F.regexp_replace(words, "_+", "_"), "^_|_$", "")
    return F.when(bare == "", F.lit("columna")).otherwise(bare)


def has_mojibake(c: Column) -> Column:
    return c.rlike("|".join(fixed.MOJIBAKE_MARKERS))


def fix_mojibake(c: Column) -> Column:
    """UTF-8 text that was read as latin-1: undo the misreading, else repair known sequences."""
    latin_only = F.when(c.rlike(r"^[\x00-\xFF]*$"), c)
    undone = F.try_validate_utf8(F.encode(latin_only, "ISO-8859-1").cast("string"))
    repaired = c
    for broken in sorted(fixed.MOJIBAKE_REPAIRS, key=lambda k: (-len(k), k)):
        repaired = F.replace(repaired, F.lit(broken), F.lit(fixed.MOJIBAKE_REPAIRS[broken]))
    return (
        F.when(~has_mojibake(c), c)
        .when(undone.isNotNull() & ~has_mojibake(undone), undone)
        .otherwise(repaired)
    )


def is_email(c: Column) -> Column:
    return c.rlike(fixed.EMAIL_PATTERN)


def is_phone(c: Column) -> Column:
    return c.rlike(fixed.PHONE_PATTERN)


def shape_length(c: Column, numeric: bool = False) -> Column:
    """Size of a value: integer digits of a number, else length without `-`, `,` and spaces."""
    if numeric:
        size = F.abs(c.cast("double"))
        whole = (size - size % 1).try_cast("decimal(38,0)")  # the cast alone would round 999.5 up to four digits
        return F.length(whole.cast("string"))
    bare = F.regexp_replace(strip(c.cast("string")), r"\.0$", "")
    return F.length(F.translate(bare, "- ,", ""))


def label(c: Column) -> Column:
    """Readable category: `4088.0` becomes `4088`, null becomes `(sin dato)`."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"^(-*\d+)\.0$", "$1"), F.lit("(sin dato)"))


def equals_ignoring_case(c: Column, value: object) -> Column:
    """Null compares as false, as a filter does."""
    return F.coalesce(F.lower(c.cast("string")) == F.lower(F.lit(str(value))), F.lit(False))


def as_category(c: Column) -> Column:
    """Text form in which a missing value is the category `nan`."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def plain_place(c: Column) -> Column:
    """Place name in lower case, without accents or punctuation."""
    bare = F.regexp_replace(F.lower(strip_accents(c.cast("string"))), r"[^a-z0-9ñ ]+", " ")
    return collapse_spaces(bare)
