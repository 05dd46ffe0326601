"""Quality rules by compression bands (operator 5).

Repetitive text compresses too well and random text too badly. Each whole text and each of its fixed chunks is
compressed with zstandard; the ratio of plain to compressed bytes must lie in a band that depends on the length, since
short texts carry the frame's overhead and long ones repeat more.
"""
from __future__ import annotations

import bisect
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tabulario.llm.common import text_column

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, " \
    "n_chunks long, n_odd_chunks long, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Limits:
    """Bands of the ratio plain / compressed, each from its number of bytes on, and what chunks may do."""

    level: int = 3
    # about 0.08 under the 0.1 % and 0.5 over the 99.9 % quantile of texts and chunks that pass the base rule
    from_bytes: tuple[int, ...] = (0, 64, 256, 512, 1_024, 2_048, 4_096, 8_192, 16_384, 65_536)
    lowest: tuple[float, ...] = (0.0, 0.8, 1.27, 1.38, 1.64, 1.73, 1.92, 2.07, 2.18, 2.18)
    highest: tuple[float, ...] = (3.0, 3.0, 2.4, 2.6, 2.9, 3.1, 3.2, 3.3, 3.4, 3.5)
    chunk: int = 4_096
    odd_share: float = 0.1
    min_words: int = 50
    repeat_percent: int = 50

    def odd(self, plain: int, packed: int) -> bool:
        band = bisect.bisect_right(self.from_bytes, plain) - 1
        return not self.lowest[band] <= plain / packed <= self.highest[band]


def facts(text: str, limits: Limits, packer: zstandard.ZstdCompressor) -> tuple:
    """The row of FACTS of one text."""
    words = WORD.findall(text)
    lines = Counter(line for line in text.split("\n") if WORD.search(line))
    windows = list(zip(words, words[1:], words[2:]))
    n_repeat = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        covered = np.zeros(len(words), bool)
        at = np.fromiter((i for i, w in enumerate(windows) if seen[w] > 1), np.int64)
        for shift in range(3):
            covered[at + shift] = True
        n_repeat = int(covered.sum())
    data = text.encode("utf-8", "replace")
    packed = len(packer.compress(data))
    # a last piece shorter than a quarter of a chunk joins no chunk; a text of one chunk is judged as a whole only
    starts = [i for i in range(0, len(data), limits.chunk) if len(data) - i >= limits.chunk // 4] if len(data) > limits.chunk else []
    odd = sum(limits.odd(len(c), len(packer.compress(c))) for c in (data[i:i + limits.chunk] for i in starts))
    failed = len(words) < limits.min_words or 100 * n_repeat > limits.repeat_percent * len(words)
    fits = not limits.odd(len(data), packed) and odd <= limits.odd_share * len(starts)
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), sum(lines.values()) - len(lines), n_repeat,
            len(data) / packed, len(starts), odd, failed, fits and not failed)


def judge(df: DataFrame, limits: Limits = Limits(), text: str = "text", into: str = "quality") -> DataFrame:
    """Add struct column `into` with the facts and verdict of each whole text; `into` is replaced if there.

    A null or empty text has zeros, fails the base rule and is not kept. Equal texts get equal verdicts. Only the text
    goes to Python, so other columns may be of any type and name.
    """
    @pandas_udf(FACTS)
    def judged(texts: pd.Series) -> pd.DataFrame:
        packer = zstandard.ZstdCompressor(level=limits.level)
        return pd.DataFrame([facts(t, limits, packer) for t in texts], columns=[c.split()[0] for c in FACTS.split(", ")])

    # not deterministic only for the optimizer: a later filter on the verdict must not run it twice
    return df.withColumn(into, judged.asNondeterministic()(text_column(text)))


def report(df: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and the columns of FACTS for each row."""
    return judge(df.select(F.col(key), F.col(text).alias("_text")), limits, "_text", "_q").select(key, "_q.*")
