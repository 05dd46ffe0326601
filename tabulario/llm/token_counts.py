"""Token counts (operator 4).

The texts of a block are cut into pre-tokens, the distinct ones of the block are counted once each (and remembered
within bounds for the next block), the counts are joined by code to the pre-token occurrences and summed per document.
No ids are kept. The join stays inside a task: its other side are the pre-tokens of the very texts the task holds, so
nothing is shuffled and a frequent pre-token is no hot key.
"""
from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tabulario.llm.common import SPACE, UNIT, Memo, text_column

RUN = re.compile(f"[^{SPACE}]+")


class PieceCounter:
    """Numbers of tokens under one vocabulary file.

    For a `.json` whose pre-tokenizer drops white space the pre-tokens are runs without white space; for a byte-level
    one that keeps it, runs with their leading blank. A `.model` file has pieces across blanks, so whole texts are its
    units. Special strings inside texts are handled as the library does by default.
    """

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            count: Callable[[list], list] = lambda units: [len(i) for i in model.encode(units, num_threads=1)]
            self.unit = None
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            count = lambda units: [len(e) for e in model.encode_batch_fast(units, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                drops_space = '"Removed"' in json.dumps(json.load(f)["pre_tokenizer"])
            self.unit = RUN if drops_space else UNIT
        self.memo = Memo(count)

    def __call__(self, texts: list[str]) -> np.ndarray:
        units = [[t] if self.unit is None else self.unit.findall(t) for t in texts]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        coded = pa.array([u for us in units for u in us], pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.memo.learn(distinct)
        pieces = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))
        total = np.r_[0, np.cumsum(pieces[coded.indices.to_numpy()])] if len(coded) else np.zeros(1, np.int64)
        end = np.cumsum(sizes)
        return total[end] - total[end - sizes]


@functools.lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Add column `into` (long): the tokens of each whole text under the vocabulary at `path`, without added ones.

    Null and empty texts have 0. A column named `into` is replaced; other columns and repeated rows stay.
    """
    @pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(piece_counter(path)(texts.tolist()))

    return df.withColumn(into, count(text_column(text)))


def report(df: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of each row."""
    slim = df.select(F.col(key), text_column(text).alias("_text"))
    return count_tokens(slim, path, "_text", "n_tokens").select(
        key, F.octet_length("_text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
