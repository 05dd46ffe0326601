"""BPE encoding and decoding (operator 9).

Distinct pre-tokens of a block of texts are encoded together by merge rounds on flat numpy arrays: the symbols of
all words lie one after the other, the rank of each neighbouring pair is found by binary search over sorted pair
keys, and each round joins, in every word, the occurrences of that word's lowest-ranked pair. The ids of a text are
the ids of its pre-tokens in order; decoding gathers each id's bytes.
"""
from __future__ import annotations

import functools
import hashlib
import json
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tabulario.llm.common import SPACE, UNIT, Memo, text_column

NO_RANK = np.iinfo(np.int32).max
#: The tokenizer's own pattern for one unit (fixed value); units hold no inner white space.
PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+")

#: The same on the bytes of ASCII units.
ASCII_PRE_TOKEN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+")

#: Texts that are not cut at blanks and line ends alone: other white space, or runs of it that a token may span.
UNEVEN = r"[\x00\t\x0b-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| [ \n]|\n\n[ \n]|(?: |\n\n)\z"
#: Letters, then one of these, are two pre-tokens.
CLOSING = frozenset(".,;:!?)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """A byte-level BPE vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte_of = spec["model"]["vocab"], byte_alphabet()
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.first = np.zeros(256, np.int32)
        for c, b in byte_of.items():
            self.first[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        self.byte_rank, self.byte_made = self._find(np.repeat(self.first, 256), np.tile(self.first, 256))
        self.memo = Memo(self._units)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; NO_RANK where the vocabulary has no such merge."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NO_RANK), self.made[at]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of each word's ids. No word may be empty."""
        length = np.array([len(w) for w in words], np.int64)
        byte = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.first[byte]
        word = np.repeat(np.arange(len(words)), length)
        last = np.zeros(len(symbol), bool)
        last[np.cumsum(length) - 1] = True
        rank, made = np.full(len(symbol), NO_RANK, np.int32), np.zeros(len(symbol), np.int32)
        inner = np.flatnonzero(~last)
        pair = byte[inner].astype(np.int64) << 8 | byte[inner + 1]
        rank[inner], made[inner] = self.byte_rank[pair], self.byte_made[pair]
        done_word, done_symbol = [], []
        while len(symbol):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[begin, len(symbol)])
            best = np.minimum.reduceat(rank, begin)
            if (over := best == NO_RANK).any():  # words without a merge left are finished
                keep = np.repeat(~over, count)
                done_word.append(word[~keep])
                done_symbol.append(symbol[~keep])
                symbol, word, last, rank, made = symbol[keep], word[keep], last[keep], rank[keep], made[keep]
                best, count = best[~over], count[~over]
                if not len(symbol):
                    break
            hit = rank == np.repeat(best, count)
            # of overlapping occurrences (aaa with the pair aa) every other one from the left is joined
            at = np.flatnonzero(hit)
            run = np.r_[True, at[1:] != at[:-1] + 1]
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            symbol[at], last[at] = made[at], last[at + 1]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            joined = np.zeros(len(symbol), bool)
            joined[at] = True
            symbol, word, last, rank, made, joined = (x[~gone] for x in (symbol, word, last, rank, made, joined))
            # only pairs that hold a new symbol need a new look-up
            changed = joined.copy()
            changed[:-1] |= joined[1:]
            rank[changed] = NO_RANK
            ask = np.flatnonzero(changed & ~last)
            rank[ask], made[ask] = self._find(symbol[ask], symbol[ask + 1])
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        symbol = symbol[np.argsort(word, kind="stable")]
        return symbol, np.bincount(word, minlength=len(words))

    def _pre_tokens(self, unit: str) -> list[bytes]:
        if unit.isascii():
            return ASCII_PRE_TOKEN.findall(unit.encode())
        if max(unit) > "ɏ":  # beyond Latin the library's own Unicode tables decide
            byte_of = byte_alphabet()
            return [bytes(byte_of[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(unit)]
        return [p.encode() for p in PRE_TOKEN.findall(unit)]

    def _units(self, units: list[str]) -> list[bytes]:
        """Little-endian ids of each unit; each distinct pre-token is encoded once."""
        parts: list[bytes | list[bytes]] = []
        words: dict[bytes, None] = {}
        for u in units:
            bare = u[1:] if u[0] == " " else u
            if bare.isalpha():  # letters alone are one pre-token
                parts.append(word := u.encode())
                words[word] = None
            else:
                parts.append(some := [u[:-1].encode(), u[-1].encode()] if u[-1] in CLOSING and bare[:-1].isalpha() else self._pre_tokens(u))
                words.update(dict.fromkeys(some))
        ids, count = self.encode_words(list(words))
        data, end = ids.astype("<u4").tobytes(), (np.cumsum(count) * 4).tolist()
        of = dict(zip(words, [data[a:b] for a, b in zip([0, *end], end)]))
        return [of[p] if type(p) is bytes else b"".join([of[x] for x in p]) for p in parts]

    def _plain(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        uneven = pc.match_substring_regex(column, UNEVEN)
        even = iter(self._even(column.filter(pc.invert(uneven))))
        units = [UNIT.findall(t) if u else None for t, u in zip(texts, uneven.to_pylist())]
        self.memo.learn(set(chain.from_iterable(filter(None, units))))
        get = self.memo.__getitem__
        return [next(even) if us is None else b"".join(map(get, us)) for us in units]

    def _even(self, texts: pa.LargeStringArray) -> list[bytes]:
        """Ids of texts without `UNEVEN` parts, whose units are words with the blank before them and single line ends."""
        if not len(texts):
            return []
        # a word is stored without its blank; one that has none is marked, and so is the nothing between a line end and a blank
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n \0"), " ")
        start = split.offsets.to_numpy()
        follows = np.ones(int(start[-1]), bool)
        follows[start[:-1]] = False
        words = pc.dictionary_encode(split.values.filter(pa.array(follows)))
        units = [w[1:] if w[:1] == "\0" else w if w == "\n" else " " + w for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
        at = np.empty(len(follows), np.int64)
        at[follows] = words.indices.to_numpy()
        at[~follows] = np.arange(len(units), len(units) + len(texts))
        units += split.values.take(pa.array(start[:-1])).to_numpy(zero_copy_only=False).tolist()
        self.memo.learn({u for u in units if u})
        get = self.memo.__getitem__
        ids = [get(u) if u else b"" for u in units]
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(length) - length
        n = length[at]
        end = np.cumsum(n)
        source = np.repeat(begin[at] - (end - n), n) + np.arange(int(end[-1]))
        data = np.frombuffer(b"".join(ids), "<u4")[source].tobytes()
        cut = (np.r_[0, end][start] * 4).tolist()
        return [data[a:b] for a, b in zip(cut, cut[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. A special token's string inside a text is that token."""
        if self.special_split is None or not any(s in t for s in self.special for t in texts):
            return self._plain(texts)
        parts = [self.special_split.split(t) for t in texts]
        plain = iter(self._plain([p for ps in parts for p in ps if p not in self.special]))
        return [b"".join(self.special[p].to_bytes(4, "little") if p in self.special else next(plain) for p in ps)
                for ps in parts]

    def decode(self, ids: list[bytes]) -> list[str]:
        """The text of each sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        length = self.piece_len[flat]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        source = np.repeat(self.piece_start[flat] - (end - length), length) + np.arange(total)
        data = self.piece_bytes[source].tobytes()
        cut = np.r_[0, end][np.cumsum([0] + [len(i) // 4 for i in ids])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """The vocabulary at `path`, read once per worker."""
    return ByteBpe(path)


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add column `into` (array<int>): the ids of `text` under the vocabulary at `path`.

    Null and empty texts have no ids. Whole texts are encoded, however long. A column named `into` is replaced;
    other columns, repeated rows included, stay as they are.
    """
    @pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(i, "<i4") for i in byte_bpe(path).encode(texts.tolist())], dtype=object)

    return df.withColumn(into, ids(text_column(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add column `into` (string): the text of the ids; null ids give an empty text. `into` is replaced if there."""
    @pandas_udf("string")
    def decoded(rows: pd.Series) -> pd.Series:
        return pd.Series(byte_bpe(path).decode([np.asarray(r, "<u4").tobytes() for r in rows]), dtype=object)

    return df.withColumn(into, decoded(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", chars: int = 1 << 20) -> DataFrame:
    """`key`, n_tokens, ids_sha256 and decoded_sha256 of each text, without moving ids out of the worker.

    Null and empty texts have 0 tokens and the digests of nothing. Rows repeat as they do in `df`. The worker takes
    about `chars` characters at a time.
    """
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        bpe, rows = byte_bpe(path), []
        for block in blocks(texts.tolist(), chars):
            ids = bpe.encode(block)
            rows += [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d.encode("utf-8", "replace")).hexdigest())
                     for i, d in zip(ids, bpe.decode(ids))]
        return pd.DataFrame(rows, columns=schema.names)

    return df.select(F.col(key), digest(text_column(text)).alias("_d")).select(key, "_d.*")


def blocks(texts: list[str], chars: int):
    """Consecutive lists of texts of about `chars` characters; a longer text stands alone."""
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > chars:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block
