import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulario.llm import bpe, packing, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoding_and_decoding_as_the_library(odd_docs, byte_path):
    texts = [r["text"] for r in odd_docs.select("text").collect()]
    got = bpe.decode(bpe.encode(odd_docs, byte_path), byte_path).collect()
    assert [r["ids"] for r in got] == library(byte_path, texts)
    assert [r["decoded"] for r in got] == [t or "" for t in texts]
    assert [r["kept"] for r in got] == [r["kept"] for r in odd_docs.collect()]
    digests = bpe.digests(odd_docs, byte_path).collect()
    assert [r["ids_sha256"] for r in digests] == [hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in library(byte_path, texts)]
    assert [r["decoded_sha256"] for r in digests] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.byte_bpe(path).encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == library(path, texts)
    assert bpe.byte_bpe(path).decode(ids) == texts


def test_broken_bytes_decode_with_replacement(spark, byte_path):
    ids = Tokenizer.from_file(byte_path).encode("é", add_special_tokens=False).ids
    half = spark.createDataFrame([(ids[:1],), ([],), (None,)], "ids array<int>")
    tail = Tokenizer.from_file(byte_path).decode(ids[:1], skip_special_tokens=False)
    assert [r["decoded"] for r in bpe.decode(half, byte_path).collect()] == [tail, "", ""]


def test_counts_as_the_library(odd_docs):
    special = odd_docs.unionByName(odd_docs.limit(1).withColumns({"text": F.lit("x<|startoftext|>y <|endoftext|>"), "doc_id": F.lit(99)}))
    rows = token_counts.report(special, WORDS, limit=1000).collect()
    texts = [r["text"] for r in special.select("text").collect()]
    want = [len(i) for i in library(WORDS, texts)]
    assert [r["n_tokens"] for r in rows] == want and [r["over_limit"] for r in rows] == [n > 1000 for n in want]
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in texts]
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in special.collect()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_other_vocabularies(spark, name):
    path = public_tokenizers.path(name)
    texts = ["two words", " lead", "a  b\n\nc", "", "naïve café"]
    if name.endswith("model"):
        import sentencepiece
        want = [len(i) for i in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        want = [len(i) for i in library(path, texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_tokens"] for r in token_counts.count_tokens(df, path).collect()] == want


def test_memory_of_the_memo_is_bounded():
    from tabulario.llm.common import Memo
    asked = []
    memo = Memo(lambda keys: asked.extend(keys) or [k * 2 for k in keys], bound=10)
    for start in range(0, 100, 5):
        memo.learn(range(start, start + 5))
        assert all(memo[k] == 2 * k for k in range(start, start + 5)) and len(memo) + len(memo._older) <= 20
    memo.learn(range(95, 100))
    assert len(asked) == 100


def check_packing(rows, texts, path, room):
    ids = {k: [*i, 2] for k, i in zip(texts, library(path, texts.values()))}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for k, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert sum(r["length"] for r in pieces) == len(ids[k]) and all(r["length"] == room for r in pieces[1:])
        assert len(pieces) == -(-len(ids[k]) // room)
        for r in pieces:
            own = np.array(ids[k][r["start"]:r["start"] + r["length"]], "<u4")
            assert zlib.crc32(own.tobytes()) == r["ids_crc32"]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert sum(r["length"] for r in pieces) <= room


def test_packing_odd_documents(spark, odd_docs, byte_path):
    own = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("sequence_id", F.lit("x"))
    texts = {r["doc_id"]: r["text"] for r in own.collect()}
    check_packing(packing.pack(own, byte_path, 64).collect(), texts, byte_path, 64)
    assert packing.pack(own.limit(0), byte_path).count() == 0
    assert packing.pack(odd_docs.where("doc_id IS NULL"), byte_path).head()["length"] > 1
    twice = packing.pack(own.unionByName(own), byte_path, 64)
    assert twice.count() == 2 * packing.pack(own, byte_path, 64).count()
    assert twice.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("o"), F.count("*").alias("c")).where("n > 64 OR o <> c").isEmpty()


def test_packing_with_a_frequent_length(spark, byte_path):
    """A third of the documents have one length; they are spread over tasks and still get places of their own."""
    rng = random.Random(4)
    texts = {i: " word" * (17 if i % 3 == 0 else rng.randint(1, 90)) for i in range(600)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    rows = packing.pack(df, byte_path, 64).collect()
    check_packing(rows, texts, byte_path, 64)
    lower = -(-sum(r["length"] for r in rows) // 64)
    assert len({r["sequence_id"] for r in rows}) <= 1.1 * lower


def test_packing_keeps_ids(spark, odd_docs, byte_path):
    own = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in own.collect()}
    ids = {k: [*i, 2] for k, i in zip(texts, library(byte_path, texts.values()))}
    rows = packing.pack(own, byte_path, 64, keep_ids=True, chars=40).collect()
    check_packing(rows, texts, byte_path, 64)
    assert all(r["ids"] == ids[r["doc_id"]][r["start"]:r["start"] + r["length"]] for r in rows)


def test_packing_keeps_large_keys_beside_null_ones(spark, byte_path):
    keys = [None, 2 ** 62 + 1, 2 ** 53 + 1, 5]
    df = spark.createDataFrame([(k, f"text {k}") for k in keys], "doc_id long, text string")
    assert {r["doc_id"] for r in packing.pack(df, byte_path).collect()} == set(keys)


@pytest.mark.parametrize("n, room", [([1], 1), ([1, 5, 4, 3, 9], 4), ([64, 65, 128, 1, 63], 64), ([], 8)])
def test_cut_and_ranks(n, room):
    document, piece, start, length = packing.cut(np.array(n, np.int64), room)
    want = []
    for d, total in enumerate(n):
        bounds = [0, *range(total % room or room, total + 1, room)]
        want += [(d, i, a, b - a) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert list(zip(document.tolist(), piece.tolist(), start.tolist(), length.tolist())) == want
    seen, plain = np.zeros(room + 1, np.int64), [0] * (room + 1)
    for _ in range(2):
        expected = []
        for v in length.tolist():
            expected.append(plain[v])
            plain[v] += 1
        assert packing.ranks(length, seen).tolist() == expected
    assert seen.tolist() == plain


@pytest.mark.parametrize("lengths", [[], [1] * 5000, [1024] * 3, [600] * 9, [513, 511] * 40, list(range(1, 1025)), [7, 5, 3] * 999])
def test_patterns_use_the_histogram_up(lengths):
    h = np.bincount(lengths, minlength=1025)
    packed = packing.pack_histogram(h, 1024)
    used = np.zeros(1025, int)
    for pattern, n in packed:
        assert n > 0 and sum(a * c for a, c in pattern) <= 1024
        for a, c in pattern:
            used[a] += n * c
    assert (used == h).all()
    least = max(-(-sum(lengths) // 1024), sum(v > 512 for v in lengths))
    assert sum(n for _, n in packed) <= 1.02 * least + 1


def test_ascii_units_split_as_the_pattern_does():
    """The byte pattern of ASCII units gives the tokenizer's own pre-tokens, control characters included."""
    from tabulario.llm.bpe import ASCII_PRE_TOKEN, PRE_TOKEN

    rng = random.Random(4)
    for _ in range(20_000):
        unit = "".join(chr(rng.choice([rng.randrange(128), 32, 39, 115, 100, 108, 48])) for _ in range(rng.randrange(1, 9)))
        assert ASCII_PRE_TOKEN.findall(unit.encode()) == [p.encode() for p in PRE_TOKEN.findall(unit)]


def test_memo_learns_without_walking_through_what_it_holds():
    from tabulario.llm.common import Memo

    class Counted(Memo):
        def __iter__(self):
            raise AssertionError("walked")

        def keys(self):
            raise AssertionError("walked")

    memo = Counted(lambda words: [w.upper() for w in words], bound=100)
    for i in range(20):
        memo.learn([f"a{i}", "b"])
    assert memo["b"] == "B" and memo["a3"] == "A3" and len(memo) == 21


def test_even_texts_are_cut_without_a_python_string_per_word(byte_path, monkeypatch):
    even = ["", "one", "a b.\nC d's (e)\n", "x\n\ny\n z", "12 ñandú\n中文 the, the,"] * 3
    uneven = ["a  b", "a\n\n b", "a\n\n", "a ", "a\tb", "a\r\nb", "a\x00b", "a \nb", "a\n\n\nb", "a\xa0b", "a　\n", "\n ", " a", "\na"]
    monkeypatch.setattr(bpe, "UNIT", None)
    got = bpe.ByteBpe(byte_path).encode(even)
    assert [np.frombuffer(i, "<u4").tolist() for i in got] == library(byte_path, even)
    monkeypatch.undo()
    mixed = [t for pair in zip(even, uneven) for t in pair]
    assert [np.frombuffer(i, "<u4").tolist() for i in bpe.ByteBpe(byte_path).encode(mixed)] == library(byte_path, mixed)
