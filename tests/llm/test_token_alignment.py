"""Alignment of two tokenizers against a plain computation over whole texts with the libraries."""
import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabulario.llm import token_alignment as A
from tabulario.llm.bpe import byte_alphabet

B_PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries(byte_path):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(byte_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def plain(docs, libraries):
    a_lib, b_lib = libraries
    byte_of = byte_alphabet()
    per, count = [], Counter()
    for i, t in docs:
        row = (i, 0, 0, 0, [], "")
        if t:
            a = a_lib.encode(" " + t, add_special_tokens=False)
            ids = a.ids
            bytes_a = [bytes(byte_of[c] for c in x) for x in a.tokens]
            b = b_lib.encode(t)
            pieces = [b_lib.id_to_piece(x) for x in b]
            bytes_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, pieces)]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                groups, at_a, at_b, i_a, i_b = [([], [])], 0, 0, 0, 0
                while i_a < len(ids) or i_b < len(b):
                    if at_a <= at_b and i_a < len(ids):
                        groups[-1][0].append(ids[i_a])
                        at_a += len(bytes_a[i_a])
                        i_a += 1
                    else:
                        groups[-1][1].append(b[i_b])
                        at_b += len(bytes_b[i_b])
                        i_b += 1
                    if at_a == at_b:
                        groups.append(([], []))
                groups.pop()
                links = [(x, y) for xs, ys in groups for x in xs for y in ys]
                form = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
                row = (i, len(ids), len(b), len(groups), links, hashlib.sha256(form.encode()).hexdigest())
        per.append(row)
        count.update(set(row[4]))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return sorted(((i, n_a, n_b, g, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest)
                   for i, n_a, n_b, g, links, digest in per), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


MORE = ["Der schnelle braune Fuchs springt über den faulen Hund.", "El niño corrió 12345 metros  en   la montaña\n\n\n  y volvió\t\tayer", "a ▁b", "x▁", " lead", "trail  ",
        "\n  \n x \n", "<s> </s> <unk> <0x41> <|endoftext|>", "1.000.000,00 €   ", "word  word　 x", "the the the the", "a" * 3000, "==== ----  ####", "​ zero", "é é", "\x00\x01"]


def test_against_libraries(spark, byte_path, libraries, odd_docs):
    """Null, empty, very long and repeated texts, a null id, clashing columns, and blocks of few characters."""
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(100 + i, t) for i, t in enumerate(MORE)]
    df = odd_docs.unionByName(spark.createDataFrame([(i, t, "n", 1) for i, t in docs[-len(MORE):]], odd_docs.schema))
    want = plain(docs, libraries)
    assert sum(w[3] for w in want) > 1000 and sum(w[4] != w[3] for w in want) > 10
    assert got(A.report(df.withColumn("pair", F.lit(1)), byte_path, B_PATH)) == want
    assert got(A.report(df.repartition(3), byte_path, B_PATH, A.Settings(chars=40, memo=20))) == want


def test_given_documents(spark, byte_path, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert got(A.report(docs, byte_path, B_PATH)) == plain([tuple(r) for r in docs.collect()], libraries)


def test_empty_tables(spark, byte_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert A.report(none, byte_path, B_PATH).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert got(A.report(blank, byte_path, B_PATH)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
