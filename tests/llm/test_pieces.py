"""Encoding and decoding by a piece vocabulary, against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from rallylake.llm import pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def hostile(seed, n):
    rng = random.Random(seed)
    parts = ["a", "b", "the", "ing", " ", "  ", "▁", "\n", "\t", "\0", "é", "é", "日本", "梦", "\U0001f600", "Ａ", "1234", "<s>", "</s>", "<unk>", "<0x41>", "ﬁ", "​", "ￜ", "�"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(n)]


def test_ids_are_those_of_the_library(library):
    own = pieces.PieceEncoder(MODEL)
    texts = [*hostile(1, 3000), "", " ", "▁", " " * 70, "a" * 5000, "ab" * 3000 + " x", "\U0001f600Ａ" * 60]
    rows = own.encode(pa.array(texts))
    assert [x.tolist() for x in rows] == [library.encode(x) for x in texts]
    assert own.decode(rows) == [library.decode(x.tolist()) for x in rows]


def test_agenda_and_matrix_give_the_same_symbols(monkeypatch):
    texts = pa.array(hostile(2, 500))
    matrix = pieces.PieceEncoder(MODEL).encode(texts)
    monkeypatch.setattr(pieces.PieceEncoder, "SHORT", 0)
    assert [x.tolist() for x in pieces.PieceEncoder(MODEL).encode(texts)] == [x.tolist() for x in matrix]


def test_agenda_takes_the_best_and_of_equal_ones_the_leftmost():
    costs = {"ab": 2.0, "bc": 1.0, "abc": 3.0, "cc": 1.0}
    assert pieces.agenda("abc", costs) == ["abc"]
    assert pieces.agenda("bcc", costs) == ["bc", "c"]
    assert pieces.agenda("ccc", costs) == ["cc", "c"]
    assert pieces.agenda("", costs) == []


def test_a_small_cache_forgets_and_stays_right(library):
    own, texts = pieces.PieceEncoder(MODEL, 50), hostile(3, 600)
    for at in range(0, 600, 20):
        assert [x.tolist() for x in own.encode(pa.array(texts[at : at + 20]))] == [library.encode(x) for x in texts[at : at + 20]]


def test_any_ids_decode_as_in_the_library(library):
    own, rng = pieces.PieceEncoder(MODEL), random.Random(4)
    few = [0, 1, 2, 3, 60, *(3 + b for b in (0x81, 0x82, 0xA9, 0xC3, 0xE3, 0xED, 0xF0, 0xFF)), 259, 300, 5000, 28705, 31000]
    rows = [np.array(rng.choices(few, k=rng.randint(0, 9)), "<u4") for _ in range(5000)]
    rows += [np.array([rng.randrange(32000) for _ in range(rng.randint(1, 30))], "<u4") for _ in range(500)]
    assert own.decode(rows) == [library.decode(x.tolist()) for x in rows]


def test_query_on_odd_rows_and_the_given_table(spark, small, library):
    texts = [None, "", " ", "same", "same", "x" * 200_000, " ".join(hostile(5, 4000)), "<s> a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").unionByName(spark.createDataFrame([(None, "no id"), (3, "same")], "doc_id int, text string"))
    found = pieces.encode_decode(docs.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1)))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["ids"], r["decoded"]) for r in found.collect() if r["doc_id"] is not None) == sorted(
        (False, k, library.encode(t or ""), library.decode(library.encode(t or ""))) for k, t in [*enumerate(texts), (3, "same")]
    )
    assert [r["ids"] for r in found.where("doc_id is null").collect()] == [library.encode("no id")]
    assert pieces.encode_decode(docs.limit(0)).collect() == []
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    given = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op12_sentencepiece(spark, small).collect()
    assert len(rows) == len(given)
    for r in rows:
        ids = library.encode(given[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_a_difference_is_an_error():
    own = pieces.PieceEncoder(MODEL)
    texts = pa.array(["a text"])
    rows = own.encode(texts)
    own.compare(pa.array([7]), texts, rows, ["a text"])
    with pytest.raises(ValueError, match="row 7"):
        own.compare(pa.array([7]), texts, [rows[0][:-1]], ["a text"])
    with pytest.raises(ValueError, match="row 7"):
        own.compare(pa.array([7]), texts, rows, ["another"])


def test_a_wrong_chunk_is_an_error(monkeypatch):
    own, merged = pieces.PieceEncoder(MODEL), pieces.PieceEncoder._merged
    monkeypatch.setattr(own, "_merged", lambda chunks: (merged(own, chunks)[0], merged(own, chunks)[1] + np.uint32(1)))
    with pytest.raises(ValueError, match="chunk"):
        own.encode(pa.array(["some words"]))


def test_a_word_is_kept_once_whatever_stands_behind_it(library):
    own, words = pieces.PieceEncoder(MODEL), [f"w{a}rd{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(f"{w}{mark}{n}" for n, w in enumerate(words)) for mark in ".,;:!?"]
    assert [x.tolist() for x in own.encode(pa.array(texts))] == [library.encode(x) for x in texts]
    # 600 chunks of white space, word, mark and number, of which no piece crosses these bounds
    assert len(own.known) < 150


@pytest.mark.parametrize("text", ["some, words", "nine 9", "x\U0001f600"])
def test_a_wrong_chunk_without_white_space_is_an_error(monkeypatch, text):
    own, merged = pieces.PieceEncoder(MODEL), pieces.PieceEncoder._merged

    def wrong(chunks):
        lengths, ids = merged(own, chunks)
        begins = np.cumsum(lengths) - lengths
        ids[[b for b, x in zip(begins, chunks, strict=True) if x[0] != "▁"]] += 1
        return lengths, ids

    monkeypatch.setattr(own, "_merged", wrong)
    with pytest.raises(ValueError, match="chunk"):
        own.encode(pa.array([text]))


@pytest.mark.parametrize("options", [{"byte_fallback": True}, {}, {"byte_fallback": True, "split_by_whitespace": False}, {"byte_fallback": True, "add_dummy_prefix": False}])
def test_models_of_other_kinds(tmp_path, options):
    texts = hostile(6, 400)
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(texts), model_prefix=str(tmp_path / "m"), model_type="bpe", vocab_size=400, hard_vocab_limit=False, minloglevel=2, **options)
    own = pieces.PieceEncoder(str(tmp_path / "m.model"))
    rows = own.encode(pa.array(texts))
    assert [x.tolist() for x in rows] == [own.library.encode(x) for x in texts]
    assert own.decode(rows) == [own.library.decode(x.tolist()) for x in rows]
