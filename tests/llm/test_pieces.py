"""Encoding by distinct marked words against the library on whole texts, round trips, odd rows."""

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from cohortry.llm import registry
from cohortry.llm.pieces import decode, encode
from cohortry.llm.text import read
from cohortry.llm.tokenizers import PieceTokenizer, marked_words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "   a", "a ", "a  b", "a   b    c  ", "▁", "▁a", "a▁b", " ▁ a", "a▁ ▁b", "\n", "\t x\n\n y", "<s> </s> <unk> <0x41>",
    "a b c　d", "日本語のテキスト 漢字", "🙂🙂 é ÿ", "a\x00b c", "x" * 3000, " " * 300, "ab " * 5000, "\U000e0001 �",
    "naïve café — “quoted”", "１２３ ﬁne", "don't can't", "a\r\nb",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def compare(found, texts, library):
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in found.collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        ids = library.encode(text or "")
        assert got[i] == (ids, library.decode(ids)), text


@pytest.mark.parametrize("block_bytes", [1 << 25, 500])
def test_same_as_library(spark, library, block_bytes):
    texts = list(enumerate(ODD))
    docs = spark.createDataFrame([(i, t, "b", 1, None) for i, t in texts], "doc_id long, text string, block string, part int, ids string")
    compare(decode(encode(docs, MODEL, block_bytes=block_bytes), MODEL), texts, library)
    compare(encode(docs, MODEL, decoded=True, block_bytes=block_bytes), texts, library)


def test_given_documents(spark, sf_dir, library):
    docs = read(spark, sf_dir, "documents")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    compare(decode(encode(docs, MODEL, block_bytes=100_000), MODEL), texts, library)


def test_repeated_and_null_ids(spark, library):
    rows = [(1, "one two"), (1, "one two"), (1, "other"), (None, "null id"), (None, "null id"), (None, None)]
    found = encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in found) == sorted((str(i), library.encode(t or "")) for i, t in rows)


def test_very_long_text(spark, library):
    text = " ".join(f"w{i % 7001}é{i % 13}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string")
    compare(decode(encode(docs, MODEL), MODEL), [(1, text), (2, "x " + text)], library)


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


def test_decode_of_any_ids(spark, library):
    rows = [(1, [1, 306, 2, 0, 200, 29871, 29871]), (2, []), (3, None), (4, [None, 5, 31999])]
    found = decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), MODEL)
    assert {r["doc_id"]: r["decoded"] for r in found.collect()} == {i: library.decode([x for x in ids or [] if x is not None]) if ids else "" for i, ids in rows}


def test_words_join_to_the_text():
    for text in ODD:
        assert "".join(marked_words(text or "")) == ("▁" + text.replace(" ", "▁") if text else "")


def test_models_that_join_words_are_refused():
    with open(MODEL, "rb") as file:
        given = file.read()
    for change in (lambda p: setattr(p.pieces[400], "piece", "a▁b"), lambda p: setattr(p.normalizer_spec, "remove_extra_whitespaces", True),
                   lambda p: setattr(p.trainer_spec, "treat_whitespace_as_suffix", True), lambda p: setattr(p.normalizer_spec, "add_dummy_prefix", False)):
        proto = sentencepiece_model_pb2.ModelProto.FromString(given)
        change(proto)
        with pytest.raises(ValueError):
            PieceTokenizer.checked(proto.SerializeToString())
    assert PieceTokenizer.checked(given) == given


def test_registered_query(spark, sf_dir, library):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in read(spark, sf_dir, "documents").collect()}
    rows = registry.op11_piece_ids(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
