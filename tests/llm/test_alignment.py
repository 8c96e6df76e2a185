"""Links of two tokenizers against brute force on whole texts."""

import hashlib
from bisect import bisect
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortry.llm import registry
from cohortry.llm.alignment import aligned_groups, link_scores
from cohortry.llm.text import read
from cohortry.llm.tokenizers import ByteTokenizer, PieceTokenizer, model_bytes, spaced_words

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "the cat's  mat\n\n sat.\tOn it ", "▁", "a ▁ b", "a▁b c", "<|endoftext|> x <s> </s>", "<0x41> é ÿ 🙂🙂 漢字 かな",
    "don't can't we'll  it's", "x" * 400, " " * 60 + "a", "\n" * 9 + "a \n b", "naïve café — “quoted”", "a b c　d e", "1234567 89,000.5", "\x00 \x1c y",
    "same words same words", "same words same words", "word " * 300, "tab\t space \t mix", "a\x85 b", "​ z᠎ w",
]


class Brute:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.a.encode_special_tokens = True
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        table = {chr(c): c for c in kept} | {chr(0x100 + n): c for n, c in enumerate(c for c in range(256) if c not in kept)}
        self.raw_a = lambda i: bytes(table[c] for c in self.a.id_to_token(i))
        self.raw_b = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = (" " + text).encode()
        if b"".join(map(self.raw_a, a)) != whole or b"".join(map(self.raw_b, b)) != whole:
            return []
        ends = []
        for ids, raw in ((a, self.raw_a), (b, self.raw_b)):
            at, out = 0, []
            for i in ids:
                at += len(raw(i))
                out.append(at)
            ends.append(out)
        both = sorted(set(ends[0]) & set(ends[1]))
        out, low = [], 0
        for high in both:
            out.append(tuple(ids[bisect(at, low) : bisect(at, high)] for ids, at in zip((a, b), ends)))
            low = high
        return out

    def rows(self, texts):
        made = [self.groups(t) for t in texts]
        links = [Counter((i, j) for a, b in g for i in a for j in b) for g in made]
        count = Counter(p for of in links for p in of)
        most = {}
        for (i, _), n in count.items():
            most[i] = max(n, most.get(i, 0))
        out = []
        for g, of in zip(made, links):
            told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(of.values()), sum(n for p, n in of.items() if count[p] == most[p[0]]),
                        sum(n * count[p] for p, n in of.items()), hashlib.sha256(told.encode()).hexdigest() if g else "", told))
        return out


@pytest.fixture(scope="module")
def brute():
    return Brute()


def got(found):
    return sorted(((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in found.collect()))


@pytest.mark.parametrize("block_bytes", [1 << 25, 40])
def test_odd_texts(spark, brute, block_bytes):
    kind = "doc_id long, text string, block long, pair long, n long, digest string"
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in enumerate(ODD)], kind).repartition(3)
    want = brute.rows(ODD)
    assert got(link_scores(docs, BYTES, PIECES, block_bytes=block_bytes)) == sorted((str(i), *w[:-1]) for i, w in enumerate(want))
    plain = aligned_groups(docs, BYTES, PIECES, block_bytes=block_bytes).collect()
    assert {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["groups"]) for r in plain} == {i: (*w[:3], w[-1]) for i, w in enumerate(want)}


def test_registered_query(spark, sf_dir, brute):
    rows = read(spark, sf_dir, "documents").collect()
    want = brute.rows([r["text"] for r in rows])
    assert got(registry.op13_token_links(spark, sf_dir)) == sorted((str(r["doc_id"]), *w[:-1]) for r, w in zip(rows, want))


def test_repeated_and_null_ids(spark, brute):
    rows = [(1, "one two"), (1, "one two"), (None, "null id"), (None, None), (2, "▁ no")]
    want = brute.rows([t for _, t in rows])
    assert got(link_scores(spark.createDataFrame(rows, "doc_id long, text string"), BYTES, PIECES)) == sorted((str(i), *w[:-1]) for (i, _), w in zip(rows, want))


def test_very_long_text(spark, brute):
    text = " ".join(f"wörd{i % 4001}, {'ab' * (i % 5)}" for i in range(30_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    [r] = aligned_groups(docs, BYTES, PIECES).collect()
    a, b = brute.a.encode(" " + text, add_special_tokens=False).ids, brute.b.encode(text)
    assert (r["n_a"], r["n_b"]) == (len(a), len(b))
    assert [i for g in r["groups"].split(";") for i in map(int, g.split("|")[0].split(","))] == a
    assert [i for g in r["groups"].split(";") for i in map(int, g.split("|")[1].split(","))] == b


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert link_scores(empty, BYTES, PIECES).collect() == [] and aligned_groups(empty, BYTES, PIECES).collect() == []


def test_long_groups_are_counted_by_ids(spark, brute, monkeypatch):
    import numpy as np

    from cohortry.llm import alignment

    with open(BYTES, "rb") as x, open(PIECES, "rb") as y:
        sides = alignment._sides(x.read(), y.read())
    found = alignment._Windows(*sides)
    ids_a, ids_b = np.array([5, 7, 5] * 40), np.array([3, 4] * 50)
    found.align(ids_a, ids_b, np.array([120]), np.array([100]), np.array([0]), np.array([1]))
    listed, sizes, place, weight = found.pairs()
    assert {(int(p >> 32), int(p & 0xFFFFFFFF)): int(weight[k]) for k, p in zip(np.argsort(place), listed)} == {(5, 3): 4000, (5, 4): 4000, (7, 3): 2000, (7, 4): 2000}
    assert sizes.tolist() == [4] and found.text[0].count(",") == 218


def test_words_are_tokenised_alone(brute):
    with open(BYTES, "rb") as file:
        words = ByteTokenizer(file.read())
    assert words.ranks is not None
    pieces = PieceTokenizer(model_bytes(PIECES))
    for text in [*filter(None, ODD), "".join(chr(c) + (" x" if c % 7 == 0 else "") for c in [*range(1, 0xD800), *range(0xE000, 0x11000)])]:
        cut = spaced_words(text)
        assert "".join(cut) == " " + text
        assert words.segment(cut)[0].tolist() == brute.a.encode(" " + text, add_special_tokens=False).ids
        assert "\u2581" in text or pieces.flat(cut, pieces.token_bytes())[0].tolist() == brute.b.encode(text)
