"""Public tokenizers inside tasks, and cuts of a text between which no token passes."""

from __future__ import annotations

import json
import os
import re
from functools import cache
from unicodedata import ucd_3_2_0

import numpy as np
import sentencepiece
import tiktoken
from sentencepiece import sentencepiece_model_pb2

MARK = "▁"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")
# a space after a letter, digit or printable ASCII sign: both kinds of tokenizer always begin a token there
_BEFORE_SPACE = re.compile(r"(?<=[\w!-~])(?= )")

_ENDS_SAFE = re.compile(r"[\w!-~]\Z").search


class _Known:
    """Characters of the basic plane that already the oldest table at hand assigns: classes of later ones differ among libraries."""

    @staticmethod
    @cache
    def table() -> frozenset:
        return frozenset(chr(c) for c in range(0x10000) if ucd_3_2_0.category(chr(c)) not in ("Cn", "Co", "Cs"))

    def issuperset(self, word: str) -> bool:
        return self.table().issuperset(word)


_KNOWN = _Known()


def model_bytes(path: str) -> bytes:
    """A vocabulary file, read once by the driver (a few MB) and sent along with the functions that need it."""
    with open(path, "rb") as file:
        return file.read()


def marked_words(text: str) -> list[str]:
    """Marked words of a text: each run of whitespace markers with what follows; the first marker is the added one."""
    return _MARKED.findall(MARK + text.replace(" ", MARK)) if text else []


def spaced_words(text: str) -> list[str]:
    """A space and the text, cut before every space that follows a letter, digit or printable ASCII sign."""
    return _BEFORE_SPACE.split(" " + text)


class Numbered(dict):
    """Numbers keys in order of their first use."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class PieceTokenizer:
    """A sentencepiece model whose pieces don't cross whitespace markers, so that marked words can be segmented one by one.

    That holds for BPE models without normalisation that add a marker in front, mark spaces as prefixes and have no piece with
    a marker after another character; any other model is refused.
    """

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.alone = [self.library.piece_to_id(MARK)]

    @staticmethod
    def checked(model: bytes) -> bytes:
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm, trained = proto.normalizer_spec, proto.trainer_spec
        crossing = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.add_dummy_prefix and norm.escape_whitespaces
        if crossing or not plain or trained.treat_whitespace_as_suffix or trained.model_type != trained.BPE or MARK not in {p.piece for p in proto.pieces}:
            raise ValueError("pieces of this model may cross whitespace markers, or it changes texts before segmenting them")
        return model

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words (or words with a space in front). The library adds the first marker itself, but not to an empty text."""
        ids = self.library.encode([w[1:] for w in words], num_threads=1)
        return [found if len(w) > 1 else self.alone for w, found in zip(words, ids)]

    def flat(self, words: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a space in front, one word after the other, and their number per word; words without markers go many at once."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        joinable = [len(w) > 1 and MARK not in w and w[-1] != " " for w in words]
        out, count = [], np.zeros(len(words), np.int64)
        low = 0
        while low < len(words):
            high = low + 1
            while high < len(words) and high - low < 50_000 and joinable[high] == joinable[low]:
                high += 1
            if joinable[low]:
                ids = np.array(self.library.encode("".join(words[low:high])[1:]), np.int64)
                count[low:high] = _split_counts(ids, size, words[low:high])
                out.append(ids)
            else:
                found = self.segment(words[low:high])
                count[low:high] = [len(f) for f in found]
                out += [np.array(f, np.int64) for f in found]
            low = high
        return np.concatenate(out) if out else np.zeros(0, np.int64), count

    def token_bytes(self) -> list[bytes]:
        """Bytes of every id: the piece with markers as spaces; <0xHH> as that byte."""
        of = self.library
        return [bytes([int(of.id_to_piece(i)[3:-1], 16)]) if of.is_byte(i) else of.id_to_piece(i).replace(MARK, " ").encode()
                for i in range(of.get_piece_size())]


class ByteTokenizer:
    """A byte-level BPE tokenizer given as JSON; special strings inside texts are plain text.

    Merging by rank needs the vocabulary alone where every merge makes the next id, which is checked; words of characters that all
    tables of character classes know go that way, many at once. Other words go through the JSON's own library.
    """

    #: fixed value: the pattern by which byte-level tokenizers cut texts
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, model: bytes):
        self.model = json.loads(model)
        self.source, self._library = model, None
        vocab, merges = self.model["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in self.model["model"]["merges"]]
        self.raw = self._token_bytes(vocab)
        cut = self.model.get("pre_tokenizer") or {}
        ranked = all(vocab.get(x + y) == 256 + i for i, (x, y) in enumerate(merges)) and all(len(self.raw[i]) == 1 for i in range(256))
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not self.model.get("normalizer")
        self.ranks = None
        if ranked and plain and not self.model["model"].get("ignore_merges"):
            ranks = {self.raw[i]: i for i in range(256 + len(merges))}
            self.ranks = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))

    @property
    def library(self):
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.source.decode())
            self._library.encode_special_tokens = True
        return self._library

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after the other, and their number per word."""
        joinable = [self.ranks is not None and bool(_ENDS_SAFE(w)) and (w.isascii() or _KNOWN.issuperset(w)) for w in words]
        out, count = [], np.zeros(len(words), np.int64)
        low = 0
        while low < len(words):
            high = low + 1
            while high < len(words) and high - low < 50_000 and joinable[high] == joinable[low]:
                high += 1
            if joinable[low]:
                ids = self.ranks.encode_to_numpy("".join(words[low:high])).astype(np.int64)
                count[low:high] = _split_counts(ids, self.size, words[low:high])
                out.append(ids)
            else:
                for k in range(low, high, 5000):
                    found = [e.ids for e in self.library.encode_batch(words[k : min(high, k + 5000)], add_special_tokens=False)]
                    count[k : k + len(found)] = [len(f) for f in found]
                    out += [np.array(f, np.int64) for f in found]
            low = high
        return np.concatenate(out) if out else np.zeros(0, np.int64), count

    def token_bytes(self) -> list[bytes]:
        return self.raw

    @staticmethod
    def _token_bytes(vocab: dict[str, int]) -> list[bytes]:
        """Bytes of every id. Byte-level entries write printable Latin-1 bytes as themselves and the others from U+0100 on."""
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        back = {chr(b): b for b in kept}
        back.update({chr(0x100 + n): b for n, b in enumerate(sorted(set(range(256)) - set(kept)))})
        out = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            out[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
        return out


def _split_counts(ids: np.ndarray, size: np.ndarray, words: list[str]) -> np.ndarray:
    """Tokens per word of joined words; raises where a token crosses the end of a word."""
    ends = np.cumsum(size[ids])
    stops = np.cumsum(np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in words), np.int64, len(words)))
    last = np.searchsorted(ends, stops)
    if len(ids) == 0 or last[-1] >= len(ends) or (ends[last] != stops).any():
        raise RuntimeError("tokens don't give the joined words back")
    return np.diff(last, prepend=-1)
