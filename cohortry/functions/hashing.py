"""Randomness derived from keys: the same row always draws the same number, on any partitioning."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Cumulative Poisson(1) probabilities up to twelve events.
POISSON_ONE = [round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)), 12) for k in range(13)]


def _digest(parts) -> Column:
    return F.md5(F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts]))


def hash_uniform(*parts) -> Column:
    """Uniform draw in [0, 1) from the md5 of the parts joined by '|'; plain values are literals."""
    return F.conv(F.substring(_digest(parts), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_below(bound: float, *parts) -> Column:
    """Whether :func:`hash_uniform` of the parts lies below the bound (over 0, up to 1): the digits are compared as they stand."""
    first = math.ceil(bound * 4294967296.0)
    return F.lit(True) if first > 0xFFFFFFFF else _digest(parts) < F.lit(f"{first:08x}")


def poisson_weight(u: Column) -> Column:
    """Poisson(1) multiplicity of a uniform draw, the per-row form of resampling n out of n."""
    weight = F.lit(0)
    for bound in POISSON_ONE:
        weight = weight + (u >= F.lit(bound)).cast("int")
    return weight


# The tables of RFC 1321.
_SINES = [int(abs(math.sin(i + 1)) * 4294967296.0) for i in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _rounds(words: list, shape: tuple) -> list[np.ndarray]:
    """MD5 of one block each; sixteen words that broadcast to the shape, or None where they are zero."""
    a, b, c, d = (np.full(shape, np.uint32(v)) for v in _START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn < 2:  # choose by the bits of one word between two others
            by, one, two = (b, c, d) if turn == 0 else (d, b, c)
            np.bitwise_xor(one, two, out=f)
            np.bitwise_and(f, by, out=f)
            np.bitwise_xor(f, two, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
        np.add(f, a, out=f)
        np.add(f, np.uint32(_SINES[i]) if word is None else word + np.uint32(_SINES[i]), out=f)
        left = np.uint32(_TURNS[turn][i % 4])
        np.right_shift(f, np.uint32(32) - left, out=g)
        np.left_shift(f, left, out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [v + np.uint32(s) for v, s in zip((a, b, c, d), _START)]


def multiplicities(units: list[str], replicates: int, seed: int) -> np.ndarray:
    """Units x replicates: the draws of a bootstrap in single bytes, the same as ``resample.replicate_rows`` gives by columns.

    The digests of texts of one length are computed together, one array operation per step of MD5; a text that doesn't fit into
    one block goes by itself.
    """
    blocks = (replicates + 3) // 4
    out = np.empty((len(units), blocks, 4), np.uint8)
    bounds = [math.ceil(p * 4294967296.0) for p in POISSON_ONE]
    texts = [u.encode() for u in units]
    heads: dict[int, list[int]] = {}
    for b in range(blocks):
        heads.setdefault(len(str(b)), []).append(b)
    tails: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        tails.setdefault(len(text), []).append(i)
    for size, rows in tails.items():
        ends = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8).reshape(len(rows), size)
        for numbers in heads.values():
            starts = [f"boot|{seed}|{b}|".encode() for b in numbers]
            whole = len(starts[0]) + size
            if whole > 55:
                for i in rows:
                    for b, start in zip(numbers, starts):
                        out[i, b] = _drawn(np.frombuffer(md5(start + texts[i]).digest(), ">u4"), bounds)
                continue
            # a block is the start, which differs by column, and the end, which differs by row: words add up as bytes don't overlap
            left = np.zeros((len(numbers), 64), np.uint8)
            left[:, :len(starts[0])] = np.frombuffer(b"".join(starts), np.uint8).reshape(len(numbers), -1)
            left[:, whole] = 0x80
            left[:, 56:58] = 8 * whole & 0xFF, 8 * whole >> 8
            right = np.zeros((len(rows), 64), np.uint8)
            right[:, len(starts[0]):whole] = ends
            left, right = left.view("<u4"), right.view("<u4")
            step = max(1, 8192 // len(numbers))
            for low in range(0, len(rows), step):
                part = right[low:low + step]
                words = []
                for w in range(16):
                    by_column, by_row = left[:, w].any(), part[:, w].any()
                    words.append(left[None, :, w] + part[:, None, w] if by_column and by_row else left[None, :, w] if by_column else part[:, None, w] if by_row else None)
                digest = _rounds(words, (len(part), len(numbers)))
                at = np.ix_(rows[low:low + step], numbers)
                for k, v in enumerate(digest):
                    out[(*at, k)] = _drawn(v.byteswap(), bounds)
    return out.reshape(len(units), -1)[:, :replicates]


def _drawn(words: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Number of bounds that each word reaches, without a search: few words reach the later ones."""
    n = np.zeros(words.shape, np.uint8)
    for bound in bounds:
        if bound > 0xFFFFFFFF:
            break
        reached = words >= np.uint32(bound)
        if not reached.any():
            break
        n += reached
    return n
