"""The binary Golay code of length 23, and fuzzy keys that it gives to 64-bit fingerprints.

Every vector of 23 bits lies within 3 bits of exactly one of 4096 codewords. The
keys of a vector are the codewords to which it and its neighbours at one bit decode:
one or six. So of two vectors at one bit from each other, each has the other's own
codeword among its keys.

A fingerprint has three segments, A of 22 bits and B, C of 21, padded with zeros.
Two fingerprints that differ in 3 bits or fewer either differ in one bit at most
in every segment, or two segments differ in no bit and one bit at most. So a family
of keys joins the codewords of all three, and six families join one segment's bits with
another one's codeword. A row of a key is ``LEFT`` if the key comes from a neighbour on the
left side of the join, ``RIGHT`` on the right side; links are between one of each.
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the code.
POLYNOMIAL = 0b101011100011
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
LEFT, RIGHT = 1, 2


def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= POLYNOMIAL << (bit - 11)
    return v


_SINGLE = [_remainder(1 << b) for b in range(23)]
#: Syndromes of the three bytes of a vector.
_BYTES = np.zeros((3, 256), np.uint32)
for _b, _s in enumerate(_SINGLE):
    _BYTES[_b // 8] ^= np.where(np.arange(256) >> (_b % 8) & 1, np.uint32(_s), np.uint32(0))
#: The error of at most 3 bits that has each syndrome.
_LEADER = np.zeros(2048, np.uint32)
for _n in (1, 2, 3):
    for _c in combinations(range(23), _n):
        _at = 0
        for _b in _c:
            _at ^= _SINGLE[_b]
        _LEADER[_at] = sum(1 << _b for _b in _c)


def decode(v: np.ndarray) -> np.ndarray:
    """The index, below 4096, of the codeword within 3 bits."""
    v = v.astype(np.uint32)
    syndrome = _BYTES[0][v & 255] ^ _BYTES[1][v >> 8 & 255] ^ _BYTES[2][v >> 16]
    return (v ^ _LEADER[syndrome]) >> 11


def around(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, is its own) of the different keys of each vector of ``bits`` bits."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    keys = decode(v[:, None].astype(np.uint32) ^ flips)
    own = keys[:, 0].copy()
    keys.sort(axis=1)
    new = np.concatenate([np.ones((len(v), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
    row, at = np.nonzero(new)
    key = keys[row, at]
    return row, key, key == own[row]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``fp`` (uint64) -> (key int64, role int8, fp) rows."""
    fp = fp.astype(np.uint64)
    seg = [(fp >> np.uint64(lo)) & np.uint64((1 << n) - 1) for lo, n in SEGMENTS]
    near = [around(s, n) for s, (_, n) in zip(seg, SEGMENTS)]
    own = [decode(s).astype(np.uint64) for s in seg]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for family, (i, j) in enumerate(permutations(range(3), 2)):
        row, key, is_own = near[j]
        joined = np.uint64(family << 60) | seg[i][row] << np.uint64(12) | key.astype(np.uint64)
        out.append((joined, np.where(is_own, LEFT | RIGHT, LEFT), fp[row]))
    three = lambda a, b, c: np.uint64(6 << 60) | a.astype(np.uint64) << np.uint64(24) | b.astype(np.uint64) << np.uint64(12) | c.astype(np.uint64)
    ra, ka, _ = near[0]
    rc, kc, _ = near[2]
    n_c = np.bincount(rc, minlength=len(fp))
    first_c = np.cumsum(n_c) - n_c
    row = np.repeat(ra, n_c[ra])  # each key of A with each key of C
    a = np.repeat(ka, n_c[ra])
    c = kc[np.arange(len(row)) - np.repeat(np.cumsum(n_c[ra]) - n_c[ra], n_c[ra]) + first_c[row]]
    out.append((three(a, own[1][row], c), np.full(len(row), LEFT), fp[row]))
    rb, kb, _ = near[1]
    out.append((three(own[0][rb], kb, own[2][rb]), np.full(len(rb), RIGHT), fp[rb]))
    key, role, fps = (np.concatenate(x) for x in zip(*out))
    return key.view(np.int64), role.astype(np.int8), fps
