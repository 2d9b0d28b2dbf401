"""Splits texts for byte-level BPE without a Python object for each word."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import cache

import numpy as np
import regex
import tiktoken

#: Fixed value: the pattern that `split` follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE, LETTER, NUMBER, OTHER = range(4)


@cache
def character_kinds() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for each code point, as the installed tiktoken's tables of characters say.

    An encoding whose pieces are single bytes gives back what its pattern matches and nothing else, so each class is asked for once.
    """
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(probe.encode_ordinary(every)).decode()
        kinds[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return kinds


def split(offsets: np.ndarray, data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Byte places at which a match of PATTERN starts, in texts that lie one after another (UTF-8).

    Matches follow each other without gaps, so each ends where the next starts.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    byte = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(points)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(byte, offsets)] = True  # a text's start, or the end of the last
    kind = kinds[points]
    starts = edge[:-1].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # a run of white space leaves its last character to what follows: a space joins it, any other stands alone
    ends = np.flatnonzero(edge[1:] | np.append(starts[1:], True))
    last = ends[(kind[ends] == SPACE) & ~edge[ends + 1]]
    starts[last] = True
    starts[last[points[last] == 32] + 1] = False
    # contractions begin a match at an apostrophe and cut into the letters behind it
    mark = np.flatnonzero((points == 39) & starts)
    mark = mark[(mark + 1 < n)]
    mark = mark[~edge[mark + 1]]
    one = np.isin(points[mark + 1], [ord(c) for c in "stmd"])
    pairs = [tuple(map(ord, p)) for p in ("re", "ve", "ll")]
    far = mark[~one]
    far = far[(far + 2 < n)]
    far = far[~edge[far + 2]]
    two = np.zeros(len(far), bool)
    for a, b in pairs:
        two |= (points[far + 1] == a) & (points[far + 2] == b)
    for at, size in ((mark[one], 2), (far[two], 3)):
        starts[at + 1] = False
        after = at + size
        after = after[after < n]
        starts[after] = True
    return byte[starts]


#: (offsets of some texts, their bytes) -> where their matches start
Splitter = Callable[[np.ndarray, np.ndarray], np.ndarray]


def splitter_of(pattern: str) -> Splitter:
    """Splits by PATTERN with arrays, and by any other pattern whose matches cover a text match by match.

    The first has tiktoken's tables of characters, made here on the driver and sent along; the others those of the module regex.
    """
    if pattern == PATTERN:
        kinds = character_kinds()
        return lambda offsets, data: split(offsets, data, kinds)

    def run(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        find, out = regex.compile(pattern).finditer, []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            at = a
            for m in find(data[a:b].tobytes().decode()):
                out.append(at)
                at += len(m[0].encode())
            if at != b:
                raise ValueError("the pattern leaves out a part of a text")
        return np.array(out, np.int64)

    return run
