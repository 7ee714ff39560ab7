"""Sets of five-word shingles as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WIDTH = 5
U = np.uint64
#: Odd multipliers (fixed values): of the byte polynomial, the mixer and the words of a shingle.
BASE = 0x9E3779B97F4A7C15
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
PLACES = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=U)
#: Texts are worked on in groups of about so many bytes; a longer text is a group of its own.
GROUP = 1 << 19

_fold = np.arange(256, dtype=np.int64)
_fold[65:91] += 32
#: A well-mixed number for each byte, upper case as lower case.
_value = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U)[_fold] | U(1)
_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= U(MIX[0])
    h ^= h >> U(33)
    h *= U(MIX[1])
    h ^= h >> U(33)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i below n."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            step = np.full(size, U(base), U)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


def _group(texts: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    if not len(data):
        yield from (np.empty(0, U) for _ in texts)
        return
    solid = ~_space[data]
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    first = begins[(begins < ends)]
    start[first] = solid[first]
    stop[ends[begins < ends] - 1] = solid[ends[begins < ends] - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_value[data] * up[: len(data)], out=sums[1:])
    words = mix((sums[e] - sums[s]) * down[s])
    lo, hi = np.searchsorted(s, begins), np.searchsorted(s, ends)
    rolled = np.zeros(max(len(words) - WIDTH + 1, 0), U)
    for k in range(WIDTH):
        rolled += words[k : len(words) - WIDTH + 1 + k] * PLACES[k]
    rolled = mix(rolled)
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if b - a >= WIDTH:
            h = np.sort(rolled[a : b - WIDTH + 1])
            yield h[np.concatenate(([True], h[1:] != h[:-1]))]
        elif b > a:
            yield mix((words[a:b] * PLACES[: b - a]).sum(keepdims=True, dtype=U) + U(b - a))
        else:
            yield np.empty(0, U)


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted; a text of one to four words has one, of no word none."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if held and size + len(b) > GROUP:
            yield from _group(held)
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield from _group(held)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    if not len(a) or not len(b):
        return False
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)
