"""Signatures and similarities of shingle sets and multisets, on numpy arrays.

All functions take whole texts and work on a batch at a time; memory is bounded
by ``UNIT`` bytes of text and by the longest single text.
"""

from __future__ import annotations

import numpy as np

from .wordcache import word_hashes

UNIT = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15

_WORD = np.zeros(256, dtype=bool)
_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", dtype=np.uint8)] = True
_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def units(texts: list[str]):
    """Ranges of texts of about UNIT characters."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > UNIT:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def words(texts: list[str], tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word, in order.  Words are runs of letters and digits, case folded."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    is_word = _WORD[data]
    edge = np.diff(is_word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stops = np.cumsum(np.array([len(r) + 1 for r in raw]))
    hashes = mix(word_hashes(data.astype(np.uint64) + _U(1), starts, ends, _BASE, tables) + (ends - starts).astype(np.uint64))
    return np.searchsorted(stops, starts, side="right"), hashes


def word_shingles(texts: list[str], k: int, tables: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of shingles of k words: (text number, shingle, count), and two digests of each text's words.

    A text of fewer than k words is one shingle; one without words has none.
    """
    doc, h = words(texts, tables)
    n = len(texts)
    size = np.bincount(doc, minlength=n)
    begin = np.cumsum(size) - size
    place = np.arange(len(doc)) - begin[doc]
    one, two = (np.zeros(n, dtype=np.uint64) for _ in range(2))
    for out, base in ((one, 0xD6E8FEB86659FD93), (two, 0xA0761D6478BD642F)):
        np.add.at(out, doc, mix(h + mix(place.astype(np.uint64) * _U(base) + _U(base))))
        out += size.astype(np.uint64) * _U(base)
    key = np.zeros(len(doc), dtype=np.uint64)
    odd = _U(0xE7037ED1A0B428DB)
    for j in range(k):
        part = np.zeros(len(doc), dtype=np.uint64)
        part[: len(doc) - j] = h[j:] if j else h
        inside = place + j < size[doc]
        key = np.where(inside, (key + part) * odd, key)
        key ^= key >> _U(29)
    whole = place + k <= size[doc]
    keep = whole | ((place == 0) & (size[doc] < k))
    doc, key = doc[keep], mix(key[keep])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(first)
    return doc[at], key[at], np.diff(np.append(at, len(doc))), mix(one), mix(two)


def bag_minhash(doc: np.ndarray, key: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures (n, m) of weighted sets with whole weights.

    Each element has Poisson processes over its weight axis, cut into the shells
    [0, 1), [1, 2), [2, 4), [4, 8), ...: a shell's process has the rate of its
    width, and each of its points belongs to one unit of the shell, so an element
    of weight w takes the points of all units below w - the same points for any
    two texts that hold that unit.  A point also belongs to one of m registers;
    the earliest point of a register names it.  Two texts agree in a register
    with the probability of their weighted Jaccard similarity.  Points are made
    in ascending order and only up to a time when all registers are surely
    taken; texts for which that fails go on to twice that time.
    """
    best = np.full(n * m, np.inf)
    name = np.zeros(n * m, dtype=np.uint64)
    total = np.bincount(doc, weights=count, minlength=n)
    limit = (np.log(m) + 3.0) / np.maximum(total, 1)
    top = np.frexp(np.maximum(count - 1, 0))[1]  # the last shell
    reps = top + 1
    who = np.repeat(np.arange(len(doc)), reps)
    shell = np.arange(len(who)) - np.repeat(np.cumsum(reps) - reps, reps)
    low = np.where(shell > 0, 2.0 ** (shell - 1), 0.0)
    width = np.where(shell > 0, low, 1.0)
    seed = mix(key[who] + mix(shell.astype(np.uint64) + _U(0x51ED270B)))
    d, w = doc[who], count[who]
    todo = np.ones(len(who), dtype=bool)
    while todo.any():
        at = np.flatnonzero(todo)
        x = np.zeros(len(at))
        step = 0
        while len(at):
            step += 1
            r = mix(seed[at] + _U(step * 0x9FB21C651E98DF25 % 2**64))
            x = x - np.log(uniform(r)) / (m * width[at])
            live = x <= limit[d[at]]
            at, x, r = at[live], x[live], r[live]
            if not len(at):
                break
            r2 = mix(r ^ _U(0xD1B54A32D192ED03))
            reg = ((r2 >> _U(32)) * _U(m)) >> _U(32)
            unit = low[at] + np.floor((r2 & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width[at])
            own = unit < w[at]
            slot, px, pr = d[at[own]] * m + reg[own].astype(np.int64), x[own], r[own]
            better = px < best[slot]
            slot, px, pr = slot[better], px[better], pr[better]
            np.minimum.at(best, slot, px)
            won = best[slot] == px
            name[slot[won]] = pr[won]
        short = np.isinf(best).reshape(n, m).any(axis=1) & (total > 0)
        if not short.any():
            break
        limit[short] *= 2
        again = np.flatnonzero(short)
        cells = (again[:, None] * m + np.arange(m)).ravel()
        best[cells] = np.inf
        todo = short[d]
    return name.reshape(n, m)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A key for each run of so many registers; the run's number is part of it."""
    n, m = signature.shape
    out = np.zeros((n, m // rows), dtype=np.uint64)
    for b in range(m // rows):
        key = np.full(n, mix(np.array([b + 1], dtype=np.uint64))[0], dtype=np.uint64)
        for r in range(rows):
            key = mix(key + signature[:, b * rows + r])
        out[:, b] = key
    return out


def char_shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each shingle of k characters; a shorter text is one shingle, filled up with zeros."""
    fill = "\0" * (k - 1)
    data = np.frombuffer("".join([t + fill for t in texts]).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    # blocks of 1, 2, 4, ... characters, and from them of k
    n, wide, block = len(data), 1, data
    h, have = None, 0
    base = _BASE
    while True:
        if k & wide:
            h = block[: n - k + 1] if h is None else h * _U(base) + block[have : have + n - k + 1]
            have += wide
        if 2 * wide > k:
            break
        block = block[:-wide] * _U(base) + block[wide:]
        base = base * base % 2**64 | 1
        wide *= 2
    size = np.array([len(t) for t in texts])
    slots = size + k - 1
    valid = np.maximum(size - k + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(texts)), slots)[: len(h)]
    place = np.arange(len(h)) - (np.cumsum(slots) - slots)[doc]
    keep = place < valid[doc]
    return doc[keep], mix(h[keep])


def one_permutation(doc: np.ndarray, h: np.ndarray, n: int, m: int) -> np.ndarray:
    """MinHash signatures (n, m) with one hash for each shingle: its high bits choose the register.

    An empty register takes the value of another, in an order that depends on the
    register alone, so equal sets keep equal signatures.
    """
    top = np.iinfo(np.uint64).max
    sig = np.full(n * m, top, dtype=np.uint64)
    slot = doc * m + (((h >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
    np.minimum.at(sig, slot, (h << _U(32)) | (h >> _U(32)))
    sig = sig.reshape(n, m)
    full = sig != top
    out = sig.copy()
    attempt = 0
    r, c = np.nonzero(~full & full.any(axis=1)[:, None])
    while len(r):
        attempt += 1
        source = (mix(c.astype(np.uint64) * _U(1_000_003) + _U(attempt)) % _U(m)).astype(np.int64)
        ok = full[r, source]
        out[r[ok], c[ok]] = sig[r[ok], source[ok]] + _U(attempt)
        r, c = r[~ok], c[~ok]
    return out
