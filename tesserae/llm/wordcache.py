"""Encoding with a public tokenizer at corpus speed.

A GPT-2 style pre-tokenizer never joins text across a single space that stands
between two non-space characters.  So a batch of texts is cut at such spaces,
equal chunks (the chunk and the space in front of it) are found with numpy, and
the tokenizers library encodes every chunk that the Python worker has not met
yet.  Texts with runs of white space or special-token strings go to the library
whole.  The ids are always those of ``Tokenizer.encode`` on the whole text.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Chunks, and words, that a worker remembers, about 200 bytes each; then it starts afresh.
MAX_CHUNKS = 700_000
#: Bytes of text taken at once; numpy needs about 80 times as much.
UNIT = 1 << 18

_RUN = re.compile(r"\s\s")
_TAIL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, tables: dict) -> np.ndarray:
    """A 64-bit polynomial hash of codes[start:end] for each pair, whatever its place."""
    n = len(codes) + 1
    if base not in tables or len(tables[base][0]) < n:
        tables[base] = powers(base, n), powers(pow(base, -1, 1 << 64), n)
    up, down = tables[base]
    total = np.zeros(n, dtype=np.uint64)
    np.cumsum(codes * up[: n - 1], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class ChunkEncoder:
    """uint32 ids of whole texts, in bounded memory."""

    def __init__(self, path: str, most: int = MAX_CHUNKS):
        self.most = most
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        newline = self._ids("\n")
        self.newline = int(newline[0]) if len(newline) == 1 else None
        self.known: dict[int, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.tables: dict = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encode_cores(self, cores: list[str]) -> None:
        """Letter-only words, each with a space in front; newlines between them are tokens of their own."""
        step = 64 if self.newline is not None else 1
        groups = [cores[i : i + step] for i in range(0, len(cores), step)]
        for group, e in zip(groups, self.tok.encode_batch_fast(["\n".join([" " + c for c in g]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.newline)).tolist() if step > 1 else []
            for c, a, b in zip(group, [0, *[x + 4 for x in cuts]], [*cuts, len(raw)]):
                self.cores[c] = raw[a:b]

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of ' ' + chunk: a word of letters and the punctuation after it never meet in one token."""
        if len(self.cores) > self.most:
            self.cores = {}
        cut = [(c.rstrip(_TAIL)) for c in chunks]
        whole = [core.isalpha() for core in cut]
        self._encode_cores(list({core for core, w in zip(cut, whole) if w and core not in self.cores}))
        rest = list({" " + c for c, w in zip(chunks, whole) if not w} | {c[len(core) :] for c, core, w in zip(chunks, cut, whole) if w and len(core) < len(c)})
        got = dict(zip(rest, (np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(rest, add_special_tokens=False))))
        return [self.cores[core] + (got[c[len(core) :]] if len(core) < len(c) else b"") if w else got[" " + c] for c, core, w in zip(chunks, cut, whole)]

    def _unit(self, parts: list[str]) -> list[np.ndarray]:
        """parts: texts, or later parts of one, that begin where a chunk begins; all but first words count their space."""
        raw = [p.encode() for p in parts]
        buf = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        ends = np.flatnonzero(buf == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        codes = buf.astype(np.uint64) + np.uint64(1)
        one, two = (word_hashes(codes, starts, ends, b, self.tables) for b in _BASES)
        uniq, first, inv = np.unique(one, return_index=True, return_inverse=True)
        if (two[first][inv] != two).any():  # two chunks with one hash
            return [self._ids(p) for p in parts]
        check = two[first]
        keys = (uniq ^ (check << np.uint64(1))).tolist()
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        missing = [i for i, k in enumerate(keys) if k not in known]
        if missing:
            data = buf.tobytes()
            at = first[missing]
            words = [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            known.update(zip((keys[i] for i in missing), self._learn(words)))
        pieces = [known[k] for k in keys]
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), dtype="<u4")
        begin = np.cumsum(size) - size
        n = size[inv]
        stop = np.cumsum(n)
        ids = flat[np.repeat(begin[inv] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
        last = np.cumsum([p.count(b" ") + 1 for p in raw])  # chunks up to the end of each part
        out, a = [], 0
        for b in last.tolist():
            out.append(ids[stop[a] - n[a] : stop[b - 1]])
            a = b
        return out

    def encode(self, texts: list) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        out: list = [None] * len(texts)
        unit: list[tuple[int, str, str]] = []
        size = 0

        def flush():
            nonlocal unit, size
            if unit:
                for (i, head, _), ids in zip(unit, self._unit([p for _, _, p in unit])):
                    ids = ids if head is None else np.concatenate([self._ids(head), ids])
                    out[i] = ids if out[i] is None else np.concatenate([out[i], ids])
            unit, size = [], 0

        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, dtype="<u4")
                continue
            if _RUN.search(text) or text[0].isspace() or " " not in text or any(s in text for s in self.specials):
                out[i] = self._ids(text)
                continue
            head, _, rest = text.partition(" ")
            while rest is not None:
                cut = rest.find(" ", UNIT)
                part, rest = (rest, None) if cut < 0 else (rest[:cut], rest[cut + 1 :])
                unit.append((i, head, part))
                head, size = None, size + len(part)
                if size >= UNIT:
                    flush()
        flush()
        return out
