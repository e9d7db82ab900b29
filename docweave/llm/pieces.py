"""Cutting texts into the pieces of a byte-level tokenizer, and remembering the pieces' ids.

All of it works on arrays over many texts at once.  A piece is known by a 64-bit hash of its
bytes, so remembering one takes a few dozen bytes and new pieces alone are encoded.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from .common import _BASE, _INV, U64, mix, powers

#: Fixed value: how byte-level tokenizers of this kind cut text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """For each code point 1 letter, 2 number, 3 white space, 0 other."""
    if not _kinds:
        every = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4").tobytes().decode("utf-32-le")
        out = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m.group()[0]), ord(m.group()[-1])
                out[a : b + 1] = kind
        _kinds.append(out)
    return _kinds[0]


def piece_starts(points: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where PATTERN's matches start; points are code points, docs the documents' first places."""
    n = len(points)
    kind = kinds()[points]
    head = np.zeros(n + 1, bool)
    head[docs] = True
    head[n] = True
    space = kind == 3
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last of the spaces before other text stands alone, or with that text if it is 0x20.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
    start |= last
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & (points[:-1] == 0x20)
    start &= ~joined
    quotes = np.flatnonzero((points == 0x27) & start)
    if len(quotes):
        at = lambda k: np.where(quotes + k < n, points[np.minimum(quotes + k, n - 1)], 0)
        one, two = at(1), at(2)
        inside = lambda k: ~head[np.minimum(quotes + k, n)]
        short = inside(1) & np.isin(one, [ord(c) for c in "stmd"])
        long = inside(1) & inside(2) & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        for which, size in ((short, 2), (long, 3)):
            q = quotes[which]
            start[q + 1] = False
            after = q + size
            after = after[after < n]
            start[after[~space[after]]] = True
    return np.flatnonzero(start)


def supported(spec: dict) -> None:
    """Raise ValueError for a vocabulary file that asks for more than byte-level pieces and plain added tokens."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    odd = [k for k in ("normalizer", "post_processor") if spec.get(k)]
    odd += ["pre_tokenizer"] * (cut.get("type") != "ByteLevel" or bool(cut.get("add_prefix_space")) or not cut.get("use_regex", True))
    odd += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [f"added token {t['content']!r}" for t in spec["added_tokens"] if any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))]
    if model.get("type") != "BPE" or odd:
        raise ValueError(f"not supported in this vocabulary file: {', '.join(odd) or model.get('type')}")


class PieceMemory:
    """ids of texts.  encode_new(bytes, offsets) -> (ids, bounds) is asked for new pieces."""

    def __init__(self, encode_new: Callable, added: dict[str, int], limit: int = 500_000):
        self.encode_new, self.added, self.limit = encode_new, added, limit
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._forget()

    def _forget(self) -> None:
        self.hash, self.first, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0

    def _store(self, ids: np.ndarray) -> int:
        at, need = self.n_ids, self.n_ids + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(max(need, len(self.ids) * 3 // 2) - at, np.uint32)])
        self.ids[at:need] = ids
        self.n_ids = need
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts data[offsets[d]:offsets[d + 1]]."""
        raw = data.tobytes()
        if self.cut is None or not any(t.encode() in raw for t in self.added):
            return self._encode(data, raw, offsets)
        out, bounds = [], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            n = 0
            for part in self.cut.split(raw[a:b].decode()):
                i, part = self.added.get(part), part.encode()
                got = np.array([i], np.uint32) if i is not None else self._encode(np.frombuffer(part, np.uint8), part, np.array([0, len(part)]))[0]
                out.append(got)
                n += len(got)
            bounds.append(bounds[-1] + n)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.array(bounds)

    def _encode(self, data, raw, offsets):
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        starts = lead[piece_starts(points, np.searchsorted(lead, offsets[:-1][offsets[:-1] < n]))]
        ends = np.append(starts[1:], n)
        total = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, n), out=total[1:])
        h = mix((total[ends] - total[starts]) * powers(_INV, n)[starts] + (ends - starts).astype(U64), 3)
        u, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > self.limit:
            self._forget()
        at = np.searchsorted(self.hash, u)
        new = np.ones(len(u), bool)
        some = at < len(self.hash)
        new[some] = self.hash[at[some]] != u[some]
        if new.any():
            a, b = starts[where[new]], ends[where[new]]
            sizes = b - a
            bounds = np.append(0, np.cumsum(sizes))
            flat = data[np.arange(bounds[-1]) + np.repeat(a - bounds[:-1], sizes)]
            ids, got = self.encode_new(flat, bounds)
            base = self._store(ids)
            spot = at[new]
            self.hash = np.insert(self.hash, spot, u[new])
            self.first = np.insert(self.first, spot, base + got[:-1])
            self.size = np.insert(self.size, spot, np.diff(got))
            at = np.searchsorted(self.hash, u)
        slot = at[inverse]
        counts = self.size[slot].astype(np.int64)
        done = np.append(0, np.cumsum(counts))
        ids = self.ids[np.arange(done[-1]) + np.repeat(self.first[slot] - done[:-1], counts)]
        return ids, done[np.searchsorted(starts, offsets)]
