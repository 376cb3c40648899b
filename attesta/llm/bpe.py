"""Encoding texts with the byte-level BPE vocabulary of a public tokenizer.

Each pre-token's bytes are the leaves of a segment tree whose nodes hold the smallest merge rank below them. The
leftmost smallest pair is found by one walk down from the root; a merge changes the ranks of two live neighbours and removes one leaf,
each a walk up. A pre-token of n bytes costs O(n log n) however long it is. Pre-tokens recur, so their ids are kept in
a bounded cache per Python worker.

Defined cases
    NULL and empty texts have the ids [] (no tokens). The strings of special tokens are ordinary text. Texts are
    encoded whole. Text that is no valid Unicode (lone surrogates) is encoded as U+FFFD.
"""

from __future__ import annotations

import base64
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the public vocabulary files are, when the caller names no other place.
TOKENIZERS = "/opt/tokenizers"
_NONE = 1 << 60


class SegmentTreeBPE:
    """Byte-level BPE; ``ranks`` gives each token's bytes its id, a lower id merging first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 400_000):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.limit = cache

    def piece(self, data: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(data)
        if n == 1:
            return (ranks[data],)
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for i in range(n - 1):
            tree[size + i] = ranks.get(data[i : i + 2], _NONE)
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b

        def put(i: int, rank: int) -> None:
            i += size
            tree[i] = rank
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a <= b else b
                if tree[i] == low:
                    return
                tree[i] = low
                i >>= 1

        while tree[1] != _NONE:
            i, low = 1, tree[1]
            while i < size:
                i *= 2
                if tree[i] != low:
                    i += 1
            i -= size
            gone = end[i]
            end[i] = end[gone]
            if end[i] < n:
                before[end[i]] = i
            put(gone, _NONE)
            put(i, ranks.get(data[i : end[end[i]]], _NONE) if end[i] < n else _NONE)
            if before[i] >= 0:
                put(before[i], ranks.get(data[before[i] : end[i]], _NONE))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        cache = self.cache
        for p in self.find(text):
            known = cache.get(p)
            if known is None:
                known = self.piece(p.encode("utf-8", "replace") if p.isascii() else p.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode("utf-8"))
                if len(p) <= 64:
                    if len(cache) >= self.limit:
                        cache.clear()
                    cache[p] = known
            ids += known
        return ids


_LOADED: dict[tuple[str, str], SegmentTreeBPE] = {}


def load(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> SegmentTreeBPE:
    """The tokenizer of ``folder/name.tiktoken``; the split pattern is the one published with the files. One a process."""
    if (folder, name) not in _LOADED:
        import importlib.util

        spec = importlib.util.spec_from_file_location("attesta_public_tokenizers", Path(folder) / "__init__.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        _LOADED[folder, name] = SegmentTreeBPE(ranks, module.PATTERN)
    return _LOADED[folder, name]


def token_ids(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """The token ids of ``text`` without special tokens, as ``array<int>``; [] for NULL and for ''."""

    @F.pandas_udf("array<int>")
    def encode(s: pd.Series) -> pd.Series:
        t = load(name, folder)
        return s.map(t.encode)

    return encode(text)


def token_count(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """How many tokens ``text`` has; 0 for NULL and for ''."""

    @F.pandas_udf("bigint")
    def count(s: pd.Series) -> pd.Series:
        t = load(name, folder)
        return s.map(lambda x: len(t.encode(x))).astype("int64")

    return count(text)
