"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a piece form a doubly linked list; a heap holds the ranks of
adjacent pairs with their places.  The lowest rank is popped, leftmost first, and
if the pair is still there, its two symbols become one.  The count is the number
of initial symbols less the merges; no ids are made.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings
inside a text count as one token each, as the library has it by default; repeated
rows each give a row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm._common import byte_symbols, slices, text_of

#: Segments and pieces that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 600_000
# White space as the library's expression engine has it; Python's own class also holds U+001C to U+001F.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: No piece crosses these: a run of other characters with a space before it, or white space left over.
_SEGMENT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")

_counters: dict[str, HeapCounter] = {}


class HeapCounter:
    """Counts of the tokens that a byte-level BPE file of the ``tokenizers`` library gives."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre, model = config["pre_tokenizer"], config["model"]
        if pre["type"] != "ByteLevel" or not pre.get("use_regex") or pre["add_prefix_space"] or config.get("normalizer") or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files can be counted")
        vocab = model["vocab"]
        self.byte_id = [vocab[c] for c in byte_symbols()]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {vocab[a] << 20 | vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.pieces = regex.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+").findall
        specials = sorted((t["content"] for t in config["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.specials = specials
        self.by_segment: dict[str, int] = {}
        self.by_piece: dict[str, int] = {}

    def merge(self, piece: bytes) -> int:
        """Symbols left when no pair of ``piece`` can be merged any more."""
        n = left = len(piece)
        if n < 2:
            return n
        sym = [self.byte_id[b] for b in piece]
        rank, made = self.rank.get, self.made
        heap = [r * n + i for i in range(n - 1) if (r := rank(sym[i] << 20 | sym[i + 1])) is not None]
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if j >= n or rank(sym[i] << 20 | sym[j]) != r:
                continue  # one of the two is gone or has grown
            sym[i], sym[j] = made[r], -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank(sym[i] << 20 | sym[k])) is not None:
                    heappush(heap, r * n + i)
            if (h := before[i]) >= 0 and (r := rank(sym[h] << 20 | sym[i])) is not None:
                heappush(heap, r * n + h)
        return left

    def _piece(self, piece: str) -> int:
        if (c := self.by_piece.get(piece)) is None:
            c = self.by_piece[piece] = self.merge(piece.encode("utf-8"))
        return c

    def _plain(self, text: str) -> int:
        segments = _SEGMENT.findall(text)
        known = self.by_segment
        try:
            return sum(map(known.__getitem__, segments))
        except KeyError:
            pass
        for s in set(segments).difference(known):
            known[s] = sum(map(self._piece, self.pieces(s)))
        return sum(map(known.__getitem__, segments))

    def count(self, text: str) -> int:
        if len(self.by_segment) > REMEMBERED or len(self.by_piece) > REMEMBERED:
            self.by_segment, self.by_piece = {}, {}
        if self.special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1


def _counter(path: str) -> HeapCounter:
    if path not in _counters:
        _counters[path] = HeapCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; no shuffle.

    ``tokenizer`` is a byte-level BPE file; its path must hold on every executor.
    """

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        c = _counter(tokenizer)
        out = [c.count(t.decode("utf-8")) for _, part in slices(texts) for t in part]
        return pa.array(np.array(out, np.int64))

    own = text_of(docs, id_col, text_col)
    return own.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), counted("text").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
