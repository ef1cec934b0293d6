"""Token counts by byte-pair merging with a heap over a linked list of symbols.

Only the number of merges is needed: tokens = first symbols - merges. No identifier is
looked up or emitted.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.llm.byte_pairs import PRE_TOKEN, byte_alphabet, cut, locate

#: Pieces kept per worker; later ones are counted anew each time they occur.
CACHE_SIZE = 1_000_000
#: Longer pieces are rare and never cached.
CACHED_LENGTH = 64


class PairMerger:
    """Counts tokens as the ``tokenizers`` library does for a byte-level BPE file.

    Strings of added tokens inside a text count as one token each, which is the
    library's default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, first = spec["model"], spec.get("pre_tokenizer") or {}
        if (model["type"] != "BPE" or spec.get("normalizer") or first.get("type") != "ByteLevel"
                or first.get("add_prefix_space") or model.get("ignore_merges")):
            raise ValueError(f"{path}: only plain byte-level BPE files can be counted")
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pre_token = regex.compile(PRE_TOKEN)
        self.alphabet = byte_alphabet()
        self.cache: dict[str, int] = {}

    def pre_token_count(self, pre_token: str) -> int:
        symbols = [self.alphabet[byte] for byte in pre_token.encode("utf-8", "replace")]
        count = len(symbols)
        if count < 2:
            return count
        ranks, end = self.ranks, count
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        heap = []
        for at in range(count - 1):
            rank = ranks.get((symbols[at], symbols[at + 1]))
            if rank is not None:
                heap.append((rank, at, symbols[at], symbols[at + 1]))
        heapq.heapify(heap)
        while heap:
            _, at, left, right = heapq.heappop(heap)
            other = after[at]
            # A merge leaves its right symbol empty and changes its left one: such entries are stale.
            if symbols[at] != left or other == end or symbols[other] != right:
                continue
            symbols[at], symbols[other] = left + right, ""
            count -= 1
            beyond = after[at] = after[other]
            if beyond < end:
                before[beyond] = at
                rank = ranks.get((symbols[at], symbols[beyond]))
                if rank is not None:
                    heapq.heappush(heap, (rank, at, symbols[at], symbols[beyond]))
            previous = before[at]
            if previous >= 0:
                rank = ranks.get((symbols[previous], symbols[at]))
                if rank is not None:
                    heapq.heappush(heap, (rank, previous, symbols[previous], symbols[at]))
        return count

    def piece_count(self, piece: str) -> int:
        return sum(map(self.pre_token_count, self.pre_token.findall(piece)))

    def plain_count(self, text: str) -> int:
        head, pieces = cut(text)
        found = [*map(self.cache.get, pieces)]
        if None in found:
            for at, known in enumerate(found):
                if known is None:
                    found[at] = self.spaced_count(pieces[at])
        return self.piece_count(head) + sum(found)

    def spaced_count(self, piece: str) -> int:
        count = self.cache.get(piece)
        if count is None:
            count = self.piece_count(" " + piece)
            if len(piece) <= CACHED_LENGTH and len(self.cache) < CACHE_SIZE:
                self.cache[piece] = count
        return count

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self.plain_count(text)
        return (sum(map(self.plain_count, self.added.split(text)))
                + sum(1 for _ in self.added.finditer(text)))


MERGERS: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    """One merger, and so one cache, per worker process and file."""
    if path not in MERGERS:
        MERGERS[path] = PairMerger(path)
    return MERGERS[path]


def token_counts(documents: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k.json",
                 limit: int = 512, n_bytes: str = "n_bytes", n_tokens: str = "n_tokens",
                 over_limit: str = "over_limit") -> DataFrame:
    """``documents`` with the UTF-8 bytes and tokens of the whole text, and whether they exceed
    ``limit`` tokens. ``tokenizer`` is a path all executors can read or a public file's name.

    A null or empty text has 0 bytes and 0 tokens. Rows are independent: repeated rows, null
    ids and other columns pass through; a column named as a result is replaced. A text of
    any length is counted whole, in memory that grows with that one text.
    """
    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = merger(locate(tokenizer)).count
        for texts in batches:
            yield pd.Series([count(value) for value in texts], dtype="int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    tokens = counted(whole)
    return (documents.withColumns({n_bytes: F.octet_length(whole).cast("long"), n_tokens: tokens})
            .withColumn(over_limit, F.col(n_tokens) > limit))
