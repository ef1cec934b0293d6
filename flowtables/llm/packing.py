"""Packing documents into token sequences by best-fit decreasing.

A document longer than a window is cut into full windows first. What is left of the
documents is placed, longest first, into the open window it fits most tightly; a segment
tree over the remaining capacity finds that window. Tasks do so with their own documents;
what lies in windows that stay loose is dealt out again and placed in a second round.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.llm.byte_pairs import PRE_TOKEN, cut, locate
from flowtables.session import written

#: Longer pieces go to the library whose time grows least with the length of a piece.
LONG_PIECE = 1000
LONG_SPACE = re.compile(rf"\s{{{LONG_PIECE + 1}}}")


class Encoder:
    """Identifiers, as little-endian unsigned 32-bit numbers, equal to those of ``tokenizers``.

    Texts are encoded from the same vocabulary's rank file. Texts that hold an added token's
    string, and long pieces, are left to ``tokenizers`` itself.
    """

    def __init__(self, tokenizer: str, ranks: str):
        import tiktoken
        self.tokenizer, self.library = tokenizer, None
        with open(ranks, "rb") as file:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.pairs = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=table,
                                       special_tokens={})
        with open(tokenizer, "rb") as file:
            self.added = [token["content"] for token in json.load(file)["added_tokens"]]

    def by_library(self, text: str) -> bytes:
        if self.library is None:  # few texts need it, and it is large
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.tokenizer)
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def by_ranks(self, text: str) -> bytes:
        return np.array(self.pairs.encode_ordinary(text), dtype="<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        return self.by_library(piece) if len(piece) > LONG_PIECE else self.by_ranks(piece)

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self.by_library(text)
        if max(map(len, text.split(" "))) <= LONG_PIECE and not LONG_SPACE.search(text):
            return self.by_ranks(text)
        head, pieces = cut(text)
        return self.piece(head) + b"".join(self.piece(" " + piece) for piece in pieces)


class OpenWindows:
    """Open windows by remaining capacity; the tree counts the windows in each range."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self.change(capacity, 1)

    def change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` that an open window has."""
        node = length + self.leaves
        if not self.counts[node]:
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, capacity: int) -> int:
        self.change(capacity, -1)
        return self.windows[capacity].pop()


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """The (window number, offset) of each length, by best-fit decreasing; ties in input order."""
    tree, placed, opened = OpenWindows(window), [(0, 0)] * len(lengths), 0
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[at]
        capacity = tree.tightest(length)
        if capacity is None:
            number, capacity = opened, window
            opened += 1
        else:
            number = tree.take(capacity)
        placed[at] = (number, window - capacity)
        if capacity > length:
            tree.add(capacity - length, number)
    return placed


PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long")
#: The second round's sequences are numbered above those of any partition of the first.
SECOND_ROUND = 1 << 62
ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer: str, ranks: str) -> Encoder:
    if (tokenizer, ranks) not in ENCODERS:
        ENCODERS[tokenizer, ranks] = Encoder(tokenizer, ranks)
    return ENCODERS[tokenizer, ranks]


#: A piece before it is placed: doc_id, start, ids, doc_tokens.
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Places one group of pieces after the other and numbers the windows on."""

    def __init__(self, window: int, free: int, first: int):
        self.window, self.free, self.following = window, free, first
        self.rows: list[tuple] = []
        self.pieces: list[Piece] = []
        self.held = 0

    def add(self, piece: Piece) -> None:
        """Take a piece; one that fills a window is placed at once."""
        if len(piece[2]) == 4 * self.window:
            self.place(piece, self.following, 0, False)
            self.following += 1
        else:
            self.pieces.append(piece)
        self.held += len(piece[2])

    def place(self, piece: Piece, number: int, offset: int, loose: bool) -> None:
        key, start, ids, total = piece
        self.rows.append((key, start, len(ids) // 4, ids, total, number, offset, loose))

    def pack(self, last: bool) -> None:
        """Place the group by best fit. Windows with more than ``free`` places left are loose.

        In the ``last`` round their pieces are put into windows one after the other and cut
        where a window ends, so that one window of the group stays loose.
        """
        lengths = [len(piece[2]) // 4 for piece in self.pieces]
        places = best_fit(lengths, self.window)
        filled = [0] * (max((number for number, _ in places), default=-1) + 1)
        for (number, _), length in zip(places, lengths):
            filled[number] += length
        numbers, opened = {}, []
        for piece, (number, offset) in zip(self.pieces, places):
            loose = self.window - filled[number] > self.free
            if loose and last:
                opened.append((number, offset, piece))
            else:
                at = numbers.setdefault(number, self.following + len(numbers))
                self.place(piece, at, offset, loose)
        self.following += len(numbers)
        self.cut_up([piece for _, _, piece in sorted(opened, key=lambda entry: entry[:2])])
        self.pieces.clear()

    def cut_up(self, pieces: list[Piece]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                part = ids[at:at + 4 * (self.window - offset)]
                self.place((key, start + at // 4, part, total), self.following, offset, False)
                at, offset = at + len(part), offset + len(part) // 4
                if offset == self.window:
                    self.following, offset = self.following + 1, 0
        self.following += offset > 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The placed rows, with ``loose`` as last column."""
        if self.rows:
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.bool_()]
            names = [field.split()[0] for field in PIECES.split(", ")] + ["loose"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, type=kind) for column, kind in zip(zip(*self.rows), kinds)], names)
        self.rows.clear()
        self.held = 0


def pack(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 2048,
         end_id: int = 1, tokenizer: str = "byte_bpe_50k.json",
         ranks: str = "byte_bpe_50k.tiktoken", group_documents: int = 20_000,
         group_bytes: int = 32 << 20, slack: float = 1 / 64) -> DataFrame:
    """Pieces of the documents' token sequences, packed into windows of ``window`` tokens.

    One row per piece: doc_id, start (tokens of its document before it), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens (with the end token), sequence_id, offset
    (place in the sequence, without gaps from 0). Each token lies in exactly one piece.

    Each task packs its documents in groups of at most ``group_documents`` or ``group_bytes``
    of tokens, so memory is bounded by a group and the longest text. Windows of which more than
    ``slack`` stays empty are opened again: their pieces, from all tasks, are dealt evenly over
    as many tasks as they need and packed in groups once more. What best fit leaves loose there
    is joined by cutting pieces at the ends of windows. So at most ``slack`` of a window is
    padding, but for one window in each group of the second round, however small the
    partitions of the input are. Only the pieces of loose windows are shuffled.

    A null or empty text is the end token alone. Null and repeated ids are packed row by row.
    Equal lengths are placed in input order. An empty table gives no rows. Other columns are
    ignored. ``tokenizer`` and ``ranks`` must be the same vocabulary.
    """
    free = int(window * slack)

    def full(packer: Packer) -> bool:
        return len(packer.pieces) >= group_documents or packer.held >= group_bytes

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(locate(tokenizer), locate(ranks)).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(window, free, TaskContext.get().partitionId() << 33)
        try:
            for batch in batches:
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(value.as_py()) + end
                    for at in range(0, len(ids), 4 * window):
                        packer.add((key, at // 4, ids[at:at + 4 * window], len(ids) // 4))
                    if full(packer):
                        packer.pack(last=False)
                        yield from packer.flush()
            packer.pack(last=False)
            yield from packer.flush()
        finally:
            pa.default_memory_pool().release_unused()

    def repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, free, SECOND_ROUND + (TaskContext.get().partitionId() << 33))
        for batch in batches:
            for piece in zip(*(batch.column(name).to_pylist()
                               for name in ("doc_id", "start", "ids", "doc_tokens"))):
                packer.add(piece)
                if full(packer):
                    packer.pack(last=True)
                    yield from packer.flush()
        packer.pack(last=True)
        yield from packer.flush()

    first = written(
        documents.select(F.col(doc_id).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
        .mapInArrow(encoded, f"{PIECES}, loose boolean"), "pieces")
    loose = first.where("loose")
    count, tokens = loose.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tight = first.where("not loose").drop("loose")
    if not count:
        return tight
    groups = max(-(-count // group_documents), -(-4 * tokens // group_bytes))
    second = loose.repartition(groups).mapInArrow(repacked, f"{PIECES}, loose boolean")
    return tight.unionByName(second.drop("loose"))
