"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND.

The test items are the indexed documents, every training passage is a query. A passage
retrieves all items whose BM25 score is at least a share of the item's score for itself;
the document then has to hold the word shingles of the item's question and of its answer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables.llm.shingles import NOT_ALPHANUMERIC, hashes, lists, shingle_set, windows, words
from flowtables.session import written

K1, B = 1.2, 0.75
#: An answer of fewer words than so many shingles has shorter shingles, one word at least: one
#: changed word shall not make a short answer unknown.
ANSWER_SHINGLES = 3
#: Words handled at once in a task.
CHUNK = 1 << 20


@dataclass
class Postings:
    items: np.ndarray       # ascending
    weights: np.ndarray     # share of the item's score for itself
    highest: float
    blocks: np.ndarray      # highest weight per block of items


@dataclass
class Statistics:
    """What BM25 knows of all items: their number of parts, mean length, and the number of parts
    with each term, for the terms that are asked for."""

    parts: int
    mean: float
    terms: np.ndarray       # sorted
    frequency: np.ndarray


class Index:
    """Test items, cut into parts that a passage holds as a whole.

    The parts of question and answer together come first, those of the ``questions`` alone after
    them, so that a passage without the answer retrieves the item too. ``statistics`` are those
    of all items' parts where the index holds a shard of them.
    """

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], threshold: float,
                 part_words: int, block: int, shingle: int, statistics: Statistics | None = None,
                 questions: bool = False):
        self.threshold, self.part_words, self.block = threshold, part_words, block
        self.ids = [item for item, _, _ in items]
        self.parts_of = [[(size, shingle_set(part, size)) for part, size in (
            (question, min(shingle, len(question))),
            (answer, min(shingle, max(1, len(answer) // ANSWER_SHINGLES)))) if len(part)]
            for _, question, answer in items]
        texts, self.item_of = [], []
        for at, (_, question, answer) in enumerate(items):
            whole = np.concatenate([question, answer])
            for start in range(0, len(whole), part_words):
                texts.append(whole[start:start + part_words])
                self.item_of.append(at)
        self.terms = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint64)
        self.statistics = statistics or self.counted(texts)
        for at, (_, question, answer) in enumerate(items if questions else []):
            for start in range(0, len(question) if len(answer) else 0, part_words):
                texts.append(question[start:start + part_words])
                self.item_of.append(at)
        self.postings = self.weigh(texts)
        del self.statistics
        self.split_terms(len(texts))

    def counted(self, texts: list[np.ndarray]) -> Statistics:
        frequency = np.zeros(len(self.terms))
        for text in texts:
            frequency[np.searchsorted(self.terms, np.unique(text))] += 1
        return Statistics(len(texts), sum(map(len, texts)) / max(len(texts), 1), self.terms, frequency)

    def weigh(self, texts: list[np.ndarray]) -> list[Postings]:
        known, mean = self.statistics, self.statistics.mean
        counted = [np.unique(text, return_counts=True) for text in texts]
        frequency = known.frequency[np.searchsorted(known.terms, self.terms)]
        idf = np.log(1 + (known.parts - frequency + 0.5) / (frequency + 0.5))
        found: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for at, (terms, counts) in enumerate(counted):
            places = np.searchsorted(self.terms, terms)
            norm = K1 * (1 - B + B * len(texts[at]) / mean)
            score = idf[places] * counts * (K1 + 1) / (counts + norm)
            for place, weight in zip(places, score / score.sum()):
                found[place].append((at, weight))
        postings = []
        for pairs in found:
            items = np.array([item for item, _ in pairs])
            weights = np.array([weight for _, weight in pairs])
            blocks = np.zeros(len(texts) // self.block + 1)
            np.maximum.at(blocks, items // self.block, weights)
            postings.append(Postings(items, weights, weights.max(), blocks))
        return postings

    def split_terms(self, parts: int) -> None:
        """Frequent terms that together give no part half the threshold are not essential: alone
        they retrieve nothing, so only essential terms start a search."""
        self.others = np.zeros(parts // self.block + 1)
        given, essential = np.zeros(parts), np.ones(len(self.terms), dtype=bool)
        for at in sorted(range(len(self.terms)), key=lambda t: -len(self.postings[t].items)):
            own = self.postings[at]
            more = given[own.items] + own.weights
            if more.max() <= self.threshold / 2:
                given[own.items] = more
                essential[at] = False
        np.maximum.at(self.others, np.arange(parts) // self.block, given)
        self.essential = essential
        # Block maxima of the essential terms, one after another.
        kept = [own.blocks if essential[at] else np.zeros(0) for at, own in enumerate(self.postings)]
        nonzero = [np.flatnonzero(blocks) for blocks in kept]
        self.block_of = np.concatenate(nonzero + [np.zeros(0, int)]).astype(np.int64)
        self.block_max = np.concatenate([b[n] for b, n in zip(kept, nonzero)] + [np.zeros(0)])
        self.block_start = np.cumsum([0] + [len(n) for n in nonzero])

    def passages(self, length: int) -> list[tuple[int, int]]:
        """Windows of twice a part, a part apart: each run of a part's length lies in one."""
        size = self.part_words
        starts = range(0, max(length - size, 1), size)
        return [(start, min(start + 2 * size, length)) for start in starts]

    def promising(self, places: np.ndarray, owner: np.ndarray, count: int) -> dict[int, list[int]]:
        """The blocks of items that may reach the threshold, in order, per passage that has any.

        ``places`` are the essential terms met and ``owner`` their passages, each pair once.
        """
        lengths = self.block_start[places + 1] - self.block_start[places]
        ends = np.cumsum(lengths)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
        at = np.repeat(self.block_start[places], lengths) + within
        width = len(self.others)
        keys = np.repeat(owner, lengths) * width + self.block_of[at]
        if count * width <= 4 * CHUNK:
            bounds = np.bincount(keys, self.block_max[at], count * width).reshape(count, width)
            met, block = np.nonzero(bounds)
            bounds = bounds[met, block]
        else:
            distinct, inverse = np.unique(keys, return_inverse=True)
            bounds = np.bincount(inverse, self.block_max[at], len(distinct))
            met, block = distinct // width, distinct % width
        good = bounds + self.others[block] >= self.threshold - 1e-9
        found: dict[int, list[int]] = {}
        for passage, own in zip(met[good].tolist(), block[good].tolist()):
            found.setdefault(passage, []).append(own)
        return found

    def retrieve(self, terms: np.ndarray, blocks: list[int]) -> list[int]:
        """All parts in ``blocks`` (ascending) that score at least the threshold for distinct
        ``terms``, by block-max WAND: lists skip blocks that are not given or fall short."""
        lists_ = [self.postings[term] for term in terms]
        cursors = [0] * len(lists_)
        live = list(range(len(lists_)))
        found, limit, given = [], self.threshold - 1e-9, 0

        def item(which: int) -> int:
            return int(lists_[which].items[cursors[which]])

        def advance(which: int, target: int) -> None:
            cursors[which] = int(np.searchsorted(lists_[which].items, target))

        while live:
            live.sort(key=item)
            bound, pivot = 0.0, None
            for order, which in enumerate(live):
                bound += lists_[which].highest
                if bound >= limit:
                    pivot = order
                    break
            if pivot is None:
                break
            target = item(live[pivot])
            while pivot + 1 < len(live) and item(live[pivot + 1]) == target:
                pivot += 1
            ahead = live[:pivot + 1]
            block = target // self.block
            while given < len(blocks) and blocks[given] < block:
                given += 1
            if given == len(blocks):
                break
            if blocks[given] > block:
                for which in ahead:
                    advance(which, blocks[given] * self.block)
                live = [which for which in live if cursors[which] < len(lists_[which].items)]
                continue
            if sum(lists_[which].blocks[block] for which in ahead) >= limit:
                if item(ahead[0]) == target:
                    score = sum(lists_[which].weights[cursors[which]] for which in ahead)
                    if score >= limit:
                        found.append(target)
                    beyond = target + 1
                else:
                    beyond = target
            else:
                # No item of this block that only these lists hold can reach the threshold.
                beyond = (block + 1) * self.block
                if pivot + 1 < len(live):
                    beyond = min(beyond, item(live[pivot + 1]))
                beyond = max(beyond, target + 1)
            for which in ahead:
                if item(which) < beyond:
                    advance(which, beyond)
            live = [which for which in live if cursors[which] < len(lists_[which].items)]
        return found

    def candidates(self, values: np.ndarray, starts: np.ndarray) -> dict[int, set[int]]:
        """Items retrieved per row of a batch of texts."""
        found: dict[int, set[int]] = {}
        if not len(self.terms):
            return found
        places = np.minimum(np.searchsorted(self.terms, values), len(self.terms) - 1)
        known = self.terms[places] == values
        spans = [(row, int(starts[row]) + a, int(starts[row]) + b) for row in range(len(starts) - 1)
                 for a, b in self.passages(int(starts[row + 1] - starts[row]))]
        at = 0
        while at < len(spans):
            end, total = at, 0
            while end < len(spans) and (end == at or total < CHUNK):
                total += spans[end][2] - spans[end][1]
                end += 1
            begins = np.array([s[1] for s in spans[at:end]])
            ends = np.array([s[2] for s in spans[at:end]])
            lengths = ends - begins
            index = np.repeat(begins - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            index += np.arange(len(index))
            owner = np.repeat(np.arange(end - at), lengths)
            met = known[index] & self.essential[places[index]]
            pairs = np.unique(owner[met] * len(self.terms) + places[index[met]])
            good = self.promising(pairs % len(self.terms), pairs // len(self.terms), end - at)
            for number, blocks in good.items():
                row, a, b = spans[at + number]
                own = np.unique(places[a:b][known[a:b]])
                for part in self.retrieve(own, blocks):
                    found.setdefault(row, set()).add(self.item_of[part])
            at = end
        return found

    def verified(self, item: int, values: np.ndarray, share: float) -> bool:
        """Whether a text has this share of the shingles of the item's question, and of its answer."""
        return all(np.isin(part, windows(values, size)).mean() >= share - 1e-9
                   for size, part in self.parts_of[item])



def item_parts(benchmark: DataFrame, item_id: str, text: str, question: str | None,
               answer: str | None) -> DataFrame:
    """(item_id, question, answer) as word hashes. Without own columns the last sentence of the
    text is the answer; a text of one sentence is all question."""
    def of(value: Column) -> Column:
        return hashes(words(F.lower(value), NOT_ALPHANUMERIC))

    if question is None:
        sentences = F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"(?<=[.!?])\s+")
        last = F.greatest(F.size(sentences) - 1, F.lit(1))
        asked = F.array_join(F.slice(sentences, F.lit(1), last), " ")
        answered = F.array_join(F.slice(sentences, last + 1, F.lit(1)), " ")
    else:
        asked, answered = F.col(question), F.col(answer) if answer else F.lit("")
    return benchmark.select(F.col(item_id).cast("long").alias("item_id"),
                            of(asked).alias("question"), of(answered).alias("answer"))


def statistics_of(parts: DataFrame, part_words: int) -> tuple[int, float, DataFrame]:
    """Number and mean length of all parts, and (term, n): how many parts hold a term."""
    whole = F.concat("question", "answer")
    pieces = written(parts.select(F.explode(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / part_words)),
        lambda at: F.slice(whole, (at * part_words + 1).cast("int"), F.lit(part_words)))).alias("piece")), "pieces")
    count, mean = pieces.agg(F.count(F.lit(1)), F.avg(F.size("piece"))).first()
    frequency = pieces.select(F.explode(F.array_distinct("piece")).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"))
    return count, mean, written(frequency, "frequency")


def contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text",
                 items: str = "items", item_id: str = "item_id", item_text: str = "text",
                 question: str | None = None, answer: str | None = None, threshold: float = 0.5,
                 share: float = 0.5, shingle: int = 5, part_words: int = 64, block: int = 4,
                 shard_items: int = 20_000, questions: bool = False) -> DataFrame:
    """``documents`` with the sorted ids of the test items whose question and answer they hold.

    Words are lower-case runs of letters and digits. Passages are windows of ``2 * part_words``
    words over the whole text; longer items are indexed in parts, each of which retrieves the
    item. ``threshold`` is the share of a part's BM25 score for itself; ``share`` the part of
    the distinct ``shingle``-word shingles of the question that the whole document must hold
    (fewer words count as one shingle), and likewise of the answer, whose shingles are a third
    of its length if that is less. Items without words match nothing;
    null and empty texts hold none; repeated items and rows are judged one by one; items
    without an id are left out; a column named as the result is replaced.

    Documents are neither shuffled nor joined. The index goes to the tasks in shards of at
    most ``shard_items`` items, which bounds what is collected and broadcast at once. Scores use
    counts over all items, made by Spark, so what is found does not depend on the shards. With
    ``questions`` the question alone retrieves an item too, so an edited question is found far from
    its answer; short questions make nearly five times the work.
    """
    parts = item_parts(benchmark, item_id, item_text, question, answer).where(
        "item_id is not null and size(question) + size(answer) > 0")
    parts = written(parts, "items")
    shards = -(-parts.count() // shard_items)
    count, mean, frequency = statistics_of(parts, part_words)
    values = hashes(words(F.lower(F.col(text)), NOT_ALPHANUMERIC))
    result = documents.withColumn("_words", values)
    found = []
    for shard in range(shards):
        own = parts.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard)
        rows = [(row.item_id, np.array(row.question, np.int64).view(np.uint64),
                 np.array(row.answer, np.int64).view(np.uint64)) for row in own.collect()]
        rows.sort(key=lambda r: (len(r[1]) + len(r[2]), r[0]))
        terms = own.select(F.explode(F.concat("question", "answer")).alias("term")).distinct()
        known = np.array([tuple(row) for row in terms.join(frequency, "term").collect()],
                         np.int64).reshape(-1, 2)  # no more than the shard's words
        order = np.argsort(known[:, 0].view(np.uint64))
        statistics = Statistics(count, mean, known[order, 0].view(np.uint64), known[order, 1].astype(float))
        index = Index(rows, threshold, part_words, block, shingle, statistics, questions)
        shared = documents.sparkSession.sparkContext.broadcast(index)
        found.append(F.col(f"_items{shard}"))
        result = result.withColumn(f"_items{shard}", searching(shared, share)(F.col("_words")))
    merged = F.array_distinct(F.array_sort(F.concat(*found))) if found else (
        F.array().cast("array<long>"))
    return (result.withColumn("_found", merged).drop("_words", *[f"_items{s}" for s in range(shards)])
            .drop(items).withColumnRenamed("_found", items))


def searching(shared, share: float):
    @F.arrow_udf("array<long>")
    def search(batch: pa.Array) -> pa.Array:
        index = shared.value
        values, starts = lists(batch)
        found = index.candidates(values, starts)
        rows = []
        for row in range(len(batch)):
            own = values[starts[row]:starts[row + 1]]
            rows.append(sorted(index.ids[item] for item in found.get(row, ())
                               if index.verified(item, own, share)))
        return pa.array(rows, pa.list_(pa.int64()))

    return search
