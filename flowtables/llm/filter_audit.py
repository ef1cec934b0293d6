"""How filters interact: what each removes in every order, from decision diagrams.

Documents become failure masks, masks become counts per part, and a part's counts become a
zero-suppressed decision diagram with counts at its ends. Swapping two adjacent levels
changes the order of two filters; a walk over swaps visits every order. The path on which
all filters pass gives what is left after each step of an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtables.llm.shingles import words

#: What a mask is weighed by: documents, those labelled good, those labelled toxic.
WEIGHTS = ("n", "good", "toxic")
NONE = (0,) * len(WEIGHTS)
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "ABCDE"
#: The filter that asks the whole table whether a smaller id holds the same text.
REPEATED = 1 << LETTERS.index("E")


class Diagram:
    """A part's failure masks with their weights, for a changing order of the filters.

    A node is (letter, passing branch, failing branch). Equal nodes are one node, and a node
    whose failing branch is empty is left out, so a filter that nothing fails costs nothing.
    """

    EMPTY = 0

    def __init__(self, order: str, masks: dict[frozenset[str], tuple[int, ...]]):
        self.order = list(order)
        self.nodes: list[tuple | None] = [None]
        self.weights = [NONE]
        self.numbers: dict[tuple, int] = {}
        self.root = self._built(0, masks)

    def _numbered(self, content: tuple, weight: tuple[int, ...]) -> int:
        if content not in self.numbers:
            self.numbers[content] = len(self.nodes)
            self.nodes.append(content)
            self.weights.append(weight)
        return self.numbers[content]

    def node(self, letter: str, passing: int, failing: int) -> int:
        if failing == self.EMPTY:
            return passing
        weight = tuple(a + b for a, b in zip(self.weights[passing], self.weights[failing]))
        return self._numbered((letter, passing, failing), weight)

    def _built(self, level: int, masks: dict[frozenset[str], tuple[int, ...]]) -> int:
        if not masks:
            return self.EMPTY
        if level == len(self.order):
            (weight,) = masks.values()
            return self._numbered((None, weight), weight) if any(weight) else self.EMPTY
        letter = self.order[level]
        return self.node(
            letter,
            self._built(level + 1, {m: w for m, w in masks.items() if letter not in m}),
            self._built(level + 1, {m: w for m, w in masks.items() if letter in m}))

    def branches(self, node: int, letter: str) -> tuple[int, int]:
        """What passes and what fails ``letter`` at a node of its level or below."""
        content = self.nodes[node]
        return content[1:] if content and content[0] == letter else (node, self.EMPTY)

    def swap(self, level: int) -> None:
        """Exchange the filters at ``level`` and the one after it."""
        above, upper, lower = set(self.order[:level]), self.order[level], self.order[level + 1]
        done: dict[int, int] = {}

        def swapped(node: int) -> int:
            content = self.nodes[node]
            if content is None or content[0] not in above and content[0] != upper:
                return node
            if node not in done:
                letter, passing, failing = content
                if letter in above:
                    done[node] = self.node(letter, swapped(passing), swapped(failing))
                else:
                    neither, only_lower = self.branches(passing, lower)
                    only_upper, both = self.branches(failing, lower)
                    done[node] = self.node(lower, self.node(upper, neither, only_upper),
                                           self.node(upper, only_lower, both))
            return done[node]

        self.root = swapped(self.root)
        self.order[level], self.order[level + 1] = lower, upper

    def steps(self) -> list[tuple[int, ...]]:
        """The weights that are left before the first filter and after each, if all pass."""
        node, found = self.root, [self.weights[self.root]]
        for letter in self.order:
            node, _ = self.branches(node, letter)
            found.append(self.weights[node])
        return found


def swaps(count: int) -> Iterator[int]:
    """The levels to swap, one after the other, so that every order occurs exactly once.

    The last filter walks through the others from end to end; between two walks the others
    move on by one swap of their own.
    """
    if count < 2:
        return
    inner, at_end = swaps(count - 1), True
    while True:
        yield from range(count - 2, -1, -1) if at_end else range(count - 1)
        level = next(inner, None)
        if level is None:
            return
        yield level + 1 if at_end else level  # the walker now stands before or after the others
        at_end = not at_end


STEP_FIELDS = ("part string, filter_order string, step int, kept long, removed long, "
               "redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def part_steps(part: str, letters: str, masks: dict[frozenset[str], tuple[int, ...]]) -> list[tuple]:
    """All steps of all orders of one part, as rows of ``STEP_FIELDS``."""
    diagram, orders = Diagram(letters, masks), {}
    orders[letters] = diagram.steps()
    for level in swaps(len(letters)):
        diagram.swap(level)
        orders["".join(diagram.order)] = diagram.steps()
    gone = {order: [tuple(a - b for a, b in zip(before, after))
                    for before, after in zip(left, left[1:])] for order, left in orders.items()}
    # A filter in the first place removes all that fail it, in the last place only its own.
    fails = {order[0]: lost[0][0] for order, lost in gone.items()}
    alone = {order[-1]: lost[-1][0] for order, lost in gone.items()}
    total = dict.fromkeys(letters, 0)
    for order, lost in gone.items():
        for letter, weight in zip(order, lost):
            total[letter] += weight[0]
    return [(part, order, step, orders[order][step][0], lost[0], fails[letter] - lost[0],
             alone[letter], lost[1], lost[2], total[letter])
            for order in sorted(orders)
            for step, (letter, lost) in enumerate(zip(order, gone[order]), 1)]


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every step of every order of the filters, per part.

    ``counts`` has part, mask (bit ``i`` is set where filter ``letters[i]`` fails), n, good and
    toxic; rows of equal part and mask add up. At most 2 to the number of filters masks of a
    part meet in a task, whatever the part's share of the documents. One row per part, order
    and step: kept, removed, redundant (fail this filter but were removed before),
    unique_fails (fail this filter alone), good_lost, toxic_lost (labels among the removed) and
    shapley (removed by this filter, summed over all orders). No rows give no parts.
    """
    def steps(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        masks = {frozenset(letter for at, letter in enumerate(letters) if row.mask >> at & 1):
                 tuple(int(getattr(row, name)) for name in WEIGHTS)
                 for row in rows.itertuples()}
        return pd.DataFrame(part_steps(key[0], letters, masks),
                            columns=[field.split()[0] for field in STEP_FIELDS.split(", ")])

    summed = counts.groupBy("part", "mask").agg(*[F.sum(name).alias(name) for name in WEIGHTS])
    return summed.groupBy("part").applyInPandas(steps, STEP_FIELDS)


def text_failures(text: Column) -> Column:
    """The mask of the four filters that look at one text only.

    A: under 100 words; B: under 80 percent of the words distinct; C: over 10 percent of the
    code points are capitals A to Z; D: one of ``#$%&*|`` occurs.
    """
    found = words(text)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = [F.size(found) < 100, 100 * F.size(F.array_distinct(found)) < 80 * F.size(found),
             100 * capitals.cast("long") > 10 * F.length(text), text.rlike("[#$%&*|]")]
    masks = [F.when(condition, 1 << at).otherwise(0) for at, condition in enumerate(fails)]
    return masks[0] + masks[1] + masks[2] + masks[3]


def failure_counts(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
                   text: str = "text", part: str = "lang") -> DataFrame:
    """The documents' failure masks counted: part, mask, n, good, toxic.

    The fifth filter, E, fails a document whose text is also that of a smaller id anywhere in
    the table. Texts are compared by their SHA-256. Rows of equal text, part and id are counted
    before they meet, so a text that a third of the table holds is a few rows in the task that
    finds its smallest id.

    A null text is empty, a null part the empty string. A null id is neither smaller nor larger
    than any id and has no labels; rows of one repeated id do not repeat each other. An id with
    several labels is good or toxic if one of them says so. Extra columns are ignored. An empty
    table gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(doc_id).alias("id"), F.sha2(whole, 256).alias("digest"),
                            F.coalesce(F.col(part), F.lit("")).alias("part"),
                            text_failures(whole).alias("mask"))
    marked = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"),
        F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    each = (rows.join(marked, "id", "left").groupBy("id", "digest", "part", "mask")
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(name, F.lit(0))).alias(name)
                                                 for name in WEIGHTS[1:]]))
    lowest = F.when(F.col("id").isNotNull(), F.struct("id", *WEIGHTS))
    without_id = [F.sum(F.when(F.col("id").isNull(), F.col(name)).otherwise(0)).alias(f"{name}_null")
                  for name in WEIGHTS]
    texts = each.groupBy("digest", "part", "mask").agg(
        F.min(lowest).alias("lowest"), *[F.sum(name).alias(name) for name in WEIGHTS], *without_id)
    # By now a text has one row per part.
    same_text = Window.partitionBy("digest")
    first = F.col("lowest.id") == F.min("lowest.id").over(same_text)
    passing = [(F.when(first, F.col(f"lowest.{name}")).otherwise(0) + F.col(f"{name}_null"))
               .alias(name) for name in WEIGHTS]
    split = texts.select("part", "mask", F.struct(*passing).alias("passing"), *WEIGHTS)
    failing = F.struct(*[(F.col(name) - F.col(f"passing.{name}")).alias(name) for name in WEIGHTS])
    sides = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("passing").alias("count")),
        F.struct((F.col("mask") + REPEATED).alias("mask"), failing.alias("count"))))
    return (split.select("part", sides.alias("side")).where("side.count.n > 0")
            .groupBy("part", F.col("side.mask").alias("mask"))
            .agg(*[F.sum(f"side.count.{name}").alias(name) for name in WEIGHTS]))


def audit_sql() -> str:
    """The audit in DuckDB's SQL."""
    bits = " ".join(f"WHEN '{letter}' THEN {1 << at}" for at, letter in enumerate(LETTERS))
    letters = ", ".join(f"('{letter}')" for letter in LETTERS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             min(doc_id) OVER (PARTITION BY t) AS lowest FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
      FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
         + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(lowest < doc_id, false)::INT AS mask,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
f(c) AS (VALUES {letters}),
orders AS (
  SELECT a.c || b.c || p.c || q.c || r.c AS filter_order FROM f a, f b, f p, f q, f r
  WHERE len(list_distinct([a.c, b.c, p.c, q.c, r.c])) = 5),
bits AS (SELECT filter_order, s AS step, CASE substr(filter_order, s, 1) {bits} END AS own,
                substr(filter_order, s, 1) AS letter FROM orders, range(1, 6) g(s)),
places AS (
  SELECT *, (sum(own) OVER (PARTITION BY filter_order ORDER BY step) - own)::INT AS before FROM bits),
steps AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, places GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM steps
"""
