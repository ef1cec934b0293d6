import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowtables.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, n string, path string"


def brute_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    found = {}
    for c, turns in own.items():
        h, back = zlib.crc32(str(c).encode()) % 9, c % 5 if c >= 0 else -(-c % 5)
        found[c] = own.get(c - back, [])[:h] + turns[h:]
    return found


def brute(conversations):
    """Every node from the list of its members."""
    members = defaultdict(list)
    for conv, turns in conversations.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    kids = defaultdict(list)
    for prefix in members:
        if prefix:
            kids[prefix[:-1]].append(prefix)
    sums = {}
    for prefix in sorted(members, key=len, reverse=True):
        leaves = sum(sums[k][0] for k in kids[prefix]) or 1
        saved = sum(sums[k][1] for k in kids[prefix])
        if prefix:
            saved += (len(members[prefix]) - 1) * len(prefix[-1][1].encode())
        sums[prefix] = leaves, saved
    return sorted(
        (min(own), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(own), len(kids[prefix]),
         *sums[prefix], hashlib.sha256(",".join(
             map(str, sorted(c for c in own if len(conversations[c]) == len(prefix)))).encode()).hexdigest())
        for prefix, own in members.items())


def nodes(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1]))


def turns_of(rng, convs, texts, most):
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(0, most)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(texts), "", ""))
    rng.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark):
    rng = random.Random(3)
    rows = turns_of(rng, range(-20, 300), ["hi", "é", "", None], 6) + [
        (400, None, "user", "null turn", "", ""), (400, 0, None, None, "", ""), (None, 0, "user", "lost", "", ""),
        (401, 0, "user", "twice", "", ""), (401, 0, "user", "twice", "", ""), (402, 1, "b", "tie", "", ""),
        (402, 1, "a", "tie", "", ""), (403, 0, "user", "long " * 50_000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute(brute_rebuilt(rows))
    found = prefix_trie.trie(prefix_trie.rebuilt(df))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                             "saved_tokens", "ends_sha256"]
    assert nodes(found) == sorted(expected, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("block, least", [(1, 2), (1, 3), (40, 2), (300, 64)])
def test_many_blocks_give_the_same_nodes(spark, monkeypatch, block, least):
    """Small blocks: nearly every node is open in its first round."""
    monkeypatch.setattr(prefix_trie, "BLOCK_NODES", block)
    monkeypatch.setattr(prefix_trie, "LEAST_PATHS", least)
    rng = random.Random(block)
    conversations = {c: [("r", rng.choice("ab")) for _ in range(rng.randrange(0, 7))] for c in range(250)}
    conversations[999] = [("r", "a")] * 90
    conversations[998] = [("r", "a")] * 60 + [("r", "b")] * 3
    order = list(conversations.items())
    paths = []
    for conv, turns in order:
        digests = [hashlib.md5(repr(t).encode()).digest() for t in turns]
        paths.append((b"".join(digests), [len(t[1]) for t in turns], conv))
    merged = {}
    for turns, sizes, conv in sorted(paths, key=lambda p: (p[0], p[2])):
        merged.setdefault(turns, (sizes, []))[1].append(conv)
    todo = [prefix_trie.Path(t, s, [(len(t) // 16, len(c), min(c), 0, 0, 0, hashlib.sha256(
        ",".join(map(str, c)).encode()).hexdigest())]) for t, (s, c) in sorted(merged.items())]
    rows, first = [], True
    while True:
        whole = len(todo) <= least or sum(len(p.turns) // 16 + 1 for p in todo) <= block
        step = len(todo) if whole else max(least, 2 if first else 5)
        left = []
        for at in range(0, len(todo), step):
            found, edges = prefix_trie.peel(todo[at:at + step], whole, not first)
            rows += found
            left += edges
        if whole:
            break
        todo, first = left, False
    keys = {r[8]: r[0] for r in rows if r[8] is not None}
    found = sorted((*r[:2], keys[r[9]] if r[9] is not None else r[2], *r[3:8]) for r in rows)
    assert found == brute(conversations)


def test_several_rounds_on_spark(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_PATHS", 8)
    rng = random.Random(9)
    # Workers read the module's own block size, so the paths must outnumber it.
    conversations = {c: [("r", rng.choice(["a", "b", f"{rng.random()}"])) for _ in range(rng.randrange(0, 12))]
                     for c in range(12_000)}
    rows = [(c, [(hashlib.md5(repr(t).encode()).hexdigest(), len(t[1])) for t in turns])
            for c, turns in conversations.items()]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<digest: string, bytes: long>>")
    assert nodes(prefix_trie.trie(df)) == sorted(brute(conversations), key=lambda r: (r[0], r[1]))


def test_one_conversation_repeated_many_times(spark):
    df = spark.range(5000).select(F.col("id").alias("conv_id"), F.array(
        F.struct(F.md5(F.lit("x")).alias("digest"), F.lit(7).cast("long").alias("bytes"))).alias("turns"))
    top, node = nodes(prefix_trie.trie(df))
    ids = hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert top == (0, 0, None, 5000, 1, 1, 4999 * 7, prefix_trie.NO_ENDS)
    assert node == (0, 1, 0, 5000, 0, 1, 4999 * 7, ids)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(prefix_trie.rebuilt(df)).count() == 0
