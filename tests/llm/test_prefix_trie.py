"""The prefix trie against a plain one, on odd rows, hot conversations and small shards."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import prefix_trie as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)} {role}{text}".encode()).hexdigest()
            convs.setdefault(conv_id, []).append(((turn is not None, turn or 0), key, (role, text)))
    convs = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    nodes, ends = {}, {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(convs.get(c - c % 20, [])[:h] + convs[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = leaves.get(path, 0) if path in kids else 1
        saved[path] = saved.get(path, 0) + ((len(nodes[path]) - 1) * len(WORD.findall(path[-1][1])) if path else 0)
        if path:
            up = path[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up], saved[up] = leaves.get(up, 0) + leaves[path], saved.get(up, 0) + saved[path]
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in nodes.items())


def found(df):
    got = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted(tuple(r) for r in got)


def conversations():
    rng, rows = random.Random(5), []
    for c in [*range(0, 170), 1000, 2007]:
        if c in (40, 41):
            continue  # a block without its first conversation, and one missing
        for t in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["Hi there you", "ok", "tell me more\nof it"])))
    rows += [(300 + c, t, "user", f"common {t}") for c in range(60) for t in range(4)]  # copies
    rows += [(500, t, "user", f"long {t % 3}") for t in range(90)] + [(501, t, "user", f"long {t % 3}") for t in range(70)]
    rows += [(7, None, "user", None), (7, None, None, "first"), (8, 3, None, None), (8, 3, "", ""), (8, 3, "a", "b"), (8, 3, "a", "b"), (8, 3, "a", "c")]
    rows += [(9, 1, "a", "1"), (9, 1, "a1", ""), (None, 1, "user", "nobody"), (None, None, None, None), (10, 2, "user", "x" * 20_000 + " y")]
    return rows


@pytest.mark.parametrize("sizes,kind", [({}, "long"), ({"BAND": 4, "RUN": 3, "SHARD_TURNS": 30, "CHUNK_BYTES": 5, "ORDERED_TURNS": 1}, "smallint"), ({"BAND": 2, "RUN": 1, "SHARD_TURNS": 1}, "int")])
def test_nodes_against_a_plain_trie(spark, monkeypatch, sizes, kind):
    for k, v in sizes.items():
        monkeypatch.setattr(T, k, v)
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id int, turn int, role string, text string, k string, pos int, depth int").repartition(6)
    df = df.withColumn("conv_id", F.col("conv_id").cast(kind))
    assert found(T.trie(*T.rebuilt(T.ordered(df)))) == plain(rows)


def test_turnless_and_empty(spark):
    # the only conversation of its block has no more turns than the head that it takes from elsewhere
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = found(T.trie(*T.rebuilt(T.ordered(df))))
    assert got == plain(rows) and len(got) == 1 and got[0][:7] == (c, 0, None, 1, 0, 1, 0)
    assert T.trie(*T.rebuilt(T.ordered(df.where("false")))).count() == 0


def test_double_array_holds_exactly_its_sequences():
    rng = np.random.default_rng(6)
    lengths = rng.integers(0, 7, 400)
    codes = np.minimum(rng.geometric(0.05, int(lengths.sum())), 300).astype(np.int64)
    trie = T.DoubleArray(codes, lengths)
    first, paths = np.cumsum(lengths) - lengths, {()}
    for a, n in zip(first, lengths, strict=True):
        paths |= {tuple(codes[a : a + d].tolist()) for d in range(n + 1)}
    slots = {(): 0}
    for p in sorted(paths, key=len):
        if p:
            slots[p] = int(trie.step(np.array([slots[p[:-1]]]), np.array([p[-1]]))[0])
        for c in [*rng.integers(0, 300, 4).tolist(), *[q[-1] for q in paths if len(p) < 2 and q[:-1] == p and q]]:
            to = int(trie.step(np.array([slots[p]]), np.array([c]))[0])
            assert (to >= 0) == ((*p, c) in paths)
    assert len(set(slots.values())) == len(paths) and trie.size < 1.5 * len(paths) + 300
    empty = T.DoubleArray(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert empty.step(np.array([0]), np.array([0])).tolist() == [-1]
