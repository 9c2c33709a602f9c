"""Conversation prefix trie: double-array tries by prefix shard, merged into one tree (operator 13)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import table, written
from formloom.operators.skew import numbered, resharded_join

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations are cut into segments of this many turns, and a shard's trie holds about this many.
BAND, SHARD_TURNS = 64, 1 << 17
#: Turns of a path that order the shards; beyond these, conversations that still agree are dealt by id.
ORDERED_TURNS = 4
#: Sums along a conversation are made in runs of this many rows, then over the runs.
RUN = 1024
CHUNK_BYTES = 1 << 20


class DoubleArray:
    """A trie in two arrays: the child of slot s by code c is slot BASE[s] + c, if CHECK there is s.

    Codes are dense and not negative. Slot 0 is the root. Nodes with many
    children are placed first, each at the first place where all of them fit;
    single children then fill the gaps, so the arrays stay close to the number
    of nodes. A BASE may be negative.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        """codes: the sequences one after the other; lengths: of each."""
        first = np.cumsum(lengths) - lengths
        most = int(codes.max()) + 1 if len(codes) else 1
        at, parents, found, nodes = np.zeros(len(lengths), np.int64), [], [], 1
        for d in range(int(lengths.max()) if len(lengths) else 0):
            live = np.flatnonzero(lengths > d)
            edges, place = np.unique(at[live] * most + codes[first[live] + d], return_inverse=True)
            parents.append(edges // most)
            found.append(edges % most)
            at[live] = nodes + place
            nodes += len(edges)
        parent = np.concatenate([np.zeros(1, np.int64), *parents])
        code = np.concatenate([np.zeros(1, np.int64), *found])
        self.slot, base = self.placed(parent, code, nodes, most)
        self.size = int(self.slot.max()) + 1
        self.base, self.check = np.zeros(self.size, np.int64), np.full(self.size, -1, np.int64)
        self.base[self.slot] = base
        self.check[self.slot[1:]] = self.slot[parent[1:]]

    @staticmethod
    def placed(parent: np.ndarray, code: np.ndarray, nodes: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each node and its BASE; the children of a node are neighbours, by ascending code."""
        slot, base = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        cuts = np.flatnonzero(np.append(True, parent[2:] != parent[1:-1])) + 1 if nodes > 1 else np.zeros(0, np.int64)
        sizes = np.diff(np.append(cuts, nodes))
        used = np.zeros(2 * nodes + most + 64, bool)
        used[0], low = True, 1
        for g in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]:
            a, n = cuts[g], sizes[g]
            offsets = code[a : a + n] - code[a]
            while used[low]:
                low += 1
            begin, width = low, max(16, 65_536 // int(n))
            while True:
                if begin + width + most >= len(used):
                    used = np.append(used, np.zeros(len(used) + width + most, bool))
                tries = begin + np.flatnonzero(~used[begin : begin + width])
                fits = tries[~used[tries[:, None] + offsets].any(1)]
                if len(fits):
                    break
                begin += width
            slot[a : a + n] = fits[0] + offsets
            used[slot[a : a + n]] = True
            base[parent[a]] = fits[0] - code[a]
        single = cuts[sizes == 1]
        if len(single):
            slot[single] = np.flatnonzero(~np.append(used, np.zeros(len(single), bool)))[: len(single)]
            base[parent[single]] = slot[single] - code[single]
        return slot, base

    def step(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The slots of the children, -1 where there is none."""
        to = self.base[at] + codes
        fine = (at >= 0) & (to > 0) & (to < self.size)
        return np.where(fine & (self.check[np.where(fine, to, 0)] == at), to, -1)


def dense(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Codes 0, 1, 2... of the rows of some 64-bit columns, and how many there are."""
    rows = np.ascontiguousarray(np.stack(columns, 1)).view(f"V{8 * len(columns)}").ravel()
    values, codes = np.unique(rows, return_inverse=True)
    return codes.astype(np.int64), len(values)


def shard_nodes(s: dict[str, np.ndarray], band: int) -> dict[str, np.ndarray]:
    """One row for each node of a shard's segments, with sums over the segments that pass it.

    s: conv, band, s1, s2 (the path before), f, l (values to sum) of each
    segment, lengths, and z1, z2, w (words) of all turns; a band has `band`
    turns. The node before a
    segment belongs to the band before; that of band 0 is the root.
    """
    lengths = s["lengths"]
    first = np.cumsum(lengths) - lengths
    turns, n_turns = dense(s["z1"], s["z2"])
    heads, _ = dense(s["band"], s["s1"], s["s2"])
    codes = np.empty(len(turns) + len(lengths), np.int64)
    begin = first + np.arange(len(lengths))
    inside = np.ones(len(codes), bool)
    inside[begin] = False
    codes[begin], codes[inside] = n_turns + heads, turns
    trie = DoubleArray(codes, lengths + 1)
    size = trie.size
    out = {k: np.zeros(size, np.int64) for k in ("p1", "p2", "q1", "q2", "depth", "n", "words", "f", "l")}
    out["conv"] = np.full(size, np.iinfo(np.int64).max)
    met = np.zeros(size, bool)
    at, p1, p2 = np.zeros(len(lengths), np.int64), s["s1"].copy(), s["s2"].copy()
    for d in range(int(lengths.max()) + 1):
        live = np.flatnonzero(lengths >= d)
        to = trie.step(at[live], codes[begin[live] + d])
        at[live] = to
        if d:
            place = first[live] + d - 1
            out["q1"][to], out["q2"][to] = p1[live], p2[live]
            p1[live] ^= s["z1"][place]
            p2[live] ^= s["z2"][place]
            out["words"][to] = s["w"][place]
        else:
            live, to = live[s["band"][live] == 0], to[s["band"][live] == 0]
        met[to] = True
        out["p1"][to], out["p2"][to], out["depth"][to] = p1[live], p2[live], s["band"][live] * band + d
        np.add.at(out["n"], to, 1)
        np.add.at(out["f"], to, s["f"][live])
        np.add.at(out["l"], to, s["l"][live])
        np.minimum.at(out["conv"], to, s["conv"][live])
    return {k: v[met] for k, v in out.items()}


NODES = ("p1", "p2", "q1", "q2", "depth", "n", "words", "f", "l", "conv")


def traversed(segments: DataFrame) -> DataFrame:
    """The shards' nodes: segments are dealt and sorted by path, and each task packs them into one trie after the other.

    `segments` has conv_id, band, s1, s2, z1, z2, w (arrays), f and l. A path
    that many conversations share is cut by their ids, so shards are equal; its
    nodes then come from several shards, each with a part of the sums.
    """
    order = ["band", "s1", "s2", *[F.get("z1", F.lit(i)) for i in range(ORDERED_TURNS)], "conv_id"]
    rows = segments.select("conv_id", "band", "s1", "s2", "f", "l", "z1", "z2", "w")
    names, lists = ("conv", "band", "s1", "s2", "f", "l"), ("z1", "z2", "w")

    def run(batches):
        held, turns = [], 0

        def shard():
            s = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
            out = shard_nodes(s, BAND)
            return pa.RecordBatch.from_arrays([pa.array(out[k]) for k in NODES], names=list(NODES))

        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                b = batch.slice(a, 2048)
                x = {k: b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, k in enumerate(names)}
                x |= {k: b.column(6 + i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i, k in enumerate(lists)}
                x["lengths"] = b.column(6).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                held.append(x)
                turns += len(x["w"]) + len(x["conv"])
                if turns >= SHARD_TURNS:
                    yield shard()
                    held, turns = [], 0
        if held:
            yield shard()

    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.mapInArrow(run, ", ".join(f"{k} long" for k in NODES))


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1, 2, 3...), k (a hash of role and text) and words of all turns.

    Turns are ordered by turn (null first), equal ones by the md5 of role and
    text. Null roles and texts are empty; rows without conv_id belong to no
    conversation and are left out. Texts stay where they are: only hashes move.
    A conversation with most rows is numbered in ranges.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(" "), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", key.alias("k")).alias("o"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return written(numbered(rows, "o", "pos", ["conv_id"]).select("conv_id", "pos", F.unhex("o.k").alias("k"), "words"), "turns")


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversation c as the first h turns of conversation c - c % block, then its own after its first h; and all ids.

    h is crc32 of c's decimal digits modulo `heads`; % has the sign of c.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    ids = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    of_base = sizes.select(F.col("conv_id").alias("base"), "n")
    ids = written(ids.join(of_base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("got")), "conversations")
    head = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    head = ids.join(head, "base").where("pos <= h").select("conv_id", "pos", "k", "words")
    own = resharded_join(turns, ids, ["conv_id"]).where("pos > h").select("conv_id", (F.col("got") + F.col("pos") - F.col("h")).alias("pos"), "k", "words")
    return head.unionByName(own), ids.select("conv_id")


def joined(*columns: str) -> list[Column]:
    return [F.coalesce(F.bit_xor(c), F.lit(0)).cast("long").alias(c) for c in columns]


def segmented(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, band, s1, s2 (the path before), e1, e2 (the segment's share), z1, z2, w: BAND turns in one row.

    A path of d turns is the exclusive or of 128-bit hashes of its turns with
    their places, so the paths before all segments of a conversation come from
    running sums over its segments, RUN of them at a time.
    """
    rows = turns.select("conv_id", "pos", F.xxhash64("k", "pos").alias("z1"), F.xxhash64("pos", "k").alias("z2"), "words")
    rows = rows.unionByName(ids.select("conv_id", F.lit(0).cast("long").alias("pos"), *[F.lit(None).cast("long").alias(c) for c in ("z1", "z2", "words")]))
    turn = F.when(F.col("pos") > 0, F.struct("pos", "z1", "z2", "words"))
    seg = rows.withColumn("band", F.expr(f"greatest(pos - 1, 0) div {BAND}")).groupBy("conv_id", "band").agg(
        F.sort_array(F.collect_list(turn)).alias("t"), *[x.alias(y) for x, y in zip(joined("z1", "z2"), ("e1", "e2"), strict=True)])
    seg = seg.select("conv_id", "band", "e1", "e2", F.col("t.z1").alias("z1"), F.col("t.z2").alias("z2"), F.col("t.words").alias("w"))
    seg = written(seg.withColumn("run", F.expr(f"band div {RUN}")), "segments")
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = seg.where("band > 0").select("conv_id").distinct().join(seg.select("conv_id", "run", "e1", "e2"), "conv_id")
    runs = runs.groupBy("conv_id", "run").agg(*joined("e1", "e2"))
    runs = runs.select("conv_id", "run", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"b{c}") for c in ("e1", "e2")]).where("run > 0")
    inside = Window.partitionBy("conv_id", "run").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumns({f"i{c}": F.coalesce(F.bit_xor(c).over(inside), F.lit(0)) for c in ("e1", "e2")}).join(runs, ["conv_id", "run"], "left")
    start = [F.col(f"i{c}").bitwiseXOR(F.coalesce(f"b{c}", F.lit(0))).alias(s) for c, s in (("e1", "s1"), ("e2", "s2"))]
    return written(seg.select("conv_id", "band", *start, "e1", "e2", "z1", "z2", "w"), "segments")


def digests(ends: DataFrame) -> DataFrame:
    """p1, p2 and ends_sha256 of ends (p1, p2, conv_id): SHA-256 of the ascending ids' decimals with commas.

    Ids are sorted over all tasks by path and id. A path that lies inside one
    task is hashed there, as its ids stream by. One that begins or ends a task,
    or has above CHUNK_BYTES of digits, gives its text in chunks, which one task
    hashes in order: SHA-256 runs through its bytes once, but nothing is held.
    """
    schema = "p1 long, p2 long, conv_id long, chunk binary, ends_sha256 string"

    def first(batches):
        key, texts, size, start, begins, rows = None, [], 0, None, True, []

        def piece():
            return (*key, start, b",".join(texts), None)

        for batch in batches:
            p1, p2, ids = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.append(True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])))
            for a, b in zip(cuts, [*cuts[1:], len(p1)], strict=True):
                now = (int(p1[a]), int(p2[a]))
                if key is not None and now != key:
                    if not begins:
                        rows.append((*key, None, None, hashlib.sha256(b",".join(texts)).hexdigest()))
                    elif texts:
                        rows.append(piece())
                    texts, size, begins = [], 0, False
                key = now
                for x in range(a, b, 65_536):
                    start = int(ids[x]) if not texts else start
                    texts.append(",".join(map(str, ids[x : min(b, x + 65_536)].tolist())).encode())
                    size += len(texts[-1])
                    if size >= CHUNK_BYTES:
                        rows.append(piece())
                        texts, size, begins = [], 0, True
            if rows:
                yield as_rows(rows)
                rows = []
        if texts:
            yield as_rows([piece()])

    def as_rows(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["p1", "p2", "conv_id", "chunk", "ends_sha256"])

    def rest(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for p1, p2, _, chunk in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (p1, p2) == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        out.append((*key, None, None, sha.hexdigest()))
                    key, sha = (p1, p2), hashlib.sha256()
                sha.update(chunk.as_py())
            if out:
                yield as_rows(out)
        if key is not None:
            yield as_rows([(*key, None, None, sha.hexdigest())])

    order = ["p1", "p2", "conv_id"]
    pieces = written(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(first, schema), "ends")
    open_ = pieces.where("chunk is not null").select(*order, "chunk").repartition("p1", "p2").sortWithinPartitions(*order).mapInArrow(rest, schema)
    return pieces.where("chunk is null").unionByName(open_).select("p1", "p2", "ends_sha256")


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each node of the trie of sequences of turns.

    `turns` has conv_id, pos (1 to n without a gap), k and words; `ids` all
    conv_ids once, also those without turns, which are members of the root
    alone. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, node and parent (128-bit
    path hashes as two numbers). No ids, no nodes.

    Shards give each node's members; the nodes that several shards share are
    merged by path. Sums over subtrees need no walk up the tree: each node is
    owned by its smallest member, whose own nodes are the end of its path. A
    subtree's sum is then the owner's sum from the node down, and for each
    other member all that it owns: a sum over members, which a second pass over
    the shards gives. Conversations of any length and paths of any number of
    members are cut into bounded pieces.
    """
    seg = segmented(turns, ids)
    none = F.lit(0).cast("long")
    parts = traversed(seg.withColumns({"f": none, "l": none}))
    nodes = parts.groupBy("p1", "p2").agg(
        F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min("words").alias("words"))
    nodes = written(nodes.withColumns({c: F.when(F.col("depth") > 0, F.col(c)) for c in ("q1", "q2")}), "nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumns({"x": (F.col("n") - 1) * F.col("words"), "leaf": (F.col("n_children") == 0).cast("long"), "run": F.expr(f"depth div {RUN}")})
    nodes = written(nodes, "nodes")
    runs = nodes.groupBy("conv", "run").agg(F.sum("x").alias("x"), F.sum("leaf").alias("l"))
    deeper, whole = Window.partitionBy("conv").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv")
    runs = written(runs.select("conv", "run", *[F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(f"later_{c}") for c in "xl"], *[F.sum(c).over(whole).alias(f"all_{c}") for c in "xl"]), "runs")
    below = Window.partitionBy("conv", "run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumns({"fx": F.sum("x").over(below), "fl": F.sum("leaf").over(below)}).join(runs, ["conv", "run"])
    owned = runs.select(F.col("conv").alias("conv_id"), F.col("all_x").alias("f"), F.col("all_l").alias("l")).distinct()
    valued = resharded_join(seg, owned, ["conv_id"], "left").withColumns({c: F.coalesce(c, none) for c in "fl"})
    sums = traversed(valued).groupBy("p1", "p2").agg(F.sum("f").alias("f"), F.sum("l").alias("l"))
    ends = digests(seg.groupBy("conv_id").agg(*[x.alias(y) for x, y in zip(joined("e1", "e2"), ("p1", "p2"), strict=True)]))
    out = nodes.join(sums, ["p1", "p2"]).join(ends, ["p1", "p2"], "left")
    names = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent_conv_id"))
    out = resharded_join(out, names, ["q1", "q2"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        (F.col("l") - F.col("all_l") + F.col("fl") + F.col("later_l")).alias("n_leaves"),
        (F.col("f") - F.col("all_x") + F.col("fx") + F.col("later_x")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        F.array("p1", "p2").alias("node"), F.when(F.col("depth") > 0, F.array("q1", "q2")).alias("parent"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(ordered(table(spark, sf_dir, "conversations")))).drop("node", "parent")


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": r"""
with tab as materialized (select list(v order by i) as tab from (select i,
  list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(256) t(i))),
t as (select conv_id::bigint as c, turn, md5(length(coalesce(role, ''))::varchar || ' ' || coalesce(role, '') || coalesce(text, '')) as k,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as w from conversations where conv_id is not null),
o as materialized (select c, k, w, row_number() over (partition by c order by turn nulls first, k) as pos from t),
sizes as (select c, count(*) as n from o group by c),
ids as materialized (select s.c, s.c - s.c % 20 as base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(s.c::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 as h from sizes s, tab),
r as materialized (select i.c, o.pos, k, w from ids i join o on o.c = i.base and o.pos <= i.h
  union all select i.c, least(i.h, coalesce(b.n, 0)) + o.pos - i.h, k, w from ids i join o on o.c = i.c and o.pos > i.h left join sizes b on b.c = i.base),
p as materialized (select c, pos, w, string_agg(k, '') over (partition by c order by pos) as p, string_agg(k, '') over (partition by c order by pos rows between unbounded preceding and 1 preceding) as q from r
  union all select c, 0, 0, '', null from ids),
e as (select c, max_by(p, pos) as p from p group by c),
n as materialized (select p, min(c) as conv_id, min(pos) as depth, any_value(case when pos > 0 then coalesce(q, '') end) as q, count(*) as n, min(w) as w from p group by p),
kids as (select q, count(*) as n_children from n where depth > 0 group by q),
below as (select distinct a.p, b.p as u from p a join p b on a.c = b.c and b.pos >= a.pos),
sums as (select below.p, count(*) filter (k.q is null) as n_leaves, sum((u.n - 1) * u.w) as saved from below join n u on u.p = below.u left join kids k on k.q = u.p group by below.p),
ends as (select p, sha256(string_agg(c::varchar, ',' order by c)) as x from e group by p)
select n.conv_id, n.depth::bigint as depth, m.conv_id as parent_conv_id, n.n as n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved::bigint as saved_tokens,
  coalesce(x, sha256('')) as ends_sha256 from n left join n m on m.p = n.q left join kids on kids.q = n.p join sums on sums.p = n.p left join ends on ends.p = n.p
"""}
