"""Bounded-space online packing of token ids into windows of one size (operator 7)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import map_groups, table, written
from formloom.llm.word_bpe import encoder

SIZE, OPEN, FAN_IN = 4096, 32, 64
#: A fullest window with less room than this is emitted padded; a larger room is filled by a cut.
CUT_ROOM = 32


class Packer:
    """A fixed number of open windows; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, open_windows: int, cut_room: int, first: int):
        self.size, self.most, self.cut_room, self.next = size, open_windows, cut_room, first
        self.windows: list[list] = []
        self.used: list[int] = []

    def emit(self, pieces: list) -> Iterator[tuple]:
        at, number = 0, self.next
        self.next += 1
        for doc_id, start, ids, tokens in pieces:
            yield doc_id, start, ids, tokens, number, at
            at += len(ids)

    def close(self, i: int) -> Iterator[tuple]:
        self.used.pop(i)
        yield from self.emit(self.windows.pop(i))

    def put(self, i: int, piece: tuple) -> Iterator[tuple]:
        self.windows[i].append(piece)
        self.used[i] += len(piece[2])
        if self.used[i] == self.size:
            yield from self.close(i)

    def place(self, doc_id, start: int, ids: np.ndarray, tokens: int) -> Iterator[tuple]:
        """Best fit; where none fits and all windows are open, the fullest is filled up and emitted."""
        while len(ids) >= self.size:
            yield from self.emit([(doc_id, start, ids[: self.size], tokens)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            fits = [(u, -i) for i, u in enumerate(self.used) if u + len(ids) <= self.size]
            if fits:
                yield from self.put(-max(fits)[1], (doc_id, start, ids, tokens))
                return
            if len(self.used) < self.most:
                self.windows.append([])
                self.used.append(0)
                continue
            fullest = self.used.index(max(self.used))
            room = self.size - self.used[fullest]
            if room < self.cut_room:
                yield from self.close(fullest)
            else:
                yield from self.put(fullest, (doc_id, start, ids[:room], tokens))
                start, ids = start + room, ids[room:]

    def rest(self) -> list[tuple]:
        out = [p for w in self.windows for p in w]
        self.windows, self.used = [], []
        return out

    def finish(self) -> Iterator[tuple]:
        """All that is open, cut to full windows; the last ids into windows whose sizes are powers of two."""
        left, room, held = self.rest(), 0, []
        total = sum(len(p[2]) for p in left)
        for doc_id, start, ids, tokens in left:
            while len(ids):
                if not room:
                    room = min(self.size, 1 << (total.bit_length() - 1))
                    total -= room
                held.append((doc_id, start, ids[:room], tokens))
                start, n, ids = start + len(ids[:room]), len(ids[:room]), ids[room:]
                room -= n
                if not room:
                    yield from self.emit(held)
                    held = []


def columns(pieces: list[tuple], part: int | None, keep: bool) -> dict:
    """A batch's columns of packed pieces (part is None) or of pieces still open in `part`."""
    packed = part is None
    return {
        "doc_id": [p[0] for p in pieces], "start": [p[1] for p in pieces], "length": [len(p[2]) for p in pieces],
        "ids_crc32": [zlib.crc32(p[2].astype("<u4").tobytes()) for p in pieces], "doc_tokens": [p[3] for p in pieces],
        "sequence_id": [p[4] if packed else None for p in pieces], "offset": [p[5] if packed else None for p in pieces],
        "part": [part] * len(pieces), "ids": [p[2].astype("<u4").tobytes() if keep or not packed else None for p in pieces],
    }


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, ids binary"


def pack(docs: DataFrame, vocabulary: str, end: int = 2, size: int = SIZE, open_windows: int = OPEN, cut_room: int = CUT_ROOM,
         fan_in: int = FAN_IN, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (keep_ids) ids,
    as little-endian unsigned 32-bit integers.

    `docs` needs doc_id and text; other columns are not read. A document is its
    text's ids and `end`; a null or empty text is `end` alone. Each task packs
    its own documents online with `open_windows` windows, so nothing is shuffled
    but what stays open: at most open_windows windows a task. Those are packed
    again, `fan_in` tasks' leftovers in one, until one group is left, which ends
    in windows whose sizes are powers of two and so need no padding. A document
    is cut where it fills a window, or where no window has room for it. Rows
    with null or repeated doc_ids are packed like others, each on its own.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema, name = f"doc_id {kind.simpleString()}, {PIECES}", to_arrow_type(kind)

    def first(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        packer = Packer(size, open_windows, cut_room, part << 28)
        for batch in batches:
            names, at, stop = batch.column(0).to_pylist(), 0, np.array([end], enc.type)
            for ids, bounds in enc.slices(batch.column(1)):
                out = []
                for a, b in zip(bounds, bounds[1:], strict=False):
                    out += packer.place(names[at], 0, np.append(ids[a:b], stop), int(b - a) + 1)
                    at += 1
                yield record(columns(out, None, keep_ids), name)
        yield record(columns(packer.rest(), part, keep_ids), name)

    def again(level: int, last: bool):
        def run(key, rows):
            packer = Packer(size, open_windows, cut_room, level << 56 | key[0] << 28)
            out = []
            for r in sorted(rows.to_pylist(), key=lambda r: (-r["length"], r["part"], r["at"])):
                out += packer.place(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
            if last:
                out += packer.finish()
            yield columns(out, None, keep_ids)
            yield columns(packer.rest(), key[0], keep_ids)

        return run

    step = written(docs.select("doc_id", "text").mapInArrow(first, schema), "packing")
    done = [step.where("part is null")]
    groups, level = step.agg(F.max("part")).first()[0], 0
    while True:
        level += 1
        groups = (groups or 0) // fan_in
        left = step.where("part is not null").withColumn("group", F.expr(f"part div {fan_in}").cast("int"))
        left = left.withColumn("at", F.monotonically_increasing_id()).select("group", "part", "at", "doc_id", "start", "length", "doc_tokens", "ids")
        step = map_groups(left, ["group"], again(level, groups == 0), schema)
        if groups == 0:
            done.append(step)
            break
        step = written(step, "packing")
        done.append(step.where("part is null"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = out if keep_ids else out.drop("ids")
    return out.drop("part")


def record(out: dict, name: pa.DataType) -> pa.RecordBatch:
    types = {"doc_id": name, "part": pa.int32(), "ids": pa.binary()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
