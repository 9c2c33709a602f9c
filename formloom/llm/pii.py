"""Personal data by base patterns and bootstrapped contextual extraction (operator 8)."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import map_batches, table, written
from formloom.operators.skew import resharded_join

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A start inside a run of digits fails as its first digit does, and no match ends inside a run.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Looser shapes that a trusted context may confirm.
NUMBER = re.compile(r"(?<!\w)[0-9](?:[ ().-]{0,2}[0-9])++(?!\w)")
ADDRESS = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?:[:.][0-9A-Fa-f]{0,4}){3,7}(?![\w:.])")
MAILBOX = re.compile(r"(?<![\w.%+-])[\w.%+-]++(?:@|\(at\)|\[at\])[\w.-]{2,}+")
#: What the operator adds to a document, and its own helpers.
COLUMNS = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found", "_base", "_row", "_found"]
AT = ("@", "(at)", "[at]")
OCCURRENCE = "array<struct<kind:string,start:int,stop:int,value:string,seed:boolean,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: linear also in words without end."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def octet(x: str) -> bool:
    x = x.lstrip("0") or "0"
    return len(x) <= 3 and int(x) <= 255


def digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the four base kinds, in that order."""
    if not text:
        return []
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(octet(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(d := digits(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the looser shapes that touch no base span and no earlier candidate."""
    loose = [(m.start(), 0, m.end()) for m in MAILBOX.finditer(text)] if any(x in text for x in AT) else []
    loose += [(m.start(), 1, m.end()) for m in ADDRESS.finditer(text) if re.search("[0-9]", m.group())]
    for m in NUMBER.finditer(text):
        n = len(digits(m.group()))
        if 7 <= n <= 19:
            loose.append((m.start(), 2 if n >= 12 else 3, m.end()))
    out, taken, i, last = [], sorted((a, b) for a, _, b in base), 0, 0
    for a, k, b in sorted(loose):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= last and not (i < len(taken) and taken[i][0] < b):
            out.append((a, k, b))
            last = b
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of one place: the word before, two words before, the words around; digits as 0."""
    left = re.sub("[0-9]", "0", text[max(0, start - 64) : start].lower()).split()[-2:]
    right = re.sub("[0-9]", "0", text[end : end + 32].lower()).split()[:1]
    if not left:
        return []
    out = [f"{left[-1]} _"]
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if right:
        out.append(f"{left[-1]} _ {right[0]}")
    return out


def scan(text: str | None) -> tuple[list, list]:
    """Base spans, and occurrences (base ones as seeds, then candidates) with their patterns."""
    if not text or not (any(x in text for x in AT) or re.search("[0-9]", text)):
        return [], []
    base = base_spans(text)
    found = [(x, True) for x in base] + [(x, False) for x in candidates(text, base)]
    return base, [
        {"kind": KINDS[k], "start": a, "stop": b, "value": text[a:b].lower(), "seed": seed, "patterns": contexts(text, a, b)}
        for (a, k, b), seed in found
    ]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(docs: DataFrame, keep: bool) -> DataFrame:
    """One row for each document with its counts, base spans and occurrences; _row tells the rows apart."""

    def make():
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33

        def run(batch):
            nonlocal number
            n = batch.num_rows
            found = [scan(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            out = dict(zip(batch.schema.names, batch.columns, strict=True)) if keep else {"doc_id": batch.column(0)}
            texts = [joined(b) for b, _ in found]
            out |= {f"n_{kind}": [sum(x[1] == k for x in b) for b, _ in found] for k, kind in enumerate(KINDS)}
            yield out | {
                "base_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in texts], "_base": texts,
                "_row": list(range(number, number + n)), "_found": [o for _, o in found],
            }
            number += n

        return run

    columns = docs.drop(*COLUMNS) if keep else docs.select("doc_id", "text")
    kept = columns.schema if keep else docs.select("doc_id").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_batches(columns, make, f"{schema}, {counts}, base_sha256 string, _base string, _row long, _found {OCCURRENCE}")


def trusted(graph: DataFrame, rounds: int, least_seeds: int, least_confidence: float) -> DataFrame:
    """kind and pattern of the contexts to trust, from the graph (kind, pattern, value, seed) of distinct edges.

    An instance of its own kind counts 1 if it is a seed; if an earlier generation
    found it, the confidence of the best pattern that did; else the confidence of
    its best pattern so far. Instances of other kinds count 0. A pattern's
    confidence is the sum of its instances over their number plus one. Only
    patterns with `least_seeds` distinct seeds or found instances take part. What
    a generation's trusted patterns surround joins the seeds of the next, until
    nothing new is found; a pattern once trusted stays so.
    """
    graph = written(graph, "pii-graph")
    total = written(graph.groupBy("pattern").agg(F.count("*").alias("n")), "pii-sizes")
    pair, found, good = ["kind", "pattern"], None, None
    while True:
        known = graph.withColumn("s", F.lit(None).cast("double")) if found is None else resharded_join(graph, found, ["kind", "value"], "left")
        known = known.withColumn("own", F.when(F.col("seed"), 1.0).otherwise(F.col("s"))).drop("s")
        sums = known.groupBy(*pair).agg(F.count("own").alias("seeds"), F.sum("own").alias("own")).where(F.col("seeds") >= least_seeds)
        base = written(sums.join(total, "pattern"), "pii-patterns")
        edges = written(resharded_join(known.where("own is null"), base.select(*pair), pair).select(*pair, "value"), "pii-edges")
        confidence = base.select(*pair, (F.col("own") / (F.col("n") + 1)).alias("c"))
        for _ in range(rounds):
            best = resharded_join(edges, confidence, pair).groupBy("kind", "value").agg(F.max("c").alias("s"))
            more = resharded_join(edges, best, ["kind", "value"]).groupBy(*pair).agg(F.sum("s").alias("s"))
            confidence = written(base.join(more, pair, "left").select(
                *pair, ((F.col("own") + F.coalesce("s", F.lit(0.0))) / (F.col("n") + 1)).alias("c")), "pii-confidence")
        sure = confidence.where(F.col("c") >= least_confidence)
        good = sure.select(*pair) if good is None else good.union(sure.select(*pair)).distinct()
        fresh = written(resharded_join(edges, sure, pair).groupBy("kind", "value").agg(F.max("c").alias("s")), "pii-found")
        if fresh.isEmpty():
            return good
        found = fresh if found is None else found.union(fresh)


def extract(docs: DataFrame, rounds: int = 2, least_seeds: int = 5, least_confidence: float = 0.8, keep: bool = False) -> DataFrame:
    """n_email, n_ip, n_card, n_phone, base_sha256, spans and found, beside doc_id or (keep) all columns of `docs`.

    `docs` needs doc_id and text. The counts and base_sha256 are those of the
    base patterns; spans has base and discovered ones, found the discovered as
    structs. Base matches are the seeds; the words around them are patterns;
    looser shapes of a kind are candidates, and one is reported where a trusted
    pattern of its kind surrounds it; reported values are seeds in turn, so that
    their other contexts may be trusted too. Null and empty texts have no spans; rows
    with null or repeated doc_ids are told apart by their place in the written
    scan. Columns with the names of the new ones are replaced.
    """
    rows = written(scanned(docs, keep), "pii-scan")
    each = rows.select("_row", F.inline("_found")).select("_row", "kind", "start", "stop", "value", "seed", F.explode("patterns").alias("pattern"))
    graph = each.groupBy("kind", "pattern", "value").agg(F.bool_or("seed").alias("seed"))
    good = trusted(graph, rounds, least_seeds, least_confidence)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    found = resharded_join(each.where("not seed"), good, ["kind", "pattern"]).select("_row", F.struct("start", place.alias("place"), "stop", "kind").alias("span"))
    found = found.groupBy("_row").agg(F.sort_array(F.collect_set("span")).alias("found"))
    out = rows.drop("_found").join(found, "_row", "left")
    parts = F.transform(F.filter(F.split("_base", ","), lambda x: x != ""), lambda x: F.split(x, ":"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform(parts, lambda x: F.struct(x[1].cast("int").alias("start"), F.array_position(kinds, x[0]).cast("int").alias("place"), x[2].cast("int").alias("stop"), x[0].alias("kind")))
    every = F.array_sort(F.concat(base, F.coalesce("found", F.expr("cast(array() as array<struct<start:int,place:int,stop:int,kind:string>>)"))))
    text = F.array_join(F.transform(every, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    return out.withColumn("spans", F.when(F.col("found").isNull(), F.col("_base")).otherwise(text)).drop("_row", "_base")


def mask(found: DataFrame) -> DataFrame:
    """The rows of extract(keep=True) with each span of text replaced by its kind in brackets."""

    def make():
        def run(batch):
            names = batch.schema.names
            out = dict(zip(names, batch.columns, strict=True))
            texts = []
            for text, spans in zip(out["text"].to_pylist(), out.pop("spans").to_pylist(), strict=True):
                at, parts = 0, []
                for kind, a, b in (x.split(":") for x in (spans or "").split(",") if x):
                    if int(a) >= at:
                        parts += [text[at : int(a)], f"[{kind.upper()}]"]
                    at = max(at, int(b))
                texts.append(text if text is None else "".join([*parts, text[at:]]))
            yield out | {"text": texts}

        return run

    columns = found.drop(*(f"n_{k}" for k in KINDS), "base_sha256", "found")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.drop("spans").schema)
    return map_batches(columns, make, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "documents")).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")


QUERIES = {"op8_pii": op8_pii}
ORACLES: dict[str, str] = {}
