"""Language ID by cross-parsing entropy over suffix automata (operator 10)."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import kept, map_batches, remainder, table

#: Runs of letters; all else in a text only separates them.
LETTERS = re.compile(r"[^\W\d_]+")
#: Words kept with their phrase counts in each Python worker; a full store is emptied.
STORE_WORDS = 200_000


class SuffixAutomaton:
    """Accepts exactly the substrings of one text; a walk from its start is a longest match."""

    def __init__(self, text: str):
        self.length = len(text)
        self.next: list[dict[str, int]] = [{}]
        link, size, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new

    def phrases(self, text: str) -> int:
        """Phrases of the cross-parsing: each the longest match at its place, or one unknown character."""
        start, count, state, fresh = self.next[0], 0, self.next[0], True
        for c in text:
            to = state.get(c)
            if to is None:
                count += not fresh
                to = start.get(c)
                if to is None:
                    count += 1
                    state, fresh = start, True
                    continue
            state, fresh = self.next[to], False
        return count + (not fresh)


class Parser:
    """Normalised phrase counts of texts, one number for each language."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.automata = [SuffixAutomaton(samples[x]) for x in self.langs]
        self.weight = np.array([math.log2(a.length + 2) for a in self.automata])
        self.store: dict[str, int] = {}
        self.counts = np.zeros((STORE_WORDS, len(self.langs)), np.int32)

    def row(self, word: str) -> int:
        if len(self.store) == STORE_WORDS:
            self.store.clear()
        n = self.store[word] = len(self.store)
        self.counts[n] = self.phrases(word)
        return n

    def phrases(self, word: str) -> list[int]:
        runs = LETTERS.findall(word)
        return [sum(a.phrases(" " + x) for x in runs) for a in self.automata]

    def costs(self, text: str) -> np.ndarray:
        words, get, total = text.lower().split(), self.store.get, np.zeros(len(self.langs), np.int64)
        for a in range(0, len(words), 4096):
            block = words[a : a + 4096]
            if len(self.store) + len(block) > STORE_WORDS:
                self.store.clear()
            rows = [n if (n := get(w)) is not None else self.row(w) for w in block if len(w) <= 64]
            total += self.counts[rows].sum(0, dtype=np.int64)
            for w in block:
                if len(w) > 64:
                    total += self.phrases(w)
        return total * self.weight / max(len(text), 1)


def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """One parser for each Python worker and set of samples."""
    return kept("language", samples, lambda: Parser(dict(samples)))


def fit(docs: DataFrame, learn: Column, sample_docs: int = 64, sample_chars: int = 65_536, doc_chars: int = 16_384) -> tuple:
    """A bounded sample of labelled text for each language.

    Rows where `learn` holds and lang, text are given; the `sample_docs` distinct
    texts with the smallest hashes, in that order, until `sample_chars` are
    reached. A text gives its first `doc_chars` characters from the first letter
    on, whatever its length. Only hashes are shuffled.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    known = known.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    # a language may have most rows: first the smallest of each of its 256 parts, then of those
    chosen = known.select("lang", "h").distinct().withColumn("part", F.pmod(F.hash("h"), 256))
    for keys in (["lang", "part"], ["lang"]):
        chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("n") <= sample_docs)
    rows = known.join(F.broadcast(chosen.drop("n", "part")), ["lang", "h"])
    rows = rows.withColumn("text", F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, doc_chars)).dropDuplicates(["lang", "h"]).collect()
    samples: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h)):
        if len(samples.get(r.lang, "")) < sample_chars:
            samples[r.lang] = samples.get(r.lang, "") + " " + " ".join(LETTERS.findall(r.text.lower()))
    return tuple(sorted(samples.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], keep: bool = False) -> DataFrame:
    """lang_pred and score for each document, beside doc_id or (keep) all its columns.

    `docs` needs doc_id and text, other columns are not read. Words are the runs
    of letters, in lower case; the cross-parsing starts anew at each word, with
    a blank before it. The language with the smallest phrases x
    log2(sample length) / characters wins, ties go to the first by name. score
    is 1 - best / second best, 1 with one language. A null text, one without a
    letter, and any text if no language was learned, are `und` with score 0.
    Repeated rows each give a row; an empty table an empty result.
    """

    def make():
        p = parser(samples)

        def run(batch):
            texts = batch.column(batch.schema.get_field_index("text"))
            pred, score = [], []
            for x in texts:
                text = x.as_py()
                if not p.langs or text is None or not LETTERS.search(text):
                    pred.append("und")
                    score.append(0.0)
                    continue
                cost = p.costs(text)
                best = int(cost.argmin())
                rest = np.delete(cost, best)
                pred.append(p.langs[best])
                score.append(float(1 - cost[best] / rest.min()) if len(rest) and rest.min() > 0 else float(not len(rest)))
            out = dict(zip(batch.schema.names, batch.columns, strict=True)) if keep else {"doc_id": batch.column(0)}
            yield out | {"lang_pred": pred, "score": score}

        return run

    columns = docs.drop("lang_pred", "score") if keep else docs.select("doc_id", "text")
    kept = columns.schema if keep else docs.select("doc_id").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_batches(columns, make, f"{schema}, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = fit(docs, remainder("doc_id", 5) != 0)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return identify(docs, samples).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language": op10_language}
ORACLES: dict[str, str] = {}
