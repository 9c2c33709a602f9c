"""Byte-level BPE encoding and decoding by a local rank file (operator 3)."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from formloom.llm.common import map_batches, table

#: A text is cut only before a blank that follows an ASCII letter or digit. Each match of the
#: pre-splitting pattern that holds such a letter or digit ends before a blank, and only an
#: optional leading blank belongs to a match, so no match crosses such a place.
SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_ENCODINGS: dict = {}


def encoding(rank_file: str, pattern: str):
    """One tiktoken encoding for each Python worker and rank file."""
    import tiktoken

    if (rank_file, pattern) not in _ENCODINGS:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[rank_file, pattern]


def pieces(text: str, size: int) -> Iterator[str]:
    """The text in order, cut at the first safe place after every `size` characters."""
    at = 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(enc, text: str | None, size: int = 1 << 16) -> np.ndarray:
    if not text:
        return np.zeros(0, "<u4")
    ids = [i for p in pieces(text, size) for i in enc.encode_ordinary(p)]
    return np.array(ids, dtype="<u4")


def encode(docs: DataFrame, rank_file: str, pattern: str, piece_chars: int = 1 << 16, keep_ids: bool = True) -> DataFrame:
    """Ids of every document's text: doc_id, n_tokens, ids (keep_ids), ids_sha256, decoded_sha256.

    `docs` needs doc_id and text; other columns, whatever their names, are not
    read. A null or empty text has no ids, and the hashes of no bytes. Repeated
    rows and null doc_ids each give their own row. Texts longer than
    `piece_chars` are encoded in pieces cut at safe places, with the same ids.
    Decoding joins the bytes of the ids. Nothing is shuffled.
    """

    def make():
        enc = encoding(rank_file, pattern)

        def run(batch):
            texts = batch.column(1)
            for a in range(0, batch.num_rows, 256):
                ids = [encode_text(enc, x.as_py(), piece_chars) for x in texts[a : a + 256]]
                out = {
                    "doc_id": batch.column(0)[a : a + 256], "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(enc.decode_bytes(x.tolist())).hexdigest() for x in ids],
                }
                yield out | {"ids": [x.astype("int32") for x in ids]} if keep_ids else out

        return run

    ids_column = "ids array<int>, " if keep_ids else ""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs.select("doc_id", "text"), make,
        f"doc_id {kind}, n_tokens long, {ids_column}ids_sha256 string, decoded_sha256 string",
    )


def decode(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of each row's ids (null ids: no bytes)."""

    def make():
        enc = encoding(rank_file, pattern)

        def run(batch):
            yield {"doc_id": batch.column(0), "content": [enc.decode_bytes(x.as_py() or []) for x in batch.column(1)]}

        return run

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return map_batches(tokens.select("doc_id", "ids"), make, f"doc_id {kind}, content binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep_ids=False)


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLES: dict[str, str] = {}
