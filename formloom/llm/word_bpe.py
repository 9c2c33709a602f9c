"""Ids of the tokenizers library for whole texts: distinct parts of words are encoded once, their ids gathered."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from formloom.llm.common import kept

WORD_END = "</w>"
#: Distinct parts that a Python worker keeps; a full store is emptied. Texts are worked on in slices of about SLICE_BYTES (a longer text is one slice).
STORE_PARTS, SLICE_BYTES = 600_000, 8 << 20
GAP, LETTER, DIGIT, SYMBOL = range(4)
ODD_BYTES = re.compile(rb"[^!-&(-~\xc3\x80-\xbf]")


def byte_classes() -> np.ndarray:
    """What a byte of a plain word belongs to; white space that the vocabulary drops is a gap."""
    out = np.full(256, SYMBOL, np.uint8)
    out[[0x20, 0x09, 0x0A, 0x0D]] = GAP
    out[0x30:0x3A] = DIGIT
    out[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
    return out


CLASSES = byte_classes()


class WordEncoder:
    """Ids of texts, two or four bytes to an id.

    The vocabulary drops white space, and merges inside a part of a word only: a
    run of letters, one digit, or a run of other characters. So a text's ids are
    those of its parts in order. Plain words, of visible ASCII without the
    apostrophe and of the composed letters up to U+00FF, are cut and lower-cased
    as bytes; other words go whole through the library, which knows their rules.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.type = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.store: dict[bytes, int] = {}
        self.ids, self.bounds = np.zeros(0, self.type), np.zeros(1, np.int64)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts beyond ASCII: many in one call, told apart by the id that ends each."""
        ids = np.array(self.library([" ".join(parts)])[0], np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else ids
        if len(ends) == len(parts) and (not len(ends) or ends[-1] == len(ids)):
            return [x.tolist() for x in np.split(ids, ends[:-1])] if len(parts) else []
        return self.library(parts)

    def learn(self, keys: list[bytes]) -> None:
        """Adds parts and odd words; an ASCII part is what the library's merges work on."""
        found: dict[bytes, list[int]] = {}
        tokenize, odd, accented = self.tokenizer.model.tokenize, [], []
        for k in keys:
            if k.isascii() and not ODD_BYTES.search(k):
                found[k] = [t.id for t in tokenize(k.decode())]
            elif ODD_BYTES.search(k) or b"\xc3\x97" in k or b"\xc3\xb7" in k:
                odd.append(k)
            else:
                accented.append(k)
        found.update(zip(odd, self.library([k.decode() for k in odd]), strict=True))
        for a in range(0, len(accented), 4096):
            some = accented[a : a + 4096]
            found.update(zip(some, self.parts([k.decode() for k in some]), strict=True))
        first = len(self.store)
        self.store.update(zip(keys, range(first, first + len(keys)), strict=True))
        ids = [found[k] for k in keys]
        ends = np.cumsum([len(x) for x in ids], dtype=np.int64) + self.bounds[-1]
        self.bounds = np.concatenate([self.bounds, ends])
        self.ids = np.concatenate([self.ids, np.array([i for x in ids for i in x], self.type)])

    def places(self, distinct: list[bytes]) -> np.ndarray:
        get = self.store.get
        found = [get(k, -1) for k in distinct]
        new = [k for k, x in zip(distinct, found, strict=True) if x < 0]
        if new:
            if len(self.store) + len(new) > STORE_PARTS:
                self.clear()
                new = distinct
            self.learn(new)
            found = [self.store[k] for k in distinct]
        return np.array(found, np.int64)

    def slices(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts at a time: their ids, one after the other, and the bounds of each; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
            yield self.ids_of(data[offsets[a] : offsets[b]], offsets[a : b + 1].astype(np.int64) - int(offsets[a]))
            a = b

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds = CLASSES[data]
        inside = kinds != GAP
        # words begin after a gap or at the begin of a text, parts also where the kind changes and at each digit
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        word = inside & begin[:-1]
        word[1:] |= inside[1:] & ~inside[:-1]
        part = inside & (kinds == DIGIT)
        part[1:] |= inside[1:] & (kinds[1:] != kinds[:-1])
        part |= word
        # Latin capitals: ASCII, and U+00C0 to U+00DE but for the multiplication sign
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        capital = ((data >= 0x41) & (data <= 0x5A)) | (after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
        flat = data + (capital.astype(np.uint8) << 5)
        fine = (data > 0x20) & (data < 0x7F) & (data != 0x27) | (data == 0xC3) | (after & (data != 0x97) & (data != 0xB7))
        odd = np.flatnonzero(inside & ~fine)
        if len(odd):
            at = np.flatnonzero(word)
            which = np.unique(np.searchsorted(at, odd, "right") - 1)
            whole = np.zeros(len(at), bool)
            whole[which] = True
            marks = np.zeros(len(data), np.int32)
            marks[at] = 1
            whole = whole[np.cumsum(marks) - 1] & inside
            part &= ~whole | word
            flat = np.where(whole, data, flat)
        places = np.flatnonzero(part)
        letters = np.cumsum(inside, dtype=np.int64)
        ends = np.append(letters[places] - 1, letters[-1] if len(letters) else 0).astype(np.int32)
        units = pa.BinaryArray.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(flat[inside])]).dictionary_encode()
        slot = self.places(units.dictionary.to_pylist())[units.indices.to_numpy(zero_copy_only=False)] if len(places) else np.zeros(0, np.int64)
        start, size = self.bounds[slot], self.bounds[slot + 1] - self.bounds[slot]
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        ids = self.ids[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(places, offsets)]

    def encode(self, text: str | None) -> bytes:
        return b"".join(ids.tobytes() for ids, _ in self.slices(pa.array([text], pa.string())))


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    return kept("word_bpe", path, lambda: WordEncoder(path))
