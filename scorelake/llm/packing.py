"""Harmonic packing of token sequences: every length class fills its own bins with a fixed number of pieces."""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Bytes of ids and chunks of text that a worker remembers, about.
REMEMBERED = 256_000_000
#: What an entry takes besides its text and ids.
ENTRY = 160
MARKS = b",.;:!?*&%$#|"
LOADED: dict[str, "Tokenizer"] = {}  # noqa: F821
KEPT: dict[tuple[str, int], "Tokens"] = {}
END = (1).to_bytes(4, "little")

# Fixed values of the tokenizer files whose texts may be cut at white space: steps before splitting, and the split.
STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def loaded(path: str):
    """The worker's own tokenizer, and whether white space and the step from letters to marks always end its tokens.

    That is known of files that lower-case and split as ``STEPS`` and ``SPLIT`` say. Others get whole texts."""
    if path not in LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        before, split = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
        first = (split.get("pretokenizers") or [{}])[0]
        spaced = any(any(ch.isspace() for ch in t["content"]) for t in file.get("added_tokens", []))
        rest = [(p.get("type"), p.get("add_prefix_space"), p.get("use_regex")) for p in (split.get("pretokenizers") or [])[1:]]
        known = before.get("normalizers") == STEPS and first.get("pattern") == {"Regex": SPLIT} and rest == [("ByteLevel", False, False)] and not spaced
        LOADED[path] = Tokenizer.from_file(path), known
    return LOADED[path]


class Tokens(dict):
    """Ids of a text as little-endian 32-bit words, remembered by chunk.

    A text is cut at ASCII white space. A chunk of letters and trailing marks is looked up as its two halves, if its
    letters are still letters alone once the tokenizer has lower-cased them: some become a letter and a mark. When half
    of what may be remembered is full, it becomes the older half, of which chunks that are met again are kept."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.tokenizer, self.known = loaded(path)
        self.most, self.held, self.older = remembered // 2, 0, {}

    def of(self, text: bytes) -> bytes:
        if not self.known:
            return self.encoded([text])[0]
        chunks = text.split()
        if self.held > self.most:
            self.older, self.held = dict(self), 0
            self.clear()
        self._find({c for c in chunks if c not in self})
        return b"".join(map(self.__getitem__, chunks))

    def _find(self, new: set[bytes]) -> None:
        for c in new & self.older.keys() if self.older else ():
            self._keep(c, self.older[c])
        halves = {}
        for c in new:
            if c not in self and (letters := c.rstrip(MARKS)):
                if letters.isascii():
                    if letters.isalpha():
                        halves[c] = (letters.lower(), c[len(letters) :])
                elif self.only_letters(letters):
                    halves[c] = (letters, c[len(letters) :])
        self._learn({h for pair in halves.values() for h in pair if h not in self} | {c for c in new if c not in self and c not in halves})
        for c, (a, b) in halves.items():
            if b:
                self._keep(c, self[a] + self[b])
            elif a != c:
                self._keep(c, self[a])

    def only_letters(self, word: bytes) -> bool:
        if word.isascii():
            return word.isalpha()
        text = word.decode("utf-8", "replace")
        return text.isalpha() and self.tokenizer.normalizer.normalize_str(text).isalpha()

    def _keep(self, chunk: bytes, ids: bytes) -> None:
        self.held += len(chunk) + len(ids) + ENTRY
        self[chunk] = ids

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, chunks: set[bytes]) -> None:
        tokenize, held = self.tokenizer.model.tokenize, 0
        plain = [c for c in chunks if c.isalpha() and c.isascii() and c.islower()]
        for c in plain:  # words as they are after lower-casing: the model's own, nothing to split
            found = [t.id for t in tokenize(c.decode())]
            self[c] = pack(f"<{len(found)}I", *found)
            held += len(c) + 4 * len(found)
        self.held += held + ENTRY * len(plain)
        if len(plain) == len(chunks):
            return
        words = [c for c in chunks if c not in self and self.only_letters(c)]
        for at in range(0, len(words), 10_000):  # one call for many words is faster, if each is one word to the tokenizer
            part = words[at : at + 10_000]
            e = self.tokenizer.encode(b" ".join(part).decode("utf-8", "replace"), add_special_tokens=False)
            ids, ends = np.array(e.ids, "<u4"), np.flatnonzero(np.diff(np.array(e.word_ids), append=-1)) + 1
            if len(ends) == len(part):
                for c, a, b in zip(part, [0, *ends], ends):
                    self._keep(c, ids[a:b].tobytes())
        rest = [c for c in chunks if c not in self]
        for c, ids in zip(rest, self.encoded(rest)):
            self._keep(c, ids)


def tokens(path: str, remembered: int, keep: bool = True) -> Tokens:
    """The worker's own, kept from task to task, or the task's own, which is gone with it."""
    if not keep:
        KEPT.clear()
        return Tokens(path, remembered)
    if (path, remembered) not in KEPT:
        KEPT.clear()
        KEPT[path, remembered] = Tokens(path, remembered)
    return KEPT[path, remembered]


def cuts(n: int, capacity: int, tail: int) -> Iterator[int]:
    """Lengths of a document's pieces: whole sequences, then powers of two, then what is left, under 2 * ``tail``.

    A class of a power of two has no padding at all; the remainder's class has less than 1 / (count + 1)."""
    yield from [capacity] * (n // capacity)
    n %= capacity
    last = n if n < tail else n % tail + tail if n % tail else 0
    n -= last
    size = capacity
    while n:
        size //= 2
        if n >= size:
            yield size
            n -= size
    if last:
        yield last


def _pack(path: str, capacity: int, tail: int, remembered: int, keep: bool):
    def packed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_, out, made = tokens(path, remembered, keep), defaultdict(list), [], [0]
        first = TaskContext.get().partitionId() << 36

        def close(pieces) -> None:
            offset = 0
            for doc, start, n, crc, total in pieces:
                out.append((doc, start, n, crc, total, first + made[0], offset))
                offset += n
            made[0] += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = known.of(text.as_py() or b"") + END
                at, total = 0, len(ids) // 4
                for n in cuts(total, capacity, tail):
                    waiting = open_[n if n >= tail * 2 else -(capacity // n)]
                    waiting.append((doc, at, n, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)]), total))
                    if len(waiting) == capacity // n:
                        close(waiting)
                        waiting.clear()
                    at += n
                if len(out) >= 20_000:
                    yield flush()
        bin_, used = [], 0  # the task's unfilled bins share the last sequences
        for piece in sorted((p for waiting in open_.values() for p in waiting), key=lambda p: -p[2]):
            if used + piece[2] > capacity:
                close(bin_)
                bin_, used = [], 0
            bin_.append(piece)
            used += piece[2]
        if bin_:
            close(bin_)
        yield flush()

    return packed_pieces


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, tail: int = 64, id: str = "doc_id", text: str = "text", remembered: int = REMEMBERED, keep: bool = True) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), all long.

    A document is its text's ids and an end id, 1. Pieces of length n lie ``capacity // n`` to a sequence, in bins of
    their own class, which each task fills alone: nothing is shuffled or sorted, and a task holds the unfilled bins
    (some 11,000 short pieces at most) and one batch of texts. Sequence ids are made of the partition and a counter,
    so a task that runs again gives the same ids; ``docs`` should be a table that is read, as its rows then have an
    order. Null texts are empty: one id. Repeated rows are packed once each. Other columns are left out.
    ``tokenizer``: the file of a public tokenizer, at the same path on all machines; a worker remembers some
    ``remembered`` bytes of ids by chunk of text, or none, with a file whose rules for cutting aren't known (see ``loaded``).
    Without ``keep`` it forgets them after each task, so that later stages find the memory free."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, capacity, tail, remembered, keep), ", ".join(f"{n} long" for n in NAMES))
