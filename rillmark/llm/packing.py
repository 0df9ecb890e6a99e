"""Best-fit packing of tokenised documents into sequences.

Bounded-space online best-fit: each task keeps at most OPEN_BINS open sequences in a
bitset keyed by free space.  A piece goes into the open sequence that it leaves fullest;
if none has room, a new one opens, for which the fullest open one closes when all are
in use.  A placed piece is emitted at once, so memory doesn't depend on the input, and
nothing is shuffled: sequences belong to the task that filled them.  So a task may leave up to
OPEN_BINS sequences with room; that loss grows with the number of tasks, not of documents.

Defined results: a null text is empty, and an empty document is its end token alone;
repeated ids are separate documents (rows); an empty table gives an empty table; the
other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, OPEN_BINS, END_ID = 2048, 1024, 0
CACHED_WORDS, CHUNK_CHARS = 400_000, 1 << 20
#: White space other than the plain space, as either library counts it.
_OTHER_SPACE = [c for c in map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _plain(t: str) -> bool:
    """Whether each space of a text stands alone between two other characters."""
    return not (t[:1] == " " or t[-1:] == " " or "  " in t or any(c in t and (f"{c} " in t or f" {c}" in t) for c in _OTHER_SPACE))


class Encoder:
    """Token ids of texts by a byte-level BPE vocabulary.

    ranks_path: the vocabulary's tokens in rank order, base64, which give the same ids as
    the tokenizers library gives with the JSON file of that vocabulary (the tests compare
    them).  added: the strings of that file's added tokens with their ids; a text is cut at
    them, the first and then the longest that matches.  The vocabulary's pattern
    never joins a single space between two other characters to what precedes it, so a
    text's ids are those of its space-led words, one after the other.  Ids of recent
    words are kept; each other word is encoded once.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = added or {}
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})") if self.added else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each has."""
        if self.cut is None or not any(a in t for a in self.added for t in texts):
            return self._plainly(texts)
        parts = [[p for p in self.cut.split(t) if p] for t in texts]
        own = [p for row in parts for p in row]
        flat, counts = self._plainly([p for p in own if p not in self.added])
        pieces, at, sizes, k = [], np.concatenate(([0], np.cumsum(counts))), [], 0
        for p in own:
            if p in self.added:
                pieces.append(np.array([self.added[p]], np.uint32))
            else:
                pieces.append(flat[at[k] : at[k + 1]])
                k += 1
            sizes.append(len(pieces[-1]))
        last = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, parts)])]
        return np.concatenate(pieces), np.diff(last)

    def _plainly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode, for texts without added tokens."""
        if len(self.known) > CACHED_WORDS:
            self.forget()
        words: list[str] = []
        counts = []
        for t in texts:
            parts = t.split(" ") if _plain(t) else _SAFE_SPACE.split(t)
            # The first word has no space before it; a lone surrogate, which no text holds, tells the two kinds apart.
            parts[0] = "\ud800" + parts[0]
            counts.append(len(parts))
            words += parts
        new = set(words).difference(self.known)
        if new:
            new = sorted(new)
            self._learn([w[1:] if w[:1] == "\ud800" else " " + w for w in new])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        k = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        first, size = self.at[k], self.at[k + 1] - self.at[k]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.concatenate(([0], ends))[np.cumsum(counts)] if counts else np.zeros(0, np.int64)
        return flat, np.diff(np.concatenate(([0], last)))

    def _learn(self, names: list[str]) -> None:
        """Stores the ids of texts that are not known yet, in order."""
        n, found = len(self.known), list(map(self.bpe.encode_ordinary, names))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        total, m = int(lengths.sum()), int(self.at[n])
        while m + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + len(found) + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.ids[m : m + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.at[n + 1 : n + 1 + len(found)] = m + np.cumsum(lengths)


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...]) -> Encoder:
    return Encoder(ranks_path, pattern, dict(added))


def added_tokens(json_path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens of a tokenizers file, which encode() of that library finds in any text."""
    with open(json_path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    odd = [x["content"] for x in found if x["single_word"] or x["lstrip"] or x["rstrip"]]
    if odd:
        raise ValueError(f"added tokens that take in what stands beside them are not known: {odd}")
    return tuple((x["content"], x["id"]) for x in found)


class Packer:
    """Open sequences by free space."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS, first: int = 0) -> None:
        self.length, self.most, self.next = length, open_bins, first
        self.mask, self.open = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        self.open -= 1
        return out

    def place(self, size: int) -> tuple[int, int]:
        """The sequence and the offset in it."""
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            name = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            name, free = self.next, self.length
            self.next += 1
        left = free - size
        if left:
            self.by_free[left].append(name)
            self.mask |= 1 << left
            self.open += 1
        return name, self.length - free


def piece_lengths(n: int, length: int = LENGTH) -> list[int]:
    """A document of n ids is one piece, or full pieces after a first that may be shorter."""
    if n <= length:
        return [n]
    return [n % length] * (n % length > 0) + [length] * (n // length)


def packed(docs: DataFrame, ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = (), id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with `with_ids` its ids.

    ranks_path, pattern, added: a vocabulary file that every executor has, its word pattern and its added tokens.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, open_bins, TaskContext.get().partitionId() << 40)
        enc = encoder(ranks_path, pattern, added)
        for batch in batches:
            i = 0
            while i < batch.num_rows:
                texts, size, j = [], 0, i
                while j < batch.num_rows and size < CHUNK_CHARS and len(texts) < 1024:
                    texts.append(batch.column(1)[j].as_py() or "")
                    size, j = size + len(texts[-1]), j + 1
                names = batch.column(0).slice(i, j - i).to_pylist()
                flat, counts = enc.encode(texts)
                cols: list[list] = [[] for _ in schema]
                at = 0
                for name, n in zip(names, counts.tolist(), strict=True):
                    ids, start = np.append(flat[at : at + n], np.uint32(END_ID)).astype("<u4"), 0
                    at += n
                    for k, m in enumerate(piece_lengths(n + 1, length)):
                        own = ids[start : start + m]
                        row = (name, k, start, m, crc32(own), *packer.place(m)) + ((own.astype(np.int32),) if with_ids else ())
                        for c, x in zip(cols, row, strict=True):
                            c.append(x)
                        start += m
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                i = j

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, kinds)
