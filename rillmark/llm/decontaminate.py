"""Benchmark decontamination with an FM-index over each shard of training text.

A shard is up to SHARD_BYTES of consecutive texts in one task.  Its words become symbols of
the benchmark's vocabulary; runs of known words that are at least as long as the
shortest test phrase are indexed (a phrase cannot occur elsewhere): suffix order,
Burrows-Wheeler transform, wavelet matrix with rank directories, sampled suffix
positions.  All phrases search backwards together, occurrences are located by
walking to a sampled position, confirmed word by word, and merged to removal spans.

The documents are never shuffled.  The benchmark is the stated query set: it reaches
the executors in blocks of BLOCK_BYTES, each small enough to broadcast, and every
shard is searched for every block.  Of several blocks a worker holds one at a time and reads the
next from its executor's disk, so memory doesn't grow with the benchmark.

Defined results: a null or wordless text has no words and no hits; items with a null id
or text, or without words, are skipped; an item_id that repeats counts once; every
row gives a row, repeated ids too; empty tables work on either side; other columns
of either table are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm import words as W

WINDOW = 10
SHARD_BYTES, BLOCK_BYTES = 16 << 20, 8 << 20
SAMPLE = 8
#: Left in place of a removed span, so that what stood around it does not form a phrase.
MARK = "…"


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before i."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class Wavelet:
    """A wavelet matrix: ranks and access of a sequence of small integers."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        for k in range(self.depth - 1, -1, -1):
            bit = (seq >> k) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before i."""
        low = np.zeros_like(i)
        for k, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros, strict=True):
            one = (c >> k) & 1 == 1
            a, b = bits.ones(low), bits.ones(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and its occurrences before i."""
        c, low = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(i)
            a, b = bits.ones(low), bits.ones(i)
            low, i = np.where(one == 1, zeros + a, low - a), np.where(one == 1, zeros + b, i - b)
            c = c * 2 + one
        return c, i - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; each 0 ends a run and sorts by its place, so nothing is compared beyond it."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = np.where(ends, rank, rank) * np.int64(n + int(text.max()) + 2) + np.where(ends, 0, after)
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n // 2 + 1:
            return order
        step *= 2


class FMIndex:
    """Of a text of symbols 1..symbols-1 in runs, each ended by a 0."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        self.n = len(text)
        order = suffix_order(text)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.bwt = Wavelet(text[order - 1].astype(np.int64), symbols)
        first = np.zeros(self.n, bool)  # the start of a run is sampled, so a walk never leaves its run
        first[0] = True
        first[1:] = text[:-1] == 0
        sampled = first[order] | (order % SAMPLE == 0)
        self.sampled, self.samples = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase (rows of symbols of one length)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            low[live] = self.less[c] + self.bwt.rank(c, low[live])
            high[live] = self.less[c] + self.bwt.rank(c, high[live])
            empty = low >= high
            high[empty] = low[empty]
            live = live[~empty[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, steps = np.empty(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            at = self.sampled.get(rows) == 1
            out[live[at]] = self.samples[self.sampled.ones(rows[at])] + steps
            live, rows = live[~at], rows[~at]
            if len(live):
                c, before = self.bwt.access(rows)
                rows, steps = self.less[c] + before, steps + 1
        return out


@dataclass
class Phrases:
    """A block of the benchmark: distinct phrases of each length, and the items that have them."""

    vocabulary: list[bytes] = field(default_factory=list)
    items: list[str] = field(default_factory=list)
    by_length: dict[int, list[tuple[np.ndarray, list[list[int]]]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[str, str]], window: int) -> Phrases:
        ids: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        items = sorted({i for i, _ in rows})
        number = {x: k for k, x in enumerate(items)}
        for item, text in rows:
            for _, _, w in W.of_column(pa.array([text]), W.ALNUM):
                seq = [ids.setdefault(w.word(x), len(ids) + 1) for x in range(len(w.hash))]
                size = min(window, len(seq))
                for x in range(len(seq) - size + 1 if size else 0):
                    found[size][tuple(seq[x : x + size])].add(number[item])
        return cls(list(ids), items, {n: (np.array(list(p), np.int64), [sorted(x) for x in p.values()]) for n, p in found.items()})

    def prepare(self) -> None:
        """Sorted hashes of the vocabulary, made once in each worker."""
        if not hasattr(self, "hashes"):
            h = W.words(np.frombuffer(b" ".join(self.vocabulary), np.uint8), np.array([0, sum(map(len, self.vocabulary)) + len(self.vocabulary) - 1])).hash
            self.order = np.argsort(h)
            self.hashes = h[self.order]
            self.maybe = np.zeros(1 << 20, bool)
            self.maybe[(h & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.shortest = min(self.by_length)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        on = self.hashes[k] == h[at]
        out[at[on]] = self.order[k[on]] + 1
        return out


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], on.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _occurrences(parts: list[W.Words], phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[list[int]]]]:
    """(phrase, first word, length, items of the phrases): words are numbered through the parts."""
    phrases.prepare()
    pieces, places, base = [], [], 0
    for w in parts:
        s = phrases.symbols(w.hash)
        # A 0 after each text keeps phrases within it; a run of known words is what stands between zeros.
        at = np.arange(len(s)) + w.doc()
        wide = np.zeros(len(s) + len(w.counts), np.int32)
        wide[at] = s
        back = np.zeros(len(wide), np.int64)
        back[at] = np.arange(len(s)) + base
        a, b = _runs(wide > 0)
        long = b - a >= phrases.shortest
        keep = np.zeros(len(wide) + 1, np.int8)
        np.add.at(keep, a[long], 1)
        np.add.at(keep, np.minimum(b[long] + 1, len(wide)), -1)  # with the 0 that ends it
        keep = np.cumsum(keep[:-1]) > 0
        pieces.append(wide[keep])
        places.append(back[keep])
        base += len(s)
    text, place = np.concatenate(pieces), np.concatenate(places)
    if not len(text):
        return
    if text[-1]:
        text, place = np.append(text, 0), np.append(place, 0)
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    for length, (rows, items) in phrases.by_length.items():
        low, high = index.search(rows)
        n = high - low
        which = np.repeat(np.arange(len(rows)), n)
        spots = index.locate(np.repeat(low, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
        yield which, place[spots], length, items


def _each(blocks: list) -> Iterator[Phrases]:
    """The values of broadcasts; of several, one is held at a time."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1 and getattr(b, "_path", None):
            b.__dict__.pop("_value", None)


def scan(column: pa.Array, blocks: list) -> Iterator[tuple[int, int, list[dict]]]:
    """For ranges of texts: n_words, the hit words' spans (bytes and code points), n_hit, items."""
    raw, at = W.buffers(column)
    for i, j in W.chunks(at, SHARD_BYTES):
        parts = [W.words(raw[at[a + i] : at[b + i]], at[a + i : b + i + 1] - at[a + i], W.ALNUM) for a, b in W.chunks(at[i : j + 1])]
        total = sum(len(w.hash) for w in parts)
        first = np.concatenate([[0], *(w.first[1:] + k for w, k in zip(parts, np.cumsum([0, *(len(w.hash) for w in parts)]), strict=False))]).astype(np.int64)
        hit, items = np.zeros(total + 1, np.int64), defaultdict(set)
        heads = np.cumsum([0, *(len(w.hash) for w in parts)])

        def word(x: int, heads=heads, parts=parts) -> bytes:
            p = int(np.searchsorted(heads, x, "right")) - 1
            return parts[p].word(int(x - heads[p]))

        for phrases in _each(blocks):
            if not phrases.by_length or not total:
                continue
            for which, start, length, owners in _occurrences(parts, phrases):
                if not len(which):
                    continue
                rows = phrases.by_length[length][0]
                spots, at_first = np.unique((start[:, None] + np.arange(length)).ravel(), return_index=True)
                named = rows[which].ravel()[at_first]
                wrong = [x for x, s in zip(spots.tolist(), named.tolist(), strict=True) if word(x) != phrases.vocabulary[s - 1]]
                if wrong:  # two words of one hash
                    fine = ~np.isin(start[:, None] + np.arange(length), wrong).any(1)
                    which, start = which[fine], start[fine]
                np.add.at(hit, start, 1)
                np.add.at(hit, start + length, -1)
                docs = np.searchsorted(first, start, "right") - 1
                for d, p in set(zip(docs.tolist(), which.tolist(), strict=True)):
                    items[d].update(phrases.items[x] for x in owners[p])
        hits = np.cumsum(hit[:-1]) > 0
        sums = np.concatenate(([0], np.cumsum(hits)))
        out = [{"n_words": int(b - a), "n_hit": int(sums[b] - sums[a]), "items": [], "bytes": [], "spans": []} for a, b in zip(first, first[1:], strict=False)]
        starts, ends = np.concatenate([w.start + o for w, o in zip(parts, _offsets(parts), strict=True)]), np.concatenate([w.end + o for w, o in zip(parts, _offsets(parts), strict=True)])
        for d in [k for k, x in enumerate(out) if x["n_hit"]]:
            a, b = _runs(hits[first[d] : first[d + 1]])
            origin = at[i + d] - at[i]
            spans = np.stack((starts[first[d] + a] - origin, ends[first[d] + b - 1] - origin), 1)
            chars = np.concatenate(([0], np.cumsum((raw[at[i + d] : at[i + d + 1]] & 0xC0) != 0x80)))
            out[d] |= {"items": sorted(items[d]), "bytes": spans.tolist(), "spans": chars[spans].tolist()}
        yield i, j, out


def _offsets(parts: list[W.Words]) -> list[int]:
    return [0, *np.cumsum([len(w.raw) for w in parts]).tolist()][: len(parts)]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list:
    """Broadcasts of the benchmark, a block at a time; the driver holds one block."""
    sc, held, size, out = benchmark.sparkSession.sparkContext, [], 0, []
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), text_col)
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += len(text)
        if size >= BLOCK_BYTES:
            out.append(sc.broadcast(Phrases.of(held, window)))
            held, size = [], 0
    return [*out, sc.broadcast(Phrases.of(held, window))]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for each row: items that occur, and the spans to remove in code points, end exclusive."""
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found in scan(batch.column(1), blocks):
                cols = [pa.array([x[c] for x in found], schema.field(c).type) for c in schema.names[1:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<long>>")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` with each removal span replaced by MARK; all other columns, and clean texts, are as they were."""
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found in scan(batch.column(at), blocks):
                part = batch.slice(i, j - i)
                if any(x["n_hit"] for x in found):
                    texts = part.column(at).to_pylist()
                    for k, x in enumerate(found):
                        if x["n_hit"]:
                            raw, kept, end = texts[k].encode(), [], 0
                            for a, b in x["bytes"]:
                                kept += [raw[end:a], MARK.encode()]
                                end = b
                            texts[k] = b"".join([*kept, raw[end:]]).decode()
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
