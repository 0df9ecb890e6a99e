"""Language-model scores: a probabilistic suffix tree over the bytes of a text's words.

A text is its lower-cased words, a space after each, then an end symbol.  Counts of
all DEPTH + 1 byte sequences of the training texts give, for each context of up to
DEPTH bytes, what follows it.  A context is a state of the tree if its divergence from its
suffix's distribution is at least BITS bits over all its occurrences (or a longer state needs it), however large
or small the corpus, so the number of states grows with the texts.
DEPTH is what a 64-bit number holds beside the symbol.
A state's distribution is smoothed with its suffix's; a symbol
is scored by the longest suffix of its history that is a state.

A sequence is a number with the latest byte of the context first, so all contexts that end in the
same three bytes are one range: each task makes the whole subtree of its ranges (`subtree`), and
contexts of up to three bytes are made from the distinct four-byte sequences, by their last byte.
Sequences travel packed by range.  Those of more than FAN tasks are first added up FAN tasks at a time, so no
range brings the counts of all tasks to one.

Neither word counts nor states have a bound, so neither is broadcast.  Neighbours of a task are a group of about
GROUP_BYTES; each group asks, bucket by bucket, for its distinct words and contexts once, and is
scored with the answers.  Of the states, only a bit array of fixed size is sent to every task: it saves
asking for most contexts that are no states, and says nothing false of those that are.  Texts are read
three times and must come in the same tasks and order each time, as files do; a group that differs is an error.

Defined results: a null or wordless text is its end token alone; rows with a null id
are training rows; repeated ids are separate rows; an empty table gives an empty table;
without training tokens nothing is known and every symbol is equally likely; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm import words as W
from rillmark.llm.cluster import Scratch, held_out

DEPTH, BITS, SMOOTH = 7, 16.0, 4.0
#: No context is asked for fewer bits in a small corpus.  Nothing here reads these; the rule that the tests spell out names them.
SURE, GAIN = 0, 0.0
GROUP_BYTES, RANGE_BYTES = 8 << 20, 4 << 20
#: Last bytes of a context that name its range; sequences that a task holds before it sends them; tasks added up at a time.
NEAR, HELD, FAN = 3, 8 << 20, 64
#: Bits of the array of states, as a power of two; bytes of text that arrays, and rows that travel, are made of.
MARKS, CHUNK, RUN_BYTES = 25, 1 << 19, 1 << 20
#: Contexts that end in the same so many bytes are in one bucket, so that names in it share most of their bytes.
KIN = 5
#: Most places of a table of pairs of pairs of bytes.
PAIRS = 1 << 24
_BYTE, _PAIR = np.uint64(255), np.uint64(0xFFFF)
#: Lower-cased bytes, and a space for each that words have none of.
_LOWER = bytes(np.where(W.NON_SPACE, W.LOWER, 0x20).astype(np.uint8))


def top(d: int) -> np.uint64:
    """The bits of a sequence's latest d context bytes."""
    return np.uint64((1 << 64) - (1 << 64 - 8 * d))


def symbols(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols, one after the other, and where each text's begin."""
    doc, length = w.doc(), w.end - w.start
    first = np.concatenate(([0], np.cumsum(np.bincount(doc, length + 1, minlength=len(w.counts)).astype(np.int64) + 1)))
    letter = np.ones(int(first[-1]), bool)
    # Before a word's space stand one for each earlier word and an end for each earlier text.
    letter[np.cumsum(length) + np.arange(len(length)) + doc] = False
    letter[first[1:] - 1] = False
    out = np.full(len(letter), 0x20, np.uint8)
    out[first[1:] - 1] = 0
    low = np.frombuffer(w.raw.tobytes().translate(_LOWER), np.uint8)
    out[letter] = low[low != 0x20]
    return out, first


def grams(out: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each symbol a number: the DEPTH before it in its text, the latest first, then it; zeros before the start."""
    # A number is eight bytes in memory, turned by one; at the start of a text it has bytes of the one before, which are cleared.
    wide = np.concatenate((np.zeros(DEPTH, np.uint8), out))
    code = np.ndarray(len(out), "<u8", wide.data, 0, (1,)).copy()
    code = code << np.uint64(8) | code >> np.uint64(56)
    for k in range(DEPTH):
        code[first[:-1][np.diff(first) > k] + k] &= top(k) | _BYTE
    return code


def _heads(code: np.ndarray) -> np.ndarray:
    """Where another number begins."""
    return np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)


def distinct(code: np.ndarray) -> np.ndarray:
    """Distinct numbers, sorted."""
    code = np.sort(code)
    return code[np.concatenate(([True], code[1:] != code[:-1]))] if len(code) else code


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, sorted, and how often each is there; the array itself is sorted."""
    code.sort()
    head = _heads(code)
    return code[head], np.diff(np.concatenate((head, [len(code)])))


def turn_of(hashes: np.ndarray) -> np.ndarray:
    """What sorts numbers that their highest bits tell apart: these are sorted with the places in the lowest, as numbers sort faster than places do."""
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    key = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)
    key.sort()
    order = (key & low).astype(np.int64)
    own = hashes[order]
    return order if (own[1:] >= own[:-1]).all() else np.argsort(hashes)


def summed(code: np.ndarray, n: np.ndarray, turn: Callable[[np.ndarray], np.ndarray] = np.argsort) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, sorted, and the sums of their counts."""
    if not len(code):
        return code, n
    order = turn(code)
    code = code[order]
    head = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[head], np.add.reduceat(n[order], head)


def shortened(code: np.ndarray, n: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of sequences with d bytes of context."""
    return summed(code & top(d) | code & _BYTE, n)


def _inverse(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the place of each one's hash among them."""
    order = turn_of(hashes)
    own = hashes[order]
    new = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
    at = np.empty(len(own), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return own[new], at


def _index(value: np.ndarray) -> np.ndarray:
    """Small numbers as places of a table: numpy looks up by these two to four times as fast as by others."""
    return value.view(np.int64)


def _ranks(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that were seen, and each one's rank."""
    value, rank = np.flatnonzero(seen), np.zeros(len(seen), np.int32)
    rank[value] = np.arange(len(value), dtype=np.int32)
    return value, rank


def sequences(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct sequences of symbols and where texts begin, sorted, how often each is there, and their places among all, sequence by sequence.

    Halves of a sequence are told by ranks, so that both and the place are one number to sort.  Where that has too few
    bits, or tables of pairs are too large, places are sorted by sequence."""
    begin = np.concatenate(([0], np.cumsum([len(out) for out, _ in parts]))).astype(np.int64)
    # Of a sequence's four pairs of bytes the second and third stood first before, or are zeros as the first of a text.
    near, last = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    for out, first in parts:
        code = grams(out, first)
        near[_index(code >> np.uint64(48))] = True
        last[_index(code & _PAIR)] = True
    (nears, near), (lasts, last) = _ranks(near), _ranks(last)
    a, b, key = len(nears), len(lasts), np.zeros(0, np.uint64)
    bits = int(begin[-1]).bit_length()
    if parts and a * max(a, b) <= PAIRS:
        key, seen = np.empty(begin[-1], np.uint64), (np.zeros(a * a, bool), np.zeros(a * b, bool))
        for (out, first), i, j in zip(parts, begin[:-1], begin[1:], strict=True):
            code = grams(out, first)
            r = np.concatenate((np.zeros(4, np.int64), near[_index(code >> np.uint64(48))]))
            second, third = r[2:-2].copy(), r[:-4].copy()
            for k in range(4):
                at = first[:-1][np.diff(first) > k] + k
                third[at] = 0
                if k < 2:
                    second[at] = 0
            own = r[4:] * a + second, third * b + last[_index(code & _PAIR)]
            for x, y in zip(seen, own, strict=True):
                x[y] = True
            key[i:j] = own[0].view(np.uint64) << np.uint64(32) | own[1].view(np.uint64)
        (high, rank), (low, ranks) = map(_ranks, seen)
        del seen
        lows = len(low).bit_length()
        if len(high).bit_length() + lows + bits <= 64:
            for i, j in zip(begin[:-1], begin[1:], strict=True):
                x = key[i:j]
                two = rank[_index(x >> np.uint64(32))].astype(np.uint64) << np.uint64(lows) | ranks[_index(x & np.uint64((1 << 32) - 1))].astype(np.uint64)
                key[i:j] = two << np.uint64(bits) | np.arange(i, j, dtype=np.uint64)
            del rank, ranks
            key.sort()
            place = (key & np.uint64((1 << bits) - 1)).astype(np.int32 if bits < 32 else np.int64)
            key >>= np.uint64(bits)
            head = _heads(key)
            own = _index(key[head])
            one, two = ((nears[x // m] << 16 | y[x % m]).astype(np.uint64) for x, y, m in ((high, nears, a), (low, lasts, b)))
            return one[own >> lows] << np.uint64(32) | two[own & (1 << lows) - 1], np.diff(np.append(head, len(key))).astype(np.int32 if bits < 32 else np.int64), place
    del key
    code = np.concatenate([np.zeros(0, np.uint64), *(grams(*x) for x in parts)])
    place = np.argsort(code)
    code = code[place]
    head = _heads(code)
    return code[head], np.diff(np.append(head, len(code))), place


@dataclass
class Level:
    """All contexts of one length: their sequences, sorted, with counts."""

    code: np.ndarray
    n: np.ndarray
    d: int

    def __post_init__(self) -> None:
        context = self.code & top(self.d) if self.d else np.zeros_like(self.code)
        self.head = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
        self.contexts = context[self.head]
        self.size = np.diff(np.concatenate((self.head, [len(context)])))
        self.all = np.add.reduceat(self.n, self.head) if len(context) else self.n
        self.row = np.repeat(np.arange(len(self.head)), self.size)

    def gain(self, up: Level) -> np.ndarray:
        """Bits that each context's symbols take less by its own distribution than by its suffix's."""
        k = np.searchsorted(up.code, (self.code & top(up.d) if up.d else np.uint64(0)) | self.code & _BYTE)
        return np.bincount(self.row, self.n * np.log2(self.n / self.all[self.row] * (up.all[up.row[k]] / up.n[k])), minlength=len(self.contexts))

    def suffixes(self, chosen: np.ndarray) -> np.ndarray:
        return distinct(self.contexts[chosen] & top(self.d - 1))


def subtree(levels: dict[int, Level], needed: np.ndarray) -> Iterator[tuple[Level, np.ndarray]]:
    """From the deepest level to the second: each with its states.  needed: contexts of the deepest that longer states need."""
    for d in sorted(levels, reverse=True)[:-1]:
        own = levels[d]
        chosen = own.gain(levels[d - 1]) >= BITS
        chosen[np.searchsorted(own.contexts, needed)] = True
        yield own, chosen
        needed = own.suffixes(chosen)


_STATES = "id long, depth int, slot int, needed boolean, symbols binary, counts binary"


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _shares(n: np.ndarray, size: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Counts as numbers of `size` bytes: where each comes from, and its value; only a count beyond that takes more than one."""
    full = (1 << 8 * size) - 1
    times = n // full + 1
    at = np.repeat(np.arange(len(n)), times)
    value = np.full(len(at), full)
    value[np.cumsum(times) - 1] = n - full * (times - 1)
    return at, value.astype(f"<u{size}")


def _rows(level: Level, chosen: np.ndarray, needed: np.ndarray | None = None, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """States as rows; a state is named by its context and its length."""
    for k in range(0, len(level.contexts), most):
        on = np.flatnonzero(chosen[k : k + most]) + k
        end = min(k + most, len(level.contexts))
        a, b = level.head[k], level.head[end] if end < len(level.head) else len(level.code)
        edge = np.flatnonzero(chosen[level.row[a:b]]) + a
        source, counts = _shares(level.n[edge])
        at = np.searchsorted(edge[source], np.append(level.head[on], len(level.code)))
        name = level.contexts[on] | np.uint64(level.d)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(name.view(np.int64)),
                pa.array(np.full(len(on), level.d, np.int32)),
                pa.array(_slot(name)),
                pa.array(np.zeros(len(on), bool) if needed is None else np.isin(level.contexts[on], needed)),
                _binary(at, (level.code[edge[source]] & _BYTE).astype(np.uint8)),
                _binary(at * 4, counts),
            ],
            names=["id", "depth", "slot", "needed", "symbols", "counts"],
        )


def _level(t: pa.RecordBatch | pa.Table, d: int) -> Level:
    """The level of rows of states of one depth, in the order of their names."""
    name = t["id"].to_numpy().view(np.uint64)
    order = np.argsort(name)
    own, n = t["symbols"].to_pylist(), t["counts"].to_pylist()
    size = np.array([len(own[k]) for k in order], np.int64)
    flat, counts = (np.frombuffer(b"".join(x[k] for k in order), kind) for x, kind in ((own, np.uint8), (n, "<u4")))
    return Level(*summed(np.repeat(name[order] & top(d), size) | flat, counts.astype(np.int64)), d)


def _planes(rows: np.ndarray) -> np.ndarray:
    """Columns one after the other; numpy's own copies of transposed bytes take several times as long."""
    out = np.empty(rows.shape[::-1], np.uint8)
    for k in range(len(out)):
        out[k] = rows[:, k]
    return out


def _small(value: np.ndarray | bytes) -> bytes:
    """Bytes compressed, after their number."""
    raw = value if isinstance(value, bytes) else value.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _whole(raw: bytes) -> bytes:
    n = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], n, "zstd", asbytes=True) if n else b""


def _less(value: np.ndarray) -> bytes:
    """Numbers compressed, by planes of their bytes: as many as the largest has."""
    width = max(1, int(value.max(initial=0)).bit_length() + 7 >> 3)
    return bytes([width]) + _small(_planes(value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]))


def _more(raw: bytes) -> np.ndarray:
    own = np.frombuffer(_whole(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    out[:, : raw[0]] = own.T
    return out.view("<u8").ravel()


def shortened_names(name: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each name its length and how many bytes are those of the name before it (none at a head); the other bytes, and how many."""
    size, context = (name & _BYTE).astype(np.int64), name & top(DEPTH)
    other = np.empty_like(name)
    other[1:] = context[1:] ^ context[:-1]
    same = np.minimum(sum((other >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, DEPTH + 1)), size)
    same[head] = 0
    place = np.arange(8)
    return (same << 3 | size).astype(np.uint8), name.astype(">u8").view(np.uint8).reshape(-1, 8)[(place >= same[:, None]) & (place < size[:, None])], size - same


def whole_names(kinds: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What shortened_names() was made of; runs of names that begin with a head may stand one after the other."""
    same, size = kinds >> 3, kinds & 7
    out, row = np.zeros((len(kinds), 8), np.uint8), np.arange(len(kinds), dtype=np.int32)
    place = np.arange(8)
    out[(place >= same[:, None]) & (place < size[:, None])] = rest
    for k in range(DEPTH):
        out[:, k] = out[:, k][np.maximum.accumulate(row * (same <= k))]
    out[:, 7] = size
    return out.view(">u8").ravel().astype(np.uint64)


_SEQUENCES = "range int, part int, size int, planes binary"


def _packed(code: np.ndarray, n: np.ndarray, part: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Sorted sequences and counts, a compressed row for each range that has any; the bytes of a row's sequences and counts stand plane by plane."""
    if int(n.max(initial=0)) < (1 << 16) - 1:
        value = n.astype("<u2")
    else:
        source, value = _shares(n, 2)
        code = code[source]
    near = code >> np.uint64(64 - 8 * NEAR)
    head = _heads(near)
    at, size = (W.mix(near[head]) >> np.uint64(33)) % np.uint64(ranges), np.diff(np.append(head, len(code)))
    order = np.argsort(at, kind="stable")
    turn, first = _gathered(head[order], size[order]), _heads(at[order])
    code, value = code[turn].astype("<u8").view(np.uint8).reshape(-1, 8), value[turn].view(np.uint8).reshape(-1, 2)
    cut = np.append(_begins(size[order])[first], len(code))
    planes = np.concatenate((_planes(code[:, ::-1]), _planes(value[:, ::-1])))  # the highest first
    own = [pa.compress(planes[:, a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(at[order][first].astype(np.int32)), pa.array(np.full(len(first), part, np.int32)), pa.array(np.diff(cut).astype(np.int32)), pa.array(own, pa.binary())], names=["range", "part", "size", "planes"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    size = batch["size"].to_pylist()
    code, n = np.empty((sum(size), 8), np.uint8), np.empty((sum(size), 2), np.uint8)
    begin = 0
    for x, m in zip(batch["planes"], size, strict=True):
        own = np.frombuffer(pa.decompress(x.as_buffer(), 10 * m, "zstd", asbytes=True), np.uint8).reshape(10, m)
        for k in range(8):
            code[begin : begin + m, k] = own[7 - k]
        for k in range(2):
            n[begin : begin + m, k] = own[9 - k]
        begin += m
    return code.view("<u8").ravel(), n.view("<u2").ravel().astype(np.int64)


def states_of(training: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """The states of the training texts (one column, text), a row each, and the root's symbols with counts."""
    total_bytes, tasks = training.select(F.octet_length("text").alias("size"), F.spark_partition_id().alias("part")).agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0)) + 1).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), []
        for batch in batches:
            for _, _, w in W.of_column(batch.column(0), most=CHUNK, hashed=False):
                held.append(grams(*symbols(w)))
                if sum(map(len, held)) >= HELD:
                    code, held = np.concatenate(held), []
                    yield from _packed(*counted(code), part, ranges)
        if held:
            yield from _packed(*counted(np.concatenate(held)), part, ranges)

    def added(t: pa.Table) -> pa.Table:
        code, n = summed(*_unpacked(t.combine_chunks().to_batches()[0]))
        return pa.Table.from_batches(list(_packed(code, n, t["part"][0].as_py(), ranges)))

    ranges = max(1, -(-int(total_bytes) // RANGE_BYTES))
    counts = training.mapInArrow(count, _SEQUENCES)
    while tasks > FAN:
        counts = scratch.keep(counts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("range", "part").applyInArrow(added, _SEQUENCES))
        tasks = -(-tasks // FAN)

    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states of more than NEAR bytes of whole ranges, and all contexts of NEAR bytes."""
        parts = [_unpacked(b) for b in batches if b.num_rows]
        if not parts:
            return
        code, n = map(np.concatenate, zip(*parts, strict=True))
        parts.clear()
        levels = {DEPTH: Level(*summed(code, n), DEPTH)}
        del code, n
        for d in range(DEPTH - 1, NEAR - 1, -1):
            levels[d] = Level(*shortened(levels[d + 1].code, levels[d + 1].n, d), d)
        needed = np.zeros(0, np.uint64)
        for own, chosen in subtree(levels, needed):
            yield from _rows(own, chosen)
            needed = own.suffixes(chosen)
        yield from _rows(levels[NEAR], np.ones(len(levels[NEAR].contexts), bool), needed)

    made = scratch.keep(counts.repartitionById(ranges, "range").mapInArrow(deep, _STATES))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for batch in batches:
            own, value = (np.frombuffer(b"".join(batch.column(k).to_pylist()), kind) for k, kind in enumerate((np.uint8, "<u4")))
            np.add.at(n, own, value.astype(np.int64))
        yield pa.RecordBatch.from_pydict({"symbol": pa.array(np.flatnonzero(n), pa.int32()), "n": pa.array(n[n > 0], pa.int64())})

    # Each symbol follows one context of NEAR bytes.
    found = made.where(F.col("depth") == NEAR).select("symbols", "counts").mapInArrow(occurrences, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).orderBy("symbol").toArrow()
    root = Level(found["symbol"].to_numpy().astype(np.uint64), found["n"].to_numpy().astype(np.int64), 0)

    def shallow(t: pa.Table) -> pa.Table:
        """The states of up to NEAR bytes that end in one byte."""
        levels = {NEAR: _level(t, NEAR)}
        for d in range(NEAR - 1, 0, -1):
            levels[d] = Level(*shortened(levels[d + 1].code, levels[d + 1].n, d), d)
        levels[0] = root
        needed = np.sort(t.filter(t["needed"])["id"].to_numpy().view(np.uint64) & top(NEAR))
        return pa.Table.from_batches([b for own, chosen in subtree(levels, needed) for b in _rows(own, chosen)])

    last = F.shiftrightunsigned("id", 56)
    near = scratch.keep(made.where(F.col("depth") == NEAR).groupBy(last).applyInArrow(shallow, _STATES))
    return made.where(F.col("depth") > NEAR).union(near), (root.code, root.n)


def _found(known: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is among known ones, which are sorted, and its place there."""
    if not len(known):
        return np.zeros(len(value), bool), np.zeros(len(value), np.int64)
    k = np.minimum(np.searchsorted(known, value), len(known) - 1)
    return known[k] == value, k


@dataclass
class Tree:
    """States by depth: sorted contexts, and their symbols' probabilities."""

    contexts: list[np.ndarray]
    escape: list[np.ndarray]  # log10 of what a state leaves to its suffix
    edges: list[np.ndarray]  # sequences, sorted
    p: list[np.ndarray]
    logp: list[np.ndarray]  # log10
    root: np.ndarray  # log10 by symbol

    @classmethod
    def of(cls, levels: dict[int, Level], symbol: np.ndarray, count: np.ndarray) -> Tree:
        """levels: by depth, the states; symbol, count: the root's."""
        root = np.full(256, 0.5)
        np.add.at(root, symbol.astype(np.int64), count)
        name, none = np.zeros(0, np.uint64), np.zeros(0)
        tree = cls([name], [none], [name], [none], [none], np.log10(root / root.sum()))
        for d in range(1, DEPTH + 1):
            own = levels.get(d) or Level(name, np.zeros(0, np.int64), d)
            hit, k = _found(tree.edges[d - 1], own.code & top(d - 1) | own.code & _BYTE)
            under = np.empty(len(own.code))
            under[hit] = tree.p[d - 1][k[hit]]
            under[~hit] = 10 ** tree.of_edges(own.code[~hit], d - 1)
            tree.contexts.append(own.contexts)
            tree.escape.append(np.log10(SMOOTH / (own.all + SMOOTH)))
            tree.edges.append(own.code)
            tree.p.append((own.n + SMOOTH * under) / (own.all[own.row] + SMOOTH))
            tree.logp.append(np.log10(tree.p[d]))
        return tree

    def of_edges(self, code: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """log10 probability of each sequence's symbol after its longest suffix state of up to `depth` bytes."""
        out, left = np.zeros(len(code)), np.arange(len(code))
        for d in range(depth, 0, -1):
            if not len(self.contexts[d]) or not len(left):
                continue
            context = code[left] & top(d)
            hit, k = _found(self.edges[d], context | code[left] & _BYTE)
            out[left[hit]] += self.logp[d][k[hit]]
            left, context = left[~hit], context[~hit]
            state, k = _found(self.contexts[d], context)
            out[left[state]] += self.escape[d][k[state]]
        out[left] += self.root[(code[left] & _BYTE).astype(np.int64)]
        return out

    def of_asked(self, code: np.ndarray) -> np.ndarray:
        """As of_edges, of sorted sequences, where states' suffixes are states; quick for those that their states know, as all do that were asked for."""
        out, left, at = self.root[(code & _BYTE).astype(np.int64)], code, np.arange(len(code))
        for d in range(1, DEPTH + 2):
            context = left & top(min(d, DEPTH))
            head = _heads(context)
            state = _found(self.contexts[d], context[head])[0] if d <= DEPTH else np.zeros(len(head), bool)
            on = np.repeat(state, np.diff(np.append(head, len(left))))
            if d > 1:  # those whose longest state is of the length before
                own, ends = left[~on], at[~on]
                hit, k = _found(self.edges[d - 1], own & top(d - 1) | own & _BYTE)
                out[ends[hit]] = self.logp[d - 1][k[hit]]
                out[ends[~hit]] = self.of_edges(own[~hit], d - 1)
            left, at = left[on], at[on]
        return out


def _place(name: np.ndarray) -> np.ndarray:
    """A state's place in the array of states."""
    return W.mix(name) >> np.uint64(64 - MARKS)


def _marks(states: DataFrame) -> np.ndarray:
    """The bit array of the states, as 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(_place(batch.column(0).to_numpy().view(np.uint64)))
            at, first = np.unique(place >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(at) else place
            yield pa.RecordBatch.from_pydict({"at": pa.array(at.view(np.int64)), "bits": pa.array(bits.view(np.int64))})

    found = states.select("id").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << MARKS - 6, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def questions(code: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names of the contexts of distinct sorted sequences that may be states, how many symbols follow each there, and these; a state's suffixes are states."""
    edges = [code]
    for d in range(DEPTH - 1, 0, -1):
        edges.append(distinct(edges[-1] & top(d) | edges[-1] & _BYTE))
    names, sizes, symbols_, states = [], [], [], np.zeros(1, np.uint64)
    for d in range(1, DEPTH + 1):
        edge = edges.pop()
        context = edge & top(d)
        head = _heads(context)
        context, size = context[head], np.diff(np.append(head, len(edge)))
        hit = _found(states, context & top(d - 1))[0]
        own = np.flatnonzero(hit)
        place = _place(context[own] | np.uint64(d))
        hit[own] = (marks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        states = context[hit]
        names.append(states | np.uint64(d))
        sizes.append(size[hit])
        symbols_.append((edge[np.repeat(hit, size)] & _BYTE).astype(np.uint8))
    return np.concatenate(names), np.concatenate(sizes), np.concatenate(symbols_)


def _gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _slot(name: np.ndarray) -> np.ndarray:
    """A context's slot, by its last KIN bytes; its bucket is what the number of buckets leaves of it."""
    return (W.mix(np.where((name & _BYTE) > KIN, name & top(KIN) | np.uint64(KIN), name)) >> np.uint64(33)).astype(np.int32)


def _range(word: np.ndarray, buckets: int) -> np.ndarray:
    """A word's bucket: ranges of hashes, so that words stand by bucket in the order of their hashes."""
    return ((word >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _groups(column: pa.Array, begin: int) -> list[tuple[int, int, int]]:
    """(group, first row, last row + 1): a row is in the group of its first byte, of all its task's texts; `begin` came before."""
    _, at = W.buffers(column)
    g = (begin + at[:-1]) // GROUP_BYTES
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else []
    return [(int(g[a]), int(a), int(b)) for a, b in zip(head, [*head[1:], len(g)], strict=False)]


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _begins(size: np.ndarray | list[int]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(size, np.int64))))


def _asking(g: int, held: tuple[list, list, list], buckets: int, marks: np.ndarray) -> pa.RecordBatch:
    words, n = summed(np.concatenate(held[0]), np.concatenate(held[1]).astype(np.int64), turn_of)
    code = np.concatenate(held[2])
    held[2].clear()
    code.sort()
    name, size, follow = questions(code[_heads(code)], marks)
    at = _slot(name) % buckets
    turn = np.lexsort((name, at))
    follow = follow[_gathered((np.cumsum(size) - size)[turn], size[turn])]
    name, size = name[turn], size[turn]
    cut, cuts = (np.searchsorted(x, np.arange(buckets + 1)) for x in (_range(words, buckets), at[turn]))
    kinds, rest, fresh = shortened_names(name, cuts[:-1][np.diff(cuts) > 0])
    ends, rests = _begins(size)[cuts], _begins(fresh)[cuts]
    used = np.flatnonzero((np.diff(cut) > 0) | (np.diff(cuts) > 0))
    # A word is told by its distance from the one before.
    cells = ((lambda x: _less(np.diff(x, prepend=np.uint64(0))), words, cut), (_less, n, cut), (_small, kinds, cuts), (_small, rest, rests), (_less, size, cuts), (_small, follow, ends))
    cols = [pa.array([f(value[c[b] : c[b + 1]]) for b in used], pa.binary()) for f, value, c in cells]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(used), g), pa.int64()), pa.array(used, pa.int32()), *cols], names=["g", "bucket", "words", "n", "kinds", "rest", "sizes", "symbols"])


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 10, rest: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out("doc_id", mod, rest))
    ends, size = own.agg(F.count_if(~F.col("held_out")), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-int(size) // GROUP_BYTES))
    buckets = 4 * groups
    states, root = states_of(own.where("not held_out").select("text"), scratch)
    sent = spark.sparkContext.broadcast((root, _marks(states)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours of a group, as one compressed row."""
        task, begin, n = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for k, a, b in _groups(batch.column(1), begin):
                for i, j in W.chunks(W.buffers(batch.column(1).slice(a, b - a))[1], RUN_BYTES):
                    rows = _small(_ipc(batch.slice(a + i, j - i)))
                    yield pa.RecordBatch.from_pydict({"g": pa.array([task + k], pa.int64()), "n": pa.array([n], pa.int64()), "rows": pa.array([rows], pa.binary())})
                    n += 1
            begin += int(W.buffers(batch.column(1))[1][-1])

    texts = own.mapInArrow(dealt, "g long, n long, rows binary").repartition(groups, "g")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group and bucket: distinct words, how often training rows have them, and contexts."""
        task, begin, now = TaskContext.get().partitionId() << 32, 0, 0
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            on = batch.column(2).to_numpy(zero_copy_only=False)
            for k, a, b in _groups(batch.column(1), begin):
                if k != now and held[0]:
                    yield _asking(task + now, held, buckets, sent.value[1])
                    held = ([], [], [])
                now = k
                for i, j, w in W.of_column(batch.column(1).slice(a, b - a), most=CHUNK):
                    for c, x in zip(held, (w.hash, ~on[a + i : a + j][w.doc()], grams(*symbols(w))), strict=True):
                        c.append(x)
            begin += int(W.buffers(batch.column(1))[1][-1])
        if held[0]:
            yield _asking(task + now, held, buckets, sent.value[1])

    asks = own.mapInArrow(asked, "g long, bucket int, words binary, n binary, kinds binary, rest binary, sizes binary, symbols binary")
    reply = pa.schema([("g", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("n", "kinds", "rest", "sizes", "symbols", "counts", "totals")), ("tokens", pa.int64()), ("known", pa.int64())])

    def answered(asks: pa.Table, known: pa.Table) -> pa.Table:
        """For each group: its words' counts in all training rows, as it asked, and of its contexts that are states how often its symbols, and any, follow."""
        if not asks.num_rows:
            return reply.empty_table()
        own = [np.cumsum(_more(x)) for x in asks["words"].to_pylist()]
        cut = _begins(list(map(len, own)))
        words, at = _inverse(np.concatenate(own))
        total = np.zeros(len(words), np.int64)
        np.add.at(total, at, np.concatenate(list(map(_more, asks["n"].to_pylist()))).astype(np.int64))
        name = known["id"].to_numpy().view(np.uint64)
        order = np.argsort(name)
        name, syms, counts = name[order], known["symbols"].to_pylist(), known["counts"].to_pylist()
        owner = np.repeat(np.arange(len(order), dtype=np.uint64), [len(syms[k]) for k in order]) << np.uint64(8)
        edge, n = summed(owner | np.frombuffer(b"".join(syms[k] for k in order), np.uint8), np.frombuffer(b"".join(counts[k] for k in order), "<u4").astype(np.int64))
        whole = np.bincount((edge >> np.uint64(8)).astype(np.int64), n, minlength=len(name)).astype(np.int64)
        size = [_more(x).astype(np.int64) for x in asks["sizes"].to_pylist()]
        cuts, size = _begins(list(map(len, size))), np.concatenate(size)
        wanted = whole_names(*(np.frombuffer(b"".join(map(_whole, asks[c].to_pylist())), np.uint8) for c in ("kinds", "rest")))
        k = np.searchsorted(name, wanted)
        on = (name[np.minimum(k, len(name) - 1)] == wanted) if len(name) else np.zeros(len(wanted), bool)
        follow = np.frombuffer(b"".join(map(_whole, asks["symbols"].to_pylist())), np.uint8)[np.repeat(on, size)]
        k, size, cuts = k[on], size[on], _begins(on)[cuts]
        ask = np.repeat(k.astype(np.uint64), size) << np.uint64(8) | follow
        j = np.minimum(np.searchsorted(edge, ask), len(edge) - 1)
        count = np.where(edge[j] == ask, n[j], 0) if len(ask) else np.zeros(0, np.int64)
        kinds, rest, fresh = shortened_names(wanted[on], cuts[:-1][np.diff(cuts) > 0])
        ends, rests = _begins(size)[cuts], _begins(fresh)[cuts]
        cells = ((_less, total[at], cut), (_small, kinds, cuts), (_small, rest, rests), (_less, size, cuts), (_small, follow, ends), (_less, count, ends), (_less, whole[k], cuts))
        cols = [pa.array([f(value[c[r] : c[r + 1]]) for r in range(asks.num_rows)], pa.binary()) for f, value, c in cells]
        once = np.arange(asks.num_rows) == 0
        return pa.table([asks["g"], asks["bucket"], *cols, pa.array(once * int(total.sum())), pa.array(once * int((total > 0).sum()))], schema=reply)

    at = F.pmod("slot", F.lit(buckets)).cast("int").alias("bucket")
    answers = asks.groupBy("bucket").cogroup(states.select("id", at, "symbols", "counts").groupBy("bucket")).applyInArrow(answered, "g long, bucket int, n binary, kinds binary, rest binary, sizes binary, symbols binary, counts binary, totals binary, tokens long, known long")
    # Of each group a last row without n_tokens brings what its answers say of all training words.
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tokens", pa.int64()), ("kinds", pa.int64())])

    def score(own: pa.Table, known: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        own = pa.concat_tables([pa.ipc.open_stream(_whole(x)).read_all() for x in own.sort_by("n")["rows"].to_pylist()]).combine_chunks()
        hashes, parts, texts = [], [], []
        for i, j, w in W.of_column(own["text"], most=CHUNK):
            hashes.append(w.hash)
            parts.append(symbols(w))
            texts.append((i, j, w.counts))
        # Sorted before the states are unpacked, so that a worker does not hold both at their largest.
        at = _inverse(np.concatenate(hashes))[1]
        del hashes, w
        code, often, place = sequences(parts)
        known = known.sort_by("bucket")
        whole = [sum(known[c].to_pylist()) for c in ("tokens", "known")]
        name = whole_names(*(np.frombuffer(b"".join(map(_whole, known[c].to_pylist())), np.uint8) for c in ("kinds", "rest")))
        size, n, alls, counts = (np.concatenate([np.zeros(0, np.uint64), *map(_more, known[c].to_pylist())]).view(np.int64) for c in ("sizes", "counts", "totals", "n"))
        flat = np.frombuffer(b"".join(map(_whole, known["symbols"].to_pylist())), np.uint8)
        begin, depth, levels = _begins(size)[:-1], (name & _BYTE).astype(np.uint8), {}
        for d in range(1, DEPTH + 1):
            on = np.flatnonzero(depth == d)
            on = on[np.argsort(name[on])]
            edge = _gathered(begin[on], size[on])  # a name's symbols are in order
            levels[d] = Level(np.repeat(name[on] & top(d), size[on]) | flat[edge], n[edge], d)
            levels[d].all = alls[on]  # of all symbols, asked for or not
        del name, size, flat, n, alls, known
        tree, cols = Tree.of(levels, *sent.value[0]), []
        del levels
        tree.p.clear()
        # The counts stand in the order of the words' hashes, as they were asked for.
        counts = counts[at]
        value = tree.of_asked(code)
        del tree, code
        each = np.empty(len(place))
        each[place] = np.repeat(value, often)
        del value, often, place
        begin = end = 0
        for (i, j, n), (out, first) in zip(texts, parts, strict=True):
            c, one = counts[begin : begin + int(n.sum())], each[end : end + len(out)]
            begin, end = begin + len(c), end + len(out)
            doc, size = np.repeat(np.arange(j - i), n), j - i
            base = np.bincount(doc, np.log10(c + 0.1), minlength=size) + np.log10(ends + 0.1)
            model = np.add.reduceat(one, first[:-1])
            cols.append(
                pa.table(
                    [own["doc_id"].slice(i, size), own["held_out"].slice(i, size), pa.array(n + 1), pa.array(np.bincount(doc[c > 0], minlength=size) + int(ends > 0)), pa.array(base), pa.array(model), *[pa.nulls(size, pa.int64())] * 2],
                    schema=schema,
                )
            )
        cols.append(pa.table([*(pa.nulls(1, f.type) for f in list(schema)[:6]), *(pa.array([x], pa.int64()) for x in whole)], schema=schema))
        return pa.concat_tables(cols)

    out = scratch.only(texts.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tokens long, kinds long"))
    n_words, n_kinds = out.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    total, kinds = int(n_words) + int(ends), int(n_kinds) + (ends > 0)
    under = float(np.log10(total + 0.1 * (kinds + 1)))
    return out.where("n_tokens is not null").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * under).alias("base_score"), "score")
