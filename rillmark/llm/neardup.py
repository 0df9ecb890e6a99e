"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Each text becomes its set of word shingles, hashed to 64 bits; equal sets
   collapse into one representative, the least id, before anything is compared.
2. BANDS bands of ROWS minimums each propose candidates.  At a similarity of 0.8
   a pair shares no band with a chance of (1 - 0.8**5)**40, about 1e-7.
3. In each band's bucket every member is compared with the bucket's least member
   (a star, so a bucket of m costs m - 1 comparisons), and the links found are
   contracted to components.  Buckets that still hold several components are compared
   with a leader drawn at random in each of ROUNDS more rounds, members of the leader's
   component aside.  Those that hold several even then are compared in all pairs
   across components, in blocks of bounded size, each pair in one bucket only: there, and only
   there, work is the square of the number of members.  Two band keys that differ but agree in 32 bits
   (a chance of about 1e-8 for a pair) make such a pair look seen.
4. A comparison reads the signatures in batches and stops as soon as the posterior
   chance of the wanted similarity falls under MISS; survivors are confirmed on
   full shingle sets.  Rows of a bucket or a leader that has many are dealt to several tasks.

Defined results: null or wordless text has an empty set (n_shingles 0) and links with
nothing; rows with a null id link with nothing and get null component and kept; rows
that share an id are one document, linked if any of their texts link; an empty table
gives an empty table; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import md5
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm import words as W
from rillmark.llm.cluster import FEW, HOT, Scratch, components, hot_join

BANDS, ROWS = 40, 5
BATCH, MISS = 20, 1e-6
#: Random stars before the rest is compared in pairs.
ROUNDS = 3
#: Bits of the broadcast bitmap of ids, whatever their number; it only spares work.
BITMAP = 1 << 23
#: Members of a block; pairs of blocks are compared, so a bucket of any size is whole.
BLOCK = 256
_RNG = np.random.default_rng(71)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(w: W.Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words, but not none, is one shingle."""
    h, at = W.ngrams(w, k)
    cut = np.searchsorted(at, w.first)
    out = []
    for i, n in enumerate(w.counts):
        if n >= k:
            s = np.sort(h[cut[i] : cut[i + 1]])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            x = np.full(1, n, np.uint64)
            for y in w.hash[w.first[i] : w.first[i + 1]]:
                x = W.pair(x, y)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minimums(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each set; sets must not be empty."""
    flat = np.concatenate(sets)
    head = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(_A), len(sets)), np.uint64)
    for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
        np.minimum.reduceat(flat * a + b, head, out=out[i])
    return out.T


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.empty((len(mins), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(mins), b, np.uint64)
        for r in range(ROWS):
            k = W.pair(k, mins[:, b * ROWS + r])
        keys[:, b] = k
    return keys


@cache
def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """After each batch, the matches under which a pair is dropped.

    With a flat prior, P(similarity >= t | m of n match) is P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of two signature matrices may still have the wanted similarity."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for step, least in enumerate(least_matches(percent)):
        cols = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (a[left, cols] == b[left, cols]).sum(1)
        on = matches >= least
        left, matches = left[on], matches[on]
    return left


def _signatures(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_hash", pa.binary()), ("keys", pa.list_(pa.int64())), ("short", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in W.of_column(batch.column(1)):
                sets = shingle_sets(w, k)
                full = [x for x, s in enumerate(sets) if len(s)]
                hashes, keys, short, sigs = ([None] * len(sets) for _ in range(4))
                if full:
                    mins = minimums([sets[x] for x in full])
                    bands, bits = band_keys(mins).view(np.int64), (W.mix(mins) >> np.uint64(48)).astype("<u2")
                    for r, x in enumerate(full):
                        hashes[x], keys[x], short[x], sigs[x] = md5(sets[x].tobytes(), usedforsecurity=False).digest(), bands[r], bands[r].astype("<u4").tobytes(), bits[r].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return run


def _full_sets(k: int, wanted):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = (W.mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(BITMAP)).astype(np.int64)
            batch = batch.filter(pa.array((wanted.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            for i, j, w in W.of_column(batch.column(1)):
                sets = shingle_sets(w, k)
                flat = pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], schema=schema)

    return run


def _matrix(column: pa.Array, width: int = BANDS * ROWS, kind: str = "<u2") -> np.ndarray:
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), width)


def _prune(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                on = pa.array(survivors(_matrix(batch.column(2)), _matrix(batch.column(3)), percent))
                yield batch.select([0, 1]).take(on)

    return run


def _may_link(i: int, j: np.ndarray, n: np.ndarray, at: np.ndarray, flat: np.ndarray, percent: int) -> np.ndarray:
    """Which sets j may link with set i, by the upper halves of their hashes: halves that meet by chance only add to what is shared."""
    own = flat[at[i] : at[i + 1]]
    size = at[j + 1] - at[j]
    other = flat[np.repeat(at[j] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
    hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
    shared = np.minimum(np.add.reduceat(hit, np.cumsum(size) - size), n[i])
    return 100 * shared >= percent * (n[i] + n[j] - shared)


def _across(percent: int):
    """Of rows sorted by block pair: pairs of different components that survive the signatures."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        sig, keys = _matrix(rows["sig"].combine_chunks(), BANDS * ROWS, "<u2"), _matrix(rows["short"].combine_chunks(), BANDS, "<u4")
        band = int(np.argmax(keys[0] == np.uint32(rows["bkey"][0].as_py() & 0xFFFFFFFF)))
        rep, n, comp, side = (rows[c].to_numpy() for c in ("rep", "n", "component", "side"))
        lists = rows["high"].combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy().view(np.uint32)
        at = at - at[0]
        alone = len(np.unique(side)) == 1
        left = np.arange(len(rep)) if alone else np.flatnonzero(side == side.min())
        other = left if alone else np.flatnonzero(side != side.min())
        a, b = [], []
        for i in left:
            j = other[other > i] if alone else other
            j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            j = j[~(keys[j, :band] == keys[i, :band]).any(1)]  # seen in an earlier band
            if len(j):
                j = j[survivors(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], percent)]
            if len(j):
                j = j[_may_link(i, j, n, at, flat, percent)]
            if len(j):
                a.append(np.full(len(j), rep[i]))
                b.append(rep[j])
        if a and sum(map(len, a)):
            x, y = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("bkey", "one", "two")]
            cut = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1), batch.num_rows]
            for i, j in zip(cut, cut[1:], strict=False):
                now = tuple(c[i] for c in cols)
                if held and now != key:
                    if out := pairs(pa.Table.from_batches(held)):
                        yield out
                    held = []
                key = now
                held.append(batch.slice(i, j - i))
        if held and (out := pairs(pa.Table.from_batches(held))):
            yield out

    return run


def _bitmap(ids: DataFrame):
    """A broadcast bitmap of BITMAP bits in which every id's bit is set; made of at most BITMAP / 64 sums."""
    slots = ids.toDF("id").mapInArrow(_slots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(BITMAP // 64, np.int64)
    for word, bits in slots.collect():
        out[word] = bits
    return ids.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(BITMAP // 64, np.int64)
    for batch in batches:
        slot = (W.mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(BITMAP)).astype(np.int64)
        np.bitwise_or.at(seen, slot >> 6, np.int64(1) << (slot & 63))
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"word": pa.array(at, pa.int64()), "bits": pa.array(seen[at], pa.int64())})


def _blocks_of(rows: DataFrame, facts: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of mixed buckets with their signatures and the upper halves of their shingles, dealt and sorted by pairs of blocks."""
    halves = sets.select(F.col("id").alias("rep"), F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("high"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    return (
        rows.join(facts.select("rep", "n", "sig", "short").hint("merge"), "rep")
        .join(halves.hint("merge"), "rep")
        .withColumn("side", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("bkey", "rep", "component", "n", "sig", "short", "high", "side", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"))
        .repartition("bkey", "one", "two")
        .sortWithinPartitions("bkey", "one", "two")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of `docs`.

    Documents link where 100 * |intersection| >= percent * |union| of their sets of
    `shingle_words`-word shingles; component_id is the least id reachable by links.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.keep(texts.mapInArrow(_signatures(shingle_words), "doc_id long, n long, set_hash binary, keys array<long>, short binary, sig binary"))
    able = signed.where("doc_id is not null and n > 0")
    sets = able.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("short").alias("short"), F.first("sig").alias("sig"))
    reps = scratch.keep(sets)

    spread = reps.select("rep", F.explode("keys").alias("bkey"))
    buckets = spread.groupBy("bkey").agg(F.min("rep").alias("leader"), F.max("rep").alias("most"), F.count(F.lit(1)).alias("rows")).where("leader <> most").drop("most")
    buckets = scratch.keep(buckets.withColumn("members", F.col("rows")))
    members = scratch.keep(hot_join(spread, buckets, "bkey", BANDS * reps.count()))

    def with_leaders(pairs: DataFrame, more: DataFrame, leaders: DataFrame, total: int) -> DataFrame:
        """`more` (pairs with columns of b) with the columns of a, which may be in many pairs."""
        if total <= HOT:
            return more.join(leaders, "a")
        counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rows"))
        return hot_join(more, scratch.keep(leaders.join(counts.hint("merge"), "a")), "a", total, by=("a", "b"))

    def with_both(pairs: DataFrame, b: DataFrame, a: DataFrame) -> DataFrame:
        """Kept pairs with the columns of their ends; a few pairs are brought to the rows of b, not these to them."""
        total = pairs.count()
        return with_leaders(pairs, b.join(F.broadcast(pairs), "b") if total <= FEW else pairs.join(b.hint("merge"), "b"), a, total)

    def surviving(pairs: DataFrame, facts: DataFrame) -> DataFrame:
        both = with_both(scratch.keep(pairs), facts.select("rep", "n", "sig").toDF("b", "nb", "sb"), facts.select("rep", "n", "sig").toDF("a", "na", "sa"))
        return both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "sa", "sb").mapInArrow(_prune(percent), "a long, b long")

    def full_sets(ids: DataFrame) -> DataFrame:
        """(id, shingles) of these ids and, as the bitmap may say so, of others."""
        return scratch.keep(texts.where("doc_id is not null").mapInArrow(_full_sets(shingle_words, _bitmap(ids)), "id long, shingles array<long>"))

    def confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
        """The pairs that link; one may be there more than once."""
        both = with_both(scratch.keep(pairs), full.toDF("b", "sb"), full.toDF("a", "sa"))
        shared = F.size(F.array_intersect("sa", "sb"))
        met = both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("total")).where(f"100L * i >= {percent}L * (total - i)")
        return scratch.keep(met.select("a", "b"))

    def joined(links: DataFrame, known: DataFrame) -> DataFrame:
        """(rep, component) after more links."""
        at = links.join(known.toDF("a", "ca"), "a", "left").join(known.toDF("b", "cb"), "b", "left")
        more = components(scratch, at.select(F.coalesce("ca", "a").alias("src"), F.coalesce("cb", "b").alias("dst"))).toDF("component", "final")
        old = known.join(more, "component", "left").select("rep", F.coalesce("final", "component").alias("component"))
        new = more.join(known, F.col("rep") == more["component"], "left_anti").select(F.col("component").alias("rep"), F.col("final").alias("component"))
        return scratch.keep(old.union(new))

    star = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    seen = scratch.keep(surviving(star, reps))
    links = confirmed(seen, full_sets(seen.select("a").union(seen.select("b"))))
    known = scratch.keep(components(scratch, links.toDF("src", "dst")).toDF("rep", "component"))

    left = members.where("members > 2").select("bkey", "rep", "members")
    facts = sets = None
    for r in range(ROUNDS + 1):
        placed = scratch.keep(left.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
        draw = F.xxhash64("rep", "bkey", F.lit(r))
        mixed = placed.groupBy("bkey").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("rep", draw).alias("leader"), F.min_by("component", draw).alias("own"), F.count(F.lit(1)).alias("rows")).where("low <> high").drop("low", "high")
        mixed = scratch.keep(mixed)
        if mixed.isEmpty():
            break
        total = placed.count()
        rows = scratch.keep(placed.join(F.broadcast(mixed.drop("rows")), "bkey") if total <= FEW else hot_join(placed, mixed, "bkey", total))
        left = rows.select("bkey", "rep", "members")
        if facts is None:
            live = scratch.keep(rows.select("rep").distinct())
            facts = scratch.keep(reps.join(live, "rep", "left_semi"))
            sets = full_sets(live)
        if r < ROUNDS:
            found = surviving(rows.where("component <> own").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct(), facts)
        else:
            found = _blocks_of(rows, facts, sets).mapInArrow(_across(percent), "a long, b long").distinct()
        links = confirmed(found, sets)
        known = known if links.isEmpty() else joined(links, known)
    named = known.toDF("node", "component")
    # Texts of one id are one document, whatever their sets.
    owned = able.select("doc_id", "set_hash").join(reps.select("set_hash", "rep"), "set_hash")
    odd = owned.groupBy("doc_id").agg(F.min("rep").alias("one")).join(owned, "doc_id").where("rep <> one").select("one", "rep").distinct()
    same = odd.join(named.toDF("one", "ca"), "one", "left").join(named.toDF("rep", "cb"), "rep", "left").select(F.coalesce("ca", "one").alias("src"), F.coalesce("cb", "rep").alias("dst"))
    second = components(scratch, same).toDF("component", "final")
    ends = reps.select("set_hash", "rep").join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(second, "component", "left").select("set_hash", F.coalesce("final", "component").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "set_hash").join(ends, "set_hash", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return scratch.only(out.withColumn("kept", F.col("doc_id") == F.col("component_id")))
