"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A shingle is five words; it weighs its count in the text times an inverse document frequency. Documents that agree in all
samples of a band meet in a bucket and are compared with its most central member by their weighted Jaccard similarity.
Links make components. Members of a bucket outside its largest component meet all others of the bucket, block by block,
by their samples alone; those that agree in LIKELY of them meet again by their texts, so that no two similar members of a
bucket stay apart.

The inverse document frequency is 1 + ln(N / df), and 1 + ln(N / (FREQUENT N)) for all shingles that fewer than a share of
FREQUENT of the documents have: so a large group of near copies isn't torn apart by the rare shingles of their edits, and
the frequent shingles that have a weight of their own are a bounded table at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm import _text as tx
from tessera.llm._store import bucketed, fresh, rows_of, shuffle_partitions, written

#: Words of a shingle, and the least similarity of a link.
WORDS, LEAST = 5, 0.8
#: Bands and samples in each: documents of similarity 0.8 share a bucket with a probability of 0.998.
BANDS, ROWS = 12, 4
#: Share of documents from which a shingle has a document frequency of its own.
FREQUENT = 1 / 64
#: Counters of the sketch that finds which shingles can be frequent; they're then counted exactly.
SKETCH_BITS = 20
#: Tasks whose sketches are summed together, before those sums are.
TASKS = 512
#: Members that a task compares with a representative at a time, and that a block holds.
CHUNK, BLOCK = 256, 128
#: Samples of BANDS * ROWS in which members of a bucket agree at least to be compared by their texts: documents of similarity
#: 0.8 agree in fewer with a probability of 2e-6.
LIKELY = 24
#: Into how many parts the members of a bucket are dealt before they're repeated, and rows of a bucket that a part holds
#: where they're not.
_PARTS, PART = 64, 512
#: What a similarity may miss the least one by: sums of weights are rounded, and ties are links.
ROUNDING = 1e-9
_HASH = np.uint64((1 << 50) - 1)
_DOC = np.uint64(50)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """first, shingles, counts and contents: row i has the different shingles first[i] to first[i + 1], sorted, as 50-bit
    hashes, and how often; and a digest of its words in order. A text of fewer words, but not none, is one shingle."""
    starts, ends, at = tx.spans(data, offsets, tx.ALNUM)
    n_rows = len(offsets) - 1
    if n_rows > 1 << 14:
        raise ValueError("too many rows in a chunk")
    h = tx.hashes(data, starts, ends)
    raw = [h[at[i] : at[i + 1]].tobytes() for i in range(n_rows)]
    n = np.diff(at)
    total = np.zeros(len(h), np.uint64)
    row = tx.owners(at)
    left = np.repeat(at[1:], n) - np.arange(len(h))  # words from here to the row's end
    for k in range(min(words, len(h))):
        factor = tx.mixed(np.array([k + 1], np.uint64))[0] | np.uint64(1)
        part = np.zeros(len(h), np.uint64)
        part[: len(h) - k] = h[k:]
        part[left <= k] = 0
        total += part * factor
    inside = (left >= words) | ((n[row] < words) & (left == n[row]))
    keys = np.sort(row[inside].astype(np.uint64) << _DOC | (tx.mixed(total[inside]) & _HASH))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    where = np.flatnonzero(new)
    counts = np.diff(np.append(where, len(keys)))
    keys = keys[where]
    return np.searchsorted(keys, np.arange(n_rows + 1).astype(np.uint64) << _DOC), keys & _HASH, counts, raw


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for low, high, data, offsets in tx.chunks(column):
        for at in range(0, high - low, 1 << 14):
            to = min(high - low, at + (1 << 14))
            yield low + at, low + to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]


@dataclass
class Weights:
    """Inverse document frequencies: those of frequent shingles, and that of all others."""

    frequent: np.ndarray
    idf: np.ndarray
    other: float

    def of(self, shingle: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = counts * self.other
        if len(self.frequent):
            bits = np.zeros(1 << 16, bool)
            bits[self.frequent >> np.uint64(34)] = True
            some = np.flatnonzero(bits[shingle >> np.uint64(34)])
            at = np.minimum(np.searchsorted(self.frequent, shingle[some]), len(self.frequent) - 1)
            hit = self.frequent[at] == shingle[some]
            out[some[hit]] = counts[some[hit]] * self.idf[at[hit]]
        return out


def weights(docs: DataFrame, text_col: str = "text", frequent: float = FREQUENT) -> Weights:
    """Counts in how many documents the shingles occur: first in a sketch, whose counters that reach the share show which
    can be frequent, then exactly. Tasks send their counters in slices, summed by slice; the table is bounded by the
    mean number of a document's shingles / frequent."""
    source = docs.select(F.col(text_col).cast("string").alias("text"))
    size, slices = 1 << SKETCH_BITS, 64

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums, n = np.zeros(size, np.uint32), 0
        for batch in batches:
            for low, high, data, offsets in _chunks(rows_of(batch, "text")):
                first, found, _, _ = shingles(data, offsets)
                sums += np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint32)
                n += int((np.diff(first) > 0).sum())
        if n:
            parts = [zstd.ZstdCompressor(level=1).compress(x.tobytes()) for x in np.split(sums, slices)]
            part = TaskContext.get().partitionId() // TASKS
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([part] * slices, pa.int32()), pa.array([n] * slices, pa.int64()), pa.array(parts, pa.binary())], ["slice", "part", "n", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size // slices, np.uint64)
        for raw in table["sums"]:
            found = zstd.ZstdDecompressor().decompress(raw.as_py())
            total += np.frombuffer(found, np.uint32 if len(found) == total.nbytes // 2 else np.uint64)
        n, number, part = sum(table["n"].to_pylist()), table["slice"][0].as_py(), table["part"][0].as_py()
        made = zstd.ZstdCompressor(level=1).compress(total.tobytes())
        return pa.table({"slice": pa.array([number], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "sums": pa.array([made], pa.binary())})

    kind = "slice int, part int, n long, sums binary"
    sums = source.mapInArrow(sketch, kind).groupBy("slice", "part").applyInArrow(add, kind).groupBy("slice").applyInArrow(add, kind).collect()
    if not sums:
        return Weights(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    n = sums[0].n
    least = max(frequent * n, 1.0)
    hot = np.concatenate([np.frombuffer(zstd.ZstdDecompressor().decompress(r.sums), np.uint64) for r in sorted(sums, key=lambda r: r.slice)]) >= least
    other = 1 + np.log(n / least)
    if not hot.any():
        return Weights(np.zeros(0, np.uint64), np.zeros(0), float(other))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(hot))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            parts = []
            for _, _, data, offsets in _chunks(rows_of(batch, "text")):
                found = shingles(data, offsets)[1]
                parts.append(found[hot[(found & np.uint64(size - 1)).astype(np.int64)]])
            if parts:
                found, count = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(count.astype(np.int64))], ["shingle", "n"])

    rows = source.mapInArrow(exact, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas().sort_values("shingle")
    return Weights(rows["shingle"].to_numpy(np.int64).astype(np.uint64), 1 + np.log(n / rows["n"].to_numpy(float)), float(other))


# Quantiles of the gamma distribution of shape 2 and scale 1, by bisection of its distribution function.
def _quantiles(n: int) -> np.ndarray:
    u = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        under = 1 - np.exp(-middle) * (1 + middle) < u
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


_GAMMA = _quantiles(1 << 16).astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA).astype(np.float32)


def sample(first: np.ndarray, shingle: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Improved consistent weighted sampling: for each row with shingles, k samples (as 64-bit hashes of shingle and level).
    Two rows agree in a sample with the probability of their weighted Jaccard similarity."""
    rows = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, k), np.uint64)
    x = tx.mixed(shingle)
    log_w = np.log(weight).astype(np.float32)
    seeds = tx.mixed(np.arange(2 * k, dtype=np.uint64) + np.uint64(1001)) | np.uint64(1)
    begin, step = 0, 1 << 15
    while begin < len(rows):  # rows of some ten thousand shingles at a time stay in the processor's cache
        end = max(begin + 1, int(np.searchsorted(first[rows], first[rows[begin]] + step, "right")) - 1)
        low, high = first[rows[begin]], first[rows[end - 1] + 1]
        xs, lw = x[low:high], log_w[low:high]
        cuts = first[rows[begin:end]] - low
        sizes = np.diff(np.append(cuts, high - low))
        owner = np.repeat(np.arange(end - begin), sizes)
        for j in range(k):
            h = xs * seeds[2 * j]
            h ^= h >> np.uint64(29)
            h *= seeds[2 * j + 1]
            r = _GAMMA[h >> np.uint64(48)]
            c = _LOG_GAMMA[(h >> np.uint64(32)) & np.uint64(0xFFFF)]
            beta = (h & np.uint64(0xFFFFFFFF)).astype(np.float32) * np.float32(2.0**-32)
            t = np.floor(lw / r + beta)
            a = c - r * (t - beta + 1)
            best = np.minimum.reduceat(a, cuts)
            hit = np.flatnonzero(a == best[owner])[::-1]
            place = np.zeros(end - begin, np.int64)
            place[owner[hit]] = hit  # of equal ones the first, the least shingle
            out[rows[begin:end], j] = tx.mixed(xs[place] ^ (t[place].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        begin = end
    return out


def bands(samples: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band of samples; keys of different bands differ."""
    out = np.zeros((len(samples), n), np.uint64)
    for b in range(n):
        key = np.full(len(samples), b + 1, np.uint64)
        for j in range(rows):
            key = tx.mixed(key ^ samples[:, b * rows + j])
        out[:, b] = key
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted arrays of shingles and their weights."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total else 0.0


def _signed(source: DataFrame, weights: Weights) -> DataFrame:
    """id, c1 and c2 (128 bits of a digest of the words), bands, and samples (16 bits of each); null for texts without words."""
    shared = source.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = rows_of(batch, "id")
            for low, high, data, offsets in _chunks(rows_of(batch, "text")):
                first, found, counts, raw = shingles(data, offsets)
                some = np.diff(first) > 0
                samples = sample(first, found, shared.value.of(found, counts), BANDS * ROWS)
                keys = bands(samples).view(np.int64)
                short = pa.array([x.tobytes() if any_ else None for x, any_ in zip(samples.astype(np.uint16), some, strict=True)], pa.binary())
                digest = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in raw), np.int64).reshape(-1, 2)
                mask = pa.array(~some)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()), mask=mask)
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(digest[:, 0], mask=~some), pa.array(digest[:, 1], mask=~some), lists, short], ["id", "c1", "c2", "bands", "samples"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, c1 long, c2 long, bands array<long>, samples binary")


def _verified(texts: DataFrame, pairs: DataFrame, weights: Weights, least: float) -> DataFrame:
    """Of the pairs a, b those whose texts are similar, written with the lesser id as a. Texts go to tasks by a and a part
    of its members: at most about CHUNK members at a time, however many a has, and a copy of a's text for each part."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumnRenamed("a", "a_")
    parted = pairs.join(sizes, F.col("a") == F.col("a_")).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).alias("part"))
    parted = written(parted, "pairs")
    need = parted.select(F.col("b").alias("need"), "a", "part", F.lit(1).alias("member")).unionByName(parted.select(F.col("a").alias("need"), "a", "part", F.lit(0).alias("member")).distinct())
    rows = need.hint("merge").join(texts, F.col("need") == F.col("id")).select("a", "part", "member", "id", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "member", "id")
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, key, own = shared.value, None, None
        for batch in batches:
            a, part, member, ids = (rows_of(batch, c).to_pylist() for c in ("a", "part", "member", "id"))
            left, right, how = [], [], []
            for low, high, data, offsets in _chunks(rows_of(batch, "text")):
                first, found, counts, _ = shingles(data, offsets)
                weight = weights.of(found, counts)
                for i in range(low, high):
                    at = slice(first[i - low], first[i - low + 1])
                    if not member[i]:
                        key, own = (a[i], part[i]), (found[at], weight[at])
                    elif key == (a[i], part[i]) and len(own[0]):
                        s = similarity(own, (found[at], weight[at]))
                        if s >= least - ROUNDING:
                            left.append(a[i])
                            right.append(ids[i])
                            how.append(s)
            t = rows_of(batch, "a").type
            yield pa.RecordBatch.from_arrays([pa.array(left, t), pa.array(right, t), pa.array(how, pa.float64())], ["a", "b", "similarity"])

    found = rows.mapInArrow(run, f"a {kind}, b {kind}, similarity double")
    return written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"), "links")


def _overlaps(first: np.ndarray, found: np.ndarray, counts: np.ndarray, weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarities of all rows with each other: sums of least weights as a product of 0-1 matrices whose
    columns are a shingle's first, second, ... occurrence."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    weight = weights.of(found, counts)
    total = np.bincount(row, weight, n)
    times = np.repeat(np.arange(len(found)), counts)
    nth = np.arange(len(times)) - np.repeat(np.cumsum(counts) - counts, counts)
    column, place, held = np.unique(tx.mixed(found[times] ^ (nth.astype(np.uint64) << np.uint64(50))), return_inverse=True, return_counts=True)
    both = np.zeros((n, n))
    some = np.flatnonzero(held[place] > 1)
    kept = np.unique(place[some])
    unit = np.zeros(len(column), np.float32)
    unit[place] = np.sqrt(weights.of(found, np.ones(len(found), np.int64)))[times]
    for at in range(0, len(kept), 1 << 14):
        part = kept[at : at + (1 << 14)]
        number = np.full(len(column), -1, np.int64)
        number[part] = np.arange(len(part))
        mine = some[number[place[some]] >= 0]
        dense = np.zeros((n, len(part)), np.float32)
        dense[row[times[mine]], number[place[mine]]] = unit[place[mine]]
        both += dense @ dense.T
    union = total[:, None] + total[None, :] - both
    return np.where(union > 0, both / np.maximum(union, 1e-300), 0.0)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links, in this order, join parts of n members that those before don't."""
    parent, out = list(range(n)), np.zeros(len(a), bool)

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        i, j = top(i), top(j)
        if i != j:
            parent[i], out[k] = j, True
    return out


def _blocks(texts: DataFrame, apart: DataFrame, samples: DataFrame, weights: Weights, least: float) -> DataFrame:
    """Links that join what is similar among each key's members (key, id, major) that aren't both major. Members are dealt
    into blocks of about BLOCK, minor ones first; each block of minor ones and each block meet in a task, first as 96 bytes
    a member: those that agree in LIKELY samples with another meet again, as texts, and a task returns a forest of links.
    Keys are dealt into parts before their members are repeated for each block; no pairs of members are listed."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    blocks = lambda some: F.ceil(F.count_if(some) / BLOCK).cast("int")
    sizes = apart.groupBy("key").agg(blocks(~F.col("major")).alias("minors"), blocks(F.col("major")).alias("majors"))
    sizes = sizes.select("key", "minors", "majors", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("part"))
    dealt = apart.hint("merge").join(samples, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(_PARTS)).cast("int")).join(sizes, ["key", "part"])
    place = F.xxhash64("id", F.lit(1))
    at = F.when(F.col("major"), F.col("minors") + F.pmod(place, F.col("majors"))).otherwise(F.pmod(place, F.col("minors"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("major"), F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1)).alias("other")
    met = dealt.withColumn("own", at).select("key", "id", "major", "own", "samples", other)
    rows = met.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "major", "samples")
    kind = apart.schema["id"].dataType.simpleString()

    def likely(table: pa.Table) -> pa.Table:
        own = table["own"].to_numpy()
        held = np.frombuffer(b"".join(table["samples"].to_pylist()), np.uint16).reshape(len(own), -1)
        left, right = (np.flatnonzero(own == table[c][0].as_py()) for c in ("x", "y"))
        theirs, some = np.ascontiguousarray(held[right].T), np.zeros(len(own), bool)
        for k in left:
            agree = right[((theirs == held[k][:, None]).sum(0, dtype=np.uint8) >= LIKELY) & (right != k)]
            some[agree] = True
            some[k] |= len(agree) > 0
        return table.select(["key", "x", "y", "id", "major"]).filter(pa.array(some))

    few = rows.groupBy("key", "x", "y").applyInArrow(likely, f"key long, x int, y int, id {kind}, major boolean")
    few = few.withColumnRenamed("id", "need").hint("merge").join(texts, F.col("need") == F.col("id")).select("key", "x", "y", "id", "major", "text")

    def run(table: pa.Table) -> pa.Table:
        ids, major = table["id"].combine_chunks(), table["major"].to_numpy()
        parts = [shingles(data, offsets)[:3] for _, _, data, offsets in _chunks(table["text"].combine_chunks())]
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for f, _, _ in parts]))])
        found, counts = np.concatenate([f for _, f, _ in parts]), np.concatenate([c for _, _, c in parts])
        near = np.triu(_overlaps(first, found, counts, shared.value) >= least - 1e-3, 1) & ~(major[:, None] & major[None, :])
        i, j = np.nonzero(near)
        weight = shared.value.of(found, counts)
        rows = [(found[a:b], weight[a:b]) for a, b in zip(first, first[1:], strict=False)]
        same = np.array([similarity(rows[a], rows[b]) for a, b in zip(i, j, strict=True)])  # products are in single precision
        some = np.flatnonzero(same >= least - ROUNDING)
        some = some[_forest(i[some], j[some], len(ids))]
        return pa.table({"a": ids.take(pa.array(i[some])), "b": ids.take(pa.array(j[some])), "similarity": pa.array(same[some], pa.float64())})

    found = few.groupBy("key", "x", "y").applyInArrow(run, f"a {kind}, b {kind}, similarity double")
    return written(found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"), "links")


def _dealt(rows: DataFrame, of_keys: DataFrame, n: str = "n") -> DataFrame:
    """Joins rows (key, id) with the one row of each key, which has the number of its rows: large keys are dealt into parts."""
    of_keys = of_keys.withColumn("parts", F.ceil(F.col(n) / PART)).select("*", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part")).drop("parts")
    return rows.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / PART)).cast("int")).drop(n).join(of_keys, ["key", "part"]).drop("part")


def grouped(source: DataFrame, buckets: DataFrame, samples: DataFrame, weights: Weights, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Links a, b, similarity: enough verified ones of the buckets' members (key, id; samples: id, samples) to join all that
    are similar. And id, label of the ends of links: the least id of its component.

    A bucket's representative is its most central member: that whose buckets have most members in all, as an original has
    beside its edited copies (of equal ones that of least id). Their links make components; in a bucket that several of
    them share, members outside its largest meet all of the bucket (see _blocks). Texts of members move once into a table
    bucketed by id, then to where they're compared.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(buckets.join(sizes, "key"), "shared")
    central = shared.groupBy("id").agg(F.sum("n").alias("c")).withColumnRenamed("id", "id_")
    ranked = written(shared.join(central, F.col("id") == F.col("id_")).select("key", "id", "n", "c"), "ranked")
    members = ranked.select("id").distinct()
    texts = bucketed(source.hint("merge").join(members, "id", "left_semi"), "id", shuffle_partitions(source.sparkSession))
    first = F.struct((-F.col("c")).alias("c"), "id")
    with_first = _dealt(ranked, ranked.groupBy("key").agg(F.min(first)["id"].alias("a"), F.count("*").alias("n"))).where("id <> a")
    # by the representative, which has the many members; being more central (or of lesser id), it's never its member's member
    found = _verified(texts, with_first.select("a", F.col("id").alias("b")).distinct(), weights, least)
    labels = components(found)
    named = labels.withColumnRenamed("id", "id_")
    parts = written(ranked.join(named, F.col("id") == F.col("id_"), "left").select("key", "id", "n", F.coalesce("label", "id").alias("label")), "parts")
    kinds = parts.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("most"), F.count("*").alias("kinds"), F.sum("n").alias("n"))
    apart = _dealt(parts, kinds.where("kinds > 1")).select("key", "id", (F.col("label") == F.col("most")).alias("major"))
    new = _blocks(texts, written(apart, "apart"), samples, weights, least)
    # components of components: what the new links join
    ends = new.select(F.col("a").alias("id")).unionByName(new.select(F.col("b").alias("id"))).distinct()
    labels = written(labels.unionByName(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))), "labels")
    of_a, of_b = (labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_")) for end in ("a", "b"))
    joined = new.join(of_a, "a").join(of_b, "b").where("a_ <> b_").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    more = components(joined).select(F.col("id").alias("label"), F.col("label").alias("least"))
    return found.unionByName(new), labels.join(more, "label", "left").select("id", F.coalesce("least", "label").alias("label"))


def links(source: DataFrame, buckets: DataFrame, samples: DataFrame, weights: Weights, least: float = LEAST) -> DataFrame:
    """The links that join all similar members (key, id) of a bucket: a, b, similarity."""
    return grouped(source, buckets, samples, weights, least)[0]


def components(edges: DataFrame, count: list | None = None) -> DataFrame:
    """id, label for each end of an edge a, b: the least id of its component. By stars: every round links the larger
    neighbours of each id to the least id around it, then the smaller ones, until all edges lead to their component's least
    id. Rounds are written; their number rises as the logarithm of the longest path, whatever the order of its ids, and is
    appended to `count`."""
    star = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())

    before, rounds = mark(star), 0
    while before[0]:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        star = written(small.where("u <> v").distinct(), "stars")
        rounds, after = rounds + 1, mark(star)
        if after == before:
            break
        before = after
    if count is not None:
        count.append(rounds)
    return star.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(star.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def _classes(source: DataFrame, least: float, frequent: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows id, text: id, c1, c2; c1, c2, group_id of the texts that have an id; and the ids that several rows have."""
    weighed = weights(source, "text", frequent)
    signed = written(_signed(source, weighed), "signed")
    known = signed.where("c1 is not null and id is not null")
    reps = written(known.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("samples").alias("samples")), "classes")
    again = written(signed.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "again")
    # an id stands for one text, of several the one of least digest
    nodes = reps.groupBy(F.col("rep").alias("id")).agg(F.min(F.struct("c1", "c2", "bands", "samples")).alias("b")).select("id", "b.*")
    several = nodes.join(again, "id", "left_semi").select(F.col("id").alias("rep"), F.col("c1").alias("d1"), F.col("c2").alias("d2"))
    odd = _digested(source.join(again, "id", "left_semi"), "text", ["c1", "c2"])
    odd = odd.join(several, (F.col("id") == F.col("rep")) & (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2"))).select("id", "text").dropDuplicates(["id"])
    own = source.where("id is not null").join(again, "id", "left_anti").unionByName(odd)
    buckets = nodes.select(F.explode("bands").alias("key"), "id").distinct()
    _, labels = grouped(own, buckets, nodes.select("id", "samples"), weighed, least)
    final = reps.select("c1", "c2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("c1", "c2", F.coalesce("label", "rep").alias("group_id"))
    return signed.select("id", "c1", "c2"), final, again


def classes(docs: DataFrame, *, least: float = LEAST, frequent: float = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, group_id, the least id of its class, and kept, whether it's that one.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z read as a-z. Texts of equal words are one before anything is
    compared, however many they are. Texts without words, or null, have a class of their own. A null id never stands for a
    class: such rows have the group_id of their class, null if they're alone. Ids name documents: of several texts with one
    id that of least digest is compared with others, and all are of its class or of a smaller id's that has the same text. Other columns aren't read; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed, final, _ = _classes(source, least, frequent)
    out = signed.join(final, ["c1", "c2"], "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("group_id"), F.col("group_id").isNull())).withColumnRenamed("id", id_col)


def _digested(docs: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """docs and the digest of each text's words in two columns, as in _signed()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in _chunks(rows_of(batch, text_col).cast(pa.large_string())):
                starts, ends, at = tx.spans(data, offsets, tx.ALNUM)
                h = tx.hashes(data, starts, ends)
                parts += [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at, at[1:], strict=False)]
            made = [pa.array([None if x is None else int.from_bytes(x[k : k + 8], "little", signed=True) for x in parts], pa.int64()) for k in (0, 8)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(x, LongType()) for x in names)]))


def deduplicated(docs: DataFrame, *, least: float = LEAST, frequent: float = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class, with all its columns: that of the class's least id.

    Rows whose id is null or occurs again are judged by their texts: those without words stay; one of each text stays if
    its id is its class's least one, or if no row with an id has a text of its class. Other rows are judged by their id.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed, final, again = _classes(source, least, frequent)
    final = written(final, "final")
    gone, c1, c2, d1, d2, group = fresh(docs, "gone", "c1", "c2", "d1", "d2", "group")
    again = again.select(F.col("id").alias(gone))
    drop = signed.where("id is not null").join(final, ["c1", "c2"]).where("id <> group_id").select(F.col("id").alias(gone))
    out = docs.where(F.col(id_col).isNotNull()).join(drop.unionByName(again).distinct(), F.col(id_col) == F.col(gone), "left_anti")
    odd = docs.where(F.col(id_col).isNull()).unionByName(docs.join(again, F.col(id_col) == F.col(gone), "left_semi"))
    odd = _digested(odd, text_col, [c1, c2])
    found = final.select(F.col("c1").alias(d1), F.col("c2").alias(d2), F.col("group_id").alias(group))
    odd = odd.join(found, (F.col(c1) == F.col(d1)) & (F.col(c2) == F.col(d2)), "left")
    stays = F.when(F.col(id_col).isNull(), F.col(group).isNull()).otherwise(F.col(id_col) == F.col(group))
    worded = odd.where(F.col(c1).isNotNull() & stays).dropDuplicates([id_col, c1, c2])
    return out.unionByName(worded.select(*docs.columns)).unionByName(odd.where(F.col(c1).isNull()).select(*docs.columns))
