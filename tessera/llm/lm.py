"""A probabilistic suffix tree over words, and scores of whole texts.

The tree's alphabet is the words that training texts have LEAST_COUNT times, an end mark, and one symbol for all other
words; within it words go by their unigram probability. A context is up to DEPTH symbols that training texts have LEAST_COUNT
times; it's kept if what follows it diverges from what follows its longest kept suffix. Probabilities of the longest kept
context are smoothed with those of its suffixes. The counts are absolute, so alphabet and tree grow with the corpus: neither
is gathered nor broadcast.

Texts are read once, into shards of numbered words, in a table bucketed by shard, which later joins don't move. Three times
shards ask and owners answer: how often words occur (owners by word); how often a word follows another (owners by the first
one); and how likely a position's word is after its longer contexts (owners by the two words before, which hold the whole
subtree of contexts that end in them). A shard asks each different question once, with its count, so a word or a passage
that is a third of all text costs no more than others; a context stops where two neighbours occur together less often than
LEAST_COUNT times, as no longer one can be a candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as tx
from tessera.llm._store import bucketed, rows_of, scanned_bytes, shuffle_partitions, written

#: How often a symbol, a context or a next symbol after a context is in the training texts at least.
LEAST_COUNT = 2
DEPTH = 8
#: Tokens that a context's suffix counts for in its distribution.
SMOOTHING = 5.0
SHARD_BYTES = 8 << 20
#: Bytes of input, as stored, for each bucket of shards.
BUCKET_BYTES = 16 << 20
#: Tokens for each owner, about.
OWNER_TOKENS = 1 << 20
END = np.uint64(0x5E5E5E5E5E5E5E5E)
#: Symbols are numbered by steps of their count, the frequent ones first: a factor of 2 has so many steps.
_STEPS = 4
_KINDS = 63 * _STEPS
#: Logarithms of probabilities go to owners in these steps of a factor of 2, and those of factors come back in the others.
_FINE, _FACTORS = 64, 1024


def _zip(x: np.ndarray) -> bytes:
    """Compressed numbers, their first bytes first, then their second ones, and so on."""
    wide = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
    return zstd.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide.T).tobytes())


def _unzip(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstd.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return planes.T.copy().view(kind).ravel()


def shards(docs: DataFrame, learns: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts as numbered words, written once, bucketed by shard: ids, learn (whether each is learnt from), first (each
    text's tokens: its words and one end), vocabulary (hashes of the shard's tokens, frequent ones first) and tokens."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(learns, F.lit(False)).alias("learn"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, learn = rows["id"].combine_chunks(), rows["learn"].to_numpy().astype(np.uint8)
            for low, high, data, offsets in tx.chunks(rows["text"], SHARD_BYTES):
                starts, ends, first = tx.spans(data, offsets, tx.BLANK_SEPARATED)
                first = first + np.arange(len(first))
                words = np.full(first[-1], END, np.uint64)
                inner = np.ones(first[-1], bool)
                inner[first[1:] - 1] = False
                words[inner] = tx.hashes(data, starts, ends)
                vocabulary, tokens, counts = np.unique(words, return_inverse=True, return_counts=True)
                order = np.argsort(-counts, kind="stable")
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), ids.slice(low, high - low)), *(pa.array([x], pa.binary()) for x in (learn[low:high].tobytes(), _zip(first.astype(np.int64)), vocabulary[order].tobytes(), _zip(place[tokens])))],
                    ["shard", "ids", "learn", "first", "vocabulary", "tokens"],
                )
                number += 1
            held, size = [], 0

        for batch in batches:  # small batches are gathered, so that shards are of even size
            held.append(batch)
            size += rows_of(batch, "text").nbytes
            if size >= SHARD_BYTES:
                yield from flush()
        yield from flush()

    kind = source.schema["id"].dataType.simpleString()
    rows = source.mapInArrow(run, f"shard long, ids array<{kind}>, learn binary, first binary, vocabulary binary, tokens binary")
    return bucketed(rows, "shard", max(shuffle_partitions(docs.sparkSession), scanned_bytes(docs) // BUCKET_BYTES))


class _Shard:
    def __init__(self, row: dict) -> None:
        self.learn = np.frombuffer(row["learn"], np.uint8).astype(bool)
        self.first = _unzip(row["first"], np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.tokens = _unzip(row["tokens"], np.uint32)
        self.learnt = np.repeat(self.learn, np.diff(self.first))  #: which tokens belong to texts that are learnt from


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names) if name != "ids"} | {"ids": batch.column(batch.schema.get_field_index("ids"))[k].values if "ids" in batch.schema.names else None}


def _power(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(x, 1)))))


@dataclass
class Sizes:
    """What all shards know of the training texts."""

    n_tokens: int
    n_types: int
    other: float  #: probability of the symbol for all other words
    bits: int  #: of a symbol's number; the numbers from 1 are symbols, 0 all others
    offsets: np.ndarray  #: by step of count and owner the number of its first symbol
    owners: int

    @property
    def rare(self) -> int:
        """The number that stands for next symbols which no longer context can have often."""
        return (1 << self.bits) - 1

    def likely(self, symbol: np.ndarray) -> np.ndarray:
        """About the unigram probability of symbols: by the step of their count."""
        firsts = self.offsets[::-1, 0]  # ascending
        step = _KINDS - np.maximum(np.searchsorted(firsts, symbol, "right"), 1)
        p = (2.0 ** ((step + 0.5) / _STEPS) + 1) / (self.n_tokens + self.n_types + 1)
        return np.where(symbol > 0, p, self.other)


def _step(total: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(total, 1)) * _STEPS + 1e-9).astype(np.int64)


def _group(table: pa.Table) -> list[dict]:
    """Messages in the order of their shards: sums don't depend on how they arrived."""
    return sorted(table.to_pylist(), key=lambda x: x["shard"])


_MESSAGE = "owner int, shard long, body array<binary>"
_ANSWER = "shard long, owner int, round int, body array<binary>"
_TYPES = {"owner": pa.int32(), "shard": pa.int64(), "round": pa.int32(), "body": pa.list_(pa.binary())}


def _batch(**columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, _TYPES[k]) for k, x in columns.items()], list(columns))


def _word_counts(store: DataFrame) -> tuple[DataFrame, Sizes]:
    """For each shard and owner how often its words, by hash, are in all training texts, and their places among the owner's
    symbols of the same step of count."""
    owners = _power(4 * max(16, shuffle_partitions(store.sparkSession)))
    shift = np.uint64(64 - int(np.log2(owners)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            shard = _Shard(row)
            counts = np.bincount(shard.tokens[shard.learnt], minlength=len(shard.vocabulary)).astype(np.uint32)
            order = np.argsort(shard.vocabulary)
            words, counts = shard.vocabulary[order], counts[order]
            cuts = np.searchsorted(words >> shift, np.arange(owners + 1).astype(np.uint64))
            some = np.flatnonzero(np.diff(cuts))
            yield _batch(owner=some.tolist(), shard=[row["shard"]] * len(some), body=[[_zip(np.diff(words[cuts[k] : cuts[k + 1]], prepend=np.uint64(0))), _zip(counts[cuts[k] : cuts[k + 1]])] for k in some])

    def answer(table: pa.Table) -> pa.Table:
        asked = _group(table)
        keys = [np.cumsum(_unzip(x["body"][0], np.uint64), dtype=np.uint64) for x in asked]
        different, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate([_unzip(x["body"][1], np.uint32) for x in asked]), len(different)).astype(np.int64)
        frequent, step = total >= LEAST_COUNT, _step(total)
        rank, sizes = np.zeros(len(total), np.int64), np.zeros(_KINDS, np.int64)
        some = np.flatnonzero(frequent)
        some = some[np.argsort(step[some], kind="stable")]
        sizes += np.bincount(step[some], minlength=_KINDS)
        rank[some] = np.arange(len(some)) - (np.cumsum(sizes) - sizes)[step[some]]
        about = np.array([total.sum(), (total > 0).sum(), total[frequent].sum(), *sizes], np.int64)
        out, at = [], 0
        for k, x in enumerate(keys):
            mine = place[at : at + len(x)]
            out.append([_zip(total[mine]), _zip(rank[mine]), *([_zip(about)] if k == 0 else [])])
            at += len(x)
        return pa.Table.from_batches([_batch(shard=[x["shard"] for x in asked], owner=[x["owner"] for x in asked], round=[0] * len(asked), body=out)])

    asked = store.select("shard", "learn", "first", "vocabulary", "tokens").mapInArrow(ask, _MESSAGE)
    answers = written(asked.groupBy("owner").applyInArrow(answer, _ANSWER), "words")
    about = np.zeros((owners, _KINDS + 3), np.int64)
    for r in answers.where(F.size("body") > 2).select("owner", F.col("body")[2].alias("about")).collect():
        about[r.owner] = _unzip(bytes(r.about), np.int64)
    n_tokens, n_types, mass = (int(x) for x in about[:, :3].sum(0))
    sizes = about[::, 3:].T[::-1]  # frequent steps first
    offsets = (1 + np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(sizes.shape)[::-1]
    everything, fresh = n_tokens + n_types + 1, int(sizes.sum())
    return answers, Sizes(n_tokens, n_types, (everything - mass - fresh) / everything, max(1, (fresh + 1).bit_length()), np.ascontiguousarray(offsets), _power(n_tokens / OWNER_TOKENS))


class _Walk:
    """A shard's positions and what owners have answered so far."""

    def __init__(self, row: dict, sizes: Sizes) -> None:
        self.shard, self.sizes = _Shard(row), sizes
        self.parts: dict[int, list[list[bytes]]] = {}
        for x in sorted(row["parts"], key=lambda x: (x["round"], x["owner"])):
            self.parts.setdefault(x["round"], []).append(x)
        vocabulary = self.shard.vocabulary
        total, rank = (np.concatenate([_unzip(x["body"][k], np.int64) for x in self.parts[0]]) for k in range(2))
        order = np.argsort(vocabulary)
        owner = (vocabulary[order] >> np.uint64(64 - int(np.log2(sizes.offsets.shape[1])))).astype(np.int64)
        number = np.where(total >= LEAST_COUNT, sizes.offsets[_step(total), owner] + rank, 0)
        self.total, self.number = np.empty_like(total), np.empty_like(number)
        self.total[order], self.number[order] = total, number
        self.base = (self.total + 1) / (sizes.n_tokens + sizes.n_types + 1)
        first, self.tokens = self.shard.first, self.shard.tokens
        self.symbols = self.number[self.tokens]
        self.inside = np.arange(len(self.tokens)) - np.repeat(first[:-1], np.diff(first))
        self.p = np.where(self.number == 0, sizes.other, self.base)[self.tokens]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The positions after a symbol; the different pairs of it and the next one, which stand by the symbol's hash; and
        for each position the place of its pair."""
        before = np.concatenate([[0], self.symbols[:-1]])
        live = np.flatnonzero((self.inside > 0) & (before > 0))
        bits = np.int64(self.sizes.bits)
        keys, place = np.unique(before[live] << bits | self.symbols[live], return_inverse=True)
        order = np.argsort(tx.mixed(keys >> bits), kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return live, keys[order], back[place]

    def ask_pairs(self, shard: int) -> pa.RecordBatch:
        live, keys, place = self.pairs()
        counts = np.bincount(place[self.shard.learnt[live]], minlength=len(keys)).astype(np.uint32)
        context = keys >> self.sizes.bits
        cuts = np.searchsorted(_owner(tx.mixed(context), self.sizes.owners), np.arange(self.sizes.owners + 1))
        some = np.flatnonzero(np.diff(cuts))
        follows = (keys & ((1 << self.sizes.bits) - 1)).astype(np.uint64)
        body = [[_zip(np.diff(context[x], prepend=0)), _zip(follows[x]), _zip(counts[x])] for x in (slice(cuts[k], cuts[k + 1]) for k in some)]
        return _batch(owner=some.tolist(), shard=[shard] * len(some), body=body)

    def one_before(self) -> None:
        """Mixes in the contexts of one symbol; `twice` is how often training texts have each position's pair."""
        live, keys, place = self.pairs()
        self.twice = np.zeros(len(self.symbols), np.int64)
        if not len(live):
            return
        n = np.concatenate([_unzip(x["body"][0], np.uint32) for x in self.parts[1]]).astype(np.int64)
        mass = np.concatenate([_unzip(x["body"][1], np.int64) for x in self.parts[1]])  # of kept contexts
        context = keys >> self.sizes.bits
        which = np.cumsum(np.diff(context, prepend=-1) != 0) - 1
        total = np.zeros(len(keys))
        total[place] = self.total[self.tokens[live - 1]]
        kept = mass[which] > 0
        own = np.where(kept & (n >= LEAST_COUNT), n / (total + SMOOTHING), 0.0)
        rest = np.where(kept, (total - mass[which] + SMOOTHING) / (total + SMOOTHING), 1.0)
        self.p[live] = own[place] + rest[place] * self.p[live]
        self.twice[live] = n[place]

    def longer(self) -> tuple[np.ndarray, np.ndarray, dict]:
        """The positions with a longer context, for each the place of its question, and the different questions: the
        symbols before (`length` of them) and the next one. Questions stand by owner and the last two symbols before."""
        s, at = self.symbols, np.arange(len(self.symbols))
        stop = np.maximum.accumulate(np.where(self.twice < LEAST_COUNT, at, -1))
        length = np.zeros(len(s), np.int64)
        length[1:] = np.minimum(at[1:] - stop[:-1], DEPTH)
        live = np.flatnonzero((self.inside > 1) & (length > 1))
        n = length[live]
        follows = np.where(self.twice[live] >= LEAST_COUNT, s[live], self.sizes.rare)
        h = tx.mixed(follows * DEPTH + n)
        for j in range(1, DEPTH + 1):
            some = np.flatnonzero(n >= j)
            h[some] = tx.mixed(h[some] ^ (s[live[some] - j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, index, place = np.unique(h, return_index=True, return_inverse=True)
        two = s[live[index] - 1] << np.int64(self.sizes.bits) | s[live[index] - 2]
        order = np.argsort(two, kind="stable")
        owner = _owner(tx.mixed(two[order]), self.sizes.owners)
        order = order[np.argsort(owner.astype(np.uint16 if self.sizes.owners <= 1 << 16 else np.uint32), kind="stable")]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        index = index[order]
        return live, back[place], {"at": live[index], "length": n[index], "next": follows[index], "owner": np.sort(owner)}

    def ask_longer(self, shard: int) -> pa.RecordBatch:
        live, place, asked = self.longer()
        s, pick, length = self.symbols, asked["at"], asked["length"]
        counts = np.bincount(place[self.shard.learnt[live]], minlength=len(pick)).astype(np.uint32)
        fine = np.where(asked["next"] == self.sizes.rare, 0, np.minimum(np.round(-np.log2(np.maximum(self.p[pick], 1e-300)) * _FINE), 65535)).astype(np.uint16)
        cuts = np.searchsorted(asked["owner"], np.arange(self.sizes.owners + 1))
        some, body = np.flatnonzero(np.diff(cuts)), []
        for k in some:
            x = slice(cuts[k], cuts[k + 1])
            mine, n = pick[x], length[x]
            columns = _steps(s[mine - 1], s[mine - 2])
            columns += [s[mine[n >= j] - j].astype(np.uint64) for j in range(3, DEPTH + 1)]
            body.append([_zip(n.astype(np.uint8)), _zip(asked["next"][x].astype(np.uint64)), _zip(fine[x]), _zip(counts[x]), *map(_zip, columns)])
        return _batch(owner=some.tolist(), shard=[shard] * len(some), body=body)

    def all_before(self) -> None:
        """Mixes in all longer contexts."""
        live, place, asked = self.longer()
        if len(live):
            times = np.concatenate([_unzip(x["body"][0], np.int16) for x in self.parts[2]])
            self.p[live] *= 2.0 ** (times[place] / _FACTORS)


def _owner(hashes: np.ndarray, owners: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - int(np.log2(owners)))).astype(np.int64) if owners > 1 else np.zeros(len(hashes), np.int64)


def _steps(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Sorted pairs of numbers as differences, of b within equal a."""
    step = np.diff(a, prepend=-1)
    return [step, np.where(step > 0, b, np.diff(b, prepend=0))]


def _pairs(step: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What _steps was given."""
    total, starts = np.cumsum(b), np.flatnonzero(step > 0)
    before = total[starts] - b[starts]
    return np.cumsum(step) - 1, total - np.repeat(before, np.diff(np.append(starts, len(b))))


def _kept(node: np.ndarray, n: np.ndarray, above: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
    """For each context the occurrences of next symbols that have a probability of their own after it, 0 if it isn't kept:
    it is if the log likelihood that its next symbols gain over the suffix's distribution exceeds half a log of its count
    for each of them."""
    some = n >= LEAST_COUNT
    node, n, above = node[some], n[some].astype(float), above[some]
    gain = np.bincount(node, n * np.log(np.maximum(n / times[node], 1e-12) / np.maximum(above, 1e-300)), size)
    kinds = np.bincount(node, minlength=size)
    mass = np.bincount(node, n, size)
    return np.where((kinds > 0) & (gain > 0.5 * kinds * np.log(np.maximum(times, 2))), mass, 0.0)


def _answer_pairs(table: pa.Table, sizes: Sizes) -> pa.Table:
    """For each message how often its pairs are in training texts, and for each of its contexts the mass (see _kept)."""
    asked = _group(table)
    keys = [np.cumsum(_unzip(x["body"][0], np.int64)) << np.int64(sizes.bits) | _unzip(x["body"][1], np.int64) for x in asked]
    different, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate([_unzip(x["body"][2], np.uint32) for x in asked]), len(different)).astype(np.int64)
    contexts, node = np.unique(different >> sizes.bits, return_inverse=True)
    times = np.bincount(node, total, len(contexts))
    mass = _kept(node, total, sizes.likely(different & ((1 << sizes.bits) - 1)), times, len(contexts)).astype(np.int64)
    out, at = [], 0
    for x in keys:
        mine = place[at : at + len(x)]
        out.append([_zip(total[mine].astype(np.uint32)), _zip(mass[node[mine[np.diff(x >> sizes.bits, prepend=-1) != 0]]])])
        at += len(x)
    return pa.Table.from_batches([_batch(shard=[x["shard"] for x in asked], owner=[x["owner"] for x in asked], round=[1] * len(asked), body=out)])


def _answer_longer(table: pa.Table, sizes: Sizes) -> pa.Table:
    """For each message by what factor the longer contexts change the probability of each question's next symbol."""
    asked = _group(table)
    read = lambda k, kind: [_unzip(x["body"][k], kind) for x in asked]
    lengths = read(0, np.uint8)
    length = np.concatenate(lengths).astype(np.int64)
    follows, counts = np.concatenate(read(1, np.int64)), np.concatenate(read(3, np.uint32)).astype(float)
    rare = follows == sizes.rare
    start = np.where(rare, 1.0, 2.0 ** (-np.concatenate(read(2, np.uint16)).astype(float) / _FINE))
    p, bits = start.copy(), np.int64(sizes.bits)
    pair = np.concatenate([a << bits | b for a, b in map(_pairs, read(4, np.int64), read(5, np.int64))])
    live, node = np.arange(len(p)), np.unique(pair, return_inverse=True)[1]
    for d in range(2, DEPTH + 1):
        if d > 2:
            symbol = np.concatenate(read(d + 3, np.int64))  # of the questions of this length or more, in order
            more = np.zeros(len(p), np.int64)
            more[length >= d] = symbol
            some = length[live] >= d
            live = live[some]
            node = np.unique(node[some] << bits | more[live], return_inverse=True)[1]
        if not len(live):
            break
        times = np.bincount(node, counts[live])
        some = times[node] >= LEAST_COUNT
        live, node = live[some], node[some]
        if not len(live):
            break
        different, place = np.unique(node << bits | follows[live], return_inverse=True)
        n = np.bincount(place, counts[live], len(different))
        n[(different & sizes.rare) == sizes.rare] = 0
        above = np.ones(len(different))
        above[place] = p[live]
        mass = _kept(different >> bits, n, above, times, len(times))
        own = np.where(n >= LEAST_COUNT, n, 0.0)[place] / (times[node] + SMOOTHING)
        rest = (times[node] - mass[node] + SMOOTHING) / (times[node] + SMOOTHING)
        p[live] = np.where(mass[node] > 0, own + rest * p[live], p[live])
    factors = np.round(np.log2(p / start) * _FACTORS).clip(-32768, 32767).astype(np.int16)
    out = np.split(factors, np.cumsum([len(x) for x in lengths])[:-1])
    return pa.Table.from_batches([_batch(shard=[x["shard"] for x in asked], owner=[x["owner"] for x in asked], round=[2] * len(asked), body=[[_zip(x)] for x in out])])


def score(docs: DataFrame, learns: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_tokens (blank-separated words with A-Z read as a-z, and an end), n_known (those that
    a training text has), train_tokens, base_score (log10 probability under add-one unigrams) and score (under the tree).

    Learns from the rows for which `learns` holds (null: no). Null texts are empty and have one token, the end. Repeated
    rows are learnt from each time and all scored. Without training tokens both scores are 0. Other columns aren't read;
    an empty table gives no rows.
    """
    store = shards(docs, learns, id_col=id_col, text_col=text_col)
    answers, sizes = _word_counts(store)
    if 2 * sizes.bits > 63:
        raise ValueError("too many symbols to number pairs of")
    shared = docs.sparkSession.sparkContext.broadcast(sizes)

    def joined(*drop: str) -> DataFrame:
        parts = answers.groupBy("shard").agg(F.collect_list(F.struct("owner", "round", "body")).alias("parts"))
        return store.drop(*drop).hint("merge").join(parts, "shard")

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield _Walk(row, shared.value).ask_pairs(row["shard"])

    def ask_longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            walk = _Walk(row, shared.value)
            walk.one_before()
            yield walk.ask_longer(row["shard"])

    def answered(answer: Callable[[pa.Table, Sizes], pa.Table]) -> Callable[[pa.Table], pa.Table]:
        return lambda table: answer(table, shared.value)

    def answers_to(ask: Callable, answer: Callable) -> DataFrame:
        asked = joined("ids").mapInArrow(ask, _MESSAGE).repartition(max(shuffle_partitions(docs.sparkSession), sizes.owners), "owner")
        return asked.groupBy("owner").applyInArrow(answered(answer), _ANSWER)

    answers = answers.unionByName(written(answers_to(ask_pairs, _answer_pairs), "pairs"))
    answers = answers.unionByName(answers_to(ask_longer, _answer_longer))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            walk = _Walk(row, shared.value)
            walk.one_before()
            walk.all_before()
            tokens, base = walk.tokens, walk.base
            inner = np.where(walk.number == 0, np.log10(base) - np.log10(walk.sizes.other), 0.0)
            found = np.log10(np.maximum(walk.p, 1e-300)) + inner[tokens]
            at = walk.shard.first[:-1]
            yield pa.RecordBatch.from_arrays(
                [row["ids"], pa.array(np.diff(walk.shard.first)), pa.array(np.add.reduceat((walk.total > 0)[tokens].astype(np.int64), at)), pa.array([walk.sizes.n_tokens] * len(at), pa.int64()), pa.array(np.add.reduceat(np.log10(base)[tokens], at)), pa.array(np.add.reduceat(found, at))],
                ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    out = joined().mapInArrow(run, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
