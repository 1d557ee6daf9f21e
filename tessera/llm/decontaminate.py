"""Benchmark decontamination over suffix arrays of the training documents.

Each Arrow batch of documents is a shard. A shard's suffix array orders, by their first words, the positions whose next
two words follow each other in some test item (or whose word is an item by itself); no other position can start a match
of two words or more. Every suffix of every test item is looked up by binary search in each shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as tx
from tessera.llm._store import rows_of

#: Words of a window: a document holds a passage of an item if it has so many consecutive words of it.
WINDOW = 10
#: Bytes of item texts in a block; a test set of more is searched block by block.
BLOCK_BYTES = 4 << 20
#: Bytes of item texts that the driver takes; a test set is small beside the corpus, and beyond this it's an error.
MOST_BYTES = 256 << 20
_KEY = 4


@dataclass
class Items:
    """A block of test items, indexed: the broadcast side of the search."""

    ids: list
    vocabulary: np.ndarray  #: sorted word hashes; word k is number k + 1, 0 is any other word
    tokens: np.ndarray  #: the items' words one after the other, each item followed by 0
    start: np.ndarray  #: where each item starts in tokens
    n_words: np.ndarray
    windows: np.ndarray  #: starts in tokens of the different windows
    width: np.ndarray  #: words of each window
    held: np.ndarray  #: window, item and position in it of all windows of all items, by window
    held_from: np.ndarray  #: where in held each window begins

    @classmethod
    def of(cls, ids: list, texts: list, window: int = WINDOW) -> Items:
        data, offsets = tx.text_buffer(pa.array(texts, pa.large_string()))
        starts, ends, first = tx.spans(data, offsets, tx.ALNUM)
        words = tx.hashes(data, starts, ends)
        vocabulary = np.unique(words)
        n = np.diff(first)
        tokens = np.zeros(len(words) + len(n), np.int64)
        tokens[np.arange(len(words)) + tx.owners(first)] = np.searchsorted(vocabulary, words) + 1
        start = first[:-1] + np.arange(len(n))
        at, width, held, n_seen = [], [], [], 0
        for w in np.unique(np.minimum(n[n > 0], window)):
            some = np.flatnonzero(np.minimum(n, window) == w)
            many = n[some] - w + 1
            item = np.repeat(some, many)
            position = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
            all_at = start[item] + position
            _, index, place = np.unique(tokens[all_at[:, None] + np.arange(w)], axis=0, return_index=True, return_inverse=True)
            at.append(all_at[index])
            width.append(np.full(len(index), w))
            held.append(np.stack([place.ravel() + n_seen, item, position], 1))
            n_seen += len(index)
        held = np.concatenate([np.zeros((0, 3), np.int64), *held])
        held = held[np.argsort(held[:, 0], kind="stable")]
        every = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
        return cls(ids, vocabulary, tokens, start, n, every(at), every(width), held, np.searchsorted(held[:, 0], np.arange(n_seen + 1)))

    def prefix(self, at: np.ndarray, n: int) -> np.ndarray:
        """The n tokens from each position, 0 from the item's end on."""
        ends = np.append(self.start[1:] - 1, len(self.tokens) - 1)
        end = ends[np.searchsorted(self.start, at, "right") - 1]
        index = at[:, None] + np.arange(n)
        return np.where(index < end[:, None], self.tokens[np.minimum(index, len(self.tokens) - 1)], 0)


@dataclass
class Block:
    """Some test items, broadcast as texts; a worker indexes them when it first needs them."""

    ids: list
    texts: list
    window: int
    _items: Items | None = None

    def items(self) -> Items:
        if self._items is None:
            self._items = Items.of(self.ids, self.texts, self.window)
        return self._items


def _member(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which codes are among the sorted wanted ones; a table of bits leaves few to search for."""
    if not len(wanted):
        return np.zeros(len(codes), bool)
    spread = np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros(1 << 20, bool)
    bits[(wanted.astype(np.uint64) * spread) >> np.uint64(44)] = True
    out = bits[(codes.astype(np.uint64) * spread) >> np.uint64(44)]
    some = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(wanted, codes[some]), len(wanted) - 1)
    out[some] = wanted[at] == codes[some]
    return out


class Shard:
    """The suffix array of some documents, over the words of a block of test items."""

    def __init__(self, words: np.ndarray, first: np.ndarray, items: Items) -> None:
        size, n_docs = len(items.vocabulary) + 1, len(first) - 1
        inside = _member(words, items.vocabulary)
        numbers = np.zeros(len(words), np.int64)
        numbers[inside] = np.searchsorted(items.vocabulary, words[inside]) + 1
        self.depth = int(items.n_words.max(initial=1))
        #: words of all documents, each document followed by a 0, and enough of them at the end to read past it
        self.tokens = np.zeros(len(words) + n_docs + self.depth + _KEY, np.int64)
        self.doc_start = first[:-1] + np.arange(n_docs)
        self.tokens[np.arange(len(words)) + tx.owners(first)] = numbers
        pairs = items.tokens[:-1] * size + items.tokens[1:]
        pairs = np.unique(pairs[(items.tokens[:-1] > 0) & (items.tokens[1:] > 0)])
        single = np.unique(items.tokens[items.start[items.n_words == 1]])
        known = np.flatnonzero(self.tokens[: len(words) + n_docs])
        keep = _member(self.tokens[known] * size + self.tokens[known + 1], pairs)
        if len(single):
            keep |= np.isin(self.tokens[known], single)
        self.suffixes = self._sorted(known[keep], size)

    def _sorted(self, at: np.ndarray, size: int) -> np.ndarray:
        """Positions by the words that follow, `depth` of them: sorted by a few words, then ties by the next few."""
        bits = max(1, int(size).bit_length())
        per = min(_KEY, 62 // bits)

        def key(p: np.ndarray, shift: int) -> np.ndarray:
            out = np.zeros(len(p), np.int64)
            for j in range(per):
                out = (out << bits) | self.tokens[np.minimum(p + shift + j, len(self.tokens) - 1)]
            return out

        k = key(at, 0)
        order = np.argsort(k, kind="stable")
        at, k = at[order], k[order]
        group = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])]) if len(at) else k
        last = k & ((1 << bits) - 1)
        for shift in range(per, self.depth, per):
            if not len(at):
                break
            tied = np.zeros(len(at), bool)
            same = group[1:] == group[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            tied &= last > 0  # a key that ends in 0 has met a word of no item: the rest doesn't matter
            some = np.flatnonzero(tied)
            if not len(some):
                break
            k = key(at[some], shift)
            order = np.lexsort((k, group[some]))
            at[some], k = at[some][order], k[order]
            step = np.zeros(len(at), np.int64)
            step[0] = 0
            step[1:] = group[1:] != group[:-1]
            inner = np.flatnonzero((group[some][1:] == group[some][:-1]) & (k[1:] != k[:-1])) + 1
            step[some[inner]] = 1
            group = np.cumsum(step)
            last[some] = k & ((1 << bits) - 1)
        return at

    def _compare(self, at: np.ndarray, patterns: np.ndarray, width: np.ndarray) -> np.ndarray:
        """-1, 0, 1: how the suffixes compare with the first `width` words of the patterns."""
        n = patterns.shape[1]
        have = self.tokens[np.minimum(at[:, None] + np.arange(n), len(self.tokens) - 1)]
        differs = (have != patterns) & (np.arange(n) < width[:, None])
        place = differs.argmax(1)
        rows = np.arange(len(at))
        return np.where(differs.any(1), np.sign(have[rows, place] - patterns[rows, place]), 0)

    def search(self, patterns: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the range of the suffixes that start with it; empty, where it would be, if none does."""
        ends = []
        for bound in (0, 1):
            low = np.zeros(len(patterns), np.int64)
            high = np.full(len(patterns), len(self.suffixes), np.int64)
            while len(some := np.flatnonzero(low < high)):
                middle = (low[some] + high[some]) // 2
                left = self._compare(self.suffixes[middle], patterns[some], width[some]) < bound
                low[some[left]] = middle[left] + 1
                high[some[~left]] = middle[~left]
            ends.append(low)
        return ends[0], ends[1]

    def longest(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pattern (0 after its end) the longest prefix that some document has, in words, and where."""
        best = np.zeros(len(patterns), np.int64)
        where = np.zeros(len(patterns), np.int64)
        if not len(self.suffixes):
            return best, where
        low, _ = self.search(patterns, (patterns > 0).sum(1))
        for neighbour in (low - 1, low):
            at = self.suffixes[np.clip(neighbour, 0, len(self.suffixes) - 1)]
            same = self.tokens[np.minimum(at[:, None] + np.arange(patterns.shape[1]), len(self.tokens) - 1)] == patterns
            same &= patterns > 0
            n = np.where(same.all(1), patterns.shape[1], same.argmin(1))
            best, where = np.maximum(best, n), np.where(n > best, at, where)
        return best, where

    def windows(self, items: Items, step: int = 1 << 14) -> Iterator[tuple[int, np.ndarray]]:
        """Each window of the items that occurs, by its number, and the positions of all its occurrences."""
        if not len(self.suffixes):
            return
        for at in range(0, len(items.windows), step):
            width = items.width[at : at + step]
            patterns = items.prefix(items.windows[at : at + step], int(width.max(initial=1)))
            low, high = self.search(patterns, width)
            for k in np.flatnonzero(high > low):
                yield at + int(k), self.suffixes[low[k] : high[k]]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list:
    """The items in blocks, each broadcast by itself. ValueError beyond MOST_BYTES."""
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("item is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the test items hold {size} bytes; at most {MOST_BYTES} are searched at a time: split them and unite the hits")
    blocks, ids, texts, held = [], [], [], 0
    broadcast = benchmark.sparkSession.sparkContext.broadcast
    for row in items.orderBy("item", "text").toLocalIterator():
        ids.append(row.item)
        texts.append(row.text)
        held += len(row.text)
        if held > BLOCK_BYTES:
            blocks.append(broadcast(Block(ids, texts, window)))
            ids, texts, held = [], [], 0
    if ids:
        blocks.append(broadcast(Block(ids, texts, window)))
    return blocks


def _longest(items: Items, found: list[tuple[int, np.ndarray]], doc_start: np.ndarray) -> Iterator[tuple]:
    """Of each document with occurrences of windows the longest verbatim match with each item: document, words, item,
    position in the document and in the item; of equally long ones the first. Windows that follow each other in both
    texts are one match."""
    at = np.concatenate([np.repeat(x, items.held_from[k + 1] - items.held_from[k]) for k, x in found])
    held = np.concatenate([np.tile(items.held[items.held_from[k] : items.held_from[k + 1]], (len(x), 1)) for k, x in found])
    doc = np.searchsorted(doc_start, at, "right") - 1
    position, item, within = at - doc_start[doc], held[:, 1], held[:, 2]
    order = np.lexsort((position, position - within, item, doc))
    doc, position, item, within, width = doc[order], position[order], item[order], within[order], items.width[held[order, 0]]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(position) != 1) | (np.diff(within) != 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(doc))) + width[first] - 1
    order = np.lexsort((within[first], position[first], -n, item[first], doc[first]))
    first, n = first[order], n[order]
    best = np.ones(len(first), bool)
    best[1:] = (doc[first][1:] != doc[first][:-1]) | (item[first][1:] != item[first][:-1])
    first, n = first[best], n[best]
    yield from zip(doc[first].tolist(), n.tolist(), item[first].tolist(), position[first].tolist(), within[first].tolist(), strict=True)


def _scan(blocks: list, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[dict]]]:
    """Chunk by chunk: rows from, to, their numbers of words and of hit words, and of each the items it holds, by id, with
    (words, position, position in the item) of the longest match."""
    for low, high, data, offsets in tx.chunks(text, 8 << 20):
        starts, ends, first = tx.spans(data, offsets, tx.ALNUM)
        words = tx.hashes(data, starts, ends)
        n_docs = high - low
        hit = np.zeros(len(words) + n_docs + 1, np.int64)
        held: list[dict] = [{} for _ in range(n_docs)]
        doc_start = first[:-1] + np.arange(n_docs)
        for block in blocks:
            items = block.value.items()
            if not len(items.windows):
                continue
            shard = Shard(words, first, items)
            found = list(shard.windows(items))
            for k, at in found:
                np.add.at(hit, at, 1)
                np.add.at(hit, at + items.width[k], -1)
            for doc, *match in _longest(items, found, doc_start) if found else ():
                name, match = str(items.ids[match[1]]), (match[0], match[2], match[3])
                if name not in held[doc] or (-held[doc][name][0], *held[doc][name][1:]) > (-match[0], *match[1:]):
                    held[doc][name] = match
        covered = np.concatenate([[0], np.cumsum(np.cumsum(hit) > 0)])
        bounds = np.append(doc_start, len(words) + n_docs)
        yield low, high, np.diff(first), covered[bounds[1:]] - covered[bounds[:-1]], held


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: its id, n_words, n_hit (words inside an occurrence of a window of an item), items (the ids
    of the items with such windows, as strings in order), contaminated, and its longest verbatim match: match_words, match_item,
    match_position and item_position, in words from 0 (0 and nulls without one; of equally long ones the least item, then
    the first).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z read as a-z; a window is `window` consecutive words of an
    item, or all words of a shorter one. Null and empty texts have no words and aren't contaminated; items without id or
    words match nothing; equal items are all named; repeated documents each get their row; an empty benchmark marks
    nothing. Other columns of either table aren't read. The plan has no shuffle: documents stay where they were read.
    """
    blocks = _blocks(benchmark, item_col, item_text, window)
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = rows_of(batch, "doc")
            for low, high, words, hits, held in _scan(blocks, rows_of(batch, "text")):
                best = [min(((-m[0], name, m[1], m[2]) for name, m in x.items()), default=(0, None, None, None)) for x in held]
                match = [pa.array([-x[0] for x in best], pa.int64()), pa.array([x[1] for x in best], pa.string()), *(pa.array([x[k] for x in best], pa.int64()) for k in (2, 3))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(x) for x in held], pa.list_(pa.string())), pa.array(hits > 0, pa.bool_()), *match],
                    ["doc", "n_words", "n_hit", "items", "contaminated", "match_words", "match_item", "match_position", "item_position"],
                )

    return source.mapInArrow(run, f"doc {kind.simpleString()}, n_words long, n_hit long, items array<string>, contaminated boolean, match_words long, match_item string, match_position long, item_position long").withColumnRenamed("doc", id_col)


def remove(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a hit word (see scan), with all their columns as they were."""
    blocks = _blocks(benchmark, item_col, item_text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for low, high, _, hits, _ in _scan(blocks, rows_of(batch, text_col)):
                keep[low:high] = hits == 0
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, least: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For every suffix of every item (item, position) its longest verbatim match anywhere: match_words (`least` or more),
    doc and doc_position (in words; of several equally long ones the least). Suffixes without a match have no row."""
    blocks = _blocks(benchmark, item_col, item_text, WINDOW)
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    doc_kind, item_kind = source.schema["doc"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = rows_of(batch, "doc")
            for low, _, data, offsets in tx.chunks(rows_of(batch, "text"), 8 << 20):
                starts, ends, first = tx.spans(data, offsets, tx.ALNUM)
                words = tx.hashes(data, starts, ends)
                for block in blocks:
                    items = block.value.items()
                    shard = Shard(words, first, items)
                    all_at = np.flatnonzero(items.tokens)
                    for at in np.array_split(all_at, max(1, len(all_at) * shard.depth >> 22)):
                        n, where = shard.longest(items.prefix(at, shard.depth))
                        some = np.flatnonzero(n >= least)
                        item = np.searchsorted(items.start, at[some], "right") - 1
                        doc = np.searchsorted(shard.doc_start, where[some], "right") - 1
                        yield pa.RecordBatch.from_pydict({
                            "item": [items.ids[i] for i in item], "position": at[some] - items.start[item], "match_words": n[some],
                            "doc": ids.take(pa.array(doc + low)), "doc_position": where[some] - shard.doc_start[doc],
                        })

    found = source.mapInArrow(run, f"item {item_kind}, position long, match_words long, doc {doc_kind}, doc_position long")
    best = F.min(F.struct((-F.col("match_words")).alias("n"), "doc", "doc_position")).alias("best")
    return found.groupBy("item", "position").agg(best).select("item", "position", (-F.col("best.n")).alias("match_words"), "best.doc", "best.doc_position")

