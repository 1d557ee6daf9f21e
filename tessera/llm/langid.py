"""Language identification with error-correcting output codes.

Every language has a codeword; for each bit of the codewords a logistic classifier over character n-grams is fitted. A
text's margins are decoded to the codeword of least weighted loss; a narrow lead over the next one is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as tx
from tessera.llm._store import carried, fresh, rows_of

#: The fit uses about so many labelled rows at most, evenly from the languages: this bound is a parameter of train().
SAMPLE_ROWS = 3000
#: Hashed byte trigrams beside the 256 single bytes.
TRIGRAMS = 4096
UNKNOWN = "und"
#: Texts whose two nearest codewords differ by less in weighted loss per unit of weight are flagged: at least this, and
#: this share of the gap that all but one in a thousand of the rows learnt from have.
LEAST_GAP, GAP_SHARE = 0.05, 0.5
_ROWS = 2048


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows from, to, and for each the square roots of its n-gram frequencies over the whole lower-cased text."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    for low, high, data, offsets in tx.chunks(column):
        grams = np.zeros(0, np.uint32)
        if len(data) > 2:
            wide = data.astype(np.uint32)
            grams = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)) >> np.uint32(20)
        for at in range(0, high - low, _ROWS):
            to = min(high - low, at + _ROWS)
            x = np.zeros((to - at, TRIGRAMS + 256), np.float32)
            for i in range(at, to):
                s, e = offsets[i], offsets[i + 1]
                if e - s > 2:
                    x[i - at, :TRIGRAMS] = np.bincount(grams[s : e - 2], minlength=TRIGRAMS)
                if e > s:
                    x[i - at, TRIGRAMS:] = np.bincount(data[s:e], minlength=256)
            x /= np.maximum(x.sum(1, keepdims=True), 1)
            yield low + at, low + to, np.sqrt(x)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1: the exhaustive code for up to 7 languages, else random rows with a large least distance."""
    if k < 2:
        return np.ones((k, 0), np.float32)
    if k <= 7:
        columns = np.arange(1, 1 << (k - 1))
        return (((columns[None, :] >> np.arange(k)[:, None]) & 1) * 2 - 1).astype(np.float32)
    bits, random, best, distance = int(np.ceil(12 * np.log2(k))), np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = random.integers(0, 2, (k, bits)) * 2 - 1
        least = (bits - (code @ code.T - 2 * bits * np.eye(k, dtype=int)).max()) // 2
        if least > distance:
            best, distance = code, least
    return best.astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray  #: weight of each bit's loss: log odds that its classifier was right in training
    least_gap: float = LEAST_GAP

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights + self.bias
        return (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(2)

    def gaps(self, loss: np.ndarray) -> np.ndarray:
        two = np.partition(loss, 1, axis=1)
        return (two[:, 1] - two[:, 0]) / self.trust.sum()

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the language's index, a score from 0 to 1, and whether a second codeword is about as near."""
        if len(self.languages) < 2:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        loss = self.losses(x)
        odds = np.exp(-(loss - loss.min(1, keepdims=True)))
        return loss.argmin(1), (odds.max(1) / odds.sum(1)).astype(float), self.gaps(loss) < self.least_gap


def fit(x: np.ndarray, labels: list[str], steps: int = 200, penalty: float = 1e-5) -> Model:
    """One logistic classifier for each bit, by accelerated gradient descent from zero: equal inputs, equal model."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    index = np.searchsorted(np.array(languages), np.array(labels))
    y = code[index]
    share = 1 / np.bincount(index)[index] / len(languages)
    mean = x.mean(0)
    z = x - mean
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    if y.shape[1]:
        vw, vb, rate = np.zeros_like(w), np.zeros_like(b), 4 / max(float((z * z).sum(1).max()), 1e-6)
        for _ in range(steps):
            g = (-y / (1 + np.exp(np.clip(y * (z @ (w + 0.9 * vw) + b + 0.9 * vb), -30, 30))) * share[:, None]).astype(np.float32)
            vw, vb = 0.9 * vw - rate * (z.T @ g + penalty * w), 0.9 * vb - rate * g.sum(0)
            w, b = w + vw, b + vb
        b = b - mean @ w
    wrong = (((x @ w + b) * y <= 0) * share[:, None]).sum(0)
    model = Model(languages, code, w.astype(np.float32), b.astype(np.float32), np.log((1 - wrong + 1e-3) / (wrong + 1e-3)).clip(0.05).astype(np.float32))
    if y.shape[1]:
        loss = model.losses(x)
        right = loss.argmin(1) == index
        if right.any():
            model.least_gap = max(LEAST_GAP, GAP_SHARE * float(np.quantile(model.gaps(loss[right]), 0.001)))
    return model


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = rows_of(batch, "lang")
        for low, high, x in features(rows_of(batch, "text")):
            packed = [row.tobytes() for row in x.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([langs.slice(low, high - low), pa.array(packed, pa.binary())], ["lang", "x"])


def train(docs: DataFrame, *, may_learn: Column | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits the classifiers on about `sample_rows` of the rows with a language, a text and an id for which may_learn holds.

    The sample takes from each language the rows whose hashed id is under a share that gives it sample_rows / languages
    rows. The driver gets counts by language and the sample's n-gram frequencies (9 kB a row), whatever the input's size.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), (F.lit(True) if may_learn is None else may_learn).alias("may"))
    rows = rows.where("may and id is not null and text is not null and lang is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], codewords(0), np.zeros((TRIGRAMS + 256, 0), np.float32), np.zeros(0, np.float32), np.zeros(0, np.float32))
    each = sample_rows / len(counts)
    share = F.element_at(F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, each / n)))]), F.col("lang"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(place < share).select("text", "lang").mapInArrow(_pack, "lang string, x binary").toPandas()
    sample = sample.sort_values(["lang", "x"])
    x = np.frombuffer(b"".join(sample["x"]), np.float16).reshape(-1, TRIGRAMS + 256).astype(np.float32)
    return fit(x, sample["lang"].tolist())


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The given columns (all, if none are given) of every row, and lang_pred, score (0 to 1) and ambiguous.

    The whole text is read. Null texts, texts without a letter, and any text if the model knows no language, are `und`
    with score 0. Equal texts get equal results. Input columns called lang_pred, score or ambiguous are replaced.
    """
    names = carried(docs, columns, "lang_pred", "score", "ambiguous")
    reads = text_col if text_col in names else fresh(docs, "text read")[0]
    source = docs.select(*names, *([] if text_col in names else [F.col(text_col).cast("string").alias(reads)]))
    kept = docs.select(*names).schema
    schema = kept.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            text = rows_of(batch, reads).cast(pa.large_string())
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score, flag = np.full(len(text), len(model.languages)), np.zeros(len(text)), np.zeros(len(text), bool)
            if model.languages:
                for low, high, x in features(text):
                    best[low:high], score[low:high], flag[low:high] = model.decode(x)
            best[~lettered], score[~lettered], flag[~lettered] = len(model.languages), 0.0, False
            out = [rows_of(batch, c) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(languages[best], pa.string()), pa.array(score), pa.array(flag)], [*names, "lang_pred", "score", "ambiguous"])

    return source.mapInArrow(run, schema)


def identified(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known: not `und`, nor flagged as between two languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text = rows_of(batch, text_col).cast(pa.large_string())
            keep = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False).copy()
            if model.languages:
                for low, high, x in features(text):
                    keep[low:high] &= ~model.decode(x)[2]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
