"""Token counts of a unigram tokenizer without its tokens.

Aho-Corasick enumerates the vocabulary's pieces in a word; dynamic programming carries the best score and the number of
pieces to each position. The tokenizer is a Unigram model with byte fallback over the pieces and scores of a vocabulary
file, after splitting a text into words at spaces: a word begins with U+2581, which stands for the space before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import carried, fresh, rows_of

#: The public vocabulary that the query uses; a parameter of every function that needs one.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What an unknown character scores below the least piece.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker keeps; then it begins anew. Longer words are counted each time.
MOST_WORDS, LONGEST_WORD = 400_000, 64


def load(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """The pieces of a SentencePiece file that stand for text, and their scores; other pieces (control, byte) are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not any(f(i) for f in odd)]


@dataclass
class Counter:
    """Counts pieces. It's sent to workers as its vocabulary and builds the automaton where it's used."""

    vocabulary: list[tuple[str, float]]
    _known: dict = field(default_factory=dict, repr=False)
    _machine: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for piece, score in self.vocabulary:
                self._machine.add_word(piece, (len(piece), score))
            self._machine.make_automaton()
            self._unknown = min((s for _, s in self.vocabulary), default=0.0) - UNKNOWN_PENALTY
        return self._machine

    def pieces(self, word: str) -> int:
        """Pieces of one word on the path of the best score. Of equal scores to a position the path whose last piece is
        longest stays, as in the tokenizer; a character that is no piece costs the unknown score and counts its bytes."""
        if not word:
            return 0
        machine, n = self.machine(), len(word)
        best, count, at = [0.0] * (n + 1), [0] * (n + 1), 1
        found = machine.iter(word)
        end, (length, score) = next(found, (n, (0, 0.0)))
        while at <= n:
            top, pieces, single = None, 0, False
            while end == at - 1:  # pieces that end here, the longest first
                start = at - length
                total = best[start] + score
                if top is None or total > top:
                    top, pieces = total, count[start] + 1
                single = single or length == 1
                end, (length, score) = next(found, (n, (0, 0.0)))
            if not single and (top is None or best[at - 1] + self._unknown > top):
                top, pieces = best[at - 1] + self._unknown, count[at - 1] + len(word[at - 1].encode("utf-8", "surrogatepass"))
            best[at], count[at] = top, pieces
            at += 1
        return count[n]

    def count(self, text: str) -> int:
        """Pieces of a whole text. Words repeat, so the counts of short ones are kept."""
        if not text:
            return 0
        known = self._known
        if len(known) > MOST_WORDS:
            known.clear()
        total = 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:  # a text that begins with a space gets no second one
            words = words[1:]
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.pieces(SPACE + word)
                if len(word) <= LONGEST_WORD and len(known) <= 2 * MOST_WORDS:
                    known[word] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], *, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The given columns (all, if none are given) of every row and n_tokens, the number of pieces of the whole text.

    Null and empty texts have 0 tokens. An input column n_tokens is replaced. Rows stay where they were read; a worker
    holds the automaton and a bounded table of words.
    """
    names = carried(docs, columns, "n_tokens")
    schema = docs.select(*names).schema.add("n_tokens", "long")
    shared = docs.sparkSession.sparkContext.broadcast(Counter(vocabulary))
    reads = text_col if text_col in names else fresh(docs, "text read")[0]
    source = docs.select(*names, *([] if text_col in names else [F.col(text_col).cast("string").alias(reads)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for batch in batches:
            n = [0 if not t.is_valid else counter.count(t.as_py()) for t in rows_of(batch, reads)]
            yield pa.RecordBatch.from_arrays([*(rows_of(batch, c) for c in names), pa.array(n, pa.int64())], [*names, "n_tokens"])

    return source.mapInArrow(run, schema)
