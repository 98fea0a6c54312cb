"""Token counts of a unigram vocabulary without making its tokens.

A unigram vocabulary (``Vocabulary``): an Aho-Corasick automaton over the vocabulary enumerates all pieces that end at each character; dynamic
programming carries the best score and its number of pieces. Ties go as in the tokenizer: of equal
scores the path whose last piece starts first wins, and the piece for an unknown character (least
score minus 10) only if it scores strictly more than any piece that ends there. Unknown characters in
a row count as one piece, or, with byte fallback, as one for each of their UTF-8 bytes.

Spaces become U+2581 and one is put before the text. Where no piece has U+2581 after another
character, and it is a piece itself, paths break before each run of it, so segments are counted on
their own and remembered (up to ``REMEMBER``); otherwise whole texts are. This is exact where sums of
scores are (the vocabularies at hand have whole numbers).

``load_pieces`` reads the pieces and scores of a SentencePiece model. Those of a BPE model are ranks of merges, so its best paths are
the tokens of the unigram tokenizer with these pieces, not of the model's merges; ``Model`` counts by the model's own encoder.

Defined cases: null and empty texts have no tokens; repeated rows are counted each; a text without
spaces is one segment, however long.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
REMEMBER = 200_000
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool = False
    least: float = field(default=0.0)


def load_pieces(path: str, byte_fallback: bool = True) -> Vocabulary:
    """The ordinary pieces of a SentencePiece model with the scores in it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Vocabulary(tuple(own), byte_fallback, min(s for _, s in own))


@dataclass(frozen=True)
class Model:
    """A serialized SentencePiece model."""

    proto: bytes


def load_model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


class ModelCounter:
    def __init__(self, model: Model):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model.proto)

    def count(self, text: str | None) -> int:
        return len(self.processor.encode(text)) if text else 0


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.unknown = vocabulary.least - UNKNOWN_PENALTY
        self.byte_fallback = vocabulary.byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.whole = any(MARK in p.lstrip(MARK) for p, _ in vocabulary.pieces) or MARK not in self.single
        self.known: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """Number of pieces of the best path."""
        if not text:
            return 0
        n = len(text)
        best, count, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(text) if len(self.automaton) else iter(())
        ahead = next(matches, None)
        for end in range(1, n + 1):
            score = start = None
            while ahead is not None and ahead[0] == end - 1:
                length, own = ahead[1]
                sum_ = best[end - length] + own
                if score is None or sum_ > score or (sum_ == score and end - length < start):
                    score, start = sum_, end - length
                ahead = next(matches, None)
            if text[end - 1] not in self.single:
                sum_ = best[end - 1] + self.unknown
                if score is None or sum_ > score:
                    best[end], unk[end] = sum_, True
                    if self.byte_fallback:
                        count[end] = count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
                    else:
                        count[end] = count[end - 1] + (not unk[end - 1])
                    continue
            best[end], count[end] = score, count[start] + 1
        return count[n]

    def segment(self, segment: str) -> int:
        found = self.known.get(segment)
        if found is None:
            found = self.viterbi(segment)
            if len(segment) <= 64:
                if len(self.known) >= REMEMBER:
                    self.known.clear()
                self.known[segment] = found
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        flat = MARK + text.replace(" ", MARK)
        if self.whole:
            return self.viterbi(flat)
        return sum(map(self.segment, _SEGMENT.findall(flat)))


def counter(spark: SparkSession, vocabulary: Vocabulary | Model):
    """A UDF of text: its number of tokens. The vocabulary, of a fixed size, is sent to all tasks."""
    sent = spark.sparkContext.broadcast(vocabulary)
    made: list[Counter | ModelCounter] = []

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        if not made:
            made.append(ModelCounter(sent.value) if isinstance(sent.value, Model) else Counter(sent.value))
        return pa.array([made[0].count(t.as_py()) for t in text], pa.int64())

    return count


def count_tokens(docs: DataFrame, vocabulary: Vocabulary | Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every document."""
    return docs.select(F.col(id_col).alias("doc_id"), counter(docs.sparkSession, vocabulary)(F.col(text_col)).alias("n_tokens"))
