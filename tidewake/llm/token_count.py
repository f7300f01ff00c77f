"""Token counts without tokens: the pieces of a unigram vocabulary by Viterbi, keeping only scores and counts.

Aho-Corasick enumerates all vocabulary pieces that end at each character; for each character the best score of a way to
get there and that way's number of pieces are kept, nothing else.  The rules are those of the public unigram tokenizer:
the text gets a leading U+2581 and each space becomes one; the best sum of scores wins, of equal sums the piece that
starts first; a character that is no piece itself costs UNKNOWN below the least score and counts its UTF-8 bytes (byte
fallback).  Where no piece has a U+2581 after another character, segments that start with U+2581 can't influence each
other, so each distinct segment is worked out once per block of texts.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table
from .words import sliced

MARK, UNKNOWN = "▁", 10.0
#: Segments that a task remembers, and the longest of them.
REMEMBERED, LONGEST = 200_000, 40
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a SentencePiece file and their scores (no control, unknown or byte pieces), read on the driver."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


class Counter(dict):
    """segment -> pieces; least is the least score of all pieces of the tokenizer, special ones too."""

    def __init__(self, pieces: list[tuple[str, float]], least: float = 0.0):
        super().__init__()
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min([least, *(s for _, s in pieces)]) - UNKNOWN
        whole = any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.segments = re.compile(".+" if whole else f"{MARK}*[^{MARK}]+|{MARK}+", re.DOTALL).findall

    def __missing__(self, segment: str) -> int:
        n = self.viterbi(segment)
        if len(segment) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = n
        return n

    def viterbi(self, segment: str) -> int:
        score, count = [0.0], [0]
        matches = self.automaton.iter(segment)
        at = next(matches, None)
        for end, char in enumerate(segment):
            best, pieces, start = float("-inf"), 0, end + 1
            while at and at[0] == end:
                size, own = at[1]
                s = end + 1 - size
                total = score[s] + own
                if total > best or total == best and s < start:
                    best, pieces, start = total, count[s] + 1, s
                at = next(matches, None)
            if char not in self.single and score[end] + self.unknown > best:
                best, pieces = score[end] + self.unknown, count[end] + len(char.encode("utf-8", "surrogatepass"))
            score.append(best)
            count.append(pieces)
        return count[-1]

    def pieces(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.segments(MARK + text.replace(" ", MARK))))


def count_tokens(texts: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """texts: any columns and `text` -> the other columns and n_tokens; null and empty texts have 0.

    A column n_tokens of texts is replaced.  Rows don't depend on each other, so repeated rows get equal counts; an empty
    table gives no rows.  A text is worked out whole; beside it a task holds its scores and counts for one segment."""
    texts = texts.drop("n_tokens")
    shared = texts.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary file

    def run(batches):
        counter = Counter(shared.value)
        for t in sliced(batches, 2 << 20):
            n = pa.array([counter.pieces(x.as_py()) for x in t.column("text")], pa.int64())
            yield from t.append_column("n_tokens", n).drop_columns(["text"]).to_batches()

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text"]
    return texts.mapInArrow(run, ", ".join([*rest, "n_tokens long"]))


def op6_token_count(spark, sf_dir: str, model: str = DEFAULT_MODEL) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(model))
