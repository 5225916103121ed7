"""Counting the pieces of a best unigram segmentation, without building it.

An Aho-Corasick automaton lists every vocabulary match of a text by its end. For each end only the best score and the
number of pieces on the way to it are carried (a Viterbi pass without back pointers). Matches at one end come
longest first and replace the best so far only if they score strictly more, which is the tie rule of
unigram tokenizers: of equal paths the one whose last piece begins earliest stays. A character without a piece of
its own scores ``lowest score - 10``; with byte fallback it counts as its UTF-8 bytes, else a run of them counts
as one unknown piece.

Scores are summed as IEEE doubles. Where all scores are whole numbers, as here, sums are exact and a text may be cut where no
piece reaches across (in front of a space mark that follows another character), so repeated words cost one look-up.
Scores that are not whole are summed over the whole text without cuts, for rounding depends on the sum so far.

The vocabulary comes from a SentencePiece model file: its normal pieces with their scores. Spaces become the space mark, one
more is put in front. Null and empty texts have no piece and score 0.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .sentencepieces import BYTE, MARK, NORMAL, PieceFile, local_file

UNKNOWN_PENALTY = 10.0
KEPT = 400_000
LONGEST_KEPT = 64


class UnigramCounter:
    def __init__(self, pieces: dict[str, float], byte_fallback: bool, prefix: str = MARK):
        if not pieces or "" in pieces:
            raise ValueError("the vocabulary needs pieces, none of them empty")
        self.scores = list(pieces.values())
        self.unknown = min(self.scores) - UNKNOWN_PENALTY
        self.bytes = byte_fallback
        self.prefix = prefix
        self.single = {p for p in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        whole = all(float(s).is_integer() for s in self.scores)
        self.cuts = whole and byte_fallback and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.newline_cuts = self.cuts and not any("\n" in p for p in pieces)
        self.units = _Units(self)

    def span(self, s: str) -> tuple[float, int]:
        """(score, pieces) of the best path through ``s``."""
        n = len(s)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        alone: list[bool] = [False] * n  # this character is an unknown piece on the best path
        single, done = self.single, 0

        def unknowns(upto: int) -> None:
            """Ends up to ``upto`` whose last character has no piece: the unknown piece comes last of all."""
            nonlocal done
            for e in range(done + 1, upto + 1):
                if (c := s[e - 1]) not in single and (best[e] is None or best[e - 1] + self.unknown > best[e]):
                    best[e] = best[e - 1] + self.unknown
                    if self.bytes:
                        count[e] = count[e - 1] + len(c.encode())
                    else:
                        count[e] = count[e - 1] + (0 if e > 1 and alone[e - 2] else 1)
                        alone[e - 1] = True
            done = max(done, upto)

        for end, (k, score) in self.automaton.iter(s):
            end += 1
            if end - 1 > done:
                unknowns(end - 1)
            x = best[end - k] + score
            if best[end] is None or x > best[end]:
                best[end], count[end] = x, count[end - k] + 1
        unknowns(n)
        return best[n], count[n]

    def count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        if not self.cuts:
            return self.span(self.prefix + text.replace(" ", MARK))
        score, n = 0.0, 0
        for s, k in map(self.units.__getitem__, self.keys(text)):
            score += s
            n += k
        return score, n

    def keys(self, text: str) -> list[str]:
        if self.newline_cuts and self.prefix and MARK not in text:
            keys = text.replace("\n", " \n").split(" ")
            if "" not in keys and keys[0][0] != "\n":
                return keys
        return _UNITS(self.prefix + text.replace(" ", MARK))

    def key_unit(self, key: str) -> str:
        """Keys are whole units, but for words with one mark in front, which have lost it."""
        return key if not self.prefix or key[0] in (MARK, "\n") else MARK + key


_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall


class _Units(dict):
    def __init__(self, counter: UnigramCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, key: str) -> tuple[float, int]:
        got = self.counter.span(self.counter.key_unit(key))
        if len(key) <= LONGEST_KEPT:
            if len(self) >= KEPT:
                self.clear()
            self[key] = got
        return got


@lru_cache(maxsize=4)
def counter(path: str) -> UnigramCounter:
    with open(path, "rb") as f:
        m = PieceFile(f.read())
    return UnigramCounter(
        {p: s for p, s, k in m.pieces if k == NORMAL},
        m.byte_fallback and sum(k == BYTE for _, _, k in m.pieces) == 256,
        MARK if m.dummy_prefix else "",
    )


def count_tokens(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score) for every row of ``df``: pieces of the best segmentation and its score.

    A narrow map without a shuffle; memory holds a batch, one text's scores and the bounded table of words.
    Repeated and null ids stay as they are; null and empty texts give 0 and 0.0.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def start():
        c = counter(local_file(model))

        def batch(ids, texts):
            got = [c.count(t) for t in texts]
            return [ids, [k for _, k in got], [s for s, _ in got]]

        return batch

    return map_rows(
        df.select(F.col(id_col), F.col(text_col).cast("string")), f"`{id_col}` {id_type}, n_tokens bigint, score double", start
    )
