"""Language identification: script ranges, per-word scores, and Viterbi spans with a switching penalty.

A model holds, for each language of the labelled rows, smoothed log frequencies of the letter 1- to 3-grams of words (hashed to a fixed
number of buckets) and the scripts its letters belong to. A word's scores are the sums over its n-grams; languages never seen with the script of
most of the word's letters are out. A text is then labelled word by word with the sequence of languages whose summed scores, less
a penalty for each change of language, are highest. Texts whose best single language no stretch of words argues against by more than the
penalty need no Viterbi pass: one running minimum shows that their path never leaves it.

The model is fitted on about ``sample_rows`` different labelled rows at most (a documented bound: rows are chosen by a hash, whole texts are used) and on their MOST_LANGUAGES most frequent
labels; its size depends on buckets and languages only, so it is small enough to be broadcast. Predictions read whole texts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, map_rows, sampled, saved

BUCKETS = 1 << 15
SAMPLE_ROWS = 20_000
#: Labels that are learnt, at most: a column of odd labels cannot make the model large.
MOST_LANGUAGES = 256
#: A change of language costs as much as this difference in log likelihood.
SWITCH = 12.0
SMOOTHING = 0.05
#: A script belongs to a language if it has this share of its letters.
SCRIPT_SHARE = 0.002
OUT = -60.0
UNKNOWN = "und"
KEPT = 400_000
LONGEST_WORD = 64

# First code points of the blocks of common scripts.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0x3130, "Hangul"), (0x31F0, "Kana"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFF00, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = [s for s, _ in SCRIPTS]


def script_of(c: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(c)) - 1][1]


_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and the number of its script."""
    if not _tables:
        _tables["letter"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        ends = [*_STARTS[1:], 0x110000]
        _tables["script"] = np.concatenate([np.full(e - s, SCRIPT_NAMES.index(n), np.uint8) for (s, n), e in zip(SCRIPTS, ends, strict=True)])
    return _tables["letter"], _tables["script"]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lower-case words: buckets of their n-grams (a row a character, -1: none), where each word begins, its letters and its script (-1: no letter)."""
    letter, script = _letters()
    code = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letter[code]
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.cumsum(size) - size
    c = np.where(is_letter, code, 1).astype(np.uint64)  # whatever is no letter is a boundary
    one = np.concatenate([np.ones(2, np.uint64), c])
    ok = np.concatenate([[False, False], is_letter])
    out = np.full((len(code), 3), -1, np.int64)
    h = one * np.uint64(0x9E3779B97F4A7C15)
    mix = lambda x: ((x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % BUCKETS
    out[:, 0] = np.where(ok[2:], mix(h[2:]), -1)
    two = (h[1:-1] + np.uint64(7)) * np.uint64(0xBF58476D1CE4E5B9) ^ h[2:]
    out[:, 1] = np.where(ok[1:-1] | ok[2:], mix(two), -1)
    three = (((h[:-2] + np.uint64(11)) * np.uint64(0x94D049BB133111EB)) ^ h[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) ^ h[2:]
    out[:, 2] = np.where(ok[1:-1] & (ok[:-2] | ok[2:]), mix(three), -1)
    n = np.add.reduceat(is_letter.astype(np.int64), first) if len(words) else np.zeros(0, np.int64)
    # letters by word and script: the script of most of them, of equals the first by name
    word, kinds = np.repeat(np.arange(len(words)), size), len(SCRIPT_NAMES)
    held = np.bincount(word[is_letter] * kinds + script[code[is_letter]], minlength=len(words) * kinds).reshape(len(words), kinds)
    return out, first, n, np.where(n > 0, held.argmax(1), -1)


def words_of(text: str) -> list[str]:
    """Lower-case words between white space; longer ones in pieces."""
    ws = text.lower().split()
    if len(text) > LONGEST_WORD and max(map(len, ws), default=0) > LONGEST_WORD:
        ws = [w[k : k + LONGEST_WORD] for w in ws for k in range(0, len(w), LONGEST_WORD)]
    return ws


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language
    allowed: np.ndarray  # script x language
    switch: float = SWITCH
    usual: np.ndarray | None = None  # log likelihood of a letter in the training rows of each language

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores by language, letters, fit) of words.

        The fit is the log likelihood above what as many letters usually have, in the language where it is highest of those that use the word's script; nan if none does.
        """
        g, first, n, script = grams(words)
        w = np.vstack([self.weights, np.zeros(len(self.languages))])
        s = np.add.reduceat(w[g[:, 0]] + w[g[:, 1]] + w[g[:, 2]], first, axis=0)
        s[n == 0] = 0
        mask = self.allowed[np.maximum(script, 0)] & (n > 0)[:, None]
        some = mask.any(1)
        usual = np.zeros(len(self.languages)) if self.usual is None else self.usual
        fits = np.where(some, np.where(mask, s - usual * n[:, None], -np.inf).max(1), np.nan)
        s[some] = np.where(mask[some], s[some] - np.where(mask[some], s[some], -np.inf).max(1, keepdims=True), OUT)
        s[~some] = 0
        return np.maximum(s, OUT), n, fits


class Labeller:
    """Applies a model to batches of texts; keeps the scores of words it has met."""

    def __init__(self, model: Model):
        self.m = model
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))
        self.letters = np.zeros(0, np.int64)
        self.fit = np.zeros(0)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > KEPT:
            self.place.clear()
            self.scores, self.letters, self.fit, new = self.scores[:0], self.letters[:0], self.fit[:0], list(words)
        if new:
            s, n, fits = self.m.score(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.scores, self.letters, self.fit = np.vstack([self.scores, s]), np.concatenate([self.letters, n]), np.concatenate([self.fit, fits])

    def places(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Where the words of each text are in the tables of scores, letters and fits."""
        self.learn({w for ws in texts for w in ws})
        return [np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws)) for ws in texts]

    def paths(self, texts: list[list[str]], at: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: languages' numbers by word, letters by word, summed scores by language."""
        at = self.places(texts) if at is None else at
        out: list = [None] * len(texts)
        hard = []
        for k, i in enumerate(at):
            s = self.scores[i]
            total = s.sum(0)
            best = int(total.argmax())
            out[k] = [np.full(len(i), best), self.letters[i], total]
            if len(i) > 1 and s.shape[1] > 1:
                gain = np.delete(s, best, 1).max(1) - s[:, best]
                run = np.cumsum(gain)
                if (run - np.minimum(np.minimum.accumulate(np.concatenate([[0.0], run[:-1]])), 0)).max() > self.m.switch:
                    hard.append(k)
        for k, path in zip(hard, self.viterbi([self.scores[at[k]] for k in hard]), strict=True):
            out[k][0] = path
        return out

    def viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best label sequences, all texts in step, the longest first."""
        if not scores:
            return []
        order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
        size = np.array([len(scores[k]) for k in order])
        first = np.cumsum(size) - size
        s = np.concatenate([scores[k] for k in order])
        came = np.zeros(s.shape, np.int16)
        own = np.arange(s.shape[1])
        best = s[first].copy()
        left = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts with more than t words
        for t in range(1, size[0]):
            m = left[t]
            v = best[:m]
            top = v.argmax(1)
            moved = v[np.arange(m), top] - self.m.switch
            change = v < moved[:, None]
            came[first[:m] + t] = np.where(change, top[:, None], own)
            best[:m] = np.where(change, moved[:, None], v) + s[first[:m] + t]
        out: list = [None] * len(scores)
        last = best.argmax(1)
        for k, (f, n, state) in enumerate(zip(first.tolist(), size.tolist(), last.tolist(), strict=True)):
            path = np.empty(n, np.int64)
            steps = came[f : f + n]
            t = n - 1
            changed = np.flatnonzero((steps != own).any(1))
            for u in changed[::-1].tolist():
                if u and steps[u, state] != state:
                    path[u : t + 1] = state
                    t, state = u - 1, int(steps[u, state])
            path[: t + 1] = state
            out[order[k]] = path
        return out

    def predict(self, text_words: list[list[str]], at: list[np.ndarray] | None = None) -> list[tuple[str, float]]:
        """Language with most letters over the whole text (of equals the one that scores best, then the first by name), and a score:
        its share of the letters times its posterior probability over the text as a whole."""
        if not self.m.languages:
            return [(UNKNOWN, 0.0)] * len(text_words)
        out = []
        for path, letters, total in self.paths(text_words, at):
            n = letters.sum()
            if not n:
                out.append((UNKNOWN, 0.0))
                continue
            share = np.bincount(path, letters, len(self.m.languages))
            best = max(range(len(share)), key=lambda k: (share[k], total[k], -k))
            rest = share > 0
            p = np.exp(total - total.max())
            p = p[best] / p.sum() if rest.sum() == 1 else 1.0
            out.append((self.m.languages[best], float(min(1.0, share[best] / n * p))))
        return out

    def fits(self, at: list[np.ndarray]) -> list[tuple[float, float | None]]:
        """For the places of each text's words: share of the letters that are in words whose script some language uses, and the mean fit of these letters (None without any)."""
        if not self.m.languages:
            return [(0.0, None)] * len(at)
        fit, letters = np.nan_to_num(self.fit), self.letters
        known = np.where(np.isnan(self.fit), 0, letters)
        out = []
        for i in at:
            n = int(known[i].sum())
            out.append((n / int(letters[i].sum()), float(fit[i].sum() / n)) if n else (0.0, None))
        return out


def spans(path: np.ndarray, letters: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of words with one language: first word, number of words, language, letters."""
    cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [{"word": a, "words": b - a, "lang": languages[path[a]], "letters": int(letters[a:b].sum())} for a, b in zip(cut, cut[1:], strict=False) if b > a]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, switch: float = SWITCH, tasks: int = 8) -> Model:
    """A model of rows with a text and a language, from about ``sample_rows`` different ones at most, chosen by a hash of id, text and label.

    What reaches the driver are sums by language and bucket. Without any row the model has no language and labels everything ``und``.
    """
    df = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    df = sampled(df.where("text is not null and lang is not null"), sample_rows)
    bound_batches(df.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, w in words.items():
                total = seen.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES)))
                if not w:
                    continue
                g, first, letters, script = grams(list(w))
                times = np.fromiter(w.values(), np.float64, len(w))
                by_char = np.repeat(times, np.diff(np.append(first, len(g))))
                for k in range(3):
                    on = g[:, k] >= 0
                    total[:BUCKETS] += np.bincount(g[on, k], by_char[on], BUCKETS)
                on = script >= 0
                total[BUCKETS:] += np.bincount(script[on], (times * letters)[on], len(SCRIPT_NAMES))
        for lang, total in seen.items():
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on), pa.string()), pa.array(on, pa.int32()), pa.array(total[on])], schema=schema)

    sums = saved(df.select("text", "lang").repartition(tasks).mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "languages")
    most = sums.where(F.col("bucket") >= BUCKETS).groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    learnt = [r["lang"] for r in most.collect()]
    table, sums = sums, sums.where(F.col("lang").isin(learnt)).toArrow()
    discard(table)
    languages = sorted(set(sums["lang"].to_pylist()))
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    number = {x: i for i, x in enumerate(languages)}
    if languages:
        counts[sums["bucket"].to_numpy(), [number[x] for x in sums["lang"].to_pylist()]] = sums["n"].to_numpy()
    seen, script = counts[:BUCKETS] + SMOOTHING, counts[BUCKETS:]
    weights, letters = np.log(seen / seen.sum(0)), np.maximum(script.sum(0), 1)
    return Model(languages, weights, script >= SCRIPT_SHARE * letters, switch, (counts[:BUCKETS] * weights).sum(0) / letters)


def identify(df: DataFrame, model: Model, keep: dict[str, Column] | None = None, text_col: str = "text", with_spans: bool = False, with_fit: bool = False) -> DataFrame:
    """Columns ``keep`` of every row of ``df`` with ``lang_pred``, ``score`` and, if wanted, ``spans`` and ``known`` and ``fit`` (see :meth:`Labeller.fits`).

    The score compares the languages with each other, so it is 1/L at least, whatever the text; ``known`` and ``fit`` tell whether any of them fits.
    ``und`` with score 0 for null texts and texts without a letter. A narrow map: no shuffle. Repeated rows get equal results.
    """
    keep = keep or {"doc_id": F.col("doc_id")}
    rows = df.select(*(c.alias(n) for n, c in keep.items()), F.col(text_col).cast("string").alias("__text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", lang_pred string, score double"
    if with_spans:
        ddl += ", spans array<struct<word: int, words: int, lang: string, letters: int>>"
    if with_fit:
        ddl += ", known double, fit double"

    sent = df.sparkSession.sparkContext.broadcast(model)  # buckets x languages, both bounded

    def start():
        lab = Labeller(sent.value)

        def batch(*cols):
            texts = [words_of(t) if t else [] for t in cols[-1]]
            model = lab.m
            at = lab.places(texts) if model.languages else [np.zeros(0, np.int64)] * len(texts)
            got = lab.predict(texts, at)
            out = [*cols[:-1], [g[0] for g in got], [g[1] for g in got]]
            if with_spans:
                out.append([spans(p, n, model.languages) for p, n, _ in lab.paths(texts, at)] if model.languages else [[] for _ in texts])
            if with_fit:
                fits = lab.fits(at)
                out += [[f[0] for f in fits], [f[1] for f in fits]]
            return out

        return batch

    return map_rows(rows, ddl, start)
