"""Mixing to target weights by soft memberships, with DataFrame functions only.

1. Classifier: a labelled table gives documents a domain. Presence of hashed words in a bounded sample of labelled texts gives
   log lifts by domain, kept where they are significant; they travel as constants of the plan, so predicting is a narrow map.
2. Posteriors are softmax scores in steps of ``1 / STEPS`` (or exact), scaled to sum to one: documents with equal posteriors are one *cell*, and all that
   the fit needs of a cell is its token count. Cells pre-aggregate a table of any size; hot sources or languages do not matter.
3. Rates: the least-squares problem  min |E(r) - targets|  over rates r >= 0, with E(r)[d] = sum of r * tokens * posterior[d], is solved by projected
   gradient steps from r = 1. Distances between totals are measured by the inverse of the Gram matrix of the posteriors. A step is scaled by the Gram matrix of those
   cells that are free to move (their rate is above 0 or would rise), which ends after a few steps, or by that of all cells, in which a step of length one is safe; of a few
   lengths of both the one that brings the totals closest is taken. Each step is two aggregations over the cells; totals and small matrices (domains x domains) are all that
   reaches the driver. Steps go on until the gap to the targets is within the tolerance or shrinks no more, and the gap is reported.
4. A document is taken floor(rate) times, and once more with the probability of the rest, decided by a hash of the document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UNITS, discard, sample_units, saved

BUCKETS = 8192
#: Labelled rows that the classifier is fitted on, at most about: a documented bound.
SAMPLE_ROWS = 20_000
STEPS = 64
#: A lift counts if the presence differs by this many standard deviations.
SIGNIFICANT = 4.0
#: The fit ends if the squared gap is below this share of all tokens, or shrinks by less than a twentieth in each of STALLED steps; ROUNDS only guards against more.
TOLERANCE, STALLED, ROUNDS = 1e-7, 5, 200
#: Lengths that are tried of a step in the free cells' matrix and of one in that of all cells; the first of the latter is safe.
LENGTHS, SAFE = (1.0, 0.5, 0.25, 0.1, 0.03), (1.0, 4.0, 16.0)


def buckets(text: Column) -> Column:
    """Distinct hashed words of a text."""
    return F.array_distinct(F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\n\\t\\r]"), lambda w: w != "")


@dataclass
class Classifier:
    domains: list[str]
    priors: list[float]
    lifts: list[list[float]]  # domain x bucket
    steps: int | None = STEPS

    def posterior(self, text: Column) -> Column:
        """array<double> of domain posteriors, in steps of 1 / ``steps`` (before scaling to sum one) or, with None, as they are."""
        n = len(self.domains)
        tables = [F.split(F.lit(",".join(f"{x:.4f}" for x in row)), ",").cast("array<double>") for row in self.lifts]
        zero = F.struct(*(F.lit(p).alias(f"d{k}") for k, p in enumerate(self.priors)))
        score = F.aggregate(buckets(text), zero, lambda acc, b: F.struct(*((acc[f"d{k}"] + tables[k][b]).alias(f"d{k}") for k in range(n))))
        score = F.transform(F.array(score), lambda s: F.array(*(s[f"d{k}"] for k in range(n))))[0]  # evaluated once
        shifted = F.transform(F.array(score), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))
        share = lambda x, e: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)
        stepped = shifted if self.steps is None else F.transform(shifted, lambda e: F.transform(e, lambda x: F.round(share(x, e) * self.steps)))
        return F.transform(stepped, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]


def fit_classifier(
    df: DataFrame, labels: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, steps: int | None = STEPS, significant: float = SIGNIFICANT
) -> Classifier:
    """A classifier of the domain that ``labels`` (by ``id_col``) gives documents of ``df``.

    Labels without an id or domain are left out, of several labels of a document the first by name counts. Without any labelled text there is one
    domain, named ``all``. The sample of about ``sample_rows`` ids is chosen by a hash of the id and small enough to be broadcast by its bound; it is never empty where
    there are labels. Different texts of one id all count, equal ones once. Lifts of less than ``significant`` deviations are left out (0: none).
    """
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), domain.cast("string").alias("domain")).where("id is not null and domain is not null")
    known = known.groupBy("id").agg(F.min("domain").alias("domain"))
    n = known.count()
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(UNITS)) < sample_units(n, sample_rows))
    seen = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    seen = seen.join(F.broadcast(known), "id").groupBy("id", "domain", F.xxhash64("text")).agg(F.first("text").alias("text"))
    seen = saved(seen.select("domain", buckets(F.col("text")).alias("b")), "labelled")
    sizes = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Classifier(["all"], [0.0], [[0.0] * BUCKETS])
    domains, total = sorted(sizes), sum(sizes.values())
    counts = [[0] * BUCKETS for _ in domains]
    for r in seen.select("domain", F.explode("b").alias("b")).groupBy("domain", "b").agg(F.count("*").alias("n")).collect():  # domains x buckets at most
        counts[domains.index(r["domain"])][r["b"]] = r["n"]
    lifts = []
    for d, row in zip(domains, counts, strict=True):
        share, out = sizes[d] / total, []
        for b in range(BUCKETS):
            all_ = sum(c[b] for c in counts)
            due = all_ * share
            sure = due and abs(row[b] - due) > significant * math.sqrt(due * (1 - share) + 0.5)
            out.append(math.log((row[b] + 0.5) / (due + 0.5)) if sure else 0.0)
        lifts.append(out)
    return Classifier(domains, [math.log(sizes[d] / total) for d in domains], lifts, steps)


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """The least-norm solution of a small symmetric system; directions without mass get nothing."""
    n = len(b)
    a = [row[:] for row in a]
    v = [[float(i == j) for j in range(n)] for i in range(n)]
    for _ in range(60 * n):  # Jacobi rotations
        p, q = max(((i, j) for i in range(n) for j in range(i)), key=lambda ij: abs(a[ij[0]][ij[1]]), default=(0, 0))
        if n < 2 or abs(a[p][q]) <= 1e-14 * max(abs(a[i][i]) for i in range(n)):
            break
        t = 0.5 * math.atan2(2 * a[p][q], a[q][q] - a[p][p])
        c, s = math.cos(t), math.sin(t)
        for k in range(n):
            a[k][p], a[k][q] = c * a[k][p] - s * a[k][q], s * a[k][p] + c * a[k][q]
        for k in range(n):
            a[p][k], a[q][k] = c * a[p][k] - s * a[q][k], s * a[p][k] + c * a[q][k]
            v[k][p], v[k][q] = c * v[k][p] - s * v[k][q], s * v[k][p] + c * v[k][q]
    top = max((abs(a[i][i]) for i in range(n)), default=0)
    out = [0.0] * n
    for i in range(n):
        if a[i][i] > 1e-10 * top:
            w = sum(v[k][i] * b[k] for k in range(n)) / a[i][i]
            for k in range(n):
                out[k] += w * v[k][i]
    return out


@dataclass
class Mix:
    domains: list[str]
    targets: list[float]
    totals: list[float]
    steps: list[list[float]] = field(default_factory=list)  # what each projected step takes off a rate, by domain
    gap: float = 0.0  # between totals and targets, squared, as a share of all tokens

    def rate(self, p: Column) -> Column:
        """The rate of a document with posteriors ``p``: all steps, each cut off at 0."""
        if not self.steps:
            return F.lit(1.0)
        history = F.split(F.lit(";".join(",".join(map(repr, s)) for s in self.steps)), ";")
        history = F.transform(history, lambda s: F.split(s, ",").cast("array<double>"))
        return F.aggregate(history, F.lit(1.0), lambda r, g: _step(r, p, g))

    def report(self, spark: SparkSession) -> DataFrame:
        """(domain, target, total, gap) of the fit: expected tokens by domain, and what is missing (negative: too many)."""
        rows = [(d, t, e, t - e) for d, t, e in zip(self.domains, self.targets, self.totals, strict=True)]
        return spark.createDataFrame(rows, "domain string, target double, total double, gap double")


def _step(r: Column, p: Column, g: Column) -> Column:
    return F.greatest(F.lit(0.0), r - _dot(p, g))


def _dot(p: Column, g: Column) -> Column:
    return F.aggregate(F.zip_with(p, g, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def _literal(g: list[float]) -> Column:
    return F.array(*map(F.lit, g))


def fit_rates(cells: DataFrame, domains: list[str], weights: dict[str, float], total: float | None = None, anchor: str | None = None, rounds: int = ROUNDS) -> Mix:
    """Rates for ``cells`` (p, n): targets are the weights' shares of ``total`` tokens.

    ``total`` defaults to all tokens there are or, with ``anchor``, to as many as use that domain's tokens once. Weights of domains
    that no document can belong to have no effect; domains without a weight are to have no token, but where no domain has one all rates
    stay one. Targets that no rates meet are approached as closely as they can be; totals, targets and gap of the result tell how closely.
    """
    d = len(domains)

    def grams(state: DataFrame, on: Column) -> list[list[float]]:
        n = F.when(on, F.col("n")).otherwise(0.0)
        row = state.agg(*(F.sum(n * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i + 1))).first()
        return [[row[f"g{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(d)] for i in range(d)]

    def totals(state: DataFrame, rates: list[Column]) -> list[list[float]]:
        x = [x or 0.0 for x in state.agg(*(F.sum(r * F.col("n") * F.col("p")[i]) for r in rates for i in range(d))).first()]
        return [x[k : k + d] for k in range(0, len(x), d)]

    state = cells.select("p", "n", F.lit(1.0).alias("r"))
    now = totals(state, [F.col("r")])[0]
    all_ = sum(now)
    gram = grams(state, F.lit(True))
    have = sum(weights.get(x, 0.0) for x in domains)
    if not have:
        return Mix(domains, list(now), now)
    share = [weights.get(x, 0.0) / have for x in domains]
    whole = all_ if total is None else total
    if anchor in domains and total is None and share[domains.index(anchor)]:
        whole = now[domains.index(anchor)] / share[domains.index(anchor)]
    mix = Mix(domains, [s * whole for s in share], now)

    def missing(e: list[float]) -> tuple[list[float], list[float], float]:
        off = [x - t for x, t in zip(e, mix.targets, strict=True)]
        plain = _solve(gram, off)
        return off, plain, sum(a * b for a, b in zip(off, plain, strict=True)) / max(whole, 1.0)

    off, plain, mix.gap = missing(now)
    stalled = 0
    while mix.gap > TOLERANCE and len(mix.steps) < rounds and stalled < STALLED:
        free = (F.col("r") > 0) | (_dot(F.col("p"), _literal(plain)) < 0)
        near = _solve(grams(state, free), off)
        tried = [[f * x for x in near] for f in LENGTHS] + [[f * x for x in plain] for f in SAFE]
        found = totals(state, [_step(F.col("r"), F.col("p"), _literal(g)) for g in tried])
        gap, k = min((missing(e)[2], k) for k, e in enumerate(found))
        if gap >= mix.gap:
            break  # no step brings the totals closer
        stalled = stalled + 1 if gap > 0.95 * mix.gap else 0
        mix.steps.append(tried[k])
        state = state.withColumn("r", _step(F.col("r"), F.col("p"), _literal(tried[k])))
        mix.totals, (off, plain, mix.gap) = found[k], missing(found[k])
        if len(mix.steps) % 8 == 0:
            state = saved(state, "rates")
    return mix


def mix_rates(
    df: DataFrame,
    labels: DataFrame,
    domain: Column,
    weights: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    total: float | None = None,
    anchor: str | None = None,
    keep: tuple[str, ...] = (),
    others: dict[str, dict[str, float]] | None = None,
    steps: int | None = STEPS,
    significant: float = SIGNIFICANT,
) -> DataFrame:
    """(id, n_tokens, domain, posterior, rate, copies, domain_total, domain_target) and the columns ``keep`` for every row of ``df``.

    ``posterior`` is in the order of the domains' names, ``domain`` the likeliest (of equals the first). Tokens are words between white
    space; null, empty and wordless texts have none, so their posteriors are the labels' shares and they do not count. ``copies`` says how often
    the row is taken. ``domain_total`` and ``domain_target`` are the tokens that the rates are expected to give the row's domain and those that the weights ask for. ``others`` names further
    targets (of all tokens there are): each adds ``rate_<name>`` and ``copies_<name>`` from the same posteriors. Equal rows get equal results; columns of ``keep`` that have a result's name are refused.
    """
    c = fit_classifier(df, labels, domain, id_col, text_col, steps=steps, significant=significant)
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col), *(F.col(k) for k in keep if k != id_col), F.size(words(text)).cast("bigint").alias("__n"), c.posterior(text).alias("__p"), F.xxhash64(F.col(id_col), text).alias("__h"))
    rows = saved(rows, "posteriors")
    cells = saved(rows.where("__n > 0").groupBy(F.col("__p").alias("p")).agg(F.sum("__n").cast("double").alias("n")), "cells")
    mix = fit_rates(cells, c.domains, weights, total, anchor)
    more = {name: fit_rates(cells, c.domains, w) for name, w in (others or {}).items()}
    discard(cells)
    place = F.array_position(F.col("__p"), F.array_max("__p")).cast("int")
    u = F.pmod(F.col("__h"), F.lit(1 << 40)) / float(1 << 40)
    copies = lambda r: (F.floor(r) + F.when(u < F.col(r) - F.floor(r), 1).otherwise(0)).cast("int")
    rates = {"rate": mix.rate(F.col("__p"))} | {f"rate_{k}": m.rate(F.col("__p")) for k, m in more.items()}
    out = rows.withColumns(rates).withColumn("__d", place)
    at = lambda v: F.element_at(F.array(*map(F.lit, v)), F.col("__d"))
    return out.select(
        id_col, F.col("__n").alias("n_tokens"), at(c.domains).alias("domain"), F.col("__p").alias("posterior"), "rate", copies("rate").alias("copies"),
        at(mix.totals).alias("domain_total"), at(mix.targets).alias("domain_target"),
        *(x for k in more for x in (F.col(f"rate_{k}"), copies(f"rate_{k}").alias(f"copies_{k}"))), *(k for k in keep if k != id_col),
    )


#: Domains of the labels table: quality and toxicity. Production weights: mostly good clean text, little of the rest.
WEIGHTS = {"good": 0.975, "poor": 0.02, "good toxic": 0.004, "poor toxic": 0.001}
ANCHOR = "good"
#: Targets that move the mix a lot, for comparison: what a classifier of quality and toxicity might be trained on.
EVEN = {"good": 0.5, "poor": 0.3, "good toxic": 0.15, "poor toxic": 0.05}


def label_domain() -> Column:
    return F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), F.concat(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, " toxic").otherwise("")))
