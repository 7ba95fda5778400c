"""Mixing sources to target weights by soft membership.

Posteriors. A classifier learned from the label table gives each document a probability for each domain:
``toxic``, ``low`` and ``high`` (quality). It is a multinomial logistic regression over shares of
byte kinds, repetition of words and lines, word length and hits of a learned lexicon, fitted on a bounded sample
of labelled rows (``SAMPLE_ROWS``).

Rates. With token shares ``w_i`` and posteriors ``p_i``, the nonnegative rates ``r_i`` minimise

    1/2 sum_d (sum_i r_i w_i p_id - target_d)^2 / s_d + ridge/2 sum_i w_i (r_i - 1)^2,

where ``s_d`` is the present share of domain d. The gradient at document i is ``p_i`` times one number per domain, so gradients add up in
a vector ``m`` of one multiplier per domain, and the rates are the projection ``max(0, 1 + p_i . m)`` of what they add up to (projected gradient with
lazy projection). A step needs sums of a few numbers from all documents: the totals, and the second moments of the documents
with positive rates, by which the gradient is scaled (this makes the steps few). Several lengths of a step are tried in the same pass; the best is taken.
Nothing but ``m`` is kept between steps, whatever their number, and a lost executor costs no step.

Steps end when the gradient is nothing but rounding (``SETTLED``); if that takes more than ``STEPS``, it is an error. ``RIDGE`` is so small that
the rates meet the targets well within ``TOLERANCE`` where any nonnegative rates can, and are then those nearest to 1. Targets that no
rates can meet (a share of 0 with posteriors above 0, or texts that are all alike) are found by a total beyond ``TOLERANCE`` at the optimum. ``rates``
then raises an error with the figures if it is ``strict``, and both operators else settle for the compromise under ``FAR_RIDGE``, which keeps rates near 1.

Effect. A document is taken ``floor(rate + u)`` times, where ``u`` is a uniform hash of its id, so the
expected number of copies is its rate.

Edge cases. Null and empty texts have no tokens; their rate follows their posterior like any other. Domains
without labelled rows are left out and the targets rescaled; a domain without a target keeps its present share; with fewer than two domains, or no tokens at all, all rates are
1. Ties among domains go to the first by name. Null ids hash as null. Repeated rows count each. Extra columns are kept by ``mix`` and ignored by ``rates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_small_batches, written
from .toxicity import WORDS, learn_lexicon

SAMPLE_ROWS, RIDGE, FAR_RIDGE, STEPS, TOLERANCE, SETTLED = 20_000, 1e-6, 2e-3, 60, 0.005, 1e-9
#: Lengths of a step that one pass tries.
LENGTHS = (1.0, 0.5, 0.2, 0.05, 0.005)
#: Target shares of the token total, by domain.
TARGETS = {"high": 0.85, "low": 0.12, "toxic": 0.03}
PREFIX = "__mixing_"

_KIND = np.zeros(256, dtype=np.int64)
_KIND[[32, 9, 10, 11, 12, 13]] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[ord("A") : ord("Z") + 1] = 3
_KIND[ord("a") : ord("z") + 1] = 4
_KIND[128:] = 5
_KIND[[ord(c) for c in ".,;:?"]] = 6
_KINDS = 7


def profile(text: str, lexicon: frozenset[str]) -> list[float]:
    """Tokens (words apart by white space), then the classifier's features."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    kinds = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=_KINDS) / size
    lines = raw.split(b"\n")
    distinct = set(words)
    marks = len(lexicon.intersection(w.strip(".,;:!?*$%&#").lower() for w in map(bytes.decode, distinct) if len(w) > 3)) if lexicon else 0
    return [float(n), *kinds.tolist(), len(distinct) / max(1, n), len(set(lines)) / len(lines), np.log1p(n), min(size / max(1, n), 50.0) / 10, float(min(marks, 5)), float(marks > 0)]


FEATURES = _KINDS + 6


def with_profile(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    terms = frozenset(t for t in lexicon if WORDS.fullmatch(t))

    @F.pandas_udf("array<double>")
    def profiles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([profile(t if isinstance(t, str) else "", terms) for t in texts], dtype=object)

    return with_small_batches(docs).withColumn(PREFIX + "profile", profiles("text"))


def features() -> Column:
    return array_to_vector(F.slice(PREFIX + "profile", 2, FEATURES))


class DomainModel:
    """Posterior of each domain from a text; without a classifier all mass is on the only domain."""

    def __init__(self, domains: list[str], lexicon: dict[str, float], classifier=None):
        self.domains, self.lexicon, self.classifier = domains, lexicon, classifier

    def with_posteriors(self, docs: DataFrame) -> DataFrame:
        """Adds ``tokens`` and ``posteriors`` (by the order of ``domains``) under prefixed names."""
        rows = with_profile(docs, self.lexicon).withColumn(PREFIX + "tokens", F.element_at(PREFIX + "profile", 1))
        if self.classifier is None:
            return rows.withColumn(PREFIX + "p", F.array(F.lit(1.0)))
        scored = self.classifier.transform(rows.withColumn(PREFIX + "features", features()))
        return scored.withColumn(PREFIX + "p", vector_to_array(PREFIX + "probability"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DomainModel:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    marks = labels.where("doc_id is not null").select("doc_id", domain.alias("domain")).where("domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))
    share = min(1.0, rows / max(1, marks.count()))
    # At most about ``rows`` ids, so they can go to every task in place of all texts to them.
    picked = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < int(share * (1 << 53)))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "domain", (F.col("domain") == "toxic").cast("int").alias("toxic"))
    sample = written(sample, "mixing-sample")
    domains = sorted(r["domain"] for r in sample.groupBy("domain").count().where("count >= 2").collect())
    if len(domains) < 2:
        return DomainModel(domains or ["high"], {})
    lexicon = learn_lexicon(sample) if "toxic" in domains else {}
    index = F.create_map(*[F.lit(x) for i, d in enumerate(domains) for x in (d, float(i))])
    known = with_profile(sample.where(F.col("domain").isin(domains)), lexicon).select(index[F.col("domain")].alias("y"), features().alias(PREFIX + "features"))
    fit = LogisticRegression(
        featuresCol=PREFIX + "features", labelCol="y", family="multinomial", regParam=1e-3, maxIter=60,
        probabilityCol=PREFIX + "probability", rawPredictionCol=PREFIX + "raw", predictionCol=PREFIX + "class",
    ).fit(written(known.repartition(4), "mixing-features"))
    return DomainModel(domains, lexicon, fit)


def goals(domains: list[str], targets: dict[str, float], present: np.ndarray) -> np.ndarray:
    """The target share of each domain: one without a target keeps its present share, the others divide the rest as their targets do."""
    named = np.array([d in targets for d in domains])
    wanted = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    rest = 1.0 - present[~named].sum()
    return np.where(named, wanted * rest / wanted.sum() if wanted.sum() > 0 else present, present)


def rates_at(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rates of documents with posteriors ``p`` (rows) at the multipliers."""
    return np.maximum(0.0, 1.0 + p @ m)


def rate_of(p: Column, m: np.ndarray | None) -> Column:
    """The rate at the multipliers; 1 without any."""
    if m is None:
        return F.lit(1.0)
    return F.greatest(F.lit(0.0), sum((p[k] * float(x) for k, x in enumerate(m)), F.lit(1.0)))


@dataclass
class Moments:
    """Sums over all documents at one vector of multipliers, as shares of the token total."""

    half: float  # half the squared rates
    mass: np.ndarray  # expected tokens by domain
    second: np.ndarray  # second moments of the posteriors where rates are positive


def moments(members: DataFrame, points: list[np.ndarray]) -> tuple[float, list[Moments]]:
    """Token total, and the moments at each of the points, in one pass.

    Each task sums its rows; only sums of a few numbers leave it.
    """
    d = len(points[0])
    width = 1 + d + d * d

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums = 0.0, np.zeros((len(points), width))
        for batch in batches:
            if len(batch):
                t, p = batch["tokens"].to_numpy(dtype=float), np.stack(batch["p"].to_numpy())
                total += t.sum()
                for k, m in enumerate(points):
                    r = rates_at(p, m)
                    sums[k] += np.concatenate([[t @ (r * r) / 2], (r * t) @ p, ((p.T * (t * (r > 0))) @ p).ravel()])
        yield pd.DataFrame({"k": range(1 + sums.size), "v": [total, *sums.ravel()]})

    got = {r["k"]: r["v"] for r in members.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    total = got.get(0, 0.0)
    v = np.array([got.get(1 + k, 0.0) for k in range(len(points) * width)]).reshape(len(points), width) / (total or 1.0)
    return total, [Moments(x[0], x[1 : d + 1], x[d + 1 :].reshape(d, d)) for x in v]


def descend(members: DataFrame, goal: np.ndarray, scale: np.ndarray, ridge: float, m: np.ndarray, at: Moments) -> tuple[np.ndarray, Moments]:
    """Multipliers of the least squares, from ``m`` with its moments."""
    value = lambda m, x: m @ goal - x.half - ridge / 2 * (scale * m) @ m
    for _ in range(STEPS):
        slope = goal - at.mass - ridge * scale * m
        if np.abs(slope).max() <= SETTLED:
            return m, at
        ahead = np.linalg.solve(at.second + ridge * np.diag(scale), slope)
        points = [m + length * ahead for length in LENGTHS]
        _, found = moments(members, points)
        values = [value(q, x) for q, x in zip(points, found)]
        best = int(np.argmax(values))
        if values[best] <= value(m, at):  # no length gains anything: what is left is rounding
            if np.abs(slope).max() <= 1e3 * SETTLED:
                return m, at
            break
        m, at = points[best], found[best]
    raise RuntimeError(f"the rates did not settle in {STEPS} steps: totals {at.mass}, targets {goal}")


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], strict: bool = False) -> np.ndarray | None:
    """The multipliers of the domains over ``tokens, p`` rows; None where all rates are 1."""
    d = len(domains)
    m = np.zeros(d)
    if d < 2:
        return None
    total, (at,) = moments(members, [m])
    if total <= 0:
        return None
    goal = goals(domains, targets, at.mass)
    scale = np.maximum(at.mass, 1e-3)
    near, reached = descend(members, goal, scale, RIDGE, m, at)
    if (np.abs(reached.mass - goal) <= TOLERANCE * goal).all():
        return near
    if strict:
        raise ValueError(f"no rates meet the targets: of {dict(zip(domains, goal.tolist()))} the nearest totals are {dict(zip(domains, reached.mass.tolist()))}")
    return descend(members, goal, scale, FAR_RIDGE, m, at)[0]


def copies_of(rate: Column, key: Column) -> Column:
    return F.floor(rate + F.pmod(F.xxhash64(key, F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, strict: bool = False) -> DataFrame:
    """One row per document: ``doc_id, tokens, domain, p_<domain>..., rate, copies``."""
    model = train(docs, labels)
    scored = model.with_posteriors(docs.select("doc_id", "text"))
    members = written(scored.select("doc_id", F.col(PREFIX + "tokens").alias("tokens"), F.col(PREFIX + "p").alias("p")), "posteriors")
    rate = rate_of(F.col("p"), fit_rates(members.select("tokens", "p"), model.domains, targets or TARGETS, strict))
    top = F.array_position("p", F.array_max("p")).cast("int")
    return members.withColumn("rate", rate).select(
        "doc_id", F.col("tokens").cast("long").alias("tokens"), F.element_at(F.array(*[F.lit(d) for d in model.domains]), top).alias("domain"),
        *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(model.domains)], "rate", copies_of(F.col("rate"), F.col("doc_id")).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents, each as often as its rate says, with their columns unchanged. Texts are profiled once."""
    model = train(docs, labels)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    scored = written(model.with_posteriors(docs).select(*columns, PREFIX + "tokens", PREFIX + "p"), "posteriors")
    members = scored.select(F.col(PREFIX + "tokens").alias("tokens"), F.col(PREFIX + "p").alias("p"))
    rate = rate_of(F.col(PREFIX + "p"), fit_rates(members, model.domains, targets or TARGETS))
    taken = scored.withColumn(PREFIX + "copies", copies_of(rate, F.col("doc_id"))).where(F.col(PREFIX + "copies") > 0)
    repeated = taken.withColumn(PREFIX + "copy", F.explode(F.sequence(F.lit(1), F.col(PREFIX + "copies"))))
    return repeated.select(*columns)
