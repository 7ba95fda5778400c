"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Learning. Labels come from the label table, texts from the documents. A bounded sample of labelled
rows (``SAMPLE_ROWS``, by hash of the id; the whole table if it is smaller) gives the lexicon, the
trees and the calibration. The sample is dealt into ``PARTS`` parts (by hash of the text, so copies stay together). With ``cross_fit`` lexicon and trees
are learned from all of it, and the calibration never sees a row that grew the trees which judge it: each part is judged by a lexicon and trees
of the other parts, and the isotonic fit takes these margins of all rows, alike at every size. Where the other parts hold one class alone, their margin is its share.
Without it, four parts make the lexicon and grow the trees, the fifth calibrates them (a sample too small for both classes in a
part, or for ``CALIBRATING`` rows of each in the calibrating one, is used whole there, which flatters the trees). The lexicon holds words
and word beginnings whose share of toxic texts, shrunk to the base rate, is high; exact copies of a
text count once there.

Features (per whole text): lexicon hits, their density and greatest weight, hits that appear only
after undoing character substitutions, second-person words and hits near them, capitals, punctuation, digits,
tokens that mix letters with other signs, stretched letters and length.

Scoring runs over all documents in one pass: features in Python workers, trees and calibration in Spark ML.

Edge cases. Null and empty texts have all features 0 and are scored like any other. Rows that repeat
an id in the labels count as toxic if one of them says so; repeated documents are scored each. Without
labels of both classes every score is the share of toxic labels (0 without any). Empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, with_small_batches, written

#: Bounds of the sample and of the lexicon; folds of the id's crc32 (fold 0 is held out).
SAMPLE_ROWS, LEXICON_TERMS, FOLDS = 20_000, 1_500, 5
#: Parts of the sample; rows of each class that the calibrating part needs to stand alone where it is not cross-fitted.
PARTS, CALIBRATING = 5, 10
NEAR, SURPRISE = 5, 12.0
STEMS = (4, 5, 6)
#: Second-person words of the corpus languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Signs written in place of letters.
SUBSTITUTES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "_": None, "-": None, ".": None})
WORDS = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])[\w@$!*.\-]*[^\W\d_][\d@$!*_.\-]+[^\W\d_][\w@$!*.\-]*")
SIGN_INSIDE = re.compile(r"[^\W\d_][\d@$!*_.\-]+[^\W\d_]")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
#: Names of the columns that are added on the way.
PREFIX = "__toxicity_"
VECTOR = PREFIX + "features"
FEATURES = [
    "hits", "density", "top_weight", "hidden_density", "second_person", "near_second_person", "capitals", "shouted",
    "exclamations", "punctuation", "digits", "mixed", "stretched", "log_words",
]


@cache
def capital() -> np.ndarray:
    """Whether a code point is a capital letter, for all of them."""
    return np.array([chr(c).isupper() for c in range(0x110000)])


def terms_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


def weight_of(word: str, lexicon: dict[str, float]) -> float:
    return max((lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0)


class Words:
    """A text's words and the features that need no lexicon, found once for any number of lexicons."""

    def __init__(self, text: str):
        self.words = words = WORDS.findall(text.lower())
        self.n, chars = max(1, len(words)), len(text)
        self.counts = counts = Counter(words)
        self.you = sum(counts[w] for w in SECOND_PERSON if w in counts)
        # A cheap search first: most texts have no such token.
        mixed = [m[0].lower() for m in MIXED.finditer(text)] if SIGN_INSIDE.search(text) else []
        self.mixed = [(m.translate(SUBSTITUTES), WORDS.findall(m)) for m in mixed]
        letters = max(1, sum(map(len, words)))
        raw = text.split()
        self.head = self.you / self.n
        self.tail = [
            int(capital()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].sum()) / letters,
            sum(len(w) > 2 and w.isupper() for w in raw) / max(1, len(raw)),
            text.count("!") / chars, (chars - letters - text.count(" ")) / chars, sum(map(text.count, "0123456789")) / chars,
            len(mixed) / self.n, len(STRETCHED.findall(text)) / self.n, math.log1p(len(words)),
        ]

    def features(self, lexicon: dict[str, float], known: dict[str, float]) -> list[float]:
        """The features under a lexicon; ``known`` is a memo of words' weights."""
        hits, top, hit_words = 0, 0.0, set()
        for w, c in self.counts.items():
            x = known.get(w)
            if x is None:
                if len(known) > 100_000:
                    known.clear()
                x = known[w] = weight_of(w, lexicon)
            if x:
                hits, top = hits + c, max(top, x)
                hit_words.add(w)
        near = 0
        if hit_words and self.you:
            at = [i for i, w in enumerate(self.words) if w in SECOND_PERSON]
            near = sum(any(w in hit_words for w in self.words[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
        hidden = sum(weight_of(plain, lexicon) > 0 and not any(p in hit_words for p in parts) for plain, parts in self.mixed)
        return [math.log1p(hits), hits / self.n, top, hidden / self.n, self.head, near / self.n, *self.tail]


def text_features(text: str, lexicons: list[dict[str, float]], known: list[dict[str, float]]) -> list[list[float]]:
    """One text's features under each lexicon; ``known`` has a memo for each."""
    if not text:
        return [[0.0] * len(FEATURES)] * len(lexicons)
    words = Words(text)
    return [words.features(x, memo) for x, memo in zip(lexicons, known)]


def with_features(docs: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """Adds a feature vector per lexicon (``<VECTOR>_k``) in one pass over the texts; all other columns stay in the JVM as they are."""

    @F.pandas_udf("array<array<double>>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: list[dict[str, float]] = [{} for _ in lexicons]
        for texts in batches:
            yield pd.Series([text_features(t if isinstance(t, str) else "", lexicons, known) for t in texts], dtype=object)

    rows = with_small_batches(docs).withColumn(PREFIX + "all", features("text"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *[array_to_vector(F.col(PREFIX + "all")[k]).alias(f"{VECTOR}_{k}") for k in range(len(lexicons))])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``doc_id, text, toxic, part`` of at most about ``rows`` labelled documents outside the held-out fold."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod("doc_id", FOLDS) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    share = min(1.0, rows / max(1, n))
    # At most about ``rows`` ids, so they can go to every task in place of all texts to them.
    picked = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < int(share * (1 << 53)))
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(picked), "doc_id").withColumn("part", F.pmod(F.xxhash64("text", F.lit("calibration")), F.lit(PARTS)).cast("int"))


def term_counts(sample: DataFrame) -> DataFrame:
    """``part, term, n, toxic``: distinct texts of a part with the term, and toxic ones among them; the term '' counts all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, toxic = Counter(), Counter()
        for batch in batches:
            for text, y, part in zip(batch["text"], batch["toxic"], batch["part"]):
                found = [(part, ""), *{(part, t) for w in set(WORDS.findall(text.lower())) for t in terms_of(w)}]
                n.update(found)
                if y:
                    toxic.update(found)
        yield pd.DataFrame({"part": [p for p, _ in n], "term": [t for _, t in n], "n": list(n.values()), "toxic": [toxic[k] for k in n]}).astype({"part": "int32", "n": "int64", "toxic": "int64"})

    texts = sample.where(F.length("text") > 0).groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.first("part").alias("part"))
    counted = texts.select("text", "toxic", "part").mapInPandas(run, "part int, term string, n long, toxic long")
    return counted.groupBy("part", "term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def best_terms(counts: DataFrame, terms: int = LEXICON_TERMS) -> dict[str, float]:
    """The terms that mark toxic texts best, with their shrunken share of toxic texts. At most ``terms`` entries."""
    summed = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    base = next((r["toxic"] / r["n"] for r in counts.where("term = ''").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).collect() if r["n"]), 0.0)
    if not base:
        return {}
    weight = (F.col("toxic") + 4 * base) / (F.col("n") + 4)
    # A term must be far from what chance gives a term of its frequency (log likelihood ratio, in nats).
    p, other = F.col("toxic") / F.col("n"), F.col("n") - F.col("toxic")
    surprise = F.col("toxic") * F.log(p / base) + F.when(other > 0, other * F.log((1 - p) / (1 - base))).otherwise(0.0)
    best = summed.where("term != '' and toxic >= 4").withColumn("weight", weight).where((F.col("weight") >= max(0.55, 2 * base)) & (surprise >= SURPRISE)).orderBy(F.desc(F.col("weight") * F.log1p("toxic")), "term").limit(terms)
    return {r["term"]: r["weight"] for r in best.collect()}


def learn_lexicon(sample: DataFrame, terms: int = LEXICON_TERMS) -> dict[str, float]:
    """The lexicon of ``text, toxic`` rows."""
    return best_terms(term_counts(sample.withColumn("part", F.lit(0))), terms)


class ToxicityModel:
    """Lexicon, trees and calibration; ``constant`` if there was nothing to tell apart."""

    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def with_score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """The documents with a score (0 to 1) beside their own columns."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(float(self.constant)))
        calibrated = self.calibration.transform(margins(self.trees, with_features(docs, [self.lexicon]).withColumnRenamed(f"{VECTOR}_0", VECTOR)))
        return calibrated.select(*[F.col(f"`{c}`") for c in docs.columns], F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(PREFIX + "calibrated"))).alias(name))


def margins(trees, df: DataFrame) -> DataFrame:
    return trees.transform(df).withColumn(PREFIX + "margin", vector_to_array(PREFIX + "probability")[1])


def grow(rows: DataFrame, rounds: int, depth: int):
    """Boosted trees over rows of both classes; otherwise the share of toxic ones."""
    classes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(classes) < 2:
        return float(next(iter(classes), 0.0))
    trees = GBTClassifier(labelCol="toxic", featuresCol=VECTOR, maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7)
    return trees.setParams(predictionCol=PREFIX + "class").setRawPredictionCol(PREFIX + "raw").setProbabilityCol(PREFIX + "probability").fit(rows)


def out_of_part(ready: DataFrame, rounds: int, depth: int) -> DataFrame:
    """``margin, toxic`` of all rows, each judged by trees and a lexicon of the other parts (vector k: lexicon without part k)."""
    found = []
    for k in range(PARTS):
        rows = ready.select("toxic", "part", F.col(f"{VECTOR}_{k}").alias(VECTOR))
        trees, own = grow(rows.where(F.col("part") != k), rounds, depth), rows.where(F.col("part") == k)
        judged = own.withColumn(PREFIX + "margin", F.lit(trees)) if isinstance(trees, float) else margins(trees, own)
        found.append(judged.select(PREFIX + "margin", "toxic"))
    return reduce(DataFrame.unionByName, found)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, rounds: int = 15, depth: int = 3, cross_fit: bool = False) -> ToxicityModel:
    sample = written(labelled_sample(docs, labels, rows), "toxicity-sample")
    classes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(classes) < 2:
        return ToxicityModel({}, constant=float(next(iter(classes), 0)))
    both = lambda df, least=1: [r["count"] >= least for r in df.groupBy("toxic").count().collect()] == [True, True]
    if cross_fit:
        counts = written(term_counts(sample), "toxicity-terms")
        lexicons = [best_terms(counts.where(F.col("part") != k)) for k in range(PARTS)] + [best_terms(counts)]
    else:
        learnt = sample.where("part != 0")
        lexicons = [learn_lexicon(learnt if both(learnt) else sample)]
    ready = written(with_features(sample.select(F.col("toxic").cast("double").alias("toxic"), "part", "text").repartition(4), lexicons).drop("text"), "toxicity-features")
    own = ready.select("toxic", "part", F.col(f"{VECTOR}_{len(lexicons) - 1}").alias(VECTOR))
    grown = own if cross_fit or not both(own.where("part != 0")) else own.where("part != 0")
    trees = grow(grown, rounds, depth)
    if cross_fit:
        judged = out_of_part(ready, rounds, depth)
    else:
        tested = own.where("part = 0")
        judged = margins(trees, tested if both(tested, CALIBRATING) else own).select(PREFIX + "margin", "toxic")
    calibration = IsotonicRegression(featuresCol=PREFIX + "margin", labelCol="toxic", predictionCol=PREFIX + "calibrated")
    return ToxicityModel(lexicons[-1], trees, calibration.fit(judged))


def score_documents(docs: DataFrame, labels: DataFrame, cross_fit: bool = False) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    scored = train(docs, labels, cross_fit=cross_fit).with_score(docs.select("doc_id", "text"))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with their columns unchanged."""
    return train(docs, labels).with_score(docs, PREFIX + "score").where(F.col(PREFIX + "score") < threshold).drop(PREFIX + "score")
