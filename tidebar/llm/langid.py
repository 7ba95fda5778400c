"""Language identification by partial matching: one variable-order byte context tree per language.

Learning. A bounded sample of labelled documents (``SAMPLE_PER_LANGUAGE`` rows each, by hash of the id) is
counted by Spark: how often each byte follows each context of up to ``ORDER`` bytes, per language.
Contexts of the highest order seen less than twice are pruned; the most frequent ``MAX_CONTEXTS`` of it stay.
After that the statistics are frozen.

Code lengths. In a context with ``n`` observations of ``d`` different bytes, a byte seen ``c`` times
has probability ``c / (n + d)``; the rest, ``d / (n + d)``, is the escape, which goes to the next shorter
context with the bytes already offered excluded, down to a uniform byte. So each context has a proper
distribution, and a text's score in a language is its exact code length, kept in integer units of
1/1024 bit. Trees of all languages are laid over one set of contexts: a context that a language has not
seen takes the row of its longest suffix. Scoring looks up one row per byte and adds.

The predicted language has the shortest code; ``score`` is its posterior under equal priors.

Edge cases. Null texts and texts without a letter are ``und`` with score 0. Ties go to the language
that sorts first. Without any labelled text every document is ``und``. Whole texts are scored, however long; empty
tables give empty results; repeated rows are predicted each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, with_small_batches

UNDETERMINED = "und"
#: Bounds of the training sample and of the trees; ids with crc32 mod 4 = 2 are held out.
SAMPLE_PER_LANGUAGE, MAX_CONTEXTS, ORDER = 400, 12_000, 3
FOLDS, HELD_OUT = 4, 2
UNIT = 1024
PIECE = 1 << 19


def text_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def count_contexts(sample: DataFrame) -> pd.DataFrame:
    """(lang, size, gram, n): occurrences of each string of up to ORDER + 1 bytes, per language. Bounded by the sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                b = np.frombuffer(b"".join(b" " * ORDER + text_bytes(t) for t in part["text"]), dtype=np.uint8).astype(np.int64)
                gram = np.zeros(len(b), dtype=np.int64)
                for size in range(1, ORDER + 2):
                    gram = b if size == 1 else gram[:-1] * 256 + b[size - 1 :]
                    key, n = np.unique(gram, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "size": size, "gram": key, "n": n})

    counted = sample.mapInPandas(run, "lang string, size long, gram long, n long")
    counted = counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    return counted.where((F.col("size") <= ORDER) | (F.col("n") >= 2)).toPandas()


class Model:
    """Frozen statistics: ``symbols`` maps bytes to columns, ``nodes`` maps the last ORDER columns to a row,
    ``cost`` holds a code length per row, column and language."""

    def __init__(self, languages: list[str], symbols: np.ndarray, width: int, nodes: np.ndarray, cost: np.ndarray):
        self.languages, self.symbols, self.width, self.nodes, self.cost = languages, symbols, width, nodes, cost

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Exact code length of each text in each language, in 1/UNIT bit."""
        raw = [b" " * ORDER + text_bytes(t) for t in texts]
        out = np.zeros((len(raw), len(self.languages)), dtype=np.int64)
        at = 0
        while at < len(raw):
            end, held = at, 0
            while end < len(raw) and (end == at or held + len(raw[end]) <= PIECE):
                held += len(raw[end])
                end += 1
            lengths = np.array([len(r) for r in raw[at:end]])
            s = self.symbols[np.frombuffer(b"".join(raw[at:end]), dtype=np.uint8)].astype(np.int32)
            key = (s[:-3] * self.width + s[1:-2]) * self.width + s[2:-1]
            row = np.empty(len(s), dtype=np.int64)
            row[3:] = self.nodes[key]
            row[:3] = 0
            own = np.ones(len(s), dtype=bool)
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            for k in range(ORDER):
                own[starts + k] = False
            total = np.zeros((len(s) + 1, 1), dtype=np.int64)
            flat = row * self.width + s
            for k in range(len(self.languages)):
                np.cumsum(np.where(own, self.cost[k][flat], 0), out=total[1:, 0])
                out[at:end, k] = total[starts + lengths, 0] - total[starts, 0]
            at = end
        return out


def build_model(counts: pd.DataFrame, max_contexts: int = MAX_CONTEXTS) -> Model | None:
    languages = sorted(counts["lang"].unique())
    if not languages:
        return None
    used = np.unique(counts.loc[counts["size"] == 1, "gram"].to_numpy())
    symbols = np.zeros(256, dtype=np.uint8 if len(used) < 255 else np.uint16)
    symbols[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1  # column 0 stands for every byte that no language has shown
    unseen = 256 - len(used)

    def decode(gram: np.ndarray, size: int) -> np.ndarray:
        """Each gram's columns, oldest byte first."""
        return np.stack([symbols[(gram >> (8 * (size - 1 - k))) & 255] for k in range(size)], axis=1).astype(np.int64)

    # Contexts of all languages: rows by order, the empty context first.
    rows: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]
    for order in range(1, ORDER + 1):
        part = counts[counts["size"] == order + 1]
        seen = part.assign(context=part["gram"] // 256).groupby("context")["n"].sum()
        if order == ORDER and len(seen) > max_contexts:
            seen = seen.sort_index().sort_values(ascending=False, kind="stable").head(max_contexts)
        c = decode(seen.index.to_numpy(dtype=np.int64), order)
        rows.append(np.unique(c @ width ** np.arange(order - 1, -1, -1)))
    first = np.cumsum([0, *map(len, rows)])

    def find(order: int, key: np.ndarray) -> np.ndarray:
        """Row numbers of contexts, -1 where there is none."""
        at = np.minimum(np.searchsorted(rows[order], key), len(rows[order]) - 1)
        return np.where(rows[order][at] == key, first[order] + at, -1) if len(rows[order]) else np.full(len(key), -1)

    cost = []
    for lang in languages:
        own = counts[counts["lang"] == lang]
        p = np.zeros((first[-1], width))
        lower = np.full((1, width), 1 / 256)
        lower[0, 0] = unseen / 256
        for order in range(ORDER + 1):
            part = own[own["size"] == order + 1]
            n = np.zeros((len(rows[order]), width))
            if len(part):
                c = decode(part["gram"].to_numpy(dtype=np.int64), order + 1)
                row = find(order, c[:, :-1] @ width ** np.arange(order - 1, -1, -1) if order else np.zeros(len(c), dtype=np.int64))
                np.add.at(n, (row[row >= 0] - first[order], c[row >= 0, -1]), part["n"].to_numpy()[row >= 0])
            if order:
                suffix = rows[order] % width ** (order - 1) if order > 1 else np.zeros(len(rows[order]), dtype=np.int64)
                up = np.maximum(find(order - 1, suffix), 0)
                lower = p[up]
            total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
            left = np.where(n > 0, 0, lower)
            rest = left.sum(axis=1, keepdims=True)
            escape = np.where(rest > 0, kinds / np.maximum(total + kinds, 1), 0)
            seen = n / np.maximum(np.where(rest > 0, total + kinds, total), 1)
            p[first[order] : first[order + 1]] = np.where(total > 0, seen + escape * left / np.where(rest > 0, rest, 1), lower)
        p[:, 0] /= unseen or 1  # one unseen byte's share of its column
        cost.append(np.rint(-np.log2(np.maximum(p, 1e-12)) * UNIT).astype(np.uint16).ravel())

    nodes = np.zeros(width**ORDER, dtype=np.int32)
    for order in range(1, ORDER + 1):
        grid = nodes.reshape((width ** (ORDER - order), width**order))
        grid[:, rows[order]] = np.arange(first[order], first[order + 1], dtype=np.int32)
    return Model(languages, symbols, width, nodes, np.stack(cost))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Learns from text and language of the rows that are not held out."""
    marked = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT))
    sizes = marked.groupBy("lang").count().collect()
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    return build_model(count_contexts(marked.where(draw < share[F.col("lang")]).select("lang", "text")))


PREDICTION = "lang_pred string, score double, bits_per_byte double"


def with_language(docs: DataFrame, model: Model | None, name: str = "language") -> DataFrame:
    """Adds a struct (lang_pred, score, bits_per_byte); the other columns stay in the JVM as they are."""
    if model is None:
        return docs.withColumn(name, F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            lettered = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
            bits = m.code_lengths(texts) / UNIT
            best = bits.argmin(axis=1) if len(texts) else np.zeros(0, dtype=int)
            ahead = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000) if len(texts) else bits
            size = np.array([max(1, len(text_bytes(t))) for t in texts])
            yield pd.DataFrame({
                "lang_pred": np.where(lettered, np.array(m.languages, dtype=object)[best], UNDETERMINED),
                "score": np.where(lettered, 1 / np.exp2(-ahead).sum(axis=1), 0.0),
                "bits_per_byte": np.where(lettered, bits.min(axis=1) / size, 0.0),
            })

    return with_small_batches(docs).withColumn(name, predict("text"))


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, bits_per_byte``."""
    found = with_language(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "language.*")


def drop_unidentified(docs: DataFrame, most_bits: float = 8.0) -> DataFrame:
    """Documents that have a language: a letter, and a code shorter than the plain bytes. Columns unchanged."""
    found = with_language(docs, train(docs), "__language")
    return found.where((F.col("__language.lang_pred") != UNDETERMINED) & (F.col("__language.bits_per_byte") < most_bits)).drop("__language")
