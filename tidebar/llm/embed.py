"""Embedding near-duplicates by NN-descent.

Vectors of one label (and length) are compared by cosine. Exact copies are one class, represented by their smallest id.

1. Start: the classes are sorted by the signs of ``BITS`` random projections, ``TREES`` times anew, by a range partitioning, and each
   keeps its ``K`` nearest of a bounded chunk of each order.
2. Descent: the neighbours and reverse neighbours of a vector are compared with each other in bounded
   blocks; what is nearer than a list's last entry replaces it. Rounds end when few entries change (``SETTLED``).
3. Threshold: list entries at or above the threshold, checked in double precision, are links; components are formed.
4. Saturation: a list whose last entry is a link may hide more links. It is enlarged to its whole
   component and ``K`` more entries from outside it; saturated classes repeat 1 to 3 until none finds a link between components.
5. Audit: a new sample of about ``AUDIT`` classes is compared with all in double precision. Recall is the share of the sample's links whose
   two ends lie in one component, which are the links that step 6 counts. While a link is missed, all lists
   are enlarged (``K`` doubled, new projections) and 1 to 4 are repeated; if links are still missed after ``ENLARGED`` times, the operator raises an error.
6. Counting: links are counted in full inside each component, without emitting pairs. Large components are cut by the angle to their first vector:
   by the triangle inequality, parts that are far apart have no links, and close parts have all; the rest is compared in blocks.

Edge cases. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
rows without label; so do vectors of different length. Equal ids are one node. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .graph import components

THRESHOLD, K, TREES, BITS, ROUNDS, CHUNK, BLOCK = 0.93, 16, 4, 48, 20, 256, 1024
AUDIT, ENLARGED, SETTLED = 2000, 4, 0.001
SLACK = 1e-4  # lists are kept in single precision
#: Width of the rings of a large component, and slack of angles, in radians.
RING, ANGLE_SLACK = 0.02, 1e-6


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, unit`` (double, length 1; null where the vector or the label cannot link)."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x"))
    sound = F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad) & F.exists("x", lambda v: v != 0)
    rows = rows.select("vec_id", "label", F.when(sound, F.col("x")).alias("x"))
    rows = rows.withColumn("top", F.array_max(F.transform("x", F.abs))).withColumn("x", F.transform("x", lambda v: v / F.col("top")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return rows.withColumn("norm", norm).select("vec_id", "label", F.transform("x", lambda v: v / F.col("norm")).alias("unit"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def matrix(vectors: pd.Series, dtype=np.float32) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=dtype) for v in vectors])


def runs(keys: list[np.ndarray]) -> list[tuple[int, int]]:
    """Bounds of stretches of equal keys."""
    n = len(keys[0])
    change = np.zeros(n, dtype=bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    edge = [0, *np.flatnonzero(change).tolist(), n]
    return list(zip(edge[:-1], edge[1:]))


def nearest(nodes: np.ndarray, x: np.ndarray, part: np.ndarray, floor: np.ndarray, k: int) -> list[tuple]:
    """Each row's best ``k`` others in the block above its floor and of another part: arrays (node, nbr, sim)."""
    s = x @ x.T
    s[(part[:, None] == part[None, :]) | (nodes[:, None] == nodes[None, :])] = -2
    k = min(k, len(nodes) - 1)
    if k < 1:
        return []
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    sim = np.take_along_axis(s, top, axis=1)
    r, c = np.nonzero(sim > np.maximum(floor, -1.5)[:, None])
    return [(nodes[r], nodes[top[r, c]], sim[r, c])]


def emitted(found: list[tuple]) -> pd.DataFrame:
    cols = [np.concatenate([f[i] for f in found]) if found else np.empty(0) for i in range(3)]
    return pd.DataFrame({"node": cols[0].astype("int64"), "nbr": cols[1].astype("int64"), "sim": cols[2].astype("float32")})


LIST = "node long, nbr long, sim float"


def chunk_neighbours(points: DataFrame, width: int, seed: int, k: int) -> DataFrame:
    """Nearest within overlapping chunks of the orders by projection signs."""
    planes = np.random.default_rng(seed).standard_normal((width, TREES * BITS)).astype(np.float32)
    weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for units in batches:
            out = [((np.asarray(u, dtype=np.float32) @ planes[: len(u)] > 0).reshape(TREES, BITS) * weight).sum(axis=1) for u in units]
            yield pd.Series(out, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            nodes, parts = batch["node"].to_numpy(), batch["part"].to_numpy()
            for lo, hi in runs([batch[c].to_numpy() for c in ("tree", "label", "dim")]):
                found = []
                for at in range(lo, hi, CHUNK // 2):
                    end = min(hi, at + CHUNK)
                    found += nearest(nodes[at:end], matrix(batch["x"].iloc[at:end]), parts[at:end], np.full(end - at, -2.0), k)
                    if end == hi:
                        break
                yield emitted(found)

    codes = points.select("label", "dim", "node", "part", "unit", F.pandas_udf(coded, "array<long>")("unit").alias("codes"))
    placed = codes.select("label", "dim", "node", "part", F.col("unit").cast("array<float>").alias("x"), F.posexplode("codes").alias("tree", "code"))
    order = ["tree", "label", "dim", "code"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "label", "dim", "node", "part", "x").mapInPandas(run, LIST)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """Each node's best ``k`` entries: ``node, best`` (array of sim and nbr, best first)."""
    return lists.groupBy("node").agg(F.slice(F.sort_array(F.collect_set(F.struct("sim", "nbr")), asc=False), 1, k).alias("best"))


def entries(graph: DataFrame) -> DataFrame:
    return graph.select("node", F.explode("best").alias("e")).select("node", F.col("e.nbr").alias("nbr"), F.col("e.sim").alias("sim"))


def descend(points: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """One round: entries found by comparing the neighbours of each vector with each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            via = batch["via"].to_numpy()
            cut = int(np.searchsorted(via, via[-1])) if via[0] != via[-1] else 0
            if cut == 0 and len(batch) > 4 * BLOCK:
                cut = len(batch)
            rest = batch.iloc[cut:]
            yield joined(batch.iloc[:cut])
        if rest is not None:
            yield joined(rest)

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return emitted([])
        nodes, parts, floor, x = part["node"].to_numpy(), part["part"].to_numpy(), part["floor"].to_numpy(), matrix(part["x"])
        found = []
        for lo, hi in runs([part["via"].to_numpy()]):
            for at in range(lo, hi, CHUNK):
                end = min(hi, at + CHUNK)
                found += nearest(nodes[at:end], x[at:end], parts[at:end], floor[at:end], k)
        return emitted(found)

    last = graph.select("node", F.when(F.size("best") >= k, F.element_at("best", -1)["sim"]).otherwise(-2.0).alias("floor"))
    vectors = points.join(last, "node", "left").select("node", "part", F.coalesce("floor", F.lit(-2.0)).alias("floor"), F.col("unit").cast("array<float>").alias("x"))
    one = entries(graph).select(F.col("node").alias("via"), F.col("nbr").alias("node"))
    both = one.unionByName(one.select(F.col("node").alias("via"), F.col("via").alias("node"))).distinct()
    return both.join(vectors, "node").repartition("via").sortWithinPartitions("via", "node").select("via", "node", "part", "floor", "x").mapInPandas(run, LIST)


def neighbour_graph(points: DataFrame, seed: int, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    width = points.agg(F.max("dim")).first()[0] or 1
    graph = written(merged(chunk_neighbours(points, width, seed, k), k), "nn-lists")
    size = graph.count() * k
    for _ in range(rounds):
        news = written(descend(points, graph, k), "nn-new")
        better = written(merged(entries(graph).unionByName(news), k), "nn-lists")
        changed = entries(better).join(entries(graph).select("node", "nbr"), ["node", "nbr"], "left_anti").count()
        discard(graph, news)
        graph = better
        if changed <= SETTLED * size:
            break
    return graph


def links_of(graph: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """List entries that are links in double precision: (a, b) with a < b."""
    near = entries(graph).where(F.col("sim") >= threshold - SLACK).select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b")).distinct()
    side = lambda c: points.select(F.col("node").alias(c), F.col("unit").alias(f"u{c}"))
    return near.join(side("a"), "a").join(side("b"), "b").where(dot("ua", "ub") >= threshold).select("a", "b")


def with_parts(points: DataFrame, links: DataFrame) -> DataFrame:
    """The points with ``part``, their component (their own node where they have no link)."""
    found = components(links)
    rest = points.drop("part")
    return written(rest.join(found, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "parts")


def counted(asks: DataFrame, cell: list[str], threshold: float) -> DataFrame:
    """``node, others`` from rows ``cell..., part, node, n, unit, asks``: in each cell and part the asking vectors meet the given ones."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in group.groupby("part"):
            asked, given = part[part["asks"]], part[~part["asks"]]
            if not len(asked) or not len(given):
                continue
            s = matrix(asked["unit"], np.float64) @ matrix(given["unit"], np.float64).T >= threshold
            s &= asked["node"].to_numpy()[:, None] != given["node"].to_numpy()[None, :]
            out.append(pd.DataFrame({"node": asked["node"].to_numpy(), "others": s @ given["n"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"node": pd.Series(dtype="int64"), "others": pd.Series(dtype="int64")})

    return asks.groupBy(*cell).applyInPandas(run, "node long, others long")


def count_links(points: DataFrame, threshold: float) -> DataFrame:
    """``node, others``: vectors of other classes linked to the node, inside its component."""
    sizes = points.groupBy("part").agg(F.count("*").alias("members")).where("members > 1")
    placed = written(points.join(sizes, "part").select("part", "node", "n", "unit", "members"), "linked")
    cols = ["part", "node", "n", "unit"]
    # Small components share cells of bounded size.
    small = placed.where(F.col("members") <= BLOCK)
    cells = max(1, -(-small.count() // (2 * BLOCK)))
    small = small.withColumn("cell", F.pmod(F.xxhash64("part"), F.lit(cells)))
    asks = small.select("cell", *cols, F.lit(True).alias("asks")).unionByName(small.select("cell", *cols, F.lit(False).alias("asks")))
    found = counted(asks, ["cell"], threshold)

    large = placed.where(F.col("members") > BLOCK)
    if large.limit(1).count():
        pivots = large.where("part = node").select("part", F.col("unit").alias("pivot"))
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("unit", "pivot"))))
        rings = large.join(pivots, "part").withColumn("angle", angle).withColumn("ring", F.floor(F.col("angle") / RING))
        rings = written(rings.select(*cols, "angle", "ring"), "rings")
        shape = rings.groupBy("part", "ring").agg(F.sum("n").alias("weight"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
        one, two = (shape.select("part", *[F.col(c).alias(f"{c}_{x}") for c in ("ring", "weight", "low", "high", "blocks")]) for x in (1, 2))
        limit = float(np.arccos(threshold))
        pairs = one.join(two, "part").where((F.col("low_2") - F.col("high_1") <= limit + ANGLE_SLACK) & (F.col("low_1") - F.col("high_2") <= limit + ANGLE_SLACK))
        pairs = pairs.withColumn("all", F.col("high_1") + F.col("high_2") <= limit - ANGLE_SLACK)
        sure = pairs.where("all").groupBy("part", F.col("ring_1").alias("ring")).agg(F.sum("weight_2").alias("weight"), F.max(F.col("ring_1") == F.col("ring_2")).alias("own"))
        found = found.unionByName(rings.join(sure, ["part", "ring"]).select("node", (F.col("weight") - F.when(F.col("own"), F.col("n")).otherwise(0)).alias("others")))
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        unsure = pairs.where("not all").withColumn("i", every("blocks_1")).withColumn("j", every("blocks_2")).select("part", "ring_1", "ring_2", "i", "j")
        dealt = rings.join(shape.select("part", "ring", "blocks"), ["part", "ring"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).select(*cols, "ring", "block")
        side = lambda ring, block, asks: dealt.withColumnRenamed("ring", ring).withColumnRenamed("block", block).join(unsure, ["part", ring, block]).select(
            *cols, "ring_1", "ring_2", "i", "j", F.lit(asks).alias("asks"))
        cell = ["part", "ring_1", "ring_2", "i", "j"]
        found = found.unionByName(counted(side("ring_1", "i", True).unionByName(side("ring_2", "j", False)), cell, threshold))
    return found.groupBy("node").agg(F.sum("others").alias("others"))


def audit(points: DataFrame, threshold: float, seed: int, sample: int = AUDIT) -> tuple[DataFrame, float]:
    """Compares about ``sample`` classes with all: the links that lead out of a component, and the recall."""
    share = min(1.0, sample / max(1, points.count()))
    drawn = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52) < share
    picked = points.where(drawn).select("node", "label", "dim", "part", "unit").limit(2 * sample).toPandas()
    shared = points.sparkSession.sparkContext.broadcast({key: (g["node"].to_numpy(), g["part"].to_numpy(), matrix(g["unit"], np.float64)) for key, g in picked.groupby(["label", "dim"])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits, missed = 0, []
            for key, g in batch.groupby(["label", "dim"]):
                if key not in shared.value:
                    continue
                nodes, parts, x = shared.value[key]
                own = g["node"].to_numpy()
                s = (x @ matrix(g["unit"], np.float64).T >= threshold) & (nodes[:, None] != own[None, :])
                out = s & (parts[:, None] != g["part"].to_numpy()[None, :])
                hits += int(s.sum())
                missed += [(int(nodes[i]), int(own[j])) for i, j in zip(*np.nonzero(out))]
            a, b = zip(*missed) if missed else ((), ())
            yield pd.DataFrame({"a": pd.array(a, dtype="Int64"), "b": pd.array(b, dtype="Int64"), "hits": np.zeros(len(a), np.int64)})
            yield pd.DataFrame({"a": pd.array([None], dtype="Int64"), "b": pd.array([None], dtype="Int64"), "hits": np.array([hits])})

    seen = written(points.select("node", "label", "dim", "part", "unit").mapInPandas(run, "a long, b long, hits long"), "audit")
    hits, missed = seen.agg(F.sum("hits"), F.count("a")).first()
    return seen.where("a is not null").select("a", "b"), 1 - missed / max(1, hits or 0)


def found_links(points: DataFrame, threshold: float, seed: int, k: int) -> DataFrame:
    """Links (a, b) by steps 1 to 4; none leads inside a ``part`` that is given."""
    graph = neighbour_graph(points, seed, k)
    links = written(links_of(graph, points, threshold), "links")
    parts = with_parts(points, links)
    full = graph.where(F.size("best") >= k).where(F.element_at("best", -1)["sim"] >= threshold - SLACK).select("node")
    crowded = parts.join(full, "node", "left_semi")
    for again in range(1, 12):
        if crowded.select("part").distinct().limit(2).count() < 2:
            break
        more = written(links_of(neighbour_graph(written(crowded, "crowded"), seed + again, k, rounds=1), points, threshold), "links")
        if not more.limit(1).count():
            break
        links = links.unionByName(more)
        parts = with_parts(points, links)
        crowded = parts.join(full, "node", "left_semi")
    return links


def audited_parts(points: DataFrame, threshold: float, seed: int) -> tuple[DataFrame, list[float]]:
    """The points with their component as ``part``, and the recall that each audit measured (the last is 1)."""
    links, recalls = None, []
    for again in range(ENLARGED + 1):
        found = found_links(points, threshold, seed + 100 * again, K << again)
        links = found if links is None else links.unionByName(found)
        parts = with_parts(points, links)
        missed, recall = audit(parts, threshold, seed + again)
        recalls.append(recall)
        if recall == 1:
            return parts, recalls
        links = links.unionByName(missed)
    raise RuntimeError(f"the neighbour graph still misses links after {ENLARGED} enlargements; recall by audit: {recalls}")


def group_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, seed: int = 11) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    rows = written(unit_vectors(embeddings), "units")
    sound = rows.where(F.col("unit").isNotNull() & F.col("vec_id").isNotNull())
    points = sound.groupBy("label", "unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).withColumn("dim", F.size("unit")).withColumn("part", F.col("node"))
    points = written(points, "classes")
    parts, _ = audited_parts(points, threshold, seed)
    counts = count_links(parts, threshold)
    classes = parts.join(counts, "node", "left").select("label", "unit", "n", "part", F.coalesce("others", F.lit(0)).alias("others"))
    placed = rows.join(classes, ["label", "unit"], "left")
    component = F.coalesce("part", "vec_id")
    return placed.select(
        "vec_id", F.coalesce(F.col("others") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
