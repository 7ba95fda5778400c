"""Audit of how the term frequencies of each language's sources differ, with exact integer arithmetic.

Statistics. ``p`` of a term in a group of ``N`` kept occurrences is ``1 + floor(10**9 * (count + 2) / (N + 2 * V))`` with ``V`` kept terms;
two values differ by ``f(p, q) = floor((p - q)**2 / (p + q))``. A pair of sources has the sum of ``f`` over all kept terms.

Tree. A kept term is a row of (source, count) entries in the order of sources, counts above zero only. With both counts zero a term adds the pair's
base ``f(p0, q0)``, one count above zero adds a correction that depends on it alone (summed up from a histogram of counts), and
two add a joint correction. Joint corrections come from a frequent-pattern tree: rows are inserted with their multiplicity, rows that begin alike share a
path, and each node adds its correction with each of its ancestors once, times its multiplicity. Equal rows are merged first; then rows are range-partitioned
and sorted, so a task walks its part of the tree depth first with one path in memory. A path cut by a partition's border is a node
on either side with its own multiplicity, which adds up to the same sums.

Edge cases. Null text, lang and source are read as ''. Groups without terms have count 0 everywhere; a language without kept terms has pair values 0 and no term rows.
Ties are ordered by the item's bytes. Each row is a document, repeated ones too; other columns are ignored; empty tables give no rows. A term
may be of any length; texts are cut into pieces between terms before they are split.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import with_small_batches, written

#: Every byte outside of terms as a blank, A-Z as a-z; bytes from 0x80 on belong to characters of terms.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a text that are split at once; entries that a task gathers before it hands them on; sums that a tree walk holds.
PIECE_BYTES, HELD_TERMS, HELD_PAIRS = 1 << 22, 300_000, 1_000_000
SCALE = 1_000_000_000


def text_terms(text: bytes) -> Iterator[list[bytes]]:
    data, at = text.translate(TERM_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts ``lang, source, term, n, docs``; a null term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [[lang] * (len(terms) + 1), [source] * (len(terms) + 1), pa.array([*terms, None], pa.binary()).cast(pa.string()), [*n.values(), 0], [*map(docs.__getitem__, terms), 0]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in text_terms(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from flushed()
    yield from flushed()


def p_of(count: str, n: str, v: str) -> Column:
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 2 as decimal(19, 0))) div nullif(cast({n} + 2 * {v} as decimal(19, 0)), 0)")


def f_of(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def term_rows(docs: DataFrame, least_docs: int) -> DataFrame:
    """``lang, term, total, entries`` (source and count) of each kept term; the row with a null term lists the language's sources."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = with_small_batches(docs).select(read("lang"), read("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = found.mapInArrow(count_batches, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("entries"))
    return rows.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).drop("docs")


def f_np(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def walk_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joint corrections ``lang, a, b, value`` of the tree of sorted rows ``lang, path, times``; a path's entries are ``no, n, p, p0``."""
    lang, path, times = None, np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
    codes, sums, held = [], [], 0

    def close(depth: int) -> None:
        """Nodes from ``depth`` on are complete: each is taken with all its ancestors, its multiplicity passes on to its parent."""
        nonlocal held
        size = len(path)
        if depth == size:
            return
        times[depth:] = np.cumsum(times[depth:][::-1])[::-1]
        if depth:
            times[depth - 1] += times[depth]
        step = max(1, HELD_PAIRS // size)
        for lo in range(max(depth, 1), size, step):
            node, above = path[lo : min(lo + step, size), None], path[None, : min(lo + step, size) - 1]
            p, p0, q, q0 = node[..., 2], node[..., 3], above[..., 2], above[..., 3]
            joint = (f_np(p, q) - f_np(p, q0) - f_np(p0, q) + f_np(p0, q0)) * times[lo : lo + step, None]
            at, up = np.nonzero(np.arange(joint.shape[1])[None] < np.arange(lo, lo + joint.shape[0])[:, None])
            codes.append(above[0, up, 0] << 32 | node[at, 0, 0])
            sums.append(joint[at, up])
            held += len(at)
            if held > HELD_PAIRS:
                merge()

    def merge() -> None:
        nonlocal held
        if codes:
            code, where = np.unique(np.concatenate(codes), return_inverse=True)
            value = np.zeros(len(code), np.int64)
            np.add.at(value, where, np.concatenate(sums))
            codes[:], sums[:], held = [code], [value], len(code)

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal held
        merge()
        if codes:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * held), pa.array(codes[0] >> 32), pa.array(codes[0] & (2**32 - 1)), pa.array(sums[0])], ["lang", "a", "b", "value"])
        codes.clear()
        sums.clear()
        held = 0

    for batch in batches:
        lists = batch.column(1)
        ends, fields = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        entries = np.stack([fields.field(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
        for k, (own, m) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            row = entries[ends[k] : ends[k + 1]]
            if own != lang:
                close(0)
                yield from flushed()
                lang, path, times = own, row[:0], times[:0]
            shared = min(len(row), len(path))
            differs = np.flatnonzero((row[:shared, :2] != path[:shared, :2]).any(axis=1))
            shared = int(differs[0]) if len(differs) else shared
            close(shared)
            path, times = row, np.concatenate([times[:shared], np.zeros(len(row) - shared, np.int64)])
            times[-1] += m
            if held > HELD_PAIRS // 2:
                yield from flushed()
    close(0)
    yield from flushed()


def audit(docs: DataFrame, least_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: per group all other sources of its language by distance, and the terms that mark it most against the language."""
    rows = written(term_rows(docs, least_docs), "terms")
    kept, groups = rows.where("term is not null"), rows.where("term is null").select("lang", F.explode("entries").alias("e")).select("lang", "e.source")
    langs = groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n")), "lang", "left").na.fill(0)
    entries = kept.select("lang", "term", "total", F.explode("entries").alias("e")).select("lang", "term", "total", "e.source", "e.n")
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = groups.join(langs, "lang").join(sizes, ["lang", "source"], "left").na.fill(0, ["group_n"])
    groups = written(groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")).withColumn("p0", p_of("0", "group_n", "v")), "groups")
    flat = entries.join(groups, ["lang", "source"]).withColumn("p", p_of("n", "group_n", "v")).withColumn("q", p_of("total", "lang_n", "v"))
    flat = written(flat.select("lang", "source", "term", "no", "n", "p", "p0", "q"), "entries")

    terms = flat.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(f_of("p", "q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    paths = flat.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("no", "n", "p", "p0"))).alias("path")).groupBy("lang", "path").agg(F.count("*").alias("times"))
    paths = written(paths, "paths").repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    joint = paths.mapInArrow(walk_tree, "lang string, a long, b long, value long")
    own = groups.select("lang", F.col("no").alias("a"), F.col("p0").alias("p0"), "v")
    other = groups.select("lang", F.col("no").alias("b"), F.col("p0").alias("q0"))
    base = own.join(other, "lang").where("a < b").select("lang", "a", "b", F.expr(f"if(v = 0, 0L, v * ({f_of('p0', 'q0')}))").alias("value"))
    counted = flat.groupBy("lang", F.col("no").alias("a"), "p", "p0").agg(F.count("*").alias("times"))
    single = counted.join(other, "lang").where("a <> b").select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr(f"times * ({f_of('p', 'q0')} - {f_of('p0', 'q0')})").alias("value"))
    pairs = base.unionByName(single).unionByName(joint).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("s")).select("lang", "value", "s.*")
    names = lambda no, name: groups.select("lang", F.col("no").alias(no), F.col("source").alias(name))
    pairs = pairs.join(names("a", "source"), ["lang", "a"]).join(names("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top_terms))
