"""MinHash near-duplicates with bottom-k sketches from one hash function.

Sets. A text's words (ASCII white space apart, A-Z lower-cased) give its distinct five-word
shingles, each hashed once to 63 bits; a text with fewer words gives its whole sequence as the one shingle.

Classes. Texts with equal sets (128-bit digest of the sorted set) form a class; its smallest id represents it. From
here on only representatives take part, so exact copies never meet each other.

Candidates. A sketch holds the ``SKETCH`` smallest hashes. Sets of ``n`` shingles that are similar share at least
``shared(n)`` values of their sketches: by counting for sets up to 96, and for larger ones but for a chance of about
1e-5 at a similarity of exactly 0.75 (``LEAST`` is 4.6 standard deviations below the mean of the worst case, less likely
above it). So with all sketches put in one order, the first ``size - shared + k`` values of both hold ``k`` common ones. The order
is: values that few documents have, then frequent ones (``FREQUENT``), each by hash. These prefixes are the inverted lists;
a passage that many documents repeat enters the prefix of those alone whose sketch it nearly fills.

1. Each list links its members to its smallest member, long ones to their greatest as well; per member the leader with the greatest overlap goes on.
2. Lists of at most ``SMALL_LIST`` members emit the pairs that lie in different components; ``k`` lists in common are needed.
3. Longer lists are compared in blocks of about ``BLOCK`` members, each pair of blocks as one group. Left out are pairs inside
   one component, and pairs that meet in another long list anyway, as both have the same first one.
   Blocks hold a bounded number of hashes and carry the full sets, so each pair is decided there; a group gives a forest of links
   between components, not its pairs.

Union-sketch estimates drop pairs that are clearly apart (``MARGIN`` is over 4.6 standard deviations).

Verification. Exact Jaccard on the full sets, rebuilt from the whole texts. A leader's text is sent once to every
batch of its members (``BATCH`` at most), so hot leaders are spread and no pair carries two texts.

Edge cases. Null, empty and blank texts have an empty set and are linked with nothing. Rows that repeat an id are one
node, linked by any of their texts; each row has its own ``n_shingles``. Null ids are kept with a null component and take no part. Ids may be
any long. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, with_small_batches, written
from .graph import components

WORDS_PER_SHINGLE, PERCENT = 5, 75
SKETCH, LEAST, MARGIN, BATCH = 64, 32, 0.25, 256
#: Members of a list that emits pairs; documents from which on a value is frequent; at most so many frequent values are told apart.
SMALL_LIST, FREQUENT, FREQUENT_VALUES = 32, 32, 500_000
#: Members and hashes of a block of a long list, about.
BLOCK, BLOCK_HASHES = 1024, 1 << 18
NO_PAIRS = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})

_RANDOM = np.random.default_rng(20240101)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, WORDS_PER_SHINGLE, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64 and of its inverse, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (int64, not negative)."""
    if not isinstance(text, str) or not text:
        return np.empty(0, dtype=np.int64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    inside = np.r_[False, ~_SPACE[raw], False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.int64)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    n = min(WORDS_PER_SHINGLE, len(words))
    h = np.full(len(words) - n + 1, n * 0x632BE59BD9B4E019 % 2**64, dtype=np.uint64)
    for k in range(n):
        h += words[k : len(words) - n + 1 + k] * _PLACE[k]
    return np.unique((mix(h) >> np.uint64(1)).astype(np.int64))


def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            s = shingle_set(text)
            rows.append((len(s), blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, s[:SKETCH].copy()))
        yield pd.DataFrame(rows, columns=["n_shingles", "digest", "sketch"])


def whole_sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([shingle_set(t) for t in texts], dtype=object)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, digest, sketch`` of every document. The id stays in the JVM."""
    rows = with_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.pandas_udf(sketched, "n_shingles long, digest binary, sketch array<long>")(text_col).alias("s"))
    return rows.select("doc_id", "s.n_shingles", "s.digest", "s.sketch")


def shared(n: int) -> int:
    """Sketch values that a set of ``n`` shingles shares at least with any similar one."""
    # A partner has up to 4 n / 3 shingles; the values that its sketch leaves out may be common ones.
    whole = -(-PERCENT * n // 100)
    return whole if 100 * n <= PERCENT * SKETCH else min(whole, max(LEAST, SKETCH - (100 - PERCENT) * n // PERCENT - 1))


def needed(n: int) -> int:
    """Lists in common (``k``) that a pair of small lists needs by the set of ``n`` shingles."""
    return max(1, shared(n) // 8)


def frequent_values(reps: DataFrame) -> np.ndarray:
    """The values in the sketches of over ``FREQUENT`` representatives, sorted. Where there are more than ``FREQUENT_VALUES``, the bound is doubled
    until they fit; that moves work between the kinds of lists and changes no result."""
    counts = written(reps.select(F.explode("sketch").alias("key")).groupBy("key").count().where(F.col("count") > FREQUENT), "frequent")
    level = F.floor(F.log2(F.col("count") / FREQUENT)).cast("int")
    sizes = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("count")).collect()}
    lowest = max(sizes, default=0)
    held = 0
    while lowest >= 0 and held + sizes.get(lowest, 0) <= FREQUENT_VALUES:
        held += sizes.get(lowest, 0)
        lowest -= 1
    kept = counts.where(level > lowest).select("key").limit(FREQUENT_VALUES).toPandas()
    discard(counts)
    return np.sort(kept["key"].to_numpy(dtype=np.int64))


def prefixes(reps: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``doc, n, k, key, rare``: the prefix of every representative."""
    known = reps.sparkSession.sparkContext.broadcast(frequent)

    @F.pandas_udf("k int, rare int, keys array<long>")
    def chosen(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sizes, values in batches:
            rows = []
            for n, s in zip(sizes.tolist(), values):
                s = np.asarray(s, dtype=np.int64)
                at = np.searchsorted(known.value, s)
                often = at < len(known.value)
                often[often] = known.value[at[often]] == s[often]
                k = needed(n)
                keys = np.concatenate([s[~often], s[often]])[: min(len(s), len(s) - shared(n) + k)]
                rows.append((k, min(len(keys), int((~often).sum())), keys))
            yield pd.DataFrame(rows, columns=["k", "rare", "keys"]).astype({"k": "int32", "rare": "int32"})

    rows = reps.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), chosen("n_shingles", "sketch").alias("p"))
    rows = rows.select("doc", "n", F.col("p.k").alias("k"), F.col("p.rare").alias("n_rare"), F.posexplode("p.keys").alias("at", "key"))
    return rows.select("doc", "n", "k", "key", (F.col("at") < F.col("n_rare")).alias("rare"))


def listed(reps: DataFrame) -> DataFrame:
    """Inverted lists with two members or more: ``key, doc, n, k, size, leader, other_leader``.

    Heads of frequent values are bounded in number and sent to the rows, so that no long list passes through one task.
    """
    rows = prefixes(reps, frequent_values(reps))
    heads = lambda df: df.groupBy("key").agg(F.count("*").alias("size"), F.min("doc").alias("leader"), F.max("doc").alias("other_leader")).where("size > 1")
    rare, often = rows.where("rare"), rows.where("not rare")
    return rare.join(heads(rare), "key").unionByName(often.join(F.broadcast(heads(often)), "key")).drop("rare")


def estimated(a: Column, b: Column) -> Column:
    """Jaccard estimate from the union's sketch; exact if both sets are no larger than a sketch."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def similar_size(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``a, b`` of the pairs that sizes and sketches do not rule out."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    sized = pairs.join(side("b"), "b").join(side("a"), "a").where(similar_size("n_a", "n_b"))
    return sized.where(estimated(F.col("s_a"), F.col("s_b")) >= PERCENT / 100 - MARGIN).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= PERCENT * union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leader, wholes = None, []
        for batch in batches:
            out = []
            for a, b, member, text in zip(batch["a"], batch["b"], batch["member"], batch["text"]):
                own = shingle_set(text)
                if not member:
                    wholes = [*wholes, own] if leader == (a, False) else [own]
                    leader = (a, False)
                    continue
                if leader is None or leader[0] != a:
                    raise ValueError(f"document {a} has no text")
                leader = (a, True)
                for whole in wholes:
                    common = len(np.intersect1d(own, whole, assume_unique=True))
                    if common and 100 * common >= PERCENT * (len(own) + len(whole) - common):
                        out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    # Members of one leader are dealt in batches; the leader's text comes first in each.
    sizes = pairs.groupBy("a").agg(F.count("*").alias("members"))
    dealt = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / BATCH))).select("a", "b", "salt")
    wanted = written(dealt, "pairs")
    if not wanted.limit(1).count():
        return wanted.select("a", "b")
    roles = wanted.select(F.col("b").alias("doc_id"), "a", "b", "salt", F.lit(True).alias("member")).unionByName(
        wanted.select("a", "salt").distinct().select(F.col("a").alias("doc_id"), "a", F.col("a").alias("b"), "salt", F.lit(False).alias("member")))
    # Texts are dealt by id at every size; the pairs grow with the corpus and are not broadcast.
    texts = docs.select("doc_id", "text").join(roles.hint("merge"), "doc_id")
    first = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "b")
    found = written(first.select("a", "b", "member", "text").mapInPandas(run, "a long, b long").distinct(), "links")
    discard(wanted)
    return found


def pairs_across(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a < b) of different components and similar sizes that meet in enough of the small lists."""
    placed = lists.where(F.col("size") <= SMALL_LIST).join(parts.withColumnRenamed("node", "doc"), "doc").select("key", "doc", "n", "k", "component")
    other = placed.select("key", *[F.col(c).alias(f"{c}_2") for c in ("doc", "n", "k", "component")])
    met = placed.join(other, "key").where("doc < doc_2 and component <> component_2").where(similar_size("n", "n_2"))
    enough = met.groupBy(F.col("doc").alias("a"), F.col("doc_2").alias("b")).agg(F.count("*").alias("lists"), F.min(F.least("k", "k_2")).alias("k"))
    return enough.where("lists >= k").select("a", "b")


def block_pairs(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """The long lists that span several components, as pairs of blocks: ``key, i, j, second, doc, component``.

    A list's members fall into kinds by two marks: their component, if many of the list have it, and their first long list, if
    that is another list and many have it. Kinds that agree in a mark need not meet here. Kinds are cut into blocks by
    hash; each pair of blocks is one group.
    """
    long = lists.where(F.col("size") > SMALL_LIST).select("key", "doc", "n")
    placed = long.join(long.groupBy("doc").agg(F.min("key").alias("first")), "doc").join(parts.withColumnRenamed("node", "doc"), "doc")
    spread = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    placed = written(placed.join(spread, "key"), "members")
    big = placed.groupBy("key", "component").agg(F.count("*").alias("n_component")).where(F.col("n_component") >= BLOCK)
    again = placed.where("first <> key").groupBy("key", "first").agg(F.count("*").alias("n_first")).where(F.col("n_first") >= BLOCK)
    mark = lambda n, of: F.when(F.col(n).isNotNull(), F.array(of)).otherwise(F.array().cast("array<long>"))
    kinds = placed.join(big, ["key", "component"], "left").join(again, ["key", "first"], "left").select(
        "key", "doc", "n", "component", F.struct(mark("n_component", "component").alias("component"), mark("n_first", "first").alias("first")).alias("kind"))
    sizes = kinds.groupBy("key", "kind").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_HASHES)).alias("n_blocks"))
    blocks = sizes.select("key", "kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    mine, other = (blocks.select("key", F.struct("kind", "block").alias(x)) for x in ("i", "j"))
    agree = F.arrays_overlap("i.kind.component", "j.kind.component") | F.arrays_overlap("i.kind.first", "j.kind.first")
    asked = mine.join(other, "key").where((F.col("i") <= F.col("j")) & ~agree)
    seats = asked.select("key", "i", "j", F.col("i").alias("own"), F.lit(False).alias("second")).unionByName(
        asked.where("i <> j").select("key", "i", "j", F.col("j").alias("own"), F.lit(True).alias("second")))
    dealt = kinds.join(sizes, ["key", "kind"]).withColumn("own", F.struct("kind", F.pmod(F.xxhash64("doc", F.lit("block")), F.col("n_blocks")).alias("block")))
    return dealt.select("key", "own", "doc", "component").join(seats, ["key", "own"]).select("key", "i", "j", "second", "doc", "component")


def common_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Numbers of common values of all rows of two lists of sorted arrays."""

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(rows) if rows else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        order = np.argsort(values, kind="stable")
        return values[order], row[order]

    found = np.zeros((len(one), len(two)), dtype=np.float32)
    (v1, r1), (v2, r2) = flat(one), flat(two)
    u1, at1, n1 = np.unique(v1, return_index=True, return_counts=True)
    u2, at2, n2 = np.unique(v2, return_index=True, return_counts=True)
    _, x, y = np.intersect1d(u1, u2, assume_unique=True, return_indices=True)
    at1, n1, at2, n2 = at1[x], n1[x], at2[y], n2[y]
    # Values that many rows hold are counted by matrix products, the others row by row.
    dense = np.flatnonzero(n1 * n2 > 2048)
    for lo in range(0, len(dense), 1024):
        words = dense[lo : lo + 1024]

        def marks(at: np.ndarray, n: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
            out = np.zeros((size, len(words)), dtype=np.float32)
            for k, w in enumerate(words):
                out[row[at[w] : at[w] + n[w]], k] = 1
            return out

        found += marks(at1, n1, r1, len(one)) @ marks(at2, n2, r2, len(two)).T
    sparse = np.flatnonzero(n1 * n2 <= 2048)
    for lo in range(0, len(sparse), 1024):
        w = sparse[lo : lo + 1024]
        a, b = n1[w], n2[w]
        inside = np.arange(int((a * b).sum())) - np.repeat(np.cumsum(a * b) - a * b, a * b)
        width = np.repeat(b, a * b)
        p = r1[np.repeat(at1[w], a * b) + inside // width]
        q = r2[np.repeat(at2[w], a * b) + inside % width]
        found += np.bincount(p * len(two) + q, minlength=found.size).reshape(found.shape)
    return found


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of the pairs that join two trees, taken in their order."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            kept.append(k)
    return kept


def judged(part: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of blocks: a forest of its components."""
    doc, comp, values = (part[c].to_numpy() for c in ("doc", "component", "hashes"))
    second = part["second"].to_numpy()
    same = not second.any()
    one, two = (np.arange(len(part)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
    if not len(one) or not len(two):
        return NO_PAIRS
    c = common_counts([values[k] for k in one], [values[k] for k in two])
    n = np.array([len(v) for v in values])
    linked = (c > 0) & (100 * c >= PERCENT * (n[one][:, None] + n[two][None, :] - c)) & (comp[one][:, None] != comp[two][None, :])
    r, s = np.nonzero(linked)
    p, q = one[r], two[s]
    chosen = forest(comp[p], comp[q])
    p, q = p[chosen], q[chosen]
    return pd.DataFrame({"a": np.minimum(doc[p], doc[q]), "b": np.maximum(doc[p], doc[q])})


def links_in_blocks(lists: DataFrame, parts: DataFrame, docs: DataFrame) -> DataFrame:
    """``a, b``: links between components in the long lists, decided on the whole sets; they join all that the lists' links join."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            for name, part in batch.groupby("cell", sort=False):
                if name != last and rest:
                    yield judged(pd.concat(rest, ignore_index=True))
                    rest = []
                last = name
                rest.append(part)
        if rest:
            yield judged(pd.concat(rest, ignore_index=True))

    asked = written(block_pairs(lists, parts), "blocks")
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(asked.select("doc").distinct().hint("merge"), "doc")
    sets = written(texts.select("doc", F.pandas_udf(whole_sets, "array<long>")("text").alias("hashes")), "sets")
    cells = asked.join(sets.hint("merge"), "doc").select(F.to_json(F.struct("key", "i", "j")).alias("cell"), "second", "doc", "component", "hashes")
    found = written(cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "a long, b long").distinct(), "block-links")
    discard(asked, sets)
    return found


def joined_parts(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` of all representatives."""
    everyone = reps.select(F.col("doc_id").alias("node")).distinct()
    return written(everyone.join(components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "parts")


def duplicate_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Verified links (a, b) that join every component of representatives."""
    lists = written(listed(reps), "lists")

    def best(leader: str, rows: DataFrame) -> DataFrame:
        met = rows.where(F.col("doc") != F.col(leader)).groupBy(F.col(leader).alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("n"))
        return met.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))

    tried = best("leader", lists).unionByName(best("other_leader", lists.where(F.col("size") > SMALL_LIST)))
    edges = verified(likely(tried, reps), docs)

    parts = joined_parts(reps, edges)
    edges = edges.unionByName(verified(likely(pairs_across(lists, parts), reps), docs))
    if not lists.where(F.col("size") > SMALL_LIST).limit(1).count():
        return edges
    return edges.unionByName(links_in_blocks(lists, joined_parts(reps, edges), docs))


def group_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(sketches(docs), "sketches")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = known.join(classes, "digest").where("doc_id = rep").dropDuplicates(["digest"]).select("doc_id", "n_shingles", "sketch")
    reps = written(reps, "representatives")
    # An id with several texts joins their classes.
    several = known.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    own = known.select("doc_id", "digest").join(several, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(duplicate_links(docs, reps).unionByName(own))
    placed = rows.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    placed = placed.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    placed = placed.join(found, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    return placed.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, with its columns unchanged. Rows without an id all stay; of rows that repeat the kept id and its text one stays."""
    kept = group_documents(docs).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    chosen = docs.join(kept, F.col("doc_id") == F.col("__kept_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return chosen.unionByName(docs.where(F.col("doc_id").isNull()))
