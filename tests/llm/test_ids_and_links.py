"""Ids of any size beside null ids, and links that only whole candidate search finds."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import bpe, embed, media, minhash, warc

IDS = [None, 2**60 + 1, 5, -(2**61) - 1]


def test_ids_stay_as_they_are(spark):
    docs = spark.createDataFrame([(i, f"text of {i} " * 30, "clash") for i in IDS], "doc_id long, text string, n_tokens string").coalesce(1)
    for rows in (
        bpe.encode_documents(docs, bpe.default_tokenizer()), media.sniff_media(media.encode_samples(docs)), minhash.group_documents(docs),
    ):
        assert {r["doc_id"] for r in rows.collect()} == set(IDS)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a").alias("url"), F.lit("x" * 200).alias("html"))
    got = {r["page_id"]: r["refers_to"] for r in warc.archive_pages(pages).collect()}
    assert got == {i: None if i == min(IDS[1:]) else min(IDS[1:]) for i in IDS}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs, bpe.default_tokenizer()).count() == media.sniff_media(media.encode_samples(docs)).count() == minhash.group_documents(docs).count() == 0
    assert embed.group_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def groups_by_brute_force(ids, texts):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    lists, up = defaultdict(list), list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in lists[g])
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[top(i)] = top(j)
        for g in s:
            lists[g].append(i)
    low = defaultdict(lambda: 2**62)
    for i, d in enumerate(ids):
        low[top(i)] = min(low[top(i)], d)
    return {d: low[top(i)] for i, d in enumerate(ids)}


def test_pairs_inside_boilerplate_and_large_groups(spark):
    rng = random.Random(12)
    new = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    passage, base = [new() for _ in range(1000)], [new() for _ in range(80)]
    texts = []
    for _ in range(30):  # 0.759 with its partner, 0.741 with all others
        extra = [new() for _ in range(18)]
        texts += [" ".join([*passage, *extra, *[new() for _ in range(160)]]) for _ in range(2)]
    for _ in range(150):  # near copies of one text, some of which are alike only through others
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = new()
        texts.append(" ".join(copy))
    ids = rng.sample(range(-(10**6), 10**6), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    want = groups_by_brute_force(ids, texts)
    assert len({want[i] for i in ids[:60]}) == 30
    assert {r["doc_id"]: r["component_id"] for r in minhash.group_documents(docs).collect()} == want


def test_an_id_with_several_texts_is_one_node(spark):
    words = [[f"w{k}{j}" for j in range(30)] for k in range(2)]
    rows = [(7, " ".join(words[0])), (7, " ".join(words[1])), (3, " ".join([*words[0], "x"])), (4, " ".join([*words[1], "x"])), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.group_documents(docs).collect()} == {7: 3, 3: 3, 4: 3, 9: 9}


@pytest.mark.parametrize("n", [2500])
def test_isolated_pairs_and_a_dense_cone(spark, monkeypatch, n):
    rng = np.random.default_rng(3)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((n, 64)))
    shift = unit(rng.standard_normal((n // 5, 64))) * rng.uniform(0.1, 0.42, (n // 5, 1))
    cone = unit(rng.standard_normal(64)) + rng.uniform(0.02, 0.32, (700, 1)) * unit(rng.standard_normal((700, 64)))
    x = np.vstack([base, base[: n // 5] + shift, cone])
    ids = list(range(-len(x) // 2, -len(x) // 2 + len(x)))
    monkeypatch.setattr(embed, "BLOCK", 128)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embed.group_vectors(df).collect()}
    s = unit(x) @ unit(x).T >= 0.93
    assert [got[i] for i in ids] == (s.sum(axis=1) - 1).tolist()


def test_audit_counts_what_is_missed(spark, monkeypatch):
    x = np.eye(4)[[0, 0, 1, 1, 2]] + 0.01 * np.arange(20).reshape(5, 4)
    df = spark.createDataFrame([(i - 2, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    points = embed.unit_vectors(df).selectExpr("label", "unit", "vec_id as node", "1L as n", "size(unit) as dim", "vec_id as part")
    missed, recall = embed.audit(points, 0.93, seed=1)
    assert recall == 0 and {tuple(sorted(r)) for r in missed.collect()} >= {(-2, -1), (0, 1)}
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(embed, "found_links", lambda *a: none)
    parts, recalls = embed.audited_parts(points, 0.93, 1)
    assert recalls[0] == 0 and recalls[-1] == 1 and parts.where("node in (-2, -1)").select("part").distinct().count() == 1
