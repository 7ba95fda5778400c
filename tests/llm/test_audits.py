"""Sharding, source divergence and tokenizer alignment against brute force, on odd rows too."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256
from itertools import groupby

import numpy as np
import pytest

divergence = pytest.importorskip("tidebar.llm.divergence")
sharding = pytest.importorskip("tidebar.llm.sharding")
tokalign = pytest.importorskip("tidebar.llm.tokalign")
public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string"


def words(seed: int, n: int, least: str = "abcdefgh") -> str:
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list(least), draw.integers(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    rows = [(i, words(i % 150, 5 + i % 40), ["en", "de", None][i % 3], ["a", "b", "c", None, "é"][i % 5]) for i in range(400)]
    rows += [(1000 + i, "one text that a third of all rows repeat", "en", "hot") for i in range(250)]
    rows += [(None, None, "en", "a"), (None, "", None, None), (7, "Ünï x Ünï", "fr", "only"), (8, words(9, 30_000), "en", "b"), (8, "again", "en", "b"), (8, "again", "en", "b"), (-5, "12 34", "none", "empty")]
    return rows


# sharding


def sharded(rows: list[tuple], shards: int) -> list[tuple]:
    """Every record's shard and slot from one sorted list."""
    records = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        key = (int(md5(raw).hexdigest()[:10], 16) << 20) + int(md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:5], 16)
        records.append((key, (doc_id is not None, doc_id or 0), zlib.crc32(raw), len(raw) + 1, doc_id))
    records.sort(key=lambda r: r[:3])
    total, at, out = sum(r[3] for r in records), 0, []
    for _, group in groupby(records, key=lambda r: r[0] >> 20):
        group = list(group)
        size, start = sum(r[3] for r in group), at
        for r in group:
            twice = 2 * start + size if size * shards * sharding.GROUP_PARTS <= total else 2 * at + r[3]
            out.append((r, min(shards - 1, twice * shards // (2 * total))))
            at += r[3]
    slots: Counter = Counter()
    result = []
    for r, s in out:
        result.append((r[4], r[3], r[2], s, slots[s]))
        slots[s] += 1
    return result


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_equal_one_sorted_list(spark, shards):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "shard").withColumnRenamed("source", "key").repartition(5)
    got = sharding.shard_documents(docs, shards)
    key = lambda r: [(x is not None, x or 0) for x in r]
    assert sorted([(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got.collect()], key=key) == sorted(sharded(rows, shards), key=key)
    assert {(r["law"], r["grown_shard"]) for r in got.collect()} == {("bytes", None)}


def test_hot_texts_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_ROWS", 8)
    rows = [(i, "hot text " * 3, "en", "a") for i in range(3000)] + [(i, None if i % 2 else "", "en", "a") for i in range(3000, 6000)] + [(i, words(i, 12), "en", "a") for i in range(6000, 7000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    lines = sharding.split_ranges(sharding.records(docs).cache(), sum(len((r[1] or "").encode()) + 1 for r in rows), len(rows))[1]
    assert lines["n"].max() < 200 and lines["n"].sum() == len(rows)
    got = sharding.shard_documents(docs, 8).groupBy("shard").agg({"size": "sum", "slot": "max", "doc_id": "count"}).collect()
    sizes = [r["sum(size)"] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= max(sum(sizes) / 8 / 64, 200)
    assert all(r["max(slot)"] + 1 == r["count(doc_id)"] for r in got)


def test_written_shards_hold_the_records(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    planned = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard_documents(docs, 4).collect()}
    for r in back.collect():
        assert planned[r["doc_id"], zlib.crc32((r["text"] or "").encode())] == r["shard"]


def test_shards_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard_documents(empty).collect() == []
    sharding.write_shards(empty, str(tmp_path / "none"))


# divergence


def audited(rows: list[tuple], least: int, top: int) -> set[tuple]:
    """Every pair and term by the definition, in Python integers."""
    docs = defaultdict(lambda: defaultdict(Counter))
    seen = defaultdict(Counter)
    for _, text, lang, source in rows:
        lower = (text or "").encode().lower().decode()
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        docs[lang or ""][source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = set()
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    for lang, groups in docs.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        p = {}
        for name, n in [*groups.items(), (None, sum(groups.values(), Counter()))]:
            total = sum(n[t] for t in kept)
            p[name] = {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}
        for s, n in groups.items():
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [("term", t, f(p[s][t], p[None][t])) for t in kept if n[t] and p[s][t] > p[None][t]]
            for part, most in ((pairs, len(pairs)), (terms, top)):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
                out |= {(lang, s, *x, k + 1) for k, x in enumerate(part[:most])}
    return out


@pytest.mark.parametrize("least", [1, 10, 10_000])
def test_divergence_equals_the_definition(spark, least):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("doc_id", "item").repartition(7)
    got = divergence.audit(docs, least_docs=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = list(map(tuple, got.collect()))
    assert len(found) == len(set(found)) and set(found) == audited(rows, least, 10)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_walk_in_parts_and_with_small_buffers(monkeypatch):
    import pyarrow as pa

    draw = np.random.default_rng(3)
    paths = sorted({tuple((int(s), int(draw.integers(1, 3))) for s in sorted(draw.choice(12, draw.integers(1, 9), replace=False))) for _ in range(400)})
    entry = pa.struct([("no", pa.int64()), ("n", pa.int64()), ("p", pa.int64()), ("p0", pa.int64())])
    rows = [{"lang": "x" if k < 300 else "y", "path": [{"no": s, "n": n, "p": 1000 * n + 7 * s, "p0": 500 + s} for s, n in path], "times": 1 + k % 4} for k, path in enumerate(paths)]
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    want: Counter = Counter()
    for r in rows:
        for j, b in enumerate(r["path"]):
            for a in r["path"][:j]:
                want[r["lang"], a["no"], b["no"]] += r["times"] * (f(a["p"], b["p"]) - f(a["p"], b["p0"]) - f(a["p0"], b["p"]) + f(a["p0"], b["p0"]))
    schema = pa.schema([("lang", pa.string()), ("path", pa.list_(entry)), ("times", pa.int64())])
    for held in (20, 1_000_000):
        monkeypatch.setattr(divergence, "HELD_PAIRS", held)
        got: Counter = Counter()
        for part in (rows[:130], rows[130:]):
            for b in divergence.walk_tree(iter([pa.RecordBatch.from_pylist(part[k : k + 50], schema=schema) for k in range(0, len(part), 50)])):
                for r in b.to_pylist():
                    got[r["lang"], r["a"], r["b"]] += r["value"]
        assert +got == +want and -got == -want


def test_terms_of_a_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 7)
    text = ("Ab-c1 Éé_" * 50).encode()
    assert [t for part in divergence.text_terms(text) for t in part] == re.findall(rb"[a-z\x80-\xff]+", text.lower())


# alignment


def aligned_whole(text: str | None, a, b, made) -> tuple[list, list]:
    """Groups and links of one text from both libraries, by all pairs of ends."""
    if not text:
        return [], []
    shown = " " + text
    ids_a, ids_b = a.encode(shown, add_special_tokens=False).ids, b.encode(text)
    raw = {"a": [made.bytes_a[i] for i in ids_a], "b": [made.bytes_b[i] for i in ids_b]}
    if any(b"".join(x) != shown.encode() for x in raw.values()):
        return [], []
    ends_a, ends_b = [np.cumsum([len(x) for x in raw[k]]).tolist() for k in "ab"]
    links = [(ids_a[i], ids_b[j]) for i, x in enumerate(ends_a) for j, y in enumerate(ends_b) if x == y] if len(ids_a) < 3000 else [(ids_a[ends_a.index(e)], ids_b[ends_b.index(e)]) for e in ends_a if e in set(ends_b)]
    groups, i, j = [], 0, 0
    for e in [e for e in ends_a if e in set(ends_b)]:
        i2, j2 = ends_a.index(e) + 1, ends_b.index(e) + 1
        groups.append(",".join(map(str, ids_a[i:i2])) + "|" + ",".join(map(str, ids_b[j:j2])))
        i, j = i2, j2
    return groups, links


TEXTS = [
    None, "", " ", "  lead and trail  ", "tab\tand\nline\r\n  deep   gaps", "a▁b stands apart", "<|endoftext|> <s>x</s> <unk> <0x0A>", "Straße naïve café 日本語 😀 é", "\x00\x1c　x y  z",
    "x" * 900, "word " * 700, "the cat sat on the mat. The cat sat!", "the cat sat on the mat. The cat sat!", "antidisestablishmentarianism  is\n\n a word 12345,678", "ünï ßß ▁", "don't they'll we've " * 20,
]


@pytest.mark.parametrize("block_chars", [40, 4_000_000])
def test_alignment_equals_the_libraries_on_whole_texts(spark, block_chars):
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = tokalign.default_tokenizers()
    a, b, made = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), tokalign.Aligner(path_a, path_b)
    a.encode_special_tokens = True
    texts = TEXTS + [words(k, 60, "abcdeéß日 ▁\n"[: 4 + k % 7]) for k in range(40)]
    rows = [(k if k % 9 else None, t, "en", "s") for k, t in enumerate(texts)]
    brute = [aligned_whole(t, a, b, made) for t in texts]
    counts = Counter(x for _, links in brute for x in links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    want = []
    for (doc_id, text, *_), (groups, links) in zip(rows, brute):
        n = [sum(g.split("|")[k].count(",") + 1 for g in groups) for k in (0, 1)]
        want.append((doc_id, *n, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "block").withColumnRenamed("source", "links").repartition(3)
    got = list(map(tuple, tokalign.crosswalk(docs, path_a, path_b, block_chars=block_chars).collect()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(1 for r in want if r[1] == 0) >= 4


def test_alignment_keeps_groups_and_survives_a_full_memo(spark):
    path_a, path_b = tokalign.default_tokenizers()
    small, large = tokalign.Aligner(path_a, path_b, memo_pieces=5), tokalign.Aligner(path_a, path_b)
    texts = [t for t in TEXTS if t]
    assert [small.documents([t])[0] for t in texts] == large.documents(texts)
    docs = spark.createDataFrame([(1, "a cat"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in tokalign.align_documents(docs, path_a, path_b, keep_groups=True).collect()}
    assert got[1]["groups"].count("|") == got[1]["n_groups"] == len(got[1]["links"]) and got[2]["groups"] == "" and got[2]["links"] == []


def test_alignment_of_an_empty_table(spark):
    assert tokalign.crosswalk(spark.createDataFrame([], SCHEMA), *tokalign.default_tokenizers()).collect() == []


def test_words_one_blank_apart_are_cut_without_the_pattern(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for letters in ("abé \n\t\r\x85　\x1c", "ab é\n", "abcdefgh \n") for _ in range(2000)]
    assert all(tokalign.pieces_of(t) == tokalign.BORDER.split(" " + t) for t in texts)
    monkeypatch.setattr(tokalign, "BORDER", None)
    path_a, path_b = tokalign.default_tokenizers()
    assert tokalign.pieces_of("a cat\nsat down") == [" a", " cat", "\nsat", " down"]
    assert tokalign.Aligner(path_a, path_b).documents(["a cat\nsat down"])[0][0] > 0
