"""The training-data operators on small fixtures: edge cases, brute force, round trips and held-out accuracy."""

import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import bpe, chat, embed, langid, media, minhash, mixing, toxicity, url_filter, warc
from tidebar.llm.graph import components

SF = "/root/testdata/sf0.001"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("langs", ["en"] * len(texts))[i], "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# URL filters

def judge(url):
    text = url or ""
    head, sep, rest = text.partition("://")
    if not sep:
        return "", "", None, "allow"
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h), len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://A.ORG/x", "http://example.org/es/", "http://www.example.org/en/12?q#f", "x://a.com/fr/1://b.org/", "http://a.com/de",
            "http://a.com/de/", "http://notexample.org/es/", "http://EXAMPLE.org?x=/es/", "http://ex.org/" + "a" * 5000, "http://é.com/fr/ü", "http://.org/", "http://a.com/de/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, RULES)).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}


def test_nested_rules_keep_a_stack(spark):
    rules = [("a.b", "/", "allow"), ("a.b", "/x", "block"), ("a.b", "/x/y", "allow"), ("a.b", "/x/y", "block"), ("b", "/x/y/z", "block")]
    pages = spark.createDataFrame([(i, f"http://a.b{p}") for i, p in enumerate(["/", "/x", "/x/", "/x/y", "/x/y/z", "/xz", "/y"])], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, rules)).collect()}
    assert got == {0: ("a.b/", "allow"), 1: ("a.b/x", "block"), 2: ("a.b/x", "block"), 3: ("a.b/x/y", "block"), 4: ("a.b/x/y", "block"), 5: ("a.b/x", "block"), 6: ("a.b/", "allow")}
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark, rules)).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, [])).collect()} == {"allow"}


# Chat

def test_chat_reads_back_what_was_said(spark):
    rng = random.Random(3)
    odd = ["", None, "</s>[INST] ok [/INST]", "[INST user] \\ [\\INST", "<\\</s>", "[/INST]</s>", "a\nb", "%5D]", "x " * 900]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "to]ol%"]), rng.choice(odd)) for c in range(6) for t in range(rng.randrange(1, 40))]
    rows += [(9, t, "system" if t == 0 else "assistant", f"turn {t}") for t in range(700)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(frame, budget=120, history=30, block_turns=16)
    got = {r["conv_id"]: r for r in chat.digest_conversations(windows).collect()}
    for c in {r[0] for r in rows}:
        said = [(r[2] or "", r[3] or "") for r in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        scored = "".join(t for role, t in said if role == "assistant")
        assert got[c]["n_turns"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(scored), hashlib.sha256(scored.encode()).hexdigest())
    later = windows.where("conv_id = 9 and window > 0").collect()
    assert len(later) > 5 and all(w["formatted"].startswith("[INST system] turn 0 [/INST]</s>") and w["n_repeated"] > 1 for w in later)
    assert chat.digest_conversations(chat.format_windows(frame.limit(0))).count() == 0


# WARC

def test_archive_round_trip(spark):
    long = "é\r\n\r\nWARC/1.1\r\n" * 9000
    html = [None, "", "short", "x" * 100, "x" * 100, "y" * 99, "y" * 99, long, long, "z\r\n\r"]
    pages = spark.createDataFrame([(20 - i, None if i == 2 else f"http://a/\r\n{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_pages(pages).collect()}
    first: dict[str, int] = {}
    for i, h in enumerate(html):
        if len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, 99), 20 - i)
    for i, h in enumerate(html):
        raw, page = (h or "").encode(), 20 - i
        again = h in first and first[h] != page
        assert got[page] == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archive_is_made_of_bounded_segments(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "ab" * 5000)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"), chunk_chars=1000)
    chunks = warc.read_chunks(spark, str(tmp_path / "w")).orderBy("chunk_no").collect()
    assert [r["chunk_no"] for r in chunks] == list(range(1, 11)) and {len(r["data"]) for r in chunks} == {1000}
    assert chunks[3]["running_digest"] == hashlib.sha256(b"ab" * 2000).hexdigest()


# BPE

def test_bpe_equals_the_library(spark):
    path = bpe.default_tokenizer()
    rng = random.Random(1)
    words = ["the", "don't", "Über", "x1", "日本", "<|endoftext|>", "  ", "\n\n", "a.b", "...", "\u00a0", "\x1c"]
    texts = [None, "", " ", "x" * 20_000, "日本語" * 3000] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))) for _ in range(30)]
    texts += texts[-2:]
    tok = bpe.Encoder(path).tok
    for r in bpe.encode_documents(docs_of(spark, texts), path, keep_text=True, memo_pieces=50).collect():
        ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == tok.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


# Media

def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_corrects_and_carves(spark):
    gz = zlib.compressobj(wbits=31)
    packed = gz.compress(b"hello" * 9) + gz.flush()
    inner = b"junk" + png() + b"BM not a bitmap" + packed
    rows = [(0, 0, "text/plain", png()), (1, 0, "image/png", b"GIF89a cut"), (2, 0, "x", media.wav_of(inner)), (3, 0, None, None), (4, 0, "image/png", png()[:-1])]
    got = {r["doc_id"]: r for r in media.sniff_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, declared string, media binary")).collect()}
    assert [got[i]["media_type"] for i in range(5)] == ["image/png", media.UNKNOWN, "audio/wav", media.UNKNOWN, media.UNKNOWN]
    assert got[0]["corrected"] and got[2]["payload_sha256"] == hashlib.sha256(inner).hexdigest()
    assert [(x["type"], x["length"]) for x in got[2]["items"]] == [("image/png", len(png())), ("application/gzip", len(packed))]


def test_samples_are_lossless(spark):
    texts = [None, "", "a" * 64, "a" * 65, "é" * 40_000, "same", "same"]
    got = {r["doc_id"]: r for r in media.sniff_media(media.encode_samples(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[5]["feature"] == got[6]["feature"]


# Near-duplicates

def shingles(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_minhash_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(60)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c d e", "A b\tc d e", "é " * 7]
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(8, 120))] + (common if rng.random() < 0.5 else [])
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(common + [word()]) for _ in range(80)]
    sets = [shingles(t) for t in texts]
    low = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            changed |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    got = {r["doc_id"]: r for r in minhash.group_documents(docs_of(spark, texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == low
    assert minhash.drop_copies(docs_of(spark, texts)).count() == len(set(low))


def test_minhash_finds_every_link_of_long_lists(spark):
    rng = random.Random(9)
    new = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    head, base, line = ([new() for _ in range(n)] for n in (7, 95, 180))
    # All alike only through the bare passage; then larger sets than a sketch; then a group that drifts.
    texts = [" ".join([*head, new()]) for _ in range(100)] + [" ".join(head)]
    texts += [" ".join(base + [new() for _ in range(30)]) for _ in range(70)] + [" ".join(base)]
    texts += [" ".join(line[k : k + 60]) for k in rng.sample(range(120), 120)]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    low = list(range(len(texts)))
    while any(low[i] != low[j] for i, j in links):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    assert len(set(low)) == 3
    got = {r["doc_id"]: r["component_id"] for r in minhash.group_documents(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == low


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1, None):
        for size in (1, 1, 1, 2, 5, 40):
            centre = rng.standard_normal(16)
            for _ in range(size):
                rows.append((n, (centre + 0.12 * rng.standard_normal(16)).tolist(), label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, None, 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [1.0, None], 0), (n + 5, [], 0), (n + 6, [2 * v for v in rows[0][1]], 0)]
    good = [(i, np.array(x), lab) for i, x, lab in rows if lab is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
    links = {i: set() for i, _, _ in rows}
    for i, x, a in good:
        for j, y, b in good:
            if i != j and a == b and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[i].add(j)
    low = {i: i for i in links}
    for _ in range(len(rows)):
        low = {i: min([low[i], *(low[j] for j in links[i])]) for i in low}
    got = {r["vec_id"]: r for r in embed.group_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {i: got[i]["n_links"] for i in links} == {i: len(x) for i, x in links.items()}
    assert {i: got[i]["component_id"] for i in links} == low


# Classifiers

def test_language_model_is_a_proper_code(spark):
    texts = ["the cat sat on the mat and the dog ran " * 5, "der hund und die katze sind im haus " * 5] * 6
    model = langid.train(docs_of(spark, texts, langs=["en", "de"] * 6))
    cost = np.exp2(-model.cost.reshape(2, -1, model.width)[:, :, 1:].astype(float) / langid.UNIT).sum(axis=2)
    unseen = np.exp2(-model.cost.reshape(2, -1, model.width)[:, :, 0].astype(float) / langid.UNIT) * (256 - (model.width - 1))
    assert np.abs(cost + unseen - 1).max() < 0.01
    odd = docs_of(spark, [None, "", "12 !!", "the dog", "die katze", "THE DOG", "x" * 100_000])
    got = {r["doc_id"]: r for r in langid.with_language(odd, model).select("doc_id", "language.*").collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["und", "und", "und", "en", "de", "en"] and got[0]["score"] == 0
    assert langid.identify(odd.limit(0)).count() == 0
    kept = langid.drop_unidentified(docs_of(spark, [*texts, None, "123"], langs=["en", "de"] * 7))
    assert kept.count() == len(texts) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_corpus(spark, n=600):
    rng = random.Random(8)
    texts, toxic = [], []
    for _ in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40)]
        bad = rng.random() < 0.25
        if bad:
            words[rng.randrange(40)] = rng.choice(["grobian", "grobling", "wicht"])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    return docs_of(spark, texts), labels, toxic


def test_toxicity_on_held_out_rows(spark):
    docs, labels, toxic = toxic_corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert len(held) > 80 and held == [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == toxic[i] for i in held]) > 0.97
    crossed = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, labels, cross_fit=True).collect()}
    assert np.mean([crossed[i] == toxic[i] for i in held]) > 0.97
    odd = docs_of(spark, [None, "", "x" * 200_000])
    assert {r["score"] for r in toxicity.score_documents(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.drop_toxic(docs.withColumn("score", F.lit(1)), labels).columns == [*docs.columns, "score"]


def test_toxicity_calibrates_on_rows_of_its_own(spark, monkeypatch):
    docs, labels, _ = toxic_corpus(spark)
    seen, learn, fit = {}, toxicity.learn_lexicon, toxicity.IsotonicRegression.fit
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda df, *a: seen.update(learnt={r["text"] for r in df.select("text").collect()}) or learn(df, *a))
    monkeypatch.setattr(toxicity.IsotonicRegression, "fit", lambda self, df, *a: seen.update(calibrated=df.count()) or fit(self, df, *a))
    toxicity.train(docs, labels)
    rows = toxicity.labelled_sample(docs, labels, 20_000).collect()
    apart = {r["text"] for r in rows if r["part"] == 0}
    assert {r["part"] for r in rows} == {0, 1, 2, 3, 4}
    assert seen["learnt"] == {r["text"] for r in rows} - apart and seen["calibrated"] == len(apart) > 50


def test_toxicity_calibrates_out_of_part(spark, monkeypatch):
    """No part is judged by a lexicon or by trees that have seen its rows, whatever the size; every row is judged."""
    for n, few in ((600, 0), (60, 2)):
        docs, labels, toxic = toxic_corpus(spark, n)
        if few:  # only two toxic rows are left, so some parts are the only ones with any
            keep = [i for i in range(n) if toxic[i] and zlib.crc32(str(i).encode()) % 5][:few]
            labels = labels.withColumn("toxic", F.col("doc_id").isin(keep).cast("int"))
        seen, best, grow, fit = {"lexicons": [], "grown": []}, toxicity.best_terms, toxicity.grow, toxicity.IsotonicRegression.fit
        monkeypatch.setattr(toxicity, "best_terms", lambda counts, *a: seen["lexicons"].append({r["part"] for r in counts.select("part").distinct().collect()}) or best(counts, *a))
        monkeypatch.setattr(toxicity, "grow", lambda rows, *a: seen["grown"].append(rows.count()) or grow(rows, *a))
        monkeypatch.setattr(toxicity.IsotonicRegression, "fit", lambda self, df, *a: seen.update(calibrated=df.count()) or fit(self, df, *a))
        toxicity.train(docs, labels, rounds=3, cross_fit=True)
        monkeypatch.undo()
        parts = [r["part"] for r in toxicity.labelled_sample(docs, labels, 20_000).collect()]
        assert set(parts) == {0, 1, 2, 3, 4} and seen["calibrated"] == len(parts)
        assert seen["lexicons"] == [*[set(parts) - {k} for k in range(5)], set(parts)]
        assert sorted(seen["grown"]) == sorted([len(parts), *[len(parts) - parts.count(k) for k in range(5)]])


def test_toxicity_lexicon_against_plain_counts(spark):
    docs, labels, _ = toxic_corpus(spark, 300)
    sample = toxicity.labelled_sample(docs, labels, 20_000)
    texts = {r["text"]: r for r in sample.collect()}
    counts = toxicity.term_counts(sample.unionByName(sample))  # copies of a text count once
    for part in range(5):
        got = {r["term"]: (r["n"], r["toxic"]) for r in counts.where(F.col("part") == part).collect()}
        own = [r for r in texts.values() if r["part"] == part]
        assert got[""] == (len(own), sum(r["toxic"] for r in own))
        having = [r for r in own if any(w.startswith("grob") and len(w) > 4 for w in r["text"].split())]
        assert got.get("grob*", (0, 0)) == (len(having), sum(r["toxic"] for r in having))
    assert {"grob*", "wicht"} <= set(toxicity.best_terms(counts))
    assert toxicity.best_terms(counts.limit(0)) == {} and toxicity.best_terms(counts.withColumn("toxic", F.lit(0))) == {}


def test_toxicity_features_by_hand():
    lexicon = {"wicht": 0.9, "grob*": 0.7}
    of = lambda text: dict(zip(toxicity.FEATURES, toxicity.text_features(text, [lexicon], [{}])[0]))
    log = np.log1p
    zero = dict.fromkeys(toxicity.FEATURES, 0.0)
    cases = {
        "": {},
        "abc": {"log_words": log(1)},
        "12 345": {"punctuation": 5 / 6 - 1 / 6, "digits": 5 / 6},  # no letter counts as one
        "Wicht": {"hits": log(1), "density": 1, "top_weight": 0.9, "capitals": 1 / 5, "log_words": log(1)},
        "grobian und wicht": {"hits": log(2), "density": 2 / 3, "top_weight": 0.9, "log_words": log(3)},
        "you wicht": {"hits": log(1), "density": 1 / 2, "top_weight": 0.9, "second_person": 1 / 2, "near_second_person": 1 / 2, "log_words": log(2)},
        "you a b c d e wicht": {"hits": log(1), "density": 1 / 7, "top_weight": 0.9, "second_person": 1 / 7, "log_words": log(7)},
        "HEY DU!": {"second_person": 1 / 2, "capitals": 1, "shouted": 1, "exclamations": 1 / 7, "punctuation": 1 / 7, "log_words": log(2)},
        "w1cht": {"hidden_density": 1 / 2, "punctuation": 1 / 5, "digits": 1 / 5, "mixed": 1 / 2, "log_words": log(2)},
        "sooo gut": {"stretched": 1 / 2, "log_words": log(2)},
        "\u00c4RGER \U0001d400": {"capitals": 1, "shouted": 1 / 2, "log_words": log(2)},
    }
    for text, wanted in cases.items():
        got = of(text)
        assert got == pytest.approx(zero | wanted), text
    two = toxicity.text_features("you wicht", [{}, lexicon], [{}, {}])
    assert two[1] == list(of("you wicht").values()) and two[0][0] == 0


def members_of(spark, p, t):
    return spark.createDataFrame([(float(a), [float(x) for x in b]) for a, b in zip(t, p)], "tokens double, p array<double>").repartition(4)


def plain_least_squares(p, w, goal, ridge, steps=200_000):
    """Projected gradient of fixed length on all rates at once, by the definition of the objective."""
    scale, r = np.maximum(w @ p, 1e-3), np.ones(len(w))
    for _ in range(steps):
        r = np.maximum(0.0, r - 0.9 * (p @ (((r * w) @ p - goal) / scale) + ridge * (r - 1)))
    return r


@pytest.mark.parametrize("ridge", [1e-2, 2e-3])
def test_mixing_finds_the_optimum(spark, ridge):
    rng = np.random.default_rng(2)
    p, t = rng.dirichlet([0.3, 0.3, 0.1], 300), rng.integers(0, 400, 300).astype(float)
    w, goal = t / t.sum(), np.array([0.75, 0.2, 0.05])
    members = members_of(spark, p, t)
    _, (at,) = mixing.moments(members, [np.zeros(3)])
    assert np.allclose(at.mass, w @ p)
    m, _ = mixing.descend(members, goal, np.maximum(w @ p, 1e-3), ridge, np.zeros(3), at)
    wanted = plain_least_squares(p, w, goal, ridge, 20_000)
    assert (wanted == 0).any() and np.abs(mixing.rates_at(p, m) - wanted).max() < 1e-5


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(2)
    p, t = rng.dirichlet([0.3, 0.3, 0.1], 500), rng.integers(1, 400, 500).astype(float)
    members, w = members_of(spark, p, t), t / t.sum()
    for goal in ([0.6, 0.3, 0.1], [0.9, 0.09, 0.01], [0.02, 0.03, 0.95]):
        m = mixing.fit_rates(members, ["a", "b", "c"], dict(zip("abc", goal)), strict=True)
        r = mixing.rates_at(p, m)
        got = members.select(mixing.rate_of(F.col("p"), m).alias("rate")).collect()
        assert np.allclose(sorted(r), sorted(x["rate"] for x in got))
        assert (r >= 0).all() and (np.abs((r * w) @ p - goal) <= mixing.TOLERANCE * np.array(goal)).all()
        # Of the rates that meet the targets they are the nearest to 1: other ones are farther.
        step = rng.normal(size=500)
        free = (p * w[:, None])[r > 0]
        step = np.where(r > 0, step, 0.0)
        step[r > 0] -= free @ np.linalg.lstsq(free.T @ free, free.T @ step[r > 0], rcond=None)[0]
        other = np.maximum(0.0, r + 1e-3 * step)
        assert np.allclose((other * w) @ p, (r * w) @ p, atol=1e-6) and (w * (other - 1) ** 2).sum() > (w * (r - 1) ** 2).sum() - 1e-7


def test_targets_out_of_reach(spark):
    members = members_of(spark, np.array([[0.5, 0.5]] * 20), np.arange(20.0))
    with pytest.raises(ValueError, match="no rates meet the targets"):
        mixing.fit_rates(members, ["a", "b"], {"a": 0.9, "b": 0.1}, strict=True)
    r = mixing.rates_at(np.array([[0.5, 0.5]]), mixing.fit_rates(members, ["a", "b"], {"a": 0.9, "b": 0.1}))
    assert 0.9 < r[0] < 1.1
    assert mixing.fit_rates(members.limit(0), ["a", "b"], {"a": 1.0}) is None and mixing.fit_rates(members, ["a"], {"a": 1.0}) is None


def test_a_domain_without_target_keeps_its_share():
    got = mixing.goals(["a", "b", "c"], {"a": 3.0, "b": 1.0}, np.array([0.5, 0.3, 0.2]))
    assert np.allclose(got, [0.6, 0.2, 0.2])
    assert np.allclose(mixing.goals(["a", "b"], {"a": 3.0, "b": 1.0, "c": 5.0}, np.array([0.5, 0.5])), [0.75, 0.25])


def test_mixing_repeats_and_drops(spark):
    docs, labels, toxic = toxic_corpus(spark, 200)
    rates = mixing.rates(docs, labels).collect()
    assert len(rates) == 200 and all(r["copies"] >= 0 for r in rates)
    mixed = mixing.mix(docs, labels)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rates)
    assert mixing.rates(docs.limit(0), labels).count() == 0
    assert {r["rate"] for r in mixing.rates(docs, labels.limit(0)).collect()} == {1.0}
    empty = docs_of(spark, [None, "", *[r["text"] for r in docs.select("text").limit(40).collect()]])
    assert mixing.rates(empty, labels).where("tokens = 0 and rate >= 0").count() == 2
