"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, divergence, embed, langid, media, minhash, mixing, sharding, tokalign, toxicity, url_filter, warc
from .common import table

#: The url rules of the production query, in the order given.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.group_vectors(table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), strict=True)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.group_documents(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest_conversations(chat.format_windows(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sniffed = media.sniff_media(media.encode_samples(table(spark, sf_dir, "documents")))
    return sniffed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cross_fit=True)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), bpe.default_tokenizer(), keep_ids=False)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokalign.crosswalk(table(spark, sf_dir, "documents"), *tokalign.default_tokenizers())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_embeddings, op2_mixing, op3_language_id, op4_warc, op5_url_filters, op6_minhash, op7_chat_formatting, op8_media_columns, op9_toxicity, op10_bpe, op11_sharding, op12_divergence, op13_alignment]
    return {f.__name__: f for f in found}


EMBED_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
n AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT p.b, r.low FROM r JOIN p ON p.a = r.node AND r.low < p.b),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""

WARC_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

URL_SQL = """
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT u.*, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

MINHASH_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS low FROM s UNION SELECT p.b, r.low FROM r JOIN p ON p.a = r.node AND r.low < p.b),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.node = doc_id
"""

CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS cost,
         regexp_replace(text, '([<\[]\\*)(/?INST|/?s>)', '\1\\\2', 'g') AS esc,
         replace(replace(regexp_replace(role, '([<\[]\\*)(/?INST|/?s>)', '\1\\\2', 'g'), '%', '%25'), ']', '%5D') AS rol
  FROM c),
s AS (
  SELECT *, length('[INST ' || rol || '] ' || esc || ' [/INST]</s>') AS shown,
         coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         first_value(role) OVER w = 'system' AS has_system,
         1024 - CASE WHEN first_value(role) OVER w = 'system' THEN first_value(cost) OVER w ELSE 0 END AS room
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
z AS (SELECT *, greatest(0, least(256, CAST(floor(room / 3) AS BIGINT))) AS reach FROM s),
y AS (SELECT *, greatest(1, CAST(floor((room - reach) / 2) AS BIGINT)) AS step FROM z),
o AS (SELECT *, CAST(start // step AS BIGINT) * 2 + CASE WHEN cost > step THEN 1 ELSE 0 END AS own FROM y),
b AS (SELECT conv_id, own AS win, min(start) AS begin, sum(shown) AS chars, greatest(0, least(min(reach), min(room) - sum(cost))) AS back FROM o GROUP BY 1, 2),
lead AS (SELECT conv_id, shown AS lead_chars FROM o WHERE start = 0 AND has_system),
h AS (
  SELECT b.conv_id, b.win, sum(o.shown) AS chars FROM b JOIN o ON o.conv_id = b.conv_id AND o.own % 2 = 0 AND o.own IN (b.win - 1, b.win - 2)
  WHERE o.start < b.begin AND o.start >= b.begin - b.back AND NOT (has_system AND start = 0) GROUP BY 1, 2),
f AS (
  SELECT b.conv_id, CAST(sum(b.chars + coalesce(h.chars, 0) + CASE WHEN b.begin > 0 THEN coalesce(lead_chars, 0) ELSE 0 END) AS BIGINT) AS formatted_chars
  FROM b LEFT JOIN h USING (conv_id, win) LEFT JOIN lead USING (conv_id) GROUP BY 1),
d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
  FROM c GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM d JOIN f USING (conv_id)
"""


#: Checksums bit by bit: a byte and seven zeros after it take one step each.
SHARDING_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
k AS (
  SELECT doc_id, size,
         CAST(('0x' || substr(md5(text), 1, 10))::BIGINT AS BIGINT) AS t, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 5))::BIGINT AS BIGINT) AS s,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: [('0x' || h)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
             lambda a, e: xor(xor(a, e) >> 1, CAST(3988292384 AS BIGINT) * (xor(a, e) & 1)))) AS text_crc32
  FROM d),
o AS (
  SELECT *, row_number() OVER w AS n, sum(size) OVER (ORDER BY t, s, doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY t) AS g, sum(size) OVER () AS total
  FROM k WINDOW w AS (ORDER BY t, s, doc_id NULLS FIRST, text_crc32)),
m AS (SELECT *, min(upto - size) OVER (PARTITION BY t) AS g0 FROM o),
p AS (SELECT *, CAST(least(7, (CASE WHEN g * 8 * 128 <= total THEN 2 * g0 + g ELSE 2 * upto - size END) * 8 // (2 * total)) AS INTEGER) AS shard FROM m)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""

DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 10),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY 1),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * v.v) AS HUGEINT) AS p
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, CAST(1 + 1000000000 * (sum(n) + 2) // (any_value(t.total) + 2 * any_value(v.v)) AS HUGEINT) AS q
      FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY 1) t USING (lang) GROUP BY 1, 2),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
allpairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM allpairs
      UNION ALL SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embeddings": EMBED_SQL, "op4_warc": WARC_SQL, "op5_url_filters": URL_SQL, "op6_minhash": MINHASH_SQL, "op7_chat_formatting": CHAT_SQL, "op11_sharding": SHARDING_SQL, "op12_divergence": DIVERGENCE_SQL}
