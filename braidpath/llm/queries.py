"""The registered queries of the training-data operators, with production parameters, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidpath.llm import bpe, chat, divergence, exact_dedup, html_extract, importance, mixing, quality_rules, rule_ensemble, secret_scan, simhash, toxicity, url_filter
from braidpath.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), bpe.rank_file(), with_ids=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.reply_order(table(spark, sf_dir, "conversations"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.classify(docs, rule_ensemble.fit(docs, table(spark, sf_dir, "labels")))


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("first_position", 6).alias("first_position"))


#: The longest rule that fits a url decides.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Sites that are blocked where no rule fits.
BLOCKED_SITES = [f"{name}.example.{tld}/" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org")]


def op8_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_SITES)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # in two slices, so that the second meets an index that has the first
    found = exact_dedup.dedup_batch(table(spark, sf_dir, "documents"), slices=2)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash": op5_simhash,
    "op6_rule_ensemble": op6_rule_ensemble,
    "op7_curriculum_mix": op7_curriculum_mix,
    "op8_bloom_cascade": op8_bloom_cascade,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_guess_cost": op10_guess_cost,
    "op11_importance": op11_importance,
    "op12_html_extract": op12_html_extract,
    "op13_divergence": op13_divergence,
}

SQL = {
    "op7_curriculum_mix": r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, 2e0 * source_size AS cap, CASE place WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight,
         CASE place WHEN 0 THEN 15e-1 WHEN 1 THEN 5e-1 ELSE 1e0 END AS a,
         CASE place WHEN 0 THEN 5e-1 WHEN 1 THEN 15e-1 ELSE 1e0 END AS b
  FROM s),
-- the level that spends the budget: that of the first source, in order of cap by weight, which is not capped at it
l AS (
  SELECT arg_min(x.level, x.ratio) AS level FROM (
    SELECT y.source, y.cap / y.weight AS ratio,
           ((SELECT 15e-1 * sum(source_size) FROM w) - coalesce((SELECT sum(z.cap) FROM w z WHERE z.cap / z.weight < y.cap / y.weight), 0))
           / (SELECT sum(z.weight) FROM w z WHERE z.cap / z.weight >= y.cap / y.weight) AS level
    FROM w y) x WHERE x.level <= x.ratio),
t AS (SELECT w.*, coalesce(least(cap, level * weight), cap) AS target FROM w CROSS JOIN l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.a, t.b,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c0
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (
  SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - c0)) AS t1,
         greatest(0, least(size, CAST(round(target) AS BIGINT) - c0 - source_size)) AS t2,
         CASE WHEN c0 = 0 OR target = 0 THEN 0.0 WHEN a = b THEN c0 / target
           ELSE least(1.0, (sqrt(greatest(0.0, a * a + (b - a) * (a + b) * c0 / target)) - a) / (b - a)) END AS time
  FROM c),
-- the demand of all sources together: slope * time + bend * time^2 of everything
q AS (SELECT sum(target * 2 * a / (a + b)) AS slope, sum(target * (b - a) / (a + b)) AS bend, sum(target) AS everything FROM t)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(t1 + t2 AS BIGINT) AS taken,
       CASE WHEN t1 > 0 THEN round(time * (slope + time * bend) / everything, 6) END AS first_position
FROM g CROSS JOIN q""",
    "op8_bloom_cascade": r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule_host, rule_path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
b AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
s AS (
  SELECT page_id, regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$')
         AND starts_with(path, '/') AS listed
  FROM u)
SELECT u.page_id, host, path, rule, coalesce(action, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN b USING (page_id) LEFT JOIN s USING (page_id)""",
    "op9_exact_dedup": """
WITH h AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM h""",
    "op11_importance": r"""
WITH tab AS (
  SELECT list(list_reduce([i::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab
  FROM range(256) r(i)),
texts AS (
  SELECT row_number() OVER () AS k, 's' AS side, doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), 't', NULL, text FROM benchmark),
found AS (
  SELECT k, side, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM texts),
counted AS (SELECT k, side, word, count(*) AS n FROM (SELECT k, side, unnest(words) AS word FROM found) GROUP BY ALL),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)),
octets AS (
  SELECT word, list_transform(range(0, length(h) // 2), lambda j: (instr('0123456789ABCDEF', h[2 * j + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * j + 2]) - 1) AS o
  FROM hexed),
hashed AS (
  SELECT word, xor(list_reduce([4294967295::BIGINT] || o, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM octets, tab),
b AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t
  FROM counted JOIN hashed USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM b) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM b) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM b),
w AS (SELECT k, sum(n * g) AS weight FROM counted JOIN hashed USING (word) JOIN gain USING (bucket) WHERE side = 's' GROUP BY k),
d AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM found LEFT JOIN w USING (k) WHERE side = 's'),
scored AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 5e-1) / 4294967296e0))) AS BIGINT) AS score FROM d),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place,
         count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM ranked""",
    "op13_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
found AS (SELECT lang, source, k, term, count(*) AS n FROM (SELECT lang, source, k, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM found GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT f.lang, f.source, f.term, sum(f.n) AS n FROM found f JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
-- every group with every kept term of its language
p AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5)::HUGEINT // (g.total + 5 * v.v)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (t.n + 5)::HUGEINT // (v.total + 5 * v.v)::HUGEINT AS q
  FROM totals g JOIN v USING (lang) JOIN kept t USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (
  SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank
  FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, CAST(rank AS INTEGER) FROM terms WHERE rank <= 50""",
}
