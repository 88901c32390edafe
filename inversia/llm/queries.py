"""The registered queries of this package, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inversia.llm import convtrie, decontaminate, filteraudit, language, mixing, quality, shards, simhash, spotsigs, substrings, tokens, toxicity, urlrules
from inversia.llm.workspace import read_table


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The words that a mixture at target weights takes of every document."""
    return mixing.digest_mix(read_table(spark, folder, "documents"))


def op3_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text, of its edited text, and likenesses."""
    return spotsigs.fingerprint_documents(read_table(spark, folder, "documents"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document."""
    return shards.digest_shards(read_table(spark, folder, "documents"))


def op5_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without repeated 100-byte strings."""
    return substrings.digest_cut(read_table(spark, folder, "documents"))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify_language(read_table(spark, folder, "documents"))


def op7_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token count of every document."""
    return tokens.count_tokens(read_table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    documents = read_table(spark, folder, "documents")
    model = toxicity.fit_toxicity(toxicity.training_rows(documents, read_table(spark, folder, "labels")))
    return toxicity.score_toxicity(documents, model)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify_quality(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return decontaminate.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return convtrie.prefix_trie(read_table(spark, folder, "conversations"))


def op12_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return urlrules.judge_urls(read_table(spark, folder, "pages"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes, per source, under every order of them."""
    return filteraudit.audit(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_mixing, op3_spotsigs, op4_sharding, op5_substrings,
        op6_language, op7_tokens, op8_toxicity, op9_quality, op10_decontamination,
        op11_prefix_trie, op12_url_filters, op13_filter_audit,
    )
}

LEAKS_SQL = r"""
WITH d AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), si AS (
  SELECT DISTINCT item_id, text, width, array_to_string(w[p : p + width - 1], ' ') AS s
  FROM (SELECT *, least(5, len(w)) AS width, unnest(range(1, greatest(len(w) - least(5, len(w)), 0) + 2)) AS p FROM i WHERE len(w) > 0)
), ni AS (SELECT item_id, text, count(*) AS n FROM si GROUP BY ALL),
widths AS (SELECT DISTINCT width FROM si),
sd AS (
  SELECT DISTINCT doc_id, text, width, array_to_string(w[p : p + width - 1], ' ') AS s
  FROM (SELECT doc_id, text, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM d, widths WHERE len(w) >= width)
)
SELECT sd.doc_id, si.item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM sd JOIN si ON sd.s = si.s AND sd.width = si.width
JOIN ni ON ni.item_id IS NOT DISTINCT FROM si.item_id AND ni.text = si.text
GROUP BY sd.doc_id, sd.text, si.item_id, si.text, n HAVING count(*) / n >= 0.8 - 1e-12
"""

# CRC-32 byte by byte from its table, which is made from the polynomial (a fixed value)
SHARDS_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), b AS (
  SELECT doc_id, source, text, octet_length(encode(coalesce(text, ''))) + 1 AS size, t,
    list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)) AS bytes,
    ('0x' || substr(md5('shards-1:' || coalesce(cast(doc_id AS varchar), '')), 1, 15))::bigint AS h
  FROM documents, crc
), r AS (
  SELECT *, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
    (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text) - 0.5e0) / count(*) OVER (PARTITION BY source) AS f
  FROM b
), p AS (
  SELECT *, row_number() OVER (ORDER BY f, h, source NULLS FIRST, doc_id) - 1 AS position, count(*) OVER () AS total FROM r
)
SELECT doc_id, size, text_crc32, 'rows' AS law, cast(position * 16 // total AS int) AS shard,
  position - ((position * 16 // total) * total + 15) // 16 AS slot, cast(NULL AS int) AS grown_shard
FROM p
"""

CUT_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
w AS (SELECT doc_id, p, substr(t, cast(2 * p + 1 AS bigint), 200) AS s FROM (SELECT doc_id, t, unnest(range(length(t) // 2 - 99)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span
  FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r)),
x AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM x),
c AS (SELECT k.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(t, cast(2 * before + 1 AS bigint), cast(2 * (a - before) AS bigint)), '' ORDER BY a) AS head, max(b) AS last
  FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, length(t) // 2 AS n_bytes, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(t, cast(2 * coalesce(last, 0) + 1 AS bigint)))) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""

RULES_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), n AS (SELECT row_number() OVER () AS row, * FROM u),
b AS (
  SELECT n.row, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM n JOIN r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY n.row
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM n LEFT JOIN b ON n.row = b.row
"""

AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d
), c AS (
  SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (
  SELECT x1.k || x2.k || x3.k || x4.k || x5.k AS filter_order FROM x x1, x x2, x x3, x x4, x x5
  WHERE len(list_distinct([x1.k, x2.k, x3.k, x4.k, x5.k])) = 5
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS k, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0)::int AS before
  FROM (SELECT filter_order, cast(unnest(range(1, 6)) AS int) AS step FROM o)
), p AS (
  SELECT part, filter_order, step, k, cast(sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS bigint) AS kept,
    cast(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS bigint) AS removed,
    cast(sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS bigint) AS redundant,
    cast(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS bigint) AS unique_fails,
    cast(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 AND good = 1 THEN n ELSE 0 END) AS bigint) AS good_lost,
    cast(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 AND toxic = 1 THEN n ELSE 0 END) AS bigint) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) OVER (PARTITION BY part, k) AS bigint) AS shapley FROM p
"""

TRIE_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS rank
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(cast(conv_id AS varchar))), '..'), lambda x: ('0x' || x)::bigint)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM o), crc
), r AS (
  SELECT c.conv_id, 0 AS own, rank, role, text FROM c JOIN o ON o.conv_id = c.base AND rank < h
  UNION ALL SELECT c.conv_id, 1, rank, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND rank >= h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path, length(text) AS chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), a AS (SELECT conv_id, depth, path, chars FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS total FROM a),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars, coalesce(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (WHERE depth = total), '') AS ends
  FROM e GROUP BY path, depth
), k AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k ON n.path = k.path),
s AS (
  SELECT substr(path, 1, cast(32 * up AS bigint)) AS path, cast(sum((n - 1) * chars) AS bigint) AS saved, count(*) FILTER (WHERE children = 0) AS leaves
  FROM (SELECT path, n, chars, children, unnest(range(depth + 1)) AS up FROM m) GROUP BY ALL
)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n AS n_convs, m.children AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.path = m.path LEFT JOIN n u ON m.depth > 0 AND u.depth = m.depth - 1 AND u.path = substr(m.path, 1, 32 * (m.depth - 1))
"""

ORACLES: dict[str, str] = {
    "op4_sharding": SHARDS_SQL,
    "op5_substrings": CUT_SQL,
    "op10_decontamination": LEAKS_SQL,
    "op11_prefix_trie": TRIE_SQL,
    "op12_url_filters": RULES_SQL,
    "op13_filter_audit": AUDIT_SQL,
}
