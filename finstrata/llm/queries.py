"""Each corpus operator as a query with production parameters over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.llm import decontam, fingerprints, hnsw, html_extract, langid, lexical, line_dedup, mixing, pii, prefix_trie, simhash, url_filter, warc

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"),
             url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/")]


@query("op1_url_filters", r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM pages),
r(a, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (SELECT n, max({'l': length(h || p), 'b': a = 'block', 'r': h || p, 'a': a}) AS m FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, m.r AS "rule", coalesce(m.a, 'allow') AS verdict FROM u LEFT JOIN best USING (n)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.label(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query("op4_warc", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS d, row_number() OVER (PARTITION BY sha1(coalesce(html, '')) ORDER BY page_id NULLS LAST, url NULLS LAST) AS k,
                  first_value(page_id) OVER (PARTITION BY sha1(coalesce(html, '')) ORDER BY page_id NULLS LAST, url NULLS LAST) AS f FROM pages)
SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(d, (i // 4) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to
FROM p""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(spark, pages, min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_source_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op7_line_dedup", r"""
WITH l AS (SELECT doc_id, source, i, string_split(coalesce(text, ''), chr(10))[i] AS raw, trim(string_split(coalesce(text, ''), chr(10))[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
           FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)),
bad AS (SELECT line, min(doc_id) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, '') || (source IS NULL)) >= 10),
m AS (SELECT l.*, bad.line IS NULL OR (doc_id IS NOT DISTINCT FROM first AND i = min(i) OVER (PARTITION BY doc_id, l.line)) AS stays FROM l LEFT JOIN bad ON l.line = bad.line),
d AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT stays) AS gone, string_agg(raw, chr(10) ORDER BY i) FILTER (stays) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE n END AS n_lines, gone AS n_removed, CAST(length(CASE WHEN gone > 0 THEN coalesce(kept, '') ELSE text END) AS BIGINT) AS n_chars,
       md5(CASE WHEN gone > 0 THEN coalesce(kept, '') ELSE text END) AS text_md5
FROM documents JOIN d USING (doc_id)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_embedding_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.span_text("base"), 256).alias("base_sha256"), pii.span_text("spans").alias("spans"))


#: A document's terms in SQL: ASCII letters and digits and all beyond ASCII.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_document_fingerprints", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS r FROM documents),
x AS (SELECT a.r, a.doc_id, a.t, length(a.t) AS n, b.r AS nr, substr(a.t, 1, length(a.t) - length(a.t) // 3) || substr(b.t, 1, length(a.t) // 3) AS e
      FROM d a JOIN d b ON b.r = a.r % (SELECT count(*) FROM d) + 1),
all_texts AS (SELECT r, 0 AS k, t FROM x UNION ALL SELECT r, 1, e FROM x),
w AS (SELECT r, k, unnest(regexp_extract_all({_FOLDED.format("t")}, '{_TERM}')) AS term FROM all_texts),
c AS (SELECT r, k, ('0x' || substr(md5(term), 1, 16))::UBIGINT AS h, count(*) AS tf FROM w GROUP BY r, k, term),
s AS (SELECT (h & 262143)::BIGINT AS slot, greatest(1, floor(1000 * ln((2.0 * (SELECT count(*) FROM d) + 2) / (2.0 * count(DISTINCT r) + 1))))::BIGINT AS weight
      FROM c WHERE k = 0 GROUP BY 1),
every AS (SELECT slot, weight FROM s UNION ALL
          SELECT DISTINCT (h & 262143)::BIGINT, floor(1000 * ln(2.0 * (SELECT count(*) FROM d) + 2))::BIGINT FROM c WHERE (h & 262143)::BIGINT NOT IN (SELECT slot FROM s)),
v AS (SELECT r, k, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN tf * weight ELSE -tf * weight END) > 0 AS one
      FROM c JOIN every ON slot = (h & 262143)::BIGINT, range(64) AS bits(b) GROUP BY r, k, b),
f AS (SELECT r, k, sum(CASE WHEN one THEN 1::UBIGINT << b ELSE 0 END)::UBIGINT AS fp FROM v GROUP BY r, k),
g AS (SELECT a.r, a.k, coalesce(f.fp, 0)::UBIGINT AS fp FROM all_texts a LEFT JOIN f ON f.r = a.r AND f.k = a.k),
near AS (SELECT a.r, count(*) - 1 AS n_near FROM g a JOIN g b ON a.k = 0 AND b.k = 0 AND bit_count(xor(a.fp, b.fp)::UBIGINT::BIT) <= 3 GROUP BY a.r)
SELECT x.doc_id, x.n AS n_chars, sha256(x.e) AS edited_sha256, printf('%016x', g.fp) AS fingerprint, printf('%016x', h.fp) AS edited_fingerprint,
       1 - bit_count(xor(g.fp, h.fp)::BIT) / 64.0::DOUBLE AS near_edited, 1 - bit_count(xor(g.fp, i.fp)::BIT) / 64.0::DOUBLE AS near_next, n_near
FROM x JOIN g ON g.r = x.r AND g.k = 0 JOIN g h ON h.r = x.r AND h.k = 1 JOIN g i ON i.r = x.nr AND i.k = 0 JOIN near ON near.r = x.r""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_ranked_search", rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED.format("text")}, '{_TERM}')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
a AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM d),
t AS (SELECT term, floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * count(*) + 1)))::BIGINT AS weight FROM c, a GROUP BY term, n_docs),
q AS (SELECT item_id, unnest(regexp_extract_all({_FOLDED.format("text")}, '{_TERM}')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN c USING (term) JOIN d USING (doc_id), a GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS "rank", doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op13_prefix_trie", r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, (xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
        lambda acc, y: list_reduce(list_concat([xor(acc, y)], range(8)), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 6)::BIGINT AS h FROM t),
r AS (SELECT c.conv_id, i AS d, r, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND i <= h
      UNION ALL SELECT c.conv_id, h + row_number() OVER (PARTITION BY c.conv_id ORDER BY i), r, x FROM c JOIN t USING (conv_id) WHERE i > h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY d) AS d, length(x) AS n, md5(length(r) || ':' || r || x) AS m FROM r),
p AS (SELECT conv_id, d, n, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d) AS prefix FROM o
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
z AS (SELECT conv_id, max_by(prefix, d) AS whole FROM p GROUP BY conv_id),
v AS (SELECT prefix, any_value(d) AS depth, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY prefix),
e AS (SELECT whole, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS s FROM z GROUP BY whole),
k AS (SELECT left(prefix, length(prefix) - 32) AS up, count(*) AS n_children FROM v WHERE prefix <> '' GROUP BY 1),
u AS (SELECT a.prefix, sum((b.n_convs - 1) * b.n)::BIGINT AS saved_tokens, count(*) FILTER (k.up IS NULL) AS n_leaves
      FROM v a JOIN v b ON starts_with(b.prefix, a.prefix) LEFT JOIN k ON k.up = b.prefix GROUP BY a.prefix)
SELECT v.conv_id, v.depth::BIGINT AS depth, w.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0) AS n_children, u.n_leaves, u.saved_tokens, coalesce(e.s, sha256('')) AS ends_sha256
FROM v JOIN u USING (prefix) LEFT JOIN k ON k.up = v.prefix LEFT JOIN e ON e.whole = v.prefix LEFT JOIN v w ON v.prefix <> '' AND w.prefix = left(v.prefix, length(v.prefix) - 32)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))
