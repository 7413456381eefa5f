"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, importance, licenses, line_dedup, near_dedup, packing, secrets, suffix_dedup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


#: DuckDB: the text of a document with A-Z lowered, as its list of words.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE["op1_minhash_near_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')]
       ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.y AS component_id, d.doc_id = m.y AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.x = d.doc_id
"""


#: The vocabulary files of the production run; a deployment names its own.
def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, json_path=_vocabulary("byte_bpe_50k.json"), ranks_path=_vocabulary("byte_bpe_50k.tiktoken"), capacity=2048)


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


ORACLE["op5_suffix_dedup"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - 49)) AS i FROM d WHERE n >= 50),
x AS (SELECT w.doc_id, i, array_slice(b, i + 1, i + 50) AS s FROM w JOIN d ON d.doc_id = w.doc_id),
m AS (SELECT s, min(doc_id) AS m FROM x GROUP BY s),
r AS (SELECT x.doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY x.doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM x JOIN m ON m.s = x.s WHERE m.m < x.doc_id),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM r),
g AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM k GROUP BY doc_id, k),
p AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM g
      UNION ALL SELECT d.doc_id, coalesce(max(e), 0), any_value(n) FROM d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id),
h AS (SELECT p.doc_id, string_agg(CASE WHEN t > f THEN hex(array_slice(b, f + 1, t)) ELSE '' END, '' ORDER BY t, f) AS h FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
c AS (SELECT doc_id, sum(e - a)::BIGINT AS removed, count(*) AS spans FROM g GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN h ON h.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def secret_sql(kinds) -> str:
    """The scan of ``kinds`` in DuckDB, whose patterns know no possessive repeats."""
    parts = []
    for i, (kind, pattern, group, least) in enumerate(kinds):
        p = pattern.replace("}+", "}").replace("*+", "*").replace("'", "''")
        parts.append(f"SELECT doc_id, repo, source, {i} AS ord, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS s FROM t WHERE regexp_matches(t, '{p}')")
    return f"""
WITH t AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '?') AS repo, coalesce(source, '?') AS source, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(parts)}),
e AS (SELECT doc_id, repo, source, ord, kind, least, m, v, s, unnest(range(1, len(m) + 1)) AS i FROM k),
f AS (SELECT doc_id, repo, source, ord, kind, v[i] AS value, length(m[i]) AS n, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM e WHERE length(v[i]) >= least),
o AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT repo) AS repos FROM f GROUP BY value),
g AS (SELECT doc_id, ord, owners <= 1 AND repos <= 10 AS live, owners || ':' || repos AS held, a, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS span FROM f JOIN o ON o.value = f.value)
SELECT t.doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY a, ord) FILTER (WHERE ord < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY a, ord) FILTER (WHERE ord < 3 OR live), '') AS spans,
       coalesce(string_agg(held, ',' ORDER BY a, ord) FILTER (WHERE ord < 3 OR live), '') AS held_by,
       coalesce(string_agg(span, ',' ORDER BY a, ord) FILTER (WHERE live), '') AS live_spans,
       count(*) FILTER (WHERE ord < 3 AND NOT live) AS n_copied
FROM t LEFT JOIN g ON g.doc_id = t.doc_id GROUP BY t.doc_id
"""


ORACLE["op7_secret_scan"] = secret_sql([*secrets.BASE, *secrets.GENERIC])


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.summary(warc.archive(table(spark, sf_dir, "pages"), least=1000)[1])


ORACLE["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN page_id <> coalesce(keeper, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> coalesce(keeper, page_id) THEN keeper END AS refers_to
FROM p LEFT JOIN k ON k.h = p.h
"""


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op10_line_dedup"] = r"""
WITH d AS (SELECT *, row_number() OVER () AS row FROM documents),
l AS (SELECT row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM (SELECT DISTINCT row, key FROM k WHERE key <> '') GROUP BY key HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON c.key = k.key GROUP BY row, doc_id
"""


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB: the words of a text for decontamination, and its distinct five-word shingles (of fewer words, the sequence).
SQL_RUNS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE["op2_decontamination"] = rf"""
WITH i AS (SELECT item_id, {SQL_RUNS} AS ws FROM benchmark), d AS (SELECT doc_id, {SQL_RUNS} AS ws FROM documents),
l AS (SELECT DISTINCT least(len(ws), 5) AS k FROM i WHERE len(ws) > 0),
s AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' '))) AS g FROM i JOIN l ON k = least(len(ws), 5)),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
g AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' '))) AS g FROM d, l WHERE len(ws) >= k),
c AS (SELECT doc_id, item_id, count(*) AS m FROM g JOIN s USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, m AS n_shared, m / n AS containment FROM c JOIN n USING (item_id) WHERE 100 * m >= 80 * n
"""


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"), width=50)


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "log_weight", "sample_key")
