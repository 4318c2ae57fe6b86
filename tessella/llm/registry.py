"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import quality
from tessella.llm.centroids import cluster
from tessella.llm.decontaminate import contaminated, decontaminate
from tessella.llm.exact_dedup import exact_dedup
from tessella.llm.html_text import extract
from tessella.llm.language import identify, learn
from tessella.llm.licences import scan_licences
from tessella.llm.line_dedup import line_dedup
from tessella.llm.passages import repeated_passages
from tessella.llm.pieces import encode_digests
from tessella.llm.shared import held_out, table
from tessella.llm.simhash import hex_of, near_dedup
from tessella.llm.url_filter import url_filter
from tessella.llm.whitening import whiten


def model_bytes(path: str | None = None) -> bytes:
    """A tokenizer model's file; by default the public 32k merge model. It is read on the driver and broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "line_no", "kept", F.col("keep_id").alias("keep_doc_id"), "keep_line_no", "distance")


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, x[i] AS line, doc_id::HUGEINT * 10000000000 + (i - 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(i)
), d AS (SELECT line, length(line) AS n, min(pos) AS pos FROM l WHERE line <> '' GROUP BY line),
h AS (
  SELECT 0 AS side, line, n, pos, p, substr(line, 1, p // 2) AS half FROM d, unnest([n, n - 1]) AS t(p) WHERE p > 0
  UNION ALL
  SELECT 1, line, n, pos, p, substr(line, n - (p - p // 2) + 1, p - p // 2) FROM d, unnest([n, n - 1]) AS t(p) WHERE p > 0
), near AS (
  SELECT a.line, min(b.pos) AS near FROM h a JOIN h b ON a.side = b.side AND a.p = b.p AND a.half = b.half AND b.pos < a.pos
  WHERE len(list_filter(range(0, a.n + 1), lambda i: substr(a.line, 1, i) = substr(b.line, 1, i)
            AND substr(a.line, i + 1 + (a.n >= b.n)::INT) = substr(b.line, i + 1 + (b.n >= a.n)::INT))) > 0
  GROUP BY a.line
), k AS (
  SELECT l.doc_id, l.line_no, l.pos, CASE WHEN l.line = '' THEN l.pos ELSE coalesce(near, d.pos) END AS keep, CASE WHEN near IS NULL THEN 0 ELSE 1 END AS distance
  FROM l LEFT JOIN d USING (line) LEFT JOIN near USING (line)
)
SELECT doc_id, line_no::INT AS line_no, keep = pos AS kept, (keep // 10000000000)::BIGINT AS keep_doc_id, (keep % 10000000000)::INT AS keep_line_no, distance FROM k
"""


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS k
  FROM d, (SELECT DISTINCT m FROM bw), unnest(range(1, greatest(1, len(w) - m + 2))) AS u(i)
), h AS (
  SELECT DISTINCT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.m = bw.m
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, m FROM h), unnest(range(i, i + m)) AS u(p) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    out = encode_digests(table(spark, sf_dir, "documents"), model_bytes(model_path))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "start_word", "end_word", F.col("partner_id").alias("partner_doc_id"), "similarity", "class_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


OP9_SQL = r"""
WITH r(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), u AS (
  SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS full_url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hp AS (
  SELECT row, page_id, full_url, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), j AS (
  SELECT hp.*, b.rule, b.v, substr(md5(full_url), 1, 1) IN ('0', '1', '2') AS held FROM hp LEFT JOIN (
    SELECT row, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.verdict, length(r.h || r.p)) AS v
    FROM hp JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY row) b USING (row)
), s AS (
  SELECT row, v, i, CASE WHEN c BETWEEN 'a' AND 'z' AND length(c) = 1 THEN ascii(c) - 96 WHEN c BETWEEN '0' AND '9' THEN 27
                         WHEN c = '.' THEN 28 WHEN c = '/' THEN 29 WHEN c = '-' THEN 30 ELSE 31 END AS x
  FROM (SELECT row, CASE WHEN NOT held THEN v END AS v, i, substr(low, i, 1) AS c FROM j, unnest(range(1, length(low) + 1)) AS t(i))
), k AS (
  SELECT row, v, coalesce(lag(x, 3) OVER w, 0) * 32768 + coalesce(lag(x, 2) OVER w, 0) * 1024 + coalesce(lag(x, 1) OVER w, 0) * 32 + x AS code
  FROM s WINDOW w AS (PARTITION BY row ORDER BY i)
), t3 AS (
  SELECT code, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS b FROM k GROUP BY code
), t0 AS (SELECT code % 32 AS code, sum(a) AS a, sum(b) AS b FROM t3 GROUP BY 1),
p0 AS (
  SELECT code, (a + da / 32.0::DOUBLE) / (na + da) AS pa, (b + db / 32.0::DOUBLE) / (nb + db) AS pb
  FROM (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb, 1 + count(*) FILTER (a > 0) OVER w AS da, 1 + count(*) FILTER (b > 0) OVER w AS db FROM t0 WINDOW w AS (PARTITION BY code // 32))
), t1 AS (SELECT code % 1024 AS code, sum(a) AS a, sum(b) AS b FROM t3 GROUP BY 1),
p1 AS (
  SELECT x.code, (a + da * q.pa) / (na + da) AS pa, (b + db * q.pb) / (nb + db) AS pb
  FROM (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb, 1 + count(*) FILTER (a > 0) OVER w AS da, 1 + count(*) FILTER (b > 0) OVER w AS db FROM t1 WINDOW w AS (PARTITION BY code // 32)) x
  JOIN p0 q ON q.code = x.code % 32
), t2 AS (SELECT code % 32768 AS code, sum(a) AS a, sum(b) AS b FROM t3 GROUP BY 1),
p2 AS (
  SELECT x.code, (a + da * q.pa) / (na + da) AS pa, (b + db * q.pb) / (nb + db) AS pb
  FROM (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb, 1 + count(*) FILTER (a > 0) OVER w AS da, 1 + count(*) FILTER (b > 0) OVER w AS db FROM t2 WINDOW w AS (PARTITION BY code // 32)) x
  JOIN p1 q ON q.code = x.code % 1024
), p3 AS (
  SELECT x.code, (a + da * q.pa) / (na + da) AS pa, (b + db * q.pb) / (nb + db) AS pb
  FROM (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb, 1 + count(*) FILTER (a > 0) OVER w AS da, 1 + count(*) FILTER (b > 0) OVER w AS db FROM t3 WINDOW w AS (PARTITION BY code // 32)) x
  JOIN p2 q ON q.code = x.code % 32768
), m AS (SELECT row, avg(ln(pa) - ln(pb)) AS score FROM k JOIN p3 USING (code) GROUP BY row),
z AS (SELECT j.*, coalesce(score, 0) AS score FROM j LEFT JOIN m USING (row)),
c AS (SELECT (coalesce(avg(score) FILTER (v = 'allow' AND held), avg(score) FILTER (v = 'allow')) + coalesce(avg(score) FILTER (v = 'block' AND held), avg(score) FILTER (v = 'block'))) / 2 AS least FROM z)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN score >= least THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score FROM z, c
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), hex_of().alias("fingerprint"), "component_id", "n_links")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n", "deviation", "identity_error", F.inline("components")).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licences(table(spark, sf_dir, "documents"))
    base, more = F.col("base.label"), F.col("spans.label")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").alias("first_word"),
        F.array_max("base.first").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        "score",
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join("centroid", ",").cast("binary"), 256)
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _op13_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The rounds as plain SQL: every distance in each of them. A squared distance d to centroid c is told as d * 64 + c."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, x, list_inner_product(x, x) AS xx FROM (
    SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims}))""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, c) - 1 AS k, c, list_inner_product(c, c) AS cc
  FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, x AS c FROM v ORDER BY h, c LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min((xx - 2 * list_inner_product(x, c) + cc)::BIGINT * 64 + k) AS best FROM v, c{i} GROUP BY r)")
        if i < rounds:
            steps.append(
                f"""m{i} AS MATERIALIZED (
  SELECT k, list(m ORDER BY p) AS c FROM (
    SELECT best % 64 AS k, p, floor(sum(x[p]) / count(*)) AS m FROM a{i} JOIN v USING (r), unnest(range(1, {dims + 1})) AS t(p) GROUP BY 1, 2) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, c, list_inner_product(c, c) AS cc FROM (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k)))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, (best % 64)::INT AS cluster, best // 64 AS distance,
       (sum(best // 64) OVER (PARTITION BY best % 64))::BIGINT AS cluster_inertia, (sum(best // 64) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c, lambda y: y::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c{rounds}.k = best % 64"""
    )


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_text": op3_html_text,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_passages": op7_passages,
    "op8_language": op8_language,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_licences": op12_licences,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op5_decontaminate": OP5_SQL,
    "op9_url_filter": OP9_SQL,
    "op13_centroids": OP13_SQL,
}
