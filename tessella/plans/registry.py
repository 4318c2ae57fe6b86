"""Registered queries of the core library and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import text as T
from tessella.functions.canonical import canonical_json_of, canonical_text, fingerprint, query_key, user_query
from tessella.functions.scoring import score_case
from tessella.functions.toolcalls import parse_tool_calls
from tessella.operators import contamination, dedup, masks, metrics, rewards, sampling, samples
from tessella.plans import calls, cases, ingest, scoring, streams, texts
from tessella.plans.base import ORACLE_SQL, QUERIES, query
from tessella.plans.base import conversations as _conversations
from tessella.plans.base import table as _t
from tessella.session import written
from tessella.sources import files

__all__ = ["ORACLE_SQL", "QUERIES", "calls", "cases", "flagship", "ingest", "scoring", "streams", "texts"]

#: Documents as training rows of four kinds, by what they are made of.
_KIND = "CASE WHEN doc_id % 10 = 0 THEN 'parallel_same' WHEN doc_id % 10 = 1 THEN 'parallel_diff' WHEN doc_id % 10 = 2 THEN 'trap_like' WHEN doc_id % 10 = 3 THEN 'pure_chat' ELSE 'ordinary' END"

# -- sources, filters, conversations


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase' AND value > 50")
def project_filter(spark, sf_dir):
    return _t(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 50").select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 500")
def limit_by_order(spark, sf_dir):
    return files.capped(_t(spark, sf_dir, "events").select("event_id", "user_id"), 500, "event_id")


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_conversations, max(length(text)) AS longest FROM conversations GROUP BY role")
def message_role_counts(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("n_conversations"), F.max(F.length("text")).alias("longest"))


@query("SELECT n_turns, count(*) AS n FROM (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id) GROUP BY n_turns")
def turns_histogram(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")).groupBy("n_turns").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN count(*) < 2 THEN 'too_few_messages'
    WHEN bool_or(role IS NULL OR role NOT IN ('system', 'user', 'assistant', 'tool')) THEN 'bad_role'
    WHEN NOT bool_or(role = 'user') OR NOT bool_or(role = 'assistant') THEN 'missing_user_or_assistant'
    WHEN bool_or(role = 'assistant' AND coalesce(text, '') = '') THEN 'empty_assistant' ELSE 'ok' END AS reason
    FROM conversations GROUP BY conv_id) GROUP BY reason"""
)
def conversation_validity(spark, sf_dir):
    return _conversations(spark, sf_dir).select(samples.validity().alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS query FROM conversations GROUP BY conv_id")
def user_query_text(spark, sf_dir):
    return _conversations(spark, sf_dir).select(F.col("sample_id").alias("conv_id"), user_query(F.col("messages")).alias("query"))


@query(
    r"""SELECT count(*) AS n_conversations, count(DISTINCT k) AS n_keys FROM (SELECT conv_id,
    string_agg(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), chr(1) ORDER BY turn) FILTER (role = 'user') AS k FROM conversations GROUP BY conv_id)"""
)
def query_key_counts(spark, sf_dir):
    keys = _conversations(spark, sf_dir).select(query_key(F.col("messages")).alias("k"))
    return keys.agg(F.count(F.lit(1)).alias("n_conversations"), F.count_distinct(F.when(F.col("k") != "[]", F.col("k"))).alias("n_keys"))


@query(
    """SELECT conv_id, coalesce(min(turn) FILTER (role = 'assistant'), -1) AS first_turn, coalesce(max(turn) FILTER (role = 'assistant'), -1) AS last_turn,
    count(*) FILTER (turn < (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id AND role = 'assistant')) AS n_before FROM conversations c GROUP BY conv_id"""
)
def first_and_last_assistant_turn(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations")
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(W.partitionBy("conv_id"))
    turns = turns.withColumn("last", last)
    mine = F.when(F.col("role") == "assistant", F.col("turn"))
    return turns.groupBy("conv_id").agg(F.coalesce(F.min(mine), F.lit(-1)).alias("first_turn"), F.coalesce(F.max(mine), F.lit(-1)).alias("last_turn"), F.count_if(F.col("turn") < F.col("last")).alias("n_before"))


@query(
    """SELECT conv_id::VARCHAR AS id, 'no_tool' AS category, (SELECT count(*) FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn < max(c.turn)) AS n_messages
    FROM conversations c WHERE role = 'assistant' GROUP BY conv_id"""
)
def conversations_to_cases(spark, sf_dir):
    cases = samples.to_case(_conversations(spark, sf_dir))
    return cases.select("id", "category", F.size("messages").cast("long").alias("n_messages"))


@query(
    """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN json_extract_string(props, '$.k') END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM events"""
)
def latest_call_fill(spark, sf_dir):
    key = F.when(F.col("event_type") == "purchase", F.get_json_object("props", "$.k"))
    return samples.latest_before(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], key, "latest").select("user_id", "event_id", "latest")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(DISTINCT json_keys(props)) AS n_key_sets FROM events GROUP BY event_type")
def props_json_extract(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"), F.count_distinct(F.to_json(F.json_object_keys("props").cast("array<string>"))).alias("n_key_sets"))


#: JSON of several depths, with keys out of order, white space and a decomposed letter inside.
_NESTED = """concat('{"z": [1, {"b":  "x ', event_type, '  y", "a": null}], "e": "e\u0301  é", "c": ', props, ', "a": true, "d": ', event_id, '.0}')"""


@query(
    """SELECT event_id, md5('{"a":true,"c":{"k":' || json_extract_string(props, '$.k') || '},"d":' || event_id || '.0,"e":"é é","z":[1,{"a":null,"b":"x ' || event_type || ' y"}]}') AS fp FROM events"""
)
def canonical_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.md5(canonical_json_of(F.expr(_NESTED))).alias("fp"))


# -- text, dedup


@query(r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS digest, length(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS n FROM documents")
def text_normalize(spark, sf_dir):
    t = T.normalize(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS digest FROM documents")
def text_canonical(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(canonical_text("text")).alias("digest"))


@query(
    r"""SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE greatest(len(t) - 3, 1) END AS n_grams,
    CASE WHEN t = '' THEN 0 ELSE (SELECT count(DISTINCT substr(t, i, 4)) FROM unnest(range(1, greatest(len(t) - 3, 1) + 1)) AS u(i)) END AS n_distinct
    FROM (SELECT doc_id, regexp_replace(lower(CASE WHEN doc_id % 100 = 7 THEN substr(text, 1, (doc_id // 100 % 7)::INT) ELSE text END), '\s+', '', 'g') AS t FROM documents)"""
)
def char_gram_counts(spark, sf_dir):
    """Whole texts; one document in a hundred is cut to 0 to 6 characters, so that short texts occur."""
    text = F.expr("if(doc_id % 100 = 7, substr(text, 1, int(doc_id div 100 % 7)), text)")
    return _t(spark, sf_dir, "documents").select("doc_id", contamination.char_gram_counts(text).alias("g")).select("doc_id", "g.n_grams", "g.n_distinct")


@query(
    r"""SELECT doc_id, fp, row_number() OVER (PARTITION BY fp ORDER BY doc_id) = 1 AS is_first
    FROM (SELECT doc_id, md5('[' || to_json(trim(regexp_replace(text, '\s+', ' ', 'g'))) || ']||[]') AS fp FROM documents)"""
)
def fingerprint_keep_first(spark, sf_dir):
    """The key is made once and kept with the order; dedup then reads those narrow rows twice."""
    key = fingerprint(F.to_json(F.array("text")), F.lit(None).cast("string"))
    keys = written(_t(spark, sf_dir, "documents").select("doc_id", key.alias("key")), "fingerprints")
    return dedup.keep_first(keys, F.col("key"), "doc_id").select("doc_id", "fp", "is_first")


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_kept, count(*) - count(DISTINCT text) AS n_dup FROM documents")
def duplicate_counts(spark, sf_dir):
    return dedup.duplicate_counts(dedup.keep_first(_t(spark, sf_dir, "documents").select("doc_id", "text"), F.md5("text"), "doc_id"))


@query("SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS percent FROM documents GROUP BY source")
def source_counts(spark, sf_dir):
    n = _t(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n")).first()[0]
    return n.select("source", "n", F.round(100.0 * F.col("n") / F.lit(total), 3).alias("percent"))


@query("SELECT md5(text) AS key, count(DISTINCT source) AS n_values FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def same_key_different(spark, sf_dir):
    return dedup.same_key_different(_t(spark, sf_dir, "documents"), F.md5("text"), F.col("source"))


# -- contamination


def _sides(spark, sf_dir):
    train = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("train_id"), F.col("text").alias("train_text"))
    bench = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("bench_id"), F.col("text").alias("bench_text"))
    return train, bench


_NEAR = r"""
WITH a AS (SELECT doc_id AS id, regexp_replace(lower(text), '\s+', '', 'g') AS t FROM documents),
b AS (SELECT item_id AS id, regexp_replace(lower(text), '\s+', '', 'g') AS t FROM benchmark),
ga AS (SELECT id, g, count(*) AS c FROM (SELECT id, substr(t, i, 4) AS g FROM a, unnest(range(1, greatest(length(t) - 3, 1) + 1)) AS u(i) WHERE t <> '') GROUP BY id, g),
gb AS (SELECT id, g, count(*) AS c FROM (SELECT id, substr(t, i, 4) AS g FROM b, unnest(range(1, greatest(length(t) - 3, 1) + 1)) AS u(i) WHERE t <> '') GROUP BY id, g),
na AS (SELECT id, sqrt(sum(c * c)) AS n FROM ga GROUP BY id), nb AS (SELECT id, sqrt(sum(c * c)) AS n FROM gb GROUP BY id),
s AS (SELECT gb.id AS bench_id, ga.id AS train_id, sum(ga.c * gb.c) AS dot FROM gb JOIN ga USING (g) GROUP BY ALL),
r AS (SELECT bench_id, train_id, dot / (na.n * nb.n) AS similarity, row_number() OVER (PARTITION BY bench_id ORDER BY dot / (na.n * nb.n) DESC, train_id) - 1 AS rank
      FROM s JOIN na ON na.id = train_id JOIN nb ON nb.id = bench_id)
"""


@query(_NEAR + "SELECT bench_id, rank, train_id, round(similarity, 4) AS similarity FROM r WHERE rank < 5")
def near_duplicate_top(spark, sf_dir):
    return contamination.top_matches(*_sides(spark, sf_dir)).withColumn("similarity", F.round("similarity", 4))


@query(_NEAR + "SELECT count(*) FILTER (similarity >= 0.3 AND rank = 0) AS n_near_cases, count(*) FILTER (similarity >= 0.3) AS n_near_pairs, count(DISTINCT bench_id) AS n_matched_cases FROM r WHERE rank < 5")
def near_duplicate_summary(spark, sf_dir):
    return contamination.summary(contamination.top_matches(*_sides(spark, sf_dir)), 0.3)


@query(
    r"""SELECT d.doc_id AS bench_id, count(*) AS n_hits, min(e.doc_id) AS first_hit FROM documents d JOIN documents e
    ON trim(regexp_replace(d.text, '\s+', ' ', 'g')) = trim(regexp_replace(e.text, '\s+', ' ', 'g')) WHERE d.doc_id % 50 = 0 GROUP BY d.doc_id"""
)
def exact_contamination(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse(F.col("text"))).alias("k"))
    hits = contamination.exact_matches(d.withColumnRenamed("doc_id", "train_id"), d.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "bench_id"), ["k"])
    return hits.select("bench_id", "n_hits", F.element_at("first_hits", 1).alias("first_hit"))


@query(
    r"""SELECT d.doc_id AS bench_id, count(*) AS n_hits, min(e.doc_id) AS first_hit FROM documents d JOIN documents e
    ON d.text = e.text AND d.source = e.source WHERE d.doc_id % 50 = 0 GROUP BY d.doc_id"""
)
def exact_pair_contamination(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k"), F.col("source").alias("k2"))
    hits = contamination.exact_matches(d.withColumnRenamed("doc_id", "train_id"), d.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "bench_id"), ["k", "k2"])
    return hits.select("bench_id", "n_hits", F.element_at("first_hits", 1).alias("first_hit"))


# -- order, splits, samples


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42||' || doc_id), doc_id) AS rk FROM documents")
def seeded_shuffle(spark, sf_dir):
    return sampling.numbered(_t(spark, sf_dir, "documents").select("doc_id"), 42, "doc_id").select("doc_id", "rk")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42||' || doc_id), doc_id) <= floor(0.9 * (SELECT count(*) FROM documents)) THEN 'train' ELSE 'eval' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return sampling.split(_t(spark, sf_dir, "documents").select("doc_id"), 42, "doc_id")


@query("SELECT doc_id, CASE WHEN rk <= 50 THEN 'train' WHEN rk <= 70 THEN 'eval' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7||' || doc_id), doc_id) AS rk FROM documents)")
def sized_split(spark, sf_dir):
    return sampling.split(_t(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id", 50, 20)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42||' || doc_id), doc_id) AS rk FROM documents) WHERE rk <= 5")
def stratified_sample(spark, sf_dir):
    return sampling.take_each(_t(spark, sf_dir, "documents").select("source", "doc_id"), 5, 42, "doc_id", ["source"]).select("source", "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('42||' || doc_id), doc_id LIMIT 30")
def sample_without_replacement(spark, sf_dir):
    return sampling.take(_t(spark, sf_dir, "documents").select("doc_id"), 30, 42, "doc_id")


_FILLED = """
WITH pool AS (SELECT item_id, row_number() OVER (ORDER BY md5('42||' || item_id), item_id) AS rk FROM benchmark), size AS (SELECT count(*) AS p FROM benchmark),
draws AS (SELECT i + 1 AS draw, ('0x' || substr(md5('42||draw||' || i), 1, 15))::BIGINT % p + 1 AS rk FROM size, unnest(range(0, 300 - p)) AS u(i))
SELECT item_id, 0 AS draw FROM pool UNION ALL SELECT item_id, draw FROM draws JOIN pool USING (rk)
"""


@query(_FILLED)
def oversample_fill(spark, sf_dir):
    return sampling.filled(_t(spark, sf_dir, "benchmark").select("item_id"), 300, 42, "item_id")


def _pools(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.expr(_KIND).alias("kind"))


_MIX = f"""
WITH k AS (SELECT doc_id, {_KIND} AS kind FROM documents)
"""


@query(
    _MIX
    + """SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS n_distinct, min(doc_id) AS low FROM (
    SELECT * FROM (SELECT * FROM k WHERE kind = 'parallel_same' ORDER BY md5('42||' || doc_id), doc_id LIMIT 10) UNION ALL
    SELECT * FROM (SELECT * FROM k WHERE kind = 'parallel_diff' ORDER BY md5('43||' || doc_id), doc_id LIMIT 10) UNION ALL
    SELECT * FROM (SELECT * FROM k WHERE kind NOT IN ('parallel_same', 'parallel_diff') ORDER BY md5('44||' || doc_id), doc_id LIMIT 80)) GROUP BY kind"""
)
def targeted_mix(spark, sf_dir):
    mix = sampling.targeted_mix(_pools(spark, sf_dir), "kind", 100, 0.2, 0.5, 42, "doc_id")
    return mix.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_distinct"), F.min("doc_id").alias("low"))


@query(
    _MIX
    + """, p AS (
    SELECT * FROM (SELECT * FROM k WHERE kind = 'parallel_same' ORDER BY md5('42||' || doc_id), doc_id LIMIT 12) UNION ALL
    SELECT * FROM (SELECT * FROM k WHERE kind = 'trap_like' ORDER BY md5('43||' || doc_id), doc_id LIMIT 8)),
    r AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = k.doc_id) ORDER BY md5('44||' || doc_id), doc_id LIMIT 60)
    SELECT doc_id, kind FROM p UNION ALL SELECT doc_id, kind FROM r"""
)
def balanced_mix(spark, sf_dir):
    return sampling.balanced_mix(_pools(spark, sf_dir), "kind", {"parallel_same": 0.15, "trap_like": 0.1}, 80, 42, "doc_id").select("doc_id", "kind")


@query(
    _MIX
    + """, p AS (SELECT * FROM k ORDER BY md5('42||' || doc_id), doc_id LIMIT 100)
    SELECT doc_id, kind FROM (SELECT * FROM k WHERE kind = 'ordinary' AND doc_id NOT IN (SELECT doc_id FROM p) ORDER BY md5('142||' || doc_id), doc_id LIMIT 20)"""
)
def evaluation_slice(spark, sf_dir):
    rows = _pools(spark, sf_dir)
    return sampling.evaluation_slice(rows, sampling.take(rows, 100, 42, "doc_id"), "kind", {"ordinary": 20}, 42, "doc_id").select("doc_id", "kind")


# -- joins and sets


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_unlabelled(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_join_labelled(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query(
    """SELECT o_orderkey, o_custkey, c_name FROM orders JOIN (SELECT c_custkey, max(c_name) AS c_name FROM customer GROUP BY c_custkey) ON o_custkey = c_custkey"""
)
def prediction_case_join(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    cases = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    found, _ = metrics.joined_predictions(orders, cases, "id", "c_name")
    return found.select("o_orderkey", F.col("id").alias("o_custkey"), "c_name")


@query(
    """WITH a AS (SELECT lang, avg(n_chars) AS v FROM documents WHERE lang <> 'es' GROUP BY lang), b AS (SELECT lang, count(*)::DOUBLE AS v FROM documents WHERE lang <> 'de' GROUP BY lang)
    SELECT coalesce(a.lang, b.lang) AS lang, round(coalesce(a.v, 'NaN'::DOUBLE), 4) AS a, coalesce(b.v, 'NaN'::DOUBLE) AS b, round(coalesce(b.v, 'NaN'::DOUBLE) - coalesce(a.v, 'NaN'::DOUBLE), 4) AS delta FROM a FULL JOIN b ON a.lang = b.lang"""
)
def compare_runs(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    a = d.where("lang <> 'es'").groupBy("lang").agg(F.avg("n_chars").alias("v"))
    b = d.where("lang <> 'de'").groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return metrics.compare(a, b, "lang", "v").withColumn("a", F.round("a", 4)).withColumn("delta", F.round("delta", 4))


@query("SELECT o_custkey AS key FROM orders UNION ALL SELECT c_custkey FROM customer")
def set_union_bag(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).unionByName(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))


@query("SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer")
def set_intersect(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).intersect(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))


@query("SELECT p_partkey AS key FROM part EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf_dir):
    keys = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")).subtract(keys)


_CALLS = "SELECT user_id, list_sort(list(DISTINCT event_type)) AS have FROM events GROUP BY user_id"


@query(
    f"""SELECT user_id, len(list_filter(have, lambda x: list_contains(['click', 'purchase'], x))) AS n_present, 2 - len(list_filter(have, lambda x: list_contains(['click', 'purchase'], x))) AS n_missing,
    len(list_filter(have, lambda x: NOT list_contains(['click', 'purchase'], x))) AS n_extra FROM ({_CALLS})"""
)
def key_sets(spark, sf_dir):
    have = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    want = F.array(F.lit("click"), F.lit("purchase"))
    size = lambda x: F.size(x).cast("long")
    return have.select("user_id", size(F.array_intersect("have", want)).alias("n_present"), size(F.array_except(want, F.col("have"))).alias("n_missing"), size(F.array_except("have", want)).alias("n_extra"))


# -- scores, rewards, masks

_SCORED = """(SELECT doc_id, source AS category, quality = 1 AS expected_tool, quality = 1 AND doc_id % 3 <> 0 AS tool_selection_correct, doc_id % 5 <> 0 AS arg_exact_match, doc_id % 7 <> 0 AS canonical_format,
CASE WHEN quality = 0 THEN doc_id % 2 = 0 END AS no_tool_correct, toxic = 0 AS clean_stop, CASE WHEN quality = 1 THEN (doc_id % 4) / 4.0 END AS arg_key_accuracy, quality = 1 AND doc_id % 11 <> 0 AS valid_format, quality = 1 AND doc_id % 13 = 0 AS invalid_json,
doc_id % 3 = 0 AS wrong_tool, quality = 1 AND doc_id % 17 < 3 AS missing_argument, quality = 1 AND doc_id % 19 < 2 AS extra_argument FROM documents JOIN labels USING (doc_id))"""
_STRICT = "CASE WHEN expected_tool THEN tool_selection_correct AND arg_exact_match AND canonical_format AND clean_stop ELSE no_tool_correct AND clean_stop END"


def _scored(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id")
    d = d.selectExpr(
        "doc_id", "source AS category", "quality = 1 AS expected_tool", "quality = 1 AND doc_id % 3 <> 0 AS tool_selection_correct", "doc_id % 5 <> 0 AS arg_exact_match", "doc_id % 7 <> 0 AS canonical_format",
        "CASE WHEN quality = 0 THEN doc_id % 2 = 0 END AS no_tool_correct", "toxic = 0 AS clean_stop", "CASE WHEN quality = 1 THEN (doc_id % 4) / 4.0D END AS arg_key_accuracy", "quality = 1 AND doc_id % 11 <> 0 AS valid_format", "quality = 1 AND doc_id % 13 = 0 AS invalid_json",
        "doc_id % 3 = 0 AS wrong_tool", "quality = 1 AND doc_id % 17 < 3 AS missing_argument", "quality = 1 AND doc_id % 19 < 2 AS extra_argument",
    )
    return d.withColumn("strict_protocol_success", F.expr(_STRICT)).withColumn("overall", F.expr("CASE WHEN expected_tool THEN tool_selection_correct AND arg_exact_match ELSE no_tool_correct END"))


@query(f"SELECT doc_id, {_STRICT} AS strict FROM {_SCORED}")
def strict_protocol_flags(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.col("strict_protocol_success").alias("strict"))


@query(
    f"""SELECT category, count(*) AS n, count(*) FILTER (ov) AS overall, count(*) FILTER (st) AS strict, count(*) FILTER (expected_tool) AS n_tool, 0 AS n_parallel_calls,
    round(avg(ov::INT), 6) AS accuracy, round(avg(st::INT), 6) AS strict_protocol_rate FROM (SELECT *, CASE WHEN expected_tool THEN tool_selection_correct AND arg_exact_match ELSE no_tool_correct END AS ov, {_STRICT} AS st FROM {_SCORED}) GROUP BY category"""
)
def category_metrics(spark, sf_dir):
    out = metrics.by_category(_scored(spark, sf_dir))
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("strict_protocol_rate", F.round("strict_protocol_rate", 6))


#: Each rate of a report: the flag and the cases among which it counts.
_RATES = {
    "tool_selection_accuracy": ("tool_selection_correct::INT", "expected_tool"), "argument_exact_match": ("arg_exact_match::INT", "expected_tool"), "argument_key_accuracy": ("coalesce(arg_key_accuracy, 0)", "expected_tool"),
    "valid_tool_call_format_rate": ("valid_format::INT", "expected_tool"), "canonical_format_rate": ("canonical_format::INT", "expected_tool"), "no_tool_accuracy": ("no_tool_correct::INT", "NOT expected_tool"),
    "tool_abstention_accuracy": ("no_tool_correct::INT", "NOT expected_tool"), "clean_stop_rate": ("clean_stop::INT", "true"), "strict_protocol_success": ("st::INT", "true"), "strict_protocol_success_tool": ("st::INT", "expected_tool"),
    "strict_protocol_success_no_tool": ("st::INT", "NOT expected_tool"), "overall_exact_match": ("ov::INT", "true"), "invalid_json_rate": ("invalid_json::INT", "expected_tool"), "wrong_tool_rate": ("wrong_tool::INT", "expected_tool"),
    "missing_argument_rate": ("missing_argument::INT", "expected_tool"), "extra_argument_rate": ("extra_argument::INT", "expected_tool"),
}
_JUDGED = f"(SELECT *, CASE WHEN expected_tool THEN tool_selection_correct AND arg_exact_match ELSE no_tool_correct END AS ov, {_STRICT} AS st FROM {_SCORED})"


@query(
    "SELECT count(*) AS n_cases, count(*) FILTER (expected_tool) AS n_tool_cases, count(*) FILTER (NOT expected_tool) AS n_no_tool_cases, "
    + ", ".join(f"round(coalesce(avg({flag}) FILTER ({among}), 0), 6) AS {name}" for name, (flag, among) in _RATES.items())
    + f" FROM {_JUDGED}"
)
def macro_means(spark, sf_dir):
    """All rates, over all, tool and no-tool cases."""
    out = metrics.aggregate(_scored(spark, sf_dir))
    return out.select("n_cases", "n_tool_cases", "n_no_tool_cases", *(F.round(r, 6).alias(r) for r in _RATES))


@query(
    r"""SELECT doc_id, regexp_matches(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '<\|im_start\|>|(?:^|\n)\s*(?:system|user|assistant)\s*\n') AS leaked,
    ends_with(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '.') AS clean FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'user' || chr(10) || 'x' ELSE text END AS text FROM documents)"""
)
def leak_and_stop(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN concat(text, '\nuser\nx') ELSE text END").alias("raw"))
    ends = F.regexp_replace("raw", T.STRIP, "").endswith(".")
    return d.select("doc_id", T.prompt_leaked(F.col("raw")).alias("leaked"), ends.alias("clean"))


@query(
    f"""SELECT user_id, round(greatest(0.0, least(1.0, len(list_filter(['click', 'purchase'], lambda x: list_contains(have, x))) / 2.0 - 0.2 * greatest(0, len(have) - 2))), 6) AS selection,
    round(greatest(0.0, 1 - abs(len(have) - 2) / 2.0), 6) AS parallel FROM ({_CALLS})"""
)
def rewards_selection(spark, sf_dir):
    have = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    want = F.array(F.lit("click"), F.lit("purchase"))
    return have.select("user_id", F.round(rewards.tool_selection(F.lit(True), want, F.col("have")), 6).alias("selection"), F.round(rewards.parallel_completion(F.lit(True), F.size(want), F.size("have")), 6).alias("parallel"))


#: A document as tokens 1, 2, ... of its length. A sequence from 1 to 0 would run backwards and have two; an unknown length has no tokens to say.
_IDS = "CASE WHEN n_chars > 0 THEN sequence(1, CAST(n_chars AS INT)) WHEN n_chars IS NOT NULL THEN CAST(array() AS ARRAY<INT>) END"


@query(
    """SELECT doc_id, max(n_chars) OVER (PARTITION BY doc_id // 8) AS size,
    (3 * (n_chars // 3) * (n_chars // 3 + 1) // 2 - 100 * (max(n_chars) OVER (PARTITION BY doc_id // 8) - n_chars // 3))::BIGINT AS checksum FROM documents"""
)
def label_mask_padding(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 8").alias("batch"), "n_chars", F.expr(_IDS).alias("input_ids"))
    d = d.withColumn("mask", F.transform("input_ids", lambda i: F.when(i % 3 == 0, 1).otherwise(0))).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
    d = masks.collated(d.withColumn("labels", masks.labels("input_ids", "mask")), "batch")
    checksum = F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", F.size("labels").cast("long").alias("size"), F.when(F.col("n_chars").isNotNull(), checksum).alias("checksum"))


@query(
    """SELECT count(*) AS n_examples, sum(n)::BIGINT AS n_tokens, sum(n // 3)::BIGINT AS n_loss_tokens, round(sum(n // 3) / sum(n), 4) AS supervised_fraction, round(avg(n), 4) AS mean_tokens FROM (SELECT n_chars AS n FROM documents)"""
)
def token_audit(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.expr(_IDS).alias("ids"))
    d = d.withColumn("mask", F.transform("ids", lambda i: F.when(i % 3 == 0, 1).otherwise(0)))
    out = masks.audit(d.select(masks.labels("ids", "mask").alias("labels")))
    return out.withColumn("supervised_fraction", F.expr("if(n_tokens > 0, supervised_fraction, n_tokens + double('nan'))"))  # shares of no tokens, as SQL has them


# -- tool calls from text

_RAW = """CASE event_id % 5 WHEN 0 THEN concat('<tool_call>{"name": "', event_type, '", "arguments": ', props, '}</tool_call><|im_end|>')
WHEN 1 THEN concat('```json\n{"name": "', event_type, '", "arguments": ', props, ',}\n```') WHEN 2 THEN concat('{"name": "', event_type, '", "arguments": ', props, '} and more')
WHEN 3 THEN concat('I would call ', event_type) ELSE concat('<tool_call>{"name": "', event_type, '", "arguments": ') END"""


def _generated(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", "event_type", "props", F.expr(_RAW).alias("raw"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN 1 ELSE 0 END AS n_calls, CASE WHEN event_id % 5 = 4 THEN 1 ELSE 0 END AS n_invalid,
    CASE event_id % 5 WHEN 0 THEN 'native' WHEN 1 THEN 'fenced' WHEN 2 THEN 'bare' END AS source, CASE WHEN event_id % 5 < 3 THEN event_type END AS name,
    CASE WHEN event_id % 5 < 3 THEN json_extract_string(props, '$.k') END AS k FROM events"""
)
def parse_calls(spark, sf_dir):
    p = _generated(spark, sf_dir).withColumn("p", parse_tool_calls("raw"))
    first = F.get("p.calls", F.lit(0))
    return p.select("event_id", F.size("p.calls").alias("n_calls"), F.size("p.invalid_blocks").alias("n_invalid"), first["source"].alias("source"), first["name"].alias("name"), F.get_json_object(first["arguments"], "$.k").alias("k"))


@query(
    """SELECT event_id, event_id % 5 IN (0, 1, 2) AS valid_format, event_id % 5 = 0 AS canonical_format, event_id % 5 < 3 AS overall, event_id % 5 = 0 AS strict,
    event_id % 5 = 4 AS invalid_json, event_id % 5 >= 3 AS missing_argument FROM events"""
)
def score_cases(spark, sf_dir):
    g = _generated(spark, sf_dir).withColumn("calls", F.array(F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments"))))
    s = g.select("event_id", score_case(F.lit("tool"), "calls", "raw", F.lit(None).cast("boolean")).alias("s"))
    return s.select("event_id", "s.valid_format", "s.canonical_format", "s.overall", F.col("s.strict_protocol_success").alias("strict"), "s.invalid_json", "s.missing_argument")


@query(
    """SELECT event_type AS category, count(*) AS n, count(*) FILTER (event_id % 5 < 3) AS overall, count(*) FILTER (event_id % 5 = 0) AS strict, count(*) AS n_tool, 0 AS n_parallel_calls,
    round(avg((event_id % 5 < 3)::INT), 6) AS accuracy, round(avg((event_id % 5 = 0)::INT), 6) AS strict_protocol_rate FROM events GROUP BY event_type"""
)
def rescore_by_category(spark, sf_dir):
    g = _generated(spark, sf_dir).withColumn("calls", F.array(F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments"))))
    s = g.select(F.col("event_type").alias("category"), score_case(F.lit("tool"), "calls", "raw", F.lit(None).cast("boolean")).alias("s")).select("category", "s.*")
    return metrics.by_category(s).withColumn("accuracy", F.round("accuracy", 6)).withColumn("strict_protocol_rate", F.round("strict_protocol_rate", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest benchmark overlaps of training documents."""
    return near_duplicate_top(spark, sf_dir)
