"""The reference's operators over the standard tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.text import sentences, stable_id, token_estimate, words
from evidra.operators import clinical, dedup, evaluation, governance, graph, ranking
from evidra.sources.readers import html_sections as sections_of
from evidra.streaming import limits

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text ---------------------------------------------------------------------------------------

COLLAPSED = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f]+', ' ', 'g'))"
WORDS = f"list_filter(string_split({COLLAPSED}, ' '), lambda w: w <> '')"


@query(
    rf"""WITH s AS (
      SELECT doc_id, lang, unnest(string_split(regexp_replace({COLLAPSED}, '([.!?]) ([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS x
      FROM documents)
    SELECT lang, count(*) AS n_sentences
    FROM (SELECT sha1(lower(x)) AS k, arg_min(lang, doc_id) AS lang FROM s WHERE length(x) >= 20 GROUP BY 1) GROUP BY 1"""
)
def sentence_dedup_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    each = docs.select("doc_id", "lang", F.posexplode(sentences(F.col("text"))).alias("pos", "s"))
    first = dedup.first_wins(each, F.sha1(F.lower("s").cast("binary")), ["doc_id", "pos"], ["lang"])
    return first.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sentences"))


@query(f"SELECT doc_id, CASE WHEN len({WORDS}) = 0 THEN 0 ELSE greatest(1, floor(len({WORDS}) * 1.3)::INT) END AS n_tokens FROM documents")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("n_tokens"))


@query(
    """SELECT o_orderkey, 'ord_' || label || '_' || substr(sha1(label || '|' || o_orderkey), 1, 8) AS order_id
    FROM (SELECT o_orderkey, lower(o_orderstatus) || '_' || trim(lower(regexp_replace(o_orderpriority, '[^a-zA-Z0-9]+', '_', 'g')), '_') AS label FROM orders)"""
)
def stable_ids(spark, sf_dir):
    name = stable_id([F.col("o_orderstatus"), F.col("o_orderpriority")], [F.col("o_orderkey")], "ord")
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("order_id"))


# --- duplicates ---------------------------------------------------------------------------------


@query(f"SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) AS n_rows FROM documents GROUP BY sha256(lower({COLLAPSED}))")
def exact_dedup_first_wins(spark, sf_dir):
    return dedup.first_wins(table(spark, sf_dir, "documents"), dedup.text_key(F.col("text")), ["doc_id"], ["doc_id", "lang"])


@query(f"SELECT sha256(lower({COLLAPSED})) AS key, count(*) AS n_rows, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_report(spark, sf_dir):
    return dedup.repeated_keys(table(spark, sf_dir, "documents"), dedup.text_key(F.col("text")), "doc_id")


@query(
    f"""SELECT doc_id, lang FROM (
      SELECT doc_id, lang, row_number() OVER (PARTITION BY sha256(lower({COLLAPSED})) ORDER BY n_chars DESC, length(text), doc_id) AS n FROM documents) WHERE n = 1"""
)
def best_copy_wins(spark, sf_dir):
    return dedup.best_wins(table(spark, sf_dir, "documents"), dedup.text_key(F.col("text")), "n_chars", "text", "doc_id", ["doc_id", "lang"])


@query()
def minhash_buckets(spark, sf_dir):
    return dedup.bucket_report(table(spark, sf_dir, "documents"))


# --- retrieval ----------------------------------------------------------------------------------


@query(
    f"""WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
    n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
    q AS (SELECT item_id AS query_id, term, count(*) AS times
      FROM (SELECT item_id, lower(unnest({WORDS})) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL),
    t AS (SELECT doc_id, len(ws) AS l, lower(unnest(ws)) AS term FROM d),
    p AS (SELECT doc_id, l, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    s AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / mean)) * times), 6) AS score
      FROM p JOIN f USING (term) JOIN q USING (term) CROSS JOIN n GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
)
def bm25_topk(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return ranking.bm25(table(spark, sf_dir, "documents"), asked)


def _knn(condition: str) -> str:
    return f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    p AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_cosine_similarity(q.e, v.e), 4) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id {condition} WHERE q.vec_id % 20 = 0)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 5"""


@query(_knn(""))
def knn_cosine_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ranking.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query(_knn("AND q.label = v.label"))
def knn_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ranking.nearest(vectors, vectors.where("vec_id % 20 = 0"), same="label")


@query(
    f"""WITH a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    b AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY len({WORDS}) DESC, doc_id) AS rank FROM documents)
    SELECT lang, doc_id, round(sum(1 / (60 + rank)), 6) AS score, count(*) AS n_lists
    FROM (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100) GROUP BY 1, 2"""
)
def rrf_fusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", F.size(words(F.col("text"))).alias("n_words"))
    lists = [ranking.top_k(docs, [F.desc(c), F.asc("doc_id")], 100, ["lang"]) for c in ("n_chars", "n_words")]
    return ranking.fuse_ranks(lists, "doc_id", ["lang"]).withColumn("score", F.round("score", 6))


@query(
    """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
    SELECT lang, doc_id, rank::INT AS rank, row_number() OVER (PARTITION BY lang ORDER BY (rank - 1) % 2, CASE WHEN (rank - 1) % 2 = 0 THEN rank ELSE -rank END)::INT AS position
    FROM r WHERE rank <= 10"""
)
def lost_in_middle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return ranking.edges_first(ranking.top_k(docs, [F.desc("n_chars"), F.asc("doc_id")], 10, ["lang"]), ["lang"]).drop("n_chars")


@query(
    """WITH h AS (SELECT conv_id, turn, length(text)::DOUBLE AS score, true AS hit FROM conversations WHERE role = 'user'),
    c AS (SELECT DISTINCT conv_id, turn FROM conversations),
    n AS (SELECT conv_id, turn + d AS turn, 0.85 * score AS score, false AS hit FROM h, (VALUES (-1), (1)) AS o(d)),
    a AS (SELECT * FROM h UNION ALL SELECT * FROM n WHERE (conv_id, turn) IN (SELECT (conv_id, turn) FROM c))
    SELECT conv_id, turn, round(coalesce(max(score) FILTER (hit), max(score)), 4) AS score, bool_or(hit) AS hit FROM a GROUP BY 1, 2"""
)
def neighbour_window(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    hits = turns.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("double").alias("score"))
    return ranking.with_neighbours(hits, turns, "conv_id", "turn").withColumn("score", F.round("score", 4))


@query(
    """SELECT doc_id, round(least(0.35 * least(n_chars / 20011.0, 1) + CASE lang WHEN 'en' THEN 0.35 WHEN 'fr' THEN 0.3 ELSE 0.1 END
      + CASE WHEN source IS NOT NULL THEN 0.08 ELSE 0 END + greatest(0, 0.08 - least(greatest(2026 - (2000 + n_chars % 26), 0), 12) * 0.005), 1), 3) AS score
    FROM documents"""
)
def quality_scores(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "guideline").when(F.col("lang") == "fr", "drug_label").otherwise("other")
    no = F.lit(False)
    score = ranking.quality_score(F.col("n_chars") / F.lit(20011.0), kind, F.col("source"), F.col("source").isNotNull(), no, no, (2000 + F.col("n_chars") % 26), 2026)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))


@query(
    """SELECT event_id, round(CASE WHEN m > 0 THEN value / m ELSE 0 END, 6) AS share
    FROM (SELECT event_id, value, max(value) OVER (PARTITION BY event_type) AS m FROM events)"""
)
def max_normalised(spark, sf_dir):
    out = ranking.over_group_max(table(spark, sf_dir, "events"), "value", ["event_type"], "share")
    return out.select("event_id", F.round("share", 6).alias("share"))


# --- patients and rules -------------------------------------------------------------------------

LADDER_SQL = """CASE WHEN {v} IS NULL THEN 'missing' WHEN {v} < 15 THEN 'kidney_failure' WHEN {v} < 30 THEN 'severely_reduced'
      WHEN {v} < 45 THEN 'moderately_reduced' WHEN {v} < 60 THEN 'mildly_reduced' ELSE 'preserved' END"""


@query(f"SELECT c_custkey, {LADDER_SQL.format(v='c_acctbal / 100')} AS status FROM customer")
def status_ladder(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", clinical.ladder(F.col("c_acctbal") / 100, *clinical.RENAL).alias("status"))


@query(
    f"""WITH p AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 100 END AS v, lower(c_mktsegment) AS seg FROM customer),
    s AS (SELECT *, {LADDER_SQL.format(v='v')} AS renal FROM p),
    f AS (
      SELECT c_custkey, 'missing_lvef' AS name, 'moderate' AS severity FROM s WHERE v IS NULL
      UNION ALL SELECT c_custkey, 'missing_egfr', 'moderate' FROM s WHERE v IS NULL
      UNION ALL SELECT c_custkey, 'missing_potassium', 'moderate' FROM s WHERE v IS NULL
      UNION ALL SELECT c_custkey, 'missing_sbp', 'moderate' FROM s WHERE v IS NULL
      UNION ALL SELECT c_custkey, 'missing_heart_rate', 'moderate' FROM s WHERE v IS NULL
      UNION ALL SELECT c_custkey, 'renal_impairment', CASE WHEN renal = 'moderately_reduced' THEN 'moderate' ELSE 'high' END FROM s
        WHERE renal IN ('severely_reduced', 'kidney_failure', 'moderately_reduced')
      UNION ALL SELECT c_custkey, 'hyperkalemia', CASE WHEN v >= 55 THEN 'high' ELSE 'moderate' END FROM s WHERE v >= 50
      UNION ALL SELECT c_custkey, 'hypotension', CASE WHEN v < 60 THEN 'high' ELSE 'moderate' END FROM s WHERE v + 30 < 100
      UNION ALL SELECT c_custkey, 'bradycardia', 'moderate' FROM s WHERE v < 60)
    SELECT name, severity, count(*) AS n FROM f GROUP BY 1, 2"""
)
def risk_flags(spark, sf_dir):
    v = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100)
    none = F.array().cast("array<string>")
    patients = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("case_id"), v.alias("lvef"), v.alias("egfr"), (v / 10).alias("potassium"), (v + 30).alias("systolic_bp"),
        v.alias("heart_rate"), F.array(F.lower("c_mktsegment")).alias("comorbidities"), none.alias("current_medications"),
    )
    return clinical.risk_flags(clinical.statuses(patients)).groupBy("name", "severity").agg(F.count(F.lit(1)).alias("n"))


BRACKETS = [("high", 40, None), ("middle", 20, 35), ("low", None, 10), ("narrow", 30, 32)]


@query(
    """SELECT bracket, count(*) AS n FROM (SELECT CASE WHEN l_quantity BETWEEN 20 AND 35 THEN 'middle' WHEN l_quantity BETWEEN 30 AND 32 THEN 'narrow'
      WHEN l_quantity <= 10 THEN 'low' WHEN l_quantity >= 40 THEN 'high' END AS bracket FROM lineitem) GROUP BY 1"""
)
def range_join_brackets(spark, sf_dir):
    rows = clinical.bracket(table(spark, sf_dir, "lineitem").select("l_quantity"), BRACKETS, "l_quantity", "bracket")
    return rows.groupBy("bracket").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS code FROM lineitem),
    s AS (SELECT l_orderkey, list(code) AS codes FROM m GROUP BY 1)
    SELECT l_orderkey, 'returned_open' AS rule_id FROM s WHERE list_has_any(codes, ['RF']) AND list_has_any(codes, ['NO'])
    UNION ALL SELECT l_orderkey, 'mixed' FROM s WHERE list_has_any(codes, ['AF', 'RF']) AND list_has_any(codes, ['NO', 'NF'])"""
)
def set_overlap_join(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("code")).distinct()
    rules = spark.createDataFrame([("returned_open", ["RF"], ["NO"]), ("mixed", ["AF", "RF"], ["NO", "NF"])], "rule_id string, set_a array<string>, set_b array<string>")
    return clinical.set_pairs(members, rules, "l_orderkey", "code")


@query(
    """SELECT c_custkey FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)) OR (c_mktsegment = 'AUTOMOBILE' AND c_nationkey = 7)"""
)
def risk_pair_semijoin(spark, sf_dir):
    rules = spark.createDataFrame([(["BUILDING", "MACHINERY"], [1, 2, 3]), (["AUTOMOBILE"], [7])], "segments array<string>, nations array<int>")
    return clinical.pair_semi_join(table(spark, sf_dir, "customer"), rules, "c_mktsegment", "c_nationkey", "segments", "nations").select("c_custkey")


FIRED = {"always": [], "low_or_missing": [[("v", "missing_or_lt", 10)]], "band": [[("v", "gte", 20), ("v", "lte", 40)], [("v", "gt", 90)]]}


@query(
    """WITH p AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 100 END AS v FROM customer)
    SELECT c_custkey, 'always' AS rule_id FROM p UNION ALL SELECT c_custkey, 'low_or_missing' FROM p WHERE v IS NULL OR v < 10
    UNION ALL SELECT c_custkey, 'band' FROM p WHERE (v >= 20 AND v <= 40) OR v > 90"""
)
def fired_rules(spark, sf_dir):
    facts = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100).alias("v"))
    return clinical.fired_rules(facts, FIRED, "c_custkey")


@query(
    """SELECT user_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""
)
def latest_lab(spark, sf_dir):
    return clinical.latest_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "ts", "event_id")


@query(
    """SELECT user_id, (SELECT x.event_type FROM events x WHERE x.user_id = e.user_id AND x.event_type IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 1) AS event_type,
      (SELECT x.value FROM events x WHERE x.user_id = e.user_id AND x.value IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 1) AS value
    FROM (SELECT DISTINCT user_id FROM events) e"""
)
def draft_merge(spark, sf_dir):
    return clinical.merged_draft(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


# --- catalogs -----------------------------------------------------------------------------------

LATEST = "SELECT o_custkey, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders"


def _latest(orders):
    return governance.latest(orders, "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"]).withColumnRenamed("o_orderkey", "version")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND lower(o_orderpriority) LIKE '%urgent%'")
def catalog_filter(spark, sf_dir):
    return governance.matching(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_custkey": None}, {"o_orderpriority": "Urgent"}).select("o_orderkey")


@query("SELECT count(*) FILTER (o_orderstatus = 'O' OR o_orderstatus NOT IN ('O', 'F') OR o_orderstatus IS NULL) AS O, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) AS total FROM orders")
def status_counts(spark, sf_dir):
    return governance.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ("O", "F"), "O")


@query(
    """SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND trim(o_orderstatus) <> '' GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' AND trim(o_orderpriority) <> '' GROUP BY 2"""
)
def facets(spark, sf_dir):
    return governance.facets(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query(f"{LATEST} GROUP BY 1")
def latest_version(spark, sf_dir):
    return _latest(table(spark, sf_dir, "orders"))


@query(
    f"""WITH old AS ({LATEST} WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), new AS ({LATEST} GROUP BY 1)
    SELECT o_custkey, CASE WHEN old.version IS NULL THEN 'inserted' WHEN old.o_orderstatus = new.o_orderstatus AND old.o_orderpriority = new.o_orderpriority THEN 'unchanged' ELSE 'updated' END AS outcome,
      CASE WHEN old.version IS NULL THEN 1 WHEN old.o_orderstatus = new.o_orderstatus AND old.o_orderpriority = new.o_orderpriority THEN old.version ELSE old.version + 1 END AS version
    FROM new LEFT JOIN old USING (o_custkey)"""
)
def version_sync(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return governance.sync(_latest(orders.where("o_orderdate < timestamp_ntz'1996-01-01'")), _latest(orders), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query(
    f"""WITH l AS ({LATEST} WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), r AS ({LATEST} WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1),
    j AS (SELECT coalesce(l.o_custkey, r.o_custkey) AS o_custkey, l.o_orderstatus AS s0, r.o_orderstatus AS s1, l.o_orderpriority AS p0, r.o_orderpriority AS p1 FROM l FULL JOIN r ON l.o_custkey = r.o_custkey),
    e AS (SELECT o_custkey, 'o_orderstatus' AS field, s0 AS old, s1 AS new FROM j UNION ALL SELECT o_custkey, 'o_orderpriority', p0, p1 FROM j)
    SELECT o_custkey, field, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'modified' END AS change, old, new FROM e WHERE old IS DISTINCT FROM new"""
)
def field_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    left, right = _latest(orders.where("o_orderdate < timestamp_ntz'1996-01-01'")), _latest(orders.where("o_orderdate >= timestamp_ntz'1995-01-01'"))
    return governance.field_diff(left, right, "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def pagination(spark, sf_dir):
    return governance.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 100)


@query(
    f"""WITH p AS ({LATEST} WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), s AS ({LATEST} GROUP BY 1)
    SELECT * FROM p UNION ALL SELECT * FROM s WHERE o_custkey NOT IN (SELECT o_custkey FROM p)"""
)
def primary_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return governance.primary_wins(_latest(orders.where("o_orderdate < timestamp_ntz'1996-01-01'")), _latest(orders), "o_custkey")


@query(
    """WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'),
    j AS (SELECT l.k AS a, r.k AS b FROM l FULL JOIN r ON l.k = r.k)
    SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (b IS NULL) AS n_left, count(*) FILTER (a IS NULL) AS n_right,
      count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*) AS rate FROM j"""
)
def set_agreement(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return governance.agreement(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "o_custkey")


@query(
    """SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS types FROM (SELECT user_id, event_type, min(event_id) AS o FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""
)
def merged_lists(spark, sf_dir):
    return governance.merged_lists(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "types").withColumn("types", F.array_join("types", ","))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def referential_integrity(spark, sf_dir):
    return governance.unknown_references(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


# --- graph --------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
    p AS (SELECT a.l_partkey AS seed, b.l_partkey, count(*) AS n FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n DESC, l_partkey)::INT AS rank FROM p) WHERE rank <= 3"""
)
def entity_cooccurrence(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return graph.co_occurring(lines, lines, "l_orderkey", "l_partkey")


@query(
    """SELECT 'rel_' || substr(sha1(l_partkey || '|SUPPLIED_BY|' || l_suppkey), 1, 16) AS relationship_id, l_partkey::VARCHAR AS source_id, 'SUPPLIED_BY' AS relationship_type, l_suppkey::VARCHAR AS target_id
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"""
)
def relationship_edges(spark, sf_dir):
    return graph.edges(table(spark, sf_dir, "lineitem"), F.col("l_partkey"), "SUPPLIED_BY", F.col("l_suppkey"))


@query(
    """SELECT c_mktsegment, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"""
)
def star_expansion(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    joined = graph.expand(lines, orders, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "l_orderkey", "o_orderkey", "c_custkey")
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1)
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_lines"), revenue.alias("revenue"))


# --- evaluation ---------------------------------------------------------------------------------

PASSES = [
    ("not_blank", "trim(text) <> ''"),
    ("long_enough", "length(text) >= 200"),
    ("no_marks", "text NOT LIKE '%###%'"),
    ("has_source", "source IS NOT NULL"),
    ("not_huge", "n_chars <= 10000"),
]


def _retention_sql() -> str:
    parts, before = [], "true"
    for name, test in PASSES:
        now = f"({before}) AND coalesce({test}, false)"
        parts.append(f"SELECT '{name}' AS pass, count(*) FILTER ({before}) AS n_in, count(*) FILTER ({now}) AS n_out FROM documents")
        before = now
    return "SELECT *, CASE WHEN n_in > 0 THEN round(n_out / n_in, 6) ELSE 0 END AS rate FROM (" + " UNION ALL ".join(parts) + ")"


@query(_retention_sql())
def staged_filter(spark, sf_dir):
    out = evaluation.retention(table(spark, sf_dir, "documents"), [(n, F.expr(t)) for n, t in PASSES])
    return out.withColumn("rate", F.round("rate", 6))


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query(
    """WITH r AS (SELECT source, quality = 1 AS g, n_chars >= 1000 AS p FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn
      FROM r GROUP BY ROLLUP (source))
    SELECT source, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
      round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1 FROM c"""
)
def precision_recall(spark, sf_dir):
    return evaluation.scores(_labelled(spark, sf_dir), F.col("quality") == 1, F.col("n_chars") >= 1000, "source")


@query(
    """SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS n, round(avg(quality), 4) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)"""
)
def rollup_rates(spark, sf_dir):
    return evaluation.accept_rates(_labelled(spark, sf_dir), F.col("quality"), "lang")


@query(
    """WITH r AS (SELECT (n_chars % 101) / 100.0 AS c, quality AS ok FROM labels JOIN documents USING (doc_id)),
    b AS (SELECT CASE WHEN c >= 0.5 AND c < 0.6 THEN 0 WHEN c >= 0.6 AND c < 0.7 THEN 1 WHEN c >= 0.7 AND c < 0.8 THEN 2 WHEN c >= 0.8 AND c < 0.9 THEN 3 ELSE 4 END AS bucket, ok FROM r)
    SELECT bucket, count(*) AS n, sum(ok)::BIGINT AS n_correct, round(sum(ok) / count(*), 4) AS accuracy, round((0.55 + bucket * 0.1)::DOUBLE, 4) AS expected FROM b GROUP BY 1"""
)
def calibration_buckets(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("confidence", (F.col("n_chars") % 101) / 100)
    return evaluation.calibration(rows, "confidence", F.col("quality") == 1)


@query("SELECT lang, doc_id, place::INT AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha1('42|' || doc_id), doc_id) AS place FROM documents) WHERE place <= 5")
def stratified_sample(spark, sf_dir):
    return evaluation.stratified_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", 5, "doc_id")


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events),
    s AS (SELECT event_type, list_sort(list(value)) AS v, sum(value) AS total FROM r WHERE n <= 1000 GROUP BY 1)
    SELECT event_type, len(v)::INT AS n, round(total, 2) AS total, v[(floor((len(v) - 1) * 0.5) + 1)::INT] AS p50, v[(floor((len(v) - 1) * 0.95) + 1)::INT] AS p95 FROM s"""
)
def latency_summary(spark, sf_dir):
    return evaluation.latencies(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"])


# --- streams and sources ------------------------------------------------------------------------


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(spark, sf_dir):
    counts = limits.window_counts(table(spark, sf_dir, "events"), "ts", "event_type")
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query()
def rate_limit_fixed(spark, sf_dir):
    return limits.fixed_windows(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 3600)


@query()
def rate_limit_sliding(spark, sf_dir):
    return limits.sliding_log(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 3600)


@query()
def html_sections(spark, sf_dir):
    return sections_of(table(spark, sf_dir, "pages"))
