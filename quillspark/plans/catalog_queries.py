"""Queries over the supplied tables, one or more for each operator, with the SQL that says what they return.

Most are written in the engine's own dialect and go through the rewriter; those
on operators that are DataFrame functions call them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import register
from ..operators import relational, search
from ..streaming import windows
from .builder import select
from .sql import Rewriter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the engine's dialect; without ``oracle`` the same text is SQL for all."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(Rewriter(spark).statement(text))

    QUERIES[name], ORACLE[name] = run, oracle or text


def _df(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


# aggregation

_sql("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
 """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
_sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_sql("agg_whole_table_empty", "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders WHERE o_orderkey < 0")
_sql("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag")
_sql("agg_min_max", "SELECT c_mktsegment, min(c_name) AS first_name, max(c_acctbal) AS top FROM customer GROUP BY c_mktsegment")
_sql("agg_median", "SELECT l_linestatus, median(l_extendedprice) AS mid FROM lineitem GROUP BY l_linestatus")
_sql("agg_min_by_max_by", "SELECT c_nationkey, min_by(c_custkey, c_acctbal) AS poorest, max_by(c_custkey, c_acctbal) AS richest FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_min(c_custkey, c_acctbal) AS poorest, arg_max(c_custkey, c_acctbal) AS richest FROM customer GROUP BY c_nationkey")
_sql("agg_expressions", "SELECT o_orderpriority, CASE WHEN count(*) > 2950 THEN 'many' ELSE 'few' END AS size, round(sum(o_totalprice) / count(*), 2) AS mean, max(o_totalprice) IS NULL AS none FROM orders GROUP BY o_orderpriority")
_sql("agg_null_handling", "SELECT nullif(c_mktsegment, 'BUILDING') AS seg, count(*) AS n, count(nullif(c_mktsegment, 'MACHINERY')) AS k FROM customer GROUP BY nullif(c_mktsegment, 'BUILDING')")
_sql("agg_rollup_cube", "SELECT r_name, n_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
_sql("agg_filter_clause", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS n FROM orders GROUP BY o_orderpriority")
_sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_sql("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")


@_df("pivot", "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS \"F\", CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS \"O\" FROM orders GROUP BY o_orderpriority")
def _pivot(spark, sf_dir):
    got = relational.pivot(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O"], F.count(F.lit(1)))
    return got.select("o_orderpriority", F.coalesce("F", F.lit(0)).alias("F"), F.coalesce("O", F.lit(0)).alias("O"))


@_df("vec_avg_group", "SELECT label, list_transform(list_sort(list(struct_pack(p := p, m := m))), lambda s: s.m) AS v FROM (SELECT label, p, round(avg(x), 6) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY label, p) GROUP BY label")
def _vec_avg(spark, sf_dir):
    got = relational.vec_avg_by(table(spark, sf_dir, "embeddings"), ["label"], "embedding", "v")
    return got.select("label", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


_PLACES = "SELECT user_id, round((event_id % 360) - 180 + value / 1000, 4) AS lon, round((event_id % 170) - 85 + value / 2000, 4) AS lat, event_id FROM events"


def _places(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(_PLACES)


@_df("geo_bbox_agg", f"SELECT user_id % 7 AS g, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM ({_PLACES}) GROUP BY 1")
def _bbox(spark, sf_dir):
    got = relational.geo_bbox_agg(_places(spark, sf_dir).withColumn("g", F.expr("user_id % 7")), ["g"], "lon", "lat")
    return got.select("g", *(F.col("bbox")[k].alias(n) for k, n in enumerate("wsen")))


@_df("geo_centroid_agg", f"SELECT user_id % 7 AS g, round(avg(lon), 5) AS lon, round(avg(lat), 5) AS lat FROM ({_PLACES}) GROUP BY 1")
def _centroid(spark, sf_dir):
    got = relational.geo_centroid_agg(_places(spark, sf_dir).withColumn("g", F.expr("user_id % 7")), ["g"], "lon", "lat")
    return got.select("g", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


@_df("geo_dissolve", "SELECT r_regionkey AS g, 'Polygon' AS kind, CAST(r_regionkey + 1 AS DOUBLE) AS width FROM region")
def _dissolve(spark, sf_dir):
    cells = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("g"), F.explode(F.sequence(F.lit(0), F.col("r_regionkey"))).alias("x"))
    square = cells.select("g", F.expr("to_json(named_struct('type', 'Polygon', 'coordinates', array(array(array(x, 0), array(x + 1, 0), array(x + 1, 1), array(x, 1), array(x, 0)))))").alias("geom"))
    box = register.fn(spark, "geo_bbox", F.col("geometry"))
    return relational.geo_dissolve(square, ["g"], "geom").select("g", F.get_json_object("geometry", "$.type").alias("kind"), (box[2] - box[0]).alias("width"))


# joins

_sql("join_inner_aggregate", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
_sql("join_right", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
_sql("join_full", "SELECT coalesce(a.n_name, b.n_name) AS n_name, a.n_regionkey AS x, b.n_regionkey AS y FROM (SELECT * FROM nation WHERE n_regionkey < 3) a FULL OUTER JOIN (SELECT * FROM nation WHERE n_regionkey > 1) b ON a.n_nationkey = b.n_nationkey")
_sql("join_cross", "SELECT a.r_name AS one, b.r_name AS two FROM region a CROSS JOIN region b")
_sql("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_sql("join_subquery", "SELECT c_name, t.total FROM customer JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) t ON c_custkey = t.o_custkey WHERE t.total > 400000")
_sql("five_way_join", "SELECT r_name, p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_size > 40 GROUP BY r_name, p_brand")


@_df("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _semi(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return relational.semi(table(spark, sf_dir, "customer"), big, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@_df("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _anti(spark, sf_dir):
    return relational.anti(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@_df("join_asof", """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id, ts, max(event_id) AS prior FROM events WHERE event_id % 2 = 1 GROUP BY user_id, ts)
 SELECT l.event_id, r.prior FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def _asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    r = e.where("event_id % 2 = 1").groupBy("user_id", "ts").agg(F.max("event_id").alias("prior"))
    return relational.asof_join(e.where("event_id % 2 = 0"), r, "ts", "ts", ["user_id"], ["prior"]).select("event_id", "prior")


@_df("join_range", "SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice >= p_retailprice * 100 AND o_totalprice < p_retailprice * 100 + 50")
def _range(spark, sf_dir):
    r = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("low"), (F.col("p_retailprice") * 100 + 50).alias("high"))
    return relational.range_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), r, "o_totalprice", "low", "high", 50.0).select("o_orderkey", "p_partkey")


# predicates and expressions

_sql("no_from", "SELECT 1 + 1 AS two, 'a' || 'b' AS ab, CAST(NULL AS INT) IS NULL AS none")
_sql("bare_table", "region", "SELECT * FROM region")
_sql("filter_between_in", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')")
_sql("filter_like_ilike", "SELECT count(*) AS n FROM part WHERE p_type LIKE '%A%' OR p_name ILIKE 'P%'")
_sql("filter_glob", "SELECT c_custkey FROM customer WHERE c_name GLOB '*1?' AND c_mktsegment NOT GLOB 'B*'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^.*1.$') AND NOT regexp_matches(c_mktsegment, '^B.*$')")
_sql("filter_similar_to", "SELECT c_custkey FROM customer WHERE c_mktsegment SIMILAR TO '(BUILD|MACH)%'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_mktsegment, '^(?:(BUILD|MACH).*)$')")
_sql("filter_regexp", "SELECT c_custkey FROM customer WHERE c_name REGEXP '[13579]$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[13579]$')")
_sql("filter_three_valued", "SELECT o_orderkey FROM orders WHERE NOT (nullif(o_orderstatus, 'P') = 'F' AND o_totalprice > 100000)")
_sql("case_forms", "SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS a, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS b, count(*) AS n FROM orders GROUP BY 1, 2, 3")
_sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
_sql("exists_uncorrelated", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 0)")


@_df("not_in_with_null", "SELECT r_regionkey FROM region WHERE r_regionkey NOT IN (1, 3)")
def _not_in(spark, sf_dir):
    return table(spark, sf_dir, "region").where(relational.not_in(F.col("r_regionkey"), [1, None, 3])).select("r_regionkey")


@_df("builder", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY c_mktsegment HAVING count(*) > 1 ORDER BY c_mktsegment DESC LIMIT 3")
def _builder(spark, sf_dir):
    b = select("count(*) AS n").from_(table(spark, sf_dir, "customer")).join(table(spark, sf_dir, "nation"), "c_nationkey = n_nationkey").where("c_acctbal > 0")
    return b.group_by("c_mktsegment").having("n > 1").order_by("-c_mktsegment").limit(3).build()


# windows

_sql("window_ranks", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS r, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS d FROM orders",
 "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS r, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS d FROM orders")
_sql("window_distribution", "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 9) AS p, round(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 9) AS q, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS t FROM customer")
_sql("window_lag_lead", "SELECT event_id, lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")
_sql("window_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders")
_sql("window_frames", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM events")
_sql("window_moving", "SELECT event_id, round(MOVING_SUM(3, value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS s, round(MOVING_AVG(3, value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS a FROM events",
 "SELECT event_id, round(coalesce(sum(value) OVER w, 0), 4) AS s, round(avg(value) OVER w, 4) AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
_sql("window_equal_interval", "SELECT c_custkey, EQUAL_INTERVAL(5) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS class FROM customer",
 "SELECT c_custkey, CAST(least(floor((c_acctbal - min(c_acctbal) OVER w) / ((max(c_acctbal) OVER w - min(c_acctbal) OVER w) / 5)), 4) + 1 AS INT) AS class FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")


# sort, limit, sets, recursion

_sql("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_sql("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7 OFFSET 5")
_sql("nulls_last", "SELECT k FROM (SELECT nullif(n_regionkey, 4) AS k, n_nationkey FROM nation) ORDER BY k DESC, n_nationkey LIMIT 22", "SELECT k FROM (SELECT nullif(n_regionkey, 4) AS k, n_nationkey FROM nation) ORDER BY k DESC NULLS LAST, n_nationkey LIMIT 22")
_sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("except_distinct", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
_sql("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql("set_left_to_right", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION SELECT n_nationkey FROM nation WHERE n_nationkey > 20 INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 2 ORDER BY k LIMIT 6",
 "SELECT * FROM ((SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION SELECT n_nationkey FROM nation WHERE n_nationkey > 20) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 2) ORDER BY k LIMIT 6")
_sql("cte_chain", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
_sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


@_df("recursive_union_distinct", "WITH RECURSIVE t(k) AS (SELECT 0 UNION SELECT (k * m + a) % 25 FROM t, (VALUES (2, 1), (1, 5)) v(m, a)) SELECT CAST(k AS BIGINT) AS k FROM t")
def _recursive(spark, sf_dir):
    folder = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    start = spark.range(1).select(F.col("id").alias("k"))
    return relational.recursive(start, lambda t: t.select(((F.col("k") * 2 + 1) % 25).alias("k")).union(t.select((F.col("k") + 5) % 25)), f"{folder}/quillspark")


# functions, one query for each family

_sql("fn_conditional", "SELECT c_custkey, IFNULL(nullif(c_mktsegment, 'BUILDING'), 'none') AS a, IIF(c_acctbal > 0, 'pos', 'neg') AS b, GREATEST(c_custkey, 100) AS g, LEAST(c_nationkey, 3) AS l, QUOTE(c_name) AS q, TYPEOF(c_acctbal) AS t FROM customer",
 "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS a, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS b, greatest(c_custkey, 100) AS g, least(c_nationkey, 3) AS l, '''' || replace(c_name, '''', '''''') || '''' AS q, 'real' AS t FROM customer")
_sql("fn_strings", "SELECT p_partkey, UPPER(p_name) AS u, LEFT(p_type, 3) AS l, RIGHT(p_type, 2) AS r, SUBSTR(p_brand, 2, 3) AS s, REPLACE(p_brand, '#', '-') AS x, INSTR(p_brand, '#') AS i, LPAD(p_brand, 12, '*') AS lp, RPAD(p_brand, 12, '*') AS rp, REVERSE(p_brand) AS v, SPLIT_PART(p_brand, '#', 2) AS sp, LEN(p_type) AS n, TRIM('  ' || p_brand || ' ') AS t, REPEAT('ab', 2) AS rr FROM part",
 "SELECT p_partkey, upper(p_name) AS u, left(p_type, 3) AS l, right(p_type, 2) AS r, substr(p_brand, 2, 3) AS s, replace(p_brand, '#', '-') AS x, CAST(instr(p_brand, '#') AS INT) AS i, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, reverse(p_brand) AS v, split_part(p_brand, '#', 2) AS sp, CAST(length(p_type) AS INT) AS n, trim('  ' || p_brand || ' ') AS t, 'abab' AS rr FROM part")
_sql("fn_text", "SELECT doc_id, TEXT_WORD_COUNT(text) AS w, TEXT_CHAR_COUNT(text) AS c, TEXT_TRUNCATE(text, 20) AS t, CONTAINS(text, 'the') AS h, STARTS_WITH(text, 'A') AS s, CONTAINS_ALL(text, 'THE', 'and') AS a, CONTAINS_SCORE(text, 'the', 'und') AS k FROM documents",
 r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INT) AS w, CAST(length(text) AS INT) AS c, CASE WHEN length(text) > 20 THEN left(text, 17) || '...' ELSE text END AS t, contains(text, 'the') AS h, starts_with(text, 'A') AS s, contains(lower(text), 'the') AND contains(lower(text), 'and') AS a, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'und') AS INT) AS k FROM documents")
_sql("fn_regexp", "SELECT p_partkey, REGEXP_MATCH(p_brand, '[0-9]1') AS m, REGEXP_EXTRACT(p_brand, '[0-9]+') AS e, REGEXP_REPLACE(p_brand, '[A-Za-z]+', 'X') AS r, LEVENSHTEIN(p_brand, 'Brand#11') AS d FROM part",
 "SELECT p_partkey, regexp_matches(p_brand, '[0-9]1') AS m, nullif(regexp_extract(p_brand, '[0-9]+'), '') AS e, regexp_replace(p_brand, '[A-Za-z]+', 'X', 'g') AS r, CAST(levenshtein(p_brand, 'Brand#11') AS INT) AS d FROM part")
_sql("fn_hash", "SELECT c_custkey, MD5(c_name) AS m, SHA256(c_name) AS s, HASH('sha1', c_name) AS h, HEX(c_name) AS x, UNHEX(HEX(c_name)) AS y, BASE64_ENCODE(c_name) AS b, BASE64_DECODE(BASE64_ENCODE(c_name)) AS d FROM customer",
 "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, sha1(c_name) AS h, hex(c_name) AS x, c_name AS y, base64(encode(c_name)) AS b, c_name AS d FROM customer")
_sql("fn_gzip", "SELECT r_regionkey, GUNZIP(GZIP(r_name)) AS name, HASH('fnv', 'a') AS same FROM region", "SELECT r_regionkey, r_name AS name, 'af63dc4c8601ec8c' AS same FROM region")
_sql("fn_math", "SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(c_acctbal, 1) AS r, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, TRUNC(c_acctbal) AS t, MOD(c_custkey, 7) AS m, SIGN(c_acctbal) AS s, round(SQRT(c_custkey), 9) AS q, round(LN(c_custkey + 1), 9) AS l, round(LOG10(c_custkey + 1), 9) AS l10, round(POW(c_nationkey, 2), 6) AS p, round(DEGREES(RADIANS(c_custkey)), 6) AS d FROM customer",
 "SELECT c_custkey, abs(c_acctbal) AS a, sign(c_acctbal) * floor(abs(c_acctbal) * 10 + 0.5) / 10 AS r, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, trunc(c_acctbal) AS t, CAST(c_custkey % 7 AS DOUBLE) AS m, CAST(sign(c_acctbal) AS INT) AS s, round(sqrt(c_custkey), 9) AS q, round(ln(c_custkey + 1), 9) AS l, round(log10(c_custkey + 1), 9) AS l10, round(pow(c_nationkey, 2), 6) AS p, round(degrees(radians(c_custkey)), 6) AS d FROM customer")
_sql("fn_trig", "SELECT n_nationkey, round(SIN(n_nationkey), 9) AS a, round(COS(n_nationkey), 9) AS b, round(TAN(n_nationkey), 9) AS c, round(ASIN(n_nationkey / 25.0D), 9) AS d, round(ACOS(n_nationkey / 25.0D), 9) AS e, round(ATAN2(n_nationkey, 2), 9) AS f, round(EXP(n_nationkey / 10.0D), 9) AS g, round(PI(), 9) AS h FROM nation",
 "SELECT n_nationkey, round(sin(n_nationkey), 9) AS a, round(cos(n_nationkey), 9) AS b, round(tan(n_nationkey), 9) AS c, round(asin(n_nationkey / 25.0), 9) AS d, round(acos(n_nationkey / 25.0), 9) AS e, round(atan2(n_nationkey, 2), 9) AS f, round(exp(n_nationkey / 10.0), 9) AS g, round(pi(), 9) AS h FROM nation")
_sql("fn_date_parts", "SELECT o_orderkey, YEAR(o_orderdate) AS y, QUARTER(o_orderdate) AS q, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, DAYOFWEEK(o_orderdate) AS w, DAYOFYEAR(o_orderdate) AS j, WEEKOFYEAR(o_orderdate) AS k, EXTRACT('DOW', o_orderdate) AS dow, STRFTIME('%Y/%m/%d', o_orderdate) AS s, UNIXEPOCH(o_orderdate) AS u, JULIANDAY(o_orderdate) AS jd FROM orders",
 "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(dayofweek(o_orderdate) + 1 AS INT) AS w, CAST(dayofyear(o_orderdate) AS INT) AS j, CAST(weekofyear(o_orderdate) AS INT) AS k, CAST(dayofweek(o_orderdate) AS DOUBLE) AS dow, strftime(o_orderdate, '%Y/%m/%d') AS s, CAST(epoch(o_orderdate) AS BIGINT) AS u, epoch(o_orderdate) / 86400.0 + 2440587.5 AS jd FROM orders")
_sql("fn_date_math", "SELECT o_orderkey, DATEDIFF('DAYS', o_orderdate, TIMESTAMP '1999-01-01') AS d, DATEDIFF('MONTHS', o_orderdate, TIMESTAMP '1999-01-01') AS m, DATE(DATE_ADD(o_orderdate, 3, 'DAY')) AS a, DATE(DATE_SUB(o_orderdate, 2, 'WEEK')) AS b, CAST(EOMONTH(o_orderdate) AS STRING) AS e, DATE(DATE_TRUNC('MONTH', o_orderdate)) AS t, OVERLAPS(o_orderdate, DATE_ADD(o_orderdate, 10, 'DAY'), TIMESTAMP '1995-01-05', TIMESTAMP '1995-01-10') AS o FROM orders",
 "SELECT o_orderkey, CAST((epoch_us(TIMESTAMP '1999-01-01') - epoch_us(o_orderdate)) // 86400000000 AS BIGINT) AS d, CAST((epoch_us(TIMESTAMP '1999-01-01') - epoch_us(o_orderdate)) // 2592000000000 AS BIGINT) AS m, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS a, strftime(o_orderdate - INTERVAL 14 DAY, '%Y-%m-%d') AS b, strftime(last_day(o_orderdate), '%Y-%m-%d') AS e, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS t, o_orderdate < TIMESTAMP '1995-01-10' AND TIMESTAMP '1995-01-05' < o_orderdate + INTERVAL 10 DAY AS o FROM orders")
_sql("fn_add_months", "SELECT DATE(ADD_MONTHS(TIMESTAMP '2024-01-31', n_nationkey)) AS d, n_nationkey FROM nation", "SELECT strftime(TIMESTAMP '2024-01-01' + to_months(n_nationkey) + INTERVAL 30 DAY, '%Y-%m-%d') AS d, n_nationkey FROM nation")
_sql("fn_arrays", "SELECT p_partkey, FIRST(SPLIT(p_name, ' ')) AS f, LAST(SPLIT(p_name, ' ')) AS l, ARRAY_LENGTH(SPLIT(p_name, ' ')) AS n, ARRAY_CONTAINS(SPLIT(p_name, ' '), 'Part') AS c, ARRAY_JOIN(ARRAY_SORT(ARRAY_DISTINCT(SPLIT(p_name, ' '))), '|') AS j FROM part",
 "SELECT p_partkey, string_split(p_name, ' ')[1] AS f, string_split(p_name, ' ')[-1] AS l, CAST(len(string_split(p_name, ' ')) AS INT) AS n, list_contains(string_split(p_name, ' '), 'Part') AS c, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '|') AS j FROM part")
_sql("fn_bitmap_blob", "SELECT n_nationkey, BITMAP_GET(BITMAP_SET('', n_nationkey), n_nationkey) AS g, BITMAP_COUNT(BITMAP_OR(BITMAP_SET('', n_nationkey), BITMAP_SET('', 3))) AS c, BITMAP_COUNT(BITMAP_AND(BITMAP_SET('', n_nationkey), BITMAP_SET('', 3))) AS a, BLOB_LENGTH('ff00') AS l, BLOB_HEX(n_name) AS h FROM nation",
 "SELECT n_nationkey, true AS g, CAST(CASE WHEN n_nationkey = 3 THEN 1 ELSE 2 END AS BIGINT) AS c, CAST(CASE WHEN n_nationkey = 3 THEN 1 ELSE 0 END AS BIGINT) AS a, 2 AS l, lower(hex(n_name)) AS h FROM nation")
_sql("fn_json_url", "SELECT event_id, JSON_GET(props, 'k') AS k, JSON_GET(URL_PARSE('http://h.org/p?q=' || event_id), 'query') AS q, URL_DECODE(URL_ENCODE('a b&' || event_id)) AS u, JSON_EXTRACT(props, 'none') AS z FROM events",
 "SELECT event_id, json_extract_string(props, '$.k') AS k, 'q=' || event_id AS q, 'a b&' || event_id AS u, CAST(NULL AS VARCHAR) AS z FROM events")
_VEC = "CAST(embedding AS DOUBLE[])"
_sql("fn_vectors", "SELECT vec_id, VEC_DIM(e) AS d, round(VEC_NORM(e), 6) AS n, round(VEC_DOT(e, e), 6) AS dd, round(VEC_COSINE_SIMILARITY(e, VEC_SCALE(e, 2.0D)), 6) AS c, round(VEC_L2_DISTANCE(e, VEC_SCALE(e, 2.0D)), 6) AS l, VEC_HAMMING_DISTANCE(e, VEC_SCALE(e, -1.0D)) AS h, round(VEC_NORM(VEC_NORMALIZE(e)), 6) AS u FROM (SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS e FROM embeddings)",
 f"SELECT vec_id, CAST(len(embedding) AS INT) AS d, round(sqrt(list_sum(list_transform({_VEC}, lambda x: x * x))), 6) AS n, round(list_sum(list_transform({_VEC}, lambda x: x * x)), 6) AS dd, 1.0::DOUBLE AS c, round(sqrt(list_sum(list_transform({_VEC}, lambda x: x * x))), 6) AS l, CAST(len(list_filter({_VEC}, lambda x: x <> 0)) AS INT) AS h, 1.0::DOUBLE AS u FROM embeddings")
_sql("fn_geo", "SELECT n_nationkey, round(HAVERSINE(0, 0, 0, n_nationkey), 3) AS d, GEO_LON(GEO_POINT(n_nationkey, 1)) AS x, GEO_WITHIN_BBOX(GEO_POINT(n_nationkey, 1), 0, 0, 10, 10) AS b, GEO_DWITHIN(GEO_POINT(0, 0), GEO_POINT(n_nationkey, 0), 1000000) AS w FROM nation",
 "SELECT n_nationkey, round(2 * 6371000 * asin(sin(radians(n_nationkey) / 2)), 3) AS d, CAST(n_nationkey AS DOUBLE) AS x, n_nationkey <= 10 AS b, 2 * 6371000 * asin(sin(radians(n_nationkey) / 2)) <= 1000000 AS w FROM nation")
_sql("fn_geo_shapes", "SELECT n_nationkey, GEO_WITHIN_POLYGON(GEO_POINT(n_nationkey + 0.5D, 0.5D), '{\"type\":\"Polygon\",\"coordinates\":[[[0,0],[10,0],[10,1],[0,1],[0,0]]]}') AS i, GEO_IS_VALID(GEO_ENVELOPE(GEO_POINT(n_nationkey, 1))) AS v FROM nation",
 "SELECT n_nationkey, n_nationkey < 10 AS i, true AS v FROM nation")
_sql("fn_tiles", "SELECT n_nationkey, TILE_X(n_nationkey * 10.0D - 120, 8) AS x, TILE_FLIP_Y(n_nationkey, 8) AS f, round(TILE_LON(n_nationkey, 5), 6) AS lon, TILE_QUADKEY(5, n_nationkey, n_nationkey) AS q, TILE_COUNT(3) AS c FROM nation",
 "SELECT n_nationkey, CAST(floor((n_nationkey * 10.0 - 120 + 180) / 360 * 256) AS BIGINT) AS x, CAST(255 - n_nationkey AS BIGINT) AS f, round(n_nationkey / 32.0 * 360 - 180, 6) AS lon, replace(replace(lpad(bin(n_nationkey), 5, '0'), '1', '3'), '', '') AS q, 64.0::DOUBLE AS c FROM nation")
ORACLE["fn_tiles"] = ORACLE["fn_tiles"].replace("replace(replace(lpad(bin(n_nationkey), 5, '0'), '1', '3'), '', '')", "replace(lpad(bin(n_nationkey), 5, '0'), '1', '3')")

# table functions and search

_QUERY = [round(((k * 37) % 19) / 19 - 0.5, 3) for k in range(64)]
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in _QUERY) + "]"
_COS = f"1 - list_sum(list_transform(list_zip({_VEC}, {_Q}), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform({_VEC}, lambda x: x * x))) * sqrt(list_sum(list_transform({_Q}, lambda x: x * x))))"


@_df("vec_search", f"SELECT vec_id, round(d, 6) AS distance, CAST(row_number() OVER (ORDER BY d, vec_id) AS BIGINT) AS place FROM (SELECT vec_id, {_COS} AS d FROM embeddings ORDER BY d, vec_id LIMIT 10)")
def _vec_search(spark, sf_dir):
    got = search.vec_search(table(spark, sf_dir, "embeddings"), "embedding", _QUERY, 10, key="vec_id")
    return got.select("vec_id", F.round("_vec_distance", 6).alias("distance"), F.col("_vec_rank").alias("place"))


@_df("text_chunks", r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
 c AS (SELECT doc_id, w, unnest(generate_series(0, CAST(greatest(ceil((len(w) - 50) / 40.0), 0) AS BIGINT))) AS k FROM d WHERE len(w) > 0)
 SELECT doc_id, CAST(k AS INT) AS chunk_index, array_to_string(list_slice(w, k * 40 + 1, k * 40 + 50), ' ') AS chunk_text, CAST(k * 40 AS INT) AS start_pos, CAST(least(k * 40 + 50, len(w)) AS INT) AS end_pos FROM c""")
def _chunks(spark, sf_dir):
    return search.text_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 50, 10).drop("text")


@_df("rag_context_from", "SELECT conv_id, turn FROM (SELECT DISTINCT c.conv_id, c.turn FROM conversations c JOIN conversations h ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1 WHERE h.turn % 4 = 2)")
def _context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    hits = c.where("turn % 4 = 2").select(F.col("conv_id").alias("d"), F.col("turn").alias("t"), F.lit(1).alias("r"))
    return search.rag_context_from(c, "conv_id", "turn", hits, "d", "t", 1, hit_rank="r").select("conv_id", "turn").distinct()


@_df("geo_search", f"SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS place FROM ({_PLACES}) WHERE lon BETWEEN -10 AND 10 AND lat BETWEEN -10 AND 10")
def _geo(spark, sf_dir):
    return search.geo_search(_places(spark, sf_dir), "lon", "lat", "bbox", -10.0, -10.0, 10.0, 10.0, key="event_id").select("event_id", F.col("_geo_rank").alias("place"))


@_df("table_from_json", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x'), (2, NULL)) t(a, b)")
def _from_json(spark, sf_dir):
    return search.table_from_json(spark, '[{"A": 1, "b": "x"}, {"a": 2}]')


# time

@_df("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _tumbling(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])


@_df("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def _sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])
