"""Queries on the dialect's own forms and on table functions called in SQL, with the SQL that says what they return."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fulltext
from ..operators import relational, search
from .catalog_queries import _COS, _QUERY, _df, _sql, table
from .function_queries import TOKENS
from .sql import Rewriter

# dialect

_sql("dialect_bare_columns", "SELECT o_custkey, o_custkey + 1, count(*) AS n, max(o_totalprice) IS NULL FROM orders GROUP BY o_custkey", "SELECT o_custkey, o_custkey + 1 AS col_1, count(*) AS n, false AS col_3 FROM orders GROUP BY o_custkey")
_sql("dialect_bare_value", "SELECT n_regionkey, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey", "SELECT n_regionkey, any_value(r_name) AS r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
_sql("dialect_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (1, NULL, 3) AND n_regionkey IN (0, NULL, 2)", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (1, 3) AND n_regionkey IN (0, 2)")
_sql("dialect_fetch", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey OFFSET 4 ROWS FETCH FIRST 6 ROWS ONLY", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 6 OFFSET 4")
_sql("dialect_first_value", "SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS f FROM events", "SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events")
_sql("dialect_pivot", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) PIVOT (max(o_totalprice) FOR o_orderstatus IN ('F' AS done, 'O' AS open))", "SELECT o_orderpriority, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS done, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY o_orderpriority")
_sql("dialect_like_escape", "SELECT n_name FROM nation WHERE n_name LIKE 'NATION!_1%' ESCAPE '!' AND n_name NOT ILIKE '%9'")
_sql("dialect_literals", "SELECT X'4142' AS b, 1.5e1D AS d, 'it''s' AS q, - - 3 AS m, TRUE AND NOT FALSE AS t FROM region", "SELECT 'AB'::BLOB AS b, 15.0::DOUBLE AS d, 'it''s' AS q, 3 AS m, true AS t FROM region")
_sql("dialect_concat_null", "SELECT n_name || NULL AS a, n_name || '-' || n_regionkey AS b FROM nation", "SELECT CAST(NULL AS VARCHAR) AS a, n_name || '-' || n_regionkey AS b FROM nation")
_sql("dialect_order_by_expression", "SELECT c_custkey, c_acctbal * -1 AS k FROM customer ORDER BY c_acctbal * -1, c_custkey LIMIT 5", "SELECT c_custkey, c_acctbal * -1 AS k FROM customer ORDER BY k, c_custkey LIMIT 5")
_sql("dialect_window_over_group", "SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY o_custkey", "SELECT o_custkey, n, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
_sql("dialect_in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_sql("dialect_join_table_theta", "SELECT s.s_suppkey, p.p_partkey FROM supplier s JOIN part p ON p.p_retailprice < s.s_acctbal / 10 AND p.p_size > 49")
_sql("dialect_sum_distinct", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY o_orderstatus HAVING sum(o_totalprice) > 0")

_sql("dialect_vec_avg", "SELECT label, round(element_at(VEC_AVG(embedding), 1), 6) AS a, round(element_at(VEC_AVG(embedding), 64), 6) AS z, VEC_DIM(VEC_AVG(embedding)) AS d FROM embeddings GROUP BY label", "SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS a, round(avg(CAST(embedding[64] AS DOUBLE)), 6) AS z, 64 AS d FROM embeddings GROUP BY label")
_sql("dialect_geo_bbox_agg", "SELECT n_regionkey, GEO_BBOX_AGG(GEO_POINT(n_nationkey * 2.0D, n_nationkey - 12.0D)) AS b FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, [min(n_nationkey * 2.0::DOUBLE), min(n_nationkey - 12.0::DOUBLE), max(n_nationkey * 2.0::DOUBLE), max(n_nationkey - 12.0::DOUBLE)] AS b FROM nation GROUP BY n_regionkey")
_sql("dialect_geo_centroid_agg", "SELECT n_regionkey, round(GEO_LON(GEO_CENTROID_AGG(GEO_POINT(n_nationkey, 2))), 6) AS x, round(GEO_LON(GEO_CENTROID_AGG(GEO_POINT(n_nationkey, 2), n_nationkey + 1)), 6) AS w FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, round(avg(n_nationkey), 6) AS x, round(sum(n_nationkey * (n_nationkey + 1.0)) / sum(n_nationkey + 1.0), 6) AS w FROM nation GROUP BY n_regionkey")


@_df("equal_interval_classes", "SELECT c_custkey, CAST(least(floor((c_acctbal - min(c_acctbal) OVER w) / ((max(c_acctbal) OVER w - min(c_acctbal) OVER w) / 5)), 4) + 1 AS INT) AS class FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def _equal(spark, sf_dir):
    return relational.equal_interval(table(spark, sf_dir, "customer"), 5, "c_acctbal", ["c_mktsegment"]).select("c_custkey", "class")


_BREAKS = """WITH v AS (SELECT s_nationkey, list_sort(list_distinct(list(s_acctbal))) AS d, list(s_acctbal) AS every FROM supplier GROUP BY s_nationkey),
 c AS (SELECT s_nationkey, d, every, i, unnest(CASE WHEN len(d) >= 3 THEN generate_series(i + 1, len(d) - 1) ELSE [0] END) AS j FROM (SELECT s_nationkey, d, every, unnest(CASE WHEN len(d) >= 3 THEN generate_series(1, len(d) - 2) ELSE [0] END) AS i FROM v)),
 g AS (SELECT s_nationkey, d, i, j, [list_filter(every, lambda x: x <= d[i]), list_filter(every, lambda x: x > d[i] AND x <= d[j]), list_filter(every, lambda x: x > d[j])] AS parts FROM c),
 k AS (SELECT s_nationkey, d, i, j, list_sum(list_transform(parts, lambda p: list_sum(list_transform(p, lambda x: (x - list_avg(p)) * (x - list_avg(p)))))) AS cost FROM g),
 b AS (SELECT s_nationkey, arg_min(CASE WHEN len(d) >= 3 THEN [d[i], d[j]] ELSE d[1 : len(d) - 1] END, coalesce(cost, 0)) AS bounds FROM k GROUP BY s_nationkey)
 SELECT s_suppkey, s_nationkey, CAST(len(list_filter(bounds, lambda x: x < s_acctbal)) + 1 AS INT) AS class FROM supplier JOIN b USING (s_nationkey)"""


@_df("window_natural_breaks", _BREAKS)
def _breaks(spark, sf_dir):
    return relational.natural_breaks(table(spark, sf_dir, "supplier"), 3, "s_acctbal", ["s_nationkey"]).select("s_suppkey", "s_nationkey", "class")


_sql("dialect_natural_breaks", "SELECT s_suppkey, s_nationkey, NATURAL_BREAKS(3) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS class FROM supplier", _BREAKS)

# search


def _bm25(query: str, k: int) -> str:
    """DuckDB SQL for the OR of a query's words over documents: doc_id, score, place."""
    terms = sorted(set(fulltext.tokens(query)))
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""t AS ({TOKENS}), n AS (SELECT doc_id, count(*) AS len FROM t GROUP BY doc_id),
 a AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(len) FROM n) / (SELECT count(*) FROM documents) AS avglen),
 f AS (SELECT doc_id, t, count(*) AS tf FROM t WHERE t IN ({listed}) GROUP BY doc_id, t), df AS (SELECT t, count(*) AS df FROM f GROUP BY t),
 s AS (SELECT doc_id, max(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))) AS score FROM f JOIN df USING (t) JOIN n USING (doc_id), a GROUP BY doc_id),
 fts AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM s ORDER BY score DESC, doc_id LIMIT {k})"""


@_df("fts_search", f"WITH {_bm25('thing that und', 10)} SELECT doc_id, round(score, 6) AS score, place FROM fts")
def _fts(spark, sf_dir):
    return search.fts_search(table(spark, sf_dir, "documents"), "thing OR that OR und", 10, ["text"], "doc_id").select("doc_id", F.round("_fts_score", 6).alias("score"), F.col("_fts_rank").alias("place"))


@_df("fts_search_boolean", f"""WITH t AS ({TOKENS}), x AS (SELECT doc_id, count(*) FILTER (WHERE t = 'that') AS a, count(*) FILTER (WHERE t = 'und') AS u, count(*) FILTER (WHERE t LIKE 'ther%') AS h, count(*) AS len FROM t GROUP BY doc_id),
 p AS (SELECT DISTINCT x.doc_id FROM t x JOIN t y ON x.doc_id = y.doc_id AND y.p = x.p + 1 WHERE x.t = 'that' AND y.t = 'this')
 SELECT doc_id FROM x WHERE ((a > 0 AND h > 0) OR doc_id IN (SELECT doc_id FROM p)) AND NOT u > 0""")
def _fts_boolean(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search.fts_search(docs, '((that AND ther*) OR "that this") AND NOT und', docs.count(), ["text"], "doc_id").select("doc_id")


_RRF = f"""WITH d AS (SELECT doc_id, text FROM documents JOIN embeddings ON doc_id = vec_id),
 v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY d, vec_id) AS vp FROM (SELECT vec_id, {_COS} AS d FROM embeddings JOIN documents ON doc_id = vec_id) ORDER BY d, vec_id LIMIT 20), {_bm25('thing that', 20).replace('FROM documents', 'FROM d')}
 SELECT doc_id, round(score, 8) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM (SELECT coalesce(v.doc_id, fts.doc_id) AS doc_id, coalesce(1 / (60 + vp), 0) + coalesce(1 / (60 + place), 0) AS score FROM v FULL JOIN fts ON v.doc_id = fts.doc_id) ORDER BY score DESC, doc_id LIMIT 5"""


@_df("hybrid_search", _RRF)
def _hybrid(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return search.hybrid_search(both, "embedding", ["text"], _QUERY, "which thing is that", 5, "doc_id").select("doc_id", F.round("_rrf_score", 8).alias("score"), F.col("_rrf_rank").alias("place"))


@_df("vec_search_ivf", f"SELECT vec_id, round(d, 6) AS distance, CAST(row_number() OVER (ORDER BY d, vec_id) AS BIGINT) AS place FROM (SELECT vec_id, {_COS} AS d FROM embeddings ORDER BY d, vec_id LIMIT 10)")
def _ivf(spark, sf_dir):
    """All lists are gone through here, so the exact rows come back; tests measure the recall of fewer."""
    index = search.IVFIndex(table(spark, sf_dir, "embeddings"), "embedding")
    return index.search(_QUERY, 10, probes=len(index.centroids), key="vec_id").select("vec_id", F.round("_vec_distance", 6).alias("distance"), F.col("_vec_rank").alias("place"))


def _metric_query(name: str, metric: str, oracle: str) -> None:
    @_df(f"vec_search_{name}", f"SELECT vec_id, round(d, 6) AS distance, CAST(row_number() OVER (ORDER BY d, vec_id) AS BIGINT) AS place FROM (SELECT vec_id, {oracle} AS d FROM embeddings ORDER BY d, vec_id LIMIT 10)")
    def _run(spark, sf_dir):
        got = search.vec_search(table(spark, sf_dir, "embeddings"), "embedding", _QUERY, 10, metric, key="vec_id")
        return got.select("vec_id", F.round("_vec_distance", 6).alias("distance"), F.col("_vec_rank").alias("place"))


_ZIP = "list_zip(CAST(embedding AS DOUBLE[]), [" + ", ".join(f"{x}::DOUBLE" for x in _QUERY) + "])"
_metric_query("l2", "l2", f"sqrt(list_sum(list_transform({_ZIP}, lambda z: (z[1] - z[2]) * (z[1] - z[2]))))")
_metric_query("manhattan", "manhattan", f"list_sum(list_transform({_ZIP}, lambda z: abs(z[1] - z[2])))")
_metric_query("dot", "dot", f"-list_sum(list_transform({_ZIP}, lambda z: z[1] * z[2]))")

# table functions in SQL

_Q = "'" + str(_QUERY) + "'"
_TOP = f"SELECT vec_id, label, round(d, 6) AS distance FROM (SELECT vec_id, label, {_COS} AS d FROM embeddings ORDER BY d, vec_id LIMIT 6)"
_sql("tf_vec_search", f"SELECT v.vec_id, v.label, round(v._vec_distance, 6) AS distance FROM VEC_SEARCH('embeddings', 'embedding', VEC_FROM_JSON({_Q}), 6) v", _TOP)
_sql("tf_vec_top_k", f"SELECT vec_id, label, round(_vec_distance, 6) AS distance FROM VEC_TOP_K('embeddings', 'embedding', {_Q}, 6, 'cosine', 'flat')", _TOP)
_sql("tf_vec_search_hnsw", f"SELECT vec_id, label, round(_vec_distance, 6) AS distance FROM VEC_SEARCH('embeddings', 'embedding', {_Q}, 6, 'cosine', 'hnsw')", _TOP)
_sql("tf_vec_warm", "SELECT table_name, column_name, metric, index_mode, row_count, vector_count, dims, distinct_dims, excluded_rows FROM VEC_WARM('embeddings', 'embedding', 'l2')", "SELECT 'embeddings' AS table_name, 'embedding' AS column_name, 'l2' AS metric, 'flat' AS index_mode, count(*) AS row_count, count(embedding) AS vector_count, CAST(max(len(embedding)) AS INT) AS dims, CAST(count(DISTINCT len(embedding)) AS BIGINT) AS distinct_dims, CAST(0 AS BIGINT) AS excluded_rows FROM embeddings")
_sql("tf_fts_search", "SELECT f.doc_id, round(f._fts_score, 6) AS score, f._fts_rank AS place FROM FTS_SEARCH('documents', 'that OR thing', 7, 'text') f JOIN documents d ON d.doc_id = f.doc_id", f"WITH {_bm25('that thing', 7)} SELECT doc_id, round(score, 6) AS score, place FROM fts")
_sql("tf_text_chunks", "SELECT chunk_index, chunk_text, start_pos, end_pos FROM TEXT_CHUNKS('a b c d e f g', 3, 1) UNION ALL SELECT chunk_index, chunk_text, start_pos, end_pos FROM TEXT_CHUNKS('abcdefg', 4, 2, 'chars')", "SELECT * FROM (VALUES (0, 'a b c', 0, 3), (1, 'c d e', 2, 5), (2, 'e f g', 4, 7), (0, 'abcd', 0, 4), (1, 'cdef', 2, 6), (2, 'efg', 4, 7)) t(chunk_index, chunk_text, start_pos, end_pos)")
_sql("tf_rag_context", "SELECT conv_id, turn FROM RAG_CONTEXT('conversations', 'conv_id', 'turn', 5, 2, 1, 2)", "SELECT conv_id, turn FROM conversations WHERE conv_id = 5 AND turn BETWEEN 1 AND 4")
_sql("tf_table_from", "SELECT j.a AS a, j.b AS b, c.x AS x FROM TABLE_FROM_JSON('[{\"A\": 1, \"b\": \"p\"}, {\"A\": 2, \"b\": \"q\"}]') j JOIN TABLE_FROM_CSV('k,x\n1,one\n2,two') c ON j.a = c.k", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'p', 'one'), (2, 'q', 'two')) t(a, b, x)")
_sql("tf_table_from_lines", "SELECT a, b FROM TABLE_FROM_JSON_LINES('{\"a\": 1, \"b\": true}\n{\"a\": 2}')", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), true), (2, NULL)) t(a, b)")
_sql("tf_table_from_xml", "SELECT id, name FROM TABLE_FROM_XML('<r><p id=\"1\"><name>x</name></p><p id=\"2\"><name>y</name></p></r>', 'p')", "SELECT * FROM (VALUES ('1', 'x'), ('2', 'y')) t(id, name)")


@_df("tf_rag_search", f"{_RRF.replace('SELECT doc_id, round(score, 8) AS score, row_number()', 'SELECT doc_id, round(score, 8) AS score, row_number()')}")
def _rag_search(spark, sf_dir):
    table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id")).createOrReplaceTempView("rag_docs")
    options = '{"text_columns": ["text"], "text_query": "which thing is that", "key_columns": ["doc_id"]}'
    return spark.sql(Rewriter(spark).statement(f"SELECT doc_id, round(_rrf_score, 8) AS score, _rrf_rank AS place FROM RAG_SEARCH('rag_docs', 'embedding', {_Q}, 5, '{options}')"))


@_df("tf_rag_context_from", "WITH h AS (SELECT conv_id AS d, turn AS t, row_number() OVER (ORDER BY conv_id, turn) AS rank FROM conversations WHERE turn % 4 = 2), m AS (SELECT c.conv_id, c.turn, rank, c.turn - t AS off FROM conversations c JOIN h ON c.conv_id = d AND c.turn BETWEEN t - 1 AND t + 1), b AS (SELECT conv_id, turn, count(*) AS hits, arg_min(struct_pack(r := rank, o := off), struct_pack(r := rank, a := abs(off), o := off)) AS best FROM m GROUP BY conv_id, turn) SELECT conv_id, turn, CAST(best.r AS BIGINT) AS hit_rank, CAST(best.o AS BIGINT) AS off, hits, row_number() OVER (ORDER BY best.r, conv_id, turn) AS place FROM b")
def _context_from(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    spark.sql("SELECT conv_id AS d, turn AS t, row_number() OVER (ORDER BY conv_id, turn) AS rank FROM conversations WHERE turn % 4 = 2").createOrReplaceTempView("rag_hits")
    return spark.sql(Rewriter(spark).statement("SELECT conv_id, turn, _hit_rank AS hit_rank, _context_offset AS off, _context_hits AS hits, _context_rank AS place FROM RAG_CONTEXT_FROM('conversations', 'conv_id', 'turn', 'rag_hits', 'd', 't', 1)"))


@_df("tf_geo_search", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS place FROM nation WHERE 2 * 6371000 * asin(sin(radians(n_nationkey) / 2)) <= 900000")
def _geo(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    rewriter = Rewriter(spark)
    spark.sql(rewriter.statement("SELECT n_nationkey, GEO_POINT(n_nationkey, 0) AS geom FROM nation")).createOrReplaceTempView("geo_places")
    return spark.sql(rewriter.statement("SELECT n_nationkey, _geo_rank AS place FROM GEO_SEARCH('geo_places', 'geom', 'radius', 0, 0, 900000)"))
