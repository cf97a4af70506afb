"""Queries that call the scalar functions family by family, with the SQL that says what they return."""

from __future__ import annotations

from .catalog_queries import _sql

_NOW = "TIMESTAMP '1997-05-17 10:00:00'"

# text

_sql("fn_strings_more", "SELECT c_custkey, ISNULL(nullif(c_mktsegment, 'BUILDING')) AS a, LTRIM('  x ' || c_name) AS lt, RTRIM(' ' || c_name || ' ') AS rt, LTRIM(c_mktsegment, 'BUMA') AS lc, RTRIM(c_mktsegment, 'YGND') AS rc, CONCAT(c_name, NULL, c_mktsegment) AS cc, CONCAT_WS('-', c_name, NULL, c_mktsegment) AS cw, LOCATE('1', c_name) AS lo, POSITION('1' IN c_name) AS po, PRINTF('%v|%d|%.2f', c_name, c_custkey, c_acctbal) AS pf, SPACE(3) AS sp, ASCII(c_mktsegment) AS code, ENDS_WITH(c_name, '7') AS en, CONTAINS_ANY(c_mktsegment, 'build', 'MACH') AS ca FROM customer",
 "SELECT c_custkey, c_mktsegment = 'BUILDING' AS a, 'x ' || c_name AS lt, ' ' || c_name AS rt, ltrim(c_mktsegment, 'BUMA') AS lc, rtrim(c_mktsegment, 'YGND') AS rc, c_name || c_mktsegment AS cc, c_name || '-' || c_mktsegment AS cw, CAST(instr(c_name, '1') AS INT) AS lo, CAST(instr(c_name, '1') AS INT) AS po, printf('%s|%d|%.2f', c_name, c_custkey, c_acctbal) AS pf, '   ' AS sp, CAST(ascii(c_mktsegment) AS INT) AS code, c_name LIKE '%7' AS en, c_mktsegment LIKE '%BUILD%' OR c_mktsegment LIKE '%MACH%' AS ca FROM customer")
_sql("fn_strings_fixed", "SELECT n_nationkey, CHAR(65 + n_nationkey) AS c, CHR(200) AS none, INITCAP('  hello   wide ' || lower(n_name)) AS i, SOUNDEX('Robert') AS s1, SOUNDEX('Ashcraft') AS s2, SOUNDEX('') AS s3, SHA512('abc') AS h, ROUND(LOG(2, pow(2, n_nationkey + 1)), 9) AS lg, ROUND(LOG(n_nationkey + 1), 9) AS ln1, ROUND(LOG2(n_nationkey + 1), 9) AS l2, ROUND(ATAN(n_nationkey), 9) AS at, RANDOM() BETWEEN 0 AND 1 AS r, LENGTH(UUID()) AS u, VERSION() LIKE 'quill%' AS v FROM nation",
 "SELECT n_nationkey, chr(65 + n_nationkey) AS c, '' AS none, 'Hello Wide Nation_' || n_nationkey AS i, 'R163' AS s1, 'A226' AS s2, '' AS s3, 'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f' AS h, CAST(n_nationkey + 1 AS DOUBLE) AS lg, round(ln(n_nationkey + 1), 9) AS ln1, round(log2(n_nationkey + 1), 9) AS l2, round(atan(n_nationkey), 9) AS at, true AS r, 36 AS u, true AS v FROM nation")
_sql("fn_row_to_text", "SELECT ROW_TO_TEXT() AS t FROM nation", "SELECT n_name || ' ' || n_nationkey || ' ' || n_regionkey AS t FROM nation")
_sql("fn_json_yaml", "SELECT event_id, JSON_GET(JSON_SET(props, 'k', event_id), 'k') AS k, JSON_GET(JSON_SET(props, 'a.b', 'x'), 'a.b') AS n, JSON_GET('{\"l\":[1,{\"m\":5}]}', 'l.1.m') AS m, YAML_GET('name: n' || event_id || chr(10) || 'size: 3', 'name') AS y, YAML_GET('name: x', 'none') AS z, YAML_PARSE(' a: ' || event_id || ' ') AS p, JSON_GET(URL_PARSE('http://h' || event_id || '.org:8080/p/q?a=1#f'), 'path') AS u, JSON_GET(URL_PARSE('https://h.org/p#frag'), 'fragment') AS f, JSON_GET(URL_PARSE('https://h.org/p#frag'), 'scheme') AS s FROM events",
 "SELECT event_id, CAST(event_id AS VARCHAR) AS k, 'x' AS n, '5' AS m, 'n' || event_id AS y, CAST(NULL AS VARCHAR) AS z, 'a: ' || event_id AS p, '/p/q' AS u, 'frag' AS f, 'https' AS s FROM events")
_sql("fn_blobs", "SELECT n_nationkey, BITMAP_NEW() AS b, BITMAP_SET(BITMAP_NEW(), n_nationkey) AS bs, HEX(BLOB_FROM_HEX(HEX(n_name))) AS fh, BLOB_SUBSTR(HEX(n_name), 2, 3) AS su, BLOB_CONCAT('ff', HEX(n_name)) AS co, BLOB_TO_BASE64(HEX(n_name)) AS tb, HEX(BLOB_FROM_BASE64(BASE64_ENCODE(n_name))) AS fb, BLOB_EQUAL(HEX(n_name), lower(HEX('NATION_3'))) AS eq, HASH('fnv', 'a') AS f1, HASH('fnv', '') AS f2, HASH('sha512', n_name) = SHA512(n_name) AS h5 FROM nation",
 "SELECT n_nationkey, '' AS b, repeat('00', n_nationkey // 8) || lower(lpad(hex(1 << (n_nationkey % 8)), 2, '0')) AS bs, hex(n_name) AS fh, lower(hex(substr(n_name, 3, 3))) AS su, 'ff' || lower(hex(n_name)) AS co, base64(encode(n_name)) AS tb, hex(n_name) AS fb, n_name = 'NATION_3' AS eq, 'af63dc4c8601ec8c' AS f1, 'cbf29ce484222325' AS f2, true AS h5 FROM nation")

# time

_sql("fn_time_parts", "SELECT event_id, HOUR(ts) AS h, MINUTE(ts) AS m, SECOND(ts) AS s, TIME(ts) AS t, DATETIME(ts) AS d, TIMESTAMP(ts) AS e, DATETIME(FROM_TIMESTAMP(event_id * 60.5D)) AS f, STRFTIME('%H:%M:%S %j %w %s %%', ts) AS x, EXTRACT('WEEK', ts) AS w, EXTRACT('EPOCH', ts) AS ep FROM events",
 "SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS m, CAST(second(ts) AS INT) AS s, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS d, CAST(floor(epoch(ts)) AS BIGINT) AS e, strftime(make_timestamp(CAST(event_id * 60500000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS f, strftime(ts, '%H:%M:%S %j %w ') || CAST(floor(epoch(ts)) AS BIGINT) || ' %' AS x, CAST(weekofyear(ts) AS DOUBLE) AS w, CAST(floor(epoch(ts)) AS DOUBLE) AS ep FROM events")
_sql("fn_now", "SELECT NOW() >= TIMESTAMP '2020-01-01' AS a, GETDATE() = CURRENT_TIMESTAMP() AS b, DATEDIFF('DAY', TODAY(), NOW()) AS c, CAST(CURRENT_DATE() AS STRING) = DATE(TODAY()) AS d, LENGTH(CURRENT_TIME()) AS e, IN_PERIOD('TODAY', NOW()) AS f, DATE() = DATE(NOW()) AS g, JULIANDAY() > 2459000 AS h, UNIXEPOCH() > 1600000000 AS i",
 "SELECT true AS a, true AS b, CAST(0 AS BIGINT) AS c, true AS d, 8 AS e, true AS f, true AS g, true AS h, true AS i")
_sql("fn_in_period", f"SELECT o_orderkey, IN_PERIOD('YTD', o_orderdate, {_NOW}) AS a, IN_PERIOD('MTD', o_orderdate, {_NOW}) AS b, IN_PERIOD('QTD', o_orderdate, {_NOW}) AS c, IN_PERIOD('L12M', o_orderdate, {_NOW}) AS d, IN_PERIOD('PREVIOUS_12_MONTHS', o_orderdate, {_NOW}) AS e, IN_PERIOD('CURRENT_QUARTER', o_orderdate, {_NOW}) AS f, IN_PERIOD('PREVIOUS_QUARTER', o_orderdate, {_NOW}) AS g, IN_PERIOD('NEXT_QUARTER', o_orderdate, {_NOW}) AS h, IN_PERIOD('CURRENT_YEAR_FULL', o_orderdate, {_NOW}) AS i, IN_PERIOD('LAST_YEAR_FULL', o_orderdate, {_NOW}) AS j, IN_PERIOD('TODAY', o_orderdate, {_NOW}) AS k FROM orders",
 f"SELECT o_orderkey, o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= {_NOW} AS a, o_orderdate >= TIMESTAMP '1997-05-01' AND o_orderdate <= {_NOW} AS b, o_orderdate >= TIMESTAMP '1997-04-01' AND o_orderdate <= {_NOW} AS c, o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < {_NOW} AS d, o_orderdate >= TIMESTAMP '1996-05-01' AND o_orderdate < TIMESTAMP '1997-05-01' AS e, o_orderdate >= TIMESTAMP '1997-04-01' AND o_orderdate < TIMESTAMP '1997-07-01' AS f, o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01' AS g, o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01' AS h, year(o_orderdate) = 1997 AS i, year(o_orderdate) = 1996 AS j, CAST(o_orderdate AS DATE) = DATE '1997-05-17' AS k FROM orders".replace("'1996-01-01' AND o_orderdate < TIMESTAMP '1997-05-17 10:00:00' AS d", "'1996-05-01' AND o_orderdate < TIMESTAMP '1997-05-17 10:00:00' AS d"))
_sql("fn_range_merge", "SELECT n_nationkey, CAST(RANGE_MERGE(array(array(5D, 8D), array(1D, CAST(n_nationkey AS DOUBLE)), array(8D, 9D))) AS STRING) AS r FROM nation WHERE n_nationkey > 0",
 "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN '[[1.0, ' || n_nationkey || '.0], [5.0, 9.0]]' ELSE '[[1.0, ' || greatest(n_nationkey, 9) || '.0]]' END AS r FROM nation WHERE n_nationkey > 0")
_sql("fn_recency", "SELECT event_id, round(RECENCY_SCORE(ts, 30, TIMESTAMP '2024-06-01'), 9) AS r, round(RAG_HYBRID_SCORE(value / 1000, ts, 30, 0.6, TIMESTAMP '2024-06-01'), 9) AS h, round(RAG_RANK_SCORE(value / 1000, ts, 30, 0.5, 0.5, 0.3, 0.4, TIMESTAMP '2024-06-01'), 9) AS k, RECENCY_SCORE(ts, 30, TIMESTAMP '2000-01-01') AS one FROM events",
 "WITH e AS (SELECT event_id, value / 1000 AS sim, exp(-ln(2) * (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(ts)) / 8.64e10 / 30) AS x FROM events) SELECT event_id, round(x, 9) AS r, round(0.6 * (sim + 1) / 2 + 0.4 * x, 9) AS h, round((0.5 * (sim + 1) / 2 + 0.3 * x + 0.2) / 1.2, 9) AS k, 1.0::DOUBLE AS one FROM e")

# full text

_STOP = "('a', 'an', 'the', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'is', 'was', 'are', 'be', 'it', 'as')"
_CUT = "CASE " + " ".join(f"WHEN w LIKE '%{s}' AND length(w) > {len(s) + 3} THEN left(w, length(w) - {len(s)})" for s in ("ing", "tion", "ed", "ly", "er", "est", "s")) + " ELSE w END"
TOKENS = f"SELECT doc_id, p, {_CUT} AS t FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 1 AND x NOT IN {_STOP}) AS w FROM documents))"
_sql("fn_fts", "SELECT doc_id, FTS_WORD_COUNT(text) AS n, FTS_MATCH(text, 'the OR und') AS m, FTS_MATCH(text, 'ther* AND NOT zzz') AS p, round(FTS_RANK(text, 'that'), 6) AS r, round(FTS_RANK(text, 'that OR und'), 6) AS o, FTS_MATCH(text, '\"that ther\"') AS ph FROM documents",
 f"""WITH t AS ({TOKENS}), c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE t = 'und') AS u, count(*) FILTER (WHERE t = 'that') AS a, count(*) FILTER (WHERE t LIKE 'ther%') AS h FROM t GROUP BY doc_id),
 ph AS (SELECT DISTINCT x.doc_id FROM t x JOIN (SELECT doc_id, t, p FROM t) y ON x.doc_id = y.doc_id AND y.p = x.p + 1 WHERE x.t = 'that' AND y.t = 'ther')
 SELECT d.doc_id, CAST(coalesce(n, 0) AS INT) AS n, coalesce(u, 0) > 0 AS m, coalesce(h, 0) > 0 AS p, round(coalesce(CASE WHEN a > 0 THEN a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / 100)) END, 0), 6) AS r,
  round(coalesce(greatest(a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / 100)), u * 2.2 / (u + 1.2 * (0.25 + 0.75 * n / 100))), 0), 6) AS o, ph.doc_id IS NOT NULL AS ph FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN ph USING (doc_id)""")
_sql("fn_fts_snippet", "SELECT n_nationkey, FTS_SNIPPET('the quick brown ' || n_name || ' jumps', 'brown', '<em>', '</em>', '', 10) AS s, FTS_HIGHLIGHT('a fox and ' || n_name || ' foxes', 'fox') AS h FROM nation",
 "SELECT n_nationkey, 'the quick <em>brown</em> ' || n_name || ' jumps' AS s, 'a <b>fox</b> and ' || n_name || ' foxes' AS h FROM nation")

# vectors

_V, _R = "CAST(embedding AS DOUBLE[])", "list_reverse(CAST(embedding AS DOUBLE[]))"
_E = "(SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS e, reverse(CAST(embedding AS ARRAY<DOUBLE>)) AS r FROM embeddings)"
_DOT = "list_sum(list_transform(list_zip(e, r), lambda z: z[1] * z[2]))"
_SS = "list_sum(list_transform(e, lambda x: x * x))"
_sql("fn_vectors_pairs", f"SELECT vec_id, round(VEC_COSINE_DISTANCE(e, r), 6) AS cd, round(VEC_MANHATTAN_DISTANCE(e, r), 6) AS l1, round(VEC_DISTANCE(e, r, 'dot'), 6) AS dd, round(VEC_DISTANCE(e, r), 6) AS dc, round(VEC_DISTANCE(e, r, 'l2'), 6) AS dl, round(VEC_DISTANCE(e, r, 'manhattan'), 6) AS dm, round(VEC_MIN_DISTANCE(e, r, VEC_SCALE(e, 3)), 6) AS md, round(VEC_INNER_PRODUCT(e, r), 6) AS ip, VEC_HAMMING_DISTANCE(e, r) AS hd FROM {_E}",
 f"SELECT vec_id, round(1 - {_DOT} / {_SS}, 6) AS cd, round(list_sum(list_transform(list_zip(e, r), lambda z: abs(z[1] - z[2]))), 6) AS l1, round(-{_DOT}, 6) AS dd, round(1 - {_DOT} / {_SS}, 6) AS dc, round(sqrt(list_sum(list_transform(list_zip(e, r), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS dl, round(list_sum(list_transform(list_zip(e, r), lambda z: abs(z[1] - z[2]))), 6) AS dm, 0.0::DOUBLE AS md, round({_DOT}, 6) AS ip, CAST(len(list_filter(list_zip(e, r), lambda z: (z[1] > 0) <> (z[2] > 0))) AS INT) AS hd FROM (SELECT vec_id, {_V} AS e, {_R} AS r FROM embeddings)")
_sql("fn_vectors_make", f"SELECT vec_id, round(element_at(VEC_ADD(e, r), 1), 6) AS a, round(element_at(VEC_SUB(e, r), 1), 6) AS s, round(element_at(VEC_MUL(e, r), 1), 6) AS m, round(element_at(VEC_AVG(e, r), 2), 6) AS av, round(element_at(VEC_CENTROID(e, r, r), 3), 6) AS ce, round(element_at(VEC_SLICE(e, 2, 3), 1), 6) AS sl, VEC_DIM(VEC_SLICE(e, 2, 3)) AS sd, VEC_DIM(VEC_CONCAT(e, r)) AS cc, VEC_TO_JSON(VEC_BINARY_QUANTIZE(VEC_SLICE(e, 0, 3))) AS bq, VEC_DIM(VEC_FROM_JSON(VEC_TO_JSON(e))) AS fj, VEC_TO_BYTES(VEC_FROM_JSON('[1, 2.5]')) AS tb, round(VEC_L2_DISTANCE(VEC_FROM_BYTES(VEC_TO_BYTES(e)), e), 6) AS fb, round(VEC_NORM(VEC_RANDOM(8, vec_id)), 6) AS rn, VEC_DIM(VEC_RANDOM(8, vec_id)) AS rd, round(element_at(VEC_QUANTIZE(e, 8), 5), 6) AS q FROM {_E}",
 f"""SELECT vec_id, round(e[1] + r[1], 6) AS a, round(e[1] - r[1], 6) AS s, round(e[1] * r[1], 6) AS m, round((e[2] + r[2]) / 2, 6) AS av, round((e[3] + 2 * r[3]) / 3, 6) AS ce, round(e[3], 6) AS sl, 3 AS sd, CAST(2 * len(e) AS INT) AS cc, '[' || CASE WHEN e[1] > 0 THEN '1.0' ELSE '0.0' END || ',' || CASE WHEN e[2] > 0 THEN '1.0' ELSE '0.0' END || ',' || CASE WHEN e[3] > 0 THEN '1.0' ELSE '0.0' END || ']' AS bq, CAST(len(e) AS INT) AS fj, '0000803f00002040' AS tb, 0.0::DOUBLE AS fb, 1.0::DOUBLE AS rn, 8 AS rd,
 round(round((e[5] - list_min(e)) / (list_max(e) - list_min(e)) * 255) / 255 * (list_max(e) - list_min(e)) + list_min(e), 6) AS q FROM (SELECT vec_id, {_V} AS e, {_R} AS r FROM embeddings)""")

# places and shapes

_P = "GEO_POINT(n_nationkey * 5.0D - 60, n_nationkey * 2.0D - 20)"
_LON1, _LAT1 = "radians(n_nationkey * 5.0 - 60)", "radians(n_nationkey * 2.0 - 20)"
_sql("fn_geo_points", f"SELECT n_nationkey, GEO_LAT({_P}) AS lat, ST_Y({_P}) AS y, round(GEO_BEARING({_P}, GEO_POINT(10, 10)), 6) AS b, round(GEO_LON(GEO_DESTINATION({_P}, 90, 100000)), 6) AS dx, round(GEO_LAT(GEO_DESTINATION({_P}, 0, 100000)), 6) AS dy, round(GEO_LAT(GEO_MIDPOINT(GEO_POINT(0, 0), GEO_POINT(n_nationkey, 0))), 6) AS my, round(GEO_LON(GEO_MIDPOINT(GEO_POINT(0, 0), GEO_POINT(n_nationkey, 0))), 6) AS mx, round(ST_DISTANCE(GEO_POINT(0, 0), GEO_POINT(0, n_nationkey)), 3) AS sd, GEO_LON(GEO_SNAP(GEO_POINT(n_nationkey + 0.4D, 0.6D), 1)) AS sn, round(GEO_LENGTH('{{\"type\":\"LineString\",\"coordinates\":[[0,0],[1,0],[3,0]]}}'), 3) AS le, GEO_LON(GEO_LINE_INTERPOLATE('{{\"type\":\"LineString\",\"coordinates\":[[0,0],[1,0],[4,0]]}}', 0.5D)) AS li FROM nation",
 f"""SELECT n_nationkey, n_nationkey * 2.0 - 20 AS lat, n_nationkey * 2.0 - 20 AS y, round((degrees(atan2(sin(radians(10) - {_LON1}) * cos(radians(10)), cos({_LAT1}) * sin(radians(10)) - sin({_LAT1}) * cos(radians(10)) * cos(radians(10) - {_LON1}))) + 360) % 360, 6) AS b,
 round(n_nationkey * 5.0 - 60 + degrees(atan2(sin(100000 / 6371000.0) * cos({_LAT1}), cos(100000 / 6371000.0) - sin({_LAT1}) * sin({_LAT1}) * cos(100000 / 6371000.0))), 6) AS dx, round(n_nationkey * 2.0 - 20 + degrees(100000 / 6371000.0), 6) AS dy, 0.0::DOUBLE AS my, round(n_nationkey / 2.0, 6) AS mx, round(6371000.0 * radians(n_nationkey), 3) AS sd, CAST(n_nationkey AS DOUBLE) AS sn, round(6371000.0 * radians(3), 3) AS le, 2.0::DOUBLE AS li FROM nation""")


def _box(w: str, s: str, e: str, n: str) -> str:
    """SQL text of a rectangle as GeoJSON."""
    return f"concat_ws('', '{{\"type\":\"Polygon\",\"coordinates\":[[[', {w}, ',', {s}, '],[', {e}, ',', {s}, '],[', {e}, ',', {n}, '],[', {w}, ',', {n}, '],[', {w}, ',', {s}, ']]]}}')"


_K = "n_nationkey"
_CELL = _box(_K, "0", f"{_K} + 1", "1")
_TEN = _box("0", "0", "10", "10")
_HOLED = f"concat_ws('', '{{\"type\":\"Polygon\",\"coordinates\":[[[0,0],[', {_K} + 4, ',0],[', {_K} + 4, ',4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}}')"
_sql("fn_geo_areas", f"SELECT n_nationkey, ST_CONTAINS({_TEN}, GEO_POINT(n_nationkey, 5)) AS c, round(GEO_POLYGON_AREA({_CELL}) / 1000000, 3) AS a, GEO_INTERSECTS({_CELL}, {_box('4', '0.5', '6', '2')}) AS i, GEO_DISJOINT({_CELL}, {_box('4.5', '0.5', '6', '2')}) AS d, GEO_EQUALS({_CELL}, {_box('3', '0', '4', '1')}) AS e, GEO_BBOX({_CELL})[2] AS bx, GEO_LON(GEO_CENTROID({_CELL})) AS cx, GEO_BBOX(GEO_AFFINE({_CELL}, 2, 0, 1, 0))[0] AS ax, round(GEO_BBOX(GEO_AFFINE({_CELL}, 0, 0, 3, 90))[1], 6) AS ay, GEO_EQUALS(GEO_DROP_HOLES({_HOLED}), {_box('0', '0', f'{_K} + 4', '4')}) AS dh, GEO_BBOX(GEO_CLIP({_TEN}, {_box(_K, '0', f'{_K} + 5', '10')}))[2] AS cl, GEO_EQUALS(GEO_ENVELOPE({_CELL}), {_CELL}) AS en, GEO_IS_VALID({_HOLED}) AS v, GEO_IS_VALID('{{\"type\":\"Polygon\",\"coordinates\":[[[0,0],[1,1]]]}}') AS iv FROM nation",
 "SELECT n_nationkey, n_nationkey > 0 AND n_nationkey < 10 AS c, round(6371000.0 * 6371000.0 * radians(1) * sin(radians(1)) / 1000000, 3) AS a, n_nationkey BETWEEN 3 AND 6 AS i, n_nationkey NOT BETWEEN 4 AND 6 AS d, n_nationkey = 3 AS e, CAST(n_nationkey + 1 AS DOUBLE) AS bx, n_nationkey + 0.5 AS cx, CAST(n_nationkey + 2 AS DOUBLE) AS ax, -1.0::DOUBLE AS ay, true AS dh, CASE WHEN n_nationkey < 10 THEN CAST(least(n_nationkey + 5, 10) AS DOUBLE) END AS cl, true AS en, true AS v, false AS iv FROM nation".replace("n_nationkey > 0 AND n_nationkey < 10 AS c", "n_nationkey < 10 AS c"))
_LINE = "concat_ws('', '{\"type\":\"LineString\",\"coordinates\":[[0,0],[', n_nationkey + 1, ',0.001],[', 2 * n_nationkey + 2, ',0]]}')"
_ENDS = "concat_ws('', '{\"type\":\"LineString\",\"coordinates\":[[0,0],[', 2 * n_nationkey + 2, ',0]]}')"
_MULTI = "concat_ws('', '{\"type\":\"MultiPoint\",\"coordinates\":[[0,0],[', n_nationkey + 1, ',0],[', n_nationkey + 1, ',', n_nationkey + 1, '],[0,', n_nationkey + 1, '],[0.5,0.5]]}')"
_sql("fn_geo_editing", f"SELECT n_nationkey, GEO_EQUALS(GEO_SIMPLIFY({_LINE}, 0.01D), {_ENDS}) AS dp, GEO_EQUALS(GEO_SIMPLIFY({_LINE}, 0.0000001D), {_LINE}) AS keep, GEO_EQUALS(GEO_CONVEX_HULL({_MULTI}), {_box('0', '0', f'{_K} + 1', f'{_K} + 1')}) AS h, GEO_EQUALS(GEO_CLEAN('{{\"type\":\"LineString\",\"coordinates\":[[0,0],[0,0],[1,1]]}}'), '{{\"type\":\"LineString\",\"coordinates\":[[0,0],[1,1]]}}') AS c, GEO_BBOX(GEO_SMOOTH({_ENDS}, 2))[2] AS sm, GEO_IS_VALID(GEO_BUFFER(GEO_POINT(n_nationkey, 10), 1000, 16)) AS bv, GEO_WITHIN_POLYGON(GEO_POINT(n_nationkey, 10), GEO_BUFFER(GEO_POINT(n_nationkey, 10), 1000)) AS bw, round(GEO_POLYGON_AREA(GEO_BUFFER(GEO_POINT(n_nationkey, 0), 1000)) / (1000000 * PI()), 2) AS ba FROM nation",
 "SELECT n_nationkey, true AS dp, true AS keep, true AS h, true AS c, CAST(2 * n_nationkey + 2 AS DOUBLE) AS sm, true AS bv, true AS bw, 0.99::DOUBLE AS ba FROM nation")
_TILE_Y = "CAST(floor((1 - ln(tan(radians(n_nationkey * 3.0 - 36)) + 1 / cos(radians(n_nationkey * 3.0 - 36))) / pi()) / 2 * 256) AS BIGINT)"
_sql("fn_tiles_more", "SELECT n_nationkey, TILE_Y(n_nationkey * 3.0D - 36, 8) AS y, JSON_GET(TILE_ZXY(n_nationkey * 10.0D - 120, n_nationkey * 3.0D - 36, 8), 'y') AS zy, JSON_GET(TILE_ZXY(n_nationkey * 10.0D - 120, n_nationkey * 3.0D - 36, 8), 'tms_y') AS ty, round(TILE_LAT(n_nationkey, 5), 6) AS la, round(CAST(JSON_GET(TILE_BBOX(5, n_nationkey, n_nationkey), '0') AS DOUBLE), 6) AS bw, JSON_GET(TILE_FROM_QUADKEY(TILE_QUADKEY(5, n_nationkey, 31 - n_nationkey)), 'x') AS qx, JSON_GET(TILE_FROM_QUADKEY(TILE_QUADKEY(5, n_nationkey, 31 - n_nationkey)), 'y') AS qy, JSON_GET(TILE_PARENT(5, n_nationkey, n_nationkey), 'x') AS px, TILE_CONTAINS(3, n_nationkey, 3, 0.5D, 10D) AS c, TILE_ROW_TMS(n_nationkey, 6) AS tr FROM nation",
 f"SELECT n_nationkey, {_TILE_Y} AS y, CAST({_TILE_Y} AS VARCHAR) AS zy, CAST(255 - {_TILE_Y} AS VARCHAR) AS ty, round(degrees(atan((exp(pi() * (1 - 2 * n_nationkey / 32.0)) - exp(-pi() * (1 - 2 * n_nationkey / 32.0))) / 2)), 6) AS la, round(n_nationkey / 32.0 * 360 - 180, 6) AS bw, CAST(n_nationkey AS VARCHAR) AS qx, CAST(31 - n_nationkey AS VARCHAR) AS qy, CAST(n_nationkey // 2 AS VARCHAR) AS px, n_nationkey = 4 AS c, CAST(63 - n_nationkey AS BIGINT) AS tr FROM nation")

# other names of the same functions

_G, _H = "GEO_POINT(n_nationkey, 1)", "GEO_POINT(3, 2)"
_ONE = "concat_ws('', '{\"type\":\"LineString\",\"coordinates\":[[0,0],[', n_nationkey + 1, ',1]]}')"
_sql("fn_names_text", "SELECT n_nationkey, ROUND(BM25(n_name, 'nation'), 6) = ROUND(FTS_RANK(n_name, 'nation'), 6) AS a, CEILING(n_nationkey / 2.0D) AS b, CHAR_LENGTH(n_name) AS c, DATE(DATEADD(TIMESTAMP '2024-01-01', n_nationkey, 'DAY')) AS d, DATE(DATESUB(TIMESTAMP '2024-01-01', n_nationkey)) AS e, EDIT_DISTANCE(n_name, 'NATION_1') AS f, IF(n_nationkey > 3, 'x', 'y') AS g, IN_ARRAY(SPLIT(n_name, '_'), 'NATION') AS h, MATCH(n_name, 'nation') AS i, NVL(nullif(n_name, 'NATION_1'), 'none') AS j, POWER(n_nationkey, 2) AS k, RAND() < 1 AS l, SUBSTRING(n_name, 2, 3) AS m, TRUNCATE(n_nationkey / 3.0D, 1) AS n, UNZIP(GZIP(n_name)) AS o FROM nation",
 "SELECT n_nationkey, true AS a, ceil(n_nationkey / 2.0) AS b, CAST(length(n_name) AS INT) AS c, strftime(DATE '2024-01-01' + n_nationkey, '%Y-%m-%d') AS d, strftime(DATE '2024-01-01' - n_nationkey, '%Y-%m-%d') AS e, CAST(levenshtein(n_name, 'NATION_1') AS INT) AS f, CASE WHEN n_nationkey > 3 THEN 'x' ELSE 'y' END AS g, true AS h, true AS i, coalesce(nullif(n_name, 'NATION_1'), 'none') AS j, pow(n_nationkey, 2) AS k, true AS l, substr(n_name, 2, 3) AS m, floor(n_nationkey / 3.0 * 10) / 10 AS n, n_name AS o FROM nation")
_sql("fn_names_vectors", f"SELECT vec_id, VEC_DOT_PRODUCT(e, r) = VEC_DOT(e, r) AS a, round(VEC_EUCLIDEAN_DISTANCE(e, r), 6) AS b, round(VEC_L1_DISTANCE(e, r), 6) AS c FROM {_E}",
 f"SELECT vec_id, true AS a, round(sqrt(list_sum(list_transform(list_zip(e, r), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS b, round(list_sum(list_transform(list_zip(e, r), lambda z: abs(z[1] - z[2]))), 6) AS c FROM (SELECT vec_id, {_V} AS e, {_R} AS r FROM embeddings)")
_sql("fn_names_points", f"SELECT n_nationkey, ST_X(ST_POINT(n_nationkey, 1)) AS a, GEO_X(ST_MAKEPOINT(n_nationkey, 1)) AS b, GEO_Y({_G}) AS c, round(GEO_DISTANCE({_G}, {_G}), 3) AS d, ST_DWITHIN({_G}, GEO_POINT(0, 1), 400000) AS e, ST_WITHIN_BBOX({_G}, 2, 0, 4, 2) AS f, round(ST_AZIMUTH(GEO_POINT(0, 0), GEO_POINT(0, n_nationkey + 1)), 6) AS g, round(ST_Y(ST_PROJECT(GEO_POINT(0, 0), 0, 6371000 * PI() / 180 * n_nationkey)), 6) AS h, round(ST_X(ST_MIDPOINT(GEO_POINT(0, 0), GEO_POINT(n_nationkey, 0))), 6) AS i, ST_WITHIN(GEO_POINT(n_nationkey + 0.5D, 0.5D), {_box('0', '0', '4', '1')}) AS j, ST_X(ST_SNAPTOGRID(GEO_POINT(n_nationkey + 0.2D, 0), 1)) AS k FROM nation",
 "SELECT n_nationkey, n_nationkey::DOUBLE AS a, n_nationkey::DOUBLE AS b, 1.0::DOUBLE AS c, 0.0::DOUBLE AS d, n_nationkey * radians(1) * 6371000 * cos(radians(1)) <= 400000 AS e, n_nationkey BETWEEN 2 AND 4 AS f, 0.0::DOUBLE AS g, n_nationkey::DOUBLE AS h, n_nationkey / 2.0 AS i, n_nationkey < 4 AS j, n_nationkey::DOUBLE AS k FROM nation")
_sql("fn_names_shapes", f"SELECT n_nationkey, ST_BBOX({_CELL})[0] AS a, round(ST_AREA({_CELL}) / 1000000, 3) AS b, ST_X(ST_CENTROID({_CELL})) AS c, ST_BBOX(ST_AFFINE({_CELL}, 1, 0, 1, 0))[0] AS d, ST_EQUALS(ST_CLEAN({_CELL}), {_CELL}) AS e, ST_BBOX(ST_CLIP({_TEN}, {_box(_K, '0', f'{_K} + 30', '10')}))[0] AS f, ST_EQUALS(ST_CONVEXHULL({_MULTI}), {_box('0', '0', f'{_K} + 1', f'{_K} + 1')}) AS g, ST_DISJOINT({_CELL}, {_box('4.5', '0.5', '6', '2')}) AS h, ST_INTERSECTS({_CELL}, {_box('4.5', '0.5', '6', '2')}) AS i, ST_EQUALS(ST_ENVELOPE({_ONE}), {_box('0', '0', f'{_K} + 1', '1')}) AS j, ST_ISVALID(ST_BUFFER({_G}, 500)) AS k, round(ST_LENGTH('{{\"type\":\"LineString\",\"coordinates\":[[0,0],[2,0]]}}'), 3) AS l, ST_Y(ST_LINE_INTERPOLATE_POINT({_ONE}, 0)) AS m, ST_EQUALS(ST_REMOVE_HOLES({_HOLED}), {_box('0', '0', f'{_K} + 4', '4')}) AS n, ST_EQUALS(ST_SIMPLIFY({_LINE}, 0.01D), {_ENDS}) AS o, ST_BBOX(ST_SMOOTH({_ENDS}, 1))[2] AS p FROM nation",
 "SELECT n_nationkey, n_nationkey::DOUBLE AS a, round(6371000.0 * 6371000.0 * radians(1) * sin(radians(1)) / 1000000, 3) AS b, n_nationkey + 0.5 AS c, n_nationkey + 1.0 AS d, true AS e, CASE WHEN n_nationkey < 10 THEN n_nationkey::DOUBLE END AS f, true AS g, n_nationkey NOT BETWEEN 4 AND 6 AS h, n_nationkey BETWEEN 4 AND 6 AS i, true AS j, true AS k, round(6371000.0 * radians(2), 3) AS l, 0.0::DOUBLE AS m, true AS n, true AS o, 2.0 * n_nationkey + 2 AS p FROM nation")
