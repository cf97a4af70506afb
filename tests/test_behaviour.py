"""What one query cannot show: refusals, recall, plans, schedules."""

import datetime
import random
import re

import duckdb
import pytest
from conftest import DATA, check_query
from pyspark.sql import functions as F

from quillspark.functions import fulltext, python_functions, register
from quillspark.operators import relational, search
from quillspark.plans import registry
from quillspark.plans.engine import ConstraintError, Engine, cron_next
from quillspark.plans.sql import Rewriter
from quillspark.sources import readers


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}")


def test_stop_words():
    assert fulltext.tokens("It was as the fox jumping") == ["fox", "jump"]
    assert fulltext.natural("What is the capital of France?") == "capital OR france"


@pytest.mark.parametrize(("query", "expected"), [("quick AND fox", True), ("quick AND cat", False), ("cat OR fox", True), ("cat OR dog", False), ("NOT cat", True), ("NOT fox", False), ('"quick brown"', True), ('"brown quick"', False), ("qui*", True), ("f?x", True), ("the", False), ("(cat OR fox) AND NOT dog", True)])
def test_match(spark, query, expected):
    got = spark.sql(Rewriter(spark).statement(f"SELECT FTS_MATCH('the quick brown fox', '{query}') AS m")).first()["m"]
    assert got is expected


def test_each_different_word_is_stemmed_once(spark, monkeypatch):
    """Matches and ranks as from the list of tokens, from far fewer steps than there are words."""
    seen = []
    monkeypatch.setattr(fulltext, "stem", lambda w, f=fulltext.stem: seen.append(w) or f(w))
    if hasattr(fulltext, "_token"):
        fulltext._token.cache_clear()
    text = "Testing the tested ÄTests, that Ther there x that ther und 1 22 É99 " * 500
    listed = [fulltext.stem(w) for w in map(str.lower, re.findall("[A-Za-z0-9]+", text)) if len(w) > 1 and w not in fulltext.STOP]
    seen.clear()
    match, rank = (python_functions.FUNCTIONS[f"fts_{k}"][1] for k in ("match", "rank"))
    for query in ("that OR und", '"that ther"', '"ther that"', "ther* AND NOT zzz", "t?er", "test", "the OR zz", '"und 22"'):
        node = fulltext.parse(query)
        assert match(text, query) == fulltext.match(node, listed, set(listed)), query
        assert rank(text, query) == fulltext.score(node, listed), query
    assert fulltext.tokens(text) == listed
    assert len(seen) < 100
    row = spark.createDataFrame([(text,)], "t string").selectExpr(f"{register.ensure(spark, 'fts_word_count')}(t) AS n", f"size({register.ensure(spark, 'fts_tokens')}(t)) AS m").first()
    assert (row["n"], row["m"]) == (len(listed), len(listed))


def test_search_agrees_with_match(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: fulltext.tokens(r["text"]) for r in docs.collect()}
    for query in ("that", "that AND NOT und", '"that this"', "th*", "(und OR der) AND NOT th*", "NOT that", "t?e*"):
        node = fulltext.parse(query)
        want = {i for i, t in rows.items() if t and fulltext.match(node, t, set(t))}
        assert {r["doc_id"] for r in search.fts_search(docs, query, 10_000, ["text"], "doc_id").collect()} == want, query


def test_ivf_recall(spark, tmp_path):
    """Vectors in clusters, which inverted lists are for; the lists that a search probes must be all that it reads."""
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(30)]
    made = [(k, [x + rng.gauss(0, 0.25) for x in centres[k % 30]]) for k in range(3000)]
    rows = spark.createDataFrame(made, "vec_id long, embedding array<double>").repartition(4)
    index = search.IVFIndex(rows, "embedding", folder=f"file://{tmp_path}/lists")
    plan = index.search(centres[0], 3, probes=2, key="vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_list" in plan
    hits = total = 0
    for k, v in made[::300]:
        exact = {x["vec_id"] for x in search.vec_search(rows, "embedding", v, 10, key="vec_id").collect()}
        found = {x["vec_id"] for x in index.search(v, 10, key="vec_id").collect()}
        hits, total = hits + len(exact & found), total + 10
    assert hits / total >= 0.9


def test_jenks_is_least():
    import itertools

    rng = random.Random(4)
    for _ in range(60):
        v = sorted(rng.randrange(40) for _ in range(rng.randrange(1, 12)))
        k = rng.randrange(1, 5)
        bounds = relational.jenks(v, k)
        cost = lambda b: sum(sum((x - sum(g) / len(g)) ** 2 for x in g) for lo, hi in zip([-1, *b], b, strict=False) if (g := [x for x in v if lo < x <= hi]))  # noqa: E731, B023
        distinct = sorted(set(v))
        best = min(cost([*c, distinct[-1]]) for c in itertools.combinations(distinct[:-1], min(k, len(distinct)) - 1))
        assert abs(cost(bounds) - best) < 1e-9


def test_least_value_of_ties(spark, tmp_path):
    """Copies of all customers: a nation's richest and poorest are then several, and the first in the file counts."""
    (tmp_path / "t").mkdir()
    duckdb.execute(f"COPY (SELECT c.* REPLACE (c_custkey + k * 10000 AS c_custkey) FROM '{DATA}/sf0.01/customer.parquet' c, range(3) r(k) ORDER BY k, c_custkey) TO '{tmp_path}/t/customer.parquet'")
    check_query(spark, registry.QUERIES["agg_min_by_max_by"], registry.ORACLE["agg_min_by_max_by"], f"{tmp_path}/t")


@pytest.mark.parametrize("kind", ["int", "double", "decimal(9,1)", "string", "date", "boolean"])
def test_least_value_of_ties_by_type(spark, kind):
    values = {"date": ["2024-03-01", "2023-12-31", "2024-02-09"], "boolean": ["true", "false", "true"], "string": ["b", "ab", "a"]}.get(kind, ["9", "-10", "1"])
    rows = [(1, v, o) for v in values for o in (0, 7)] + [(1, None, 7), (1, values[2], None), (2, None, 7)]
    spark.createDataFrame(rows, "g int, v string, o int").selectExpr("g", f"CAST(v AS {kind}) AS v", "o").repartition(3).createOrReplaceTempView("tied")
    got = spark.sql(Rewriter(spark).statement("SELECT g, CAST(ARG_MIN(v, o) AS STRING) AS a, CAST(MAX_BY(v, o) AS STRING) AS z FROM tied GROUP BY g ORDER BY g")).collect()
    least = spark.sql("SELECT CAST(min(v) AS STRING) AS v FROM tied").first()["v"]
    assert [tuple(r) for r in got] == [(1, least, least), (2, None, None)]
    over = spark.sql(Rewriter(spark).statement("SELECT CAST(max_by(v, o) OVER (PARTITION BY g) AS STRING) AS z FROM tied WHERE g = 1")).collect()
    assert {r["z"] for r in over} == {least}


def test_natural_breaks_of_a_large_window(spark):
    """A partition's values are handed over once and not with each of its rows, of which there would be 1.6 billion here."""
    rows = spark.range(40_001).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.col("id") % 500 + F.col("id") % 3 * 10_000).alias("v"), F.lit(1).alias("g"))
    rows.createOrReplaceTempView("broken")
    got = spark.sql(Rewriter(spark).statement("SELECT v, NATURAL_BREAKS(3) OVER (PARTITION BY g ORDER BY v) AS class, NATURAL_BREAKS(2) OVER (ORDER BY v DESC) AS two FROM broken"))
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["class"], r["v"] is None, None if r["v"] is None else r["v"] // 10_000) for r in got.select("class", "v").distinct().collect()}
    assert found == {(None, True, None), (1, False, 0), (2, False, 1), (3, False, 2)}
    assert {r["two"] for r in got.select("two").distinct().collect()} == {None, 1, 2}


def test_cron():
    at = datetime.datetime(2024, 2, 28, 23, 50, tzinfo=datetime.UTC).timestamp()
    after = lambda spec: datetime.datetime.fromtimestamp(cron_next(spec, at), datetime.UTC).strftime("%m-%d %H:%M")
    assert after("*/15 * * * *") == "02-29 00:00"
    assert after("30 4 1,15 * *") == "03-01 04:30"
    assert after("0 9 * * 1-5") == "02-29 09:00"
    assert after("0 0 29 2 *") == "02-29 00:00"
    with pytest.raises(ValueError, match="five fields"):
        cron_next("* *", at)


def test_refused_insert_changes_nothing(engine):
    engine.sql("CREATE TABLE p (id INT PRIMARY KEY, code TEXT UNIQUE)")
    engine.sql("INSERT INTO p VALUES (1, 'a')")
    for bad in ("INSERT INTO p VALUES (1, 'b')", "INSERT INTO p VALUES (2, 'a')", "INSERT INTO p VALUES (NULL, 'c')"):
        with pytest.raises(ConstraintError):
            engine.sql(bad)
    assert engine.sql("SELECT * FROM p").count() == 1


def test_update_is_refused_for_referenced_keys(engine):
    for s in ("CREATE TABLE p (id INT PRIMARY KEY)", "INSERT INTO p VALUES (1)", "CREATE TABLE c (p INT REFERENCES p(id))", "INSERT INTO c VALUES (1)"):
        engine.sql(s)
    with pytest.raises(ConstraintError):
        engine.sql("UPDATE p SET id = 2")
    engine.sql("DELETE FROM c")
    engine.sql("UPDATE p SET id = 2")
    assert [r["id"] for r in engine.sql("SELECT id FROM p").collect()] == [2]


def test_vacuum_removes_old_versions(engine):
    engine.sql("CREATE TABLE a (x INT)")
    for k in range(3):
        engine.sql(f"INSERT INTO a VALUES ({k})")
    engine.sql("BEGIN")
    engine.sql("DELETE FROM a")
    assert engine.sql("VACUUM").first()["removed"] > 3
    engine.sql("ROLLBACK")
    assert engine.sql("SELECT * FROM a").count() == 3
    assert engine.sql("VACUUM").first()["removed"] > 0 and engine.sql("VACUUM").first()["removed"] == 0


def test_triggers_end(engine):
    engine.sql("CREATE TABLE a (x INT)")
    engine.sql("CREATE TRIGGER t AFTER INSERT ON a BEGIN INSERT INTO a VALUES (1); END")
    with pytest.raises(RecursionError):
        engine.sql("INSERT INTO a VALUES (0)")


def test_transactions_in_order(engine):
    with pytest.raises(ValueError, match="no transaction"):
        engine.sql("COMMIT")
    engine.sql("BEGIN")
    engine.sql("CREATE TABLE made (x INT)")
    engine.sql("ROLLBACK")
    with pytest.raises(KeyError):
        engine.frame("made")


def test_file_and_http_are_off(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    readers.ALLOWED[:] = []
    with pytest.raises(PermissionError):
        readers.file_text(spark, f"{tmp_path}/a.txt")
    with pytest.raises(PermissionError):
        readers.file_text(spark, f"{tmp_path}/in/../../a.txt", f"{tmp_path}/in")
    with pytest.raises(PermissionError):
        readers.http_text(spark, "http://localhost/")


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet(f"{DATA}/sf0.01/orders.parquet")
    orders.createOrReplaceTempView("orders")
    plan = spark.sql(Rewriter(spark).statement("SELECT o_orderkey FROM orders WHERE o_custkey = 5"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,5)" in plan and "o_totalprice" not in plan


def test_dialect_leaves_spark_sql_alone(spark):
    r = Rewriter(spark)
    for text in ("SELECT a AS b FROM t WHERE x IN (1, 2)", "SELECT count(*) AS n FROM t", "SELECT t.* FROM t", "SELECT CASE WHEN a THEN b END AS c FROM t"):
        assert " ".join(r.statement(text).split()) == text


def test_null_semantics_of_functions(spark):
    row = spark.sql(Rewriter(spark).statement("SELECT CONTAINS(NULL, 'a') AS a, ENDS_WITH(NULL, 'a') AS b, CONCAT('x', NULL) AS c, CONCAT_WS(NULL, 'a') AS d, VEC_DIM(NULL) AS e, QUOTE(NULL) AS f")).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["f"]) == (False, False, "x", None, "NULL")


def test_errors_of_functions(spark):
    for call in ("SQRT(-1)", "LN(0)", "VEC_ADD(array(1D), array(1D, 2D))", "VEC_NORMALIZE(array(0D))", "YAML_PARSE('  ')", "BITMAP_SET('', 2000)"):
        with pytest.raises(Exception):  # noqa: B017
            spark.sql(Rewriter(spark).statement(f"SELECT {call} AS x")).collect()
    assert register.known("st_clip") and not register.known("no_such_function")


def test_range_join_against_plain(spark):
    rng = random.Random(1)
    points = spark.createDataFrame([(k, rng.uniform(0, 100)) for k in range(200)], "p int, x double")
    ranges = spark.createDataFrame([(k, a := rng.uniform(0, 100), a + rng.uniform(0, 9)) for k in range(60)], "r int, low double, high double")
    got = {(r["p"], r["r"]) for r in relational.range_join(points, ranges, "x", "low", "high", 5.0).collect()}
    assert got == {(r["p"], r["r"]) for r in points.crossJoin(ranges).where("x >= low AND x < high").collect()}


def test_wide_ranges_are_listed_a_few_times(spark):
    points = spark.range(50).select("id", (F.col("id") * 20.0).alias("x"))
    ranges = spark.createDataFrame([(1, 0.0, 1e6), (2, 5.0, 5.5), (3, 400.0, 400.0), (4, -50.0, 30.0)], "r int, low double, high double")
    got = sorted((r["id"], r["r"]) for r in relational.range_join(points, ranges, "x", "low", "high", 0.5).select("id", "r").collect())
    assert got == sorted([(k, 1) for k in range(50)] + [(0, 4), (1, 4)])


def test_range_join_of_copies(spark, tmp_path):
    """Copies of ranges and points: all pairs, told apart by any kind of column, and few bytes a pair in a file."""
    points = spark.range(70).select(F.expr("named_struct('k', id)").alias("a.b"), (F.col("id") % 7 * 1.0).alias("x"))
    ranges = spark.range(300).select(F.expr("map('k', id)").alias("m"), F.lit(2.0).alias("low"), F.lit(5.0).alias("high"))
    got = [(r[0]["k"], r[2]["k"]) for r in relational.range_join(points, ranges, "x", "low", "high", 2.0).collect()]
    assert sorted(got) == [(p, r) for p in range(70) if 2 <= p % 7 < 5 for r in range(300)]
    assert relational.range_join(points, ranges.drop("m"), "x", "low", "high", 2.0).count() == 9000
    (tmp_path / "t").mkdir()
    for t, key in (("orders", "o_orderkey"), ("part", "p_partkey")):
        duckdb.execute(f"COPY (SELECT t.* REPLACE ({key} + k * 1000000 AS {key}) FROM '{DATA}/sf0.1/{t}.parquet' t, range(4) r(k)) TO '{tmp_path}/t/{t}.parquet'")
    registry.QUERIES["join_range"](spark, f"{tmp_path}/t").write.parquet(f"file://{tmp_path}/pairs")
    assert spark.read.parquet(f"file://{tmp_path}/pairs").count() == 300_020 * 16
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 300_020 * 16


def test_asof_against_plain(spark):
    rng = random.Random(12)
    left = [(k, rng.choice(["a", "b", None]), rng.randrange(1000)) for k in range(300)]
    right = [(rng.choice(["a", "b", None]), t, t * 10) for t in rng.sample(range(1000), 90)]
    got = relational.asof_join(spark.createDataFrame(left, "k int, g string, t int"), spark.createDataFrame(right, "g string, t int, v int"), "t", "t", ["g"], ["v"], buckets=7)
    want = {k: max(((t2, v) for g2, t2, v in right if g2 == g and t2 <= t), default=(None, None))[1] for k, g, t in left}
    assert {r["k"]: r["v"] for r in got.collect()} == want


def test_numbers_by_parts(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    got = search.numbered(df, "n", "k", parts=9).collect()
    assert all(r["n"] == r["k"] + 1 for r in got)


def test_dissolve_with_hole(spark):
    from quillspark.functions import geometry

    cells = [(x, y) for x in range(4) for y in range(4) if (x, y) != (1, 2)]
    rows = [("g", geometry.dump("Polygon", [[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]])) for x, y in cells]
    got = geometry.load(relational.geo_dissolve(spark.createDataFrame(rows, "g string, geom string").repartition(5), ["g"], "geom").first()["geometry"])
    assert got["type"] == "Polygon" and len(got["coordinates"]) == 2
    assert geometry.bbox(got) == [0.0, 0.0, 4.0, 4.0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, v array<double>")
    assert search.fts_search(none, "word", 3, ["text"], "doc_id").count() == 0
    assert search.vec_search(none, "v", [1.0], 3, key="doc_id").count() == 0
    assert search.text_chunks(none, "text", 3).count() == 0
    assert relational.natural_breaks(none.withColumn("x", F.lit(1.0)), 3, "x", ["doc_id"]).count() == 0
