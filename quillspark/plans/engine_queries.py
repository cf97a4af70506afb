"""Queries that change data through the engine first: DML, constraints, views, jobs, triggers, transactions, roles, system tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .builder import delete_from, insert_into, select, update
from .catalog_queries import _df, table
from .engine import Engine
from .formatting import analyse, beautify, minify
from .profile import profile, schema_context, top_values


def _engine(spark: SparkSession) -> Engine:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return Engine(spark, f"{folder.rstrip('/')}/quillspark/engine")


def _script(name: str, oracle: str, *statements: str) -> None:
    """The last statement's rows after the others were run; ``{name}`` stands for a table loaded from the supplied ones."""

    @_df(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _engine(spark)
        table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
        table(spark, sf_dir, "region").createOrReplaceTempView("region")
        for s in statements[:-1]:
            e.sql(s)
        return e.sql(statements[-1])


_MAKE = "CREATE TABLE en (id INT PRIMARY KEY, name TEXT NOT NULL, region INT DEFAULT 7, note TEXT)"
_FILL = "INSERT INTO en (id, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation"

_script("dml_insert_values", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(7 AS BIGINT), NULL), (2, 'b', 7, 'x'), (3, 'c', 9, NULL)) t(id, name, region, note)", _MAKE, "INSERT INTO en (id, name) VALUES (1, 'a')", "INSERT INTO en VALUES (3, 'c', 9, NULL)", "INSERT INTO en (note, name, id) VALUES ('x', 'b', 2)", "SELECT * FROM en")
_script("dml_insert_returning", "SELECT CAST(4 AS BIGINT) AS id, CAST(14 AS BIGINT) AS twice", _MAKE, "INSERT INTO en (id, name) VALUES (4, 'd') RETURNING id, region * 2 AS twice")
_script("dml_update", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name || CASE WHEN n_regionkey = 2 THEN '!' ELSE '' END AS name, CAST(CASE WHEN n_regionkey = 2 THEN 12 ELSE n_regionkey END AS BIGINT) AS region FROM nation", _MAKE, _FILL, "UPDATE en SET name = name || '!', region = region + 10 WHERE region = 2", "SELECT id, name, region FROM en")
_script("dml_update_returning", "SELECT CAST(n_nationkey AS BIGINT) AS id, 'z' AS note FROM nation WHERE n_nationkey < 3", _MAKE, _FILL, "UPDATE en SET note = 'z' WHERE id < 3 RETURNING id, note")
_script("dml_delete", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_regionkey <> 1 OR n_nationkey > 20", _MAKE, _FILL, "DELETE FROM en WHERE region = 1 AND id <= 20", "SELECT id FROM en")
_script("dml_delete_returning", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey IN (2, 5)", _MAKE, _FILL, "DELETE FROM en WHERE id IN (2, 5) RETURNING id, name")
_script("ddl_create_as_alter", "SELECT n_name, CAST(5 AS BIGINT) AS extra FROM nation WHERE n_regionkey = 1", "CREATE TABLE cta AS SELECT n_name FROM nation WHERE n_regionkey = 1", "CREATE TABLE IF NOT EXISTS cta (x INT)", "ALTER TABLE cta ADD COLUMN extra INT DEFAULT 5", "SELECT n_name, extra FROM cta")
_script("ddl_index_drop", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey BETWEEN 4 AND 9 AND n_regionkey = 1", _MAKE, _FILL, "CREATE INDEX ix ON en (region, id)", "CREATE UNIQUE INDEX iy ON en (id)", "DROP INDEX iy", "CREATE TABLE gone (x INT)", "DROP TABLE gone", "DROP TABLE IF EXISTS gone", "SELECT id FROM en WHERE region = 1 AND id BETWEEN 4 AND 9")
_script("ddl_index_seek", "SELECT n_name AS name FROM nation WHERE n_nationkey = 11", _MAKE, _FILL, "CREATE INDEX ix ON en (id)", "SELECT name FROM en WHERE id = 11")
_script("ddl_index_page", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey > 6 ORDER BY 1 LIMIT 5", _MAKE, _FILL, "CREATE INDEX ix ON en (id)", "SELECT id FROM en WHERE id > 6 ORDER BY id LIMIT 5")
_script("ddl_fts_table", "SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(1 AS BIGINT) AS place FROM nation WHERE n_nationkey = 3", "CREATE VIRTUAL TABLE ft USING fts (id, body)", "INSERT INTO ft SELECT CAST(n_nationkey AS STRING), concat('word', n_nationkey, ' shared') FROM nation", "SELECT id, _fts_rank AS place FROM FTS_SEARCH('ft', 'word3', 5, 'body')")
_script("view_scan", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey", "CREATE VIEW vw AS SELECT n_regionkey, n_nationkey FROM nation WHERE n_nationkey > 3", "SELECT n_regionkey, count(*) AS n FROM vw GROUP BY n_regionkey")
_script("view_materialised", "SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) + CASE WHEN n_regionkey = 0 THEN 1 ELSE 0 END AS n FROM nation GROUP BY n_regionkey", _MAKE, _FILL, "CREATE MATERIALIZED VIEW mv AS SELECT region, count(*) AS n FROM en GROUP BY region", "INSERT INTO en VALUES (100, 'new', 0, NULL)", "SELECT region, n FROM mv")
_script("view_materialised_manual", "SELECT CAST(25 AS BIGINT) AS n", _MAKE, _FILL, "CREATE MATERIALIZED VIEW mw REFRESH MANUAL AS SELECT count(*) AS n FROM en", "DELETE FROM en WHERE id < 5", "SELECT n FROM mw")
_script("view_refresh_and_forms", "SELECT CAST(20 AS BIGINT) AS n", _MAKE, _FILL, "CREATE VIEW vf AS SELECT count(*) AS n FROM en", "ALTER VIEW vf MATERIALIZE", "DELETE FROM en WHERE id < 5", "REFRESH MATERIALIZED VIEW vf", "ALTER MATERIALIZED VIEW vf TO VIEW", "SELECT n FROM vf")
_script("view_staleness", "SELECT 'ms' AS name, true AS stale", _MAKE, _FILL, "CREATE MATERIALIZED VIEW ms REFRESH MANUAL AS SELECT count(*) AS n FROM en", "DELETE FROM en WHERE id = 1", "SELECT name, stale FROM sys.materialized_views")
_PARENT = ("CREATE TABLE parent (id INT PRIMARY KEY, name TEXT)", "INSERT INTO parent SELECT r_regionkey, r_name FROM region")
_script("fk_cascade", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS p FROM nation WHERE n_regionkey <> 2", *_PARENT, "CREATE TABLE child (id INT, p INT REFERENCES parent(id) ON DELETE CASCADE)", "INSERT INTO child SELECT n_nationkey, n_regionkey FROM nation", "DELETE FROM parent WHERE id = 2", "SELECT id, p FROM child")
_script("fk_set_null", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(nullif(n_regionkey, 2) AS BIGINT) AS p FROM nation", *_PARENT, "CREATE TABLE child (id INT, p INT REFERENCES parent(id) ON DELETE SET NULL)", "INSERT INTO child SELECT n_nationkey, n_regionkey FROM nation", "DELETE FROM parent WHERE id = 2", "SELECT id, p FROM child")
_script("fk_update_cascade", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(CASE WHEN n_regionkey = 2 THEN 20 ELSE n_regionkey END AS BIGINT) AS p FROM nation", *_PARENT, "CREATE TABLE child (id INT, p INT REFERENCES parent(id) ON UPDATE CASCADE)", "INSERT INTO child SELECT n_nationkey, n_regionkey FROM nation", "UPDATE parent SET id = 20 WHERE id = 2", "SELECT id, p FROM child")
_script("fk_update_set_null", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(nullif(n_regionkey, 2) AS BIGINT) AS p FROM nation", *_PARENT, "CREATE TABLE child (id INT, p INT REFERENCES parent(id) ON DELETE CASCADE ON UPDATE SET NULL)", "INSERT INTO child SELECT n_nationkey, n_regionkey FROM nation", "UPDATE parent SET id = 20 WHERE id = 2", "SELECT id, p FROM child")


@_df("constraints_refused", "SELECT * FROM (VALUES ('primary key'), ('not null'), ('foreign key'), ('restrict')) t(refused)")
def _refused(spark, sf_dir):
    from .engine import ConstraintError

    e, found = _engine(spark), []
    for s in ("CREATE TABLE cp (id INT PRIMARY KEY, name TEXT NOT NULL)", "INSERT INTO cp VALUES (1, 'a')", "CREATE TABLE cc (p INT REFERENCES cp(id))", "INSERT INTO cc VALUES (1)"):
        e.sql(s)
    for what, s in (("primary key", "INSERT INTO cp VALUES (1, 'b')"), ("not null", "INSERT INTO cp VALUES (2, NULL)"), ("foreign key", "INSERT INTO cc VALUES (5)"), ("restrict", "DELETE FROM cp WHERE id = 1"), ("nothing", "INSERT INTO cc VALUES (NULL)")):
        try:
            e.sql(s)
        except ConstraintError:
            found.append((what,))
    return spark.createDataFrame(found, "refused string")


_script("trigger_after_insert", "SELECT CAST(n_nationkey AS BIGINT) AS id, 'insert' AS what FROM nation WHERE n_nationkey < 3", _MAKE, "CREATE TABLE log (id INT, what TEXT)", "CREATE TRIGGER t1 AFTER INSERT ON en FOR EACH ROW BEGIN INSERT INTO log VALUES (NEW.id, 'insert'); END", "INSERT INTO en (id, name) SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 3", "SELECT id, what FROM log")
_script("trigger_update_delete", "SELECT * FROM (VALUES ('NATION_1', 'x'), ('x', NULL)) t(old, new)", _MAKE, "INSERT INTO en (id, name) SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 3", "CREATE TABLE log (old TEXT, new TEXT)", "CREATE TRIGGER t1 BEFORE UPDATE ON en BEGIN INSERT INTO log VALUES (OLD.name, NEW.name); END", "CREATE TRIGGER t2 AFTER DELETE ON en BEGIN INSERT INTO log VALUES (OLD.name, NULL); END", "UPDATE en SET name = 'x' WHERE id = 1", "DELETE FROM en WHERE id = 1", "DROP TRIGGER t1", "UPDATE en SET name = 'y' WHERE id = 2", "SELECT old, new FROM log")
_script("transaction_rollback", "SELECT count(*) AS n, max(n_name) AS m FROM nation", _MAKE, _FILL, "BEGIN", "DELETE FROM en WHERE id > 3", "UPDATE en SET name = 'zzz'", "ROLLBACK", "SELECT count(*) AS n, max(name) AS m FROM en")
_script("transaction_commit", "SELECT CAST(4 AS BIGINT) AS n", _MAKE, _FILL, "BEGIN TRANSACTION", "DELETE FROM en WHERE id > 3", "COMMIT", "SELECT count(*) AS n FROM en")


@_df("roles", "SELECT * FROM (VALUES ('ann', 'select', true), ('ann', 'delete', false), ('bob', 'select', false), ('bob after grant', 'select', true), ('bob after revoke', 'select', false)) t(who, what, allowed)")
def _roles(spark, sf_dir):
    e, found = _engine(spark), []
    for s in ("CREATE TABLE rt (id INT)", "CREATE USER ann", "CREATE USER bob", "CREATE ROLE reader", "GRANT SELECT ON rt TO reader", "GRANT reader TO ann"):
        e.sql(s)

    def attempt(who: str, shown: str, what: str, statement: str) -> None:
        try:
            e.sql(statement, user=who)
            found.append((shown, what, True))
        except PermissionError:
            found.append((shown, what, False))

    attempt("ann", "ann", "select", "SELECT * FROM rt")
    attempt("ann", "ann", "delete", "DELETE FROM rt")
    attempt("bob", "bob", "select", "SELECT * FROM rt")
    e.sql("GRANT SELECT ON rt TO bob")
    attempt("bob", "bob after grant", "select", "SELECT * FROM rt")
    e.sql("REVOKE SELECT ON rt FROM bob")
    attempt("bob", "bob after revoke", "select", "SELECT * FROM rt")
    return spark.createDataFrame(found, "who string, what string, allowed boolean")


@_df("jobs_schedule", "SELECT * FROM (VALUES ('cron', 2), ('interval', 4), ('once', 1), ('off', 0)) t(job, runs)")
def _jobs(spark, sf_dir):
    """Four jobs over three simulated hours, asked every ten minutes: at the full hour, each 45 minutes, once, and disabled."""
    import datetime

    e = _engine(spark)
    begin = datetime.datetime(2024, 3, 5, 10, 5, tzinfo=datetime.UTC).timestamp()
    e.sql("CREATE TABLE jt (id INT)", now=begin)
    for name, plan in (("cron", "CRON '0 * * * *'"), ("interval", "INTERVAL '45m'"), ("once", "ONCE ''"), ("off", "INTERVAL '1m'")):
        e.sql(f"CREATE JOB {name} SCHEDULE {plan} AS SELECT count(*) AS n FROM jt", now=begin)
    e.sql("ALTER JOB off DISABLE")
    for minute in range(0, 180, 10):
        e.run_due_jobs(begin + 60 * minute)
    ran = [h[0] for h in e.history]
    return spark.createDataFrame([(j, ran.count(j)) for j in ("cron", "interval", "once", "off")], "job string, runs int")


@_df("procedure_call", "SELECT CAST(count(*) + 2 AS BIGINT) AS called FROM nation")
def _procedure(spark, sf_dir):
    e = _engine(spark)
    nation = table(spark, sf_dir, "nation")
    e.register_procedure("tally", lambda engine, more: nation.count() + more)
    return e.sql("CALL tally(2)")


_script("analyse_table", "SELECT 'region' AS \"column\", count(*) AS rows, CAST(0 AS BIGINT) AS nulls, min(CAST(n_regionkey AS VARCHAR)) AS min, max(CAST(n_regionkey AS VARCHAR)) AS max FROM nation UNION ALL SELECT 'note', count(*), count(*), NULL, NULL FROM nation", _MAKE, _FILL, "ANALYZE en", "SELECT column, rows, nulls, min, max FROM sys.statistics WHERE table = 'en' AND column IN ('region', 'note')")
_script("system_tables", "SELECT 'en' AS name, CAST(4 AS BIGINT) AS columns", _MAKE, "SELECT name, columns FROM sys.tables WHERE name = 'en'")
_script("catalog_tables", "SELECT * FROM (VALUES ('id', 'PRIMARY KEY'), ('id', 'NOT NULL'), ('name', 'NOT NULL')) t(\"column\", kind)", _MAKE, "SELECT column, kind FROM catalog.constraints WHERE table = 'en'")
_script("sqlite_schema", "SELECT * FROM (VALUES ('table', 'en'), ('view', 'vq')) t(type, name)", _MAKE, "CREATE VIEW vq AS SELECT 1 AS x", "SELECT type, name FROM sqlite_schema")
_script("pragma_table_info", "SELECT * FROM (VALUES (0, 'id', 'INT', 1, NULL, 1), (1, 'name', 'TEXT', 1, NULL, 0), (2, 'region', 'INT', 0, '7', 0), (3, 'note', 'TEXT', 0, NULL, 0)) t(cid, name, type, \"notnull\", dflt_value, pk)", _MAKE, "PRAGMA table_info(en)")
_script("audit_log", "SELECT CAST(2 AS BIGINT) AS n", _MAKE, "INSERT INTO en (id, name) VALUES (1, 'a')", "SELECT count(*) AS n FROM sys.audit WHERE statement LIKE 'CREATE TABLE en%' OR statement LIKE 'INSERT INTO en%'")


@_df("explain_statement", "SELECT true AS planned, true AS counted")
def _explain(spark, sf_dir):
    e = _engine(spark)
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    found = e.sql("EXPLAIN ANALYZE SELECT count(*) AS n FROM nation")
    return found.agg(F.max(F.col("plan").contains("Physical Plan")).alias("planned"), F.max(F.col("plan").startswith("1 rows in")).alias("counted"))


@_df("positional_parameters", "SELECT n_nationkey FROM nation WHERE n_nationkey > 5 AND n_name <> 'NATION_9'")
def _parameters(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return _engine(spark).sql("SELECT n_nationkey FROM nation WHERE n_nationkey > ? AND n_name <> ?", [5, "NATION_9"])


# the builder, functions of users, profiles, text of statements


@_df("builder_with", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT DISTINCT o_custkey FROM big JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 5")
def _builder_with(spark, sf_dir):
    for t in ("orders", "customer"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    b = select("o_custkey").distinct().with_("big", select("o_custkey", "o_totalprice").from_("orders").where("o_totalprice > 200000")).from_("big").join("customer", "o_custkey = c_custkey").where("c_nationkey < 5")
    return spark.sql(b.to_sql())


@_df("builder_dml", "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey = 4 THEN 'four' ELSE n_name END AS name FROM nation WHERE n_nationkey < 5 AND n_nationkey <> 2")
def _builder_dml(spark, sf_dir):
    e = _engine(spark)
    e.sql("CREATE TABLE bd (id INT, name TEXT)")
    rows = [(k, f"NATION_{k}") for k in range(5)]
    e.sql(insert_into("bd", ["id", "name"], rows))
    e.sql(update("bd", {"name": "four"}, "id = 4"))
    e.sql(delete_from("bd", "id = 2"))
    return e.sql("SELECT id, name FROM bd")


@_df("user_functions", "SELECT n_regionkey, CAST(n_regionkey * 2 AS BIGINT) AS twice, max(n_nationkey) - min(n_nationkey) AS spread FROM nation GROUP BY n_regionkey")
def _user_functions(spark, sf_dir):
    import pandas as pd

    from ..functions import register

    def spread(x: pd.Series) -> int:
        return int(x.max() - x.min())

    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    register.user_function(spark, "twice", lambda x: x * 2, "bigint")
    register.user_aggregate(spark, "spread", spread, "bigint")
    return spark.sql("SELECT n_regionkey, twice(n_regionkey) AS twice, CAST(spread AS INT) AS spread FROM (SELECT n_regionkey, spread(n_nationkey) AS spread FROM nation GROUP BY n_regionkey)")


@_df("user_table_function", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 6")
def _user_table_function(spark, sf_dir):
    from . import table_functions
    from .sql import Rewriter

    table_functions.register("first_numbers", lambda spark, n: spark.range(int(n)).select(F.col("id").cast("int").alias("k")))
    return spark.sql(Rewriter(spark).statement("SELECT k FROM FIRST_NUMBERS(6)"))


@_df("profile_columns", "SELECT * FROM (SELECT 'n_name' AS \"column\", 'string' AS type, count(*) AS rows, CAST(0 AS BIGINT) AS nulls, min(n_name) AS min, max(n_name) AS max FROM nation) UNION ALL SELECT 'n_regionkey', 'int', count(*), 0, '0', '4' FROM nation")
def _profile(spark, sf_dir):
    return profile(table(spark, sf_dir, "nation").select("n_name", "n_regionkey")).select("column", "type", "rows", "nulls", "min", "max")


@_df("profile_top_values", "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus ORDER BY n DESC, value LIMIT 2")
def _top(spark, sf_dir):
    return top_values(table(spark, sf_dir, "orders"), "o_orderstatus", 2)


@_df("sql_formatting", "SELECT 'select a, count(*) as n from t where x > 1 group by a' AS small, 4 AS lines, 't' AS tables, 'SELECT' AS kind")
def _formatting(spark, sf_dir):
    text = "select a,  count(*) as n -- comment\nfrom t /* y */ where x > 1\n group by a"
    found = analyse(text)
    return spark.createDataFrame([(minify(text), len(beautify(text).splitlines()), ",".join(found["tables"]), found["kind"])], "small string, lines int, tables string, kind string")



_script("vacuum", "SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey >= 5", _MAKE, _FILL, "CREATE MATERIALIZED VIEW mz AS SELECT count(*) AS n FROM en", "DELETE FROM en WHERE id < 5", "SELECT n FROM mz", "VACUUM", "SELECT id FROM en")


@_df("schema_context", "SELECT 'nation (' || (SELECT count(*) FROM nation) || ' rows): n_nationkey int, n_name string, n_regionkey int' AS line UNION ALL SELECT 'region (' || (SELECT count(*) FROM region) || ' rows): r_regionkey int, r_name string'")
def _context(spark, sf_dir):
    text = schema_context({t: table(spark, sf_dir, t) for t in ("nation", "region")})
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")
