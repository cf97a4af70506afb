"""Queries that write a supplied table in a format and read it back, with the SQL over the table as it was."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..sources import extensions, readers, writers
from ..streaming import windows
from .catalog_queries import _df, table

_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


def _folder(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/quillspark/files-{uuid.uuid4().hex[:12]}"


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_name").cast("string").alias("n_name"), F.col("n_regionkey").cast("long").alias("n_regionkey"))


def _round_trip(name: str, write, read, oracle: str = _NATION) -> None:
    @_df(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        write(_nation(spark, sf_dir), path)
        return _typed(read(spark, path))


_round_trip("io_csv", writers.write_csv, readers.read_csv)
_round_trip("io_csv_semicolon", lambda df, p: writers.write_csv(df, p, sep=";"), readers.read_csv)
_round_trip("io_tsv", writers.write_tsv, readers.read_tsv)
_round_trip("io_ndjson", writers.write_ndjson, readers.read_json)
_round_trip("io_json_array", lambda df, p: writers.write_json_array(df, f"{p}/a.json"), lambda spark, p: readers.read_json(spark, f"{p}/a.json"))
_round_trip("io_xml", writers.write_xml, lambda spark, p: readers.read_xml(spark, p, "row"))
_round_trip("io_parquet", writers.write_parquet, lambda spark, p: spark.read.parquet(p))
_round_trip("io_xlsx", lambda df, p: writers.write_xlsx(df, f"{p}/a.xlsx"), lambda spark, p: readers.read_xlsx(spark, f"{p}/a.xlsx"))
_round_trip("io_csv_gzip", lambda df, p: df.coalesce(1).write.csv(p, header=True, compression="gzip"), readers.read_csv)
_round_trip("io_csv_utf16", lambda df, p: df.coalesce(1).write.csv(p, header=True, encoding="UTF-16LE"), readers.read_csv)


def _text(spark: SparkSession, name: str, text: str) -> str:
    path = f"{_folder(spark)}/{name}"
    writers.put(spark, path, [text.encode()])
    return path


@_df("io_fuzzy_csv", "SELECT * FROM (VALUES (1, 'plain', 1.5), (2, 'say \"hi\" now', 2.5), (3, NULL, NULL), (4, 'short', NULL)) t(id, name, value)")
def _fuzzy_csv(spark, sf_dir):
    """A quote that is not closed, a value of the wrong type, a short row, a row that is no row."""
    path = _text(spark, "f.csv", 'id,name,value\n1,plain,1.5\n2,"say "hi" now",2.5\n3,,x\n4,short\n')
    return readers.read_fuzzy_csv(spark, path, "id int, name string, value double").select("id", "name", "value")


@_df("io_fuzzy_json", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'b'), (3, 'c')) t(id, name)")
def _fuzzy_json(spark, sf_dir):
    path = _text(spark, "f.jsonl", "{\"id\": 1, \"name\": \"a\"}\n{id: 2, 'name': 'b'}\n{\"id\": 03, /* odd */ \"name\": \"c\"}\n")
    return readers.read_fuzzy_json(spark, path).select("id", "name")


@_df("io_json_object", "SELECT CAST(7 AS BIGINT) AS id, 'solo' AS name")
def _json_object(spark, sf_dir):
    return readers.read_json(spark, _text(spark, "o.json", '{\n "id": 7,\n "name": "solo"\n}\n')).select("id", "name")


@_df("io_yaml", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'one', 1.5::DOUBLE, true, 'x, y'), (2, 'two', NULL, false, 'p')) t(id, name, size, ok, tags)")
def _yaml(spark, sf_dir):
    path = _text(spark, "a.yaml", "---\n# two rows\n- id: 1\n  name: \"one\"\n  size: 1.5\n  ok: true\n  tags: [x, y]\n- id: 2\n  name: two\n  size: null\n  ok: false\n  tags:\n    - p\n")
    return readers.read_yaml(spark, path).select("id", "name", "size", "ok", F.array_join(F.from_json("tags", "array<string>"), ", ").alias("tags"))


@_df("io_geojson", "SELECT n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, CAST(n_nationkey AS DOUBLE) AS lon FROM nation")
def _geojson(spark, sf_dir):
    path = f"{_folder(spark)}/a.geojson"
    writers.write_geojson(_nation(spark, sf_dir).select("n_name", "n_regionkey", F.expr("to_json(named_struct('type', 'Point', 'coordinates', array(CAST(n_nationkey AS DOUBLE), 1D)))").alias("geometry")), path)
    return readers.read_geojson(spark, path).select("n_name", "n_regionkey", F.get_json_object("geometry", "$.coordinates[0]").cast("double").alias("lon"))


@_df("io_topojson", "SELECT n_nationkey AS k, CAST(n_nationkey + 1 AS DOUBLE) AS east FROM nation")
def _topojson(spark, sf_dir):
    path = f"{_folder(spark)}/a.topojson"
    line = F.expr("to_json(named_struct('type', 'LineString', 'coordinates', array(array(0, 0), array(n_nationkey + 1, 1))))")
    writers.write_topojson(_nation(spark, sf_dir).select(F.col("n_nationkey").alias("k"), line.alias("geometry")), path)
    return readers.read_topojson(spark, path).select(F.col("k").cast("int").alias("k"), F.get_json_object("geometry", "$.coordinates[1][0]").cast("double").alias("east"))


@_df("io_kml", "SELECT * FROM (VALUES ('spot', 'Point', 7.5::DOUBLE), ('way', 'LineString', 1.0::DOUBLE), ('field', 'Polygon', 0.0::DOUBLE)) t(name, kind, x)")
def _kml(spark, sf_dir):
    marks = "".join(f"<Placemark><name>{n}</name>{g}</Placemark>" for n, g in (("spot", "<Point><coordinates>7.5,1</coordinates></Point>"), ("way", "<LineString><coordinates>1,2 3,4</coordinates></LineString>"), ("field", "<Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon>")))
    found = readers.read_kml(spark, _text(spark, "a.kml", f"<kml><Document>{marks}</Document></kml>"))
    first = F.regexp_extract(F.col("geometry"), r"\[+(-?[0-9.]+)", 1).cast("double")
    return found.select("name", F.get_json_object("geometry", "$.type").alias("kind"), first.alias("x"))


@_df("io_osm", "SELECT * FROM (VALUES (CAST(10 AS BIGINT), CAST(2 AS INT), 'road'), (11, 3, NULL)) t(way, points, highway)")
def _osm(spark, sf_dir):
    nodes = "".join(f'<node id="{k}" lat="{k}.5" lon="{k}"/>' for k in (1, 2, 3))
    path = _text(spark, "a.osm", f'<osm>{nodes}<way id="10"><nd ref="1"/><nd ref="2"/><tag k="highway" v="road"/></way><way id="11"><nd ref="1"/><nd ref="2"/><nd ref="3"/></way></osm>')
    nodes, ways = readers.read_osm(spark, path)
    held = ways.select("id", "tags", F.explode("nodes").alias("n")).join(nodes.select(F.col("id").alias("n")), "n")
    return held.groupBy(F.col("id").alias("way"), F.get_json_object("tags", "$.highway").alias("highway")).agg(F.count("*").cast("int").alias("points")).select("way", "points", "highway")


@_df("io_routing_graph", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(2 AS BIGINT), 1.5::DOUBLE), (2, 3, 2.0), (4, 5, 7.25)) t(source, target, cost)")
def _routing(spark, sf_dir):
    text = readers.read_routing_graph(spark, _text(spark, "g.txt", "# edges\n1 2 1.5\n2,3,2\n"))
    return text.union(readers.read_routing_graph(spark, _text(spark, "g.json", '{"source": 4, "target": 5, "cost": 7.25}\n')))


def _tiles(spark, sf_dir) -> DataFrame:
    return _nation(spark, sf_dir).select((F.col("n_regionkey") + 1).cast("int").alias("zoom_level"), F.col("n_nationkey").cast("int").alias("tile_column"), F.lit(0).alias("tile_row"), F.col("n_name").cast("binary").alias("tile_data"))


_TILES = "SELECT CAST(n_regionkey + 1 AS INT) AS zoom_level, CAST(n_nationkey AS INT) AS tile_column, 0 AS tile_row, n_name AS tile FROM nation"


@_df("io_mbtiles", _TILES)
def _mbtiles(spark, sf_dir):
    path = f"{_folder(spark)}/a.mbtiles"
    writers.write_mbtiles(_tiles(spark, sf_dir), path, {"name": "nations"})
    return readers.read_mbtiles(spark, path).select("zoom_level", "tile_column", "tile_row", F.col("tile_data").cast("string").alias("tile"))


@_df("io_tile_artifact", _TILES)
def _artifact(spark, sf_dir):
    path = _folder(spark)
    readers.tile_artifact(_tiles(spark, sf_dir), path)
    readers.check_tile_artifact(spark, path)
    return readers.read_tile_artifact(spark, path).select("zoom_level", "tile_column", "tile_row", F.col("tile_data").cast("string").alias("tile"))


@_df("io_shapefile", "SELECT * FROM (VALUES ('Point', 1.5::DOUBLE, 'a', 10.0::DOUBLE), ('Point', 2.5, 'b', 20.0)) t(kind, x, name, size)")
def _shapefile(spark, sf_dir):
    import struct

    points = [(1.5, 4.0, "a", 10), (2.5, 5.0, "b", 20)]
    records = b"".join(struct.pack(">ii", n + 1, 10) + struct.pack("<idd", 1, x, y) for n, (x, y, _, _) in enumerate(points))
    shp = struct.pack(">iiiiiii", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<iidddddddd", 1000, 1, 1.5, 4, 2.5, 5, 0, 0, 0, 0) + records
    field = lambda name, kind, size: name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([size, 0]) + b"\0" * 14
    rows = b"".join(b" " + n.encode().ljust(8) + str(v).rjust(6).encode() for _, _, n, v in points)
    dbf = struct.pack("<B3xIHH20x", 3, 2, 32 + 64 + 1, 15) + field("name", "C", 8) + field("size", "N", 6) + b"\r" + rows + b"\x1a"
    folder = _folder(spark)
    writers.put(spark, f"{folder}/p.shp", [shp])
    writers.put(spark, f"{folder}/p.dbf", [dbf])
    found = readers.read_shapefile(spark, f"{folder}/p.shp")
    return found.select(F.get_json_object("geometry", "$.type").alias("kind"), F.get_json_object("geometry", "$.coordinates[0]").cast("double").alias("x"), "name", F.col("size").cast("double").alias("size"))


@_df("io_sql_script", "SELECT 'INSERT INTO nation (n_nationkey, n_name) VALUES (' || n_nationkey || ', ''' || n_name || ''');' AS value FROM nation")
def _sql_script(spark, sf_dir):
    path = _folder(spark)
    writers.write_sql(_nation(spark, sf_dir).select("n_nationkey", "n_name"), path, "nation")
    return spark.read.text(path)


@_df("io_manifest", "SELECT count(*) AS rows, true AS same, false AS other FROM nation")
def _manifest(spark, sf_dir):
    df = _nation(spark, sf_dir)
    one, two, three = writers.manifest(df), writers.manifest(df.repartition(3)), writers.manifest(df.where("n_nationkey > 0"))
    return spark.createDataFrame([(one["rows"], one["sha256"] == two["sha256"], one["sha256"] == three["sha256"])], "rows long, same boolean, other boolean")


@_df("io_snapshot", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _snapshot(spark, sf_dir):
    path = _folder(spark)
    writers.save_snapshot(spark, {t: table(spark, sf_dir, t) for t in ("nation", "region")}, path)
    held = writers.load_snapshot(spark, path, ["nation", "region"])
    return held["nation"].join(held["region"], F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@_df("io_import_file", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey")
def _import(spark, sf_dir):
    path = f"{_folder(spark)}.csv"
    writers.write_csv(_nation(spark, sf_dir), path)
    readers.import_file(spark, path, "imported")
    return spark.sql("SELECT n_regionkey AS k, count(*) AS n FROM imported GROUP BY n_regionkey")


@_df("io_files_and_lines", "SELECT 2 AS files, CAST(5 AS BIGINT) AS lines, 'one' || chr(10) || 'two' || chr(10) AS text")
def _files(spark, sf_dir):
    folder = _folder(spark)
    writers.put(spark, f"{folder}/a.txt", [b"one\ntwo\n"])
    writers.put(spark, f"{folder}/b.txt", [b"x\ny\nz\n"])
    text = readers.file_text(spark, f"{folder}/a.txt", folder)
    return text.select(F.lit(readers.files(spark, folder).count()).cast("int").alias("files"), F.lit(readers.lines(spark, folder).count()).cast("long").alias("lines"), F.col("value").alias("text"))


@_df("io_table_functions", "SELECT c.id AS id, c.name AS name, j.size AS size FROM (VALUES (1, 'a'), (2, 'b')) c(id, name) JOIN (VALUES (CAST(1 AS BIGINT), CAST(5 AS BIGINT)), (2, 6)) j(id, size) ON c.id = j.id")
def _table_functions(spark, sf_dir):
    from .sql import Rewriter

    a, b = _text(spark, "c.csv", "id,name\n1,a\n2,b\n"), _text(spark, "j.jsonl", '{"id": 1, "size": 5}\n{"id": 2, "size": 6}\n')
    return spark.sql(Rewriter(spark).statement(f"SELECT c.id AS id, c.name AS name, j.size AS size FROM CSV_ROWS('{a}') c JOIN JSON_ROWS('{b}') j ON c.id = j.id"))


@_df("fn_file", "SELECT 'hello' || chr(10) AS t")
def _file(spark, sf_dir):
    from .sql import Rewriter

    path = _text(spark, "h.txt", "hello\n")
    readers.ALLOWED[:] = [path.rsplit("/", 1)[0]]
    return spark.sql(Rewriter(spark).statement(f"SELECT FILE('{path}') AS t"))


@_df("table_from_functions", "SELECT * FROM (VALUES ('lines', CAST(2 AS BIGINT)), ('xml', 2), ('csv', 2)) t(source, n)")
def _from(spark, sf_dir):
    found = [("lines", search.table_from_json_lines(spark, '{"a": 1}\n{"a": 2}').count()), ("xml", search.table_from_xml(spark, "<r><p><a>1</a></p><p><a>2</a></p></r>", "p").count()), ("csv", search.table_from_csv(spark, "a;b\n1;2\n3;4", sep=";").count())]
    return spark.createDataFrame(found, "source string, n long")


@_df("storage_extension", "SELECT CAST(n_nationkey * 2 AS BIGINT) AS k, 'part ' || n_nationkey % 3 AS part FROM nation WHERE n_nationkey < 12")
def _extension(spark, sf_dir):
    extensions.register(spark, "doubled", "k long, part string", lambda options: [0, 1, 2], lambda item, options: ((2 * n, f"part {item}") for n in range(int(options["most"])) if n % 3 == item))
    return spark.read.format("doubled").option("most", "12").load()


# streams over the same tables: each catches up with a folder and ends


@_df("stream_tumbling", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def _stream_tumbling(spark, sf_dir):
    events, folder = table(spark, sf_dir, "events"), _folder(spark)
    feed = windows.follow(spark, f"{sf_dir}/events.parquet*", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = windows.tumbling(feed, "ts", "1 hour", ["event_type"], [F.count("*").alias("n")], late="100 days").select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")
    return windows.result(counted, folder, "complete")


@_df("stream_view", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def _stream_view(spark, sf_dir):
    """A view kept by adding each batch's sums to its last version."""
    events, folder = table(spark, sf_dir, "events"), _folder(spark)
    halves = f"{folder}/feed"
    events.where("event_id % 2 = 0").write.parquet(f"{halves}/a")
    schema = "user_id long, n long, total double"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/view-0")
    state = {"at": 0}

    def apply(batch: DataFrame, number: int) -> None:
        held = batch.sparkSession.read.schema(schema).parquet(f"{folder}/view-{state['at']}")
        new = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        held.union(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).write.mode("overwrite").parquet(f"{folder}/view-{state['at'] + 1}")
        state["at"] += 1

    feed = windows.follow(spark, f"{halves}/*", events.schema)
    windows.maintain(feed, f"{folder}/checkpoint", apply).awaitTermination()
    events.where("event_id % 2 = 1").write.parquet(f"{halves}/b")
    windows.maintain(feed, f"{folder}/checkpoint", apply).awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/view-{state['at']}").select("user_id", "n", F.round("total", 4).alias("total"))


