"""Writers: distributed where the format is made of rows; single documents are written by the driver from an iterator."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import tempfile
import zipfile
from collections.abc import Callable, Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header, quote='"', escape='"')


def write_tsv(df: DataFrame, path: str) -> None:
    write_csv(df, path, sep="\t")


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_xml(df: DataFrame, path: str, row_tag: str = "row", root_tag: str = "rows") -> None:
    df.write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def sql_script(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement per row, as a column of text."""
    kinds = dict(df.dtypes)

    def literal(c: str):
        x, k = F.col(f"`{c}`"), kinds[c]
        if k == "binary":
            v = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
        elif k in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or k.startswith("decimal"):
            v = x.cast("string")
        else:
            v = F.concat(F.lit("'"), F.replace((x if k == "string" else F.to_json(x) if k.startswith(("array", "map", "struct")) else x.cast("string")), F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(v, F.lit("NULL"))

    names = ", ".join(df.columns)
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), F.concat_ws(", ", *map(literal, df.columns)), F.lit(");")).alias("value"))


def write_sql(df: DataFrame, path: str, table: str) -> None:
    sql_script(df, table).write.mode("overwrite").text(path)


def features(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """One GeoJSON feature per row, as a column of text."""
    rest = [c for c in df.columns if c != geom]
    properties = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(F.col(geom), F.lit("null")), F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array in a local file, row by row."""
    _document(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")), path, "[", "]")


def write_geojson(df: DataFrame, path: str, geom: str = "geometry") -> None:
    _document(features(df, geom), path, '{"type":"FeatureCollection","features":[', "]}")


def put(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> None:
    """Write one file through Hadoop's file system, so that any store will do; the driver holds a chunk at a time."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        for c in chunks:
            for at in range(0, len(c), 1 << 20):
                out.write(bytearray(c[at : at + (1 << 20)]))
    finally:
        out.close()


def _document(rows: DataFrame, path: str, head: str, tail: str) -> None:
    def chunks():
        held, size = [head], 0
        for k, r in enumerate(rows.toLocalIterator()):
            held.append(("," if k else "") + r[0])
            size += len(r[0])
            if size > 1 << 19:
                yield "".join(held).encode()
                held, size = [], 0
        yield "".join([*held, tail]).encode()

    put(rows.sparkSession, path, chunks())


def _from_local(spark: SparkSession, path: str, make: Callable[[str], None]) -> None:
    """Make a file in a folder of the driver's own and copy it to its place."""
    with tempfile.TemporaryDirectory() as folder:
        local = f"{folder}/file"
        make(local)
        with open(local, "rb") as f:
            put(spark, path, iter(lambda: f.read(1 << 20), b""))


def write_topojson(df: DataFrame, path: str, geom: str = "geometry", layer: str = "rows") -> None:
    """Lines and rings become arcs, each kept once whichever way it runs."""
    arcs: dict[tuple, int] = {}

    def arc(c) -> int:
        k = tuple(tuple(p[:2]) for p in c)
        if k[::-1] in arcs:
            return ~arcs[k[::-1]]
        return arcs.setdefault(k, len(arcs))

    shapes = []
    for r in df.toLocalIterator():
        row = r.asDict()
        g = json.loads(row.pop(geom))
        kind, c = g["type"], g["coordinates"]
        own = {"coordinates": c} if "Point" in kind else {"arcs": [arc(c)] if kind == "LineString" else [[arc(x)] for x in c] if kind in ("Polygon", "MultiLineString") else [[[arc(x)] for x in p] for p in c]}
        shapes.append({"type": kind, **own, "properties": row})
    text = json.dumps({"type": "Topology", "arcs": [list(map(list, a)) for a in arcs], "objects": {layer: {"type": "GeometryCollection", "geometries": shapes}}}, default=str)
    put(df.sparkSession, path, [text.encode()])


def write_xlsx(df: DataFrame, path: str) -> None:
    """One sheet with a header, values inline."""

    def name(k: int) -> str:
        out = ""
        k += 1
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(k: int, n: int, v) -> str:
        at = f"{name(k)}{n}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    # Fixed values of the format: the parts that a workbook of one sheet needs.
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    types = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
    relations = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/></Relationships>'
    book = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'

    def make(local: str) -> None:
        with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", head + types)
            z.writestr("_rels/.rels", head + relations.format(kind="officeDocument", target="xl/workbook.xml"))
            z.writestr("xl/workbook.xml", head + book)
            z.writestr("xl/_rels/workbook.xml.rels", head + relations.format(kind="worksheet", target="worksheets/sheet1.xml"))
            with z.open("xl/worksheets/sheet1.xml", "w") as f:
                f.write((head + sheet).encode())
                f.write(('<row r="1">' + "".join(cell(k, 1, c) for k, c in enumerate(df.columns)) + "</row>").encode())
                for n, r in enumerate(df.toLocalIterator(), 2):
                    f.write((f'<row r="{n}">' + "".join(cell(k, n, v) for k, v in enumerate(r)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")

    _from_local(df.sparkSession, path, make)


def write_mbtiles(tiles: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    def make(local: str) -> None:
        with sqlite3.connect(local) as db:
            db.execute("CREATE TABLE metadata (name text, value text)")
            db.execute("CREATE TABLE tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob)")
            db.executemany("INSERT INTO metadata VALUES (?, ?)", (metadata or {}).items())
            db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", ((r[0], r[1], r[2], bytes(r[3])) for r in tiles.select("zoom_level", "tile_column", "tile_row", "tile_data").toLocalIterator()))
            db.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")

    _from_local(tiles.sparkSession, path, make)


def manifest(df: DataFrame) -> dict:
    """Schema, row count, and a digest of the typed rows that does not depend on their order or place."""
    row = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(8)]
    r = df.select(row.alias("h")).agg(F.count("*").alias("n"), *parts).first()
    text = ",".join(str(r[f"s{k}"] or 0) for k in range(8))
    return {"schema": df.schema.jsonValue(), "rows": r["n"], "sha256": hashlib.sha256(text.encode()).hexdigest()}


def save_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
