"""Readers: Spark's own where there is one; small map, sheet and tile files are parsed on the driver."""

from __future__ import annotations

import csv as _csv
import gzip
import io
import json
import os
import re
import sqlite3
import struct
import tempfile
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry


def _head(spark: SparkSession, path: str, n: int = 64 * 1024) -> bytes:
    """The first bytes of a file, through Hadoop's file system so that any store will do."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        where = sorted((s.getPath() for s in fs.listStatus(where) if not s.getPath().getName().startswith(("_", "."))), key=lambda p: p.getName())[0]
    stream = fs.open(where)
    try:
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()
    return gzip.GzipFile(fileobj=io.BytesIO(data)).read1(n) if data[:2] == b"\x1f\x8b" else data


def whole(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes, for formats that the driver parses."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def encoding(head: bytes) -> str:
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "UTF-16"
    return "UTF-16LE" if head[1:40:2].count(0) > 8 else "UTF-16BE" if head[0:40:2].count(0) > 8 else "UTF-8"


def delimiter(text: str) -> str:
    """The separator whose count per line is most even and not zero."""
    lines = [x for x in text.splitlines()[:50] if x.strip()]
    best, found = (0.0, 0.0), ","
    for d in ",;\t|":
        counts = [len(next(_csv.reader([x], delimiter=d))) - 1 for x in lines]
        if counts and max(counts):
            usual = max(set(counts), key=counts.count)
            if usual and (counts.count(usual) / len(counts), usual) > best:
                best, found = (counts.count(usual) / len(counts), usual), d
    return found


def has_header(text: str, sep: str) -> bool:
    rows = list(_csv.reader(text.splitlines()[:20], delimiter=sep))
    if len(rows) < 2:
        return bool(rows) and not any(re.fullmatch(r"[-+.\d]+", c) for c in rows[0])
    number = lambda c: bool(re.fullmatch(r"\s*[-+]?\d+(\.\d+)?\s*", c))
    return not any(map(number, rows[0])) and len(set(rows[0])) == len(rows[0]) and (any(number(c) for r in rows[1:] for c in r) or all(re.fullmatch(r"[A-Za-z_][\w ]*", c) for c in rows[0]))


def read_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool | None = None, infer: bool = True) -> DataFrame:
    head = _head(spark, path)
    enc = encoding(head)
    text = head.decode(enc, "replace").lstrip("﻿")
    sep = sep or delimiter(text)
    header = has_header(text, sep) if header is None else header
    return spark.read.csv(path, sep=sep, header=header, inferSchema=infer, encoding=enc, multiLine=enc != "UTF-8", quote='"', escape='"')


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def read_fuzzy_csv(spark: SparkSession, path: str, schema: str, sep: str | None = None, header: bool = True) -> DataFrame:
    """Rows of the schema from lines that may be broken.

    A line is cut at separators outside quotes; a quote inside a field that is not
    followed by a separator stays as it is.  Fields that lack are null, those too many
    go, values that cannot be cast are null, and lines without any content are passed over.
    """
    sep = sep or delimiter(_head(spark, path).decode("utf-8", "replace"))
    s = re.escape(sep)
    lines = spark.read.text(path).where(F.trim("value") != "")
    if header:
        first = lines.first()
        lines = lines.where(F.col("value") != (first[0] if first else ""))
    # a field: quoted up to a quote before a separator or the end, or anything without a separator
    fields = F.regexp_extract_all(F.concat(F.lit(sep), F.col("value")), F.lit(rf'{s}(\s*"(?:[^"]|"(?!\s*(?:{s}|$)))*"\s*(?={s}|$)|[^{s}]*)'), F.lit(1))
    plain = F.transform(fields, lambda f: F.when(F.trim(f).rlike('^".*"$'), F.replace(F.regexp_replace(F.trim(f), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.trim(f)))
    kinds = [(f.name, f.dataType) for f in spark.createDataFrame([], schema).schema]
    return lines.select(plain.alias("f")).select(*(F.nullif(F.get("f", F.lit(k)), F.lit("")).try_cast(kind).alias(name) for k, (name, kind) in enumerate(kinds)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array, an object, or one object to a line."""
    first = _head(spark, path, 4096).lstrip()
    lines = first.startswith(b"{") and bool(re.match(rb"\{[^\n]*\}\s*(\n\s*\{|$)", first))
    return spark.read.json(path, multiLine=not lines)


def read_fuzzy_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("allowNumericLeadingZeros", True).json(path, mode="PERMISSIVE", allowComments=True, allowUnquotedFieldNames=True, allowSingleQuotes=True, allowBackslashEscapingAnyCharacter=True)


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of scalars to a DataFrame; columns in order of appearance, types by the values."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not names:
        return spark.createDataFrame([], "value string")

    def kind(n: str) -> str:
        own = {type(r[n]) for r in rows if r.get(n) is not None}
        return "bigint" if own == {int} else "double" if own and own <= {int, float} else "boolean" if own == {bool} else "string"

    kinds = {n: kind(n) for n in names}
    cast = {"bigint": int, "double": float, "boolean": bool, "string": lambda v: v if isinstance(v, str) else json.dumps(v)}
    return spark.createDataFrame([tuple(None if r.get(n) is None else cast[kinds[n]](r[n]) for n in names) for r in rows], ", ".join(f"`{n}` {kinds[n]}" for n in names))


def scalar(text: str | None):
    """A value from text: number, truth value, null or the text itself."""
    if text is None or text.strip() in ("", "null", "~"):
        return None
    t = text.strip()
    if re.fullmatch(r"[-+]?\d+", t):
        return int(t)
    if re.fullmatch(r"[-+]?\d*\.\d+([eE][-+]?\d+)?", t):
        return float(t)
    return t == "true" if t in ("true", "false") else t.strip("'\"")


def _flow(text: str):
    """A YAML value on one line: [a, b], {k: v}, a quoted text or a scalar."""
    t = text.strip()
    if t[:1] in "[{" and t:
        parts, depth, now, quote = [], 0, "", ""
        for c in t[1:-1]:
            quote = "" if c == quote else c if not quote and c in "'\"" else quote
            depth += (c in "[{") - (c in "]}") if not quote else 0
            if c == "," and depth == 0 and not quote:
                parts.append(now)
                now = ""
            else:
                now += c
        parts += [now] if now.strip() else []
        if t[0] == "[":
            return [_flow(p) for p in parts]
        return {k.strip().strip("'\""): _flow(v) for k, _, v in (p.partition(":") for p in parts)}
    if t[:1] in "'\"" and len(t) > 1 and t[-1] == t[0]:
        return t[1:-1]
    return scalar(re.sub(r"\s#.*$", "", t))


def parse_yaml(text: str):
    """Block and flow mappings, sequences and scalars, the part of YAML that tables are written in."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#") and x.strip() not in ("---", "...")]

    def block(at: int, indent: int):
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out = []
            while at < len(lines) and lines[at][0] == indent and (lines[at][1].startswith("- ") or lines[at][1] == "-"):
                rest = lines[at][1][1:].strip()
                inner = indent + len(lines[at][1]) - len(lines[at][1][1:].lstrip())
                if re.match(r"[^\[{'\"][^:]*:(\s|$)", rest):
                    lines[at] = (inner, rest)
                    value, at = block(at, inner)
                elif rest:
                    value, at = _flow(rest), at + 1
                else:
                    value, at = block(at + 1, lines[at + 1][0])
                out.append(value)
            return out, at
        found = {}
        while at < len(lines) and lines[at][0] == indent and not lines[at][1].startswith("- "):
            k, _, v = lines[at][1].partition(":")
            k, v = k.strip().strip("'\""), v.strip()
            if v and not v.startswith("#"):
                found[k], at = _flow(v), at + 1
            elif at + 1 < len(lines) and (lines[at + 1][0] > indent or lines[at + 1][0] == indent and lines[at + 1][1].startswith("- ")):
                found[k], at = block(at + 1, lines[at + 1][0])
            else:
                found[k], at = None, at + 1
        return found, at

    return block(0, lines[0][0])[0] if lines else []


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """A list of mappings, or one of them; values that are lists or mappings become JSON text."""
    found = parse_yaml(whole(spark, path).decode())
    return _frame(spark, [r if isinstance(r, dict) else {"value": r} for r in (found if isinstance(found, list) else [found])])


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    with zipfile.ZipFile(io.BytesIO(whole(spark, path))) as z:
        ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", ns)) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)] if "xl/sharedStrings.xml" in z.namelist() else []
        table = []
        for row in ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iterfind(".//m:row", ns):
            cells: dict[int, object] = {}
            for c in row.iterfind("m:c", ns):
                at = 0
                for ch in re.match("[A-Z]+", c.get("r", "A"))[0]:
                    at = at * 26 + ord(ch) - 64
                v, inline = c.find("m:v", ns), c.find(".//m:t", ns)
                cells[at - 1] = shared[int(v.text)] if c.get("t") == "s" else inline.text if inline is not None else (v.text == "1" if c.get("t") == "b" else scalar(v.text)) if v is not None else None
            table.append(cells)
    names = [str(table[0].get(k, f"col_{k}")) for k in range(max(table[0]) + 1)]
    return _frame(spark, [{n: r.get(k) for k, n in enumerate(names)} for r in table[1:]])


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: its properties and geometry, as text."""
    raw = spark.read.text(path, wholetext=True)
    features = raw.select(F.explode(F.from_json("value", "features array<string>")["features"]).alias("f"))
    flat = features.select(F.get_json_object("f", "$.geometry").alias("geometry"), F.get_json_object("f", "$.properties").alias("p"))
    keys = [r[0] for r in flat.select(F.explode(F.json_object_keys("p"))).distinct().orderBy("col").collect()]
    return flat.select(*(F.get_json_object("p", f"$['{k}']").alias(k) for k in keys), "geometry")


def read_topojson(spark: SparkSession, path: str) -> DataFrame:
    topo = json.loads(whole(spark, path))
    t = topo.get("transform")
    arcs = []
    for arc in topo["arcs"]:
        x = y = 0
        out = []
        for p in arc:
            x, y = (x + p[0], y + p[1]) if t else p[:2]
            out.append([x * t["scale"][0] + t["translate"][0], y * t["scale"][1] + t["translate"][1]] if t else [x, y])
        arcs.append(out)

    def line(refs) -> list:
        out: list = []
        for r in refs:
            a = arcs[r] if r >= 0 else arcs[~r][::-1]
            out += a[1:] if out else a
        return out

    rows = []
    for name, obj in topo["objects"].items():
        for g in obj.get("geometries", [obj]):
            kind = g["type"]
            c = g.get("coordinates") if "Point" in kind else line(g["arcs"]) if kind == "LineString" else [line(r) for r in g["arcs"]] if kind in ("Polygon", "MultiLineString") else [[line(r) for r in p] for p in g["arcs"]]
            rows.append({"layer": name, **g.get("properties", {}), "geometry": geometry.dump(kind, c)})
    return _frame(spark, rows)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    rows = []
    for mark in (e for e in ET.fromstring(whole(spark, path)).iter() if e.tag.endswith("Placemark")):
        get = lambda tag: next((e for e in mark.iter() if e.tag.endswith(tag)), None)  # noqa: B023, E731
        kind = next((k for k in ("Polygon", "LineString", "Point") if get(k) is not None), None)
        rings = [[[float(x) for x in p.split(",")[:2]] for p in e.text.split()] for e in mark.iter() if e.tag.endswith("coordinates")]
        shape = None if kind is None else geometry.dump(kind, rings[0][0] if kind == "Point" else rings[0] if kind == "LineString" else rings)
        rows.append({"name": getattr(get("name"), "text", None), "description": getattr(get("description"), "text", None), "geometry": shape})
    return _frame(spark, rows)


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways)."""
    root = ET.fromstring(whole(spark, path))
    tags = lambda e: json.dumps({t.get("k"): t.get("v") for t in e.iter("tag")})
    nodes = [(int(e.get("id")), float(e.get("lat")), float(e.get("lon")), tags(e)) for e in root.iter("node")]
    ways = [(int(e.get("id")), [int(n.get("ref")) for n in e.iter("nd")], tags(e)) for e in root.iter("way")]
    return spark.createDataFrame(nodes, "id long, lat double, lon double, tags string"), spark.createDataFrame(ways, "id long, nodes array<bigint>, tags string")


def read_routing_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges (source, target, cost) from lines of text or JSON."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    if raw.first()[0].lstrip().startswith("{"):
        return spark.read.json(path).select(F.col("source").cast("long"), F.col("target").cast("long"), F.col("cost").cast("double"))
    p = F.split(F.trim("value"), r"[\s,;]+")
    return raw.where(~F.col("value").startswith("#")).select(p[0].cast("long").alias("source"), p[1].cast("long").alias("target"), p[2].cast("double").alias("cost"))


def read_mbtiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of a SQLite file, which the driver reads."""
    with tempfile.TemporaryDirectory() as folder:
        local = f"{folder}/tiles"
        with open(local, "wb") as f:
            f.write(whole(spark, path))
        with sqlite3.connect(local) as db:
            rows = [(z, x, y, bytearray(d)) for z, x, y, d in db.execute("SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles")]
    return spark.createDataFrame(rows, "zoom_level int, tile_column int, tile_row int, tile_data binary")


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Points, lines and polygons of a shapefile (or a zip with one) with the columns of its dBASE table."""
    data = whole(spark, path)
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = {n.lower().rsplit(".", 1)[-1]: n for n in z.namelist()}
            data, table = z.read(names["shp"]), z.read(names["dbf"])
    else:
        table = whole(spark, re.sub(r"(?i)\.shp$", ".dbf", path))
    shapes, at = [], 100
    while at + 8 <= len(data):
        size = 2 * struct.unpack(">i", data[at + 4 : at + 8])[0]
        shapes.append(_shape(data[at + 8 : at + 8 + size]))
        at += 8 + size
    count, head, width = struct.unpack("<IHH", table[4:12])
    fields = []
    for k in range(32, head - 1, 32):
        if table[k] == 13:
            break
        fields.append((table[k : k + 11].split(b"\0")[0].decode("latin-1"), chr(table[k + 11]), table[k + 16]))
    rows = []
    for n, shape in zip(range(count), shapes, strict=False):
        record, place, row = table[head + n * width : head + (n + 1) * width], 1, {}
        for name, kind, size in fields:
            text = record[place : place + size].decode("utf-8", "replace").strip()
            place += size
            row[name] = scalar(text) if kind in "NF" else (text in "TtYy" if text and text != "?" else None) if kind == "L" else text or None
        if record[:1] != b"*":
            rows.append({**row, "geometry": shape})
    return _frame(spark, rows)


def _shape(record: bytes) -> str | None:
    """A shapefile record as GeoJSON; heights and measures go."""
    kind = struct.unpack("<i", record[:4])[0] % 10
    if kind == 1:
        return geometry.dump("Point", list(struct.unpack("<dd", record[4:20])))
    if kind == 8:
        n = struct.unpack("<i", record[36:40])[0]
        return geometry.dump("MultiPoint", [list(struct.unpack("<dd", record[40 + 16 * k : 56 + 16 * k])) for k in range(n)])
    if kind not in (3, 5):
        return None
    parts, n = struct.unpack("<ii", record[36:44])
    starts = [*struct.unpack(f"<{parts}i", record[44 : 44 + 4 * parts]), n]
    points = [list(struct.unpack("<dd", record[44 + 4 * parts + 16 * k :][:16])) for k in range(n)]
    lines = [points[a:z] for a, z in zip(starts, starts[1:], strict=False)]
    if kind == 3:
        return geometry.dump("LineString", lines[0]) if len(lines) == 1 else geometry.dump("MultiLineString", lines)
    turn = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))
    polygons: list[list] = []
    for ring in lines:  # outer rings run clockwise, holes follow their outer ring
        if turn(ring) <= 0 or not polygons:
            polygons.append([ring])
        else:
            polygons[-1].append(ring)
    return geometry.dump("Polygon", polygons[0]) if len(polygons) == 1 else geometry.dump("MultiPolygon", polygons)


def tile_artifact(tiles: DataFrame, path: str) -> None:
    """Tiles as Parquet by zoom level, sorted so that row groups narrow a look-up."""
    tiles.repartitionByRange("zoom_level", "tile_column", "tile_row").sortWithinPartitions("zoom_level", "tile_column", "tile_row").write.mode("overwrite").partitionBy("zoom_level").parquet(path)


def check_tile_artifact(spark: SparkSession, path: str) -> None:
    """Raise if the table lacks a column, or a tile is there twice or out of its zoom level's range."""
    df = spark.read.parquet(path)
    if lacks := {"zoom_level", "tile_column", "tile_row", "tile_data"} - set(df.columns):
        raise ValueError(f"{path} lacks {sorted(lacks)}")
    keys = ["zoom_level", "tile_column", "tile_row"]
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{path} has a tile twice")
    if not df.where("tile_column < 0 OR tile_row < 0 OR zoom_level NOT BETWEEN 0 AND 30").isEmpty():
        raise ValueError(f"{path} has a tile out of range")


def read_tile_artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("path", F.input_file_name())


#: Folders below which FILE may read, and whether HTTP may fetch; none and no until they are set.
ALLOWED: list[str] = []
HTTP_ALLOWED = [False]


def file_text(spark: SparkSession, path: str, allowed: str | None = None) -> DataFrame:
    """FILE(path) as a source; only below a folder that is allowed."""
    plain = lambda p: os.path.normpath(re.sub("^file:/*", "/", p))
    if not any(plain(path).startswith(plain(a) + "/") for a in ([allowed] if allowed else ALLOWED)):
        raise PermissionError(f"{path} is not below a folder that is allowed")
    return spark.read.text(path, wholetext=True)


def http_text(spark: SparkSession, url: str) -> DataFrame:
    """HTTP(url) as a source of one row; off until ``HTTP_ALLOWED`` says otherwise."""
    from urllib.request import urlopen

    if not HTTP_ALLOWED[0] or not url.startswith(("http://", "https://")):
        raise PermissionError("HTTP is off")
    with urlopen(url, timeout=30) as f:
        return spark.createDataFrame([(f.read().decode("utf-8", "replace"),)], "value string")


READERS = {".csv": read_csv, ".tsv": read_tsv, ".json": read_json, ".jsonl": read_json, ".ndjson": read_json, ".yaml": read_yaml, ".yml": read_yaml, ".xlsx": read_xlsx, ".geojson": read_geojson, ".topojson": read_topojson, ".kml": read_kml, ".mbtiles": read_mbtiles, ".shp": read_shapefile, ".zip": read_shapefile}


def import_file(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """Read by the name's extension (a trailing .gz aside), and name a view for it if asked."""
    ext = os.path.splitext(path.removesuffix(".gz"))[1].lower()
    df = spark.read.parquet(path) if ext == ".parquet" else READERS[ext](spark, path)
    if view:
        df.createOrReplaceTempView(view)
    return df
