"""Functions that no SQL expression gives: vectorised (Arrow) Python functions, one call per batch."""

from __future__ import annotations

import gzip
import json
import math
import random
import struct

import pandas as pd
from pyspark.sql.functions import pandas_udf

from . import fulltext, geometry


def _rows(returns: str, f, least: int, most: int | None = None):
    return returns, f, least, most or least


def build(name: str):
    """The pandas function of a name; null in a required argument gives null."""
    returns, f, least, _ = FUNCTIONS[name]

    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            out.append(None if any(x is None or isinstance(x, float) and math.isnan(x) for x in row[:least]) else f(*row))
        return pd.Series(out, dtype=object)

    return pandas_udf(run, returns)


def build_aggregate(name: str):
    """The pandas aggregate of a name; a window's rows are handed over once, not once a row."""
    returns, f = AGGREGATES[name]

    def run(*columns: pd.Series) -> list:
        return f(*columns)

    return pandas_udf(run, returns)


def _geo(f):
    return lambda g, *rest: f(geometry.load(g), *rest)


def _text(g) -> str | None:
    return None if g is None else json.dumps(g, separators=(",", ":"))


def _fnv(s: str) -> str:
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def _json_set(j: str, path: str, value) -> str:
    root = json.loads(j)
    at, keys = root, [int(k) if k.isdigit() else k for k in path.replace("[", ".").replace("]", "").split(".")]
    for k in keys[:-1]:
        at = at[k] if isinstance(at, list) else at.setdefault(k, {})
    if isinstance(at, list) and keys[-1] == len(at):
        at.append(value)
    else:
        at[keys[-1]] = value
    return json.dumps(root, separators=(",", ":"))


def _random_vector(n: int, seed: int) -> list[float]:
    r = random.Random(seed)
    v = [r.gauss(0, 1) for _ in range(int(n))]
    size = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / size for x in v]


def _breaks(values: pd.Series, classes: pd.Series) -> list[float]:
    from ..operators.relational import jenks

    return jenks(values.dropna(), int(classes.iloc[0]))


def _bytes(data) -> bytes:
    return data.encode() if isinstance(data, str) else bytes(data)


def _buffer(g, m, *segments):
    return geometry.dump("Polygon", geometry.buffer(geometry.load(g)["coordinates"], m, int(segments[0]) if segments else 32))


def _hull(g):
    ring = geometry.hull(geometry.points(geometry.load(g)))
    return geometry.dump("Polygon", [ring]) if len(ring) > 3 else geometry.dump("LineString", ring) if len(ring) == 2 else geometry.dump("Point", ring[0])


def _smooth(g, n):
    if not 0 <= n <= 8:
        raise ValueError("GEO_SMOOTH: 0 to 8 iterations")
    return _text(geometry.smooth(geometry.load(g), int(n)))


FUNCTIONS = {
    "json_set": _rows("string", _json_set, 2, 3),
    "fnv": _rows("string", _fnv, 1),
    "gzip": _rows("binary", lambda d: gzip.compress(_bytes(d), mtime=0), 1),
    "gunzip": _rows("string", lambda d: gzip.decompress(_bytes(d)).decode("utf-8", "replace"), 1),
    "vec_to_bytes": _rows("string", lambda v: struct.pack(f"<{len(v)}f", *v).hex(), 1),
    "vec_from_bytes": _rows("array<double>", lambda h: list(struct.unpack(f"<{len(h) // 8}f", bytes.fromhex(h))), 1),
    "vec_random": _rows("array<double>", _random_vector, 2),
    "fts_match": _rows("boolean", lambda t, q: fulltext.match(fulltext.parse(q), (k := fulltext.Bag(t)), k), 2),
    "fts_rank": _rows("double", lambda t, q: fulltext.score(fulltext.parse(q), fulltext.Bag(t)), 2),
    "fts_snippet": _rows("string", lambda t, q, *rest: fulltext.snippet(t, q, *rest), 2, 6),
    "fts_highlight": _rows("string", lambda t, q, *rest: fulltext.snippet(t, q, *rest, whole=True), 2, 4),
    "geo_within_polygon": _rows("boolean", lambda p, g: geometry.in_polygon(geometry.load(p)["coordinates"], geometry.load(g)), 2),
    "st_contains": _rows("boolean", lambda g, p: geometry.in_polygon(geometry.load(p)["coordinates"], geometry.load(g)), 2),
    "geo_polygon_area": _rows("double", _geo(geometry.area), 1),
    "geo_length": _rows("double", _geo(geometry.length), 1),
    "geo_buffer": _rows("string", _buffer, 2, 3),
    "geo_convex_hull": _rows("string", _hull, 1),
    "geo_line_interpolate": _rows("string", lambda g, f: geometry.dump("Point", geometry.interpolate(geometry.load(g)["coordinates"], f)), 2),
    "geo_intersects": _rows("boolean", lambda a, b: geometry.intersects(geometry.load(a), geometry.load(b)), 2),
    "geo_disjoint": _rows("boolean", lambda a, b: not geometry.intersects(geometry.load(a), geometry.load(b)), 2),
    "geo_equals": _rows("boolean", lambda a, b: geometry.canonical(geometry.load(a)) == geometry.canonical(geometry.load(b)), 2),
    "geo_simplify": _rows("string", lambda g, t, *m: _text(geometry.simplify(geometry.load(g), t, *m)), 2, 3),
    "geo_centroid": _rows("string", lambda g: geometry.dump("Point", geometry.centroid(geometry.load(g))), 1),
    "geo_affine": _rows("string", lambda g, *a: _text(geometry.affine(geometry.load(g), *a)), 5, 7),
    "geo_smooth": _rows("string", _smooth, 2),
    "geo_drop_holes": _rows("string", lambda g: _text(geometry.drop_holes(geometry.load(g))), 1),
    "geo_clean": _rows("string", lambda g: _text(geometry.clean(geometry.load(g))), 1),
    "geo_snap": _rows("string", lambda g, grid: _text(geometry.snap(geometry.load(g), grid)), 2),
    "geo_is_valid": _rows("boolean", _geo(geometry.is_valid), 1),
    "geo_clip": _rows("string", lambda g, b: _text(geometry.clip(geometry.load(g), geometry.load(b))), 2),
}
AGGREGATES = {"breaks": ("array<double>", _breaks)}
