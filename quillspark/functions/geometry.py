"""Plane and spherical geometry on GeoJSON values, for the vectorised functions."""

from __future__ import annotations

import json
import math
from functools import lru_cache

RADIUS = 6_371_000.0


_parsed = lru_cache(maxsize=512)(json.loads)  # a constant polygon is parsed once, not for each row; nothing here changes what it gets


def load(g):
    if g is None:
        return None
    if isinstance(g, str):
        g = _parsed(g)
    return g["geometry"] if g.get("type") == "Feature" else g


def dump(kind: str, coordinates) -> str:
    return json.dumps({"type": kind, "coordinates": coordinates}, separators=(",", ":"))


def points(g) -> list:
    kind = g["type"]
    if kind == "GeometryCollection":
        return [p for x in g["geometries"] for p in points(x)]
    c = g["coordinates"]
    depth = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}[kind]
    flat = [c]
    for _ in range(depth):
        flat = [p for x in flat for p in x]
    return flat


def polygons(g) -> list:
    return [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"] if g["type"] == "MultiPolygon" else []


def lines(g) -> list:
    """Lines of a geometry, with the rings of polygons."""
    return {"LineString": lambda c: [c], "MultiLineString": list, "Polygon": list, "MultiPolygon": lambda c: [r for p in c for r in p]}.get(g["type"], lambda c: [])(g["coordinates"])


def mapped(g, f):
    """The geometry with every position changed by ``f``."""

    def walk(c):
        return f(c) if c and isinstance(c[0], (int, float)) else [walk(x) for x in c]

    return {"type": g["type"], "coordinates": walk(g["coordinates"])}


def bbox(g) -> list[float]:
    ps = points(g)
    xs, ys = [p[0] for p in ps], [p[1] for p in ps]
    return [min(xs), min(ys), max(xs), max(ys)]


def haversine(p, q) -> float:
    a, b = math.radians(p[1]), math.radians(q[1])
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def in_ring(p, ring) -> bool:
    x, y, inside = p[0], p[1], False
    for (x1, y1, *_), (x2, y2, *_) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def in_polygon(p, g) -> bool:
    return any(in_ring(p, poly[0]) and not any(in_ring(p, hole) for hole in poly[1:]) for poly in polygons(g))


def ring_area(ring) -> float:
    total = 0.0
    for p, q in zip(ring, [*ring[1:], ring[0]], strict=True):
        total += math.radians(q[0] - p[0]) * (2 + math.sin(math.radians(p[1])) + math.sin(math.radians(q[1])))
    return abs(total * RADIUS * RADIUS / 2)


def area(g) -> float:
    return sum(ring_area(poly[0]) - sum(map(ring_area, poly[1:])) for poly in polygons(g))


def length(g) -> float:
    return sum(haversine(p, q) for line in lines(g) for p, q in zip(line, line[1:], strict=False))


def destination(p, bearing: float, metres: float) -> list[float]:
    d, b, lat, lon = metres / RADIUS, math.radians(bearing), math.radians(p[1]), math.radians(p[0])
    lat2 = math.asin(math.sin(lat) * math.cos(d) + math.cos(lat) * math.sin(d) * math.cos(b))
    lon2 = lon + math.atan2(math.sin(b) * math.sin(d) * math.cos(lat), math.cos(d) - math.sin(lat) * math.sin(lat2))
    return [(math.degrees(lon2) + 540) % 360 - 180, math.degrees(lat2)]


def buffer(p, metres: float, segments: int = 32) -> list:
    ring = [destination(p, 360.0 * k / segments, metres) for k in range(segments)]
    return [[*ring, ring[0]]]


def hull(ps) -> list:
    ps = sorted({(p[0], p[1]) for p in ps})
    if len(ps) < 3:
        return [list(p) for p in ps]

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(ps) + half(reversed(ps))
    return [list(p) for p in [*ring, ring[0]]]


def interpolate(line, fraction: float) -> list[float]:
    sizes = [haversine(p, q) for p, q in zip(line, line[1:], strict=False)]
    left = max(0.0, min(1.0, fraction)) * sum(sizes)
    for p, q, s in zip(line, line[1:], sizes, strict=False):
        if left <= s and s:
            return [a + (b - a) * left / s for a, b in zip(p[:2], q[:2], strict=True)]
        left -= s
    return list(line[-1][:2])


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(a, b, p) -> bool:
    return _turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def segments_cross(a, b, c, d) -> bool:
    if _turn(a, b, c) * _turn(a, b, d) < 0 and _turn(c, d, a) * _turn(c, d, b) < 0:
        return True
    return _on(a, b, c) or _on(a, b, d) or _on(c, d, a) or _on(c, d, b)


def intersects(a, b) -> bool:
    la, lb = lines(a), lines(b)
    for one, two in ((a, b), (b, a)):
        for p in points(one) if not lines(one) else [line[0] for line in lines(one)]:
            if polygons(two) and in_polygon(p, two):
                return True
            if any(_on(x, y, p) for line in lines(two) for x, y in zip(line, line[1:], strict=False)):
                return True
    if not la and not lb:
        return bool({tuple(p[:2]) for p in points(a)} & {tuple(p[:2]) for p in points(b)})
    return any(segments_cross(p, q, r, s) for x in la for p, q in zip(x, x[1:], strict=False) for y in lb for r, s in zip(y, y[1:], strict=False))


def canonical(g):
    """A form that does not depend on where a ring begins or which way it runs."""

    def ring(r):
        r = [tuple(p[:2]) for p in r]
        r = r[:-1] if r[0] == r[-1] else r
        return min(tuple(s[k:] + s[:k]) for s in (r, r[::-1]) for k in range(len(s)))

    kind = g["type"]
    if kind in ("Polygon", "MultiPolygon"):
        return kind, tuple(sorted((ring(p[0]), tuple(sorted(map(ring, p[1:])))) for p in polygons(g)))
    if kind in ("LineString", "MultiLineString"):
        return kind, tuple(sorted(min(tuple(map(tuple, x)), tuple(map(tuple, x[::-1]))) for x in lines(g)))
    return kind, tuple(sorted(tuple(p[:2]) for p in points(g)))


def simplify_line(line, tolerance: float) -> list:
    """Douglas and Peucker's method, without recursion."""
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        (x1, y1), (x2, y2) = line[a][:2], line[b][:2]
        size = math.hypot(x2 - x1, y2 - y1)
        best, at = -1.0, -1
        for k in range(a + 1, b):
            x, y = line[k][:2]
            d = abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / size if size else math.hypot(x - x1, y - y1)
            if d > best:
                best, at = d, k
        if best > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [line[k] for k in sorted(keep)]


def visvalingam(line, least: float) -> list:
    line = list(line)
    while len(line) > 2:
        areas = [abs(_turn(line[k - 1], line[k], line[k + 1])) / 2 for k in range(1, len(line) - 1)]
        k = min(range(len(areas)), key=areas.__getitem__)
        if areas[k] >= least:
            break
        line.pop(k + 1)
    return line


def _per_line(g, f):
    c = g["coordinates"]
    depth = {"LineString": 0, "MultiLineString": 1, "Polygon": 1, "MultiPolygon": 2}.get(g["type"])
    if depth is None:
        return g

    def walk(x, d):
        return f(x) if d == 0 else [walk(y, d - 1) for y in x]

    return {"type": g["type"], "coordinates": walk(c, depth)}


def simplify(g, tolerance: float, method: str = "dp"):
    closed = g["type"] in ("Polygon", "MultiPolygon")
    cut = simplify_line if method == "dp" else visvalingam

    def one(line):
        out = cut(line, tolerance)
        return line if closed and len(out) < 4 else out

    return _per_line(g, one)


def smooth(g, rounds: int):
    closed = g["type"] in ("Polygon", "MultiPolygon")

    def one(line):
        for _ in range(rounds):
            out = [] if closed else [line[0]]
            for p, q in zip(line, line[1:], strict=False):
                out.append([0.75 * a + 0.25 * b for a, b in zip(p[:2], q[:2], strict=True)])
                out.append([0.25 * a + 0.75 * b for a, b in zip(p[:2], q[:2], strict=True)])
            line = [*out, out[0]] if closed else [*out, line[-1]]
        return line

    return _per_line(g, one)


def centroid(g) -> list[float]:
    sx = sy = weight = 0.0
    for poly in polygons(g):
        for n, ring in enumerate(poly):
            a = cx = cy = 0.0
            for (x1, y1, *_), (x2, y2, *_) in zip(ring, ring[1:], strict=False):
                c = x1 * y2 - x2 * y1
                a, cx, cy = a + c, cx + (x1 + x2) * c, cy + (y1 + y2) * c
            if a:
                w = abs(a / 2) * (1 if n == 0 else -1)
                sx, sy, weight = sx + w * cx / (3 * a), sy + w * cy / (3 * a), weight + w
    if not weight:
        for line in lines(g):
            for p, q in zip(line, line[1:], strict=False):
                w = math.hypot(q[0] - p[0], q[1] - p[1])
                sx, sy, weight = sx + w * (p[0] + q[0]) / 2, sy + w * (p[1] + q[1]) / 2, weight + w
    if not weight:
        ps = points(g)
        return [sum(p[0] for p in ps) / len(ps), sum(p[1] for p in ps) / len(ps)]
    return [sx / weight, sy / weight]


def affine(g, dx, dy, scale, degrees, ax=None, ay=None):
    if ax is None:
        box = bbox(g)
        ax, ay = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return mapped(g, lambda p: [ax + scale * (c * (p[0] - ax) - s * (p[1] - ay)) + dx, ay + scale * (s * (p[0] - ax) + c * (p[1] - ay)) + dy])


def drop_holes(g):
    return {"type": g["type"], "coordinates": g["coordinates"][:1] if g["type"] == "Polygon" else [p[:1] for p in g["coordinates"]] if g["type"] == "MultiPolygon" else g["coordinates"]}


def clean(g):
    """Without repeated neighbours, and with closed rings."""
    closed = g["type"] in ("Polygon", "MultiPolygon")

    def one(line):
        out = [p for k, p in enumerate(line) if k == 0 or p != line[k - 1]]
        return [*out, out[0]] if closed and out and out[0] != out[-1] else out

    return _per_line(g, one)


def snap(g, grid: float):
    return mapped(g, lambda p: [round(x / grid) * grid for x in p])


def is_valid(g) -> bool:
    try:
        kind, c = g["type"], g["coordinates"]
        if not all(math.isfinite(x) for p in points(g) for x in p[:2]):
            return False
        if kind == "LineString":
            return len(c) > 1
        return all(len(r) > 3 and r[0] == r[-1] for poly in polygons(g) for r in poly)
    except (KeyError, TypeError, IndexError, ValueError):
        return False


def clip(g, boundary):
    """Sutherland and Hodgman's method; the boundary must be a convex polygon."""
    ring = polygons(boundary)[0][0]
    ring = ring[:-1] if ring[0] == ring[-1] else ring
    if sum(_turn(ring[0], p, q) for p, q in zip(ring[1:], ring[2:], strict=False)) < 0:
        ring = ring[::-1]
    out = []
    for poly in polygons(g):
        held = poly[0][:-1]
        for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
            new = []
            for p, q in zip(held, [*held[1:], *held[:1]], strict=True):
                tp, tq = _turn(a, b, p), _turn(a, b, q)
                if tp >= 0:
                    new.append(p)
                if tp * tq < 0:
                    t = tp / (tp - tq)
                    new.append([p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])])
            held = new
        if len(held) > 2:
            out.append([[*held, held[0]]])
    return None if not out else {"type": "Polygon", "coordinates": out[0]} if len(out) == 1 else {"type": "MultiPolygon", "coordinates": out}


def edges(g, grid: float = 0.0) -> list[tuple[float, float, float, float, int]]:
    """Edges of polygons with the inside on their left: ends in order, and 1 or -1 for along or against."""
    out = []
    for poly in polygons(g):
        for n, r in enumerate(poly):
            r = [tuple(float(round(x / grid) * grid if grid else x) for x in p[:2]) for p in r]
            turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))
            r = r[::-1] if (turn < 0) == (n == 0) else r
            for a, b in zip(r, r[1:], strict=False):
                if a != b:
                    out.append((*a, *b, 1) if a < b else (*b, *a, -1))
    return out


def outline(found: dict[tuple, int]) -> str | None:
    """Directed edges, with how often each is there, joined to rings and those to polygons."""
    after: dict[tuple, list] = {}
    for (a, b), n in sorted(found.items()):
        after.setdefault(a, []).extend([b] * n)
    outer, holes = [], []
    while any(after.values()):
        start = min(a for a, to in after.items() if to)
        ring = [start]
        while len(ring) == 1 or ring[-1] != start:
            ring.append(after[ring[-1]].pop())
        turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
        (outer if turn > 0 else holes).append([list(p) for p in ring])
    polys = [[r] for r in outer]
    for h in holes:
        next((p for p in polys if in_ring(h[0], p[0])), polys[0] if polys else []).append(h)
    if not polys:
        return None
    return dump("Polygon", polys[0]) if len(polys) == 1 else dump("MultiPolygon", polys)


def dissolve(geometries, grid: float = 0.0) -> str | None:
    """Union of adjoining polygons: edges that two of them share go, the rest is joined to rings."""
    net: dict[tuple, int] = {}
    for g in geometries:
        for ax, ay, bx, by, n in edges(g, grid):
            net[(ax, ay), (bx, by)] = net.get(((ax, ay), (bx, by)), 0) + n
    return outline({(a, b) if n > 0 else (b, a): abs(n) for (a, b), n in net.items() if n})
