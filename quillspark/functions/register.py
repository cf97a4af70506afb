"""Finding a function by its name: Spark's own, one with an SQL body, or a vectorised Python one.

``fn(spark, name, *columns)`` builds a Column; ``sql_call(spark, name, args)``
gives the SQL text of a call.  Functions are registered when they are first
asked for, under ``q_<name>``, so none of Spark's own is hidden.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import python_functions
from .definitions import ALIASES, DEFINITIONS

#: Functions of any number or kind of arguments, as SQL text over their arguments.
MACROS = {
    "concat": lambda a: f"concat_ws('', {', '.join(a)})",
    "if": lambda a: f"CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END",
    "isnull": lambda a: f"(({a[0]}) IS NULL)",
    "typeof": lambda a: f"CASE WHEN ({a[0]}) IS NULL THEN 'null' WHEN typeof({a[0]}) IN ('tinyint', 'smallint', 'int', 'bigint') THEN 'integer' WHEN typeof({a[0]}) IN ('float', 'double') OR typeof({a[0]}) LIKE 'decimal%' THEN 'real' WHEN typeof({a[0]}) = 'boolean' THEN 'boolean' WHEN typeof({a[0]}) LIKE 'timestamp%' OR typeof({a[0]}) = 'date' THEN 'datetime' WHEN typeof({a[0]}) = 'string' THEN 'text' ELSE 'json' END",
    "version": lambda a: "'quillspark 0.1.0'",
    "locate": lambda a: f"locate({a[0]}, {a[1]})",
    "position": lambda a: f"position({', '.join(a)})",
    "printf": lambda a: f"format_string({', '.join([a[0].replace('%v', '%s'), *a[1:]])})",
    "today": lambda a: "date_trunc('DAY', current_timestamp())",
    "random": lambda a: "rand()",
    "contains_all": lambda a: "coalesce(" + " AND ".join(f"contains(lower({a[0]}), lower({t}))" for t in a[1:]) + ", false)",
    "contains_any": lambda a: "coalesce(" + " OR ".join(f"contains(lower({a[0]}), lower({t}))" for t in a[1:]) + ", false)",
    "contains_score": lambda a: "(" + " + ".join(f"coalesce(CAST(contains(lower({a[0]}), lower({t})) AS INT), 0)" for t in a[1:]) + ")",
    "vec_min_distance": lambda a: "least(" + ", ".join(f"q_vec_cosine_distance({a[0]}, {v})" for v in [*a[1:], a[1]]) + ")",
    "vec_centroid": lambda a: f"transform({_sum_vectors(a)}, x -> x / {len(a)})",
    "hash": lambda a: f"CASE lower({a[0]}) WHEN 'md5' THEN md5({a[1]}) WHEN 'sha1' THEN sha1({a[1]}) WHEN 'sha256' THEN sha2({a[1]}, 256) WHEN 'sha512' THEN sha2({a[1]}, 512) WHEN 'fnv' THEN q_fnv({a[1]}) ELSE raise_error(concat('unknown algorithm ', {a[0]})) END",
}
#: Aggregates over geometries, as SQL text: each row's box or centre first, then Spark's own aggregates of those.
AGGREGATES = {
    "geo_bbox_agg": lambda a: "array(" + ", ".join(f"{f}(q_geo_bbox({a[0]})[{k}])" for k, f in enumerate(("min", "min", "max", "max"))) + ")",
    "geo_centroid_agg": lambda a: _centre(a[0], a[1] if len(a) > 1 else "1D"),
}
#: Of rows that are equal in the order, the one with the least value counts, however the rows are split.
AGGREGATES |= {f"{f}_by": lambda a, f=f: f"{f}_by({a[0]}, CASE WHEN ({a[1]}) IS NOT NULL THEN struct({a[1]}, {_least_first(a[0], f == 'min')}) END)" for f in ("min", "max")}
MACROS |= AGGREGATES
_NEEDS = {"geo_bbox_agg": ["geo_bbox"], "geo_centroid_agg": ["geo_centroid", "geo_point", "geo_lon", "geo_lat"], "vec_min_distance": ["vec_cosine_distance"], "hash": ["fnv"], "date_sub": ["date_add"]}
_DONE: dict[int, set[str]] = {}


def _sum_vectors(args: list[str]) -> str:
    out = args[0]
    for a in args[1:]:
        out = f"zip_with({out}, {a}, (x, y) -> x + y)"
    return out


def _least_first(v: str, up: bool) -> str:
    """Items of a struct that puts lesser values of any type first (``up``) or last, nulls at the other end; Spark folds the cases on the type."""
    whole, real = f"typeof({v}) IN ('tinyint', 'smallint', 'int', 'bigint')", f"(typeof({v}) IN ('float', 'double') OR typeof({v}) LIKE 'decimal%')"
    n, x, t = f"try_cast(CAST({v} AS STRING) AS BIGINT)", f"try_cast(CAST({v} AS STRING) AS DOUBLE)", f"CAST({v} AS STRING)"
    if not up:
        n, x, t = f"~{n}", f"nanvl(-{x}, CAST('-Infinity' AS DOUBLE))", f"concat(translate(hex({t}), '0123456789ABCDEF', 'FEDCBA9876543210'), '~')"
    return f"({v}) IS {'' if up else 'NOT '}NULL, CASE WHEN {whole} THEN {n} END, CASE WHEN {real} THEN {x} END, CASE WHEN NOT {whole} THEN {t} END"


def _centre(g: str, w: str) -> str:
    at = lambda f: f"sum({f}(q_geo_centroid({g})) * ({w})) / sum({w})"
    return f"q_geo_point({at('q_geo_lon')}, {at('q_geo_lat')})"


def canonical(name: str) -> str:
    name = name.lower()
    return ALIASES.get(name, name)


def known(name: str) -> bool:
    name = canonical(name)
    return name in DEFINITIONS or name in MACROS or name in python_functions.FUNCTIONS


def ensure(spark: SparkSession, name: str) -> str:
    """Register the function if need be; the name to call it by."""
    name = canonical(name)
    for other in _NEEDS.get(name, ()):
        ensure(spark, other)
    done = _DONE.setdefault(id(spark), set())
    if name in DEFINITIONS:
        if name not in done:
            params, returns, body = DEFINITIONS[name]
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION q_{name}({params}) RETURNS {returns} RETURN {body}")
            done.add(name)
        return f"q_{name}"
    if name in python_functions.FUNCTIONS:
        if name not in done:
            spark.udf.register(f"q_{name}", python_functions.build(name))
            done.add(name)
        return f"q_{name}"
    if name in python_functions.AGGREGATES:
        if name not in done:
            spark.udf.register(f"q_{name}", python_functions.build_aggregate(name))
            done.add(name)
        return f"q_{name}"
    return name


def sql_call(spark: SparkSession, name: str, args: list[str]) -> str:
    name = canonical(name)
    target = ensure(spark, name)
    if name in MACROS:
        return MACROS[name](args)
    return f"{target}({', '.join(args)})"


def fn(spark: SparkSession, name: str, *columns: Column | str) -> Column:
    """A call as a Column; for a function of the MACROS kind the arguments must be SQL text."""
    name = canonical(name)
    if name in MACROS:
        return F.expr(sql_call(spark, name, [str(c) for c in columns]))
    return F.call_function(ensure(spark, name), *columns)


def names() -> list[str]:
    return sorted({*DEFINITIONS, *MACROS, *python_functions.FUNCTIONS, *ALIASES})


def user_function(spark: SparkSession, name: str, f, returns: str) -> None:
    """A function of the user's own, called with batches of values (pandas series)."""
    spark.udf.register(name, F.pandas_udf(f, returns))


def user_aggregate(spark: SparkSession, name: str, f, returns: str) -> None:
    """An aggregate of the user's own: a group's values (a pandas series, so the hint says) to one value."""
    spark.udf.register(name, F.pandas_udf(f, returns, F.PandasUDFType.GROUPED_AGG))
