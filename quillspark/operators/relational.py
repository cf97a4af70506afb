"""Relational operators that are more than one DataFrame call."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry


def ordered(df: DataFrame, *items: tuple[str, bool]) -> DataFrame:
    """Sort by (column, ascending) with nulls last either way."""
    return df.orderBy(*(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in items))


def top_k(df: DataFrame, k: int, *items: tuple[str, bool], offset: int = 0) -> DataFrame:
    """The first ``k`` rows after ``offset``; Spark keeps a heap per task for this."""
    out = ordered(df, *items)
    return (out.offset(offset) if offset else out).limit(k)


def distinct_on(df: DataFrame, keys: Sequence[str], *items: tuple[str, bool]) -> DataFrame:
    """The first row of each key in the given order; one row per key leaves each task before the shuffle."""
    order = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in items] or [F.lit(1)]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def set_chain(first: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """UNION, UNION ALL, EXCEPT, INTERSECT strictly from left to right, by position, names from the left."""
    out = first
    for how, other in steps:
        how = how.upper()
        if how == "UNION ALL":
            out = out.union(other)
        elif how == "UNION":
            out = out.union(other).distinct()
        elif how == "EXCEPT":
            out = out.subtract(other)
        elif how == "INTERSECT":
            out = out.intersect(other)
        else:
            raise ValueError(f"unknown set operation {how}")
    return out


def semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def _number(df: DataFrame, name: str) -> Column:
    """A column as a number; times as seconds."""
    kind = df.schema[name].dataType.typeName()
    return (F.col(name).cast("timestamp") if kind in ("timestamp", "timestamp_ntz", "date") else F.col(name)).cast("double")


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[str], values: Sequence[str], buckets: int = 64) -> DataFrame:
    """For each left row the values of the last right row at or before its time, within ``by``.

    Time is cut into ``buckets`` of equal length, so a key with very many rows is not
    one task's.  Within a key and bucket both sides are stacked and the last right row
    is carried forward; a left row before its bucket's first right row takes the last
    one of the buckets before, which is a table of one row a key and bucket.
    """
    low, high = left.agg(F.min(_number(left, left_time)), F.max(_number(left, left_time))).first()
    width = (high - low) / buckets if low is not None and high > low else 1.0
    bucket = lambda df, t: F.least(F.greatest(F.floor((_number(df, t) - (low or 0.0)) / width), F.lit(-1)), F.lit(buckets)).cast("int")
    r = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l"), bucket(right, right_time).alias("__b"))
    m = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__v"].dataType).alias("__v"), F.struct(*(F.col(c) for c in left.columns)).alias("__l"), bucket(left, left_time).alias("__b"))
    both = r.unionByName(m)
    keys = [*by, "__b"]
    ends = both.groupBy(*keys).agg(F.max_by("__v", F.when(F.col("__side") == 0, F.col("__t"))).alias("__end"))
    before = ends.select(*keys, F.last("__end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    for k in by:
        before = before.withColumnRenamed(k, f"__{k}")
    found = carried.join(before.withColumnRenamed("__b", "__bb"), functools.reduce(Column.__and__, [F.col("__b") == F.col("__bb"), *(F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by)]))
    out = found.withColumn("__last", F.coalesce("__last", "__before"))
    return out.select("__l.*", *(F.col(f"__last.{v}").alias(v) for v in values))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, most: int = 256) -> DataFrame:
    """Pairs with low <= point < high as an equi-join on buckets.

    Buckets are ``width`` wide on the lowest level and twice as wide on each one above.
    A range is listed on the level where it meets three buckets at most, and a point
    once on each level whose ranges reach as far, so neither is listed without bound.

    Equal ranges are joined as one row, ``most`` at a time, with four times as many
    points of their bucket, and rows are told apart again after the join.  So the pairs of a
    point lie side by side and the same ranges come again with the next point, which
    columnar files keep as runs and repeats.  The functions over arrays keep the join
    out of generated code, which would hold all matches of a row at once.
    """
    size = F.greatest((F.col(high) - F.col(low)).cast("double"), F.lit(width))
    r = ranges.where(F.col(high) > F.col(low)).withColumn("__level", F.ceil(F.log2(size / width)).cast("int"))
    at = lambda c: F.floor(F.col(c).cast("double") / (F.lit(width) * F.pow(F.lit(2.0), F.col("__level")))).cast("long")
    levels = sorted(map(tuple, r.groupBy("__level").agg(F.min(F.col(low).cast("double")), F.max(F.col(high).cast("double"))).collect()))  # 2000 at most, by the range of doubles
    if not levels:
        return points.crossJoin(ranges.limit(0))
    rest = [c for c in ranges.columns if c not in (low, high)]
    nested = {f.name for f in ranges.schema if f.dataType.typeName() in ("array", "map", "struct", "variant")}
    order = [F.to_json(F.struct(f"`{c}`")) if c in nested else F.col(f"`{c}`") for c in rest] or [F.lit(1)]
    part = F.floor((F.row_number().over(Window.partitionBy(low, high).orderBy(*order)) - 1) / most)
    alike = r.withColumn("__part", part).groupBy("__level", low, high, "__part").agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(0))).alias("__alike")).drop("__part")
    listed = alike.withColumn("__b", F.explode(F.sequence(at(low), at(high))))
    x = F.col(point).cast("double")
    reached = F.array_compact(F.array(*(F.when((x >= lo) & (x <= hi), n) for n, lo, hi in levels)))
    own = F.struct(*(F.col(f"`{c}`") for c in points.columns))
    p = points.select(own.alias("__p"), F.col(point).alias("__x"), F.explode(reached).alias("__level")).withColumn("__b", at("__x"))
    p = p.repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__level", "__b")  # by number, as Spark would put partitions together by their few bytes, not by the pairs they make
    nth = F.row_number().over(Window.partitionBy("__level", "__b").orderBy("__x"))
    near = p.withColumn("__part", F.floor((nth - 1) / (4 * most))).groupBy("__level", "__b", "__part").agg(F.collect_list(F.struct("__x", "__p")).alias("__near")).drop("__part")
    within = lambda s: (s["__x"] >= F.col(low)) & (s["__x"] < F.col(high))
    on = [listed["__level"] == near["__level"], listed["__b"] == near["__b"], F.exists("__near", within)]
    met = listed.join(near.hint("merge"), on).select(low, high, "__alike", F.explode(F.filter("__near", within)).alias("__s"))
    each = met.select(low, high, F.col("__s.__p").alias("__p"), F.explode("__alike").alias("__r"))
    return each.select("__p.*", *(F.col(f"`{c}`" if c in (low, high) else f"__r.`{c}`") for c in ranges.columns))


def not_in(value: Column, items: Sequence) -> Column:
    """NOT IN where a null member never makes the result unknown."""
    return ~value.isin([x for x in items if x is not None])


def pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, agg: Column) -> DataFrame:
    return df.groupBy(*keys).pivot(column, list(values)).agg(agg)


def recursive(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], folder: str, distinct: bool = True, most: int = 1024) -> DataFrame:
    """Semi-naive recursion: ``step`` sees the rows that the last round added; rounds are written below ``folder``."""
    spark = anchor.sparkSession
    run = f"{folder}/recursive-{uuid.uuid4().hex[:12]}"

    def kept(df: DataFrame, at: int) -> DataFrame:
        df.write.parquet(f"{run}/{at}")
        return spark.read.schema(df.schema).parquet(f"{run}/{at}")

    out = front = kept(anchor.distinct() if distinct else anchor, 0)
    for at in range(1, most + 1):
        new = step(front)
        new = new.toDF(*anchor.columns)
        front = kept(new.distinct().subtract(out) if distinct else new, at)
        if front.isEmpty():
            return out
        out = out.union(front)
    raise RuntimeError(f"recursion did not end within {most} rounds")


# aggregates


def vec_avg_by(df: DataFrame, keys: Sequence[str], vector: str, name: str = "vec_avg") -> DataFrame:
    """Mean vector per key; sums are formed per position within each task, and no group is gathered in one place."""
    long = df.select(*keys, F.posexplode(vector).alias("__p", "__x"))
    per = long.groupBy(*keys, "__p").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__m"))), lambda s: s["__m"]).alias(name))


def geo_bbox_agg(df: DataFrame, keys: Sequence[str], lon: str, lat: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array(F.min(lon), F.min(lat), F.max(lon), F.max(lat)).alias("bbox"))


def geo_centroid_agg(df: DataFrame, keys: Sequence[str], lon: str, lat: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(*keys).agg((F.sum(F.col(lon) * w) / F.sum(w)).alias("lon"), (F.sum(F.col(lat) * w) / F.sum(w)).alias("lat"))


def geo_dissolve(df: DataFrame, keys: Sequence[str], geom: str, grid: float = 0.0) -> DataFrame:
    """Union of a group's adjoining polygons.

    Every edge is counted along and against its direction, within each task first;
    edges that two polygons share cancel out, and only what is left, the outline,
    meets in one place to be joined to rings.
    """
    import pandas as pd

    own = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def edges(batches):
        for pdf in batches:
            rows = [(*key, *e) for *key, g in pdf.itertuples(index=False, name=None) if g is not None for e in geometry.edges(geometry.load(g), grid)]
            yield pd.DataFrame(rows, columns=[*keys, "ax", "ay", "bx", "by", "n"])

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = {((ax, ay), (bx, by)) if n > 0 else ((bx, by), (ax, ay)): abs(int(n)) for ax, ay, bx, by, n in pdf[["ax", "ay", "bx", "by", "n"]].itertuples(index=False, name=None)}
        return pd.DataFrame([[*key, geometry.outline(found)]], columns=[*keys, "geometry"])

    split = df.select(*keys, geom).mapInPandas(edges, f"{own}, ax double, ay double, bx double, by double, n int")
    left = split.groupBy(*keys, "ax", "ay", "bx", "by").agg(F.sum("n").alias("n")).where("n <> 0")
    return left.groupBy(*keys).applyInPandas(one, f"{own}, geometry string")


# windows


def moving(kind: str, n: int, value: str, partition: Sequence[str], order: Sequence[Column]) -> Column:
    """MOVING_SUM (0 where all is null) and MOVING_AVG over the last ``n`` rows."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(n - 1), 0)
    x = F.col(value).cast("double")
    return F.coalesce(F.sum(x).over(w), F.lit(0.0)) if kind == "sum" else F.avg(x).over(w)


def equal_interval(df: DataFrame, n: int, value: str, partition: Sequence[str], name: str = "class") -> DataFrame:
    """Class 1 to n of equal width between a key's least and greatest value.

    The bounds are one aggregation, a row a key, and rows are classed by a join with
    it, so rows of a key need not meet in one task; Spark ships the bounds if they are few.
    """
    keys = list(partition) or ["__all"]
    src = df if partition else df.withColumn("__all", F.lit(1))
    bounds = src.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    met = src.join(bounds, functools.reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)))
    low, high = F.col("__low"), F.col("__high")
    place = F.least(F.floor((F.col(value) - low) / ((high - low) / n)), F.lit(n - 1)) + 1
    return met.select(*(F.col(f"`{c}`") for c in df.columns), F.when(F.col(value).isNotNull(), F.when(high == low, 1).otherwise(place)).cast("int").alias(name))


def jenks(values: Sequence[float], k: int, weights: Sequence[int] | None = None) -> list[float]:
    """Upper bounds of the ``k`` classes with the least squared deviation; ``values`` sorted, with their numbers of rows.

    Equal values are one; the best last cut never moves left as the end moves
    right, so each class is found by divide and conquer in m log m steps.
    """
    import numpy as np

    distinct, at = np.unique(np.asarray(values, dtype=float), return_inverse=True)
    w = np.bincount(at, weights=None if weights is None else np.asarray(weights, dtype=float), minlength=len(distinct)).astype(float)
    m, k = len(distinct), min(k, len(distinct))
    shifted = distinct - distinct.mean() if m else distinct
    s0, s1, s2 = (np.concatenate([[0.0], np.cumsum(w * shifted**p)]) for p in (0, 1, 2))
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    cuts = np.zeros((k + 1, m + 1), dtype=np.int64)
    for c in range(1, k + 1):
        now = np.full(m + 1, np.inf)
        todo = [(c, m, c - 1, m - 1)]
        while todo:
            low, high, a0, a1 = todo.pop()
            if low > high:
                continue
            b = (low + high) // 2
            a = np.arange(a0, min(a1, b - 1) + 1)
            n = s0[b] - s0[a]
            cost = best[a] + (s2[b] - s2[a]) - (s1[b] - s1[a]) ** 2 / n
            j = int(cost.argmin())
            now[b], cuts[c, b] = cost[j], a[j]
            todo += [(low, b - 1, a0, int(a[j])), (b + 1, high, int(a[j]), a1)]
        best = now
    out, b = [], m
    for c in range(k, 0, -1):
        out.append(float(distinct[b - 1]))
        b = int(cuts[c, b])
    return out[::-1]


def natural_breaks(df: DataFrame, n: int, value: str, partition: Sequence[str], name: str = "class") -> DataFrame:
    """Jenks classes per partition: bounds come from the partition's distinct values, rows are then classed by a join."""
    import pandas as pd

    keys = list(partition) or ["__all"]
    src = df if partition else df.withColumn("__all", F.lit(1))
    schema = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys) + ", __bounds array<double>"

    def bounds(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, jenks(pdf["__v"].tolist(), n, pdf["__n"].tolist())]], columns=[*keys, "__bounds"])

    counted = src.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    found = counted.groupBy(*keys).applyInPandas(bounds, schema)
    place = F.size(F.filter("__bounds", lambda b: b < F.col(value).cast("double"))) + 1
    return src.join(found, keys, "left").withColumn(name, F.when(F.col(value).isNotNull(), place)).drop("__bounds", *([] if partition else ["__all"]))
