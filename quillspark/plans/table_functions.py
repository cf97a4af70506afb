"""Table functions by name, for calls in FROM and JOIN: arguments are plain values, the result is a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..sources import readers

#: Functions that a user registered: name -> f(spark, *arguments) -> DataFrame.
EXTERNAL: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, f: Callable[..., DataFrame]) -> None:
    EXTERNAL[name.lower()] = f


def _vector(v) -> list[float]:
    return [float(x) for x in (json.loads(v) if isinstance(v, str) else v)]


def _vec_search(spark, table, column, query, k, metric="cosine", index="flat"):
    """Modes flat, exact and ivf; hnsw, a graph that one machine walks, is answered by the exact scan."""
    df, query = spark.table(table), _vector(query)
    if index.lower() not in ("flat", "exact", "ivf", "hnsw"):
        raise ValueError(f"VEC_SEARCH: unknown index {index}")
    if index.lower() == "ivf":
        return search.IVFIndex(df, column).search(query, int(k), metric=_metric(metric), key=df.columns[0])
    return search.vec_search(df, column, query, int(k), _metric(metric), df.columns[0])


def _metric(name: str) -> str:
    return {"inner_product": "dot"}.get(name.lower(), name.lower())


def _vec_warm(spark, table, column, metric="cosine", index="flat"):
    """Counts of a vector column; the table is held in memory from here on."""
    df = spark.table(table)
    df.persist()
    size = F.size(F.col(column))
    sizes = df.groupBy(F.when(F.col(column).isNull(), None).otherwise(size).alias("d")).agg(F.count("*").alias("n"))
    known = F.col("d").isNotNull()
    got = sizes.agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("vector_count"), F.max_by("d", F.when(known, F.col("n"))).alias("dims"), F.count(F.when(known, 1)).alias("distinct_dims"), F.max(F.when(known, F.col("n"))).alias("__most"))
    return got.select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.lit(_metric(metric)).alias("metric"), F.lit(index).alias("index_mode"), "row_count", "vector_count", "dims", "distinct_dims", (F.col("vector_count") - F.coalesce("__most", F.lit(0))).alias("excluded_rows"))


def _fts_search(spark, table, query, k, *columns):
    df = spark.table(table)
    return search.fts_search(df, query, int(k), list(columns) or df.columns, df.columns[0])


def _rag_search(spark, table, column, query, k, options="{}"):
    df, o = spark.table(table), json.loads(options or "{}")
    texts = o.get("text_columns") or ([o["text_column"]] if o.get("text_column") else [])
    metric = _metric(o.get("metric", "cosine"))
    if not texts or not o.get("text_query"):
        return search.vec_search(df, column, _vector(query), int(k), metric, df.columns[0])
    if not o.get("key_columns"):
        raise ValueError("RAG_SEARCH: key_columns is required with a text query")
    return search.hybrid_search(df, column, texts, _vector(query), o["text_query"], int(k), o["key_columns"][0], metric, natural=o.get("auto_or_expand", True))


def _hybrid(spark, table, column, text, terms, query, k, options="{}"):
    df = spark.table(table)
    o = json.loads(options or "{}")
    return search.hybrid_search(df, column, [text], _vector(query), terms, int(k), (o.get("key_columns") or df.columns)[0], _metric(o.get("metric", "cosine")))


def _rag_context(spark, table, doc_col, chunk_col, doc, chunk, before, after=None):
    return search.rag_context(spark.table(table), doc_col, chunk_col, doc, int(chunk), int(before), None if after is None else int(after))


def _rag_context_from(spark, table, doc_col, chunk_col, hits, hit_doc, hit_chunk, before, after=None):
    found = spark.table(hits)
    rank = next((c for c in found.columns if c.lower() in ("rank", "_rrf_rank", "_vec_rank", "_fts_rank")), None)
    return search.rag_context_from(spark.table(table), doc_col, chunk_col, found, hit_doc, hit_chunk, int(before), None if after is None else int(after), rank)


def _text_chunks(spark, text, size, overlap=0, unit="words"):
    return search.text_chunks(spark.createDataFrame([(text,)], "t string"), "t", int(size), int(overlap), unit).drop("t")


def _geo_search(spark, table, geom, mode, *args):
    df = spark.table(table)
    at = lambda k: F.get_json_object(F.col(geom), f"$.coordinates[{k}]").cast("double")
    placed = df.withColumn("__lon", at(0)).withColumn("__lat", at(1))
    return search.geo_search(placed, "__lon", "__lat", mode, *map(float, args), key=df.columns[0]).drop("__lon", "__lat")


FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    "vec_search": _vec_search,
    "vec_top_k": _vec_search,
    "vec_warm": _vec_warm,
    "fts_search": _fts_search,
    "rag_search": _rag_search,
    "hybrid_search": _hybrid,
    "vec_hybrid_search": _hybrid,
    "rag_context": _rag_context,
    "rag_context_from": _rag_context_from,
    "text_chunks": _text_chunks,
    "geo_search": _geo_search,
    "table_from_json": lambda spark, source, spec=None: search.table_from_json(spark, source),
    "table_from_json_lines": lambda spark, source: search.table_from_json_lines(spark, source),
    "table_from_csv": lambda spark, source, options="{}": search.table_from_csv(spark, source, **{{"delimiter": "sep"}.get(k, k): v for k, v in json.loads(options).items()}),
    "table_from_xml": lambda spark, source, record: search.table_from_xml(spark, source, record),
    "files": lambda spark, path, recursive=True: readers.files(spark, path),
    "lines": lambda spark, path: readers.lines(spark, path),
    "csv_rows": lambda spark, path, header=True: readers.read_csv(spark, path, header=bool(header)),
    "json_rows": lambda spark, path: readers.read_json(spark, path),
}


def known(name: str) -> bool:
    return name.lower() in FUNCTIONS or name.lower() in EXTERNAL


def call(spark: SparkSession, name: str, args: list) -> DataFrame:
    name = name.lower()
    return (EXTERNAL.get(name) or FUNCTIONS[name])(spark, *args)
