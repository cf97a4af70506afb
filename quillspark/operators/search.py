"""Table functions: vector, full-text and hybrid search, context windows, chunks, places, and tables from text."""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fulltext


def _vector(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def distance(column: str, query: Sequence[float], metric: str = "cosine") -> Column:
    v, q = F.col(column), _vector(query)
    if metric == "cosine":
        size = sum(float(x) ** 2 for x in query) ** 0.5
        return 1 - _dot(v, q) / (F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) * F.lit(size))
    if metric in ("l2", "euclidean"):
        return F.sqrt(F.aggregate(F.zip_with(v, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    if metric in ("manhattan", "l1"):
        return F.aggregate(F.zip_with(v, q, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "dot":
        return -_dot(v, q)
    raise ValueError(f"unknown metric {metric}")


def _ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rank the few rows of a top-k."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def vec_search(df: DataFrame, column: str, query: Sequence[float], k: int, metric: str = "cosine", key: str | None = None) -> DataFrame:
    """The ``k`` nearest rows with _vec_distance, _vec_similarity, _vec_rank; ties go by ``key``. Each task keeps k rows."""
    tie = F.col(key or df.columns[0]).asc_nulls_last()
    found = df.where(F.size(column) == len(query)).withColumn("_vec_distance", distance(column, query, metric))
    top = found.where("_vec_distance is not null").orderBy(F.col("_vec_distance"), tie).limit(k)
    similar = 1 - F.col("_vec_distance") if metric == "cosine" else -F.col("_vec_distance") if metric == "dot" else 1 / (1 + F.col("_vec_distance"))
    return _ranked(top.withColumn("_vec_similarity", similar), "_vec_rank", F.col("_vec_distance"), tie)


class IVFIndex:
    """Inverted lists of vectors: centroids by k-means on a bounded sample of ``sample`` rows, all rows listed under their nearest one.

    With ``folder`` the lists are written there, one partition a list, so a search reads
    only the lists that it probes; without, each search finds the rows' lists anew.
    For the cosine metric vectors are listed by direction.
    """

    def __init__(self, df: DataFrame, column: str, lists: int | None = None, sample: int = 20_000, seed: int = 7, metric: str = "cosine", folder: str | None = None):
        import numpy as np

        n = df.count()
        lists = lists or max(4, min(64, int(n**0.5 / 2)))
        rows = df.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(F.col(column).cast("string"))).limit(sample).toPandas()[column]
        x = np.stack([np.asarray(v, dtype=float) for v in rows])
        if metric == "cosine":
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), size=min(lists, len(x)), replace=False)]
        for _ in range(12):
            near = (-2 * x @ c.T + (c**2).sum(axis=1)).argmin(axis=1)
            c = np.stack([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
        self.column, self.centroids, self.n, self.metric = column, c, n, metric
        distances = F.array(*(F.struct(distance(column, v.tolist(), "cosine" if metric == "cosine" else "l2").alias("d"), F.lit(k).alias("k")) for k, v in enumerate(c)))
        self.rows = df.withColumn("_list", F.array_min(distances)["k"])
        if folder:
            self.rows.repartition("_list").write.mode("overwrite").partitionBy("_list").parquet(folder)
            self.rows = df.sparkSession.read.parquet(folder).select(*df.columns, "_list")

    def search(self, query: Sequence[float], k: int, probes: int | None = None, metric: str | None = None, key: str | None = None) -> DataFrame:
        import numpy as np

        probes = probes or max(1, int(len(self.centroids) ** 0.5) + k // 32)
        q = np.asarray(query, dtype=float)
        if self.metric == "cosine":
            near = (-(self.centroids @ q) / np.maximum(np.linalg.norm(self.centroids, axis=1), 1e-12)).argsort()
        else:
            near = ((self.centroids - q) ** 2).sum(axis=1).argsort()
        return vec_search(self.rows.where(F.col("_list").isin(near[:probes].tolist())), self.column, query, k, metric or self.metric, key).drop("_list")


#: Words in text that has single blanks between, before and after its words; patterns that begin with the blank are found fast.
_STOP_WORDS = "|".join(w for w in fulltext.STOP if len(w) > 1)
_END = "(?:" + "|".join(fulltext.SUFFIXES) + ")?"


def _stem(w: Column) -> Column:
    out = w
    for s in reversed(fulltext.SUFFIXES):
        out = F.when(w.endswith(s) & (F.length(w) > len(s) + 3), w.substr(F.lit(1), F.length(w) - len(s))).otherwise(out)
    return out


def _leaves(node) -> list[tuple]:
    """Terms, phrases and patterns of a query, each once."""
    if node is None:
        return []
    if node[0] in ("term", "phrase", "like"):
        return [node]
    return list({repr(x): x for part in ([node[1]] if node[0] == "not" else node[1]) for x in _leaves(part)}.values())


def fts_search(df: DataFrame, query: str, k: int, columns: Sequence[str], key: str, natural: bool = False) -> DataFrame:
    """The ``k`` best rows by BM25 that a query matches, with _fts_score and _fts_rank; ties go by ``key``.

    The query has terms, "phrases", patterns with * and ?, AND, OR, NOT and
    parentheses; adjacent parts are joined by AND.  With ``natural`` it is a
    question whose content words are joined by OR.  A row's tokens are never
    listed: their number is one count of a regular expression, and only words that
    may stem to the query's terms are taken out and stemmed.  One aggregation gives
    document frequencies and the average length, a second pass scores; each task
    keeps k rows.
    """
    node = fulltext.parse(fulltext.natural(query) if natural else query)
    if node is None:
        return df.limit(0).select("*", F.lit(0.0).alias("_fts_score"), F.lit(0).cast("long").alias("_fts_rank"))
    leaves = _leaves(node)
    patterns = {t for x in leaves for t in ([re.escape(x[1])] if x[0] == "term" else map(re.escape, x[1]) if x[0] == "phrase" else [x[1].replace(".", "[a-z0-9]")])}
    forms = f" ((?:{'|'.join(sorted(patterns))}){_END})(?= )"
    letters = F.translate(F.concat_ws(" ", *columns), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = F.concat(F.lit(" "), F.regexp_replace(letters, "[^a-z0-9]+", " "), F.lit(" "))
    # each step is a generator's output, so that Spark works it out once a row and not in every place that names it
    held = df.withColumn("__low", F.explode(F.array(low)))
    count = F.regexp_count("__low", F.lit("[a-z0-9]{2,}")) - F.regexp_count("__low", F.lit(f" (?:{_STOP_WORDS})(?= )"))
    stems = lambda words: F.transform(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*fulltext.STOP)), _stem)
    phrases = [x[1] for x in leaves if x[0] == "phrase"]
    gap = f"(?: (?:{_STOP_WORDS}|[a-z0-9]))* "
    spans = [F.regexp_extract_all("__low", F.lit(f"(?=( {gap.join(f'{re.escape(t)}{_END}' for t in p)}(?= )))"), F.lit(1)) for p in phrases]

    def is_phrase(p: list[str]):
        return lambda w: stems(F.regexp_extract_all(w, F.lit("[a-z0-9]+"), F.lit(0))) == F.array(*map(F.lit, p))

    in_order = [F.exists(s, is_phrase(p)) for s, p in zip(spans, phrases, strict=True)]
    found = F.struct(count.cast("double").alias("n"), stems(F.regexp_extract_all("__low", F.lit(forms), F.lit(1))).alias("hit"), F.array(*in_order, F.lit(False)).alias("phrases"))
    held = held.withColumn("__found", F.explode(F.array(found))).drop("__low").select(*df.columns, F.col("__found.n").alias("__n"), F.col("__found.hit").alias("__hit"), F.col("__found.phrases").alias("__phrases"))
    terms = sorted({t for x in leaves if x[0] != "like" for t in ([x[1]] if x[0] == "term" else x[1])})
    stats = held.agg(F.count("*").alias("n"), F.avg("__n").alias("avg"), *(F.sum(F.array_contains("__hit", t).cast("long")).alias(f"df{i}") for i, t in enumerate(terms))).first()
    n, average = stats["n"], stats["avg"] or 1.0
    often = {t: stats[f"df{i}"] or 0 for i, t in enumerate(terms)}
    if liked := sorted({x[1] for x in leaves if x[0] == "like"}):  # the dictionary's terms that patterns stand for
        met = held.select(F.explode(F.array_distinct("__hit")).alias("t")).where(" OR ".join(f"t RLIKE '^(?:{p})$'" for p in liked)).groupBy("t").count()
        often |= {r["t"]: r["count"] for r in met.collect()}
    idf = {t: math.log(1 + (n - df + 0.5) / (df + 0.5)) if df else 0.0 for t, df in often.items()}
    tf_of = lambda t: F.size(F.filter("__hit", lambda x: x == t)).cast("double")
    weigh = lambda tf, own: own * tf * (fulltext.K1 + 1) / (tf + fulltext.K1 * (1 - fulltext.B + fulltext.B * F.col("__n") / average))

    def weight(t: str) -> Column:
        return weigh(tf_of(t), F.lit(idf[t]))

    def both(node) -> tuple[Column, Column]:
        """(whether the row matches, its score) of a part of the query."""
        kind, x = node
        if kind == "term":
            return F.array_contains("__hit", x), weight(x)
        if kind == "phrase":
            held_in = F.col("__phrases")[phrases.index(x)]
            return held_in, F.when(held_in, functools.reduce(Column.__add__, map(weight, x)) * fulltext.PHRASE).otherwise(0.0)
        if kind == "like":
            known = F.from_json(F.lit(json.dumps({t: v for t, v in idf.items() if re.fullmatch(x, t)})), "map<string,double>")
            own = F.filter(F.array_distinct("__hit"), lambda t: t.rlike(f"^(?:{x})$"))
            return F.size(own) > 0, F.aggregate(F.array_sort(own), F.lit(0.0), lambda s, t: s + weigh(tf_of(t), F.element_at(known, t)))
        if kind == "not":
            return ~both(x)[0], F.lit(0.0)
        tests, scores = zip(*map(both, x), strict=True)
        if kind == "or":
            return functools.reduce(Column.__or__, tests), F.greatest(*scores)
        return functools.reduce(Column.__and__, tests), functools.reduce(Column.__add__, scores)

    test, score = both(node)
    found = held.where(test & (F.col("__n") > 0)).withColumn("_fts_score", score).drop("__n", "__hit", "__phrases")
    order = (F.col("_fts_score").desc(), F.col(key).asc_nulls_last())
    return _ranked(found.orderBy(*order).limit(k), "_fts_rank", *order)


def hybrid_search(df: DataFrame, vec_col: str, text_cols: Sequence[str], query: Sequence[float], terms: str, k: int, key: str, metric: str = "cosine", constant: int = 60, natural: bool = True) -> DataFrame:
    """Reciprocal rank fusion of a vector and a text search, 4 k rows of each: _rrf_score and _rrf_rank."""
    a = vec_search(df, vec_col, query, 4 * k, metric, key).select(key, "_vec_distance", "_vec_rank")
    b = fts_search(df, terms, 4 * k, text_cols, key, natural).select(key, "_fts_score", "_fts_rank")
    both = a.join(b, key, "full").withColumn("_rrf_score", F.coalesce(1 / (constant + F.col("_vec_rank")), F.lit(0.0)) + F.coalesce(1 / (constant + F.col("_fts_rank")), F.lit(0.0)))
    top = both.orderBy(F.col("_rrf_score").desc(), F.col(key)).limit(k)
    return _ranked(top, "_rrf_rank", F.col("_rrf_score").desc(), F.col(key)).join(df, key)


rag_search = hybrid_search


def rag_context(df: DataFrame, doc_col: str, chunk_col: str, doc, chunk: int, before: int, after: int | None = None) -> DataFrame:
    after = before if after is None else after
    return df.where((F.col(doc_col) == doc) & F.col(chunk_col).between(chunk - before, chunk + after)).orderBy(chunk_col)


def rag_context_from(df: DataFrame, doc_col: str, chunk_col: str, hits: DataFrame, hit_doc: str, hit_chunk: str, before: int, after: int | None = None, hit_rank: str | None = None) -> DataFrame:
    """Chunks around hits, each once under its best hit: _hit_rank, _context_offset, _context_rank, _context_hits."""
    after = before if after is None else after
    rank = F.col(hit_rank) if hit_rank else F.row_number().over(Window.orderBy(hit_doc, hit_chunk))
    h = hits.select(F.col(hit_doc).alias("__d"), F.col(hit_chunk).alias("__c"), rank.cast("long").alias("_hit_rank"))
    h = h.withColumn("__at", F.explode(F.sequence(F.col("__c") - before, F.col("__c") + after)))
    met = df.join(h, (F.col(doc_col) == F.col("__d")) & (F.col(chunk_col) == F.col("__at"))).withColumn("_context_offset", (F.col(chunk_col) - F.col("__c")).cast("long"))
    w = Window.partitionBy(doc_col, chunk_col)
    best = met.withColumn("_context_hits", F.count("*").over(w)).withColumn("__n", F.row_number().over(w.orderBy("_hit_rank", F.abs("_context_offset"), "_context_offset"))).where("__n = 1").drop("__n", "__d", "__c", "__at")
    return best.withColumn("_context_rank", F.row_number().over(Window.orderBy("_hit_rank", doc_col, chunk_col)).cast("long"))


def text_chunks(df: DataFrame, text: str, size: int, overlap: int = 0, unit: str = "words") -> DataFrame:
    """Each row's text in pieces of ``size`` words or characters: chunk_index, chunk_text, start_pos, end_pos."""
    step = size - min(overlap, size - 1)
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.filter(F.split(t, r"\s+"), lambda x: x != "") if unit == "words" else None
    n = F.size(parts) if unit == "words" else F.char_length(t)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    piece = (lambda s: F.array_join(F.slice("__parts", s + 1, size), " ")) if unit == "words" else (lambda s: F.col("__parts").substr(s + 1, F.lit(size)))
    src = df.withColumn("__parts", parts if unit == "words" else t).withColumn("__n", n).withColumn("__starts", starts)
    rows = src.select(*df.columns, "__parts", "__n", F.posexplode("__starts").alias("chunk_index", "start_pos"))
    return rows.select(*df.columns, "chunk_index", piece(F.col("start_pos")).alias("chunk_text"), "start_pos", F.least(F.col("start_pos") + size, F.col("__n")).alias("end_pos"))


def geo_search(df: DataFrame, lon: str, lat: str, mode: str, *args: float, key: str) -> DataFrame:
    """Rows in a box (w, s, e, n) or within metres of a point (lon, lat, m), with _geo_rank; a box is tested before the distance."""
    if mode == "bbox":
        w, s, e, n = args
        found = df.where(F.col(lon).between(w, e) & F.col(lat).between(s, n))
    else:
        x, y, m = args
        d = m / 111_000.0
        a, b = F.radians(F.lit(float(y))), F.radians(lat)
        h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(F.col(lon) - x) / 2), 2)
        found = df.where(F.col(lat).between(y - d, y + d)).where(2 * 6_371_000 * F.asin(F.sqrt(F.least(F.lit(1.0), h))) <= m)
    return numbered(found, "_geo_rank", key)


def numbered(df: DataFrame, name: str, key: str, parts: int = 64) -> DataFrame:
    """Rows numbered from 1 by a key; a key that is a number is cut at its quantiles and each part is numbered by itself, from where the one before ends."""
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double"):
        return df.withColumn(name, F.row_number().over(Window.orderBy(key)).cast("long"))
    cuts = sorted(set(df.approxQuantile(key, [k / parts for k in range(1, parts)], 0.01)))
    part = F.coalesce(functools.reduce(Column.__add__, ((F.col(key) > c).cast("int") for c in cuts), F.lit(0)), F.lit(-1))
    counts = {r["p"]: r["n"] for r in df.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in sorted(counts):
        before.append(F.when(F.col("__part") == k, F.lit(total)))
        total += counts[k]
    first = F.coalesce(*before, F.lit(0)) if before else F.lit(0)
    w = Window.partitionBy("__part").orderBy(key)
    return df.withColumn("__part", part).withColumn(name, (first + F.row_number().over(w)).cast("long")).drop("__part")


def table_from_json(spark: SparkSession, source: str) -> DataFrame:
    data = json.loads(source)
    rows = [{k.lower(): v for k, v in x.items()} if isinstance(x, dict) else {"value": x} for x in (data if isinstance(data, list) else [data])]
    return table_from_json_lines(spark, "\n".join(json.dumps(r) for r in rows))


def table_from_json_lines(spark: SparkSession, source: str) -> DataFrame:
    lines = spark.createDataFrame([(x,) for x in source.splitlines() if x.strip()], "value string")
    found = spark.read.json(lines.rdd.map(lambda r: r[0]))
    return found.select(*sorted(found.columns))


def table_from_csv(spark: SparkSession, source: str, sep: str = ",", header: bool = True) -> DataFrame:
    lines = spark.sparkContext.parallelize([x for x in source.splitlines() if x.strip()], 1)
    return spark.read.csv(lines, sep=sep, header=header, inferSchema=True)


def table_from_xml(spark: SparkSession, source: str, record: str) -> DataFrame:
    import xml.etree.ElementTree as ET

    rows = [{c.tag.lower(): c.text for c in r} | r.attrib for r in ET.fromstring(source).iter(record)]
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))
