"""Line deduplication by site-relative frequency, with DataFrame functions only.

Pages are grouped by the host of their address.  A page's lines are the pieces
of its HTML between tags and line breaks, without outer blanks and without empty
ones.  A line that is on more than ``ratio`` of the pages of its host, and on at
least ``min_pages`` of them, is boilerplate and is dropped from all its pages.

A page counts a line once.  Lines travel as SHA-256 keys and are counted within
each task before the shuffle, so a host or a line with a third of all rows sends
a row per task.  A page's own count goes the same way under an empty key.

Boilerplate keys are few: a host has no more than its pages' mean number of lines
divided by the ratio.  While all hosts together have at most ``SHIPPED`` of them,
each host's list is shipped to all tasks and pages never move.  Beyond, the keys
are joined to the pages' keys, and pages with such lines get the list of their own
dropped keys, which is no longer than the page.

Defined cases: null or unparsable addresses make a host of their own (null);
null and empty pages have no lines but count as pages of their host; pages with
equal id and content are reported each; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

RATIO, MIN_PAGES = 0.3, 3
#: Boilerplate keys that are shipped to all tasks at most (about 100 bytes each).
SHIPPED = 200_000


def host(url: Column) -> Column:
    """Lower-case host of an address; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)", 1))
    return F.when(found != "", found)


def lines(html: Column) -> Column:
    pieces = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", "\n"), "\n")
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")


def key(line: Column) -> Column:
    return F.unhex(F.sha2(line.cast("binary"), 256))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key) of every boilerplate line; ``pages`` has host and keys."""
    seen = pages.select("host", F.explode(F.concat(F.array(F.lit(b"")), F.array_distinct("keys"))).alias("key"))
    counts = seen.groupBy("host", "key").agg(F.count("*").alias("n"))
    often = counts.where((F.col("n") >= min_pages) & (F.length("key") > 0))
    totals = counts.where(F.length("key") == 0).select(F.col("host").alias("h"), F.col("n").alias("total"))
    return often.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.lit(ratio) * F.col("total")).select("host", "key")


def clean(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shipped: int = SHIPPED) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (the lines that stay, in order) of every page."""
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host(F.col(f"`{url_col}`")).alias("host"), lines(F.col(f"`{html_col}`")).alias("lines"))
    keyed = src.withColumn("keys", F.transform("lines", key))
    found = shared.stored(boilerplate(keyed, ratio, min_pages), f"{shared.fresh_dir(pages.sparkSession, 'lines')}/boilerplate")
    bad = found.select(F.col("host").alias("h"), F.col("key").alias("k"))
    if found.count() <= shipped:
        lists = bad.groupBy("h").agg(F.collect_set("k").alias("gone"))
        return _without(keyed.join(F.broadcast(lists), F.col("host").eqNullSafe(F.col("h")), "left"))
    # pages that agree in id, host and lines lose the same lines, so they may share a row here
    own = keyed.select("page_id", "host", F.xxhash64("keys").alias("content"), F.explode(F.array_distinct("keys")).alias("key"))
    hit = own.join(bad, F.col("host").eqNullSafe(F.col("h")) & (F.col("key") == F.col("k")))
    gone = hit.groupBy(F.col("page_id").alias("i"), F.col("host").alias("o"), F.col("content").alias("c")).agg(F.collect_set("key").alias("gone"))
    both = keyed.withColumn("content", F.xxhash64("keys")).join(gone, F.col("page_id").eqNullSafe(F.col("i")) & F.col("host").eqNullSafe(F.col("o")) & (F.col("content") == F.col("c")), "left")
    return _without(both)


def _without(rows: DataFrame) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text of rows with lines, keys and the list ``gone`` (null: nothing) of keys to drop."""
    stay = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(F.filter(F.arrays_zip("lines", "keys"), lambda x: ~F.array_contains("gone", x["keys"])), lambda x: x["lines"]))
    return rows.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), stay.alias("stay")).select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("stay")).alias("n_dropped"), F.array_join("stay", "\n").alias("text"))


ORACLE = rf"""
    WITH p AS (
        SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1)), '') AS host,
            list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
        FROM pages),
    l AS (SELECT host, unnest(list_distinct(lines)) AS line FROM p),
    t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
    c AS (SELECT host, line, count(*) AS n FROM l GROUP BY host, line),
    b AS (SELECT c.host, list(line) AS bad FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE n >= {MIN_PAGES} AND n > {RATIO} * total GROUP BY c.host),
    k AS (
        SELECT page_id, p.host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS stay
        FROM p LEFT JOIN b ON p.host IS NOT DISTINCT FROM b.host)
    SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(stay) AS BIGINT) AS n_dropped, coalesce(array_to_string(stay, chr(10)), '') AS text
    FROM k"""
