"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content.  The
ledger, a Parquet table in the shared folder, says which rules in which version
have been run on which blob, and what they found.  A scan takes the blobs for
which some (blob, rule@version) pair is missing, runs the missing rules on one
copy of each, appends to the ledger, and joins the findings of the present rule
versions back to all paths.  A rule whose version is raised is run anew on all
blobs; nothing else is.

Positions come from one pass of a rule's pattern: matches are put between two
marks, the text is split at the marks, and lengths are summed up.  Characters
that serve as marks are replaced in the text beforehand by another control
character, which no rule matches either, so positions stay.

Defined cases: null text counts as empty; empty text has no findings; null ids
and repeated rows are paths of their own; an empty table gives an empty result
and leaves the ledger alone; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

OPEN, SHUT, CLEAR = "\x01", "\x02", "\x03"
#: Matches whose lengths are summed in one go; so a text of n matches costs n * (GROUP + n / GROUP).
GROUP = 512
#: Blobs with findings that are shipped to all tasks at most; beyond, a shuffle finds them.
SHIPPED = 50_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java pattern; ``value`` is the group whose length must reach ``least``."""

    kind: str
    version: int
    pattern: str
    value: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", value=2, least=12),
    Rule("access", 1, r"AKIA[A-Z0-9]++", least=18),
    Rule("hex", 1, r"[0-9a-f]{16,}+"),
)
MORE = (
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
)
RULES = BASE + MORE
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _summed(parts: Column, kind_no: int, rule: Rule) -> Column:
    """Spans of one group of parts, from 0, and the parts' length: struct(at, spans)."""

    def step(acc: Column, part: Column) -> Column:
        size = F.instr(part, SHUT) - 1
        span = F.struct(acc["at"].alias("start"), F.lit(kind_no).alias("kind"), (acc["at"] + size).alias("end"))
        match = F.substring_index(part, SHUT, 1)
        held = match if not rule.value else F.regexp_extract(match, rule.pattern, rule.value)
        found = F.when(F.char_length(held) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]) if rule.least else F.concat(acc["spans"], F.array(span))
        return F.struct((acc["at"] + F.char_length(part) - 1).alias("at"), found.alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans")), step)


def spans_of(parts: Column, kind_no: int, rule: Rule) -> Column:
    """Spans in the whole text, from the text split at the opening marks."""
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 2) / GROUP).cast("int")), lambda g: _summed(F.slice(parts, g * GROUP + 2, GROUP), kind_no, rule))

    def step(acc: Column, group: Column) -> Column:
        moved = F.transform(group["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + group["at"]).alias("at"), F.concat(acc["spans"], F.array(moved)).alias("spans"))

    start = F.struct(F.char_length(F.element_at(parts, 1)).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"))
    return F.when(F.size(parts) > 1, F.flatten(F.aggregate(groups, start, step)["spans"])).otherwise(F.expr(f"cast(array() as {SPAN})"))


def scanned(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blobs`` (blob, text, missing array of rule keys) -> (blob, rules, findings)."""
    df = blobs.withColumn("text", F.regexp_replace("text", f"[{OPEN}{SHUT}]", CLEAR))
    for k, rule in enumerate(rules):
        marked = F.when(F.array_contains("missing", rule.key), F.regexp_replace("text", rule.pattern, f"{OPEN}$0{SHUT}")).otherwise(F.lit(""))
        df = df.withColumn(f"parts{k}", F.split(marked, OPEN))
    found = F.concat(*(spans_of(F.col(f"parts{k}"), k, rule) for k, rule in enumerate(rules)))
    keys = F.array(*(F.lit(r.key) for r in rules))
    named = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(keys, s["kind"] + 1).alias("rule")))
    return df.select("blob", F.col("missing").alias("rules"), named.alias("findings"))


def _ledger(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def scan(versions: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks and give every path its findings: (doc_id, blob, findings)."""
    spark = versions.sparkSession
    paths = shared.id_text(versions, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paths = paths.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    keys = F.array(*(F.lit(r.key) for r in rules))
    ledger = _ledger(spark, ledger_path)
    # copies meet within a task first, so a blob of any number of paths sends one text per task
    if ledger is None:
        fresh = paths.groupBy("blob").agg(F.first("text").alias("text")).withColumn("missing", keys)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        known = paths.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(keys, F.coalesce("seen", F.expr("cast(array() as array<string>)"))).alias("missing")).where(F.size("missing") > 0)
        fresh = paths.groupBy("blob").agg(F.first("text").alias("text")).join(known, "blob")
    scanned(fresh, rules).write.mode("append").parquet(ledger_path)
    now = spark.read.schema("blob binary, rules array<string>, findings array<struct<start:int,end:int,rule:string>>").parquet(ledger_path)
    placed = F.transform("findings", lambda s: F.struct(s["start"].alias("start"), (F.array_position(keys, s["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end")))
    found = now.select("blob", F.filter(placed, lambda s: s["kind"] >= 0).alias("findings")).where(F.size("findings") > 0)
    if ledger is not None:
        found = found.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    # blobs with findings are few; while they are, they are shipped, so paths stay where they are, however many share a blob
    few = found.limit(SHIPPED + 1).count() <= SHIPPED
    return paths.select("doc_id", "blob").join(F.broadcast(found) if few else found, "blob", "left").select("doc_id", "blob", F.array_sort(F.coalesce("findings", F.expr(f"cast(array() as {SPAN})"))).alias("findings"))


def report(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; the first three rules are the base."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("findings", lambda s: s["kind"] < len(BASE))
    return scan(docs, ledger_path, rules=rules).select("doc_id", *(count(k).alias(f"n_{BASE[k].kind}") for k in range(len(BASE))), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))
