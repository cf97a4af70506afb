"""An engine over a Spark session: tables kept as Parquet, views, materialised views, DML, jobs, triggers, procedures.

A table's rows are in a folder of their own for each version; a change writes a
new version and then swaps the temporary view, so readers never see half of it.
"""

from __future__ import annotations

import copy
import datetime
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .builder import literal
from .sql import Rewriter

_TYPES = {
    "INT": "bigint", "INTEGER": "bigint", "INT64": "bigint", "UINT": "bigint", "UINT64": "decimal(20,0)", "FLOAT": "double", "FLOAT64": "double", "FLOAT32": "double", "REAL": "double", "DOUBLE": "double", "TEXT": "string", "STRING": "string",
    "VARCHAR": "string", "CHAR": "string", "UUID": "string", "XML": "string", "YAML": "string", "URL": "string", "HASH": "string", "BITMAP": "string", "TIME": "string", "JSON": "string", "JSONB": "string", "GEOMETRY": "string", "GEOM": "string",
    "BOOL": "boolean", "BOOLEAN": "boolean", "DATE": "date", "DATETIME": "timestamp", "TIMESTAMP": "timestamp", "DECIMAL": "decimal(38,10)", "NUMERIC": "decimal(38,10)", "MONEY": "decimal(38,4)", "BLOB": "binary", "BYTEA": "binary", "BINARY": "binary",
    "VECTOR": "array<double>", "EMBEDDING": "array<double>", "COMPLEX": "struct<re:double,im:double>", "DURATION": "string", "INTERVAL": "string", "POINTER": "bigint", "BYTE": "tinyint", "RUNE": "string", "ANY": "string", "INTERFACE": "string", "MAP": "map<string,string>", "ARRAY": "array<string>",
}


class ConstraintError(ValueError):
    """A row breaks a constraint of its table."""


@dataclass
class Column:
    name: str
    type: str
    declared: str
    not_null: bool = False
    primary: bool = False
    unique: bool = False
    default: str | None = None
    references: tuple[str, str, str, str] | None = None  # table, column, on delete, on update


@dataclass
class Table:
    name: str
    columns: list[Column]
    version: int = 0
    path: str = ""
    statistics: list[tuple] | None = None


@dataclass
class MaterialisedView:
    name: str
    query: str
    policy: str = "ON STALE"
    path: str = ""
    stale: bool = True
    refreshed: float = 0.0
    reads: set[str] = field(default_factory=set)


def cron_next(spec: str, now: float) -> float:
    """The first minute after ``now`` (UTC) that fits minute, hour, day of the month, month and day of the week."""
    limits = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))

    def values(field: str, low: int, high: int) -> set[int]:
        out: set[int] = set()
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, _, z = span.partition("-")
            first, last = (low, high) if a == "*" else (int(a), int(z) if z else high if step else int(a))
            out |= set(range(first, last + 1, int(step or 1)))
        return out

    fields = spec.split()
    if len(fields) != 5:
        raise ValueError(f"a schedule has five fields: {spec}")
    minute, hour, day, month, weekday = (values(f, *x) for f, x in zip(fields, limits, strict=True))
    weekday |= {0} if 7 in weekday else set()
    at = datetime.datetime.fromtimestamp(now, datetime.UTC).replace(second=0, microsecond=0) + datetime.timedelta(minutes=1)
    for _ in range(366 * 24 * 60 * 4):
        by_day, by_week = at.day in day, at.isoweekday() % 7 in weekday
        fits = by_day and by_week if "*" in (fields[2], fields[4]) else by_day or by_week
        if not (at.month in month and fits):
            at = at.replace(hour=0, minute=0) + datetime.timedelta(days=1)
        elif at.hour not in hour:
            at = at.replace(minute=0) + datetime.timedelta(hours=1)
        elif at.minute not in minute:
            at += datetime.timedelta(minutes=1)
        else:
            return at.timestamp()
    raise ValueError(f"the schedule never comes: {spec}")


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{uuid.uuid4().hex[:8]}"
        self.rewriter = Rewriter(spark)
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        self.materialised: dict[str, MaterialisedView] = {}
        self.indexes: dict[str, tuple[str, list[str]]] = {}
        self.jobs: dict[str, dict] = {}
        self.history: list[tuple] = []
        self.triggers: dict[str, dict] = {}
        self.procedures: dict[str, Callable] = {}
        self.audit: list[tuple[float, str | None, str]] = []
        self.users: dict[str, set[str]] = {}  # user or role -> roles
        self.roles: set[str] = set()
        self.grants: set[tuple[str, str, str]] = set()  # who, privilege, table
        self._before: dict[str, Table] | None = None
        self._depth = 0
        self._now: float | None = None

    # statements

    def sql(self, text: str, args: list | None = None, user: str | None = None, now: float | None = None) -> DataFrame:
        """Run a statement; without ``user`` everything is allowed, ``now`` stands for the clock where jobs are made."""
        text = text.strip().rstrip(";").strip()
        self.audit.append((time.time(), user, text))
        if user is not None:
            self._allow(user, text)
        self._now = now
        for pattern, handler in self._handlers():
            if m := re.match(pattern, text, re.I | re.S):
                return handler(m)
        self._refresh_used(text)
        rewritten = self.rewriter.statement(self._system(text))
        return self.spark.sql(rewritten, args=args) if args else self.spark.sql(rewritten)

    # users and transactions

    def _allow(self, user: str, text: str) -> None:
        words = re.findall(r"\w+", text)
        what = words[0].upper() if words else ""
        held, todo = set(), [user.lower()]
        while todo:
            if (who := todo.pop()) not in held:
                held.add(who)
                todo += self.users.get(who, ())
        if user.lower() not in self.users:
            raise PermissionError(f"no user {user}")
        named = {w.lower() for w in words} & (set(self.tables) | set(self.views) | set(self.materialised))
        need = {(what if what in ("INSERT", "UPDATE", "DELETE") else "SELECT", t) for t in named} if what in ("SELECT", "WITH", "INSERT", "UPDATE", "DELETE") else {("ADMIN", "*")}
        for privilege, t in need:
            if not any((w, p, x) in self.grants for w in held for p in (privilege, "ALL") for x in (t, "*")):
                raise PermissionError(f"{user} may not {privilege} {t}")

    def _grant(self, give: bool, what: str, table: str | None, who: str) -> DataFrame:
        if table is None:
            (self.users[who.lower()].add if give else self.users[who.lower()].discard)(what.lower())
        else:
            for p in what.split(","):
                (self.grants.add if give else self.grants.discard)((who.lower(), p.strip().upper(), table.lower()))
        return self._say("granted" if give else "revoked", True)

    def _user(self, name: str, role: bool = False) -> DataFrame:
        self.users.setdefault(name.lower(), set())
        if role:
            self.roles.add(name.lower())
        return self._say("created", True)

    def _drop_user(self, name: str) -> DataFrame:
        self.users.pop(name.lower(), None)
        self.roles.discard(name.lower())
        self.grants = {g for g in self.grants if g[0] != name.lower()}
        return self._say("dropped", True)

    def begin(self) -> DataFrame:
        """Remember every table's version; versions are never overwritten, so going back is naming the old ones."""
        if self._before is not None:
            raise ValueError("a transaction is open")
        self._before = copy.deepcopy(self.tables)
        return self._say("begun", True)

    def end(self, keep: bool) -> DataFrame:
        if self._before is None:
            raise ValueError("no transaction is open")
        if not keep:
            for gone in set(self.tables) - set(self._before):
                self.spark.catalog.dropTempView(gone)
            self.tables = self._before
            for t in self.tables.values():
                self.frame(t.name).createOrReplaceTempView(t.name)
            for v in self.materialised.values():
                v.stale = True
        self._before = None
        return self._say("committed" if keep else "rolled_back", True)

    def _handlers(self):
        return [
            (r"CREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s+AS\s+(.*)", lambda m: self.create_as(m[2], m[3], bool(m[1]))),
            (r"CREATE\s+VIRTUAL\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s+USING\s+fts\d?\s*\((.*)\)", lambda m: self.create_table(m[2], ", ".join(f"{c.strip()} TEXT" for c in m[3].split(",")), bool(m[1]))),
            (r"CREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\((.*)\)", lambda m: self.create_table(m[2], m[3], bool(m[1]))),
            (r"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?(\w+)", lambda m: self.drop_table(m[2], bool(m[1]))),
            (r"ALTER\s+TABLE\s+(\w+)\s+ADD\s+(?:COLUMN\s+)?(.*)", lambda m: self.add_column(m[1], m[2])),
            (r"CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s+ON\s+(\w+)\s*\((.*)\)", lambda m: self.create_index(m[1], m[2], [c.strip() for c in m[3].split(",")])),
            (r"DROP\s+INDEX\s+(?:IF\s+EXISTS\s+)?(\w+)", lambda m: self._say("dropped", self.indexes.pop(m[1].lower(), None) is not None)),
            (r"CREATE\s+(OR\s+REPLACE\s+)?MATERIALIZED\s+VIEW\s+(\w+)\s+(?:REFRESH\s+(.*?)\s+)?AS\s+(.*)", lambda m: self.create_materialised(m[2], m[4], m[3] or "ON STALE")),
            (r"REFRESH\s+MATERIALIZED\s+VIEW\s+(\w+)", lambda m: self.refresh(m[1])),
            (r"DROP\s+MATERIALIZED\s+VIEW\s+(?:IF\s+EXISTS\s+)?(\w+)", lambda m: self._drop_view(m[1], self.materialised)),
            (r"ALTER\s+VIEW\s+(\w+)\s+MATERIALIZE", lambda m: self._materialise(m[1])),
            (r"ALTER\s+MATERIALIZED\s+VIEW\s+(\w+)\s+TO\s+VIEW", lambda m: self._to_view(m[1])),
            (r"CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s+AS\s+(.*)", lambda m: self.create_view(m[1], m[2])),
            (r"DROP\s+VIEW\s+(?:IF\s+EXISTS\s+)?(\w+)", lambda m: self._drop_view(m[1], self.views)),
            (r"INSERT\s+INTO\s+(\w+)\s*(?:\(([^)]*)\))?\s*(VALUES\s*.*?|SELECT\s.*?)(?:\s+RETURNING\s+(.*))?$", lambda m: self.insert(m[1], m[3], [c.strip() for c in m[2].split(",")] if m[2] else None, m[4])),
            (r"UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*?))?(?:\s+RETURNING\s+(.*))?$", lambda m: self.update(m[1], m[2], m[3], m[4])),
            (r"DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*?))?(?:\s+RETURNING\s+(.*))?$", lambda m: self.delete(m[1], m[2], m[3])),
            (r"CREATE\s+JOB\s+(\w+)\s+SCHEDULE\s+(CRON|INTERVAL|ONCE)\s+'([^']*)'\s+AS\s+(.*)", lambda m: self._job(m[1], kind=m[2].upper(), every=m[3], sql=m[4], enabled=True)),
            (r"ALTER\s+JOB\s+(\w+)\s+(ENABLE|DISABLE)", lambda m: self._job(m[1], enabled=m[2].upper() == "ENABLE")),
            (r"DROP\s+JOB\s+(\w+)", lambda m: self._say("dropped", self.jobs.pop(m[1].lower(), None) is not None)),
            (r"CREATE\s+TRIGGER\s+(\w+)\s+(BEFORE|AFTER)\s+(INSERT|UPDATE|DELETE)\s+ON\s+(\w+)\s+(?:FOR\s+EACH\s+ROW\s+)?BEGIN\s+(.*?);?\s*END", lambda m: self._trigger(m[1], m[2], m[3], m[4], m[5])),
            (r"DROP\s+TRIGGER\s+(?:IF\s+EXISTS\s+)?(\w+)", lambda m: self._say("dropped", self.triggers.pop(m[1].lower(), None) is not None)),
            (r"CALL\s+(\w+)\s*\((.*)\)", lambda m: self._call(m[1], m[2])),
            (r"BEGIN(?:\s+TRANSACTION)?$", lambda m: self.begin()),
            (r"(COMMIT|ROLLBACK|END)(?:\s+TRANSACTION)?$", lambda m: self.end(m[1].upper() != "ROLLBACK")),
            (r"CREATE\s+(USER|ROLE)\s+(\w+)", lambda m: self._user(m[2], m[1].upper() == "ROLE")),
            (r"DROP\s+(?:USER|ROLE)\s+(\w+)", lambda m: self._drop_user(m[1])),
            (r"GRANT\s+([\w\s,]+?)(?:\s+ON\s+(\w+|\*))?\s+TO\s+(\w+)", lambda m: self._grant(True, m[1], m[2], m[3])),
            (r"REVOKE\s+([\w\s,]+?)(?:\s+ON\s+(\w+|\*))?\s+FROM\s+(\w+)", lambda m: self._grant(False, m[1], m[2], m[3])),
            (r"VACUUM$", lambda m: self.vacuum()),
            (r"ANALYZE(?:\s+TABLE)?\s+(\w+)", lambda m: self.analyse(m[1])),
            (r"EXPLAIN\s+(ANALYZE\s+)?(.*)", lambda m: self.explain(m[2], bool(m[1]))),
            (r"PRAGMA\s+(\w+)\s*(?:\(\s*'?(\w+)'?\s*\))?", lambda m: self.pragma(m[1], m[2])),
        ]

    # tables

    def create_table(self, name: str, body: str, if_missing: bool = False) -> DataFrame:
        if name.lower() in self.tables:
            if if_missing:
                return self._say("created", False)
            raise ValueError(f"table {name} exists")
        columns, depth, part = [], 0, ""
        for c in body + ",":
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                columns.append(self._column(part.strip()))
                part = ""
            else:
                part += c
        t = self.tables[name.lower()] = Table(name, columns)
        self._swap(t, self.spark.createDataFrame([], self._schema(t)))
        return self._say("created", True)

    @staticmethod
    def _column(text: str) -> Column:
        m = re.match(r"(\w+)(?:\s+(\w+)(\s*\([^)]*\))?)?(.*)", text, re.S)
        declared = (m[2] or "ANY").upper()
        kind = f"decimal{m[3].strip()}" if declared in ("DECIMAL", "NUMERIC") and m[3] else _TYPES.get(declared, "bigint" if declared.startswith(("INT", "UINT")) else "string")
        rest = whole = m[4]
        ref = re.search(r"REFERENCES\s+(\w+)\s*\((\w+)\)", rest, re.I)
        action = lambda event: " ".join((m[1] if (m := re.search(rf"ON\s+{event}\s+(CASCADE|SET\s+NULL|RESTRICT|NO\s+ACTION)", whole, re.I)) else "RESTRICT").upper().split())
        default = re.search(r"DEFAULT\s+('(?:[^']|'')*'|\S+)", rest, re.I)
        rest = re.sub(r"ON\s+(?:DELETE|UPDATE)\s+SET\s+NULL", "", rest, flags=re.I)
        primary = bool(re.search(r"PRIMARY\s+KEY", rest, re.I))
        return Column(m[1], kind, declared, primary or bool(re.search(r"NOT\s+NULL", rest, re.I)), primary, bool(re.search(r"\bUNIQUE\b", rest, re.I)), default[1] if default else None, (ref[1].lower(), ref[2], action("DELETE"), action("UPDATE")) if ref else None)

    @staticmethod
    def _schema(t: Table) -> str:
        return ", ".join(f"`{c.name}` {c.type}" for c in t.columns)

    def _swap(self, t: Table, rows: DataFrame, event: str = "") -> None:
        path = f"{self.folder}/{t.name.lower()}/v{t.version + 1}"
        rows.write.parquet(path)
        t.version, t.path, t.statistics = t.version + 1, path, None
        self.frame(t.name).createOrReplaceTempView(t.name)
        for v in self.materialised.values():
            v.stale = v.stale or t.name.lower() in v.reads

    def frame(self, name: str) -> DataFrame:
        t = self.tables[name.lower()]
        return self.spark.read.schema(self._schema(t)).parquet(t.path)

    def create_as(self, name: str, query: str, if_missing: bool = False) -> DataFrame:
        if name.lower() in self.tables and if_missing:
            return self._say("created", False)
        rows = self.sql(query)
        t = self.tables[name.lower()] = Table(name, [Column(f.name, f.dataType.simpleString(), f.dataType.simpleString().upper()) for f in rows.schema])
        self._swap(t, rows)
        return self._say("created", True)

    def drop_table(self, name: str, if_exists: bool = False) -> DataFrame:
        if name.lower() not in self.tables and not if_exists:
            raise KeyError(f"no table {name}")
        self.spark.catalog.dropTempView(name)
        return self._say("dropped", self.tables.pop(name.lower(), None) is not None)

    def add_column(self, name: str, text: str) -> DataFrame:
        t, c = self.tables[name.lower()], self._column(text)
        rows = self.frame(name).withColumn(c.name, F.expr(c.default or "NULL").cast(c.type))
        t.columns.append(c)
        self._swap(t, rows)
        return self._say("altered", True)

    def create_index(self, name: str, table: str, columns: list[str]) -> DataFrame:
        """Lay the table out by the columns, so that row-group statistics narrow a scan."""
        t = self.tables[table.lower()]
        self.indexes[name.lower()] = (table, columns)
        self._swap(t, self.frame(table).repartitionByRange(*columns).sortWithinPartitions(*columns))
        return self._say("created", True)

    def vacuum(self) -> DataFrame:
        """Remove the files of versions that no table, view or open transaction names; what was read from them before is gone then."""
        held = {t.path for t in [*self.tables.values(), *(self._before or {}).values()]} | {v.path for v in self.materialised.values()}
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = 0
        for kind in fs.listStatus(where) if fs.exists(where) else []:
            parts = fs.listStatus(kind.getPath())
            if kind.getPath().getName() == "views":
                parts = [p for v in parts for p in fs.listStatus(v.getPath())]
            for part in parts:
                if not any(part.getPath().toString().endswith(re.sub(r"^\w+:/*", "/", h)) for h in held if h):
                    gone += fs.delete(part.getPath(), True)
        return self._say("removed", gone)

    # changes

    def insert(self, name: str, source: str, columns: list[str] | None = None, returning: str | None = None) -> DataFrame:
        t = self.tables[name.lower()]
        given = columns or [c.name for c in t.columns]
        new = self.sql(source) if source.upper().startswith("SELECT") else self.spark.sql(self.rewriter.statement(f"SELECT * FROM {source}"))
        new = new.toDF(*given)
        have = {g.lower(): g for g in given}
        new = new.select(*((F.col(f"`{have[c.name.lower()]}`") if c.name.lower() in have else F.expr(c.default or "NULL")).cast(c.type).alias(c.name) for c in t.columns))
        new = self._kept(new, name)
        change = new.select(F.struct(*new.columns).alias("NEW"))
        self._fire("BEFORE", "INSERT", name, change)
        rows = self.frame(name).unionByName(new)
        self._check(t, new, rows)
        self._swap(t, rows)
        self._fire("AFTER", "INSERT", name, change)
        return new.selectExpr(*_items(returning)) if returning else self._say("inserted", new.count())

    def update(self, name: str, sets: str, where: str | None, returning: str | None = None) -> DataFrame:
        t = self.tables[name.lower()]
        cond = F.coalesce(F.expr(self.rewriter.nested(_tokens(where))), F.lit(False)) if where else F.lit(True)
        to = {k.strip().lower(): v.strip() for k, _, v in (x.partition("=") for x in _items(sets))}
        old = self.frame(name).withColumn("__hit", cond).withColumn("__old", F.struct(*(c.name for c in t.columns)))
        rows = old.select(*(F.when(F.col("__hit"), F.expr(self.rewriter.nested(_tokens(to[c.name.lower()]))).cast(c.type)).otherwise(F.col(c.name)).alias(c.name) if c.name.lower() in to else F.col(c.name) for c in t.columns), "__hit", "__old")
        rows = self._kept(rows, name)
        hit = rows.where("__hit")
        change = hit.select(F.col("__old").alias("OLD"), F.struct(*(c.name for c in t.columns)).alias("NEW"))
        hit, rows = hit.drop("__hit", "__old"), rows.drop("__hit", "__old")
        self._fire("BEFORE", "UPDATE", name, change)
        self._check(t, hit, rows)
        self._follow(t, change, set(to))
        self._swap(t, rows)
        self._fire("AFTER", "UPDATE", name, change)
        return hit.selectExpr(*_items(returning)) if returning else self._say("updated", hit.count())

    def delete(self, name: str, where: str | None, returning: str | None = None) -> DataFrame:
        t = self.tables[name.lower()]
        cond = F.coalesce(F.expr(self.rewriter.nested(_tokens(where))), F.lit(False)) if where else F.lit(True)
        old = self.frame(name)
        gone = self._kept(old.where(cond), name)
        change = gone.select(F.struct(*gone.columns).alias("OLD"))
        self._fire("BEFORE", "DELETE", name, change)
        self._cascade(t, gone)
        self._swap(t, old.where(~cond))
        self._fire("AFTER", "DELETE", name, change)
        return gone.selectExpr(*_items(returning)) if returning else self._say("deleted", gone.count())

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name.lower()}/change-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _check(self, t: Table, new: DataFrame, rows: DataFrame) -> None:
        for c in t.columns:
            if c.not_null and not new.where(F.col(c.name).isNull()).isEmpty():
                raise ConstraintError(f"{t.name}.{c.name} is null")
            if (c.primary or c.unique) and not rows.where(F.col(c.name).isNotNull()).groupBy(c.name).count().where("count > 1").isEmpty():
                raise ConstraintError(f"{t.name}.{c.name} is not unique")
            if c.references and not new.where(F.col(c.name).isNotNull()).join(self.frame(c.references[0]).select(F.col(c.references[1]).alias("__k")), F.col(c.name) == F.col("__k"), "left_anti").isEmpty():
                raise ConstraintError(f"{t.name}.{c.name} refers to no row of {c.references[0]}")

    def _cascade(self, t: Table, gone: DataFrame) -> None:
        for child in list(self.tables.values()):
            for c in child.columns:
                if c.references and c.references[0] == t.name.lower():
                    keys = gone.select(F.col(c.references[1]).alias("__k")).distinct()
                    own = self.frame(child.name)
                    met = own.join(keys, F.col(c.name) == F.col("__k"), "left_semi")
                    if met.isEmpty():
                        continue
                    if c.references[2] == "CASCADE":
                        met = self._kept(met, child.name)
                        self._cascade(child, met)
                        self._swap(child, own.join(keys, F.col(c.name) == F.col("__k"), "left_anti"))
                    elif c.references[2] == "SET NULL":
                        nulled = own.join(keys, F.col(c.name) == F.col("__k"), "left").select(*(F.when(F.col("__k").isNull(), F.col(c.name)).alias(c.name) if x.name == c.name else F.col(x.name) for x in child.columns))
                        self._swap(child, nulled)
                    else:
                        raise ConstraintError(f"rows of {child.name} refer to {t.name}")

    def _follow(self, t: Table, change: DataFrame, changed: set[str]) -> None:
        """What an update of referenced keys does to the rows that refer to them."""
        for child in list(self.tables.values()):
            for c in child.columns:
                if not c.references or c.references[0] != t.name.lower() or c.references[1].lower() not in changed:
                    continue
                keys = change.select(F.col(f"OLD.{c.references[1]}").alias("__k"), F.col(f"NEW.{c.references[1]}").alias("__to")).where("__k is distinct from __to and __k is not null")
                own = self.frame(child.name)
                if own.join(keys, F.col(c.name) == F.col("__k"), "left_semi").isEmpty():
                    continue
                if c.references[3] not in ("CASCADE", "SET NULL"):
                    raise ConstraintError(f"rows of {child.name} refer to {t.name}")
                to = F.col("__to") if c.references[3] == "CASCADE" else F.lit(None)
                moved = own.join(keys, F.col(c.name) == F.col("__k"), "left")
                self._swap(child, moved.select(*(F.when(F.col("__k").isNull(), F.col(c.name)).otherwise(to).cast(c.type).alias(c.name) if x.name == c.name else F.col(x.name) for x in child.columns)))

    # views

    def create_view(self, name: str, query: str) -> DataFrame:
        self.views[name.lower()] = query
        self.sql(query).createOrReplaceTempView(name)
        return self._say("created", True)

    def create_materialised(self, name: str, query: str, policy: str = "ON STALE") -> DataFrame:
        v = self.materialised[name.lower()] = MaterialisedView(name, query, policy.upper(), reads=self._reads(query))
        self.refresh(v.name)
        return self._say("created", True)

    def _reads(self, query: str) -> set[str]:
        words = {w.lower() for w in re.findall(r"\w+", query)}
        found = words & set(self.tables)
        for name in words & (set(self.views) | set(self.materialised)):
            found |= self._reads(self.views.get(name) or self.materialised[name].query)
        return found

    def refresh(self, name: str) -> DataFrame:
        v = self.materialised[name.lower()]
        path = f"{self.folder}/views/{name.lower()}/{uuid.uuid4().hex[:8]}"
        self.sql(v.query).write.parquet(path)
        v.path, v.stale, v.refreshed = path, False, time.time()
        self.spark.read.parquet(path).createOrReplaceTempView(v.name)
        return self._say("refreshed", True)

    def _refresh_used(self, text: str) -> None:
        words = {w.lower() for w in re.findall(r"\w+", text)}
        for n in words & set(self.materialised):
            v = self.materialised[n]
            if v.policy.startswith(("MANUAL", "ON DEMAND")):
                continue
            every = re.match(r"EVERY\s+'?(\d+)\s*(S|M|H|D)?", v.policy)
            old = every and time.time() - v.refreshed > int(every[1]) * {"S": 1, "M": 60, "H": 3600, "D": 86400}[every[2] or "S"]
            if old or v.stale and not every or v.policy.startswith("DAILY") and time.time() - v.refreshed > 86400:
                self.refresh(v.name)
        for n in words & set(self.views):
            self.sql(self.views[n]).createOrReplaceTempView(n)

    def _drop_view(self, name: str, where: dict) -> DataFrame:
        self.spark.catalog.dropTempView(name)
        return self._say("dropped", where.pop(name.lower(), None) is not None)

    def _materialise(self, name: str) -> DataFrame:
        return self.create_materialised(name, self.views.pop(name.lower()))

    def _to_view(self, name: str) -> DataFrame:
        return self.create_view(name, self.materialised.pop(name.lower()).query)

    # jobs, triggers, procedures

    def _job(self, name: str, **fields) -> DataFrame:
        job = self.jobs.setdefault(name.lower(), {"name": name, "next": 0.0})
        job.update(fields)
        if job.get("kind") == "CRON" and "every" in fields:
            job["next"] = cron_next(job["every"], self._now or time.time())
        return self._say("jobs", len(self.jobs))

    def run_due_jobs(self, now: float | None = None) -> list[str]:
        """Run every enabled job that is due; a scheduler thread or an outer cron calls this."""
        now, ran = now or time.time(), []
        for j in self.jobs.values():
            if j.get("enabled") and j["next"] <= now:
                start = time.time()
                try:
                    self.sql(j["sql"])
                    state = "ok"
                except Exception as e:  # a failed job is history, not the end of the scheduler
                    state = str(e)[:200]
                self.history.append((j["name"], start, time.time(), state))
                m = re.match(r"(\d+)\s*([SMHD]?)", j["every"].upper()) if j["kind"] == "INTERVAL" else None
                j["next"] = now + int(m[1]) * {"": 1, "S": 1, "M": 60, "H": 3600, "D": 86400}[m[2]] if m else cron_next(j["every"], now) if j["kind"] == "CRON" else float("inf")
                ran.append(j["name"])
        return ran

    def _trigger(self, name: str, when: str, event: str, table: str, body: str) -> DataFrame:
        self.triggers[name.lower()] = {"name": name, "when": when.upper(), "event": event.upper(), "table": table.lower(), "body": [s.strip() for s in body.split(";") if s.strip()]}
        return self._say("created", True)

    def _fire(self, when: str, event: str, table: str, change: DataFrame) -> None:
        """Run the triggers for every changed row; NEW and OLD are columns of ``change``.

        An INSERT of values in a body is one INSERT for all rows; other statements run
        row by row, with the row's values in place of NEW and OLD.
        """
        if self._depth >= 32:
            raise RecursionError("triggers are nested too deeply")
        self._depth += 1
        try:
            for t in list(self.triggers.values()):
                if (t["when"], t["event"], t["table"]) == (when, event, table.lower()):
                    for s in t["body"]:
                        self._react(s, change)
        finally:
            self._depth -= 1

    def _react(self, statement: str, change: DataFrame) -> None:
        if m := re.match(r"(INSERT\s+INTO\s+\w+\s*(?:\([^)]*\))?)\s*VALUES\s*\((.*)\)\s*$", statement, re.I | re.S):
            view = f"__change_{uuid.uuid4().hex[:8]}"
            change.createOrReplaceTempView(view)
            self.sql(f"{m[1]} SELECT {m[2]} FROM {view}")
            self.spark.catalog.dropTempView(view)
            return
        for row in change.toLocalIterator():
            at = {k.upper(): {n.lower(): v for n, v in row[k].asDict().items()} for k in change.columns}
            self.sql(re.sub(r"\b(NEW|OLD)\.(\w+)", lambda m: literal(at.get(m[1].upper(), {}).get(m[2].lower())), statement, flags=re.I))  # noqa: B023

    def register_procedure(self, name: str, f: Callable) -> None:
        self.procedures[name.lower()] = f

    def _call(self, name: str, args: str) -> DataFrame:
        values = list(self.spark.sql(f"SELECT {args}").first()) if args.strip() else []
        out = self.procedures[name.lower()](self, *values)
        return out if isinstance(out, DataFrame) else self._say("called", out is None or out)

    # information

    def analyse(self, name: str) -> DataFrame:
        df = self.frame(name)
        aggs = [F.count("*").alias("rows")]
        for c in df.columns:
            aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}__nulls"), F.approx_count_distinct(F.col(c).cast("string")).alias(f"{c}__distinct"), F.min(F.col(c).cast("string")).alias(f"{c}__min"), F.max(F.col(c).cast("string")).alias(f"{c}__max")]
        r = df.agg(*aggs).first().asDict()
        found = [(name, c, r["rows"], r[f"{c}__nulls"], r[f"{c}__distinct"], r[f"{c}__min"], r[f"{c}__max"]) for c in df.columns]
        self.tables[name.lower()].statistics = found
        return self.spark.createDataFrame(found, "table string, column string, rows long, nulls long, distinct_values long, min string, max string")

    def explain(self, query: str, run: bool = False) -> DataFrame:
        df = self.sql(query)
        text = df._jdf.queryExecution().toString()
        rows = [(k, line) for k, line in enumerate(text.splitlines())]
        if run:
            start = time.time()
            n = df.count()
            rows.append((len(rows), f"{n} rows in {time.time() - start:.3f} s"))
        return self.spark.createDataFrame(rows, "step int, plan string")

    def pragma(self, name: str, arg: str | None) -> DataFrame:
        name = name.lower()
        if name in ("table_info", "table_xinfo"):
            t = self.tables[arg.lower()]
            return self.spark.createDataFrame([(k, c.name, c.declared, int(c.not_null), c.default, int(c.primary)) for k, c in enumerate(t.columns)], "cid int, name string, type string, notnull int, dflt_value string, pk int")
        if name == "table_list":
            return self.spark.createDataFrame([("main", t.name, "table", len(t.columns)) for t in self.tables.values()], "schema string, name string, type string, ncol int")
        values = {"database_list": "main", "schema_version": str(sum(t.version for t in self.tables.values())), "user_version": "0", "application_id": "0", "foreign_keys": "1", "journal_mode": "memory", "integrity_check": "ok", "quick_check": "ok", "compile_options": "SPARK"}
        return self.spark.createDataFrame([(values[name],)], f"{name} string")

    def _system(self, text: str) -> str:
        """System tables become temporary views when a query names them."""
        for schema, name in set(re.findall(r"\b(sys|catalog)\.(\w+)", text, re.I)):
            rows, cols = self._system_rows(name.lower())
            self.spark.createDataFrame(rows, cols).createOrReplaceTempView(f"__{schema.lower()}_{name.lower()}")
            text = re.sub(rf"\b{schema}\.{name}\b", f"__{schema.lower()}_{name.lower()}", text)
        if re.search(r"\bsqlite_(schema|master)\b", text, re.I):
            rows = [("table", t.name, t.name, self._schema(t)) for t in self.tables.values()] + [("view", n, n, q) for n, q in self.views.items()]
            self.spark.createDataFrame(rows, "type string, name string, tbl_name string, sql string").createOrReplaceTempView("__sqlite_schema")
            text = re.sub(r"\bsqlite_(schema|master)\b", "__sqlite_schema", text, flags=re.I)
        return text

    def _system_rows(self, name: str):
        from ..functions import register

        ts = self.tables.values()
        kinds = {
            "tables": ([(t.name, len(t.columns), t.version) for t in ts], "name string, columns int, version int"),
            "columns": ([(t.name, c.name, c.type, c.not_null, c.default) for t in ts for c in t.columns], "table string, name string, type string, not_null boolean, default_value string"),
            "constraints": ([(t.name, c.name, k) for t in ts for c in t.columns for k, on in (("PRIMARY KEY", c.primary), ("UNIQUE", c.unique), ("NOT NULL", c.not_null), ("FOREIGN KEY", bool(c.references))) if on], "table string, column string, kind string"),
            "indexes": ([(n, t, ",".join(c)) for n, (t, c) in self.indexes.items()], "name string, table string, columns string"),
            "views": (list(self.views.items()), "name string, sql string"),
            "materialized_views": ([(v.name, v.query, v.policy, v.stale, v.refreshed) for v in self.materialised.values()], "name string, sql string, policy string, stale boolean, refreshed double"),
            "functions": ([(n,) for n in register.names()], "name string"),
            "procedures": ([(n,) for n in self.procedures], "name string"),
            "jobs": ([(j["name"], j.get("kind"), j.get("every"), j.get("sql"), j.get("enabled")) for j in self.jobs.values()], "name string, kind string, schedule string, sql string, enabled boolean"),
            "job_history": (self.history, "name string, started double, ended double, state string"),
            "triggers": ([(t["name"], t["when"], t["event"], t["table"]) for t in self.triggers.values()], "name string, timing string, event string, table string"),
            "objects": ([(t.name, "table") for t in ts] + [(n, "view") for n in self.views] + [(n, "materialized view") for n in self.materialised], "name string, kind string"),
            "dependencies": ([(n, r) for n, q in {**self.views, **{k: v.query for k, v in self.materialised.items()}}.items() for r in sorted(self._reads(q))], "name string, reads string"),
            "statistics": ([r for t in ts if t.statistics for r in t.statistics], "table string, column string, rows long, nulls long, distinct_values long, min string, max string"),
            "audit": ([*self.audit], "at double, user string, statement string"),
            "users": ([(u, u in self.roles, ",".join(sorted(r))) for u, r in self.users.items()], "name string, is_role boolean, roles string"),
            "grants": (sorted(self.grants), "name string, privilege string, table string"),
            "config": (sorted(self.spark.conf.getAll.items()) if hasattr(self.spark.conf, "getAll") and not callable(self.spark.conf.getAll) else [], "key string, value string"),
            "variables": ([("version", "0.1.0"), ("folder", self.folder)], "name string, value string"),
            "status": ([("tables", len(self.tables)), ("statements", len(self.audit))], "name string, value long"),
            "storage": ([(t.name, t.path) for t in ts], "table string, path string"),
            "memory": ([("default_parallelism", self.spark.sparkContext.defaultParallelism)], "name string, value long"),
            "connections": ([(self.spark.sparkContext.applicationId,)], "id string"),
            "extensions": ([], "name string"),
        }
        return kinds[name]

    def _say(self, what: str, value) -> DataFrame:
        return self.spark.createDataFrame([(int(value),)], f"{what} long")


def _tokens(text: str) -> list[str]:
    from .sql import tokenise

    return tokenise(text)


def _items(text: str) -> list[str]:
    from .sql import _split, tokenise

    return ["".join(x).strip() for x in _split(tokenise(text))]
