"""A fluent builder that makes DataFrame calls: ``select("a").from_(df).where("a > 1").build()``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SelectBuilder:
    def __init__(self, *items: str | Column):
        self.items, self.source, self.steps = items or ("*",), None, []
        self.parts: list[str] = []  # joins and tests as SQL text, where tables are names
        self.tests_text: list[str] = []
        self.named: list[tuple[str, SelectBuilder]] = []
        self.keys: tuple = ()
        self.tests: list[str | Column] = []
        self.order: list[Column] = []
        self.order_text: list[str] = []
        self.is_distinct, self.most, self.skip = False, None, 0

    def distinct(self):
        self.is_distinct = True
        return self

    def from_(self, df: DataFrame | str):
        """A DataFrame, or the name of a table for ``to_sql``."""
        self.source = df
        return self

    def with_(self, name: str, query: SelectBuilder):
        """A named query before this one; for ``to_sql``."""
        self.named.append((name, query))
        return self

    def join(self, df: DataFrame | str, on, how: str = "inner"):
        if isinstance(df, str):
            self.parts.append(f"{how.upper()} JOIN {df} ON {on}")
            return self
        self.steps.append(lambda d: d.join(df, F.expr(on) if isinstance(on, str) and not on.isidentifier() else on, how))
        return self

    def left_join(self, df: DataFrame, on):
        return self.join(df, on, "left")

    def right_join(self, df: DataFrame, on):
        return self.join(df, on, "right")

    def full_join(self, df: DataFrame, on):
        return self.join(df, on, "full")

    def cross_join(self, df: DataFrame):
        self.steps.append(lambda d: d.crossJoin(df))
        return self

    def exists(self, df: DataFrame, on):
        return self.join(df, on, "left_semi")

    def not_exists(self, df: DataFrame, on):
        return self.join(df, on, "left_anti")

    def where(self, test: str | Column):
        self.steps.append(lambda d: d.where(test))
        self.tests_text.append(str(test))
        return self

    def group_by(self, *keys: str):
        self.keys = keys
        return self

    def having(self, test: str | Column):
        self.tests.append(test)
        return self

    def order_by(self, *columns: str):
        """Names, with a leading minus for descending; nulls last either way."""
        self.order_text = [f"{c[1:]} DESC NULLS LAST" if c.startswith("-") else f"{c} ASC NULLS LAST" for c in columns]
        self.order = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in columns]
        return self

    def limit(self, n: int):
        self.most = n
        return self

    def offset(self, n: int):
        self.skip = n
        return self

    def to_sql(self) -> str:
        """The same as a statement; tables must have been given by name and expressions as text."""
        out = "WITH " + ", ".join(f"{n} AS ({q.to_sql()})" for n, q in self.named) + " " if self.named else ""
        items = [*(k for k in self.keys if k not in self.items), *self.items]
        out += f"SELECT {'DISTINCT ' if self.is_distinct else ''}{', '.join(map(str, items))} FROM {self.source}"
        out += "".join(f" {p}" for p in self.parts)
        out += " WHERE " + " AND ".join(f"({t})" for t in self.tests_text) if self.tests_text else ""
        out += f" GROUP BY {', '.join(self.keys)}" if self.keys else ""
        out += " HAVING " + " AND ".join(f"({t})" for t in self.tests) if self.tests else ""
        out += " ORDER BY " + ", ".join(self.order_text) if self.order_text else ""
        return out + (f" LIMIT {self.most}" if self.most is not None else "") + (f" OFFSET {self.skip}" if self.skip else "")

    def build(self) -> DataFrame:
        d = self.source
        for step in self.steps:
            d = step(d)
        columns = [F.expr(x) if isinstance(x, str) else x for x in self.items]
        if self.keys:
            d = d.groupBy(*self.keys).agg(*columns)
            for t in self.tests:
                d = d.where(t)
        else:
            d = d.select(*columns)
        d = d.distinct() if self.is_distinct else d
        d = d.orderBy(*self.order) if self.order else d
        d = d.offset(self.skip) if self.skip else d
        return d if self.most is None else d.limit(self.most)


def select(*items: str | Column) -> SelectBuilder:
    return SelectBuilder(*items)


def literal(v) -> str:
    """A Python value as SQL text."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def insert_into(table: str, columns: list[str], rows: list[tuple]) -> str:
    return f"INSERT INTO {table} ({', '.join(columns)}) VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


def update(table: str, values: dict, where: str | None = None) -> str:
    return f"UPDATE {table} SET " + ", ".join(f"{k} = {literal(v)}" for k, v in values.items()) + (f" WHERE {where}" if where else "")


def delete_from(table: str, where: str | None = None) -> str:
    return f"DELETE FROM {table}" + (f" WHERE {where}" if where else "")


def create_table(table: str, columns: dict[str, str]) -> str:
    return f"CREATE TABLE {table} (" + ", ".join(f"{k} {v}" for k, v in columns.items()) + ")"


def drop_table(table: str, if_exists: bool = False) -> str:
    return f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{table}"
