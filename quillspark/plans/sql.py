"""A thin layer over Spark SQL: statements are rewritten token by token where the dialect differs.

Rewritten: bare table names, DISTINCT ON, GLOB, SIMILAR TO, MOVING_SUM / MOVING_AVG,
EQUAL_INTERVAL, NATURAL_BREAKS, FIRST_VALUE over its whole partition, set operations
from left to right, nulls last in every ORDER BY, OFFSET ... FETCH, null members of
IN lists, bare columns beside aggregates, names of unnamed items, ROW_TO_TEXT, calls
of table functions in FROM and JOIN, and calls of functions that
``functions.register`` knows.  All else is Spark SQL.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from ..functions import register
from ..sources import readers
from . import table_functions

_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|[A-Za-z_][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?[DLdl]?|<=>|<>|!=|<=|>=|\|\||->|::|.""", re.S)
#: Functions whose Spark namesake means the same, so calls stay as they are.
SAME = frozenset(
    "coalesce nullif greatest least cast upper lower concat_ws replace instr reverse repeat lpad rpad levenshtein regexp_replace md5 sha1 base64 power exp pi sin cos tan atan atan2 degrees radians now current_timestamp current_date date_trunc year month day hour minute second quarter dayofweek dayofyear weekofyear array_distinct array_sort count sum avg min max median row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value uuid url_encode url_decode char_length".split()
)
_END_OF_ORDER = frozenset("LIMIT OFFSET UNION EXCEPT INTERSECT FETCH ROWS RANGE WINDOW HAVING".split())


def tokenise(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not t.startswith(("--", "/*"))]


def _close(tokens: list[str], at: int) -> int:
    """Index of the parenthesis that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(tokens)):
        depth += (tokens[k] == "(") - (tokens[k] == ")")
        if depth == 0:
            return k
    raise ValueError("a parenthesis is not closed")


def _split(tokens: list[str], sep: str = ",") -> list[list[str]]:
    out, depth = [[]], 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t == sep and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _text(tokens: list[str]) -> str:
    return "".join(tokens).strip()


def _words(tokens: list[str]) -> list[tuple[int, str]]:
    """(index, upper-case text) of the tokens that are not white space, at depth 0."""
    out, depth = [], 0
    for k, t in enumerate(tokens):
        if t == ")":
            depth -= 1
        if depth == 0 and not t.isspace():
            out.append((k, t.upper()))
        if t == "(":
            depth += 1
    return out


def glob_to_regex(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def similar_to_regex(pattern: str) -> str:
    return "^(?:" + "".join(".*" if c == "%" else "." if c == "_" else c for c in pattern) + ")$"


def _literal(token: str) -> str:
    return token[1:-1].replace("''", "'")


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Rewriter:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def statement(self, sql: str) -> str:
        tokens = tokenise(sql.strip().rstrip(";"))
        words = [t for t in tokens if not t.isspace()]
        if len(words) == 1 and re.fullmatch(r"[A-Za-z_]\w*|`[^`]*`", words[0]):
            return f"SELECT * FROM {words[0]}"
        return self.query(tokens)

    def query(self, tokens: list[str]) -> str:
        """A query expression: WITH, set operations, a SELECT, or anything else."""
        words = _words(tokens)
        if words and words[0][1] == "WITH":
            start = next((k for k, w in words if w in ("SELECT", "VALUES", "FROM")), None)
            if start is not None:
                return self.nested(tokens[:start]) + self.query(tokens[start:])
        cuts = [(n, k, w) for n, (k, w) in enumerate(words) if w in ("UNION", "EXCEPT", "INTERSECT")]
        if cuts and words[0][1] in ("SELECT", "("):
            return self.chain(tokens, words, cuts)
        if words and words[0][1] == "SELECT":
            tokens = self.fetch(tokens, words)
            words = _words(tokens)
        if words and words[0][1] == "SELECT":
            return self.select(tokens, words)
        return self.nested(tokens)

    def chain(self, tokens: list[str], words, cuts) -> str:
        tail = next((k for n, (k, w) in enumerate(words) if n > cuts[-1][0] and (w in ("LIMIT", "OFFSET") or w == "ORDER")), len(tokens))
        if len(cuts) == 1:  # nothing to group; a recursive query must stay as it is
            n, k, w = cuts[0]
            more = words[n + 1]
            how = f"{w} {more[1]}" if more[1] in ("ALL", "DISTINCT") else w
            begin = more[0] + 1 if more[1] in ("ALL", "DISTINCT") else k + 1
            return f"{self.query(tokens[:k]).rstrip()} {how} {self.query(tokens[begin:tail]).strip()} {self.nested(tokens[tail:])}"
        out, begin, how = "", 0, ""
        for n, k, w in [*cuts, (None, tail, "")]:
            term = self.query(tokens[begin:k])
            term = term if term.lstrip().startswith("(") else f"({term})"
            out = term if not out else f"({out} {how} {term})"
            if n is not None:
                more = words[n + 1]
                how, begin = (f"{w} {more[1]}", more[0] + 1) if more[1] in ("ALL", "DISTINCT") else (w, k + 1)
        return f"SELECT * FROM {out if out.startswith('((') else '(' + out + ')'} {self.nested(tokens[tail:])}"

    def select(self, tokens: list[str], words) -> str:
        if len(words) > 2 and words[1][1] == "DISTINCT" and words[2][1] == "ON":
            at = words[3][0]
            end = _close(tokens, at)
            keys = self.nested(tokens[at + 1 : end])
            order = next((n for n, (k, w) in enumerate(words) if w == "ORDER" and words[n + 1][1] == "BY"), None)
            stop = next((k for n, (k, w) in enumerate(words) if w in ("LIMIT", "OFFSET")), len(tokens))
            by = self.nested(tokens[words[order][0] : stop]) if order is not None else "ORDER BY 1"
            body = words[order][0] if order is not None else stop
            source = next(k for k, w in words if w == "FROM")
            items = [self.nested(x).strip() for x in _split(tokens[end + 1 : source])]
            names = [f"__c{n}" for n in range(len(items))]
            shown = [_alias(x) for x in items]
            plain = [re.sub(r"(?is)\s+AS\s+[`\w]+\s*$", "", x) for x in items]
            inner = ", ".join(f"{p} AS {n}" for p, n in zip(plain, names, strict=True))
            return f"SELECT {', '.join(f'{n} AS {s}' for n, s in zip(names, shown, strict=True))} FROM (SELECT {inner}, row_number() OVER (PARTITION BY {keys} {by}) AS __n FROM {self.nested(tokens[source + 1 : body])}) WHERE __n = 1 {self.nested(tokens[stop:])}"
        return self.nested(self.items(tokens, words))

    @staticmethod
    def fetch(tokens: list[str], words) -> list[str]:
        """OFFSET n ROWS FETCH FIRST m ROWS ONLY as LIMIT m OFFSET n."""
        at = next((n for n, (_, w) in enumerate(words) if w == "FETCH" and n + 3 < len(words) and words[n + 1][1] in ("FIRST", "NEXT")), None)
        if at is None:
            return tokens
        most = tokens[words[at + 2][0]] if words[at + 2][1] not in ("ROW", "ROWS") else "1"
        head, offset = words[at][0], []
        if at > 2 and words[at - 1][1] in ("ROW", "ROWS") and words[at - 3][1] == "OFFSET":
            head, offset = words[at - 3][0], [" ", "OFFSET", " ", tokens[words[at - 2][0]]]
        return [*tokens[:head], "LIMIT", " ", most, *offset]

    def items(self, tokens: list[str], words) -> list[str]:
        """The SELECT list with ROW_TO_TEXT spelt out, bare columns beside aggregates made a value of the group, and unnamed expressions named."""
        first = 2 if len(words) > 1 and words[1][1] in ("DISTINCT", "ALL") else 1
        if len(words) <= first or words[first][1] in ("*", "TRANSFORM"):
            return tokens
        source = next((k for k, w in words if w == "FROM"), len(tokens))
        stops = ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "WINDOW")
        group = next((n for n, (_, w) in enumerate(words) if w == "GROUP"), None)
        keys: list[str] = []
        plain_group = group is None
        if group is not None:
            begin = words[group + 1][0] + 1
            end = next((k for n, (k, w) in enumerate(words) if n > group and w in stops[2:]), len(tokens))
            keys = [_text(x).lower() for x in _split(tokens[begin:end])]
            plain_group = not any(re.search(r"(?i)\b(rollup|cube|sets|all)\b", k) for k in keys)
        shown = _split(tokens[words[first][0] : source])
        aggregated = group is not None or any(_aggregates(x) for x in shown)
        out = []
        for at, x in enumerate(shown):
            body, alias = _named(x)
            if source < len(tokens):
                body = re.sub(r"(?i)\bvec_avg\s*\(([^(),]+)\)", lambda m: self.mean_vector(m[1].strip(), tokens[source : next((k for k, w in words if k > source and w in stops), len(tokens))]), body)
            if re.fullmatch(r"(?i)row_to_text\s*\(\s*\)", body):
                end = next((k for k, w in words if k > source and w in stops), len(tokens))
                columns = sorted(self.spark.sql(f"SELECT * {self.nested(tokens[source:end])} LIMIT 0").columns)
                body = "concat_ws(' ', " + ", ".join(f"CAST(`{c}` AS STRING)" for c in columns) + ")"
            bare = re.fullmatch(r"(?:[A-Za-z_`][\w`]*\.)?[A-Za-z_`][\w`]*", body) and body.upper() not in ("NULL", "TRUE", "FALSE", "CURRENT_DATE", "CURRENT_TIMESTAMP")
            name = alias or (body.split(".")[-1] if bare else None)
            if aggregated and plain_group and bare and not any(k in (body.lower(), body.split(".")[-1].lower(), (name or "").lower(), str(at + 1)) or k.split(".")[-1] == body.split(".")[-1].lower() for k in keys):
                out.append(f"any_value({body}) AS {name}")
            elif name is None and not re.search(r"\*\s*$", body):
                out.append(f"{body} AS col_{at}")
            else:
                out.append(f"{body} AS {alias}" if alias else body)
        head = tokens[: words[first][0]]
        return [*head, *tokenise(", ".join(out)), *([" "] if source < len(tokens) else []), *tokens[source:]]

    def mean_vector(self, column: str, source: list[str]) -> str:
        """VEC_AVG over a group: a mean for each place, so that each task adds up its own rows; the length is the first row's."""
        row = self.spark.sql(f"SELECT size({column}) AS n {self.nested(source)} LIMIT 1").first()
        size = max(row["n"] or 0, 0) if row else 0
        return "array(" + ", ".join(f"avg(CAST(get({column}, {k}) AS DOUBLE))" for k in range(size)) + ")"

    def nested(self, tokens: list[str]) -> str:
        """Rewrite calls, predicates and ORDER BY; go into parentheses."""
        out: list[str] = []
        k = 0
        while k < len(tokens):
            t, up = tokens[k], tokens[k].upper()
            nxt = next((j for j in range(k + 1, len(tokens)) if not tokens[j].isspace()), None)
            if up in ("GLOB", "SIMILAR") and nxt is not None:
                j = nxt if up == "GLOB" else next(j for j in range(nxt + 1, len(tokens)) if not tokens[j].isspace())
                convert = glob_to_regex if up == "GLOB" else similar_to_regex
                out.append(f"RLIKE {_quoted(convert(_literal(tokens[j])))}")
                k = j + 1
            elif up == "ORDER" and nxt is not None and tokens[nxt].upper() == "BY":
                end = self.order_end(tokens, nxt + 1)
                out.append("ORDER BY " + ", ".join(self.order_item(x) for x in _split(tokens[nxt + 1 : end])) + (" " if end < len(tokens) else ""))
                k = end
            elif up == "IN" and nxt is not None and tokens[nxt] == "(":
                end = _close(tokens, nxt)
                members = _split(tokens[nxt + 1 : end])
                known = [m for m in members if _text(m).upper() != "NULL"]
                inner = ", ".join(self.nested(m).strip() for m in known) if known and len(known) < len(members) else self.query(tokens[nxt + 1 : end])
                out += [t, " (", inner, ")"]
                k = end + 1
            elif nxt is not None and tokens[nxt] == "(" and table_functions.known(up) and next((x.upper() for x in reversed(tokens[:k]) if not x.isspace()), "") in ("FROM", "JOIN", ","):
                end = _close(tokens, nxt)
                given = self.nested(tokens[nxt + 1 : end]).strip()
                row = list(self.spark.sql(f"SELECT {given}").first()) if given else []
                view = f"__{up.lower()}_{uuid.uuid4().hex[:8]}"
                table_functions.call(self.spark, up, row).createOrReplaceTempView(view)
                out.append(view)
                k = end + 1
            elif nxt is not None and tokens[nxt] == "(" and re.fullmatch(r"[A-Za-z_]\w*", t) and self.is_call(up):
                end = _close(tokens, nxt)
                args = tokens[nxt + 1 : end]
                done = self.call(t, args, tokens, end)
                if done is None:
                    out += [t, "(", self.query(args), ")"]
                    k = end + 1
                else:
                    out.append(done[0])
                    k = done[1]
            elif t == "(":
                end = _close(tokens, k)
                out += ["(", self.query(tokens[k + 1 : end]), ")"]
                k = end + 1
            else:
                out.append(t)
                k += 1
        return "".join(out)

    @staticmethod
    def is_call(up: str) -> bool:
        return up not in ("IN", "ON", "AND", "OR", "NOT", "FROM", "JOIN", "WHERE", "OVER", "AS", "VALUES", "EXISTS", "BY", "SELECT", "USING", "WHEN", "THEN", "ELSE", "UNION", "ALL", "EXCEPT", "INTERSECT", "HAVING", "PIVOT", "FOR", "BETWEEN", "LIKE", "CASE")

    def call(self, name: str, args: list[str], tokens: list[str], end: int) -> tuple[str, int] | None:
        low = name.lower()
        if low == "first_value":
            over = next((j for j in range(end + 1, len(tokens)) if not tokens[j].isspace()), None)
            at = next((j for j in range((over or end) + 1, len(tokens)) if not tokens[j].isspace()), None)
            if over is not None and tokens[over].upper() == "OVER" and at is not None and tokens[at] == "(":
                stop = _close(tokens, at)
                spec = tokens[at + 1 : stop]
                frame = next((k for k, w in _words(spec) if w in ("ROWS", "RANGE", "GROUPS")), len(spec))
                return f"first_value({self.nested(args)}) OVER ({self.nested(spec[:frame]).strip()} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", stop + 1
            return None
        if low in ("moving_sum", "moving_avg", "equal_interval", "natural_breaks"):
            over = next(j for j in range(end + 1, len(tokens)) if tokens[j] == "(")
            stop = _close(tokens, over)
            return self.window(low, [self.nested(a).strip() for a in _split(args)], tokens[over + 1 : stop]), stop + 1
        if low == "extract" and args and args[0].startswith("'"):
            return register.sql_call(self.spark, "extract_part", [self.nested(a).strip() for a in _split(args)]), end + 1
        if low in ("file", "http") and _text(args):
            where = self.spark.sql(f"SELECT {self.nested(args)}").first()[0]
            view = f"__{low}_{uuid.uuid4().hex[:8]}"
            (readers.file_text if low == "file" else readers.http_text)(self.spark, where).createOrReplaceTempView(view)
            return f"(SELECT max(value) FROM {view})", end + 1
        if low in SAME:
            return None
        if not register.known(low):
            plain = register.canonical(low)
            return (f"{plain}({', '.join(self.nested(a).strip() for a in _split(args)) if _text(args) else ''})", end + 1) if plain != low else None
        over = next((j for j in range(end + 1, len(tokens)) if not tokens[j].isspace()), None)
        if over is not None and tokens[over].upper() == "OVER" and register.canonical(low) not in ("min_by", "max_by"):
            return None
        parts = [self.nested(a).strip() for a in _split(args)] if _text(args) else []
        if low == "position" and any(x.upper() == "IN" for x in args):
            return None
        if low in ("first", "last") and len(parts) != 1:
            return None
        return register.sql_call(self.spark, low, parts), end + 1

    def window(self, low: str, args: list[str], spec: list[str]) -> str:
        order = next(k for k, w in _words(spec) if w == "ORDER")
        part, by = _text(spec[:order]), self.nested(spec[order:]).strip()
        column = re.sub(r"(?is)^ORDER BY\s+|\s+(ASC|DESC)\b.*$|\s+NULLS\s+\w+$", "", by).strip()
        if low == "natural_breaks":
            bounds = f"{register.ensure(self.spark, 'breaks')}(CAST({column} AS DOUBLE), {args[0]}) OVER ({part})"
            return f"CASE WHEN {column} IS NOT NULL AND NOT isnan(CAST({column} AS DOUBLE)) THEN size(filter({bounds}, __b -> __b < CAST({column} AS DOUBLE))) + 1 END"
        if low == "equal_interval":
            lo, hi = f"min({column}) OVER ({part})", f"max({column}) OVER ({part})"
            return f"CASE WHEN {hi} = {lo} THEN 1 ELSE CAST(least(floor(({column} - {lo}) / (({hi} - {lo}) / {args[0]})), {args[0]} - 1) + 1 AS INT) END"
        value = args[1] if len(args) > 1 else column
        frame = f"OVER ({part} {by} ROWS BETWEEN {int(args[0]) - 1} PRECEDING AND CURRENT ROW)"
        return f"coalesce(sum(CAST({value} AS DOUBLE)) {frame}, 0D)" if low == "moving_sum" else f"avg(CAST({value} AS DOUBLE)) {frame}"

    @staticmethod
    def order_end(tokens: list[str], at: int) -> int:
        depth = 0
        for k in range(at, len(tokens)):
            if tokens[k] == "(":
                depth += 1
            elif tokens[k] == ")":
                if depth == 0:
                    return k
                depth -= 1
            elif depth == 0 and tokens[k].upper() in _END_OF_ORDER:
                return k
        return len(tokens)

    def order_item(self, tokens: list[str]) -> str:
        text = self.nested(tokens).strip()
        return text if re.search(r"(?i)\bNULLS\s+(FIRST|LAST)\s*$", text) else f"{text} NULLS LAST"


_AGGREGATES = frozenset("count sum avg min max median min_by max_by arg_min arg_max any_value first last geo_bbox_agg geo_centroid_agg collect_list collect_set".split())


_NO_OPERAND = frozenset("AND OR NOT IS LIKE ILIKE IN BETWEEN GLOB REGEXP RLIKE CASE WHEN THEN ELSE DISTINCT ESCAPE SIMILAR TO OVER DIV INTERVAL".split())


def _named(item: list[str]) -> tuple[str, str | None]:
    """(expression, alias) of an item of a SELECT list."""
    parts = [(k, t) for k, t in enumerate(item) if not t.isspace()]
    if len(parts) > 1 and re.fullmatch(r"[A-Za-z_]\w*|`[^`]*`|\"[^\"]*\"", parts[-1][1]) and parts[-1][1].upper() not in ("END", "NULL", "TRUE", "FALSE"):
        alias, before = parts[-1][1].replace('"', "`"), parts[-2][1]
        if before.upper() == "AS":
            return _text(item[: parts[-2][0]]), alias
        if before.upper() not in _NO_OPERAND and re.fullmatch(r"[A-Za-z_]\w*|`[^`]*`|\"[^\"]*\"|'.*'|[0-9].*|\)", before, re.S):
            return _text(item[: parts[-1][0]]), alias
    return _text(item), None


def _aggregates(tokens: list[str]) -> bool:
    """Whether an item calls an aggregate that is no window function, at any depth but inside subqueries."""
    k = 0
    while k < len(tokens):
        t = tokens[k].lower()
        nxt = next((j for j in range(k + 1, len(tokens)) if not tokens[j].isspace()), None)
        if t == "select":
            return False
        if t in _AGGREGATES and nxt is not None and tokens[nxt] == "(":
            end = _close(tokens, nxt)
            over = next((x.upper() for x in tokens[end + 1 :] if not x.isspace()), "")
            few = t in ("min", "max", "first", "last") and len(_split(tokens[nxt + 1 : end])) > 1
            if over != "OVER" and not few and t not in ("first", "last"):
                return True
        k += 1
    return False


def _alias(item: str) -> str:
    found = re.search(r"(?is)\s+AS\s+([`\w]+)\s*$", item)
    return found[1] if found else re.sub(r"^.*\.", "", item) if re.fullmatch(r"[\w.`]+", item) else "`" + item.replace("`", "") + "`"
