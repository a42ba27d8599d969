"""Engine SQL: rewrites over Spark SQL for forms that Spark does not parse.

Rewritten are ``QUALIFY``, comparisons with ``ANY``/``ALL`` subqueries,
``GROUPS`` window frames, ``SIMILAR TO``, ``LIKE MEANING``, system-time travel, the
vector operators ``<-> <#> <=>`` and the JSON operators ``-> ->> #> #>> @> <@ ?`` and the
``jsonb_*`` functions. ``EXPLAIN`` gives a row of cost, size and tier, a
recursive CTE with ``UNION`` runs until nothing new appears, and the tables
of ``pg_catalog`` are views of Spark's catalogue. Everything else goes to Spark unchanged.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPERAND = r"(?:[A-Za-z_][\w.]*(?:\([^()]*\))?|'(?:[^']|'')*'|\([^()]*\)|\$?\d+(?:\.\d+)?)"


def close_of(text: str, at: int) -> int:
    """Index of the parenthesis that closes the one at ``at``; strings are skipped."""
    depth, quote = 0, None
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return i
    raise ValueError("unbalanced parentheses")


def rewrite_any_all(text: str) -> str:
    """``x op ANY (subquery)`` and ``x op ALL (subquery)``.

    Equality becomes IN, inequality with ALL becomes NOT IN; an ordering
    comparison becomes one with the least or greatest value, with NULL when
    the subquery has NULLs that leave the answer open, TRUE or FALSE when it is empty.
    """
    pattern = re.compile(rf"({_OPERAND})\s*(<=|>=|<>|!=|=|<|>)\s*(ANY|SOME|ALL)\s*\(", re.I)
    while m := pattern.search(text):
        end = close_of(text, m.end() - 1)
        x, op, kind, sub = m[1], m[2], m[3].upper(), text[m.end() : end]
        kind = "ANY" if kind == "SOME" else kind
        one = lambda f: f"(SELECT {f} FROM ({sub}) AS _q(_v))"
        all_equal = f"({x} = {one('min(_v)')} AND {x} = {one('max(_v)')})"
        if op == "=" and kind == "ANY":
            new = f"({x} IN ({sub}))"
        elif op in ("<>", "!=") and kind == "ALL":
            new = f"({x} NOT IN ({sub}))"
        elif op == "=":
            new = f"(CASE WHEN {one('count(*)')} = 0 THEN true WHEN NOT {all_equal} THEN false WHEN {one('count(_v) < count(*)')} THEN NULL ELSE {all_equal} END)"
        elif op in ("<>", "!="):
            new = f"(CASE WHEN {one('count(*)')} = 0 THEN false WHEN NOT {all_equal} THEN true WHEN {one('count(_v) < count(*)')} THEN NULL ELSE NOT {all_equal} END)"
        else:
            bound = one("min(_v)" if (op in ("<", "<=")) == (kind == "ALL") else "max(_v)")
            empty, sure = ("true", "false") if kind == "ALL" else ("false", "true")
            new = (
                f"(CASE WHEN {one('count(*)')} = 0 THEN {empty} WHEN ({x} {op} {bound}) = {sure} THEN {sure} "
                f"WHEN {one('count(_v) < count(*)')} THEN NULL ELSE {x} {op} {bound} END)"
            )
        text = text[: m.start()] + new + text[end + 1 :]
    return text


def rewrite_groups_frame(text: str) -> str:
    """``GROUPS BETWEEN ...`` over a table or subquery: a RANGE frame on the dense rank of the order keys.

    The select's FROM clause is wrapped so that the rank is a column.
    """
    pattern = re.compile(r"OVER\s*\(", re.I)
    at = 0
    while m := pattern.search(text, at):
        end = close_of(text, m.end() - 1)
        body = text[m.end() : end]
        g = re.match(r"\s*(PARTITION\s+BY\s+(?P<p>.*?)\s+)?ORDER\s+BY\s+(?P<o>.*?)\s+GROUPS\s+(?P<f>.*)$", body, re.I | re.S)
        if not g:
            at = m.end()
            continue
        part = f"PARTITION BY {g['p']} " if g["p"] else ""
        name = f"_g{m.start()}"
        text = text[: m.end()] + f"{part}ORDER BY {name} RANGE {g['f']}" + text[end:]
        source = re.search(r"\bFROM\s+(\w+)", text[m.end() :], re.I)
        if not source:
            raise ValueError("a GROUPS frame needs a FROM clause with a named table")
        a = m.end() + source.start(1)
        table = source[1]
        text = text[:a] + f"(SELECT *, dense_rank() OVER ({part}ORDER BY {g['o']}) AS {name} FROM {table}) AS {table}" + text[a + len(table) :]
        at = m.end()
    return text


def rewrite_qualify(text: str) -> str:
    """``QUALIFY p`` at the end of a select: the predicate filters an outer select, without its helper column."""
    m = re.search(r"\bQUALIFY\b", text, re.I)
    if not m:
        return text
    depth, end = 0, len(text)  # an ORDER BY inside the predicate's OVER clause belongs to the predicate
    for x in re.finditer(r"[()]|\b(?:ORDER\s+BY|LIMIT)\b", text[m.end() :], re.I):
        depth += {"(": 1, ")": -1}.get(x[0], 0)
        if x[0] not in "()" and depth == 0:
            end = m.end() + x.start()
            break
    predicate, rest = text[m.end() : end].strip(), text[end:]
    head = text[: m.start()]
    s = re.search(r"\bSELECT\b", head, re.I)
    inner = head[: s.end()] + f" ({predicate}) AS _qualify, " + head[s.end() :]
    return f"SELECT * EXCEPT (_qualify) FROM ({inner}) WHERE _qualify {rest}"


def rewrite_time_travel(text: str) -> str:
    """``t FOR SYSTEM_TIME AS OF x``, ``... BETWEEN a AND b``, ``... ALL``, and ``t AS OF [SYSTEM TIME] x``."""
    value = r"((?:TIMESTAMP\s*)?'[^']*'|\d+)"
    text = re.sub(rf"\b(\w+)\s+FOR\s+SYSTEM_TIME\s+BETWEEN\s+{value}\s+AND\s+{value}", r"(SELECT * FROM \1 WHERE valid_from < \3 AND valid_to > \2) AS \1", text, flags=re.I)
    text = re.sub(r"\b(\w+)\s+FOR\s+SYSTEM_TIME\s+ALL\b", r"\1", text, flags=re.I)
    return re.sub(rf"\b(\w+)\s+(?:FOR\s+SYSTEM_TIME\s+)?AS\s+OF\s+(?:SYSTEM\s+TIME\s+)?{value}", r"(SELECT * FROM \1 WHERE valid_from <= \2 AND valid_to > \2) AS \1", text, flags=re.I)


def vector_sql(kind: str, a: str, b: str) -> str:
    """Distance of two array columns as a Spark SQL expression; NULL when lengths differ (and for cosine with a zero vector)."""
    da, db = f"CAST({a} AS ARRAY<DOUBLE>)", f"CAST({b} AS ARRAY<DOUBLE>)"

    def total(f: str) -> str:
        return f"aggregate(zip_with({da}, {db}, (p, q) -> {f}), 0D, (s, v) -> s + v)"

    if kind == "l2":
        body = f"sqrt({total('(p - q) * (p - q)')})"
    elif kind == "l1":
        body = total("abs(p - q)")
    elif kind == "inner":
        body = total("p * q")
    else:
        norm = f"(sqrt({total('p * p')}) * sqrt({total('q * q')}))"
        body = f"(1D - try_divide({total('p * q')}, {norm}))"
    return f"(CASE WHEN size({a}) = size({b}) THEN {body} END)"


def similar_pattern(text: str) -> str:
    """A SIMILAR TO pattern as an anchored regular expression: ``%`` and ``_`` outside brackets are wildcards, ``\\`` escapes."""
    out, i, bracket = "", 0, False
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            out, i = out + re.escape(text[i + 1]), i + 2
            continue
        bracket = c == "[" or bracket and c != "]"
        plain = bracket or c == "]"
        out += c if plain else {"%": "(?s:.*)", "_": "(?s:.)"}.get(c, c if c in "()|*+?{},-" else re.escape(c))
        i += 1
    return f"^(?:{out})$".replace("''", "\\x27")


#: Least cosine of two texts' word sets at which ``LIKE MEANING`` holds.
MEANING = 0.5


def meaning_sql(value: str, text: str) -> str:
    """The words that two texts share, by the root of the product of their numbers of distinct words, reach ``MEANING``; NULL for NULL."""

    def words(v: str) -> str:
        return f"array_distinct(filter(split(lower({v}), '[^\\\\p{{L}}\\\\p{{N}}]+'), _w -> _w <> ''))"

    a, b = words(value), words(text)
    return f"(size(array_intersect({a}, {b})) >= {MEANING}D * sqrt(size({a}) * size({b})) AND size(array_intersect({a}, {b})) > 0)"


def rewrite_json_functions(text: str) -> str:
    """``jsonb_*`` calls as Spark's functions of JSON texts."""

    def kind(a: str) -> str:
        first = f"substr(ltrim({a}), 1, 1)"
        return f"(CASE WHEN {a} IS NULL THEN NULL WHEN {first} = '{{' THEN 'object' WHEN {first} = '[' THEN 'array' WHEN {first} = '\"' THEN 'string' WHEN {first} IN ('t', 'f') THEN 'boolean' WHEN {first} = 'n' THEN 'null' ELSE 'number' END)"

    def path(parts: list[str]) -> str:
        return "concat('$', " + ", ".join(f"(CASE WHEN {p} RLIKE '^[0-9]+$' THEN concat('[', {p}, ']') ELSE concat('.', {p}) END)" for p in parts) + ")"

    make = {
        "array_length": lambda a: f"json_array_length({a[0]})",
        "object_keys": lambda a: f"explode(json_object_keys({a[0]}))",
        "array_elements": lambda a: f"explode(from_json({a[0]}, 'ARRAY<STRING>'))",
        "typeof": lambda a: kind(a[0]),
        "extract_path": lambda a: f"get_json_object({a[0]}, {path(a[1:])})",
        "extract_path_text": lambda a: f"get_json_object({a[0]}, {path(a[1:])})",
        "build_object": lambda a: f"to_json(named_struct({', '.join(a)}))",
        "build_array": lambda a: f"to_json(array({', '.join(a)}))",
    }
    pattern, at = re.compile(r"\bjsonb?_(" + "|".join(sorted(make, key=len, reverse=True)) + r")\s*\(", re.I), 0
    while m := pattern.search(text, at):
        if m[0].lower().startswith("json_") and m[1].lower() in ("array_length", "object_keys"):
            at = m.end()  # Spark's own
            continue
        end = close_of(text, m.end() - 1)
        new = make[m[1].lower()](_top(text[m.end() : end]))
        text, at = text[: m.start()] + new + text[end + 1 :], m.start()
    return text


def _top(text: str) -> list[str]:
    """Parts of a text between commas outside brackets and strings."""
    out, depth, quote, at = [], 0, False, 0
    for i, c in enumerate(text):
        quote ^= c == "'"
        depth += 0 if quote else (c == "(") - (c == ")")
        if c == "," and not depth and not quote:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


_MASKED = re.compile("\x01(\\d+)\x01")


def json_contains(value: str, wanted) -> str:
    """Spark SQL for: the JSON text ``value`` contains the parsed JSON ``wanted``, as objects, arrays and scalars do."""
    if isinstance(wanted, dict):
        parts = [f"{value} IS NOT NULL"]
        for k, v in wanted.items():
            key = k.replace("'", "\\'")
            parts.append(json_contains(f"get_json_object({value}, '$[\\'{key}\\']')", v))
        return "(" + " AND ".join(parts) + ")"
    if isinstance(wanted, list):
        items = f"from_json({value}, 'ARRAY<STRING>')"
        parts = [f"{value} IS NOT NULL", *(f"exists({items}, _j -> {json_contains('_j', w)})" for w in wanted)]
        return "(" + " AND ".join(parts) + ")"
    if wanted is None:
        return f"({value} IS NULL)"
    text = json.dumps(wanted) if not isinstance(wanted, str) else wanted
    return f"coalesce({value} = '{text.replace(chr(39), chr(39) * 2)}', false)"


def rewrite_operators(text: str, literals: list[str] = (), cosine: tuple[bool, ...] | None = None) -> str:
    """Vector and JSON operators between simple operands.

    ``literals`` holds the strings whose places are masked in ``text``;
    ``cosine`` tells of each ``<=>`` whether it is the distance or null-safe equality.
    """

    def plain(value: str) -> str:
        return _MASKED.sub(lambda m: literals[int(m[1])], value.strip("'")).replace("''", "'")

    def binary(op: str, make) -> None:
        nonlocal text
        pattern = re.compile(rf"({_OPERAND})\s*{op}\s*({_OPERAND})")
        while m := pattern.search(text):
            text = text[: m.start()] + make(m[1], m[2]) + text[m.end() :]

    def path(value: str) -> str:
        v = plain(value)
        return f"$[{v}]" if v.isdigit() else f"$.{v}"

    def deep(value: str) -> str:
        return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in plain(value).strip("{}").split(","))

    turns = iter(cosine or ())

    def spaceship(a: str, b: str) -> str:
        return vector_sql("cosine", a, b) if next(turns, True) else f"({a} IS NOT DISTINCT FROM {b})"

    def contains(a: str, b: str) -> str:
        return json_contains(a, json.loads(plain(b))) if b[0] == "'" else f"(size(array_except({b}, {a})) = 0)"

    binary("<->", lambda a, b: vector_sql("l2", a, b))
    binary("<#>", lambda a, b: vector_sql("inner", a, b))
    binary("<=>", spaceship)
    binary("@>", contains)
    binary("<@", lambda a, b: contains(b, a))
    binary("#>>", lambda a, b: f"get_json_object({a}, '{deep(b)}')")
    binary("#>", lambda a, b: f"get_json_object({a}, '{deep(b)}')")
    binary("->>", lambda a, b: f"get_json_object({a}, '{path(b)}')")
    text = re.sub(rf"({_OPERAND})\s*->\s*('(?:[^']|'')*')", lambda m: f"get_json_object({m[1]}, '{path(m[2])}')", text)
    text = re.sub(rf"({_OPERAND})\s*\?\s*('(?:[^']|'')*')", r"coalesce(array_contains(json_object_keys(\1), \2), false)", text)
    return text


def rewrite(text: str, cosine: tuple[bool, ...] | None = None) -> str:
    """All rewrites; what stands in string literals and comments is left alone."""
    literals: list[str] = []

    def mask(m: re.Match) -> str:
        if m[0][0] != "'":
            return " " if m[0][0] in "-/" else m[0]
        literals.append(m[0][1:-1])
        return f"'\x01{len(literals) - 1}\x01'"

    out = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*(?!\+).*?\*/|`[^`]*`", mask, text, flags=re.S)
    out = rewrite_time_travel(out)
    out = rewrite_any_all(out)
    if re.search(r"\bGROUPS\b", out, re.I):
        out = rewrite_groups_frame(out)
    if re.search(r"\bQUALIFY\b", out, re.I):
        out = rewrite_qualify(out)
    out = re.sub(r"\bSIMILAR\s+TO\s+'\x01(\d+)\x01'", lambda m: f"RLIKE r'{similar_pattern(literals[int(m[1])])}'", out, flags=re.I)
    out = re.sub(rf"({_OPERAND})\s+(NOT\s+)?LIKE\s+MEANING\s+('\x01\d+\x01')", lambda m: ("NOT " if m[2] else "") + meaning_sql(m[1], m[3]), out, flags=re.I)
    if re.search(r"\bjsonb?_", out, re.I):
        out = rewrite_json_functions(out)
    if re.search(r"<->|<#>|<=>|#>|->>|@>|<@|->\s*'|\?\s*'", out):
        out = rewrite_operators(out, literals, cosine)
    return _MASKED.sub(lambda m: literals[int(m[1])], out)


def pg_catalog(spark: SparkSession) -> dict[str, DataFrame]:
    """The virtual tables of ``pg_catalog``, made from the current database's tables and views, Spark's types and settings."""
    names = sorted(t.name for t in spark.catalog.listTables())
    fields = [(i + 1, k + 1, f.name, f.dataType.simpleString()) for i, n in enumerate(names) for k, f in enumerate(spark.table(n).schema.fields)]
    types = sorted({f[3] for f in fields} | {"bigint", "boolean", "date", "double", "int", "string", "timestamp"})
    number = {t: i + 1 for i, t in enumerate(types)}
    spaces = sorted(d.name for d in spark.catalog.listDatabases())
    own = spaces.index(spark.catalog.currentDatabase()) + 1
    make = spark.createDataFrame
    settings = [(r.key, r.value) for r in spark.sql("SET").collect()]
    return {
        "pg_type": make([(i, t) for t, i in number.items()], "oid int, typname string"),
        "pg_namespace": make([(i + 1, n) for i, n in enumerate(spaces)], "oid int, nspname string"),
        "pg_class": make([(i + 1, n, own, "r") for i, n in enumerate(names)], "oid int, relname string, relnamespace int, relkind string"),
        "pg_attribute": make([(t, n, number[k], i) for t, i, n, k in fields], "attrelid int, attname string, atttypid int, attnum int"),
        "pg_database": make([(1, spark.catalog.currentCatalog())], "oid int, datname string"),
        "pg_settings": make(settings, "name string, setting string"),
    }


def _ctes(text: str) -> tuple[list[tuple[str, str, str]], str]:
    """(name, columns, body) of each table of a WITH clause, and the query that follows."""
    at, out = re.match(r"\s*WITH\s+RECURSIVE\s+", text, re.I).end(), []
    while m := re.compile(r"\s*(\w+)\s*(?:\(([^()]*)\))?\s*AS\s*\(", re.I).match(text, at):
        end = close_of(text, m.end() - 1)
        out.append((m[1], m[2] or "", text[m.end() : end]))
        at = end + 1
        if not (comma := re.compile(r"\s*,").match(text, at)):
            break
        at = comma.end()
    return out, text[at:]


def _union_at(body: str) -> re.Match | None:
    """The last UNION without ALL outside brackets and strings."""
    depth, found = 0, None
    for x in re.finditer(r"'(?:[^']|'')*'|[()]|\bUNION\b(?!\s+ALL)", body, re.I):
        depth += {"(": 1, ")": -1}.get(x[0], 0)
        if depth == 0 and x[0].upper() == "UNION":
            found = x
    return found


def run_recursive(spark: SparkSession, text: str) -> DataFrame | None:
    """``WITH RECURSIVE r(cols) AS (base UNION step) query``: each round joins what the last one found, so cycles end; None where no table is of that form.

    What is found has the types of the base. Other tables of the clause stay as they are.
    """
    from tessera.operators.graph import cut

    tables, query = _ctes(text)
    before, ran = [], False
    for name, columns, body in tables:
        at = _union_at(body)
        if at is None or not re.search(rf"\b{name}\b", body[at.end() :]):
            before.append(f"{name}{f' ({columns})' if columns else ''} AS ({body})")
            continue
        ran = True
        head = f"WITH RECURSIVE {', '.join(before)}" if before else ""
        found = cut(run_sql(spark, f"{head} SELECT * FROM ({body[: at.start()]})").distinct())
        if columns:
            found = found.toDF(*[c.strip() for c in columns.split(",")])
        view, new = f"_rec_{uuid.uuid4().hex}", found
        step = f"WITH RECURSIVE {', '.join([*before, f'{name} AS (SELECT * FROM {view})'])} SELECT * FROM ({body[at.end() :]})"
        while not new.isEmpty():
            new.createOrReplaceTempView(view)
            made = run_sql(spark, step).toDF(*found.columns).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in found.schema.fields])
            new = cut(made.subtract(found))
            found = cut(found.unionAll(new))
        found.createOrReplaceTempView(view)
        before.append(f"{name} AS (SELECT * FROM {view})")
    return run_sql(spark, f"WITH RECURSIVE {', '.join(before)} {query}") if ran else None


def run_sql(spark: SparkSession, text: str, args=None) -> DataFrame:
    """Run engine SQL; ``args`` are positional (list, ``?``) or named (dict, ``:name``) parameters.

    ``<=>`` is the cosine distance where its operands are arrays, else
    null-safe equality: of the readings of a text the first is taken that the
    analyser accepts.
    """
    if m := re.match(r"\s*EXPLAIN\s+(?=SELECT|WITH)", text, re.I):
        plan = explain_tier(run_sql(spark, text[m.end() :], args))
        return spark.createDataFrame([tuple(Decimal(v) if isinstance(v, int) else v for v in plan.values())], "operation string, estimated_cost decimal(38,0), estimated_rows decimal(38,0), cascade_tier string")
    if re.search(r"\bpg_catalog\.", text, re.I):
        for name, df in pg_catalog(spark).items():
            df.createOrReplaceTempView(f"_{name}")
        text = re.sub(r"\bpg_catalog\.(?=pg_\w)", "_", text, flags=re.I)
    if re.match(r"\s*WITH\s+RECURSIVE\b", text, re.I) and not args and (out := run_recursive(spark, text)) is not None:
        return out
    if isinstance(args, list):
        text = re.sub(r"\$(\d+)", "?", text)
    readings = list(itertools.product((True, False), repeat=min(6, text.count("<=>")))) or [()]
    for i, cosine in enumerate(readings):
        try:
            return spark.sql(rewrite(text, cosine), args=args) if args else spark.sql(rewrite(text, cosine))
        except AnalysisException:
            if i + 1 == len(readings):
                raise
    raise AssertionError


#: Cascade tiers in order, and the plan nodes that need them.
TIERS = ("lookup", "formula", "extract", "aggregate", "reason")


def explain_tier(df: DataFrame) -> dict:
    """Operation, estimated rows and size, and the highest cascade tier of a plan."""
    plan = df._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    tier = 0
    for i, nodes in enumerate((r"Relation|LocalRelation", r"Project|Filter", r"Generate|Sort|Limit", r"Aggregate|Join|Window|Distinct", r"Python|Pandas|Arrow|InPandas")):
        if re.search(rf"\b(?:{nodes})\b|(?:{nodes})", text):
            tier = i
    size = int(str(plan.stats().sizeInBytes()))
    rows = plan.stats().rowCount()
    return {"operation": text.split(" ")[0].split("\n")[0], "estimated_cost": size, "estimated_rows": int(str(rows.get())) if rows.isDefined() else None, "cascade_tier": TIERS[tier]}
