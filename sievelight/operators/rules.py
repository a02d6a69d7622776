"""Declarative validation rules: one predicate a rule, one aggregation for all rules of a table."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import text as tx

TYPES = ("email_format", "phone_id", "nik", "not_null", "numeric_range", "date_range", "starts_with", "regex", "cross_column")
OPERATORS = {"eq": "=", "ne": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}


@dataclass(frozen=True)
class Rule:
    column: str
    kind: str
    params: dict = field(default_factory=dict)
    name: str | None = None

    def __post_init__(self):
        check_config(self.kind, self.params)


def check_config(kind: str, params: dict) -> None:
    """Raises ValueError for a rule that could not mean anything."""
    if kind not in TYPES:
        raise ValueError(f"unknown rule type: {kind}")
    if kind in ("numeric_range", "date_range") and params.get("min") is None and params.get("max") is None:
        raise ValueError(f"{kind} needs min or max")
    if kind == "numeric_range":
        low, high = (None if params.get(k) is None else float(params[k]) for k in ("min", "max"))
        if low is not None and high is not None and low > high:
            raise ValueError("min is above max")
    if kind == "starts_with" and not str(params.get("prefix") or ""):
        raise ValueError("starts_with needs a prefix")
    if kind == "regex":
        if not params.get("pattern"):
            raise ValueError("regex needs a pattern")
        re.compile(params["pattern"])
        _java_pattern(params["pattern"])
    if kind == "cross_column":
        if params.get("operator") not in OPERATORS:
            raise ValueError(f"unknown operator: {params.get('operator')}")
        if not params.get("left") or not params.get("right"):
            raise ValueError("cross_column needs left and right")


def _java_pattern(pattern: str) -> None:
    """Raises ValueError for a pattern that the engine's dialect doesn't take, where an engine runs."""
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        except (IllegalArgumentException, Py4JJavaError) as e:
            raise ValueError(f"pattern not supported: {pattern}") from e


def as_text(df: DataFrame, column: str) -> Column:
    """A column as text; whole doubles without a fraction."""
    c = F.col(column)
    if dict(df.dtypes)[column] in ("double", "float"):
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def column_text(df: DataFrame, column: str) -> Column:
    """A column as text: a double column whose values are all whole, without fractions, else every value with one (one pass decides)."""
    if dict(df.dtypes)[column] not in ("double", "float"):
        return F.col(column).cast("string")
    whole = df.agg(F.bool_and(F.col(column) == F.floor(column))).first()[0]
    return F.col(column).cast("decimal(38,0)").cast("string") if whole else F.col(column).cast("string")


def json_record(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as a JSON object: null stays null, whole doubles are written without a fraction, and what JSON has no type for as text."""
    parts = []
    for c, kind in df.dtypes:
        if columns is None or c in columns:
            value = F.parse_json(as_text(df, c)) if kind in ("double", "float") else F.col(c) if kind in ("bigint", "int", "smallint", "tinyint", "boolean", "string") else F.col(c).cast("string")
            parts.append(value.alias(c))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def key_digest(x: Column) -> Column:
    """What is stored of a secret key: its SHA-256 in hexadecimal digits."""
    return F.sha2(x.cast("string"), 256)


def _within(value: Column, params: dict, make) -> Column:
    ok = value.isNotNull()
    if params.get("min") is not None:
        ok &= value >= make(params["min"])
    if params.get("max") is not None:
        ok &= value <= make(params["max"])
    return F.coalesce(ok, F.lit(False))


def predicate(df: DataFrame, rule: Rule) -> Column:
    """True where a row satisfies ``rule``; null and blank values satisfy all but not_null and starts_with."""
    v, p = as_text(df, rule.column), rule.params
    blank = v.isNull() | (tx.stripped(v) == "")
    s = tx.stripped(v)
    if rule.kind == "not_null":
        return ~blank
    if rule.kind == "starts_with":
        prefix, value = str(p["prefix"]), F.coalesce(s, F.lit(""))
        return value.startswith(prefix) if p.get("case_sensitive") else F.lower(value).startswith(prefix.casefold())
    if rule.kind == "email_format":
        ok = F.lower(s).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z")
    elif rule.kind == "phone_id":
        ok = tx.phone(v).rlike(r"^08[0-9]{8,11}\z")
    elif rule.kind == "nik":
        ok = F.length(F.regexp_replace(v, "[^0-9]", "")) == 16
    elif rule.kind == "numeric_range":
        ok = _within(tx.number(v), p, lambda x: F.lit(float(x)))
    elif rule.kind == "date_range":
        ok = _within(tx.parsed_date(v), p, lambda x: F.to_date(F.lit(str(x))))
    elif rule.kind == "regex":
        ok = v.rlike(f"^(?:{p['pattern']})")
    else:
        raise ValueError("a cross_column rule has no predicate of one value")
    return blank | F.coalesce(ok, F.lit(False))


def _cross(df: DataFrame, rule: Rule) -> tuple[Column, Column]:
    """Whether a row is comparable, and whether it satisfies the rule: numbers with numbers, dates with dates, texts with texts."""
    a, b = (as_text(df, rule.params[k]) for k in ("left", "right"))
    numbers, dates = (tx.number(a), tx.number(b)), (tx.parsed_date(a), tx.parsed_date(b))
    kind = [F.when(n.isNotNull(), 0).when(d.isNotNull(), 1).otherwise(2) for n, d in zip(numbers, dates, strict=True)]
    whole = (tx.stripped(a) != "") & (tx.stripped(b) != "")
    op = OPERATORS[rule.params["operator"]]
    compare = lambda x, y: {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    ok = F.when(kind[0] == 0, compare(*numbers)).when(kind[0] == 1, compare(*dates)).otherwise(compare(F.lower(tx.stripped(a)), F.lower(tx.stripped(b))))
    return F.coalesce(whole & (kind[0] == kind[1]), F.lit(False)), F.coalesce(ok, F.lit(False))


def run_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, checked and violations of every rule, from one pass over ``df``."""
    for r in rules:
        if r.kind != "cross_column" and r.column not in df.columns:
            raise KeyError(r.column)
    sums = []
    for i, r in enumerate(rules):
        if r.kind == "cross_column" and not {r.params["left"], r.params["right"]} <= set(df.columns):
            sums += [F.lit(0).cast("long").alias(f"c{i}"), F.lit(0).cast("long").alias(f"v{i}")]
        elif r.kind == "cross_column":
            can, ok = _cross(df, r)
            sums += [F.count_if(can).alias(f"c{i}"), F.count_if(can & ~ok).alias(f"v{i}")]
        else:
            sums += [F.count(F.lit(1)).alias(f"c{i}"), F.count_if(~predicate(df, r)).alias(f"v{i}")]
    names = [r.name or f"{r.kind}:{r.column}" for r in rules]
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"c{i}").alias("checked"), F.col(f"v{i}").alias("violations")) for i, n in enumerate(names)])
    return df.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def violations(df: DataFrame, rule: Rule, order: str | None = None, page: int | None = None, page_size: int = 50) -> DataFrame:
    """All rows that break ``rule``; in order of ``order``, and of these one page (from 1, at most 200 rows), where asked for."""
    if rule.kind == "cross_column":
        can, ok = _cross(df, rule)
        found = df.filter(can & ~ok)
    else:
        found = df.filter(~predicate(df, rule))
    found = found.orderBy(order) if order else found
    if page is None:
        return found
    if order is None or page < 1 or not 1 <= page_size <= 200:
        raise ValueError("a page needs an order, a number from 1 and 1 to 200 rows")
    return found.offset((page - 1) * page_size).limit(page_size)


#: Hints of columns that get a rule by their name, in order of precedence.
SUGGESTED = (("email_format", ("email", "mail"), {}), ("nik", ("nik", "ktp"), {}), ("phone_id", ("hp", "phone", "telp", "telepon"), {}), ("date_range", ("lahir", "birth"), {"min": "1900-01-01", "max": "2026-12-31"}))


def suggest(columns: list[str]) -> list[Rule]:
    """Built-in rules by column name: the first kind whose hints it holds."""
    found = []
    for c in columns:
        fits = [Rule(c, kind, params) for kind, hints, params in SUGGESTED if any(h in c.lower() for h in hints)]
        found += fits[:1]
    return found


def proposal(reply: str) -> dict:
    """The JSON object of a language model's reply, with or without a code fence."""
    text = reply.strip()
    if fenced := re.fullmatch(r"```(?:json)?(.*?)```", text, re.DOTALL):
        text = fenced[1]
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("the reply is not one object")
    return found


def proposed_rule(reply: str | dict, columns: list[str]) -> Rule:
    """The rule that a reply proposes, checked and never stored; an error where its type, parameters or columns can't be."""
    found = proposal(reply) if isinstance(reply, str) else reply
    params = found.get("params") or {}
    if not isinstance(params, dict):
        raise ValueError("params must be an object")
    kind = found.get("rule_type")
    column = params.get("left") if kind == "cross_column" else found.get("column_name")
    rule = Rule(column, kind, params, found.get("description") or None)
    if unknown := {column, *([params["right"]] if kind == "cross_column" else [])} - set(columns):
        raise ValueError(f"unknown columns: {unknown}")
    return rule


def rule_from_words(ask: Callable[[str], str], instruction: str, columns: list[str]) -> Rule:
    """A rule in words, put by ``ask`` (a language model of the caller's choice) and checked."""
    return proposed_rule(ask(f"Columns: {', '.join(columns)}. Rule types: {', '.join(TYPES)}. Answer with one JSON object (column_name, rule_type, params, description). Rule: {instruction}"), columns)
