"""Queries over the star tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.operators import crosscheck, golden, privacy, profile, review
from sievelight.operators.rules import Rule, run_rules, violations


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def registry(queries: dict):
    """A decorator that keeps queries and their SQL by name."""

    def query(name: str, sql: str | None = None):
        def keep(f):
            queries[name] = (f, sql)
            return f

        return keep

    return query


#: The same projections in both dialects: the tables are clean, so faults are planted by key.
DIRTY = """SELECT c_custkey,
 CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN '  ' ELSE c_name END AS c_name,
 CASE WHEN c_custkey % 7 = 0 THEN concat('0812', lpad(cast(c_custkey AS varchar(20)), 8, '0'))
      WHEN c_custkey % 7 = 1 THEN concat('+62812', lpad(cast(c_custkey AS varchar(20)), 8, '0'))
      WHEN c_custkey % 7 = 2 THEN '0813444' ELSE concat('812-', lpad(cast(c_custkey AS varchar(20)), 8, '0')) END AS phone,
 CASE WHEN c_custkey % 11 = 0 THEN 'not-an-email' ELSE concat('User', cast(c_custkey % 500 AS varchar(20)), '@Gmial.com') END AS email,
 CASE WHEN c_custkey % 5 = 0 THEN concat('Jln.  Mawar no ', cast(c_custkey % 90 AS varchar(20))) ELSE concat(' jalan  melati RT', cast(c_custkey % 9 AS varchar(20))) END AS address,
 CASE WHEN c_custkey % 13 = 0 THEN '44/09/1994' WHEN c_custkey % 2 = 0 THEN '1994-03-21' ELSE '21/03/1894' END AS born,
 CASE WHEN c_custkey % 23 = 0 THEN 'n/a' WHEN c_custkey % 3 = 0 THEN concat(cast(c_custkey % 100 AS varchar(20)), ',5') ELSE cast(c_custkey % 100 AS varchar(20)) END AS amount,
 concat(CASE WHEN c_custkey % 4 = 0 THEN 'Dr. ' ELSE 'Ibu ' END, 'Moehammad ', cast(c_custkey % 300 AS varchar(20))) AS person,
 c_mktsegment, c_acctbal FROM customer"""
WITH = f"WITH dirty AS ({DIRTY}) "


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "customer").selectExpr(*[x for x in _split(DIRTY)])


def _split(sql: str) -> list[str]:
    """Select items of a projection without commas at depth 0."""
    body, out, depth, start, case = sql[len("SELECT ") : sql.rindex(" FROM ")], [], 0, 0, 0
    quoted = False
    for i, c in enumerate(body):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(body[start:i])
                start = i + 1
    return [*out, body[start:]]


QUERIES: dict = {}
query = registry(QUERIES)


# ---------------------------------------------------------------- profiles

_SHAPE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({v}, '\\s', ' ', 'g'), '\\p{{Lu}}', 'A', 'g'), '\\p{{Ll}}', 'a', 'g'), '\\p{{L}}', 'a', 'g'), '\\p{{Nd}}', '9', 'g')"
_NUMBER = "regexp_matches(trim({v}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"
_DAY_FIRST = "coalesce(try_strptime({v}, '%Y-%m-%d'), try_strptime({v}, '%d/%m/%Y'), try_strptime({v}, '%m/%d/%Y'))"


def _profile_sql(table: str, numeric: list[str], texts: list[str], head: str = "") -> str:
    """A profile of each column by aggregates of its own."""
    parts = []
    for i, c in enumerate(numeric + texts):
        text = c if c in texts else f"CASE WHEN {c} = floor({c}) THEN cast(cast({c} AS bigint) AS varchar) ELSE cast({c} AS varchar) END"
        kind = "'numeric'" if c in numeric else f"""CASE WHEN count(v) = 0 THEN 'text' WHEN bool_and(lower(trim(v)) IN ('true', 'false', 'yes', 'no', 'ya', 'tidak')) THEN 'boolean'
 WHEN avg(CASE WHEN v IS NULL THEN NULL WHEN {_NUMBER.format(v='v')} THEN 1.0 ELSE 0 END) > 0.8 THEN 'numeric' WHEN avg(CASE WHEN v IS NULL THEN NULL WHEN {_DAY_FIRST.format(v='trim(v)')} IS NOT NULL THEN 1.0 ELSE 0 END) > 0.8 THEN 'date' ELSE 'text' END"""
        number = f"cast({c} AS double)" if c in numeric else f"CASE WHEN kind = 'numeric' AND {_NUMBER.format(v='v')} THEN cast(trim(v) AS double) END"
        parts.append(f"""SELECT {i} AS position, '{c}' AS "column", kind AS inferred_type, count(*) AS rows, count(*) - count(v) AS null_count, count(t) - count(v) AS blank_count, count(v) AS non_missing,
 round(cast(count(v) AS double) / count(*), 4) AS completeness, count(DISTINCT v) AS "distinct", count(v) - count(DISTINCT v) AS duplicate_count, round(cast(count(DISTINCT v) AS double) / count(v), 4) AS uniqueness,
 count(v) = count(*) AND count(DISTINCT v) = count(*) AS is_candidate_key, cast(min(length(v)) AS bigint) AS min_length, cast(max(length(v)) AS bigint) AS max_length, round(avg(length(v)), 2) AS mean_length, round(quantile_cont(cast(length(v) AS double), 0.5), 2) AS median_length,
 min(x) AS minimum, max(x) AS maximum, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.75), 4) AS q3, CASE WHEN count(x) > 0 THEN round(coalesce(stddev_samp(x), 0), 4) END AS std,
 strftime(min(day), '%Y-%m-%d') AS min_date, strftime(max(day), '%Y-%m-%d') AS max_date, round(max(same), 4) AS consistency
FROM (SELECT *, {number} AS x, CASE WHEN kind = 'date' THEN {_DAY_FIRST.format(v='trim(v)')} END AS day, CASE WHEN kind = 'text' AND v IS NOT NULL AND present >= 5 THEN cast(count(*) OVER (PARTITION BY {_SHAPE.format(v='v')}) AS double) / present END AS same
 FROM (SELECT *, CASE WHEN regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> '' THEN t END AS v FROM (SELECT *, {text} AS t FROM {table})) CROSS JOIN (SELECT count(v) AS present, {kind} AS kind FROM (SELECT CASE WHEN regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> '' THEN t END AS v FROM (SELECT {text} AS t FROM {table})))) GROUP BY kind""")
    return head + " UNION ALL ".join(parts)


def _shown(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = profile.report(profile.profile(df, columns)).drop("physical_type", "top_values", "notes")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("min_date", "max_date")})


@query("agg13_profile_customer", _profile_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]))
def profile_customer(spark, d):
    return _shown(_read(spark, d, "customer"), ["c_custkey", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment"])


@query("agg13_profile_dirty", _profile_sql("dirty", [], ["c_name", "phone", "email", "born", "amount", "address", "person"], WITH))
def profile_dirty(spark, d):
    return _shown(_dirty(spark, d), ["c_name", "phone", "email", "born", "amount", "address", "person"])


@query("agg13_profile_orders", _profile_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]))
def profile_orders(spark, d):
    return _shown(_read(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"])


@query("agg12_notes", WITH + """SELECT 'c_name' AS "column", concat_ws('; ', CASE WHEN count(v) < 0.9 * count(*) THEN concat(cast(round((1 - cast(count(v) AS double) / count(*)) * 100) AS integer), '% nilai kosong') END,
 CASE WHEN cast(count(DISTINCT v) AS double) / count(v) < 0.9 THEN 'kemungkinan variasi ejaan / duplikat' END) AS notes FROM (SELECT CASE WHEN trim(c_name) <> '' THEN c_name END AS v FROM dirty)
UNION ALL SELECT 'phone', 'format tidak seragam, perlu standardisasi' FROM dirty GROUP BY 1""")
def notes(spark, d):
    return profile.profile(_dirty(spark, d), ["c_name", "phone"]).select("column", "notes")


@query("agg5_first_seen", """SELECT value, "count" FROM (SELECT cast(o_orderkey % 12 AS varchar) AS value, count(*) AS "count", min(o_orderkey) AS f FROM orders WHERE o_orderkey % 12 < 11 AND o_orderkey <= 144 GROUP BY 1) ORDER BY "count" DESC, f LIMIT 10""")
def first_seen(spark, d):
    rows = _read(spark, d, "orders").filter("o_orderkey % 12 < 11 AND o_orderkey <= 144").select("o_orderkey", (F.col("o_orderkey") % 12).cast("string").alias("k"))
    return profile.profile(rows, ["k"], "o_orderkey").select(F.explode("top_values").alias("t")).select("t.value", "t.count")


@query("agg5_top_values", "SELECT p_name AS value, count(*) AS \"count\", cast(count(*) AS double) / (SELECT count(*) FROM part) AS share FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_values(spark, d):
    return profile.top_values(_read(spark, d, "part"), "p_name")


_RUN = "CASE WHEN regexp_matches(r, '^\\p{Nd}') THEN concat('\\d{', length(r), '}') WHEN regexp_matches(r, '^\\p{Lu}') THEN concat('[A-Z]{', length(r), '}') WHEN regexp_matches(r, '^\\p{Ll}') THEN concat('[a-z]{', length(r), '}') WHEN regexp_matches(r, '^\\s') THEN concat('\\s{', length(r), '}') WHEN regexp_matches(r, '[()\\[\\]{}?*+|^$\\\\.&~#-]') THEN concat('\\', r) ELSE r END"


@query("agg9_patterns", WITH + f"""SELECT pattern, count(*) AS "count", min(v) AS example FROM (SELECT v, concat('^', array_to_string(list_transform(regexp_extract_all(v, '\\p{{Nd}}+|\\p{{Lu}}+|\\p{{Ll}}+|\\s+|.'), lambda r: {_RUN}), ''), '$') AS pattern
 FROM (SELECT concat(person, ' <', phone, '>') AS v FROM dirty)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def patterns(spark, d):
    return profile.patterns(_dirty(spark, d).withColumn("v", F.concat("person", F.lit(" <"), "phone", F.lit(">"))), "v")


@query("fn18_signature", WITH + """SELECT left(regexp_replace(regexp_replace(regexp_replace(v, '[0-9]+', '9', 'g'), '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), 80) AS signature, count(*) AS "count" FROM (SELECT concat(person, ' ID-', email, phone) AS v FROM dirty) GROUP BY 1""")
def signatures(spark, d):
    return _dirty(spark, d).groupBy(tx.signature(F.concat("person", F.lit(" ID-"), "email", "phone")).alias("signature")).agg(F.count("*").alias("count"))


_TYPE = f"""SELECT '{{c}}' AS "column", CASE WHEN bool_and(lower(trim(v)) IN ('true', 'false', 'yes', 'no', 'ya', 'tidak')) THEN 'boolean' WHEN avg(CASE WHEN {_NUMBER.format(v='v')} THEN 1.0 ELSE 0 END) > 0.8 THEN 'numeric'
 WHEN avg(CASE WHEN {_DAY_FIRST.format(v='trim(v)')} IS NOT NULL THEN 1.0 ELSE 0 END) > 0.8 THEN 'date' ELSE 'text' END AS inferred_type FROM (SELECT {{e}} AS v FROM dirty) WHERE trim(v) <> ''"""
_TYPED = {"amount": "amount", "dotted": "replace(amount, ',', '.')", "born": "born", "person": "person", "flag": "CASE WHEN c_custkey % 3 = 0 THEN ' Ya' WHEN c_custkey % 3 = 1 THEN 'tidak' ELSE '' END"}


@query("agg11_inferred_type", WITH + " UNION ALL ".join(_TYPE.format(c=c, e=e) for c, e in _TYPED.items()))
def inferred(spark, d):
    return profile.inferred_types(_dirty(spark, d).select(*[F.expr(e).alias(c) for c, e in _TYPED.items()]), list(_TYPED))


# ---------------------------------------------------------------- rules

RULES = [
    Rule("email", "email_format"), Rule("phone", "phone_id"), Rule("phone", "nik"), Rule("c_name", "not_null"), Rule("amount", "numeric_range", {"min": 10, "max": 60.5}),
    Rule("born", "date_range", {"min": "1900-01-01", "max": "2026-12-31"}), Rule("phone", "starts_with", {"prefix": "08"}), Rule("person", "regex", {"pattern": "Dr"}),
]
_PHONE = "CASE WHEN starts_with(p1, '8') AND length(p1) >= 9 THEN concat('0', p1) ELSE p1 END"
_P1 = "(SELECT *, CASE WHEN starts_with(d0, '620') THEN d0[3:] WHEN starts_with(d0, '62') THEN concat('0', d0[3:]) ELSE d0 END AS p1 FROM (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS d0 FROM dirty))"


def _rule_sql(rule: str, broken: str, source: str = "dirty") -> str:
    return f"SELECT '{rule}' AS rule, count(*) AS checked, count(*) FILTER (WHERE {broken}) AS violations FROM {source}"


RULES_SQL = WITH + " UNION ALL ".join([
    _rule_sql("email_format:email", "NOT regexp_matches(lower(email), '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}$')"),
    _rule_sql("phone_id:phone", f"NOT regexp_matches({_PHONE}, '^08[0-9]{{8,11}}$')", _P1),
    _rule_sql("nik:phone", "length(regexp_replace(phone, '[^0-9]', '', 'g')) <> 16"),
    _rule_sql("not_null:c_name", "c_name IS NULL OR trim(c_name) = ''"),
    _rule_sql("numeric_range:amount", "coalesce(try_cast(replace(amount, ',', '.') AS double) NOT BETWEEN 10 AND 60.5, true)"),
    _rule_sql("date_range:born", "born <> '1994-03-21'"),
    _rule_sql("starts_with:phone", "NOT starts_with(phone, '08')"),
    _rule_sql("regex:person", "NOT starts_with(person, 'Dr')"),
])


@query("rul_all", RULES_SQL)
def all_rules(spark, d):
    return run_rules(_dirty(spark, d), RULES)


@query("rul9_cross_column", "SELECT 'discount below tax' AS rule, count(*) AS checked, count(*) FILTER (WHERE NOT l_discount < l_tax) AS violations FROM lineitem")
def cross_column(spark, d):
    return run_rules(_read(spark, d, "lineitem"), [Rule("l_discount", "cross_column", {"left": "l_discount", "right": "l_tax", "operator": "lt"}, "discount below tax")])


@query("rul12_violations", WITH + "SELECT c_custkey, email FROM dirty WHERE email = 'not-an-email'")
def rule_violations(spark, d):
    return violations(_dirty(spark, d), RULES[0]).select("c_custkey", "email")


@query("rul12_page", WITH + "SELECT c_custkey, email FROM dirty WHERE email = 'not-an-email' ORDER BY c_custkey LIMIT 25 OFFSET 25")
def violations_page(spark, d):
    return violations(_dirty(spark, d), RULES[0], "c_custkey", 2, 25).select("c_custkey", "email")


@query("rul13_latest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def latest(spark, d):
    return profile.latest(_read(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id")


# ---------------------------------------------------------------- between tables

_RI = "SELECT count(*) AS checked, count(*) FILTER (WHERE known) AS matched, count(*) FILTER (WHERE NOT known) AS violations, cast(count(*) FILTER (WHERE known) AS double) / count(*) AS key_overlap, cast(count(*) FILTER (WHERE NOT known) AS double) / count(*) AS orphan_rate FROM (SELECT {k} IN (SELECT {p} FROM {parent}) AS known FROM {child})"
_DIRTY_ORDERS = "(SELECT CASE WHEN o_orderkey % 23 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS k FROM orders)"


def _dirty_orders(spark, d):
    return _read(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 23 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS k")


@query("jn1_orders_customer", _RI.format(k="k", p="c_custkey", parent="customer", child=_DIRTY_ORDERS))
def orders_customer(spark, d):
    return crosscheck.referential_integrity(_dirty_orders(spark, d), "k", _read(spark, d, "customer"), "c_custkey")


@query("jn1_orphans", f"SELECT cast(k AS varchar) AS \"key\", count(*) AS rows FROM {_DIRTY_ORDERS} WHERE k NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def orphans(spark, d):
    return crosscheck.orphans(_dirty_orders(spark, d), "k", _read(spark, d, "customer"), "c_custkey")


@query("jn1_lineitem_part", _RI.format(k="l_partkey", p="p_partkey", parent="part", child="lineitem"))
def lineitem_part(spark, d):
    return crosscheck.referential_integrity(_read(spark, d, "lineitem"), "l_partkey", _read(spark, d, "part"), "p_partkey")


@query("jn2_consistency", WITH + "SELECT count(*) AS checked, count(*) FILTER (WHERE lower(trim(a.c_name)) <> lower(trim(b.c_name))) AS violations FROM dirty a JOIN customer b USING (c_custkey) WHERE a.c_name IS NOT NULL")
def consistency(spark, d):
    return crosscheck.consistency(_dirty(spark, d), "c_custkey", "c_name", _read(spark, d, "customer"), "c_custkey", "c_name")


@query("jn1_samples", f"SELECT cast(k AS varchar) AS \"key\" FROM (SELECT k, min(o_orderkey) AS f FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer) GROUP BY 1) ORDER BY f LIMIT 10")
def orphan_samples(spark, d):
    rows = _read(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 23 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS k")
    return crosscheck.orphans(rows, "k", _read(spark, d, "customer"), "c_custkey", "o_orderkey", crosscheck.SAMPLES).select("key")


@query("jn2_samples", WITH + """SELECT concat(a.c_custkey, ': "', a.amount, '" vs "', b.amount, '"') AS sample FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'nan' ELSE amount END AS amount FROM dirty) a JOIN (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'None' ELSE upper(amount) END AS amount FROM dirty) b USING (c_custkey)
 WHERE a.amount IN ('nan', 'None') OR lower(a.amount) <> lower(b.amount) ORDER BY a.c_custkey LIMIT 10""")
def mismatch_samples(spark, d):
    rows = _dirty(spark, d)
    a, b = rows.selectExpr("c_custkey", "CASE WHEN c_custkey % 10 = 0 THEN 'nan' ELSE amount END AS amount"), rows.selectExpr("c_custkey", "CASE WHEN c_custkey % 10 = 0 THEN 'None' ELSE upper(amount) END AS amount")
    return crosscheck.inconsistencies(a, "c_custkey", "amount", b, "c_custkey", "amount", "c_custkey")


# ---------------------------------------------------------------- outliers, personal data, standard forms

_EVENTS = "(SELECT event_id, CASE WHEN event_id % 997 = 0 THEN value * 1000 ELSE value END AS value FROM events)"


@query("ano2_outliers", f"""WITH e AS {_EVENTS}, s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS sd FROM e)
SELECT event_id AS "key", value, CASE WHEN greatest(q1 - value, value - q3) > 1.5 * (q3 - q1) THEN 'outlier_iqr' ELSE 'outlier_zscore' END AS kind,
 CASE WHEN greatest(q1 - value, value - q3) > 3 * (q3 - q1) OR abs(value - m) / sd > 4 THEN 'tinggi' ELSE 'sedang' END AS severity
FROM e, s WHERE greatest(q1 - value, value - q3) > 1.5 * (q3 - q1) OR abs(value - m) / sd > 3""")
def outliers(spark, d):
    rows = _read(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 997 = 0 THEN value * 1000 ELSE value END AS value")
    return profile.numeric_outliers(rows, "event_id", "value", None).drop("explanation")


_KONTAK = "CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE concat('(0812) 3456-', lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0')) END"
_NOMOR = "CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE concat('3171.', lpad(cast(c_custkey AS varchar(9)), 8, '0'), '-0001') END"
_PII = {"c_name": "c_name", "phone": "phone", "email": "email", "address": "address", "amount": "amount", "kontak": _KONTAK, "nomor": _NOMOR, "no_ktp": "concat('x', cast(c_custkey AS varchar(9)))", "surat": "concat(person, '@', 'x.id')"}
_SHARE = "avg(CASE WHEN {v} IS NULL THEN NULL WHEN regexp_matches({v}, '{p}') THEN 1.0 ELSE 0 END) > 0.6"


def _pii_sql(c: str, e: str) -> str:
    tests = [_SHARE.format(v="regexp_replace(v, '[\\s()-]', '', 'g')", p="^(\\+?62|0)8[0-9]{7,11}$"), _SHARE.format(v="v", p="^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"), _SHARE.format(v="regexp_replace(v, '[^0-9]', '', 'g')", p="^[0-9]{16}$")]
    named = {"c_name": "name", "phone": "phone", "email": "email", "address": "address", "no_ktp": "nik"}.get(c, "")
    case = " ".join(f"WHEN {t}{' OR true' if named == k else ''} THEN '{k}'" for k, t in zip(("phone", "email", "nik"), tests, strict=True))
    return f"SELECT '{c}' AS \"column\", CASE {case} {f'ELSE {chr(39)}{named}{chr(39)}' if named in ('name', 'address') else ''} END AS pii_type FROM (SELECT {e} AS v FROM dirty)"


@query("pii1_detect", WITH + "SELECT * FROM (" + " UNION ALL ".join(_pii_sql(c, e) for c, e in _PII.items()) + ") WHERE pii_type IS NOT NULL")
def detect(spark, d):
    return privacy.detect(_dirty(spark, d).select(*[F.expr(e).alias(c) for c, e in _PII.items()])).select("column", "pii_type")


@query("pii3_mask", WITH + """SELECT c_custkey, sha256(c_name)[1:12] AS c_name, CASE WHEN length(phone) > 6 THEN concat(phone[1:4], repeat('*', length(phone) - 6), phone[-2:]) ELSE repeat('*', length(phone)) END AS phone,
 CASE WHEN contains(email, '@') THEN concat(left(split_part(email, '@', 1), 2), repeat('*', cast(greatest(length(split_part(email, '@', 1)) - 2, 1) AS bigint)), '@', split_part(email, '@', 2)) ELSE repeat('*', length(email)) END AS email FROM
 (SELECT * REPLACE (CASE WHEN c_custkey % 6 = 0 THEN 'a@x.id' WHEN c_custkey % 6 = 1 THEN '@x.id' ELSE email END AS email) FROM dirty)""")
def mask(spark, d):
    rows = _dirty(spark, d).withColumn("email", F.expr("CASE WHEN c_custkey % 6 = 0 THEN 'a@x.id' WHEN c_custkey % 6 = 1 THEN '@x.id' ELSE email END"))
    return privacy.mask(rows, {"c_name": "name", "phone": "phone", "email": "email"}).select("c_custkey", "c_name", "phone", "email")


@query("fn8_phone", WITH + f"SELECT c_custkey, {_PHONE} AS phone FROM {_P1}")
def phone(spark, d):
    return _dirty(spark, d).select("c_custkey", tx.phone(F.col("phone")).alias("phone"))


@query("fn6_identifier", WITH + "SELECT c_custkey, regexp_replace(lower(concat(phone, '/', email)), '[^a-z0-9]', '', 'g') AS code FROM dirty")
def identifier(spark, d):
    return _dirty(spark, d).select("c_custkey", tx.identifier(F.concat("phone", F.lit("/"), "email")).alias("code"))


@query("fn11_ngrams", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3))))[1:8], ',') AS grams FROM (SELECT p_partkey, replace(lower(p_name), ' ', '') AS n FROM part)")
def ngrams(spark, d):
    return _read(spark, d, "part").select("p_partkey", F.array_join(tx.ngrams(tx.basic(F.col("p_name")), 3), ",").alias("grams"))


@query("fn12_name_block", "SELECT p_partkey, array_to_string(list_sort(list_transform(string_split(lower(p_name), ' ')[1:2], lambda w: w[1:3])), '') AS code FROM part")
def name_block(spark, d):
    return _read(spark, d, "part").select("p_partkey", tx.name_block(F.col("p_name")).alias("code"))


@query("fn4_email", WITH + "SELECT c_custkey, replace(lower(email), '@gmial.com', '@gmail.com') AS email FROM dirty")
def email(spark, d):
    return _dirty(spark, d).select("c_custkey", tx.email(F.col("email")).alias("email"))


@query("fn3_name", WITH + "SELECT c_custkey, regexp_replace(lower(person), '^(dr\\.|ibu) ', '') AS name FROM dirty")
def name(spark, d):
    return _dirty(spark, d).select("c_custkey", tx.person_name(F.col("person")).alias("name"))


@query("fn5_address", WITH + "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN concat('jalan mawar nomor ', c_custkey % 90) ELSE concat('jalan melati rt', c_custkey % 9) END AS address FROM dirty")
def address(spark, d):
    return _dirty(spark, d).select("c_custkey", tx.address(F.col("address")).alias("address"))


@query("fn10_phonetic", WITH + "SELECT c_custkey, CASE WHEN length(n) = 3 AND n[1] = n[2] AND n[2] = n[3] THEN concat('mhmd ', n[1]) WHEN length(n) > 1 AND n[1] = n[2] THEN concat('mhmd ', n[1], n[3:]) WHEN length(n) = 3 AND n[2] = n[3] THEN concat('mhmd ', n[1:2]) ELSE concat('mhmd ', n) END AS code FROM (SELECT c_custkey, cast(c_custkey % 300 AS varchar) AS n FROM dirty)")
def phonetic(spark, d):
    return _dirty(spark, d).select("c_custkey", tx.phonetic(F.col("person")).alias("code"))


@query("fn17_date", WITH + "SELECT c_custkey, CASE born WHEN '21/03/1894' THEN '1894-03-21' ELSE born END AS born FROM dirty")
def standard_date(spark, d):
    return privacy.standardize(_dirty(spark, d), {"born": "date"}).select("c_custkey", "born")


@query("cln2_standardize", WITH + "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN concat('Jl. Mawar No. ', c_custkey % 90) ELSE concat('Jl. Melati RT ', c_custkey % 9) END AS address FROM dirty")
def standard_address(spark, d):
    return privacy.standardize(_dirty(spark, d), {"address": "address"}).select("c_custkey", "address")


@query("cln2_changes", WITH + "SELECT 'c_name' AS \"column\", 'text' AS kind, count(*) AS changed FROM dirty WHERE c_name <> regexp_replace(trim(c_name), '\\s+', ' ', 'g') UNION ALL SELECT 'email', 'email', count(*) FROM dirty WHERE email <> lower(email)")
def changed(spark, d):
    return privacy.changes(_dirty(spark, d), {"c_name": "text", "email": "email"})


# ---------------------------------------------------------------- review, clean export, dictionary

_REVIEW = "WITH c AS (SELECT o_custkey AS cluster, CASE WHEN o_custkey % 5 = 0 THEN 'split' ELSE 'pending' END AS status, count(*) AS n FROM orders GROUP BY 1) "


def _members(spark, d):
    return _read(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("id"))


def _clusters(spark, d):
    return _members(spark, d).select("cluster").distinct().selectExpr("cluster", "CASE WHEN cluster % 5 = 0 THEN 'split' ELSE 'pending' END AS status", "cast(1 AS double) AS cohesion")


@query("rev1_decide", _REVIEW + """SELECT cluster, CASE WHEN status = 'pending' AND cluster % 3 = 0 AND n > 1 THEN 'confirmed' WHEN status = 'pending' AND cluster % 3 = 1 THEN 'split' ELSE status END AS status,
 CASE WHEN cluster % 3 < 2 AND status <> 'pending' THEN 'already reviewed' WHEN cluster % 3 = 0 AND n < 2 THEN 'fewer than two members' END AS rejected FROM c""")
def decide(spark, d):
    clusters = _clusters(spark, d)
    decisions = clusters.selectExpr("cluster", "CASE cluster % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'split' END AS action").filter("action IS NOT NULL")
    return review.decide(clusters, _members(spark, d), decisions).select("cluster", "status", "rejected")


@query("rev3_exclude", _REVIEW + """, m AS (SELECT o_custkey AS cluster, o_orderkey AS id, status FROM orders JOIN c ON c.cluster = o_custkey), l AS (SELECT * FROM m WHERE NOT (status = 'pending' AND id % 4 = 0)),
 p AS (SELECT x.cluster, avg(((x.id + y.id) % 128) / 128.0) AS s FROM l x JOIN l y ON x.cluster = y.cluster AND x.id < y.id GROUP BY 1), k AS (SELECT c.cluster, c.status, c.n, (SELECT count(*) FROM l WHERE l.cluster = c.cluster) AS r FROM c)
 SELECT k.cluster, CASE WHEN r < n AND r < 2 THEN 'split' ELSE status END AS status, CASE WHEN r < n AND r > 1 THEN round(s, 4) ELSE 1.0 END AS cohesion FROM k LEFT JOIN p USING (cluster)""")
def exclude(spark, d):
    members = _members(spark, d)
    a, b = members.withColumnRenamed("id", "a"), members.withColumnRenamed("id", "b")
    pairs = a.join(b, "cluster").filter("a < b").selectExpr("cluster", "a", "b", "(a + b) % 128 / 128 AS score")
    return review.exclude(_clusters(spark, d), members, pairs, members.filter("id % 4 = 0"))[0]


@query("cln1_clean", """WITH m AS (SELECT o_orderkey, o_totalprice, o_custkey AS k, CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'confirmed' WHEN o_custkey % 3 = 0 THEN 'split' ELSE 'pending' END AS s FROM orders)
SELECT o_orderkey, o_totalprice, CASE WHEN s IS NOT NULL THEN k END AS cluster, CASE WHEN s IS NULL THEN 'unique' WHEN s = 'split' THEN 'reviewed_distinct' ELSE 'pending_review' END AS status, NULL AS source_rows FROM m WHERE s IS DISTINCT FROM 'confirmed'
UNION ALL SELECT min(o_orderkey), max(o_totalprice), k, 'golden_record', string_agg(concat('r-', o_orderkey), ',' ORDER BY o_orderkey) FROM m WHERE s = 'confirmed' GROUP BY k""")
def clean(spark, d):
    rows = _read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    members = rows.selectExpr("o_orderkey", "o_custkey AS cluster", "CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'confirmed' WHEN o_custkey % 3 = 0 THEN 'split' ELSE 'pending' END AS status").filter("status IS NOT NULL")
    goldens = rows.join(members.filter("status = 'confirmed'").select("o_orderkey", "cluster"), "o_orderkey").groupBy("cluster").agg(F.max("o_totalprice").alias("o_totalprice"))
    out = golden.clean(rows.drop("o_custkey"), "o_orderkey", members, goldens)
    return out.select("o_orderkey", "o_totalprice", F.col("_dq_cluster_id").alias("cluster"), F.col("_dq_status").alias("status"), F.col("_dq_source_rows").alias("source_rows"))


@query("agg22_differing", "SELECT o_custkey, concat_ws(',', CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'o_orderstatus' END, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'o_orderpriority' END) AS columns FROM orders GROUP BY 1")
def differing(spark, d):
    return review.differing(_read(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"]).select("o_custkey", F.array_join("columns", ",").alias("columns"))


_TOP = "SELECT '{c}' AS \"column\", string_agg(concat(v, ' (', n, ')'), '; ' ORDER BY n DESC, v) AS top_values, '{r}' AS rules, '' AS pii FROM (SELECT {c} AS v, count(*) AS n FROM dirty GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"


@query("snk4_dictionary", WITH + " UNION ALL ".join(_TOP.format(c=c, r=r) for c, r in (("person", "regex"), ("amount", "numeric_range"), ("c_mktsegment", ""))) + """ UNION ALL SELECT 'email',
 concat('[PII: Email] contoh: ', left(e, 2), repeat('*', cast(greatest(position('@' IN e) - 3, 1) AS bigint)), substr(e, position('@' IN e))), 'email_format', 'Email' FROM (SELECT min(email) AS e FROM dirty)""")
def dictionary(spark, d):
    rows, columns = _dirty(spark, d), ["person", "amount", "email", "c_mktsegment"]
    profiles = profile.profile(rows, columns)
    tops = profiles.select("column", F.explode("top_values").alias("t")).select("column", "t.value", "t.count")
    rules = spark.createDataFrame([(r.column, r.kind) for r in RULES], "column string, rule string")
    return review.dictionary(profiles.select("column"), tops, rules, privacy.detect(rows, columns))
