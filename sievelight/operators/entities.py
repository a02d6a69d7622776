"""Entity resolution end to end: configuration, candidates, scores, components, validated clusters."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields
from itertools import combinations
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import similarity as sim
from sievelight.functions import text as tx
from sievelight.operators import resolve
from sievelight.operators.privacy import roles
from sievelight.operators.rules import as_text
from sievelight.operators.shared import running_counts, settled

MATCH_METHODS = (*resolve.METHODS,)
BLOCK_METHODS = ("exact", "composite_exact", "prefix", "token_prefix", "phonetic", "ngram", "email_local", "phone_suffix")
FUZZY = ("token_sort", "token_set", "fuzzy_ratio", "jaro_winkler", "phonetic")
#: Members of a cluster, and of a component up to which all its pairs are scored.
CLUSTER_ROWS, COMPONENT_ROWS = 20, 60
#: Share of a value that isn't known; evidence that a score by roles needs; weights of the roles (fixed values).
UNKNOWN_SHARE, LEAST_WEIGHT = 0.01, 0.4
ROLE_WEIGHTS = {"phone": 0.35, "email": 0.25, "name": 0.25, "address": 0.15}
ROLE_METHODS = {"phone": "phone", "email": "email", "name": "token_sort", "address": "token_set"}


def _check(what: str, method: str, known: tuple, columns: tuple, normalizers: tuple) -> None:
    if method not in known:
        raise ValueError(f"unknown {what} method: {method}")
    if not columns:
        raise ValueError(f"a {what} rule needs columns")
    if method == "composite_exact" and len(columns) < 2:
        raise ValueError("composite_exact needs two columns")
    if unknown := set(normalizers) - set(tx.NORMALIZERS):
        raise ValueError(f"unknown normalizers: {', '.join(sorted(unknown))}")


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")


@dataclass(frozen=True)
class MatchRule:
    columns: tuple[str, ...]
    method: str = "exact"
    weight: float = 2.0
    normalizers: tuple[str, ...] = ()
    mismatch_penalty: float = 0.0
    mismatch_threshold: float = 0.2
    required: bool = False
    required_threshold: float = 0.999
    m_probability: float = 0.95
    max_u_probability: float = 0.25
    fuzzy_u_probability: float = 0.25

    def __post_init__(self):
        _check("matching", self.method, MATCH_METHODS, self.columns, self.normalizers)
        _within("weight", self.weight, 0, 5)
        for name in ("mismatch_penalty", "mismatch_threshold", "required_threshold", "max_u_probability", "fuzzy_u_probability"):
            _within(name, getattr(self, name), 0, 1)
        if not 0.5 < self.m_probability < 1:
            raise ValueError("m_probability must lie between 0.5 and 1")

    @property
    def key(self) -> str:
        return "+".join(self.columns)


@dataclass(frozen=True)
class BlockRule:
    columns: tuple[str, ...]
    method: str = "exact"
    normalizers: tuple[str, ...] = ()
    length: int = 3

    def __post_init__(self):
        _check("blocking", self.method, BLOCK_METHODS, self.columns, self.normalizers)
        _within("length", self.length, 1, 20)


@dataclass(frozen=True)
class ExactRule:
    columns: tuple[str, ...]
    normalizers: tuple[str, ...] = ("basic",)

    def __post_init__(self):
        _check("exact", "exact", ("exact",), self.columns, self.normalizers)


@dataclass(frozen=True)
class Validation:
    enabled: bool = True
    method: str = "representative"
    min_cohesion: float = 0.7
    min_representative_score: float = 0.75

    def __post_init__(self):
        if self.method not in ("connected", "representative"):
            raise ValueError(f"unknown cluster validation: {self.method}")
        _within("min_cohesion", self.min_cohesion, 0, 1)
        _within("min_representative_score", self.min_representative_score, 0, 1)


@dataclass(frozen=True)
class DedupConfig:
    """What counts as the same entity. ``from_dict`` reads the stored form, in which a rule names ``column`` or ``columns``."""

    threshold: float = 0.8
    prior_probability: float = 0.05
    exact_row_match: bool = True
    rules: tuple[MatchRule, ...] = ()
    blocking_rules: tuple[BlockRule, ...] = ()
    exact_match_rules: tuple[ExactRule, ...] = ()
    cluster_validation: Validation = field(default_factory=Validation)
    version: int = 2

    def __post_init__(self):
        _within("threshold", self.threshold, 0.1, 1)
        if not 0 < self.prior_probability <= 0.5:
            raise ValueError("prior_probability must lie between 0 and 0.5")

    @classmethod
    def from_dict(cls, given: dict) -> DedupConfig:
        def made(kind, one: dict):
            known = {f.name for f in fields(kind)}
            own = {k: tuple(v) if isinstance(v, list) else v for k, v in one.items() if k in known and v is not None}
            if "columns" in known and not own.get("columns"):
                own["columns"] = (one["column"],) if one.get("column") else ()
            return kind(**own)

        lists = {"rules": MatchRule, "blocking_rules": BlockRule, "exact_match_rules": ExactRule}
        own = {k: given[k] for k in ("threshold", "prior_probability", "exact_row_match", "version") if k in given}
        own |= {k: tuple(made(kind, x) for x in given.get(k) or ()) for k, kind in lists.items()}
        return cls(**own, cluster_validation=made(Validation, given.get("cluster_validation") or {}))

    def check_columns(self, columns: list[str]) -> None:
        """Raises ValueError where a rule names a column that isn't there."""
        named = {c for r in (*self.rules, *self.blocking_rules, *self.exact_match_rules) for c in r.columns}
        if missing := named - set(columns):
            raise ValueError(f"unknown columns: {', '.join(sorted(missing))}")


def role_rules(found: dict[str, str]) -> tuple[MatchRule, ...]:
    """Rules by the roles of columns, for a table without a configuration."""
    return tuple(MatchRule((c,), ROLE_METHODS[r], ROLE_WEIGHTS[r] * 4, (r,)) for r, c in found.items() if r in ROLE_METHODS)


def derived_blocking(rules: tuple[MatchRule, ...]) -> tuple[BlockRule, ...]:
    """Blocking rules that bring together what the matching rules can agree on."""
    out: list[BlockRule] = []
    for r in rules:
        # a rule without normalizers takes those of its method, and so do its blocks
        own = r.normalizers or ((r.method,) if r.method in ("phone", "email") else ())
        if r.method in ("exact", "composite_exact"):
            out.append(BlockRule(r.columns, "composite_exact" if len(r.columns) > 1 else "exact", own))
        elif r.method == "phone":
            out.append(BlockRule(r.columns, "phone_suffix", own, 7))
        elif r.method == "email":
            out += [BlockRule(r.columns, "email_local", own, 4), BlockRule(r.columns, "ngram", own)]
        elif r.method in FUZZY:
            out += [BlockRule(r.columns, "phonetic", own), BlockRule(r.columns, "prefix", own), BlockRule(r.columns, "ngram", own)]
    return tuple(out)


# ---------------------------------------------------------------- values of rows


def _normal(df: DataFrame, columns: tuple[str, ...], normalizers: tuple[str, ...], method: str = "") -> list[Column]:
    return [F.coalesce(tx.normalized(as_text(df, c), list(normalizers), method), F.lit("")) for c in columns]


def block_rules(df: DataFrame, rules: tuple[BlockRule, ...]) -> list[tuple[str, Column]]:
    return [(f"{'+'.join(r.columns)}:{r.method.replace('_', '-')}", resolve.block_keys(r.method, _normal(df, r.columns, r.normalizers), r.length)) for r in rules]


def exact_keys(df: DataFrame, config: DedupConfig | None, columns: list[str]) -> list[tuple[str, Column]]:
    """Keys of rows that are the same by an identity rule (all its values present), or as whole rows (one value present)."""
    keys = []
    for i, r in enumerate(config.exact_match_rules if config else ()):
        values = F.array(*_normal(df, r.columns, r.normalizers))
        keys.append((f"exact{i}", F.when(~F.array_contains(values, ""), F.array(F.sha2(F.concat_ws("\x1f", values), 256))).otherwise(F.array().cast("array<string>"))))
    if config is None or config.exact_row_match:
        values = _normal(df, tuple(sorted(columns)), ("basic",))
        # spelt out: a test with a function over the array would work out every value once more, row by row outside generated code
        present = F.lit(False)
        for v in values:
            present |= v != ""
        keys.append(("row", F.when(present, F.array(F.sha2(F.concat_ws("\x1f", *values), 256))).otherwise(F.array().cast("array<string>"))))
    return keys


def evidence(df: DataFrame, row_id: str, rules: tuple[MatchRule, ...], frequencies: bool) -> DataFrame:
    """id and, for each rule, ``e``: its normalised values, what is compared, and the share of rows with these values."""
    made = []
    for r in rules:
        v = _normal(df, r.columns, r.normalizers, r.method)
        made.append(F.struct(F.array(*v).alias("v"), (tx.phonetic(v[0]) if r.method == "phonetic" else v[0]).alias("k")))
    out = settled(df.select(F.col(row_id).alias("id"), *[m.alias(f"r{i}") for i, m in enumerate(made)]))
    shares = []
    for i in range(len(rules)):
        shares.append(F.lit(UNKNOWN_SHARE))
        if frequencies:
            present = ~F.array_contains(F.col(f"r{i}.v"), "")
            counts = out.filter(present).groupBy(F.col(f"r{i}.v").alias(f"v{i}")).agg(F.count(F.lit(1)).alias(f"n{i}"))
            total = out.agg(F.count_if(present).alias(f"all{i}"))
            out = out.join(counts, F.col(f"r{i}.v") == F.col(f"v{i}"), "left").crossJoin(F.broadcast(total)).withColumn(f"s{i}", F.coalesce(F.col(f"n{i}") / F.col(f"all{i}"), F.lit(UNKNOWN_SHARE))).drop(f"v{i}", f"n{i}", f"all{i}")
            shares[-1] = F.col(f"s{i}")
    parts = [F.struct(F.col(f"r{i}.v").alias("v"), F.col(f"r{i}.k").alias("k"), s.alias("s")) for i, s in enumerate(shares)]
    return settled(out.select("id", (F.array(*parts) if parts else F.array().cast("array<struct<v:array<string>,k:string,s:double>>")).alias("e")))


# ---------------------------------------------------------------- scores


def part_keys(rules: tuple[MatchRule, ...]) -> list[str]:
    """A name for each rule's part of a score; the place tells rules over the same columns apart."""
    seen: set[str] = set()
    out = []
    for i, r in enumerate(rules):
        out.append(r.key if r.key not in seen else f"{r.key}#{i + 1}")
        seen.add(r.key)
    return out


def scored(pairs: DataFrame, rows: DataFrame, rules: tuple[MatchRule, ...], prior: float | None) -> DataFrame:
    """a, b, score and parts of ``pairs``, from the evidence of ``rows``; ``prior`` None weighs similarities instead of odds."""
    both = pairs.join(rows.select(F.col("id").alias("a"), F.col("e").alias("ea")), "a").join(rows.select(F.col("id").alias("b"), F.col("e").alias("eb")), "b")
    for i, r in enumerate(rules):
        x, y = F.col("ea")[i], F.col("eb")[i]
        gone = F.array_contains(x["v"], "") | F.array_contains(y["v"], "")
        if r.method == "composite_exact":
            score = (x["v"] == y["v"]).cast("double")
        elif r.method == "phonetic":
            score = resolve.similarity("jaro_winkler", x["k"], y["k"])
        else:
            score = resolve.similarity(r.method, x["k"], y["k"])
        both = both.withColumn(f"s{i}", F.when(~gone, score))
    found = [F.col(f"s{i}") for i in range(len(rules))]
    some = F.lit(False)
    for s in found:
        some |= s.isNotNull()
    if prior is None:
        weight = sum((F.when(s.isNotNull(), r.weight / 4).otherwise(0.0) for s, r in zip(found, rules, strict=True)), F.lit(0.0))
        gained = sum((F.coalesce(s * (r.weight / 4), F.lit(0.0)) for s, r in zip(found, rules, strict=True)), F.lit(0.0))
        total = F.when(weight >= LEAST_WEIGHT - 1e-12, gained / weight).otherwise(0.0)
    else:
        terms = []
        for i, (s, r) in enumerate(zip(found, rules, strict=True)):
            x, y = F.col("ea")[i], F.col("eb")[i]
            terms.append(resolve.log_odds(s, x["v"] == y["v"], x["s"], y["s"], r.weight, r.m_probability, r.max_u_probability, r.fuzzy_u_probability, r.mismatch_penalty, r.mismatch_threshold))
        vetoed = [F.coalesce(s < r.required_threshold, F.lit(False)) for s, r in zip(found, rules, strict=True) if r.required]
        veto = F.lit(False)
        for v in vetoed:
            veto |= v
        total = F.when(veto | ~some, 0.0).otherwise(resolve.probability(terms, prior))
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.round(s, 4).alias("value")) for k, s in zip(part_keys(rules), found, strict=True)])
    parts = F.map_from_entries(F.filter(cells, lambda c: c["value"].isNotNull())) if rules else F.create_map().cast("map<string,double>")
    return both.select("a", "b", F.coalesce(total, F.lit(0.0)).alias("score"), parts.alias("parts"))


KERNELS = {
    "exact": lambda a, b: float(a == b), "phone": lambda a, b: float(a == b), "email": lambda a, b: 1.0 if a == b else 0.5 * sim.indel_ratio(a, b), "token_sort": sim.token_sort_ratio,
    "token_set": sim.token_set_ratio, "fuzzy_ratio": sim.indel_ratio, "jaro_winkler": sim.jaro_winkler, "phonetic": sim.jaro_winkler,
}


class Scorer:
    """``scored`` for one pair at a time, for pairs that only the validation of clusters asks for."""

    def __init__(self, rules: tuple[MatchRule, ...], prior: float | None):
        self.rules, self.prior, self.keys = rules, prior, part_keys(rules)

    def __call__(self, x: list, y: list) -> tuple[float, dict[str, float]]:
        parts, odds, weights, gained, veto = {}, 0.0, 0.0, 0.0, False
        for r, key, p, q in zip(self.rules, self.keys, x, y, strict=True):
            v, w = list(p["v"]), list(q["v"])
            if not all(v) or not all(w) or (r.method == "phonetic" and not (p["k"] and q["k"])):
                continue
            s = float(v == w) if r.method == "composite_exact" else KERNELS[r.method](p["k"], q["k"])
            parts[key] = round(s, 4)
            weights, gained = weights + r.weight / 4, gained + s * r.weight / 4
            veto |= r.required and s < r.required_threshold
            u = min(max(p["s"], q["s"], 1e-4), r.max_u_probability)
            u = u if v == w else max(u, r.fuzzy_u_probability)
            odds += r.weight * (s * math.log(r.m_probability / u) + (1 - s) * math.log((1 - r.m_probability) / max(1 - u, 1e-4)))
            if r.mismatch_penalty > 0 and s <= r.mismatch_threshold:
                odds += math.log(max(1 - r.mismatch_penalty, 0.001))
        if self.prior is None:
            return (gained / weights if weights >= LEAST_WEIGHT - 1e-12 else 0.0), parts
        if not parts or veto:
            return 0.0, parts
        return 1 / (1 + math.exp(-(odds + math.log(self.prior / (1 - self.prior))))), parts


# ---------------------------------------------------------------- clusters

EXACT = {"exact_fast_path": 1.0}
CLUSTERED = "component long, least long, cohesion double, members array<long>, pairs array<struct<a:long,b:long,score:double,parts:map<string,double>>>"


class _Component:
    """One component's rows and the scores that are known; others are computed when they are asked for."""

    def __init__(self, rows: pd.DataFrame, edges: pd.DataFrame, scorer: Scorer):
        self.of = dict(zip(rows["id"].tolist(), rows["e"], strict=True))
        self.known = {}
        for a, b, score, exact in zip(edges["a"].tolist(), edges["b"].tolist(), edges["score"].tolist(), edges["exact"].tolist(), strict=True):
            self.known[a, b] = (score, EXACT if exact else None)
        self.scorer = scorer

    def pair(self, a: int, b: int) -> tuple[float, dict[str, float]]:
        key = (a, b) if a < b else (b, a)
        found = self.known.get(key)
        if found is None or found[1] is None:
            found = self.known[key] = self.scorer(self.of[key[0]], self.of[key[1]])
        return found

    def pairs(self, members: list[int]) -> list[dict]:
        return [{"a": a, "b": b, "score": round(self.pair(a, b)[0], 4), "parts": self.pair(a, b)[1]} for a, b in combinations(sorted(members), 2)]

    def cohesion(self, members: list[int]) -> float:
        found = self.pairs(members)
        return sum(p["score"] for p in found) / len(found) if found else 0.0


def representative_groups(whole: _Component, least: float, cohesion: float) -> list[list[int]]:
    """Groups round the row that is most like all others left: those as like it as ``least``, if they hold together, else without the weakest."""
    left, out = set(whole.of), []
    while len(left) > 1:
        mean = {x: sum(whole.pair(x, y)[0] for y in left if y != x) / (len(left) - 1) for x in left}
        top = min(left, key=lambda x: (-mean[x], x))
        group = [top, *(x for x in sorted(left - {top}) if whole.pair(top, x)[0] >= least)]
        if len(group) < 2:
            left.discard(top)
        elif whole.cohesion(group) >= cohesion:
            out.append(group)
            left -= set(group)
        else:
            left.discard(min(group, key=lambda x: (mean[x], x)))
    return out


def bounded_groups(whole: _Component, least: float, cohesion: float) -> list[list[int]]:
    """Groups of a row and its best known neighbours, for components whose pairs are too many: the row with most neighbours left comes first."""
    near: dict[int, dict[int, float]] = {x: {} for x in whole.of}
    for (a, b), (score, _) in whole.known.items():
        if score >= least:
            near[a][b] = near[b][a] = score
    degree = {x: len(n) for x, n in near.items()}
    by_degree: dict[int, set[int]] = {}
    for x, d in degree.items():
        by_degree.setdefault(d, set()).add(x)
    left, out = set(whole.of), []

    def leave(gone):
        for x in gone:
            left.discard(x)
            by_degree[degree[x]].discard(x)
            for y in near[x]:
                if y in left:
                    by_degree[degree[y]].discard(y)
                    degree[y] -= 1
                    by_degree.setdefault(degree[y], set()).add(y)

    most = max(by_degree, default=0)
    while len(left) > 1:
        while not by_degree.get(most):
            most -= 1
        top = min(by_degree[most])
        group = [top, *sorted((y for y in near[top] if y in left), key=lambda y: (-near[top][y], y))[: CLUSTER_ROWS - 1]]
        if len(group) > 1 and whole.cohesion(group) >= cohesion:
            out.append(group)
            leave(group)
        else:
            leave([top])
    return out


def _validated(scorer: Scorer, validation: Validation | None):
    def run(key, rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        whole, groups = _Component(rows, edges, scorer), [sorted(rows["id"].tolist())]
        if validation is not None and len(rows) > COMPONENT_ROWS:
            groups = bounded_groups(whole, validation.min_representative_score, validation.min_cohesion)
        elif validation is not None and validation.enabled and validation.method == "representative":
            groups = representative_groups(whole, validation.min_representative_score, validation.min_cohesion)
        out = []
        for group in groups:
            members = sorted(group)[:CLUSTER_ROWS]
            out.append((key[0], members[0], round(whole.cohesion(members), 4), members, whole.pairs(members)))
        return pd.DataFrame(out, columns=["component", "least", "cohesion", "members", "pairs"])

    return run


class Resolved(NamedTuple):
    """clusters (cluster, cohesion, status, record_count), members (cluster, id), pairs (cluster, a, b, score, parts), groups (cluster, cohesion, members as an array in order)."""

    roles: dict[str, str]
    clusters: DataFrame
    members: DataFrame
    pairs: DataFrame
    groups: DataFrame


def resolve_entities(df: DataFrame, row_id: str, config: DedupConfig | None = None, most: int | None = resolve.BLOCK_ROWS, most_rows: int | None = None, most_pairs: int | None = None) -> Resolved:
    """The rows of ``df`` that are the same entity, as clusters of at most ``CLUSTER_ROWS`` rows.

    Rows that are the same by an identity rule or as a whole score 1; others
    that share a block are scored. Pairs over the threshold form components.
    With a configuration these are split into groups that hold together:
    components up to ``COMPONENT_ROWS`` by all their pairs, larger ones by the
    best known neighbours of the best connected rows, each component in one
    task. Where one key alone can make rows the same, neither pairs nor
    components are built (``equal_groups``). Blocks of more than ``most`` rows
    are passed over (``resolve.left_out``), with None none is. ``row_id`` is a
    number, unique. ``most_rows`` takes the first rows only, ``most_pairs`` the
    first pairs, both in order of ids. Clusters are named in order of cohesion,
    then of their least row. An empty table has none.
    """
    columns = [c for c in df.columns if c != row_id]
    found = roles(columns)
    if config is not None:
        config.check_columns(columns)
    df = df if most_rows is None else df.orderBy(row_id).limit(most_rows)
    df = df.withColumn(row_id, F.col(row_id).cast("long"))
    own = config.rules if config and config.rules else ()
    rules = own or role_rules(found)
    prior = config.prior_probability if own else None

    blocking = (config.blocking_rules if own else ()) or derived_blocking(rules)
    keys = exact_keys(df, config, columns)
    if len(keys) == 1 and not blocking:
        return _resolved(found, equal_groups(df, row_id, keys[0][1], most, config is not None), _all_exact(F.col("members")))
    exact = resolve.pairs_within(df, row_id, keys, most) if keys else df.sparkSession.createDataFrame([], "a long, b long")
    exact = settled(exact)
    rows = evidence(df, row_id, rules, bool(own))
    if blocking:
        pairs = resolve.pairs_within(df, row_id, block_rules(df, blocking), most).join(exact, ["a", "b"], "left_anti")
        pairs = pairs if most_pairs is None else pairs.orderBy("a", "b").limit(most_pairs)
        scores = settled(scored(pairs, rows, rules, prior).select("a", "b", "score"))
    else:
        scores = exact.limit(0).withColumn("score", F.lit(0.0))
    threshold = config.threshold if config else 0.8
    linked = scores.filter(F.col("score") >= threshold).select("a", "b").union(exact)
    placed = resolve.components(linked).withColumnRenamed("cluster", "component")

    validation = config.cluster_validation if config else None
    if validation is None:
        placed = _first_members(placed)
    known = scores.withColumn("exact", F.lit(False)).union(exact.select("a", "b", F.lit(1.0), F.lit(True)))
    least = min(threshold, validation.min_representative_score) if validation else threshold
    ends = [placed.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")) for k in "ab"]
    edges = known.filter(F.col("score") >= least).join(ends[0], "a").join(ends[1], "b").filter("ca = cb").select(F.col("ca").alias("component"), "a", "b", "score", "exact")
    inside = placed.join(rows, "id").select("component", "id", "e")
    groups = settled(inside.groupBy("component").cogroup(edges.groupBy("component")).applyInPandas(_validated(Scorer(rules, prior), validation), CLUSTERED))

    return _resolved(found, groups, F.col("pairs"))


def _resolved(found: dict[str, str], groups: DataFrame, pairs: Column) -> Resolved:
    """The clusters of ``groups`` (least, cohesion, members and what ``pairs`` needs), named in order."""
    ordered = running_counts(groups.withColumns({"at": F.struct((-F.col("cohesion")).alias("c"), "least"), "g": F.lit(0), "n": F.lit(1)}), "g", "at", "n")
    named = settled(ordered.withColumn("cluster", F.format_string("ec_%05d", F.col("below") + 1)).drop("component", "least", "at", "g", "n", "below", "total"))
    return Resolved(
        found,
        named.select("cluster", "cohesion", F.lit("pending").alias("status"), F.size("members").cast("long").alias("record_count")),
        named.select("cluster", F.explode("members").alias("id")),
        named.select("cluster", F.explode(pairs).alias("p")).select("cluster", "p.*"),
        named.select("cluster", "cohesion", "members"),
    )


def _all_exact(members: Column) -> Column:
    """The pairs of ``members`` (sorted) as those of rows that are all the same."""
    parts = F.map_from_arrays(F.array(*map(F.lit, EXACT)), F.array(*map(F.lit, EXACT.values())))
    after = lambda i: F.slice(members, i + 2, F.size(members))
    return F.flatten(F.transform(members, lambda a, i: F.transform(after(i), lambda b: F.struct(a.alias("a"), b.alias("b"), F.lit(1.0).alias("score"), parts.alias("parts")))))


def equal_groups(df: DataFrame, row_id: str, keys: Column, most: int | None, validated: bool) -> DataFrame:
    """least, cohesion and members of the clusters of rows with equal ``keys`` (one at most a row), when nothing else links rows.

    Each class of equal rows is a component whose pairs all score 1, so the
    groups that validation finds are known without a pair: the first
    ``CLUSTER_ROWS`` members, of a class over ``COMPONENT_ROWS`` each run of so
    many, without a row that is left alone. No more are gathered at once.
    """
    keyed = df.select(F.col(row_id).alias("id"), F.unhex(F.try_element_at(keys, F.lit(1))).alias("key")).filter("key IS NOT NULL")
    if most is None:
        ranked = running_counts(keyed.withColumn("n", F.lit(1)), "key", "id", "n")
    else:
        whole = Window.partitionBy("key")
        ranked = keyed.select("id", "key", (F.row_number().over(whole.orderBy("id")) - 1).alias("below"), F.count(F.lit(1)).over(whole).alias("total")).filter(F.col("total") <= most)
    run = F.floor(F.col("below") / CLUSTER_ROWS)
    kept = (run == 0) | (F.col("total") > COMPONENT_ROWS) if validated else run == 0
    groups = ranked.filter(kept).groupBy("key", run.alias("run")).agg(F.array_sort(F.collect_list("id")).alias("members"))
    return settled(groups.filter(F.size("members") > 1).select(F.col("members")[0].alias("least"), F.lit(1.0).alias("cohesion"), "members"))


def _first_members(placed: DataFrame) -> DataFrame:
    """The first ``CLUSTER_ROWS`` rows of each component: without validation no other is looked at."""
    return placed.withColumn("k", F.row_number().over(Window.partitionBy("component").orderBy("id"))).filter(F.col("k") <= CLUSTER_ROWS).drop("k")
