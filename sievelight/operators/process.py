"""One run over a dataset: profile, rules, entities, outliers, personal data, score and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators import entities, monitor, privacy, profile, rules


@dataclass(frozen=True)
class Pipeline:
    """What a run does. Rules, outliers, personal data and the score need both profiling and entities, as their results do."""

    profiling: bool = True
    rules: bool = True
    dedup: bool = True
    schedule: str | int = "manual"
    threshold: float = monitor.THRESHOLD

    def __post_init__(self):
        monitor.interval(self.schedule)
        monitor.alert_threshold(self.threshold)

    @property
    def scoring(self) -> bool:
        return self.profiling and self.rules and self.dedup


def process(df: DataFrame, row_id: str, own_rules: list[rules.Rule] | None = None, config: entities.DedupConfig | None = None, flags: Pipeline | None = None, confirmed: DataFrame | None = None) -> dict[str, DataFrame]:
    """The results of a run by name, as far as ``flags`` ask for them.

    Without rules of its own a dataset gets those that its column names
    suggest. ``confirmed`` (cluster members that are pending or confirmed)
    counts duplicates where entities are not resolved again.
    """
    flags = flags or Pipeline()
    columns, out = [c for c in df.columns if c != row_id], {}
    if flags.profiling:
        out["profiles"] = profile.profile(df, columns, row_id)
    if flags.dedup:
        found = entities.resolve_entities(df, row_id, config)
        out |= {"clusters": found.clusters, "members": found.members, "pairs": found.pairs}
    if flags.scoring:
        checks = own_rules if own_rules is not None else rules.suggest(columns)
        results = rules.run_rules(df, checks) if checks else df.sparkSession.createDataFrame([], "rule string, checked long, violations long")
        at = df.sparkSession.createDataFrame([(r.name or f"{r.kind}:{r.column}", r.column) for r in checks], "rule string, column string")
        out["results"] = results.join(F.broadcast(at), "rule")
        out["outliers"] = profile.outliers(df.select(row_id, *columns), row_id)
        out["pii"] = privacy.detect(df, columns, row_id)
        out["score"] = monitor.score(out["profiles"], out["results"], out.get("members", confirmed))
    return out


def rerun_rules(df: DataFrame, row_id: str, own_rules: list[rules.Rule], members: DataFrame | None = None) -> dict[str, DataFrame]:
    """Profile, rules, outliers, personal data and score again, with the clusters as they are."""
    columns = [c for c in df.columns if c != row_id]
    out = {"profiles": profile.profile(df, columns, row_id), "results": rules.run_rules(df, own_rules), "outliers": profile.outliers(df, row_id), "pii": privacy.detect(df, columns, row_id)}
    return out | {"score": monitor.score(out["profiles"], out["results"], members)}
