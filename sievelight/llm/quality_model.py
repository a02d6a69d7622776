"""Quality classifier by positive-unlabelled learning.

A small network is fitted on trusted positives and unlabelled text alone, by
the non-negative unbiased risk of Kiryo et al. (2017): with class prior c and
logistic loss l, c E_P[l(f, 1)] + max(0, E_U[l(f, 0)] - c E_P[l(f, 0)]). Where
the second part turns negative on a batch the step goes against it, which
keeps the network from memorising the positives.

The class prior is estimated from positives and unlabelled text, too: a
network that tells the one from the other orders all rows, and above any score
the unlabelled rows hold at least the prior's share of what the positives
hold there, so the least such ratio bounds the prior, closely where the highest
scores are good text alone. Fits with that prior order the rows better, and
their bounds are closer. The last fit's output becomes a score by the same
counts: the prior times the positives' density over that of all rows.

The fit begins on bounded samples. Scaling, prior and the last steps, along
the gradient of the whole risk, take all unlabelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.common import held_out, stored, table, trimmed, utf8
from sievelight.llm.textstats import CLASSES, COMMON, text_stats

#: Labelled positives that the fit may hold, at most; unlabelled rows that it begins with, and its last steps, over all of them.
POSITIVES, UNLABELLED, WHOLE_STEPS = 20_000, 40_000, 4
#: Bins of a score, and the share of positives that a tail must hold to bound the prior.
BINS, LEAST_TAIL = 1000, 0.5
#: Largest output of the network that is told from others.
REACH = 15.0
#: Further estimates of the prior, each from a fit with the one before.
PRIOR_ROUNDS = 2
FOLDS, THRESHOLD = 5, 0.3
FEATURES = (*CLASSES, "log_words", "word_length", "distinct", "top_word", "repeated", "dup_lines", "line_words", "common", "has_words")


def features(text: bytes) -> list[float]:
    """The classifier's view of a text; every entry is finite, an empty text gives zeros."""
    s = text_stats(text)
    chars, n, lines = max(1.0, float(s.classes.sum())), max(1, s.n_words), max(1, s.n_lines)
    return [*np.sqrt(s.classes / chars), np.log1p(s.n_words) / 8, min(s.word_chars / n, 40) / 10, s.n_distinct / n, s.top_word / n, s.n_repeat_words / n, s.n_dup_lines / lines, np.log1p(n / lines) / 6, float(s.common[: len(COMMON)].sum()) / n, float(s.n_words > 0)]


def _featured(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            rows = np.array([features(t) for t in utf8(part.column(1))], np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "features"])


class Network:
    """One hidden layer; standardises its input; ``fit`` minimises the non-negative risk by Adam."""

    def __init__(self, inputs: int, hidden: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.knots = np.zeros(inputs), np.ones(inputs), None
        self.w = [rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w[0] + self.w[1])
        return h, h @ self.w[2] + self.w[3][0]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The network's output for rows as they are, within ``REACH`` on either side."""
        return np.clip(self._forward((x - self.mean) / self.scale)[1], -REACH, REACH)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The share of good text among rows like these: the network's own until it is calibrated, which leaves their order as it is."""
        f = self.raw(x)
        own = 1 / (1 + np.exp(-f))
        return own if self.knots is None else 0.999 * np.interp(f, *self.knots) + 0.001 * own

    def _gradient(self, x: np.ndarray, h: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        back = d[:, None] * self.w[2] * (1 - h * h)
        return [x.T @ back, back.sum(axis=0), h.T @ d, np.array([d.sum()])]

    def gradients(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], float, float]:
        """Gradients of the mean losses of the (scaled) rows as label 1 and as label 0, and these losses."""
        h, f = self._forward(x)
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return self._gradient(x, h, (s - 1) / len(x)), self._gradient(x, h, s / len(x)), float(np.logaddexp(0, -f).mean()), float(np.logaddexp(0, f).mean())

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 3000, batch: int = 512, rate: float = 0.005, decay: float = 1e-4, seed: int = 6) -> Network:
        """Adam over batches of (scaled) rows."""
        rng, adam = np.random.default_rng(seed), Adam(self.w, decay)
        for t in range(1, steps + 1):
            up, down, _, as_zero = self.gradients(positive[rng.integers(0, len(positive), batch)])
            _, other, _, loss = self.gradients(unlabelled[rng.integers(0, len(unlabelled), batch)])
            adam.step(risk_gradient(up, down, as_zero, other, loss, prior), rate * (1 - t / (steps + 1)))
        return self

    def fit_apart(self, positive: np.ndarray, unlabelled: np.ndarray, steps: int = 1500, batch: int = 512, rate: float = 0.005, seed: int = 7) -> Network:
        """Tells positives from unlabelled rows, as many of each in a batch."""
        rng, adam = np.random.default_rng(seed), Adam(self.w, 1e-3)
        for t in range(1, steps + 1):
            up = self.gradients(positive[rng.integers(0, len(positive), batch)])[0]
            down = self.gradients(unlabelled[rng.integers(0, len(unlabelled), batch)])[1]
            adam.step([a + b for a, b in zip(up, down, strict=True)], rate * (1 - t / (steps + 1)))
        return self


def risk_gradient(up: list, down: list, as_zero: float, other: list, loss: float, prior: float) -> list[np.ndarray]:
    """The step of the non-negative risk: ``up`` and ``down`` of the positives as 1 and as 0, ``other`` of the unlabelled rows as 0."""
    if loss - prior * as_zero >= 0:
        return [prior * a - prior * b + c for a, b, c in zip(up, down, other, strict=True)]
    return [prior * b - c for b, c in zip(down, other, strict=True)]


class Adam:
    """Steps on weights in place, with decay of the matrices among them."""

    def __init__(self, weights: list[np.ndarray], decay: float):
        self.w, self.decay, self.t = weights, decay, 0
        self.first, self.second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def step(self, gradient: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for i, g in enumerate(gradient):
            g = g + self.decay * self.w[i] * (i in (0, 2))
            self.first[i] = 0.9 * self.first[i] + 0.1 * g
            self.second[i] = 0.999 * self.second[i] + 0.001 * g * g
            self.w[i] = self.w[i] - rate * (self.first[i] / (1 - 0.9**self.t)) / (np.sqrt(self.second[i] / (1 - 0.999**self.t)) + 1e-8)


def _sampled(df: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` rows of features, the same in every run, whatever the order of rows."""
    rows = df.select(F.xxhash64("doc_id", "features").alias("at"), "features").orderBy("at", "features").limit(most).toArrow()
    flat = rows.column("features").combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(-1, len(FEATURES))


def _summed(make, size: int):
    """One row a task: the sum of what ``make`` gives for its rows of features, as ``size`` doubles."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += make(np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, -1))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _over_all(rows: DataFrame, make, size: int) -> np.ndarray:
    """A sum over all rows; a few numbers a task reach the driver, which adds them in order of size, so that the order of tasks plays no part."""
    total, merge = np.zeros(size), []
    for r in rows.select("features").mapInArrow(_summed(make, size), "sums binary").toLocalIterator():
        merge.append(np.frombuffer(r["sums"]))
        if len(merge) == 256:
            merge = [np.sort(np.array(merge), axis=0).sum(axis=0)]
    return total + np.sort(np.array(merge), axis=0).sum(axis=0) if merge else total


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = LEAST_TAIL) -> float:
    """The prior's estimate from how many positives and unlabelled rows fall to each bin of a score (lowest first).

    Above any score the unlabelled share over the positive share is the prior
    or more, so the least ratio counts, of tails with a share of ``least`` of
    the positives or more. What chance takes from it in small samples makes the
    estimate low rather than high, which rejects too much rather than nothing.
    """
    tail = lambda c: np.cumsum(c[::-1])[::-1] / max(c.sum(), 1)
    p, u = tail(positive), tail(unlabelled)
    keep = p >= least
    return float(np.clip((u[keep] / p[keep]).min(), 0.01, 0.99))


def _bins(outputs: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(((outputs + REACH) / (2 * REACH) * BINS).astype(np.int64), BINS - 1), minlength=BINS).astype(np.float64)


def posterior(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Outputs and the share of good text at them, rising: the prior times the positives' density over the unlabelled rows', pooled where it would fall."""
    at = (np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH
    blocks: list[list[float]] = []
    for x, p, u in zip(at, positive / max(positive.sum(), 1), unlabelled / max(unlabelled.sum(), 1), strict=True):
        if p == 0 and u == 0:
            continue
        blocks.append([p, u, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, u, _, end = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + u, blocks[-1][2], end]
    xs = np.array([x for b in blocks for x in b[2:]])
    ys = np.array([min(prior * p / u, 1.0) if u else 1.0 for p, u, *_ in blocks]).repeat(2)
    return xs, ys


class Pair:
    """Two networks, each fitted to half of the positives and calibrated by the other half; the score is their mean."""

    def __init__(self, models: list[Network], prior: float):
        self.models, self.prior = models, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(sum(m.score(x) for m in self.models) / len(self.models), 9)


def _losses(model: Network):
    """The rows' number, their losses as label 0 and the gradient of these, as sums."""

    def of_rows(x: np.ndarray) -> np.ndarray:
        _, down, _, loss = model.gradients(model.scaled(x))
        return len(x) * np.concatenate([[1.0, loss], *(g.ravel() for g in down)])

    return of_rows


def _binned(models: list[Network]):
    return lambda x: sum(_bins(m.raw(x)) for m in models)


def train(featured: DataFrame, labels: DataFrame, folds: int = FOLDS, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Pair | float:
    """The networks, or a constant score where there is nothing to learn from.

    Of the labels only the rows of label 1 are used; label 0 says no more than
    that there are bad texts.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), folds, 0))
    counts = own.agg(F.count("*").alias("n"), F.sum("quality").alias("good")).first()
    if not counts["n"] or not counts["good"] or counts["good"] == counts["n"]:
        return 1.0 if not counts["n"] or counts["good"] else 0.0
    good = own.filter("quality = 1").select("doc_id").distinct()
    rest = featured.filter(~held_out(F.col("doc_id"), folds, 0))
    p, u = _sampled(featured.join(good, "doc_id", "left_semi"), positives), _sampled(rest, unlabelled)
    if not len(p) or not len(u):
        return 1.0
    width = len(FEATURES)
    sums = _over_all(rest, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]), 2 * width + 1)
    mean = sums[1 : width + 1] / sums[0]
    scale = np.sqrt(np.maximum(sums[width + 1 :] / sums[0] - mean * mean, 0)) + 1e-3

    def new(seed: int) -> Network:
        made = Network(width, seed=seed)
        made.mean, made.scale = mean, scale
        return made

    # the prior is read from positives that a network has not seen, each half in turn: first from networks that tell them from unlabelled text, then from fits with the prior so far
    prior, halves = 1.0, (p[::2], p[1::2] if len(p) > 1 else p)
    for k in range(1 + PRIOR_ROUNDS):
        probes, fresh = [], np.zeros(BINS)
        for i, seen in enumerate(halves):
            probe = new(4 + 2 * k + i)
            if k:
                probe.fit(probe.scaled(seen), probe.scaled(u), prior, steps=1000)
            else:
                probe.fit_apart(probe.scaled(seen), probe.scaled(u), steps=1000)
            fresh += _bins(probe.raw(halves[1 - i]))
            probes.append(probe)
        prior = min(prior, estimated_prior(fresh, _over_all(rest, _binned(probes), BINS)))

    u, models = new(0).scaled(u), []
    for i, own in enumerate(halves):
        model = new(11 + i)
        own = model.scaled(own)
        model.fit(own, u, prior, steps=2000)
        adam, sizes = Adam(model.w, 1e-4), [w.size for w in model.w]
        for _ in range(WHOLE_STEPS):
            found = _over_all(rest, _losses(model), 2 + sum(sizes))
            flat = np.split(found[2:] / found[0], np.cumsum(sizes)[:-1])
            up, down, _, as_zero = model.gradients(own)
            adam.step(risk_gradient(up, down, as_zero, [g.reshape(w.shape) for g, w in zip(flat, model.w, strict=True)], found[1] / found[0], prior), 5e-4)
        models.append(model)
    # each is calibrated by the positives that it has not seen
    for i, model in enumerate(models):
        model.knots = posterior(_bins(model.raw(halves[1 - i])), _over_all(rest, _binned([model]), BINS), prior)
    return Pair(models, prior)


def _scored(model: Pair | float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
                s = model.score(x) if isinstance(model, Pair) else np.full(len(x), model)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def featurize(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_featured), "doc_id long, features array<float>")


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    Null and empty texts are scored like any other. A null id is never held
    out and has no label; repeated rows and labels are allowed (labels that
    are not 0 or 1 are ignored). Other columns are ignored. Without labels of
    both kinds the score is 1 (0 where all labels are 0). An empty table gives
    no rows; a text of any length is read whole, once.
    """
    featured = stored(featurize(docs), "quality")
    model = train(featured, labels, folds)
    return featured.select("doc_id", "features", held_out(F.col("doc_id"), folds, 0).alias("held_out")).mapInArrow(trimmed(_scored(model)), "doc_id long, held_out boolean, score double, predicted int")


def _passing(model: Pair | float):
    """Rows without their last column, the features, that the model doesn't reject."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(batch.num_columns - 1).flatten(), np.float64).reshape(batch.num_rows, -1)
                s = model.score(x) if isinstance(model, Pair) else np.full(len(x), model)
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(s >= THRESHOLD))

    return run


def _with_features(text: int):
    """Rows with the features of the text in column ``text``."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows = np.array([features(t) for t in utf8(part.column(text))], np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "features"])

    return run


def keep_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """The rows of ``docs``, whole, that the classifier doesn't reject; features are computed once and written beside the rows."""
    # flat columns: as one struct, rows with very long texts crashed the JVM on their way to Python
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    featured = stored(rows.mapInArrow(trimmed(_with_features(names.index("text"))), f"{kinds}, features array<float>"), "quality", compression="zstd")
    model = train(featured.select(F.col(f"c{names.index('doc_id')}").cast("long").alias("doc_id"), "features"), labels, folds)
    return featured.mapInArrow(trimmed(_passing(model)), kinds).toDF(*names)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
