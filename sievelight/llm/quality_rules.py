"""Quality rules: base counts, and distance of a text's distributions from its language.

The corpus itself teaches the references. For each language that enough texts
name, the words that most of its texts hold are its common words, and the mean
distributions of its texts over character classes and over these words are its
references. A text is compared to the language whose common words it fits
best, by Jensen-Shannon distance, and fails where its character classes are
too far, or where it holds hardly any common word; texts too short for a
stable histogram, and texts that name a language without a reference, are left
to the base rules.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.llm.common import batches as arrow_batches
from sievelight.llm.common import stored, table, trimmed, utf8
from sievelight.llm.textstats import CLASSES, plain_words, text_stats

#: Base rules: fewest words; most words in repeated 3-word windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Class distances (base 2) that are always near enough, and as multiples of the language's median; share of the distance of a text without any common word.
CLASS_DISTANCE, CLASS_SPREAD, WORD_PART = 0.19, 8.0, 0.93
#: Words and characters under which the distances are not applied.
GUARD_WORDS, GUARD_CHARS = 50, 200
#: Texts of ``GUARD_WORDS`` words that a language needs to serve as a reference; common words of each, and their bytes at most; bins of a distance.
REFERENCE_TEXTS, COMMON_WORDS, WORD_BYTES, BINS = 30, 48, 16, 1000
#: Words that a task counts before it passes their counts on, and parts in which a language's words are ranked.
COUNTED, PARTS = 200_000, 64


# ---------------------------------------------------------------- common words


def _word_counts(batches):
    """lang, word and the number of texts that hold it, and with a null word the number of texts; a task's part."""
    counts: dict[str, dict] = {}
    held = 0

    def rows():
        for lang, own in counts.items():
            words = list(own)
            for i in range(0, len(words), 1 << 14):
                part = words[i : i + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array([own[w] for w in part], pa.int64())], ["lang", "word", "texts"])

    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            for t, lang in zip(utf8(batch.column(0).slice(i, 1024)), batch.column(1).slice(i, 1024).to_pylist(), strict=True):
                found = plain_words(t)
                if lang is None or sum(found.values()) < GUARD_WORDS:
                    continue
                own = counts.setdefault(lang, {})
                held -= len(own)
                own[None] = own.get(None, 0) + 1
                for w in found:
                    if w and len(w) <= WORD_BYTES:
                        own[w] = own.get(w, 0) + 1
                held += len(own)
            if held > COUNTED:
                yield from rows()
                counts, held = {}, 0
    yield from rows()


def common_words(rows: DataFrame, least: int = REFERENCE_TEXTS, most: int = COMMON_WORDS) -> dict[str, list[bytes]]:
    """The ``most`` words that the most texts hold of each language that ``least`` texts or more name, by all rows of ``rows`` (text, lang)."""
    counts = rows.select("text", "lang").filter("lang IS NOT NULL").mapInArrow(trimmed(_word_counts), "lang string, word binary, texts long").groupBy("lang", "word").agg(F.sum("texts").alias("texts"))
    counts = stored(counts.filter(F.col("word").isNull() | (F.col("texts") > 1)), "words", compression="zstd")
    found: dict[str, list[bytes]] = {r["lang"]: [] for r in counts.filter(F.col("word").isNull() & (F.col("texts") >= least)).select("lang").collect()}
    # a large language's words are ranked in parts first
    best = [F.desc("texts"), F.asc("word")]
    tops = counts.filter(F.col("word").isNotNull() & F.col("lang").isin(*found)).withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        tops = tops.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter(F.col("k") <= most)
    for r in tops.select("lang", "word").orderBy("lang", "k").collect():
        found[r["lang"]].append(bytes(r["word"]))
    return dict(sorted(found.items()))


# ---------------------------------------------------------------- figures


FIGURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang string, classes array<int>, at array<int>, times array<int>"
_FIGURES = {**{c: pa.int64() for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}, "lang": pa.string(), "classes": pa.list_(pa.int32()), "at": pa.list_(pa.int32()), "times": pa.list_(pa.int32())}


def _figures(number: dict[bytes, int]):
    """The counts of each text; of common words only those that it holds, by number."""

    def run(batches):
        for batch in batches:
            ids, langs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i in range(0, batch.num_rows, 1024):
                rows = []
                for d, t, lang in zip(ids[i : i + 1024], utf8(batch.column(1).slice(i, 1024)), langs[i : i + 1024], strict=True):
                    s = text_stats(t, number)
                    at = np.flatnonzero(s.common[:-1])
                    rows.append((d, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, lang, s.classes.astype(np.int32), at.astype(np.int32), s.common[at].astype(np.int32)))
                yield from arrow_batches(_FIGURES, rows)

    return run


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence to base 2) of each row of ``p`` from ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = np.where(p > 0, p * np.log2(p / m), 0).sum(-1), np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


class References(NamedTuple):
    """Languages, the numbers of their common words, their distributions, and their cut-offs."""

    langs: list[str]
    numbers: list[np.ndarray]
    by_class: np.ndarray
    by_word: list[np.ndarray]
    most_class: np.ndarray
    most_word: np.ndarray


class _Batch:
    """A batch of figures as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.n = batch.column(1).to_numpy().astype(np.float64)
        self.classes = batch.column(7).flatten().to_numpy().reshape(len(self.n), len(CLASSES)).astype(np.float64)
        self.at, self.times = batch.column(8).flatten().to_numpy(), batch.column(9).flatten().to_numpy().astype(np.float64)
        self.row = np.repeat(np.arange(len(self.n)), pc.list_value_length(batch.column(8)).to_numpy())

    def words(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of these common words, and last of all others, in each row."""
        place = np.full(max(int(self.at.max(initial=0)), int(numbers.max(initial=0))) + 1, -1)
        place[numbers] = np.arange(len(numbers))
        own = place[self.at]
        here, width = own >= 0, len(numbers) + 1
        out = np.bincount(self.row[here] * width + own[here], self.times[here], minlength=len(self.n) * width).reshape(len(self.n), width)
        out[:, -1] = self.n - out[:, :-1].sum(axis=1)
        return out

    def fitted(self, refs: References) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language that each row fits best, and its word and class distances from it."""
        far = np.stack([js_distance(_shares(self.words(k)), q) for k, q in zip(refs.numbers, refs.by_word, strict=True)], axis=1)
        best = far.argmin(axis=1)
        return best, far[np.arange(len(best)), best], js_distance(_shares(self.classes), refs.by_class[best])


def _added(langs: list[str], numbers: list[np.ndarray], refs: References | None):
    """Sums of a task's shares, in whole millionths so that their order plays no part: one row a language.

    With ``refs`` only texts within the language's median class distance count.
    """
    index = {k: i for i, k in enumerate(langs)}

    def run(batches):
        sums = [np.zeros(1 + len(CLASSES) + len(k) + 1, np.int64) for k in numbers]
        for batch in batches:
            if not batch.num_rows:
                continue
            b = _Batch(batch)
            own = np.array([index.get(k, -1) for k in batch.column(6).to_pylist()])
            own[b.n < GUARD_WORDS] = -1
            if refs is not None:
                best, _, char = b.fitted(refs)
                own[char > refs.most_class[best]] = -1
            for i in np.unique(own[own >= 0]):
                here = own == i
                shares = np.concatenate([_shares(b.classes[here]), _shares(b.words(numbers[i])[here])], axis=1)
                sums[i][0] += here.sum()
                sums[i][1:] += np.round(1e6 * shares).astype(np.int64).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([s.tolist() for s in sums], pa.list_(pa.int64()))], ["lang", "sums"])

    return run


def _far(refs: References):
    """A histogram of class distances from the best language for each language: a task's part."""

    def run(batches):
        counts = np.zeros((len(refs.langs), BINS), np.int64)
        for batch in batches:
            if batch.num_rows:
                b = _Batch(batch)
                best, _, char = b.fitted(refs)
                long = b.n >= GUARD_WORDS
                np.add.at(counts, (best[long], np.minimum((char[long] * BINS).astype(int), BINS - 1)), 1)
        yield pa.RecordBatch.from_arrays([pa.array(refs.langs, pa.string()), pa.array(counts.tolist(), pa.list_(pa.int64()))], ["lang", "sums"])

    return run


def _by_language(parts: DataFrame) -> dict[str, np.ndarray]:
    """The tasks' rows (lang, sums), added by place on executors: as many numbers as languages have places reach the driver."""
    found: dict[str, dict[int, int]] = {}
    for r in parts.select("lang", F.posexplode("sums").alias("k", "n")).filter("n <> 0").groupBy("lang", "k").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r["lang"], {})[r["k"]] = r["n"]
    return {lang: np.array([own.get(k, 0) for k in range(max(own) + 1)], np.float64) for lang, own in found.items()}


def references(figures: DataFrame, words: dict[str, list[bytes]], number: dict[bytes, int]) -> References:
    """The languages' references, from the half of each language's texts nearest to a first reference over all of them, so that junk doesn't shape them."""
    langs, numbers = list(words), [np.array([number[w] for w in own], np.int64) for own in words.values()]
    part = "lang string, sums array<long>"
    nothing = References([], [], np.zeros((0, len(CLASSES))), [], np.zeros(0), np.zeros(0))

    def made(sums: dict[str, np.ndarray], before: References | None = None) -> References:
        by_class, by_word = [], []
        for i, (lang, k) in enumerate(zip(langs, numbers, strict=True)):
            own = np.zeros(1 + len(CLASSES) + len(k) + 1)
            got = sums.get(lang, own[:0])
            own[: len(got)] = got
            if before is not None and not own[0]:
                by_class.append(before.by_class[i])
                by_word.append(before.by_word[i])
                continue
            by_class.append(_shares(own[1 : 1 + len(CLASSES)]))
            by_word.append(_shares(own[1 + len(CLASSES) :]))
        none = [float(js_distance(np.eye(len(q))[-1:], q)[0]) for q in by_word]
        return References(langs, numbers, np.array(by_class), by_word, np.full(len(langs), np.inf), WORD_PART * np.array(none))

    def medians(refs: References) -> np.ndarray:
        found, out = _by_language(figures.mapInArrow(trimmed(_far(refs)), part)), []
        for lang in langs:
            total = np.cumsum(found.get(lang, np.zeros(1)))
            out.append((int(np.searchsorted(total, total[-1] / 2)) + 1) / BINS)
        return np.array(out)

    if not langs:
        return nothing
    first = made(_by_language(figures.mapInArrow(trimmed(_added(langs, numbers, None)), part)))
    first = first._replace(most_class=medians(first))
    final = made(_by_language(figures.mapInArrow(trimmed(_added(langs, numbers, first)), part)), first)
    return final._replace(most_class=np.maximum(CLASS_DISTANCE, CLASS_SPREAD * medians(final)))


VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, language string, class_distance double, word_distance double"


def _judged(refs: References):
    langs = refs.langs

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            b, repeated = _Batch(batch), batch.column(5).to_numpy()
            failed = (b.n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * b.n)
            if langs:
                best, word, char = b.fitted(refs)
                most_word, most_char = refs.most_word[best], refs.most_class[best]
            else:
                best, word, char = np.zeros(len(b.n), int), np.zeros(len(b.n)), np.zeros(len(b.n))
                most_word, most_char = np.ones(len(b.n)), np.ones(len(b.n))
            # a text is not held against other languages where its own has no reference
            own = batch.column(6)
            met = pc.or_(pc.is_null(own), pc.is_in(own, value_set=pa.array(langs, own.type))).to_numpy(zero_copy_only=False)
            word, char = np.where(met, word, 0), np.where(met, char, 0)
            odd = ((word > most_word) & (b.n >= GUARD_WORDS)) | ((char > most_char) & (b.classes.sum(axis=1) >= GUARD_CHARS))
            names = [x.split()[0] for x in VERDICT.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(failed), pa.array(~failed & ~odd), pa.array([langs[i] if langs and m else None for i, m in zip(best, met, strict=True)], pa.string()), pa.array(char), pa.array(word)], names)

    return run


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts and verdict for every row of ``docs`` (doc_id, text, lang).

    A null text has no words and fails the base rules; a null language
    doesn't matter, because a text is compared to the reference that it fits
    best. A text that names a language with fewer than ``REFERENCE_TEXTS``
    texts is left to the base rules, without a language or distances. Ids may
    be null or repeat; repeated rows count as often as they stand there; other
    columns are ignored. Where no text names its language there is no
    reference, and the base rules decide. An empty table gives no rows. A text
    is held whole, with its words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    words = common_words(rows)
    number = {w: i for i, w in enumerate(sorted({w for own in words.values() for w in own}))}
    figures = stored(rows.mapInArrow(trimmed(_figures(number)), FIGURES), "rules")
    return figures.mapInArrow(trimmed(_judged(references(figures, words, number))), VERDICT)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
