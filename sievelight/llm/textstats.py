"""Counts of one text that the quality operators share."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np

#: Frequent words of written English, French, German and Spanish.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split()
    + "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son".split()
    + "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split()
    + "de la que el en y a los se del las un por con no una su para es al lo como o pero sus le ha me si".split()
)
COMMON = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}

#: Character classes, by byte; bytes 128 to 191 continue a character and count nowhere.
CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "exclamation", "quote", "symbol", "punctuation", "wide", "control")


def _class_of_byte() -> np.ndarray:
    kind = np.full(256, CLASSES.index("control"), np.int64)
    for chars, name in (
        (range(33, 127), "punctuation"), (range(97, 123), "lower"), (range(65, 91), "upper"), (range(48, 58), "digit"), (b" \t\r\x0b\x0c", "blank"),
        (b"\n", "newline"), (b".,;:", "stop"), (b"!?", "exclamation"), (b"\"'()-", "quote"), (b"#*$%&|<>", "symbol"), (range(192, 256), "wide"),
    ):
        for c in chars:
            kind[c] = CLASSES.index(name)
    kind[128:192] = len(CLASSES)
    return kind


_KIND = _class_of_byte()
_BLANKS = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_WORD_BYTE = _KIND <= CLASSES.index("control")
_WORD_BYTE[_BLANKS] = False


class TextStats(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int
    n_distinct: int
    top_word: int
    classes: np.ndarray
    common: np.ndarray


def _repeated(words: list[bytes]) -> int:
    """Words within 3-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    n = len(ids) + 1
    # the pair is renumbered first, so the code stays below len(words) * n
    _, pair = np.unique(w[:-1] * n + w[1:], return_inverse=True)
    _, at, count = np.unique(pair[:-1] * n + w[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def plain_words(text: bytes) -> Counter:
    """The words of a text in small ASCII letters, without stops at their ends, and how often each occurs."""
    found: Counter = Counter()
    for w, n in Counter(text.lower().split()).items():
        found[w.rstrip(b".,;:!?")] += n
    return found


def text_stats(text: bytes, common_words: dict[bytes, int] = COMMON) -> TextStats:
    """All counts of a UTF-8 text; an empty one has zeros. ``common`` counts ``common_words`` by their numbers, and last all others."""
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(_KIND, by_byte, minlength=len(CLASSES) + 1)[: len(CLASSES)]
    words = text.split()
    counts = Counter(words)
    common = np.zeros(len(common_words) + 1)
    for w, n in plain_words(text).items():
        common[common_words.get(w, len(common_words))] += n
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return TextStats(len(words), int(by_byte[_WORD_BYTE].sum()), int(classes[CLASSES.index("symbol")]), len(lines), len(lines) - len(set(lines)), _repeated(words), len(counts), max(counts.values(), default=0), classes, common)
