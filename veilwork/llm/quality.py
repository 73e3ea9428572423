"""Quality rules: distribution divergence against language references, beside plain repetition rules.

The references are the corpus itself, by language: a histogram of character classes and one of common words, counted
over every document.  A document is rejected when the Jensen-Shannon distance of its histogram to that of its language
is beyond a threshold; short documents are not judged (guards).  Every language has a reference, however small its
share; references stay a table that is joined by language.

Defined results: a null text has no words (``n_words`` 0, so ``base_failed``); a null language is a language of its
own; repeated rows are judged each on its own; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, bounded_batches, byte_runs, fresh, stored, texts

#: Character classes by byte; a lead byte of UTF-8 stands for its character, continuation bytes do not count.
CLASS_BYTES = [
    (range(0x61, 0x7B), "lower"), (range(0x41, 0x5B), "upper"), (range(0x30, 0x3A), "digit"), (b" \t\v\f\r", "blank"),
    (b"\n", "line"), (b".,;:!?'\"-()", "sentence"), (b"#*$%&|<>", "symbol"), (range(0xC0, 0xE0), "two_byte"),
    (range(0xE0, 0xF0), "three_byte"), (range(0xF0, 0x100), "four_byte"),
]
N_CLASSES = len(CLASS_BYTES) + 1  # and the rest of ASCII
SYMBOLS = list(b"#*$%&|<>")
BLANKS = list(b" \t\n\v\f\r")
_CLASS = np.full(256, len(CLASS_BYTES), np.int64)
for _i, (_chars, _) in enumerate(CLASS_BYTES):
    _CLASS[list(_chars)] = _i
_CLASS[0x80:0xC0] = N_CLASSES  # continuation bytes
FLUSH_WORDS = 200_000  # different words a task holds for all languages together
HELD_LANGUAGES = 64  # references a task holds


@dataclass(frozen=True)
class QualityRules:
    """Thresholds.  ``word_share`` bounds a reference to 1/share words."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    guard_chars: int = 200  # fewer characters: classes are not judged
    guard_words: int = 100  # fewer words: common words are not judged
    max_class_distance: float = 0.33
    max_word_distance: float = 0.5
    #: For texts with under half of their language's share of common words, at most this share of the distance of a text
    #: without any, where at least ``guard_common`` common words are to be expected; None for the constant alone.  Labelled
    #: good texts of sf0.1 reach a share of 0.80.
    max_word_share: float | None = 0.85
    guard_common: int = 20
    word_share: float = 1 / 500


def _classes(raw: np.ndarray) -> np.ndarray:
    """256-bin histogram folded to classes."""
    return np.bincount(_CLASS, np.bincount(raw, minlength=256), N_CLASSES + 1)[:N_CLASSES]


def _language(lang: str) -> Column:
    return F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(""))


def references(docs: DataFrame, rules: QualityRules, lang: str, text: str) -> DataFrame:
    """``(lang, classes, n_words, common)`` of each language with a word: character counts by class, and the common words
    with their counts.  Nothing of it is collected."""
    bounded_batches(docs.sparkSession)
    pairs = docs.select(_language(lang).alias("lang"), F.col(f"`{text}`").alias("text"))

    def class_counts(batches):
        for b in batches:
            total: dict[str, np.ndarray] = {}
            langs = b.column(0).to_pylist()
            for first, raw, at in byte_runs(b.column(1)):
                for i in range(len(at) - 1):
                    part = raw[at[i]:at[i + 1]]
                    row = np.append(_classes(part), len(part.tobytes().split()))
                    k = langs[first + i]
                    total[k] = total[k] + row if k in total else row
            yield pa.RecordBatch.from_pydict({"lang": list(total), "n": [x.astype(np.int64).tolist() for x in total.values()]},
                                             pa.schema([("lang", pa.string()), ("n", pa.list_(pa.int64()))]))

    counts = pairs.mapInArrow(class_counts, "lang string, n array<long>")
    by_lang = counts.groupBy("lang").agg(*(F.sum(F.col("n")[i]).alias(f"c{i}") for i in range(N_CLASSES + 1)))
    by_lang = stored(by_lang.filter(F.col(f"c{N_CLASSES}") >= 1).select(
        "lang", F.array(*(f"c{i}" for i in range(N_CLASSES))).alias("classes"), F.col(f"c{N_CLASSES}").alias("n_words")), "languages")

    def word_counts(batches):
        seen: dict[str, Counter] = {}

        def out():
            for k, c in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())],
                    names=["lang", "word", "n"])
            seen.clear()

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), texts(b.column(1))):
                seen.setdefault(k, Counter()).update(x.encode().lower().split())
            if sum(map(len, seen.values())) > FLUSH_WORDS:
                yield from out()
        yield from out()

    common = (
        pairs.mapInArrow(word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        .join(by_lang.select("lang", "n_words"), "lang").filter(F.col("n") >= F.lit(rules.word_share) * F.col("n_words"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("common"))
    )
    return by_lang.join(common, "lang", "left")


def packed(refs: DataFrame) -> DataFrame:
    """``(lang, ref)``: each reference as the bytes of class shares, common words with their places, and their shares
    (the last is all other words)."""

    def make(batches):
        for b in batches:
            out = []
            for r in b.select([1, 2, 3]).to_pylist():
                mine = sorted((bytes(x["word"]), x["n"]) for x in r["common"] or [])
                shares = np.array([n for _, n in mine] + [r["n_words"] - sum(n for _, n in mine)], float)
                classes = np.array(r["classes"], float)
                out.append(pickle.dumps((classes / max(1.0, classes.sum()), {w: i for i, (w, _) in enumerate(mine)}, shares / max(1.0, shares.sum()))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["lang", "ref"])

    return stored(refs.mapInArrow(make, "lang string, ref binary"), "references")


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2) of two distributions: 0 equal, 1 disjoint."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows that occur twice or more."""
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    twice = {g for g, n in Counter(grams).items() if n > 1}
    hit, end = 0, 0
    for i, g in enumerate(grams):
        if g in twice:
            hit += i + window - max(i, end)
            end = i + window
    return hit


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


OUT = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
       ("base_failed", "boolean"), ("class_distance", "double"), ("word_distance", "double"), ("kept", "boolean")]


def judge(text: str, ref, rules: QualityRules) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    chars = int(bins.sum() - bins[0x80:0xC0].sum())
    n_repeat = repeated_words(words, rules.window)
    failed = len(words) < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * len(words)
    far, word_limit = [None, None], rules.max_word_distance
    if ref is not None:
        classes, places, shares = ref
        if chars >= rules.guard_chars:
            mine = np.bincount(_CLASS, bins, N_CLASSES + 1)[:N_CLASSES]
            far[0] = js_distance(mine / mine.sum(), classes)
        if len(words) >= rules.guard_words:
            seen = np.zeros(len(shares))
            for k, n in Counter(map(places.get, raw.lower().split())).items():
                seen[-1 if k is None else k] = n
            far[1] = js_distance(seen / len(words), shares)
            rest = shares[-1]
            few = 1 - seen[-1] / len(words) < (1 - rest) / 2  # chance alone moves the sum of many rare words little
            if rules.max_word_share is not None and few and len(words) * (1 - rest) >= rules.guard_common:
                word_limit = min(word_limit, rules.max_word_share * js_distance(np.array([0.0, 1.0]), np.array([1 - rest, rest])))
    kept = not failed and (far[0] or 0) <= rules.max_class_distance and (far[1] or 0) <= word_limit
    return (len(words), chars - int(bins[BLANKS].sum()), int(bins[SYMBOLS].sum()), repeated_lines(text), n_repeat, failed, *far, kept)


def score(docs: DataFrame, rules: QualityRules = QualityRules(), lang: str = "lang", text: str = "text",
          keep: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """Add the counts, distances and the verdict to each row; with ``only_kept`` drop rejected rows and the new columns."""
    refs = packed(references(docs, rules, lang, text))
    mine, ref = fresh(docs.columns, "lang", "ref")
    joined = docs.join(refs.toDF(mine, ref), _language(lang) == F.col(mine), "left")
    named = [] if only_kept else list(zip(fresh(docs.columns if keep is None else keep, *(n for n, _ in OUT)), (t for _, t in OUT)))
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def make(batches) -> Iterator[list]:
        known: dict[str | None, tuple | None] = {}
        for langs, column, packs in batches:
            rows = []
            for i, (k, x) in enumerate(zip(langs.to_pylist(), texts(column))):
                if k not in known:
                    if len(known) >= HELD_LANGUAGES:
                        known.clear()
                    known[k] = pickle.loads(packs[i].as_py()) if packs[i].is_valid else None
                rows.append(judge(x, known[k], rules))
            if only_kept:
                yield [[r[-1] for r in rows]]
            else:
                yield [pa.array([r[i] for r in rows], arrow[t]) for i, (_, t) in enumerate(OUT)]

    return add_columns(joined, [mine, text, ref], named, make, docs.columns if keep is None else keep, where=only_kept)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows that pass, all columns."""
    return score(docs, rules, only_kept=True)
