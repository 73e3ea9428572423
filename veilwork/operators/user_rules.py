"""Rules of the user's own: new detector ids, new types with labels, canonical forms, arbiters of families.

A ``RuleSet`` goes wherever ``rules`` is taken, and its ``render`` into ``Policy(renderer=...)``.  A rule is a pattern, any
function from the text column to findings, or a Python function over batches of texts for what no expression can say;
its findings then go through resolution, decisions, numbering and rewriting like all others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.spans import FINDING, FINDINGS, Stages, find_all
from .base_rules import BASE_RULES, HIGH, Rule

FIRST_ORDINAL, RANK = 1000, 500  # after all fixed types and detectors
_HITS = "array<struct<start:int,len:int,canonical:string>>"


class RuleSet(dict[str, Rule]):
    """Rules by detector id, the fixed ones included unless ``base`` is empty."""

    def __init__(self, base: dict[str, Rule] = BASE_RULES):
        super().__init__(base)
        self.labels: dict[str, str] = {}
        self.arbiters: list[tuple[frozenset[str], Callable[[Column], Column]]] = []

    def type(self, pii_type: str, label: str) -> None:
        """A new type; ``label`` stands in its placeholders."""
        if pii_type in dims.TYPE_ORD or pii_type in self.labels:
            raise ValueError(f"{pii_type} is a type already")
        self.labels[pii_type] = label

    def _ordinal(self, pii_type: str) -> int:
        known = dims.TYPE_ORD.get(pii_type)
        return FIRST_ORDINAL + list(self.labels).index(pii_type) if known is None else known

    def _add(self, detector_id: str, pii_type: str, rule: Rule) -> None:
        if detector_id in self or detector_id in dims.DETECTOR_TYPE:
            raise ValueError(f"{detector_id} is a detector already")
        if not re.fullmatch(dims.DETECTOR_ID_PATTERN, detector_id):
            raise ValueError(f"{detector_id} is no detector id")
        if pii_type not in dims.TYPE_ORD and pii_type not in self.labels:
            raise ValueError(f"{pii_type} is no type; name it first")
        self[detector_id] = rule

    def _finding(self, detector_id: str, pii_type: str, risk: int, conf: int, start: Column, length: Column, canonical: Column, surface: Column) -> Column:
        lit = lambda v: F.lit(v)
        return F.struct(start, length, lit(self._ordinal(pii_type)), lit(pii_type), lit(detector_id), canonical, surface, lit(risk), lit(conf),
                        lit(RANK), lit(dims.EV_S), F.lit(None)).cast(FINDING)

    def pattern(self, detector_id: str, pii_type: str, pattern: str, canonical: Callable[[Column], Column] = lambda x: x,
                valid: Callable[[Column], Column] | None = None, risk: int = 2, conf: int = HIGH) -> None:
        """All matches that pass ``valid``; ``canonical`` tells which of them are one value."""
        def rule(t: str, out: str) -> Stages:
            hits = find_all(t, pattern)
            if valid is not None:
                hits = F.filter(hits, lambda m: valid(m["text"]))
            yield {out: F.transform(hits, lambda m: self._finding(
                detector_id, pii_type, risk, conf, m["start"], F.length(m["text"]), canonical(m["text"]), m["text"])).cast(FINDINGS)}

        self._add(detector_id, pii_type, rule)

    def python(self, detector_id: str, pii_type: str, scan: Callable[[str], Iterable[tuple[int, int, str]]], risk: int = 2,
               conf: int = HIGH) -> None:
        """``scan(text)`` gives ``(start, length, canonical)`` of each finding; it runs over Arrow batches of texts."""
        @F.pandas_udf(_HITS)
        def hits(texts: pd.Series) -> pd.Series:
            return texts.map(lambda x: [] if x is None else [{"start": s, "len": n, "canonical": c} for s, n, c in scan(x)])

        def rule(t: str, out: str) -> Stages:
            yield {f"{out}_hits": hits(F.col(t))}
            yield {out: F.transform(f"{out}_hits", lambda m: self._finding(
                detector_id, pii_type, risk, conf, m["start"], m["len"], m["canonical"],
                F.substring(F.col(t), m["start"] + 1, m["len"]))).cast(FINDINGS)}

        self._add(detector_id, pii_type, rule)

    def arbiter(self, family: Iterable[str], choose: Callable[[Column], Column]) -> None:
        """``choose`` takes the findings of a family of detectors in a text and gives those that stay."""
        self.arbiters.append((frozenset(family), choose))

    def render(self, pii_type: Column, number: Column) -> Column:
        """Placeholders of the fixed types and of these."""
        out = dims.alias_token(pii_type, number)
        for name, label in self.labels.items():
            out = F.when(pii_type == name, F.concat(F.lit(f"[{label}"), number.cast("string"), F.lit("]"))).otherwise(out)
        return out
