"""The complete chains: scan, scan with the US pack, redact a corpus, redact conversations, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.base_rules import explode_findings, scan_arrays
from ..operators.decide import (
    Policy,
    assign_aliases_over,
    decide_rows,
    finding_rows,
    redact_rows,
    scan_marked,
    scan_resolved,
    scan_resolved_us,
)
from ..operators.us_rules import RefLists, scan_us_arrays
from .shape import materialize


def scan_findings(docs: DataFrame, rules=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Resolved, context-adjusted finding rows of the base rules."""
    return explode_findings(scan_resolved(docs, rules, text), "findings", key)


def us_candidate_rows(docs: DataFrame, lists: RefLists | None = None, detectors=None, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Unresolved candidates of the base rules and the US pack, from one reading of the text."""
    df = scan_us_arrays(scan_arrays(docs, None, text), detectors, lists, text)
    return explode_findings(
        df.select(*docs.columns, F.concat("candidates", "us_findings").alias("_both")), "_both", key
    )


def scan_findings_us(docs: DataFrame, lists: RefLists | None = None, detectors=None, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Finding rows with the US pack on.  Documents held back, for a tie or for a missing list, are in ``held_back_us``."""
    return explode_findings(scan_resolved_us(docs, lists, detectors, text), "findings", key)


def held_back_us(docs: DataFrame, lists: RefLists | None = None, detectors=None, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Keys of documents whose findings cannot be told apart, or that a detector could not read: they give no finding rows
    and are not clean."""
    return scan_resolved_us(docs, lists, detectors, text).where("ambiguous or not_scanned").select(key)


def decided_conversations(turns: DataFrame, policy: Policy | None = None, rules=None,
                          us: RefLists | None = None) -> DataFrame:
    """Numbered finding rows of conversations: a value keeps its number across all turns of its conversation."""
    policy = policy or Policy()
    rows = finding_rows(scan_marked(turns, rules, us), "conv_id", "turn")
    # numbering reads the rows three times; the texts must be scanned once, and raw surfaces are not written
    return assign_aliases_over(materialize(decide_rows(rows, policy).drop("surface")), "conv_id", "turn", renderer=policy.renderer)


def redact_conversations(turns: DataFrame, policy: Policy | None = None, rules=None,
                         us: RefLists | None = None) -> DataFrame:
    return redact_rows(turns, decided_conversations(turns, policy, rules, us), ["conv_id", "turn"])
