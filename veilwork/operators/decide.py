"""Decisions per finding: trust lists, policy, placeholders and the rewritten text.

Lists are ordinary tables ``(pii_type, value)`` of any size and are joined to finding rows.  A policy
without lists needs no join and stays inside the row.

A text is rewritten only when that is safe: every protected value has a placeholder and the spans are
disjoint and inside the text.  Otherwise the text stays as it is, with status ``error``.  A text whose
findings cannot be told apart (US pack) stays as it is, with status ``ambiguous``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.checks import evidence_code  # noqa: F401  (part of the public surface)
from ..functions.spans import (
    FINDING,
    FINDINGS,
    Stages,
    ascending,
    empty,
    end_of,
    fence,
    let,
    memo,
    remembered,
    rewrite,
    run_stages,
    running_max,
    running_sum,
)
from ..functions.text import text_sha256
from ..plans.shape import materialize
from .base_rules import scan_arrays
from .resolve import FINDING_COLS, adjust_context, resolve_candidates_in_row, resolve_overlaps_in_row
from .us_rules import RefLists, scan_us_arrays

# Category switches; every other type is always on.
CATEGORIES = {"Phone": "phone", "Email": "email", "Name": "name", "Address": "address"}
ALL_ON = {"name": True, "phone": True, "email": True, "address": True, "company": True}

PROTECT, ASK, BYPASS = "Protect", "NeedsDecision", "Bypass"


@dataclass
class Policy:
    """Lists and switches of one scan.  A missing list is an empty one."""

    trusted: DataFrame | None = None
    exceptions: DataFrame | None = None
    user_exceptions: DataFrame | None = None
    settings: dict[str, bool] = field(default_factory=lambda: dict(ALL_ON))
    renderer: Callable[[Column, Column], Column] = dims.alias_token  # type and number to a placeholder

    def has_lists(self) -> bool:
        return any(df is not None for df in (self.trusted, self.exceptions, self.user_exceptions))


# --- single expressions ----------------------------------------------------------------------


def decide(risk: Column, conf: Column, trusted: Column) -> Column:
    return (
        F.when(risk == 3, ASK)
        .when(trusted, BYPASS)
        .when(risk == 2, PROTECT)
        .when(conf == 3, PROTECT)
        .when(conf == 2, ASK)
        .otherwise(BYPASS)
    )


def apply_category_settings(pii_type: Column, risk: Column, disposition: Column, settings: dict[str, bool]) -> Column:
    off = [t for t, name in CATEGORIES.items() if not settings.get(name, True)]
    if not off:
        return disposition
    asked = (disposition == ASK) & (risk == 1) & pii_type.isin("Name", "Address")
    return F.when(pii_type.isin(off) & ((disposition == PROTECT) | asked), BYPASS).otherwise(disposition)


def apply_user_exception(disposition: Column, listed: Column) -> Column:
    return F.when((disposition == PROTECT) & listed, BYPASS).otherwise(disposition)


def strictness(disposition: Column) -> Column:
    return F.when(disposition == PROTECT, 2).when(disposition == ASK, 1).otherwise(0)


def doc_status(n_candidates: Column, n_protect: Column, n_pending: Column) -> Column:
    return (
        F.when(n_candidates == 0, "no_findings")
        .when(n_pending > 0, "needs_decision")
        .when(n_protect == n_candidates, "protected")
        .when(n_protect > 0, "partly_kept")
        .otherwise("kept")
    )


# --- row form --------------------------------------------------------------------------------


def _flags(findings: DataFrame, lists: dict[str, DataFrame | None]) -> DataFrame:
    """Add one boolean per list: whether it holds the row's (type, value).

    All lists meet the findings in one join.  It is a sorted one: a list may hold many times more entries than the planner
    expects from its files, and must not be built whole in the driver or in a task.
    """
    given = {name: df for name, df in lists.items() if df is not None}
    flags = lambda of: [F.coalesce(of(name), F.lit(False)).alias(name) for name in lists]
    if not given:
        return findings.select("*", *flags(lambda name: F.lit(False)))
    entries = None
    for name, df in given.items():
        one = df.select("pii_type", F.col("value").alias("canonical"), *[F.lit(n == name).alias(n) for n in given])
        entries = one if entries is None else entries.unionByName(one)
    listed = entries.groupBy("pii_type", "canonical").agg(*[F.max(name).alias(name) for name in given])
    joined = findings.join(listed.hint("merge"), ["pii_type", "canonical"], "left")
    return joined.select(
        *[F.col(c) for c in joined.columns if c not in lists], *flags(lambda name: F.col(name) if name in given else F.lit(False)))


def _trust(flagged: DataFrame) -> DataFrame:
    flag = F.when(F.col("risk") == 1, F.col("_e")).when(F.col("risk") == 2, F.col("_t")).otherwise(F.lit(False))
    return flagged.withColumn("trusted", flag).drop("_t", "_e")


def trust_match(findings: DataFrame, trusted: DataFrame | None, exceptions: DataFrame | None) -> DataFrame:
    """Add ``trusted``: risk 1 against the exceptions, risk 2 against the trusted list, risk 3 never."""
    return _trust(_flags(findings, {"_t": trusted, "_e": exceptions}))


def _except(flagged: DataFrame) -> DataFrame:
    return flagged.withColumn("disposition", apply_user_exception(F.col("disposition"), F.col("_u"))).drop("_u")


def user_exception_match(decided: DataFrame, user_exceptions: DataFrame | None) -> DataFrame:
    """Protect becomes Bypass on an exact (type, value) entry; nothing else changes."""
    return _except(_flags(decided, {"_u": user_exceptions}))


def decide_rows(findings: DataFrame, policy: Policy) -> DataFrame:
    """``trust_match``, the decision, the category settings and ``user_exception_match``, with one join for all lists."""
    c = F.col
    df = _trust(_flags(findings, {"_t": policy.trusted, "_e": policy.exceptions, "_u": policy.user_exceptions}))
    df = df.withColumn("disposition", decide(c("risk"), c("conf"), c("trusted")))
    df = df.withColumn(
        "disposition", apply_category_settings(c("pii_type"), c("risk"), c("disposition"), policy.settings)
    )
    return _except(df)


def assign_aliases(decided: DataFrame, scope: str = "doc_id", renderer: Callable[[Column, Column], Column] = dims.alias_token) -> DataFrame:
    """Number distinct protected values per type by first appearance; repeats share the number.

    For a scope that is one document.  A scope of many rows goes through ``assign_aliases_over``.
    """
    named = (F.col("disposition") == PROTECT) & F.col("canonical").isNotNull()
    place = F.when(named, F.struct("start", "len", "type_ord", "detector_id"))
    first = F.min(place).over(Window.partitionBy(scope, "pii_type", "canonical"))
    rank = F.dense_rank().over(Window.partitionBy(scope, "pii_type").orderBy(F.col("_first").asc_nulls_last()))
    return (
        decided.withColumn("_first", first)
        .withColumn("alias_no", F.when(named, rank))
        .withColumn("alias", renderer(F.col("pii_type"), F.col("alias_no")))
        .drop("_first")
    )


def assign_aliases_over(decided: DataFrame, scope: str, position: str, width: int = 1024,
                        renderer: Callable[[Column, Column], Column] = dims.alias_token) -> DataFrame:
    """``assign_aliases`` for a scope of any number of rows, such as a conversation.

    ``position`` orders the rows of a scope (whole numbers).  Distinct values are found by a
    pre-aggregated group-by; their numbering is a two-step rank, within stretches of ``width``
    positions and then by the counts of earlier stretches, so that no task holds a whole scope.
    The final join repeats values on one side only; a hot value is split by adaptive skew handling.
    """
    named = (F.col("disposition") == PROTECT) & F.col("canonical").isNotNull()
    firsts = (
        decided.where(named)
        .groupBy(scope, "pii_type", "canonical")
        .agg(F.min(F.struct(position, "start", "len", "type_ord", "detector_id")).alias("first"))
        .withColumn("_part", F.floor(F.col(f"first.{position}") / width))
    )
    inside = firsts.withColumn(
        "_n", F.row_number().over(Window.partitionBy(scope, "pii_type", "_part").orderBy("first"))
    )
    before = Window.partitionBy(scope, "pii_type").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        firsts.groupBy(scope, "pii_type", "_part")
        .agg(F.count("*").alias("_c"))
        .withColumn("_offset", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .drop("_c")
    )
    numbers = inside.join(offsets, [scope, "pii_type", "_part"]).select(
        scope, "pii_type", "canonical", (F.col("_n") + F.col("_offset")).cast("int").alias("_number")
    )
    out = decided.join(numbers, [scope, "pii_type", "canonical"], "left")
    return (
        out.withColumn("alias_no", F.when(named, F.col("_number")))
        .withColumn("alias", renderer(F.col("pii_type"), F.col("alias_no")))
        .drop("_number")
    )


def disposition_counts(decided: DataFrame, *keys: str) -> DataFrame:
    n = lambda cond: F.count_if(cond).cast("int")
    d = F.col("disposition")
    return decided.groupBy(*keys).agg(
        F.count("*").cast("int").alias("n_candidates"),
        n(F.col("trusted")).alias("n_trusted"),
        n(d == PROTECT).alias("n_protect"),
        n(d == ASK).alias("n_pending"),
        n(d == BYPASS).alias("n_bypass"),
    )


def decision_items(decided: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct (type, value, risk, detector) that wait for a decision, with the first place they occur."""
    return (
        decided.where((F.col("disposition") == ASK) & F.col("canonical").isNotNull())
        .groupBy(key, "pii_type", "canonical", "risk", "detector_id")
        .agg(F.min("start").alias("first_start"), F.count("*").cast("int").alias("n"))
    )


def strictest_disposition(decided: DataFrame, key: str = "doc_id") -> DataFrame:
    return (
        decided.where(F.col("canonical").isNotNull())
        .groupBy(key, "pii_type", "canonical", "risk", "detector_id")
        .agg(F.max_by("disposition", strictness(F.col("disposition"))).alias("disposition"))
    )


def safe_edits(text: Column, edits: Column, n_protect: Column) -> Column:
    """Whether sorted edits may be applied: one for each protected finding, all with a token, disjoint, inside the text."""
    inside = F.forall(
        edits,
        lambda e: e["token"].isNotNull() & (e["start"] >= 0) & (e["len"] > 0) & (end_of(e) <= F.length(text)),
    )
    apart = F.forall(
        F.transform(edits, lambda e, i: (i == 0) | (end_of(F.get(edits, i - 1)) <= e["start"])), lambda ok: ok
    )
    return F.coalesce((F.size(edits) == n_protect) & inside & apart, F.lit(False))


def redact_rows(docs: DataFrame, numbered: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rewrite texts from numbered finding rows.  Documents without findings pass through.

    Only the edits travel to the join; the texts are shuffled on the document key once.  Rows may carry
    ``ambiguous`` and ``not_scanned`` (see ``finding_rows``).
    """
    c = F.col
    edit = F.struct("start", "len", c("alias").alias("token"))
    mark = lambda name: c(name) if name in numbered.columns else F.lit(False)
    per_doc = (
        numbered.groupBy(*keys)
        .agg(
            F.array_sort(F.collect_list(F.when(c("disposition") == PROTECT, edit))).alias("_edits"),
            F.count("start").cast("int").alias("n_candidates"),
            F.count_if(c("disposition") == PROTECT).cast("int").alias("n_protect"),
            F.count_if(c("disposition") == ASK).cast("int").alias("n_pending"),
            F.max(mark("ambiguous")).alias("_tied"),
            F.max(mark("not_scanned")).alias("_unread"),
        )
    )
    counts = ["n_candidates", "n_protect", "n_pending"]
    joined = docs.join(per_doc, keys, "left").fillna(0, counts).fillna(False, ["_tied", "_unread"])
    due = (c("n_protect") > 0) & (c("n_pending") == 0)
    safe = safe_edits(c(text), c("_edits"), c("n_protect"))
    return (
        joined.withColumn("redacted", F.when(due & safe, rewrite(c(text), c("_edits"))).otherwise(c(text)))
        .withColumn("status", _status(c("_unread"), c("_tied"), due & ~safe, *[c(n) for n in counts]))
        .drop("_edits", "_tied", "_unread")
    )


def _status(unread: Column, ambiguous: Column, unsafe: Column, *counts: Column) -> Column:
    return F.when(unread, "not_scanned").when(ambiguous, "ambiguous").when(unsafe, "error").otherwise(doc_status(*counts))


# --- in-row form -----------------------------------------------------------------------------

DECIDED = FINDING[:-1] + ",trusted:boolean,disposition:string>"


def decide_in_row(findings: Column, settings: dict[str, bool]) -> Column:
    """Decisions inside the row, for a policy without lists."""

    def one(f: Column) -> Column:
        chosen = decide(f["risk"], f["conf"], F.lit(False))
        final = apply_category_settings(f["pii_type"], f["risk"], chosen, settings)
        return F.struct(*[f[c] for c in FINDING_COLS], F.lit(False), final).cast(DECIDED)

    return F.transform(findings, one)


def number_in_row(out: str, decided: str, renderer: Callable[[Column, Column], Column] = dims.alias_token) -> Stages:
    """Edits with placeholders for the protected findings of one document, sorted by start.

    Sorting by value finds each value's first place; sorting by first place numbers the values.
    Both steps use prefix scans, so nothing is quadratic in the number of findings.
    """
    v, h, hm, p, w, c, b, bm = (f"{out}_{k}" for k in ("v", "h", "hm", "p", "w", "c", "b", "bm"))
    protect = F.filter(decided, lambda f: (f["disposition"] == PROTECT) & f["canonical"].isNotNull())
    by_value = "struct<type_ord:int,canonical:string,start:int,len:int,pii_type:string>"
    by_first = "struct<type_ord:int,first:int,start:int,len:int,pii_type:string>"

    def same(arr: str, i: Column, x: Column, *fields: str) -> Column:
        """Whether the item before agrees with this one on the fields."""
        prev = F.get(F.col(arr), i - 1)
        out_ = i > 0
        for f in fields:
            out_ = out_ & (prev[f] == x[f])
        return F.coalesce(out_, F.lit(False))

    yield {
        v: ascending(
            F.transform(
                protect, lambda f: F.struct(f["type_ord"], f["canonical"], f["start"], f["len"], f["pii_type"]).cast(by_value)
            )
        )
    }
    yield {h: F.transform(v, lambda x, i: F.when(same(v, i, x, "type_ord", "canonical"), F.lit(-1)).otherwise(i))}
    yield {hm: running_max(F.col(h))}
    yield {
        p: let(F.col(hm), lambda heads: ascending(
            F.transform(
                v,
                lambda x, i: F.struct(
                    x["type_ord"],
                    F.get(F.col(v), F.greatest(F.get(heads, i), F.get(F.col(h), i)))["start"],
                    x["start"], x["len"], x["pii_type"],
                ).cast(by_first),
            )
        ))
    }
    # w marks the first finding of each value, c counts values so far, b the count where the type starts
    yield {w: F.transform(p, lambda x, i: F.when(same(p, i, x, "type_ord", "first"), 0).otherwise(1))}
    yield {c: running_sum(F.col(w))}
    yield {b: F.transform(p, lambda x, i: F.when(same(p, i, x, "type_ord"), -1).otherwise(F.get(F.col(c), i)))}
    yield {bm: running_max(F.col(b))}
    at = lambda name, i: F.get(F.col(name), i)
    yield {
        out: let(F.col(bm), lambda bases: ascending(
            F.transform(
                p,
                lambda x, i: F.struct(
                    x["start"].alias("start"),
                    x["len"].alias("len"),
                    renderer(
                        x["pii_type"], at(c, i) + at(w, i) - F.greatest(F.get(bases, i), at(b, i))
                    ).alias("token"),
                ),
            )
        ))
    }


def _resolved_stages(text: str, candidates: str, out: str) -> Stages:
    yield from resolve_overlaps_in_row(f"{out}_w", F.col(candidates))
    yield from adjust_context(out, text, f"{out}_w")


def scan_resolved(docs: DataFrame, rules=None, text: str = "text", out: str = "findings") -> DataFrame:
    """Add the resolved, context-adjusted findings of the base rules as an array column (no shuffle)."""
    df = scan_arrays(docs, rules, text, "_cand")
    stages = remembered(lambda: _resolved_stages(text, "_cand", out), "resolved", text, out)
    return fence(run_stages(df, [stages], docs.columns, [out]), docs.columns, [out])


# columns of a text's tenant: whether the US pack is on for it, and which of the pack's detectors are not ready
US_ON, US_MISSING = "_us_on", "_us_missing"
MOST_SENT = 20_000  # tenants up to which their rules are sent to every task
SALTS = 256  # parts that a tenant's texts are dealt into for a join


def scan_resolved_us(docs: DataFrame, lists: RefLists | None = None, detectors=None, text: str = "text",
                     rules=None) -> DataFrame:
    """Add ``findings``, ``ambiguous`` and ``not_scanned`` with the US pack on, all inside the row.

    A document with an unresolvable tie has no findings and is marked ambiguous; one that a detector of the pack should
    have read but could not is marked as not scanned.  Callers hold both back.  With the columns of ``tenant_masks``
    each row is scanned by the rules of its tenant, in the same pass.
    """
    keep = docs.columns
    lists = lists or RefLists()
    on = F.coalesce(F.col(US_ON), F.lit(False)) if US_ON in keep else F.lit(True)
    missing = F.lit(bool(lists.not_ready() & set(detectors or lists.not_ready())))
    if US_MISSING in keep:
        missing = missing | (F.coalesce(F.size(US_MISSING), F.lit(0)) > 0)
    df, read = scan_arrays(docs, rules, text), text
    if US_ON in keep or US_MISSING in keep:
        read = "_us_text"
        df = df.withColumn(read, F.when(on & ~missing, F.col(text)))
    df = scan_us_arrays(df, detectors, lists, read)
    unread = on & missing
    both = F.when(unread, empty(FINDINGS)).when(on, F.concat("candidates", "us_findings")).otherwise(F.col("candidates"))
    df = df.select(*keep, unread.alias("not_scanned"), both.alias("_both"))
    resolved = remembered(lambda: resolve_candidates_in_row("_w", F.col("_both")), "us_resolved")
    df = run_stages(df, [resolved], [*keep, "not_scanned"], ["_w"])
    # a null text has no candidates and is not a tie
    tied = F.col("_w").isNull() & F.col(text).isNotNull()
    df = df.select(*keep, "not_scanned", tied.alias("ambiguous"), F.coalesce("_w", empty(FINDINGS)).alias("_w"))
    context = remembered(lambda: adjust_context("findings", text, "_w"), "us_context", text)
    marks = ["not_scanned", "ambiguous"]
    df = run_stages(df, [context], [*keep, *marks], ["findings"])
    return fence(df, keep, [*marks, "findings"])


def scan_marked(docs: DataFrame, rules=None, us: RefLists | None = None, text: str = "text") -> DataFrame:
    """Add ``findings``, ``ambiguous`` and ``not_scanned``: the base rules, and the US pack when its lists are given."""
    if us is None:
        return scan_resolved(docs, rules, text).withColumns({"ambiguous": F.lit(False), "not_scanned": F.lit(False)})
    return scan_resolved_us(docs, us, None, text, rules)


def finding_rows(scanned: DataFrame, *keys: str) -> DataFrame:
    """Finding rows of ``scan_marked``; a document that is held back gives one row without a finding, so that it is not lost."""
    rows = scanned.select(*keys, "ambiguous", "not_scanned", F.inline_outer("findings"))
    return rows.where(F.col("start").isNotNull() | F.col("ambiguous") | F.col("not_scanned"))


def redact_in_row(docs: DataFrame, settings: dict[str, bool] | None = None, rules=None, text: str = "text",
                  us: RefLists | None = None, renderer: Callable[[Column, Column], Column] = dims.alias_token) -> DataFrame:
    """Scan, decide and rewrite in one narrow pass over the texts, for a policy without lists."""
    keep = docs.columns
    scanned = scan_marked(docs, rules, us, text).withColumnsRenamed({"findings": "_f", "ambiguous": "_tied", "not_scanned": "_unread"})
    df = scanned.select(*keep, "_tied", "_unread", decide_in_row(F.col("_f"), settings or ALL_ON).alias("findings"))
    n = lambda cond: F.size(F.filter("findings", cond))
    df = df.select(
        "*",
        F.size("findings").alias("n_candidates"),
        n(lambda f: f["disposition"] == PROTECT).alias("n_protect"),
        n(lambda f: f["disposition"] == ASK).alias("n_pending"),
    )
    due = (F.col("n_protect") > 0) & (F.col("n_pending") == 0)
    cols = df.columns
    df = df.select("*", F.when(due, F.col("findings")).otherwise(F.slice("findings", 1, 0)).alias("_fired"))
    df = run_stages(df, [remembered(lambda: number_in_row("_edits", "_fired", renderer), "numbers", renderer)], cols, ["_edits"])
    df = df.select("*", (due & safe_edits(F.col(text), F.col("_edits"), F.col("n_protect"))).alias("_fire"))
    new_text = memo(lambda: rewrite(F.col(text), F.col("_edits")), "rewrite", text)
    computed = [c for c in cols if c not in keep and c not in ("_tied", "_unread")]
    counts = [F.col(c) for c in ("n_candidates", "n_protect", "n_pending")]
    df = df.select(
        *[c for c in cols if c not in ("_tied", "_unread")],
        F.when(F.col("_fire"), new_text).otherwise(F.col(text)).alias("redacted"),
        _status(F.col("_unread"), F.col("_tied"), due & ~F.col("_fire"), *counts).alias("status"),
    )
    return fence(df, keep, [*computed, "redacted", "status"])


def redact_corpus(docs: DataFrame, policy: Policy | None = None, rules=None, key: str = "doc_id",
                  text: str = "text", us: RefLists | None = None) -> DataFrame:
    """Redact a corpus; ``us`` turns the US pack on.

    Without lists the whole chain stays in the row; lists of any size are joined to finding rows.
    """
    policy = policy or Policy()
    cols = docs.columns + ["redacted", "n_candidates", "n_protect", "n_pending", "status"]
    if not policy.has_lists():
        return redact_in_row(docs, policy.settings, rules, text, us, policy.renderer).select(*cols)
    rows = finding_rows(scan_marked(docs, rules, us, text), key)
    numbered = assign_aliases(decide_rows(rows, policy), key, policy.renderer)
    return redact_rows(docs, numbered, [key], text).select(*cols)


def tenant_masks(gates: DataFrame, readiness: DataFrame) -> DataFrame:
    """``(tenant, _us_on, _us_missing)`` from ``gates(tenant, gate, in_scope)`` and ``readiness(scope, detector_id, state)``.

    A gate that is unavailable does not switch the pack off, it leaves its texts unread.
    """
    missing = readiness.where("state <> 'Ready'").groupBy(F.col("scope").alias("tenant")).agg(F.collect_set("detector_id").alias(US_MISSING))
    shut = F.when(F.col("gate") == "Unavailable", F.array(F.lit("gate")))
    return gates.join(missing, "tenant", "left").select(
        "tenant", (F.col("in_scope") | (F.col("gate") == "Unavailable")).alias(US_ON),
        F.coalesce(shut, US_MISSING, F.array().cast("array<string>")).alias(US_MISSING))


def redact_tenants(docs: DataFrame, masks: DataFrame, policy: Policy | None = None, rules=None, key: str = "doc_id",
                   text: str = "text", us: RefLists | None = None) -> DataFrame:
    """Redact the texts of many tenants in one pass, each by its own rules.

    A tenant with the pack off, or without a row in ``masks``, gets the base rules; one whose required lists are missing
    or invalid gets ``not_scanned`` and unchanged texts, never a clean result.

    The texts stay where they are; for very many tenants they are dealt by tenant and salt.  By the tenant alone, a few
    tasks would scan them all.
    """
    masks = materialize(masks.select("tenant", US_ON, US_MISSING))  # its joins would plan the scan anew, each as it ends
    if masks.limit(MOST_SENT + 1).count() <= MOST_SENT:
        masked = docs.join(F.broadcast(masks), "tenant", "left")
    else:
        salted = masks.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        dealt = docs.withColumn("_salt", F.monotonically_increasing_id() % SALTS)
        masked = dealt.join(salted.hint("merge"), ["tenant", "_salt"], "left").drop("_salt")
    return redact_corpus(masked, policy, rules, key, text, us or RefLists()).drop(US_ON, US_MISSING)


def protect_all(decided: DataFrame) -> DataFrame:
    """Every pending item becomes protected."""
    d = F.col("disposition")
    return decided.withColumn("disposition", F.when(d == ASK, PROTECT).otherwise(d))


def item_key() -> list[str]:
    return ["pii_type", "canonical", "risk", "detector_id"]


def resolve_decisions(docs: DataFrame, decided: DataFrame, decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlay reviewer choices and release only texts in which every pending item is settled.

    ``decisions(doc_id, text_sha256, pii_type, canonical, risk, detector_id, choice, n_confirm)``.
    A choice made for another version of the text is ignored; keeping a risk-3 value takes two
    confirmations.
    """
    current = docs.select(key, text_sha256(F.col("text")).alias("text_sha256"))
    settled = (
        (F.col("choice") == "protect")
        | ((F.col("choice") == "keep") & ((F.col("risk") < 3) | (F.col("n_confirm") >= 2)))
    )
    choices = (
        decisions.join(current, [key, "text_sha256"])
        .where(settled)
        .groupBy(key, *item_key())
        # protect wins when both were chosen
        .agg(F.max("choice").alias("choice"))
    )
    overlaid = decided.join(choices, [key, *item_key()], "left")
    pending = F.col("disposition") == ASK
    new = (
        F.when(pending & (F.col("choice") == "protect"), PROTECT)
        .when(pending & (F.col("choice") == "keep"), BYPASS)
        .otherwise(F.col("disposition"))
    )
    return overlaid.withColumn("disposition", new).drop("choice")


# --- release after review --------------------------------------------------------------------


def release_decisions(docs: DataFrame, decided: DataFrame, decisions: DataFrame, key: str = "doc_id",
                      renderer: Callable[[Column, Column], Column] = dims.alias_token) -> DataFrame:
    """Settle reviewed texts: ``(key, redacted, text_sha256, n_protect, n_pending, n_kept, status)`` of each text with an item to decide.

    A text is released as a whole or not at all.  ``waiting``: an item is not settled, or was settled for another version
    of the text.  ``stale``: a choice of this very version names an item that does not wait for one; the review saw other
    findings.  Else every protected value, chosen or not, is numbered anew over the whole text and replaced:
    ``released``, or ``released_partly`` if the reviewer kept an item; ``kept`` if nothing is protected and the text stays.
    ``ambiguous`` and ``error`` as in ``redact_rows``.  ``text_sha256`` is that of the resulting text.

    Only texts with such an item meet their edits; the others are not read again.
    """
    c = F.col
    items = decision_items(decided, key)
    current = docs.select(key, text_sha256(c("text")).alias("text_sha256")).join(items.select(key).distinct(), key, "left_semi")
    known = items.select(key, *item_key()).withColumn("_known", F.lit(True))
    stray = decisions.join(current, [key, "text_sha256"]).join(known, [key, *item_key()], "left").where("_known is null")
    stray = stray.select(key).distinct().withColumn("_stray", F.lit(True))
    wait = docs.join(items.select(key).distinct(), key, "left_semi")
    mine = decided.join(items.select(key).distinct(), key, "left_semi")
    settled = resolve_decisions(wait, mine, decisions, key)
    asked = mine.where(c("disposition") == ASK).select(key, "start", "detector_id").withColumn("_asked", F.lit(True))
    kept = settled.join(asked, [key, "start", "detector_id"]).where(c("disposition") == BYPASS).groupBy(key).agg(
        F.count("*").cast("int").alias("n_kept"))
    out = redact_rows(wait, assign_aliases(settled, key, renderer), [key])
    out = out.join(kept, key, "left").join(stray, key, "left").fillna(0, ["n_kept"])
    status = (
        F.when(c("_stray"), "stale").when(c("status").isin("ambiguous", "error"), c("status"))
        .when(c("n_pending") > 0, "waiting").when(c("n_protect") == 0, "kept").when(c("n_kept") > 0, "released_partly").otherwise("released")
    )
    out = out.withColumn("status", status)
    text = F.when(c("status").isin("released", "released_partly"), c("redacted")).otherwise(c("text"))
    return out.withColumn("redacted", text).select(
        key, "redacted", text_sha256(c("redacted")).alias("text_sha256"), "n_protect", "n_pending", "n_kept", "status")


def mint_grants(released: DataFrame, decided: DataFrame, decisions: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One pass for each kept item of risk 1 in a text that was released or kept, bound to the resulting text:
    ``(key, text_sha256, detector_id, canonical, n)``.  Kept items of risk 3 give none."""
    committed = released.where(F.col("status").isin("released", "released_partly", "kept")).select(key, "text_sha256")
    asked = decided.where((F.col("disposition") == ASK) & (F.col("risk") == 1)).join(committed.select(key), key, "left_semi")
    settled = resolve_decisions(docs.join(committed.select(key), key, "left_semi"), asked, decisions, key)
    kept = settled.where((F.col("disposition") == BYPASS) & F.col("detector_id").isNotNull() & F.col("canonical").isNotNull())
    return kept.select(key, "detector_id", "canonical").distinct().join(committed, key).withColumn("n", F.lit(1)).select(
        key, "text_sha256", "detector_id", "canonical", "n")
