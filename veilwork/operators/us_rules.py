"""US opt-in scans: tax numbers, health, immigration, licence, bank, phone, address and name.

All read the raw text (no normalisation; non-ASCII digits are rejected).  ``with_us_inputs`` adds
the columns the rules share (fields, line breaks, jurisdiction marks); ``scan_us_arrays`` then adds
one array of findings and one of attempts per text, with no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.checks import (
    aba_checksum,
    atin_violation,
    evidence_code,
    itin_violation,
    number_shape,
    ssn_range_violation,
)
from ..functions.spans import (
    FINDING,
    FINDINGS,
    Stages,
    clean_markers,
    drop_overlapping,
    empty,
    find_all,
    let,
    memo,
    one_stage,
    remembered,
    resolve_stages,
    run_stages,
    running_max,
)
from ..functions.text import ascii_upper
from .base_rules import HIGH, MEDIUM
from .fields import (
    accepted_at_trimmed_end,
    bind_fields,
    jurisdiction_marks,
    label_pattern,
    line_breaks,
    line_numbers,
    lines_in,
    read_labelled,
    read_values,
    trimmed,
    usable,
)

ATTEMPT = (
    "struct<start:int,len:int,detector_id:string,evidence:int,outcome:string,reason:string,position:int,canonical:string>"
)
ATTEMPTS = f"array<{ATTEMPT}>"

LETTER_DIGIT = r"[\p{L}\p{Nd}]"
TAX_KINDS = {"us.atin": 50, "us.itin": 60, "us.ssn": 70}

# Letters of a health number (B I L O S Z are left out) and the kind at each position.
MBI_LETTERS = "ACDEFGHJKMNPQRTUVWXY"
MBI_POSITIONS = "1LADLADLLDD"


CODES, STATES, SUFFIXES = "_us_codes", "_us_states", "_us_suffixes"  # columns of list records beside the text


@dataclass
class RefLists:
    """Reference lists for phone and address: Python lists, or tables ``(record)`` of any size.

    Without area codes the phone detector is not ready, without suffixes and states the address detector; a text that was
    not read by a detector that is neither ready nor in ``without`` counts as not scanned.  Rules read the lists from columns (``attach``): area codes are three digits and states two letters, so there are at most 1000 and 676
    of them; suffixes are counted first, and a long list meets the words of the texts in a join instead.
    """

    area_codes: list[str] | DataFrame = field(default_factory=list)
    suffixes: list[str] | DataFrame = field(default_factory=list)
    states: list[str] | DataFrame = field(default_factory=list)
    without: frozenset[str] = frozenset()  # detectors that are left out knowingly
    most_in_row: int = 20_000  # suffixes that are set beside every text
    _has: dict[str, bool] = field(default_factory=dict, repr=False)

    def _any(self, name: str) -> bool:
        if name not in self._has:
            records = getattr(self, name)
            self._has[name] = bool(records.take(1) if isinstance(records, DataFrame) else records)
        return self._has[name]

    def not_ready(self) -> set[str]:
        phone = set() if self._any("area_codes") else {"us.phone"}
        return (phone | (set() if self._any("suffixes") and self._any("states") else {"us.address"})) - self.without

    @classmethod
    def stand_in(cls) -> "RefLists":
        """Codes by the numbering-plan rule and a short list of suffixes, to be chosen knowingly where no lists exist:
        with it foreign area codes are taken for US ones and rare suffixes are missed."""
        codes = [f"{n}" for n in range(200, 1000) if n // 10 % 10 != 9 and n % 100 != 11]
        return cls(codes, list(dims.STREET_SUFFIXES), list(dims.STATE_CODES))

    @classmethod
    def from_table(cls, ref_lists: DataFrame) -> "RefLists":
        """From ``ref_lists(list_id, record)``; an area-code record may carry a jurisdiction after the code."""
        pick = lambda name, shape, value=F.col("record"): ref_lists.where(
            (F.col("list_id") == name) & F.col("record").rlike(shape)).select(value.alias("record")).distinct()
        return cls(pick("us.npa", "^[0-9]{3}($| )", F.substring("record", 1, 3)), pick("usps.suffix", "."), pick("usps.state", "^[A-Z]{2}$"))

    def attach(self, df: DataFrame, text: str) -> DataFrame:
        """Add the list columns.  A table's records become a column by a subquery when the scan runs."""
        def column(records: list[str] | DataFrame) -> Column:
            if isinstance(records, DataFrame):
                return F.coalesce(records.agg(F.collect_set("record")).scalar(), empty("array<string>"))
            return F.array(*map(F.lit, records)).cast("array<string>")

        df = df.select("*", column(self.area_codes).alias(CODES), column(self.states).alias(STATES))
        if not isinstance(self.suffixes, DataFrame) or self.suffixes.limit(self.most_in_row + 1).count() <= self.most_in_row:
            return df.select("*", column(self.suffixes).alias(SUFFIXES))
        # the words that may close a street, by text, narrowed to those of the list; equal texts have equal words
        after = F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{Nd}}-])[1-9][0-9]{{0,5}}[A-Za-z]? (?=([^\r\n]{{0,210}}))"), F.lit(1))
        bare = lambda w: ascii_upper(F.regexp_extract(w, "^[0-9A-Za-z.'-]*+", 0))
        words = F.array_distinct(F.flatten(F.transform(after, lambda x: F.transform(F.slice(F.split(x, " ", 6), 1, 5), bare))))
        rows = df.select(F.sha2(text, 256).alias("_h"), F.explode(words).alias("record")).distinct()
        known = rows.join(self.suffixes.select("record"), "record", "left_semi").groupBy("_h").agg(F.collect_set("record").alias(SUFFIXES))
        joined = df.join(known, F.sha2(text, 256) == F.col("_h"), "left").drop("_h")
        return joined.withColumn(SUFFIXES, F.coalesce(SUFFIXES, empty("array<string>")))


def attempt(detector_id, start, length, evidence, outcome, reason=None, position=None, canonical=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        *[as_col(v) for v in (start, length, detector_id, evidence, outcome, reason, position, canonical)]
    ).cast(ATTEMPT)


def us_finding(detector_id, start, length, canonical, surface, evidence, risk=3, conf=HIGH, owner=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    if isinstance(detector_id, Column):
        pii_type = dims.lookup(dims.DETECTOR_TYPE, detector_id, "string")
        rank = dims.lookup(dims.RANK, detector_id, "int")
        ordinal = dims.type_ordinal(pii_type)
    else:
        pii_type = F.lit(dims.DETECTOR_TYPE[detector_id])
        rank = F.lit(dims.RANK[detector_id])
        ordinal = F.lit(dims.TYPE_ORD[dims.DETECTOR_TYPE[detector_id]])
    return F.struct(
        start, length, ordinal, pii_type, as_col(detector_id), canonical, surface, as_col(risk), as_col(conf), rank,
        as_col(evidence), F.lit(None) if owner is None else owner,
    ).cast(FINDING)


def first_per_span(out: str, preferred: Column, others: Column, item_type: str) -> Stages:
    """Both arrays in span order; on one span the preferred item wins."""
    keyed = f"array<struct<start:int,len:int,later:int,f:{item_type}>>"
    k = f"{out}_k"
    tag = lambda arr, later: F.transform(arr, lambda f: F.struct(f["start"], f["len"], F.lit(later), f)).cast(keyed)
    yield {k: F.array_sort(F.concat(tag(preferred, 0), tag(others, 1)))}

    def fresh(x: Column, i: Column) -> Column:
        p = F.get(F.col(k), i - 1)
        same = (i > 0) & (p["start"] == x["start"]) & (p["len"] == x["len"])
        return F.when(~F.coalesce(same, F.lit(False)), x["f"])

    yield {out: F.filter(F.transform(k, fresh), lambda f: f.isNotNull())}


# --- tax numbers -----------------------------------------------------------------------------

_WINDOW = "struct<start:int,len:int,form:string,digits:string,label_kind:string>"


def tax_attempts(out: str, text: str, fields: str, target: str | None = None) -> Stages:
    """Every attempt of the tax-number family: accepted, rejected with a reason, or superseded.

    A dashed number is tried as all three kinds, other forms only as the kind of their label.
    Kinds are mutually exclusive on a number, so the smallest accepted kind of a span is its winner.
    """
    kinds = [target] if target else list(TAX_KINDS)
    tax_roles = list(TAX_KINDS)
    bounds = r"[\p{L}\p{Nd}-]"
    labelled_fields = read_labelled(F.col(fields), tax_roles if target is None else [target])

    def reject(kind, start, length, reason, evidence) -> Column:
        return attempt(kind, start, length, evidence, "Rejected", reason)

    def defect(s: Column, shape: Column) -> Column:
        foreign = F.regexp_replace(s, "[0-9]", "").rlike(r"\p{Nd}")
        return (
            F.when(foreign, "NonAsciiDigit")
            .when(shape == "unsupported", "UnsupportedSeparator")
            .when(shape == "mixed", "MixedSeparators")
        )

    def outer(start: Column, core: int, nxt: Column, kind: Column) -> Column:
        reason = F.when(nxt.rlike(f"^{bounds}"), "AlphanumericBoundaryViolation").otherwise("TrailingContent")
        return reject(kind, start, F.lit(core), reason, dims.EV_SC)

    def classify(f: Column) -> Column:
        v = trimmed(f)
        start, n, kind = f["val_start"], F.length(v), f["role"]
        shape = number_shape(v)
        inner = lambda length: F.substring(v, 1, length)
        grouped = lambda s: number_shape(s).isin("dashed", "spaced")
        inside = "AlphanumericBoundaryViolation"
        plain_reason = F.when(v.rlike(r"^[0-9]+([- ])[0-9]+\1[0-9]+\z"), "InvalidLength").otherwise("UnrecognizedValueShape")
        not_bound = F.when(
            (f["state"] == "RejectedEmptyCandidate") & (f["terminator"] == "NextRecognizedLabel"),
            "NextRecognizedFieldTerminatesBinding",
        ).otherwise("FieldBindingRejected")
        return (
            F.when(f["state"] != "FieldAccepted", reject(kind, f["label_start"], f["label_len"], not_bound, dims.EV_SC))
            .when(shape.isNotNull() & defect(v, shape).isNotNull(), reject(kind, start, n, defect(v, shape), dims.EV_SC))
            .when(shape.isNotNull(), F.lit(None))
            .when((n > 9) & (number_shape(inner(9)) == "compact"), outer(start, 9, F.substring(v, 10, 1), kind))
            .when((n > 11) & grouped(inner(11)), outer(start, 11, F.substring(v, 12, 1), kind))
            .when(
                (n == 10) & v.rlike(f"^{bounds}") & (number_shape(F.substring(v, 2, 9)) == "compact"),
                reject(kind, start + 1, F.lit(9), inside, dims.EV_SC),
            )
            .when(
                (n == 12) & v.rlike(f"^{bounds}") & grouped(F.substring(v, 2, 11)),
                reject(kind, start + 1, F.lit(11), inside, dims.EV_SC),
            )
            .otherwise(reject(kind, start, n, plain_reason, dims.EV_SC))
        )

    named = F.filter(labelled_fields, lambda f: (f["state"] != "FieldAccepted") | (trimmed(f) != ""))
    label_rejects = F.filter(F.transform(named, classify), lambda a: a.isNotNull())

    def label_window(f: Column) -> Column:
        v = trimmed(f)
        ok = number_shape(v).isNotNull() & defect(v, number_shape(v)).isNull()
        w = F.struct(f["val_start"], F.length(v), number_shape(v), F.regexp_replace(v, "[^0-9]", ""), f["role"])
        return F.when(ok, w.cast(_WINDOW))

    label_windows = F.filter(F.transform(F.filter(labelled_fields, usable), label_window), lambda w: w.isNotNull())

    # unlabelled dashed numbers, unless another field's value owns that stretch
    own_roles = tax_roles if target is None else [target]
    span = "struct<start:int,len:int>"
    owned = F.transform(
        F.filter(F.col(fields), lambda f: ~f["in_word"] & usable(f) & ~F.coalesce(f["role"].isin(own_roles), F.lit(False))),
        lambda f: F.struct(f["val_start"].alias("start"), f["val_len"].alias("len")).cast(span),
    )
    dash_type = "struct<start:int,len:int,text:string,touches:boolean>"
    dashed = F.transform(
        find_all(clean_markers(text), r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}", (), 1, 1),
        lambda m: F.struct(
            m["start"], F.length(m["text"]), m["text"], m["before"].rlike(f"{bounds}$") | m["after"].rlike(f"^{bounds}")
        ).cast(dash_type),
    )
    yield {f"{out}_d": dashed, f"{out}_o": owned, f"{out}_lr": label_rejects, f"{out}_lw": label_windows}
    yield from drop_overlapping(f"{out}_f", F.col(f"{out}_d"), F.col(f"{out}_o"), dash_type)
    free = F.col(f"{out}_f")
    shape = F.lit("dashed")

    def free_reject(d: Column) -> Column:
        reason = F.when(d["touches"], "AlphanumericBoundaryViolation").otherwise(defect(d["text"], shape))
        each = F.array(*[reject(k, d["start"], d["len"], reason, dims.EV_S) for k in kinds])
        return F.when(reason.isNotNull(), each).otherwise(empty(ATTEMPTS))

    def free_window(d: Column) -> Column:
        ok = ~d["touches"] & defect(d["text"], shape).isNull()
        w = F.struct(d["start"], d["len"], shape, F.regexp_replace(d["text"], "[^0-9]", ""), F.lit(None))
        return F.when(ok, w.cast(_WINDOW))

    def judge(w: Column) -> Column:
        checks = {"us.atin": atin_violation, "us.itin": itin_violation, "us.ssn": ssn_range_violation}

        def one(kind: str) -> Column:
            own = F.coalesce(w["label_kind"] == kind, F.lit(False))
            reason = checks[kind](w["digits"])
            return F.when(
                (w["form"] == "dashed") | own,
                attempt(
                    kind, w["start"], w["len"], F.when(own, dims.EV_SC).otherwise(dims.EV_S),
                    F.when(reason.isNull(), "Accepted").otherwise("Rejected"), reason, None, w["digits"],
                ),
            )

        return F.filter(F.array(*[one(k) for k in kinds]), lambda a: a.isNotNull())

    free_windows = F.filter(F.transform(free, free_window), lambda w: w.isNotNull())
    yield {f"{out}_fw": free_windows, f"{out}_fr": F.flatten(F.transform(free, free_reject))}
    yield from first_per_span(f"{out}_w", F.col(f"{out}_lw"), F.col(f"{out}_fw"), _WINDOW)
    yield {f"{out}_j": F.flatten(F.transform(f"{out}_w", judge))}
    yield {out: F.array_sort(F.array_distinct(F.concat(f"{out}_lr", f"{out}_fr", f"{out}_j"))).cast(ATTEMPTS)}


def accepted_findings(attempts: Column, surface_from: str) -> Column:
    """Accepted attempts as findings."""
    return F.transform(
        F.filter(attempts, lambda a: a["outcome"] == "Accepted"),
        lambda a: us_finding(
            a["detector_id"], a["start"], a["len"], a["canonical"],
            F.substring(F.col(surface_from), a["start"] + 1, a["len"]), a["evidence"],
        ),
    ).cast(FINDINGS)


def minus_accepted(out: str, attempts: Column) -> Stages:
    """Drop rejections whose (detector, span) was accepted, and repeats.

    Sorting puts the attempts on one span next to each other, an acceptance first; a running
    maximum carries the place of the last acceptance forward.
    """
    keyed = f"array<struct<start:int,len:int,d:string,rejected:int,a:{ATTEMPT}>>"
    k, m = f"{out}_mk", f"{out}_mm"
    yield {
        k: F.array_sort(
            F.transform(
                F.array_distinct(attempts),
                lambda a: F.struct(
                    a["start"], a["len"], a["detector_id"], F.when(a["outcome"] == "Accepted", 0).otherwise(1), a
                ),
            ).cast(keyed)
        )
    }
    yield {m: running_max(F.transform(k, lambda x, i: F.when(x["rejected"] == 0, i).otherwise(F.lit(-1))))}

    def one(x: Column, i: Column) -> Column:
        lead = F.get(F.col(k), F.get(F.col(m), i))
        taken = (F.get(F.col(m), i) >= 0) & (lead["start"] == x["start"]) & (lead["len"] == x["len"]) & (lead["d"] == x["d"])
        return F.when(~F.coalesce(taken, F.lit(False)), x["a"])

    yield {out: F.filter(F.transform(k, one), lambda a: a.isNotNull()).cast(ATTEMPTS)}


# --- health and student numbers --------------------------------------------------------------


def _mbi_classes() -> list[str]:
    letters = MBI_LETTERS + MBI_LETTERS.lower()
    return [{"1": "[1-9]", "L": f"[{letters}]", "A": f"[{letters}0-9]", "D": "[0-9]"}[k] for k in MBI_POSITIONS]


def mbi_pattern() -> str:
    c = _mbi_classes()
    return "".join(c) + "|" + "".join(c[:4]) + "([- ])" + "".join(c[4:7]) + r"\1" + "".join(c[7:])


def mbi_attempts(out: str, text: str, fields: str) -> Stages:
    pattern = mbi_pattern()
    upper = lambda s: F.upper(F.regexp_replace(s, "[^0-9A-Za-z]", ""))

    def position_error(eleven: Column) -> Column:
        """First failing position, with its reason."""
        errors = []
        for i, kind in enumerate(MBI_POSITIONS):
            c = F.substring(eleven, i + 1, 1)
            digit, letter = c.rlike("[0-9]"), c.rlike(f"[{MBI_LETTERS}]")
            excluded = F.concat(F.lit("Excluded"), F.when(c.rlike("[BILOS]"), c).otherwise(F.lit("Z")))
            ok, reason = {
                "1": (c.rlike("[1-9]"), F.lit("Position1RequiresOneToNine")),
                "D": (digit, F.lit("PositionRequiresDigit")),
                "L": (letter, F.when(digit, "PositionRequiresAllowedLetter").otherwise(excluded)),
                "A": (digit | letter, excluded),
            }[kind]
            errors.append(F.when(~ok, F.struct(reason.alias("reason"), F.lit(i + 1).alias("position"))))
        return F.coalesce(*errors)

    def labelled(f: Column) -> Column:
        v = trimmed(f)
        n, alnum = F.length(v), F.length(F.regexp_replace(v, "[^0-9A-Za-z]", ""))
        foreign = F.regexp_replace(v, "[0-9A-Za-z]", "").rlike(LETTER_DIGIT)
        no = lambda reason, position=None: attempt(
            "us.mbi", f["val_start"], n, dims.EV_SC, "Rejected", reason, position
        )
        first = F.length(F.regexp_extract(v, "^([0-9A-Za-z]*)", 1))
        second = first + 1 + F.length(F.regexp_extract(v, "^[0-9A-Za-z]*[^0-9A-Za-z]([0-9A-Za-z]*)", 1))
        seps = F.regexp_replace(v, "[0-9A-Za-z]", "")
        standard = seps.rlike("^[- ][- ]$")
        placed = (first == 4) & (second == 8)
        judged = let(
            position_error(upper(v)),
            lambda e: F.when(e.isNotNull(), no(e["reason"], e["position"])).otherwise(
                attempt("us.mbi", f["val_start"], n, dims.EV_SC, "Accepted", None, None, upper(v))
            ),
        )
        shape = (
            F.when((n - alnum == 0) & (alnum != 11), no("WrongLength"))
            .when(n - alnum == 0, judged)
            .when((n - alnum == 2) & (alnum != 11), no("WrongLength"))
            .when((n - alnum == 2) & ~placed & standard, no("BadGrouping"))
            .when((n - alnum == 2) & ~standard, no("UnsupportedSeparator"))
            .when((n - alnum == 2) & ~seps.isin("--", "  "), no("MixedSeparators"))
            .when(n - alnum == 2, judged)
            .otherwise(no("UnrecognizedValueShape"))
        )
        return (
            F.when(
                f["state"] != "FieldAccepted",
                attempt("us.mbi", f["label_start"], f["label_len"], dims.EV_SC, "Rejected", "FieldBindingRejected"),
            )
            .when(v == "", F.lit(None))
            .when(foreign & n.isin(11, 13), no("NonAsciiLookalike"))
            .when(foreign, no("UnrecognizedValueShape"))
            .when(v.rlike(rf"^(?:{pattern})[^0-9A-Za-z]"), no("TrailingContent"))
            .otherwise(shape)
        )

    def free(m: Column) -> Column:
        touches = m["before"].rlike(f"{LETTER_DIGIT}$") | m["after"].rlike(f"^{LETTER_DIGIT}")
        n = F.length(m["text"])
        return F.when(
            touches, attempt("us.mbi", m["start"], n, dims.EV_S, "Rejected", "BoundaryViolation")
        ).otherwise(attempt("us.mbi", m["start"], n, dims.EV_S, "Accepted", None, None, upper(m["text"])))

    rows = F.filter(F.transform(read_labelled(F.col(fields), ["us.mbi"]), labelled), lambda a: a.isNotNull())
    found = F.transform(find_all(clean_markers(text), pattern, (), 1, 1), free)
    yield from _labelled_first(out, rows, found)


def _labelled_first(out: str, labelled: Column, free: Column) -> Stages:
    """Attempts of both passes; of two acceptances on one span the labelled one stays."""
    x, y = f"{out}_x", f"{out}_y"
    yield {x: labelled, y: free}
    ok = lambda arr: F.filter(arr, lambda a: a["outcome"] == "Accepted")
    no = lambda arr: F.filter(arr, lambda a: a["outcome"] != "Accepted")
    yield from first_per_span(f"{out}_a", ok(x), ok(y), ATTEMPT)
    yield from minus_accepted(out, F.concat(F.col(f"{out}_a"), no(x), no(y)))


def sevis_attempts(out: str, text: str, fields: str) -> Stages:
    core = "N[0-9]{10}"

    def judge(start: Column, token: Column, evidence: int) -> Column:
        n = F.length(token)
        no = lambda reason: attempt("us.sevis", start, n, evidence, "Rejected", reason)
        digits = F.substring(token, 2, F.length(token))
        letter_then_digits = (n >= 10) & token.rlike(r"^\p{L}\p{Nd}+\z")
        inside = F.regexp_instr(token, F.lit(core))
        return (
            F.when(token.rlike(rf"^{core}\z"), attempt("us.sevis", start, n, evidence, "Accepted", None, None, token))
            .when(letter_then_digits & (n != 11), no("WrongLength"))
            .when(letter_then_digits & ~digits.rlike("^[0-9]+$"), no("NonAsciiDigit"))
            .when(letter_then_digits & ~token.rlike("^[A-Za-z]"), no("NonAsciiLookalike"))
            .when(letter_then_digits, no("PrefixMustBeN"))
            .when(
                (n > 11) & token.rlike(core),
                attempt("us.sevis", start + inside - 1, F.lit(11), evidence, "Rejected", "BoundaryViolation"),
            )
        )

    def labelled(f: Column) -> Column:
        v = trimmed(f)
        no = lambda reason: attempt("us.sevis", f["val_start"], F.length(v), dims.EV_SC, "Rejected", reason)
        return (
            F.when(
                f["state"] != "FieldAccepted",
                attempt("us.sevis", f["label_start"], f["label_len"], dims.EV_SC, "Rejected", "FieldBindingRejected"),
            )
            .when(v == "", F.lit(None))
            .when(v.rlike(rf"^{LETTER_DIGIT}+\z"), F.coalesce(judge(f["val_start"], v, dims.EV_SC), no("UnrecognizedValueShape")))
            .when(v.rlike(rf"^{core}[^\p{{L}}\p{{Nd}}]"), no("TrailingContent"))
            .otherwise(no("UnrecognizedValueShape"))
        )

    tokens = find_all(clean_markers(text), rf"(?<!{LETTER_DIGIT}){LETTER_DIGIT}{{10,}}+")
    rows = F.filter(F.transform(read_labelled(F.col(fields), ["us.sevis"]), labelled), lambda a: a.isNotNull())
    judged = F.filter(F.transform(tokens, lambda m: judge(m["start"], m["text"], dims.EV_S)), lambda a: a.isNotNull())
    found = F.when(F.col(text).rlike(r"\p{Nd}{9}"), judged).otherwise(empty(ATTEMPTS))
    yield from _labelled_first(out, rows, found)


# --- document numbers ------------------------------------------------------------------------


def _field_findings(fields: Column, make) -> Column:
    return F.filter(F.transform(fields, make), lambda f: f.isNotNull()).cast(FINDINGS)


def _line_flags(out: str, spots: str, position: str, breaks: str, marked: str) -> Stages:
    """Columns ``{out}_l`` (line numbers) and ``{out}`` (whether the line is under a US jurisdiction) of an ascending array."""
    yield from line_numbers(f"{out}_l", F.transform(spots, lambda s: s[position]), F.col(breaks))
    yield from lines_in(out, F.col(f"{out}_l"), F.col(marked))


def passport(out: str, text: str, fields: str, breaks: str, marked: str) -> Stages:
    current, legacy = r"^[A-Za-z][0-9]{8}\z", r"^(?=.*[0-9])[0-9A-Za-z]{6,12}\z"
    f_, t_ = f"{out}_f", f"{out}_t"
    tokens = find_all(clean_markers(text), rf"(?<!{LETTER_DIGIT})[A-Za-z][0-9]{{8}}(?!{LETTER_DIGIT})")
    yield {
        f_: read_values(F.col(fields), ["us.passport"]),
        t_: F.when(F.size(marked) == 0, F.slice(tokens, 1, 0)).otherwise(tokens),
    }
    for f_step, t_step in zip(
        _line_flags(f"{f_}j", f_, "label_start", breaks, marked), _line_flags(f"{t_}j", t_, "start", breaks, marked)
    ):
        yield {**f_step, **t_step}

    def labelled(f: Column, flag: Column) -> Column:
        v = trimmed(f)
        j = flag | (f["label"] == "U.S. Passport")
        make = lambda s: us_finding(
            "us.passport", f["val_start"], F.length(v), ascii_upper(v), v,
            evidence_code(F.lit(s), F.lit(True), j), owner=j,
        )
        return F.when(v.rlike(current), make(True)).when(v.rlike(legacy), make(False))

    def bare(m: Column, flag: Column) -> Column:
        return F.when(
            flag,
            us_finding(
                "us.passport", m["start"], F.lit(9), ascii_upper(m["text"]), m["text"], dims.EV_SJP, owner=F.lit(True)
            ),
        )

    present = lambda arr: F.filter(arr, lambda f: f.isNotNull()).cast(FINDINGS)
    yield {
        f"{out}_n": present(F.zip_with(f_, f"{f_}j", labelled)),
        f"{out}_b": present(F.zip_with(t_, f"{t_}j", bare)),
    }
    yield from first_per_span(out, F.col(f"{out}_n"), F.col(f"{out}_b"), FINDING)


def a_number(fields: str) -> Column:
    def make(f: Column) -> Column:
        v = trimmed(f)
        digits = F.regexp_replace(v, "[^0-9]", "")
        out = us_finding(
            "us.a_number", f["val_start"], F.length(v), F.concat(F.lit("A"), digits), v, dims.EV_SC
        )
        return F.when(v.rlike(r"^(?:[Aa][ -]?)?[0-9]{7,9}\z"), out)

    return _field_findings(read_values(F.col(fields), ["us.a_number"]), make)


def i94(fields: str) -> Column:
    def make(f: Column) -> Column:
        v = trimmed(f)
        return F.when(
            v.rlike(r"^[0-9A-Za-z]{11}\z"), us_finding("us.i94", f["val_start"], F.length(v), ascii_upper(v), v, dims.EV_SC)
        )

    return _field_findings(read_values(F.col(fields), ["us.i94"]), make)


def driver_state_id(out: str, text: str, fields: str, breaks: str, marked: str) -> Stages:
    roles = ["us.driver_state_id", "us.driver_state_id.customer"]
    companion = (
        r"(?i)(?<![A-Za-z0-9])Document Type(?![A-Za-z0-9]) *[:#=]? *(?:Driver License|State ID)(?![A-Za-z0-9]) *"
        rf"(?=\z|[\r\n;|\t]|{label_pattern(dims.ALL_LABELS)})"
    )
    f_, c_ = f"{out}_f", f"{out}_c"
    yield {
        f_: F.when(F.size(marked) == 0, F.slice(fields, 1, 0)).otherwise(read_values(F.col(fields), roles)),
        c_: F.transform(find_all(clean_markers(text), companion), lambda m: m["start"]),
    }
    yield from _line_flags(f"{f_}j", f_, "label_start", breaks, marked)
    yield from line_numbers(f"{c_}l", F.col(c_), F.col(breaks))

    def make(f: Column, flag: Column, line: Column) -> Column:
        v = trimmed(f)
        packed = F.regexp_replace(v, "[ -]", "")
        one_companion = F.size(F.filter(f"{c_}l", lambda n: n == line)) == 1
        ok = (
            flag
            & ((f["role"] == "us.driver_state_id") | one_companion)
            & v.rlike(r"^[0-9A-Za-z]+(?:[ -][0-9A-Za-z]+)*\z")
            & packed.rlike("[0-9]")
            & F.length(packed).between(4, 25)
        )
        return F.when(
            ok, us_finding("us.driver_state_id", f["val_start"], F.length(v), ascii_upper(packed), v, dims.EV_SCJP)
        )

    rows = F.transform(
        F.arrays_zip(F.col(f_).alias("f"), F.col(f"{f_}j").alias("j"), F.col(f"{f_}j_l").alias("n")),
        lambda x: make(x["f"], x["j"], x["n"]),
    )
    yield {out: F.filter(rows, lambda f: f.isNotNull()).cast(FINDINGS)}


# --- bank accounts ---------------------------------------------------------------------------

FINANCIAL_ROLES = ["bank.routing", "bank.specific", "bank.generic"]
PAIR_DISTANCE = 128


def _value_before_next_label(f: Column) -> Column:
    """The trimmed value; a comma in front of a following label is not part of it."""
    return F.when(
        f["terminator"] == "NextRecognizedLabel", F.regexp_replace(trimmed(f), " *,$", "")
    ).otherwise(trimmed(f))


def bank_account(out: str, fields: str, breaks: str) -> Stages:
    """Accounts by their own label, or paired with the routing number in the field before or after.

    Financial fields of one line are neighbours, so "the only one on its line" is a look at both sides.
    """
    k, n, p = f"{out}_k", f"{out}_n", f"{out}_p"
    some = F.exists(fields, lambda f: f["role"].isin("bank.specific", "bank.generic"))
    kept = F.filter(fields, lambda f: ~(f["role"].isin(FINANCIAL_ROLES) & f["in_word"]))
    yield {k: F.when(some, kept).otherwise(F.slice(fields, 1, 0))}
    yield from line_numbers(n, F.transform(k, lambda f: f["label_start"]), F.col(breaks))
    yield {
        p: F.filter(
            F.transform(k, lambda f, i: F.struct(f.alias("f"), F.get(F.col(n), i).alias("line"), i.alias("i"))),
            lambda x: x["f"]["role"].isin(FINANCIAL_ROLES),
        )
    }
    at = lambda j: F.get(F.col(p), j)

    def solo(j: Column) -> Column:
        line = at(j)["line"]
        before = F.when(j <= 0, True).otherwise(at(j - 1)["line"] != line)
        return before & F.coalesce(at(j + 1)["line"] != line, F.lit(True))

    def pairs(a: Column, j: Column, b: Column, k_: Column) -> Column:
        valid = (
            (b["f"]["role"] == "bank.routing")
            & accepted_at_trimmed_end(b["f"])
            & aba_checksum(_value_before_next_label(b["f"]))
            & (F.abs(a["i"] - b["i"]) == 1)
            & (F.abs(a["f"]["label_start"] - b["f"]["label_start"]) <= PAIR_DISTANCE)
            & ((a["line"] == b["line"]) | ((F.abs(a["line"] - b["line"]) == 1) & solo(j) & solo(k_)))
        )
        return F.coalesce(valid, F.lit(False))

    yield {
        f"{out}_q": F.transform(
            p,
            lambda x, j: F.when(j == 0, False).otherwise(pairs(x, j, at(j - 1), j - 1)) | pairs(x, j, at(j + 1), j + 1),
        )
    }

    def one(x: Column, paired: Column) -> Column:
        f, v = x["f"], _value_before_next_label(x["f"])
        ok = (
            (f["role"] != "bank.routing")
            & accepted_at_trimmed_end(f)
            & v.rlike(r"^[0-9A-Za-z]{4,17}\z")
            & (paired | (f["role"] == "bank.specific"))
        )
        evidence = F.when(paired, dims.EV_SCJP).otherwise(dims.EV_C)
        return F.when(ok, us_finding("us.bank_account", f["val_start"], F.length(v), ascii_upper(v), v, evidence))

    yield {out: F.filter(F.zip_with(p, f"{out}_q", one), lambda f: f.isNotNull()).cast(FINDINGS)}


# --- phone, address, name --------------------------------------------------------------------


def phone_forms(compact: bool) -> str:
    area, exchange, rest = "[2-9][0-9]{2}", "[2-9][0-9]{2}", "[0-9]{4}"
    grouped = lambda s: f"{area}{s}{exchange}{s}{rest}"
    parens = rf"\({area}\) {exchange}-{rest}"
    forms = [
        rf"\+1-{grouped('-')}", rf"\+1 {parens}", rf"\+1 {grouped(' ')}", rf"\+1{area}{exchange}{rest}",
        f"1-{grouped('-')}", f"1 {parens}", parens, grouped("-"), grouped(r"\."), grouped(" "),
    ]
    if compact:
        forms.append(f"{area}{exchange}{rest}")
    return "(" + "|".join(forms) + ")"


def phone_pattern(compact: bool) -> str:
    """Groups: 1 number, 2 extension digits."""
    bound = r"(?![\p{L}\p{Nd}-]|\.[0-9])"
    return rf"{phone_forms(compact)}(?: ?(?i:extension|ext|x) ?([0-9]++){bound}|{bound})"


def us_phone(out: str, text: str, fields: str) -> Stages:
    def national(number: Column) -> Column:
        return F.right(F.regexp_replace(number, "[^0-9]", ""), F.lit(10))

    def make(start: Column, whole: Column, number: Column, extension: Column, evidence: int) -> Column:
        n = national(number)
        canonical = F.when(extension != "", F.concat(n, F.lit("x"), extension)).otherwise(n)
        return F.when(F.array_contains(F.col(CODES), F.substring(n, 1, 3)), us_finding("us.phone", start, F.length(whole), canonical, whole, evidence, 2))

    def labelled(f: Column) -> Column:
        v, p = trimmed(f), "^" + phone_pattern(True)
        whole = F.regexp_extract(v, p, 0)
        out = make(f["val_start"], whole, F.regexp_extract(v, p, 1), F.regexp_extract(v, p, 2), dims.EV_SC)
        return F.when(whole != "", out)

    g = lambda m, i: F.get(m["groups"], F.lit(i))
    hits = find_all(clean_markers(text), r"(?<![\p{L}\p{Nd}\-+.])" + phone_pattern(False), (1, 2))
    bare = _field_findings(hits, lambda m: make(m["start"], m["text"], g(m, 0), g(m, 1), dims.EV_S))
    named = _field_findings(read_values(F.col(fields), ["us.phone"]), labelled)
    yield {
        f"{out}_n": named,
        f"{out}_b": F.when(F.col(text).rlike(r"[0-9][-. ][0-9]{4}|\+1[0-9]{10}"), bare).otherwise(empty(FINDINGS)),
    }
    yield from first_per_span(out, F.col(f"{out}_n"), F.col(f"{out}_b"), FINDING)


_TOKEN = "[0-9A-Za-z][0-9A-Za-z.'-]{0,39}(?![0-9A-Za-z.'-])"
_UNIT = " (?i:APT|STE|UNIT) [0-9A-Za-z-]{1,10}(?![0-9A-Za-z-])"


def us_address(out: str, text: str, fields: str) -> Stages:
    """Street addresses under an address label, or complete with city, state and ZIP on one line."""
    head = r"[1-9][0-9]{0,5}(?![0-9])[A-Za-z]?"
    box = "(?:PO Box|(?:RR|HC) [1-9][0-9]{0,3} Box) [0-9A-Za-z-]{1,10}(?![0-9A-Za-z-])"
    sep = "(?:, ?+(?! )| (?! ))"
    city = "[A-Za-z][A-Za-z.'-]{0,39}(?![A-Za-z.'-])"
    rest = (
        rf"^{sep}{city}(?: {city}){{0,3}}?{sep}[A-Z]{{2}} [0-9]{{5}}(?:-[0-9]{{4}})?"
        r"(?![\p{L}\p{Nd}-])"
    )
    listed = lambda tail: F.array_contains(F.col(STATES), F.regexp_extract(tail, "([A-Z]{2}) [0-9]{5}(?:-[0-9]{4})?$", 1))

    def street(s: Column) -> Column:
        """Length of the street at the start of ``s`` (with its unit), or NULL."""
        def by_tokens(run: Column) -> Column:
            lead = F.length(F.regexp_extract(s, f"^{head} ", 0))
            tokens = F.split(run, " ", -1)

            def through(k: int) -> Column:
                return lead + F.length(F.array_join(F.slice(tokens, 1, k + 1), " "))

            known = lambda k: F.array_contains(F.col(SUFFIXES), ascii_upper(F.get(tokens, F.lit(k))))
            base = F.coalesce(*[F.when(known(k), through(k)) for k in (1, 2, 3, 4)])
            return let(
                base,
                lambda b: b + F.length(F.regexp_extract(F.substring(s, b + 1, F.length(s)), f"^{_UNIT}", 0)),
            )

        return let(
            F.regexp_extract(s, f"^{head} ({_TOKEN}(?: {_TOKEN}){{0,4}})", 1),
            lambda run: F.when(run != "", by_tokens(run)),
        )

    def labelled(f: Column) -> Column:
        v = F.regexp_replace(trimmed(f), "[.?!]+$", "")
        boxed = F.length(F.regexp_extract(v, f"^{box}", 0))
        return let(
            F.coalesce(street(v), F.when(boxed > 0, boxed)),
            lambda n: F.when(
                n.isNotNull() & ~F.substring(v, n + 1, 1).rlike(r"[\p{L}\p{Nd}'-]"),
                us_finding("us.address", f["val_start"], F.length(v), v, v, dims.EV_SC, 2),
            ),
        )

    def complete(m: Column) -> Column:
        s = F.concat(m["text"], F.get(m["groups"], F.lit(0)))
        return let(
            street(s),
            lambda n: let(
                F.regexp_extract(F.substring(s, n + 1, F.length(s)), rest, 0),
                lambda tail: F.when(
                    (tail != "") & listed(tail) & (n + F.length(tail) <= 160),
                    us_finding(
                        "us.address", m["start"], n + F.length(tail), F.left(s, n + F.length(tail)),
                        F.left(s, n + F.length(tail)), dims.EV_SJP, 2,
                    ),
                ),
            ),
        )

    hits = find_all(
        clean_markers(text), rf"(?<![\p{{L}}\p{{Nd}}-]){head} (?=([0-9A-Za-z][^\r\n]{{0,170}}))", (1,)
    )
    has_zip = F.col(text).rlike(r"[ ,][A-Z]{2} [0-9]{5}")
    yield {
        f"{out}_n": _field_findings(read_values(F.col(fields), ["us.address"]), labelled),
        f"{out}_c": F.when(has_zip, _field_findings(hits, complete)).otherwise(empty(FINDINGS)),
    }
    yield from resolve_stages(f"{out}_w", F.col(f"{out}_c"), FINDING, lambda f: [f["start"]])
    yield from first_per_span(out, F.col(f"{out}_n"), F.col(f"{out}_w"), FINDING)


def name_pattern(least: int) -> str:
    token = r"(?>[A-Za-z](?:[A-Za-z'-]{1,39}+(?![A-Za-z'-])|\.|(?![A-Za-z'.-])))"
    return rf"(?>{token}(?: {token}){{{least - 1},3}}+)(?=\z|[,;|\t\r\n.?!])"


HONORIFIC = r"(?:Mrs\.?|Mr\.?|Ms\.?|Miss|Dr\.?)"


def us_name(out: str, text: str, fields: str) -> Stages:
    def labelled(f: Column) -> Column:
        v = trimmed(f)
        found = F.regexp_extract(v, "^" + name_pattern(1), 0)
        generic = f["role"] == "us.name.generic"
        out = us_finding(
            "us.name", f["val_start"], F.length(found), found, found, dims.EV_C,
            F.when(generic, 1).otherwise(2), F.when(generic, MEDIUM).otherwise(HIGH),
        )
        return F.when((found != "") & ~(generic & v.rlike(f"^{HONORIFIC} [A-Za-z]")), out)

    hits = find_all(clean_markers(text), rf"(?<![A-Za-z0-9]){HONORIFIC} ({name_pattern(2)})", (1,))
    titled = F.transform(
        hits,
        lambda m: us_finding(
            "us.name", m["start"], F.length(m["text"]), F.get(m["groups"], F.lit(0)), m["text"], dims.EV_C, 1, MEDIUM
        ),
    ).cast(FINDINGS)
    named = _field_findings(read_values(F.col(fields), ["us.name.specific", "us.name.generic"]), labelled)
    yield {
        f"{out}_n": named,
        f"{out}_b": F.when(F.col(text).rlike(rf"{HONORIFIC} [A-Za-z]"), titled).otherwise(empty(FINDINGS)),
    }
    yield from first_per_span(out, F.col(f"{out}_n"), F.col(f"{out}_b"), FINDING)


# --- the scan --------------------------------------------------------------------------------

TAX, MBI, SEVIS = ["us.ssn", "us.itin", "us.atin"], ["us.mbi"], ["us.sevis"]
BOUND = ["us.passport", "us.a_number", "us.i94", "us.driver_state_id", "us.bank_account", "us.phone", "us.address",
         "us.name"]


def scan_us_arrays(docs: DataFrame, detectors: list[str] | None = None, lists: RefLists | None = None,
                   text: str = "text", single: bool = False) -> DataFrame:
    """Add ``us_findings`` and ``us_attempts`` (numbers with an audit of rejections) as array columns.

    ``single`` evaluates each tax detector on its own instead of as a family.  Detectors whose lists are missing are left
    out (``RefLists.not_ready``); asking for one of them by name is an error.
    """
    lists = lists or RefLists()
    unready = lists.not_ready()
    if unready & set(detectors or ()):
        raise ValueError("required detectors are not ready: " + ", ".join(sorted(unready & set(detectors))))
    chosen = detectors or [d for d in dims.US_DETECTORS if d not in unready | lists.without]
    chosen = [d for d in chosen if d in dims.US_DETECTORS and dims.DETECTOR_TYPE[d]]
    keep = docs.columns
    inputs = {}
    if any(d in TAX for d in chosen):
        inputs["_tax"] = memo(lambda: bind_fields(text, dims.TAX_LABELS), "tax_fields", text)
    if "us.mbi" in chosen:
        inputs["_mbi"] = memo(lambda: bind_fields(text, dims.LABELS["us.mbi"]), "mbi_fields", text)
    if "us.sevis" in chosen:
        inputs["_sevis"] = memo(lambda: bind_fields(text, dims.LABELS["us.sevis"]), "sevis_fields", text)
    if any(d in BOUND for d in chosen):
        inputs["_all"] = memo(lambda: bind_fields(text, dims.ALL_LABELS), "all_fields", text)
    in_lines = any(d in chosen for d in ("us.passport", "us.driver_state_id"))
    if in_lines or "us.bank_account" in chosen:
        inputs["_breaks"] = memo(lambda: line_breaks(text), "breaks", text)
    listed = lists.attach(docs, text) if {"us.phone", "us.address"} & set(chosen) else docs
    df = listed.select("*", *[c.alias(n) for n, c in inputs.items()])
    if in_lines:
        df = df.select("*", memo(lambda: jurisdiction_marks(text, F.col("_all")), "marks", text).alias("_marks"))
        df = run_stages(df, [line_numbers("_marked", F.col("_marks"), F.col("_breaks"))], df.columns, ["_marked"])

    stages, attempts, found = [], [], []

    def run(names: list[str], out: str, make) -> None:
        names.append(out)
        stages.append(remembered(make, "us", out, text))

    family = [d for d in chosen if d in TAX]
    if family and (single or len(family) < 3):
        for d in family:
            run(attempts, f"_t{d[3:]}", lambda d=d: tax_attempts(f"_t{d[3:]}", text, "_tax", d))
    elif family:
        run(attempts, "_tfamily", lambda: tax_attempts("_tfamily", text, "_tax"))
    if "us.mbi" in chosen:
        run(attempts, "_tmbi", lambda: mbi_attempts("_tmbi", text, "_mbi"))
    if "us.sevis" in chosen:
        run(attempts, "_tsevis", lambda: sevis_attempts("_tsevis", text, "_sevis"))
    makers = {
        "us.passport": lambda o: passport(o, text, "_all", "_breaks", "_marked"),
        "us.a_number": lambda o: one_stage(o, a_number("_all")),
        "us.i94": lambda o: one_stage(o, i94("_all")),
        "us.driver_state_id": lambda o: driver_state_id(o, text, "_all", "_breaks", "_marked"),
        "us.bank_account": lambda o: bank_account(o, "_all", "_breaks"),
        "us.phone": lambda o: us_phone(o, text, "_all"),
        "us.address": lambda o: us_address(o, text, "_all"),
        "us.name": lambda o: us_name(o, text, "_all"),
    }
    for d in chosen:
        if d in makers:
            out = f"_d{d[3:]}"
            run(found, out, lambda d=d, out=out: makers[d](out))
    df = run_stages(df, stages, keep, attempts + found)
    joined = (F.concat(*attempts) if attempts else empty(ATTEMPTS)).cast(ATTEMPTS)
    df = df.select(*keep, *found, joined.alias("us_attempts"))
    arrays = [F.col(n) for n in found] + [accepted_findings(F.col("us_attempts"), text)]
    return df.select(*keep, "us_attempts", F.concat(*arrays).alias("us_findings"))


def arbitrate_tax_family(out: str, attempts: str) -> Stages:
    """Winners of arbitrary accepted attempts: kind order first, then position; overlapped losers are superseded.

    The result is ``array<ATTEMPT>`` with the outcome set; rejected attempts pass through.
    """
    kind = lambda a: dims.lookup(TAX_KINDS, a["detector_id"], "int")
    ok, won = f"{out}_ok", f"{out}_won"
    yield {ok: F.array_distinct(F.filter(attempts, lambda a: a["outcome"] == "Accepted"))}
    yield from resolve_stages(
        won, F.col(ok), ATTEMPT, lambda a: [kind(a), a["start"], a["len"], a["evidence"], a["canonical"]]
    )
    lost = F.transform(F.array_except(ok, won), lambda a: a.withField("outcome", F.lit("Superseded")).cast(ATTEMPT))
    rest = F.filter(attempts, lambda a: a["outcome"] != "Accepted")
    yield {out: F.array_sort(F.concat(F.col(won), lost, rest))}
