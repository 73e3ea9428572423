"""Labelled fields in key-value text, and properties of the line they are on.

One regular expression built from a label list finds every field of a text: label, up to three
spaces, an optional ``: # =``, up to three spaces, and a value up to a line end, ``;``, tab, ``|``
or the start of the next label.  Everything is an array column over the raw text.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.spans import Stages, clean_markers, empty, find_all, let, run_stages, running_max, running_sum
from ..functions.text import NEWLINE

MAX_FIELD = 96

FIELD = (
    "struct<label_start:int,label_len:int,label:string,role:string,val_start:int,val_len:int,value:string,"
    "separator:string,pre_sp:int,post_sp:int,terminator:string,state:string,in_word:boolean>"
)
FIELDS = f"array<{FIELD}>"


def _escape(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in s)


def label_pattern(labels: list[str]) -> str:
    """Alternation of the labels, longest first at every point.

    Labels that share a beginning share it in the pattern too, which keeps the search from
    trying every label at every character.
    """
    def build(tails: list[str]) -> str:
        if len(tails) == 1:
            return _escape(tails[0])
        heads: dict[str, list[str]] = {}
        for t in tails:
            if t:
                heads.setdefault(t[0].upper(), []).append(t)
        branches = []
        for group in heads.values():
            branches.append(_escape(group[0][0]) + build([t[1:] for t in group]))
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return f"(?:{body})?" if "" in tails else body

    return build(sorted(set(labels), key=lambda s: (s.upper(), s)))


def field_pattern(labels: list[str]) -> str:
    """Groups: 1 label, 2-5 spaces, separator, spaces, value; 6 or 7 mark four or more spaces."""
    one = label_pattern(labels)
    closed = [label for label in labels if label[-1] in ":#="]
    # a label ends a value where it starts a token, or inside a token when a separator follows it
    following = rf"(?<![A-Za-z0-9])(?:{one})|(?:{one})[:#=]"
    # a shorter label may carry the separator that the longest one at this point does not
    shorter = [s for s in labels if any(o != s and o.upper().startswith(s.upper()) for o in labels)]
    if shorter:
        following += rf"|(?:{'|'.join(_escape(s) for s in shorter)})[:#=]"
    if closed:
        following += "|" + "|".join(_escape(c) for c in closed)
    return (
        rf"(?i)({one})(?:( {{0,3}}+)(?! )([:#=]?+)( {{0,3}}+)(?! )((?:(?!{following})[^\r\n;\t|])*+)"
        rf"|(?=( {{4,}}))|(?=( {{0,3}}+[:#=] {{4,}})))"
    )


def label_words(labels: list[str]) -> list[str]:
    """Words of which every label holds at least one, in capitals."""
    longest = {max(re.findall("[A-Z0-9]+", label.upper()) or [label.upper()], key=len) for label in labels}
    return sorted(w for w in longest if not any(v != w and v in w for v in longest))


def role_of(label: Column) -> Column:
    pairs = {label_text.upper(): role for role, labels in dims.LABELS.items() for label_text in labels}
    return dims.lookup(pairs, label, "string")


def canonical_label(label: Column) -> Column:
    return dims.lookup({label_text.upper(): label_text for label_text in dims.ALL_LABELS}, label, "string")


def bind_fields(text: str, labels: list[str]) -> Column:
    """All fields of the text column, in order: ``array<FIELD>``."""

    def one(m: Column) -> Column:
        g = lambda i: F.get(m["groups"], F.lit(i - 1))
        pre_bad, post_bad = g(6) != "", g(7) != ""
        bad = pre_bad | post_bad
        size = F.length(m["text"])
        state = (
            F.when(pre_bad, "RejectedPreSeparatorSpaces")
            .when(post_bad, "RejectedPostSeparatorSpaces")
            .when(g(5) == "", "RejectedEmptyCandidate")
            .when(size > MAX_FIELD, "FieldRejectedOverMaxLength")
            .otherwise("FieldAccepted")
        )
        terminator = (
            F.when(bad | (m["after"] == ""), "EndOfText")
            .when(m["after"] == "\r", "Cr")
            .when(m["after"] == "\n", "Lf")
            .when(m["after"] == ";", "Semicolon")
            .when(m["after"] == "\t", "HorizontalTab")
            .when(m["after"] == "|", "VerticalBar")
            .otherwise("NextRecognizedLabel")
        )
        val_start = m["start"] + F.when(bad, F.length(g(1))).otherwise(size - F.length(g(5)))
        spaces_before = F.length(F.regexp_extract(g(7), "^( *)", 1))
        pre = F.when(pre_bad, F.length(g(6))).when(post_bad, spaces_before).otherwise(F.length(g(2)))
        post = F.when(post_bad, F.length(g(7)) - spaces_before - 1).otherwise(F.length(g(4)))
        tail = F.concat(g(2), g(3), g(4), g(5), F.when(bad, F.lit(" ")).otherwise(m["after"]))
        in_word = m["before"].rlike("[A-Za-z0-9]$") | tail.rlike("^[A-Za-z0-9]")
        key = F.upper(g(1))
        return F.struct(
            m["start"], F.length(g(1)), canonical_label(key), role_of(key), val_start, F.length(g(5)), g(5),
            F.when(~bad & (g(3) != ""), g(3)), pre, post, terminator, state, in_word,
        ).cast(FIELD)

    hits = find_all(clean_markers(text), field_pattern(labels), (1, 2, 3, 4, 5, 6, 7), 1, 1)
    # in capitals once for all words: the planner would write a derived text into each use
    some = let(F.upper(F.col(text)), lambda u: reduce(or_, [u.contains(word) for word in label_words(labels)], F.lit(False)))
    # most texts hold no word of a label, and finding that out is cheaper than searching for the labels
    return F.when(some, F.transform(hits, one)).otherwise(empty(FIELDS))


def trimmed(field: Column) -> Column:
    """The value without trailing spaces."""
    return F.regexp_replace(field["value"], " +$", "")


def read_labelled(fields: Column, roles: list[str]) -> Column:
    """Fields of the given roles whose label is not inside a word (accepted or not)."""
    return F.filter(fields, lambda f: f["role"].isin(roles) & ~f["in_word"])


def usable(field: Column) -> Column:
    return (field["state"] == "FieldAccepted") & (trimmed(field) != "")


def read_values(fields: Column, roles: list[str]) -> Column:
    return F.filter(read_labelled(fields, roles), usable)


def accepted_at_trimmed_end(field: Column) -> Column:
    """Accepted, or over the limit only because of trailing spaces."""
    end = field["val_start"] + F.length(trimmed(field))
    short = (field["state"] == "FieldRejectedOverMaxLength") & (end - field["label_start"] <= MAX_FIELD)
    return ((field["state"] == "FieldAccepted") | short) & (trimmed(field) != "")


# --- lines -----------------------------------------------------------------------------------


def line_breaks(text: str) -> Column:
    """Start offsets of line terminators."""
    return F.transform(find_all(clean_markers(text), NEWLINE), lambda m: m["start"])


def line_numbers(out: str, positions: Column, breaks: Column) -> Stages:
    """Line number of each position of an ascending int array: one merged sweep over positions and breaks."""
    events = "array<struct<at:int,kind:int>>"
    e, n = f"{out}_e", f"{out}_n"
    tag = lambda arr, kind: F.transform(arr, lambda p: F.struct(p, F.lit(kind))).cast(events)
    some_breaks = F.when(F.size(positions) > 0, breaks).otherwise(F.slice(breaks, 1, 0))
    yield {e: F.array_sort(F.concat(tag(some_breaks, 0), tag(positions, 1)))}
    yield {n: running_sum(F.transform(e, lambda x: 1 - x["kind"]))}
    yield {
        out: F.filter(
            F.transform(e, lambda x, i: F.when(x["kind"] == 1, F.get(F.col(n), i)).otherwise(F.lit(-1))), lambda k: k >= 0
        )
    }


def lines_in(out: str, lines: Column, marked: Column) -> Stages:
    """For each line number (ascending), whether it is one of the marked ones: a sweep again."""
    events = "array<struct<line:int,kind:int>>"
    e, m = f"{out}_e", f"{out}_m"
    tag = lambda arr, kind: F.transform(arr, lambda p: F.struct(p, F.lit(kind))).cast(events)
    some_marks = F.when(F.size(lines) > 0, marked).otherwise(F.slice(marked, 1, 0))
    yield {e: F.array_sort(F.concat(tag(some_marks, 0), tag(lines, 1)))}
    yield {m: running_max(F.transform(e, lambda x: F.when(x["kind"] == 0, x["line"]).otherwise(F.lit(-1))))}
    hit = "struct<kind:int,hit:boolean>"
    yield {
        out: F.transform(
            F.filter(
                F.transform(e, lambda x, i: F.struct(x["kind"], F.get(F.col(m), i) == x["line"]).cast(hit)),
                lambda x: x["kind"] == 1,
            ),
            lambda x: x["hit"],
        )
    }


def jurisdiction_pattern() -> str:
    names = "|".join(sorted(dims.JURISDICTION_NAMES, key=len, reverse=True))
    edge = r"[\p{L}\p{Nd}]"
    return rf"(?<!{edge})(?:(?i:{names})(?!{edge})|USA(?!{edge})|U\.S\.)"


def jurisdiction_marks(text: str, fields: Column) -> Column:
    """Ascending offsets that put their line under a US jurisdiction: names, or a bound two-letter code."""
    named = F.transform(find_all(clean_markers(text), jurisdiction_pattern()), lambda m: m["start"])
    codes = "|".join(dims.JURISDICTION_CODES)
    # the code may end the value; the character after it decides unless the value goes on
    bound = F.filter(
        read_labelled(fields, ["jurisdiction"]),
        lambda f: f["state"].isin("FieldAccepted", "FieldRejectedOverMaxLength")
        & f["value"].rlike(rf"^(?:{codes})(?![\p{{L}}\p{{Nd}}])")
        & ((f["val_len"] > 2) | ~f["terminator"].isin("NextRecognizedLabel"))
        & (f["val_start"] + 2 - f["label_start"] <= MAX_FIELD),
    )
    return F.array_sort(F.concat(named, F.transform(bound, lambda f: f["label_start"])))


def field_rows(docs: DataFrame, labels: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Field rows with their line number."""
    df = docs.select(key, text, bind_fields(text, labels).alias("_f"), line_breaks(text).alias("_b"))
    starts = F.transform("_f", lambda f: f["label_start"])
    df = run_stages(df, [line_numbers("_l", starts, F.col("_b"))], [key, "_f"], ["_l"])
    rows = df.select(key, F.inline_outer(F.zip_with("_f", "_l", lambda f, n: F.struct(f.alias("f"), n.alias("line")))))
    return rows.where(F.col("f").isNotNull()).select(key, "f.*", "line")


def line_jurisdiction(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Line rows ``(doc, line)`` that name a US jurisdiction."""
    df = docs.select(key, text, bind_fields(text, dims.ALL_LABELS).alias("_f"), line_breaks(text).alias("_b"))
    df = df.select(key, "_b", jurisdiction_marks(text, F.col("_f")).alias("_m"))
    df = run_stages(df, [line_numbers("_l", F.col("_m"), F.col("_b"))], [key], ["_l"])
    rows = df.select(key, F.explode_outer(F.array_distinct("_l")).alias("line"))
    return rows.where(F.col("line").isNotNull())
