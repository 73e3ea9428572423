"""Span kernel: match offsets, prefix scans, interval islands, greedy choice and rewriting.

Spark has no function that returns every match position.  ``find_all`` gets them with a
single regex pass: it wraps each match in control characters, splits on them, and turns
segment lengths into offsets with a prefix scan.  All offsets are 0-based code points.

The array folds below work on blocks, so a text with very many matches costs about
n^(4/3) instead of n^2.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Sequence

from typing import Any
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, NEUTRAL = "\u0001", "\u0002", "\u0003"
BLOCK = 128

FINDING = (
    "struct<start:int,len:int,type_ord:int,pii_type:string,detector_id:string,canonical:string,surface:string,"
    "risk:int,conf:int,rank:int,evidence:int,owner_claim:boolean>"
)
FINDINGS = f"array<{FINDING}>"


# goes with its context: after a restart nothing of the old one is found again
_MADE: WeakKeyDictionary[SparkContext, dict[tuple, Any]] = WeakKeyDictionary()


def memo(make: Callable[[], Any], *key) -> Any:
    """Make an expression once per session.  ``key`` names it and the columns it reads.

    Large expressions take longer to create than to run; they only refer to columns by name.
    """
    made = _MADE.setdefault(SparkContext._active_spark_context, {})
    if key not in made:
        made[key] = make()
    return made[key]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A column of an earlier stage that a lambda reads needs it as well: the optimizer writes a column that is named once
    into the place where it is read, and there the whole of it is computed again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def empty(array_type: str) -> Column:
    return F.array().cast(array_type)


def at(arr: Column, index: Column) -> Column:
    """0-based element, NULL outside."""
    return F.get(arr, index)


def clean_markers(text: str) -> str:
    """SQL text with the two control characters ``find_all`` uses neutralised; the length does not change."""
    return f"if(rlike({text}, '[{OPEN}{SEP}]'), translate({text}, '{OPEN}{SEP}', '{NEUTRAL * 2}'), {text})"


def ascending(items: Column) -> Column:
    """Items without nulls, sorted.  ``array_sort`` gives the same order, but runs a lambda for each comparison."""
    return F.sort_array(items)


def _fold(arr: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running values of ``op`` from ``zero`` on: one more than items, the last one over all of them."""
    first = F.array(F.lit(zero)).cast("array<int>")
    return F.aggregate(arr, first, lambda s, x: F.array_append(s, op(F.element_at(s, -1), x)).cast("array<int>"))


def prefix_scan(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """Exclusive prefix scan of an int array under an associative ``op`` with identity ``zero``."""

    def blocked(arr: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / BLOCK).cast("int")),
            lambda b: _fold(F.slice(arr, b * BLOCK + 1, BLOCK), op, zero),
        )
        return let(
            blocks,
            lambda bs: let(
                _fold(F.transform(bs, lambda b: F.element_at(b, -1)), op, zero),
                lambda heads: F.flatten(
                    F.transform(bs, lambda b, i: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda v: op(at(heads, i), v)))
                ),
            ),
        )

    return let(
        values,
        lambda arr: F.when(F.size(arr) <= BLOCK, F.slice(_fold(arr, op, zero), F.lit(1), F.size(arr))).otherwise(blocked(arr)),
    )


def running_sum(values: Column) -> Column:
    return prefix_scan(values, lambda a, b: a + b, 0)


def running_max(values: Column) -> Column:
    return prefix_scan(values, lambda a, b: F.greatest(a, b), -1)


def sql_text(s: str) -> str:
    """A string as a SQL literal."""
    escaped = s.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _let_sql(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running_sum_sql(arr: str) -> str:
    """``running_sum`` of the SQL array ``arr``, as SQL."""

    def fold(values: str, v: str) -> str:
        # one more than values: the last one is the sum of all
        return f"aggregate({values}, cast(array(0) as array<int>), ({v}, {v}x) -> cast(array_append({v}, element_at({v}, -1) + {v}x) as array<int>))"

    blocks = (
        f"transform(sequence(0, cast(floor((size(rs_a) - 1) / {BLOCK}) as int)), "
        f"rs_b -> {fold(f'slice(rs_a, rs_b * {BLOCK} + 1, {BLOCK})', 'rs_s')})"
    )
    joined = _let_sql(
        fold("transform(rs_bs, rs_x -> element_at(rs_x, -1))", "rs_h"),
        "rs_heads",
        "flatten(transform(rs_bs, (rs_y, rs_i) -> transform(slice(rs_y, 1, size(rs_y) - 1), rs_v -> get(rs_heads, rs_i) + rs_v)))",
    )
    return _let_sql(
        arr, "rs_a", f"if(size(rs_a) <= {BLOCK}, slice({fold('rs_a', 'rs_t')}, 1, size(rs_a)), {_let_sql(blocks, 'rs_bs', joined)})"
    )


def find_all(text: str, pattern: str, groups: Sequence[int] = (), ctx: int = 0, reach: int = 2) -> Column:
    """All non-overlapping matches, left to right, in the SQL string expression ``text``.

    Gives ``array<struct<start,text,groups,before,after>>``.  ``before`` and ``after`` are the
    ``ctx`` characters around the match; ``reach`` is how many neighbouring matches they may
    run across, so ``reach`` times the shortest match must be at least ``ctx``.
    ``text`` must be free of the marker characters (see ``clean_markers``).

    Written as one SQL expression: the same tree built call by call takes far longer to create.
    """
    refs = "".join(f"{SEP}${g}" for g in groups)
    out_type = "array<struct<start:int,text:string,groups:array<string>,before:string,after:string>>"
    last = len(groups) + 1
    # element 0 holds the text before the first match; element i holds match, groups and the gap after it
    gap = lambda i: f"get(get(fa_ps, {i}), if({i} = 0, 0, {last}))"
    whole = lambda i: f"coalesce(if({i} > 0, concat(get(get(fa_ps, {i}), 0), {gap(i)}), if({i} = 0, {gap(i)}, '')), '')"
    lens = f"transform(fa_ps, (fa_p, fa_i) -> length(fa_p[0]) + if(fa_i = 0, 0, length(fa_p[{last}])))"
    before = after = "cast(null as string)"
    if ctx:
        back = ", ".join(whole(f"(fa_k - {d})") for d in range(reach, 0, -1))
        ahead = ", ".join([gap("fa_k")] + [whole(f"(fa_k + {d})") for d in range(1, reach + 1)])
        before, after = f"right(concat({back}), {ctx})", f"left(concat({ahead}), {ctx})"
    taken = f"slice(fa_q, 2, {len(groups)})" if groups else "cast(array() as array<string>)"
    rows = (
        f"slice(transform(fa_ps, (fa_q, fa_k) -> named_struct('start', get(fa_offs, fa_k), 'text', fa_q[0], "
        f"'groups', {taken}, 'before', {before}, 'after', {after})), 2, size(fa_ps))"
    )
    parts = f"transform(split(fa_m, '{OPEN}', -1), fa_s -> split(fa_s, '{SEP}', -1))"
    build = _let_sql(parts, "fa_ps", _let_sql(_running_sum_sql(lens), "fa_offs", rows))
    marked = f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(OPEN + '$0' + refs + SEP)})"
    return F.expr(
        _let_sql(marked, "fa_m", f"if(instr(fa_m, '{OPEN}') > 0, cast({build} as {out_type}), cast(array() as {out_type}))")
    )


def end_of(x: Column) -> Column:
    return x["start"] + x["len"]


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < end_of(b)) & (b["start"] < end_of(a))


# --- staged work -----------------------------------------------------------------------------
#
# Larger computations are written as stages: a generator yields dictionaries of named columns, each
# able to read the columns of the ones before.  ``run_stages`` runs several generators side by side,
# one projection per stage.  This keeps every single expression shallow (the analyzer resolves nested
# lambdas level by level) and shares intermediate arrays instead of computing them twice.

Stages = Generator[dict[str, Column], None, None]


def run_stages(df: DataFrame, stages: Sequence[Stages], keep: Sequence[str], out: Sequence[str]) -> DataFrame:
    live = list(stages)
    while live:
        new: dict[str, Column] = {}
        still = []
        for g in live:
            step = next(g, None)
            if step is not None:
                new.update(step)
                still.append(g)
        live = still
        if new:
            df = df.select("*", *[c.alias(n) for n, c in new.items()])
    return df.select(*keep, *out)


def fence(df: DataFrame, keep: Sequence[str], computed: Sequence[str]) -> DataFrame:
    """Keep filters on computed columns above the projections that compute them.

    The optimizer moves a filter below a projection by writing the whole expression into it, once per
    stage, which multiplies the work (and the plan) of every stage.  A one-row generator stops that.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*computed))))


def remembered(make: Callable[[], Stages], *key) -> Stages:
    """The same stages, made once per session (see ``memo``)."""
    yield from memo(lambda: list(make()), *key)


def one_stage(out: str, expression: Column) -> Stages:
    yield {out: expression}


def island_stages(name: str, items: Column) -> Stages:
    """Columns ``{name}_x`` (items by start), ``{name}_o`` (whether any two overlap) and ``{name}_b`` (bounds of their
    overlap islands, null when none do: then each item is an island).

    Intervals are connected exactly when they fall in one island, so islands are the connected
    components of the overlap graph.
    """
    x, o, r, h = f"{name}_x", f"{name}_o", f"{name}_r", f"{name}_h"
    yield {x: ascending(items)}
    # the end of the items so far, -1 once one starts before it
    clear = lambda stop, v: F.when((stop >= 0) & (v["start"] >= stop), F.greatest(stop, end_of(v))).otherwise(-1)
    yield {o: F.aggregate(x, F.lit(0), clear) < 0}
    yield {r: F.when(F.col(o), running_max(F.transform(x, end_of)))}
    yield {
        h: let(F.col(r), lambda reach: F.filter(
            F.transform(x, lambda v, i: F.when(v["start"] >= F.get(reach, i), i).otherwise(F.lit(-1))),
            lambda i: i >= 0,
        ))
    }
    yield {
        f"{name}_b": F.transform(
            h, lambda v, k: F.struct(v.alias("at"), (F.coalesce(F.get(F.col(h), k + 1), F.size(x)) - v).alias("n"))
        )
    }


def per_island(name: str, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to each island of ``island_stages``, joined; null when no items overlap."""
    return F.flatten(F.transform(f"{name}_b", lambda b: body(F.slice(F.col(f"{name}_x"), b["at"] + 1, b["n"]))))


def drop_overlapping(out: str, items: Column, guards: Column, item_type: str) -> Stages:
    """Interval anti-join inside the row: the items that overlap none of the guards."""
    tagged = f"array<struct<start:int,len:int,guard:boolean,item:{item_type}>>"

    def tag(arr: Column, guard: bool) -> Column:
        # guards are worth a look only when there are items
        some = F.when(F.size(items) == 0, F.slice(arr, 1, 0)).otherwise(arr) if guard else arr
        return F.transform(
            some, lambda x: F.struct(x["start"], x["len"], F.lit(guard), F.lit(None) if guard else x)
        ).cast(tagged)

    def keep(part: Column) -> Column:
        clear = lambda x: ~F.exists(part, lambda g: g["guard"] & overlaps(x, g))
        return F.filter(part, lambda x: ~x["guard"] & ((F.size(part) == 1) | clear(x)))

    yield from island_stages(out, F.concat(tag(items, False), tag(guards, True)))
    kept = F.when(F.col(f"{out}_o"), per_island(out, keep)).otherwise(F.filter(f"{out}_x", lambda x: ~x["guard"]))
    yield {out: F.transform(kept, lambda x: x["item"])}


def greedy(ordered: Column, item_type: str) -> Column:
    """Accept items in order unless they overlap an item already accepted."""
    arr = f"array<{item_type}>"
    return F.aggregate(
        ordered,
        empty(arr),
        lambda acc, x: F.when(F.exists(acc, lambda a: overlaps(a, x)), acc).otherwise(F.array_append(acc, x)).cast(arr),
    )


def resolve_stages(out: str, items: Column, item_type: str, strength: Callable[[Column], list[Column]]) -> Stages:
    """Winners among overlapping items: greedy inside each overlap island, strongest first.

    ``strength`` gives ascending sort keys.
    """

    def choose(part: Column) -> Column:
        ranked = ascending(
            F.transform(part, lambda f: F.struct(F.struct(*strength(f)).alias("k"), f.alias("f")))
        )
        return F.when(F.size(part) == 1, part).otherwise(greedy(F.transform(ranked, lambda r: r["f"]), item_type))

    yield from island_stages(out, items.cast(f"array<{item_type}>"))
    yield {out: F.when(F.col(f"{out}_o"), ascending(per_island(out, choose))).otherwise(F.col(f"{out}_x"))}


def rewrite(text: Column, edits: Column) -> Column:
    """Replace disjoint spans, given as ``array<struct<start,len,token>>`` sorted by start.

    Edits are taken in blocks and each block cuts its own stretch of text first, so that
    the per-edit substring does not walk the whole text.
    """

    def piece(chunk: Column, base: Column, es: Column, j: Column) -> Column:
        prev_end = F.when(j == 0, base).otherwise(end_of(at(es, j - 1)))
        e = at(es, j)
        return F.concat(F.substring(chunk, prev_end - base + 1, e["start"] - prev_end), e["token"])

    def block(t: Column, es: Column, b: Column) -> Column:
        lo = b * BLOCK
        base = F.when(b == 0, F.lit(0)).otherwise(end_of(at(es, lo - 1)))
        return let(
            F.slice(es, lo + 1, BLOCK),
            lambda part: let(
                F.struct(base.alias("base"), end_of(F.element_at(part, -1)).alias("stop")),
                lambda r: let(
                    F.substring(t, r["base"] + 1, r["stop"] - r["base"]),
                    lambda chunk: F.array_join(
                        F.transform(part, lambda _, j: piece(chunk, r["base"], part, j)), ""
                    ),
                ),
            ),
        )

    def body(t: Column, es: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(es) - 1) / BLOCK).cast("int")), lambda b: block(t, es, b)
        )
        last = end_of(F.element_at(es, -1))
        return F.concat(F.array_join(blocks, ""), F.substring(t, last + 1, F.length(t)))

    return let(edits, lambda es: F.when(F.size(es) == 0, text).otherwise(body(text, es)))


def to_raw(norm_span: Column, dropped: Column) -> Column:
    """Map a span of the normalised text to the raw text.

    ``dropped`` holds, for each dropped zero-width character, its position in normalised
    coordinates.  The span runs from its first to its last kept character, so dropped
    characters inside it are covered.
    """

    def raw(i: Column) -> Column:
        return i + F.size(F.filter(dropped, lambda d: d <= i))

    first, last = norm_span["start"], end_of(norm_span) - 1
    return let(
        F.struct(raw(first).alias("a"), raw(last).alias("b")),
        lambda r: F.struct(r["a"].alias("start"), (r["b"] - r["a"] + 1).alias("len")),
    )
