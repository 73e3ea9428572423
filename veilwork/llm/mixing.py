"""Mixing sources to target weights by weighted fair queueing.

Each source sends its documents in shuffled order, as often as ``max_repeats`` times over.  A copy of a document is
finished at the virtual time *words its source has sent by then / target of the source*, so that all sources reach their
targets at time 1.  All copies are laid in the order of their finish times by a range sort, and the mix takes them until
the budget, which is the number of all words, is used up; the one copy that crosses it gives the words that are left.

Both running sums (words of a source, words of the mix) are scans over ranges (``operators.history``): a source that
holds most documents, and the one global order, are spread over all tasks.  The driver sees a few numbers a round and
the one row at the cut.  Texts are read once, to count their words, and are never shuffled.

Defined cases.  A null or empty text has no words, takes part in nothing and gets ``taken`` 0.  The null source is one
of its own and comes last; the empty string is another, and comes first.  Repeated ids are documents of their own; equal
rows are interchangeable.  Long texts are counted whole, in the JVM.  Without words every target is 0.  Without rows
there is no result row.  Other columns of the input play no part and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.history import carry
from .common import stored

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixRules:
    """``weights`` go round over the sources in code-point order; no document is taken more than ``max_repeats`` times."""

    weights: tuple[int, ...] = (1, 2, 3)
    max_repeats: int = 3
    seed: str = "mix"


def targets(sources: DataFrame, rules: MixRules) -> DataFrame:
    """Add ``rank`` (from 0) and ``target`` to ``sources(source, source_size)``.

    Shares are dealt by weight; a source whose share is above ``max_repeats`` times its size keeps that much, and what is
    over goes to the others by weight, until none is above.  Each round is one sum over the table of sources.
    """
    ranked = carry(sources.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"],
                   {"rank": ("sum", F.lit(1).cast("long"))}, lambda df: stored(df, "sources"))
    cycle = F.array(*(F.lit(w) for w in rules.weights))
    ranked = ranked.drop("_last").withColumn("rank", F.col("rank") - 1)
    ranked = ranked.withColumn("_w", F.element_at(cycle, (F.col("rank") % len(rules.weights)).cast("int") + 1).cast("long"))
    ranked = stored(ranked.withColumn("_most", rules.max_repeats * F.col("source_size")), "ranked")
    left, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    total, n_full = left, 0
    while True:
        share = (F.lit(left) * F.col("_w")).cast("double") / F.lit(float(weight or 1))
        full = share > F.col("_most")
        used, rest, n = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0)),
                                   F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0)), F.count_if(full)).first()
        if n == n_full or not rest:
            return ranked.withColumn("target", F.when(full, F.col("_most").cast("double")).otherwise(share)).drop("_w", "_most")
        left, weight, n_full = total - used, rest, n


def _finish(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("_sent")).cast("double") / F.col("target")


def mix(docs: DataFrame, rules: MixRules = MixRules(), id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``(id, size, source_size, target, taken, finish)`` of each document; ``finish`` is the time of its first copy."""
    sized = docs.select(
        F.col(f"`{id}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    place = F.md5(F.concat(F.lit(rules.seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    sent = carry(sized.withColumn("_place", place), ["source"], ["_place", "id", "size"], {"_sent": ("sum", F.col("size"))},
                 lambda df: stored(df, "shuffled"))
    sent = stored(sent.drop("_place"), "sent")
    about = targets(sent.groupBy("source").agg(F.sum("size").alias("source_size")), rules).withColumnRenamed("source", "_source")
    placed = stored(sent.join(about, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"), "placed")
    budget = sent.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    key = ["finish", "rank", "epoch", "_sent"]
    copies = placed.where("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(rules.max_repeats - 1))))
    line = carry(copies.withColumn("finish", _finish(F.col("epoch"))).select(*key, "size"), [], key,
                 {"total": ("sum", F.col("size"))}, lambda df: stored(df, "copies"))
    cut = line.where(F.col("total") >= budget).agg(F.min(F.struct("total", *key, "size")).alias("cut")).first()["cut"]
    taken = F.lit(0).cast("long")
    if cut is not None:
        last = F.struct(F.lit(cut["finish"]), F.lit(cut["rank"]).cast("long"), F.lit(cut["epoch"]), F.lit(cut["_sent"]).cast("long"))
        part = cut["size"] - (cut["total"] - budget)
        for e in range(rules.max_repeats):
            here = F.struct(_finish(F.lit(e)), F.col("rank"), F.lit(e), F.col("_sent"))
            taken = taken + F.when(here < last, F.col("size")).when(here == last, F.lit(part).cast("long")).otherwise(F.lit(0))
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0)).cast("long")
    finish = F.when((F.col("size") > 0) & (F.col("target") > 0), _finish(F.lit(0)))
    return placed.select("id", "size", "source_size", "target", taken.alias("taken"), finish.alias("finish"))


def mixed(docs: DataFrame, rules: MixRules = MixRules(), id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, in the order of their finish times.

    The copy at the cut holds its first words only, joined by blanks.  Ids must be unique.
    """
    found = mix(docs, rules, id, source, text).where("taken > 0")
    size, taken = F.col("_size"), F.col("_taken")
    found = found.select(F.col("id").alias("_id"), F.col("size").alias("_size"), F.col("taken").alias("_taken"), F.col("finish").alias("_finish"),
                         (F.col("source_size") / F.col("target")).alias("_lap"))
    rows = docs.join(found, F.col(f"`{id}`").eqNullSafe(F.col("_id")))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((taken - 1) / size))))
    left = taken - F.col("_copy") * size
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({WORD})"), F.lit(1))
    rows = rows.withColumn(text, F.when(left < size, F.array_join(F.slice(words, F.lit(1), left.cast("int")), " ")).otherwise(F.col(f"`{text}`")))
    rows = rows.withColumn("_at", F.col("_finish") + F.col("_copy") * F.col("_lap"))
    return rows.repartitionByRange("_at").sortWithinPartitions("_at").select(*(f"`{c}`" for c in docs.columns))
