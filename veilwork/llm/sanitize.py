"""Personal data with information-theoretic sanitisation, on DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, cards and phones; their values are the protected entities.  The corpus
then tells which other terms give an entity away: the terms of a document, wherever they stand, are counted with each of
its entities, and over all documents.  A term exceeds the disclosure thresholds when it is with one entity in at least
``min_contexts`` different texts (or different surroundings of ``reach`` characters, which only add evidence), the
chance of the entity given the term is ``min_posterior`` or more, and knowing the term raises it by ``min_bits`` bits.
Such terms are spans of kind ``term`` wherever they stand.  The parts of found values are no terms of their documents.

Texts are not shuffled, but those of documents that hold such a term.  Counts are pre-aggregated, so that an entity or
a term that many documents share is no hot group.

Spans count code points, end exclusive.  Defined results: a null text is empty; rows that share an id are told apart by
their texts; equal rows get equal results; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import clean_markers, find_all
from .common import fresh, stored

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = "A-Za-z0-9._%+-"
# Starting inside a run is only possible right after the match before; elsewhere it could only fail as its start did.
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Possessive groups are read in a loop; others call themselves once a repetition, and a long run of digits ends the JVM.
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
WORD = r"[\p{L}\p{M}\p{N}]+"
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
SPAN = "struct<start:int,kind:int,end:int>"


@dataclass(frozen=True)
class DisclosureRules:
    reach: int = 80  # characters on either side of an entity that are its surroundings
    min_letters: int = 3
    min_contexts: int = 3
    min_posterior: float = 0.5
    min_bits: float = 3.0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def base_hits(text: str) -> Column:
    """``array<struct<start,kind,end,value>>`` of the base patterns, by start, then kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def kind(i: int, test: str, pattern: str, ok, value) -> Column:
        hits = F.filter(find_all(text, pattern), lambda m: ok(m["text"]))
        found = F.transform(hits, lambda m: F.struct(
            m["start"].alias("start"), F.lit(i).alias("kind"), (m["start"] + F.length(m["text"])).alias("end"), value(m["text"]).alias("value")))
        return F.when(F.col(text).rlike(test), found).otherwise(none)

    size = lambda x: F.length(_digits(x))
    return F.array_sort(F.concat(
        kind(0, "@[A-Za-z0-9-]+[.]", EMAIL, lambda x: F.lit(True), F.lower),
        kind(1, r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", IP, lambda x: x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), lambda x: x),
        kind(2, "[0-9](?:[ -]?[0-9]){13}", CARD, lambda x: size(x).between(14, 19) & F.call_function("luhn_check", _digits(x)), _digits),
        kind(3, r"\+[0-9]", PHONE, lambda x: size(x).between(10, 15), _digits)))


def scan_base(docs: DataFrame, rules: DisclosureRules, key: str, text: str) -> DataFrame:
    """``(id, version, base, contexts, terms)``; a context is an entity with the terms near it.  ``terms`` are those of
    the whole text outside the found values, of texts with an entity only."""
    named = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    found = named.selectExpr("id", "xxhash64(text) as version", f"{clean_markers('text')} as text").withColumn("hits", base_hits("text"))

    def context(h: Column) -> Column:
        a = F.greatest(h["start"] - rules.reach, F.lit(0))
        before = F.substring(F.col("text"), a + 1, h["start"] - a)
        after = F.substring(F.col("text"), h["end"] + 1, F.lit(rules.reach))
        # words that the border cuts are left out
        before = F.when(a > 0, F.regexp_replace(before, r"^[\p{L}\p{M}\p{N}]+", "")).otherwise(before)
        words = F.split(F.lower(F.concat(before, F.lit(" "), F.regexp_replace(after, r"[\p{L}\p{M}\p{N}]+$", ""))), NOT_WORD)
        return F.struct(F.concat_ws(":", h["kind"], h["value"]).alias("entity"),
                        F.array_distinct(F.filter(words, lambda w: F.length(w) >= rules.min_letters)).alias("terms"))

    state = "struct<out:array<string>,done:int>"
    outside = F.aggregate(
        F.col("hits"), F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("done")).cast(state),
        lambda s, h: F.struct(
            F.when(h["start"] > s["done"], F.array_append(s["out"], F.substring(F.col("text"), s["done"] + 1, h["start"] - s["done"]))).otherwise(s["out"]).alias("out"),
            F.greatest(s["done"], h["end"]).alias("done")).cast(state),
        lambda s: F.concat_ws(" ", s["out"], F.substring(F.col("text"), s["done"] + 1, F.length("text"))))
    words = F.array_distinct(F.filter(F.split(F.lower(outside), NOT_WORD), lambda w: F.length(w) >= rules.min_letters))
    return found.select(
        "id", "version", F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["kind"].alias("kind"), h["end"].alias("end"))).cast(f"array<{SPAN}>").alias("base"),
        F.transform("hits", context).alias("contexts"), F.when(F.size("hits") > 0, words).alias("terms"))


def revealing_terms(docs: DataFrame, base: DataFrame, rules: DisclosureRules, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """``(term, entity, posterior, bits)`` beyond the thresholds, and the documents ``(id, version, term)`` they stand in."""
    contexts = base.select("id", "version", F.explode("contexts").alias("c")).select(
        "id", "version", "c.entity", "c.terms", F.xxhash64(F.array_sort("c.terms")).alias("context"))
    documents = base.select("id", "version").distinct().count()
    # bits = log2(both * documents / (n_term * n_entity)) and both is at most the smaller count, so neither count can be larger
    most = documents / 2.0 ** rules.min_bits
    entities = contexts.groupBy("entity", "id", "version").agg(F.count("*").alias("m")).groupBy("entity").agg(
        F.count("*").alias("n_entity"), F.sum("m").alias("mentions"))
    # with fewer mentions than contexts are asked for there is no support
    entities = stored(entities.filter((F.col("n_entity") <= most) & (F.col("mentions") >= rules.min_contexts)).select("entity", "n_entity"), "entities")
    words = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).select(
        "id", F.xxhash64("text").alias("version"), F.explode(F.array_distinct(F.split(F.lower("text"), NOT_WORD))).alias("term"))
    # the whole vocabulary is counted before it meets the candidates, so common words never fan out
    frequency = stored(words.groupBy("term").agg(F.count("*").alias("n_term")), "frequency")
    common = stored(frequency.filter(F.col("n_term") > most).select("term"), "common")  # at most 2 ** min_bits times the words of a text
    near = contexts.join(entities.select("entity"), "entity").select("entity", "id", "version", "context", F.explode("terms").alias("term"))
    whole = base.filter("terms is not null").select("id", "version", "terms", F.explode(F.array_distinct("contexts.entity")).alias("entity")).join(
        entities.select("entity"), "entity").select("entity", "id", "version", F.explode("terms").alias("term"))
    # equal texts and equal surroundings count once for support, so copies of one text support nothing; documents count for the odds
    together = near.drop("context").unionByName(whole).join(common, "term", "left_anti").distinct().groupBy("entity", "term", "version").agg(
        F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("texts"))
    different = stored(near.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).filter(
        F.col("contexts") >= rules.min_contexts), "different")
    pairs = stored(together.join(different, ["entity", "term"], "left").filter(
        (F.col("texts") >= rules.min_contexts) | F.col("contexts").isNotNull()).select("entity", "term", "both"), "pairs")
    scored = pairs.join(frequency, "term").join(entities, "entity").select(
        "term", "entity", (F.col("both") / F.col("n_term")).alias("posterior"),
        F.log2(F.col("both") * F.lit(float(documents)) / (F.col("n_term") * F.col("n_entity"))).alias("bits"))
    flagged = stored(scored.filter((F.col("posterior") >= rules.min_posterior) & (F.col("bits") >= rules.min_bits)), "flagged")
    # few terms are left; the size of their table decides how Spark joins it
    return flagged, words.join(flagged.select("term").distinct(), "term", "left_semi")


def sanitize(docs: DataFrame, rules: DisclosureRules = DisclosureRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, version, base, spans)``: base spans, and all spans with those of revealing terms, by start, then kind."""
    base = stored(scan_base(docs, rules, key, text), "base")
    _, standing = revealing_terms(docs, base, rules, text, key)
    terms = stored(standing.groupBy("id", "version").agg(F.collect_set("term").alias("terms")), "terms")
    named = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).select(
        "id", F.xxhash64("text").alias("version"), "text").distinct()
    marked = named.join(terms, ["id", "version"]).selectExpr("id", "version", "terms", f"{clean_markers('text')} as text")
    hits = F.filter(find_all("text", WORD), lambda m: F.array_contains(F.col("terms"), F.lower(m["text"])))
    extra = marked.select("id", "version", F.transform(hits, lambda m: F.struct(
        m["start"].alias("start"), F.lit(4).alias("kind"), (m["start"] + F.length(m["text"])).alias("end"))).cast(f"array<{SPAN}>").alias("extra"))
    return base.join(extra, ["id", "version"], "left").select(
        "id", "version", "base", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def report(docs: DataFrame, rules: DisclosureRules = DisclosureRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans of each row."""
    out = sanitize(docs, rules, key, text)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select("id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                      count(4).alias("n_term"), written(F.col("spans")).alias("spans"))


def generalise(docs: DataFrame, rules: DisclosureRules = DisclosureRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns: entities are replaced by their kind, revealing terms are removed (as ``[term]``).

    Only texts with a span are rewritten, and only they are shuffled.
    """
    spans = sanitize(docs, rules, key, text).filter(F.size("spans") > 0)
    i, v, s, mine = fresh(docs.columns, "id", "version", "spans", "mine")
    spans = spans.select(F.col("id").alias(i), F.col("version").alias(v), F.col("spans").alias(s)).distinct()
    source = docs.withColumn(mine, F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    joined = source.join(spans, F.col(f"`{key}`").eqNullSafe(F.col(i)) & (F.col(mine) == F.col(v)), "left")
    state = "struct<out:string,done:int>"
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    body = F.aggregate(
        F.col(s), F.struct(F.lit("").alias("out"), F.lit(0).alias("done")).cast(state),
        lambda a, x: F.when(x["start"] >= a["done"], F.struct(
            F.concat(a["out"], F.substring(F.col(f"`{text}`"), a["done"] + 1, x["start"] - a["done"]), F.get(names, x["kind"])).alias("out"),
            x["end"].alias("done"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["done"], x["end"]).alias("done"))).cast(state),
        lambda a: F.concat(a["out"], F.substring(F.col(f"`{text}`"), a["done"] + 1, F.length(F.col(f"`{text}`")))))
    clean = F.when(F.col(s).isNull(), F.col(f"`{text}`")).otherwise(body)
    return joined.select(*((clean if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns))
