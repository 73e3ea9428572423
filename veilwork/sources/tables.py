"""Inputs: text tables and streams, HTML cells, reference lists and policy lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import dims
from ..functions.spans import Stages, fence, prefix_scan, run_stages, running_max, running_sum

ADDABLE_TYPES = ["Phone", "Email"]


# --- texts -----------------------------------------------------------------------------------


def text_source(df: DataFrame, kind: str, key: list[str], text: str) -> DataFrame:
    """A table as scan input: ``(kind, doc_key, text)``; the key columns are joined by a slash."""
    doc_key = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    return df.select(F.lit(kind).alias("kind"), doc_key.alias("doc_key"), F.col(text).alias("text"))


def stream_source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A directory of parquet files as a stream of changes; the trigger size bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


# The entities of published tables.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "nbsp": " ", "amp": "&"}


def cell_text(markup: Column) -> Column:
    """Text of a piece of markup: a tag counts as a blank, entities are read once, runs of white space are one blank.

    The markup is cut before every entity; a piece then begins with at most one, so nothing is read twice.
    """
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    bare = F.regexp_replace(markup, "<[^<>]*+>", " ")

    def read(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^&(#?[0-9a-z]+);", 1)
        rest = F.substring(piece, F.length(name) + 3, F.length(piece))
        return F.coalesce(F.concat(named[name], rest), piece)

    words = F.split(F.array_join(F.transform(F.split(bare, "(?=&)"), read), ""), r"\s+")
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def html_cells(df: DataFrame, key: str, html: str, tags: list[str] = ("td", "th")) -> DataFrame:
    """Cells of the given tags, in order: ``(key, tag, pos, cell)``."""
    def cells(tag: str) -> Column:
        found = F.regexp_extract_all(F.col(html), F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
        return F.transform(found, lambda c, i: F.struct(F.lit(tag).alias("tag"), i.alias("pos"), c.alias("cell")))

    rows = df.select(key, F.inline_outer(F.concat(*[cells(t) for t in tags])))
    return rows.where(F.col("tag").isNotNull()).withColumn("cell", cell_text(F.col("cell")))


def html_tables(df: DataFrame, key: str, html: str) -> DataFrame:
    """Rows of all tables of a page: ``(key, table, row, cells)``; other columns are dropped.

    The tags of tables, rows and cells are read once, as an automaton with a stack: the depth of a tag is the number of
    tables open there, and what stands at one depth belongs to the table that was opened there last.  Tables are numbered
    by their opening tags, nested ones too, whose text is no part of the cell around them.  A cell ends at the next cell
    or row of its table, a row at the next row, a table where the page ends, whether they are closed or not; an end tag
    without a beginning is passed over; cells before the first row form a row.  Comments, scripts and styles are left out.
    A page without a table gives no rows, nor does a null.
    """
    tag = r"(?i)<(/?(?:table|tr|td|th))(?=[\s>/])[^>]*+>"
    shown = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)", " ")
    event = "struct<level:int,pos:int,name:string,no:int,text:string>"

    def stages() -> Stages:
        yield {"_tags": F.transform(F.regexp_extract_all("_shown", F.lit(tag), F.lit(1)), F.lower), "_texts": F.split("_shown", tag, -1)}
        step = lambda x: F.when(x == "table", 1).when(x == "/table", -1).otherwise(0)
        yield {"_steps": F.transform("_tags", step), "_opens": F.transform("_tags", lambda x: (x == "table").cast("int"))}
        yield {"_sum": running_sum(F.col("_steps")), "_no": running_sum(F.col("_opens"))}
        total = lambda i: F.get("_sum", i) + F.get("_steps", i)
        # end tags too many leave the depth at nothing: the sum less its lowest value so far
        yield {"_low": prefix_scan(F.transform("_steps", lambda x, i: total(i)), lambda x, y: F.least(x, y), 0), "_all": F.transform("_steps", lambda x, i: total(i))}
        depth = lambda i: F.get("_all", i) - F.least(F.lit(0), F.get("_low", i), F.get("_all", i))
        yield {"_events": F.array_sort(F.transform("_tags", lambda x, i: F.struct(
            depth(i).cast("int").alias("level"), i.alias("pos"), x.alias("name"), F.get("_no", i).alias("no"), F.get("_texts", i + 1).alias("text")).cast(event)))}
        is_ = lambda *names: lambda x: x["name"].isin(*names)
        mark = lambda test: F.transform("_events", lambda x, i: F.when(test(x), i).otherwise(F.lit(-1)))
        count = lambda test: F.transform("_events", lambda x: test(x).cast("int"))
        yield {"_mt": mark(is_("table")), "_mr": mark(is_("table", "tr")), "_mc": mark(is_("table", "tr", "td", "th", "/td", "/th", "/tr")),
               "_nr": count(is_("tr")), "_nc": count(is_("td", "th"))}
        yield {"_t": running_max(F.col("_mt")), "_r": running_max(F.col("_mr")), "_c": running_max(F.col("_mc")),
               "_rows": running_sum(F.col("_nr")), "_cells": running_sum(F.col("_nc"))}
        last = lambda found, marks, i: F.greatest(F.get(found, i), F.get(marks, i))

        def piece(x: Column, i: Column) -> Column:
            table, row, state = last("_t", "_mt", i), last("_r", "_mr", i), last("_c", "_mc", i)
            upto = lambda sums, ones, j: F.get(sums, j) + F.get(ones, j)
            number = upto("_rows", "_nr", i) - F.get("_rows", table)  # 0: before the first row tag of the table
            cell = upto("_cells", "_nc", i) - upto("_cells", "_nc", row)
            inside = (x["level"] > 0) & (table >= 0) & F.get("_events", state)["name"].isin("td", "th")
            return F.when(inside, F.struct(F.get("_events", table)["no"].alias("table"), number.alias("row"), cell.alias("cell"), x["pos"].alias("pos"), x["text"].alias("text")))

        yield {"_pieces": F.filter(F.transform("_events", piece), lambda x: x.isNotNull())}

    pieces = run_stages(df.select(F.col(key), shown.alias("_shown")), [stages()], [key], ["_pieces"])
    rows = fence(pieces, [key], ["_pieces"]).select(key, F.inline("_pieces"))
    cells = rows.groupBy(key, "table", "row", "cell").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("markup"))
    rows = cells.groupBy(key, "table", "row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell", cell_text(F.col("markup")).alias("text")))), lambda x: x["text"]).alias("cells"))
    first = F.min("row").over(Window.partitionBy(key, "table"))
    return rows.select(key, "table", (F.col("row") - F.when(first == 0, 0).otherwise(1)).alias("row"), "cells")


def html_table_rows(df: DataFrame, key: str, html: str, index: int) -> DataFrame:
    """``(key, row, cells)`` of the ``index``-th table of each page; a page without that table gives no rows."""
    return html_tables(df, key, html).where(F.col("table") == index).select(key, "row", "cells")


# --- reference lists -------------------------------------------------------------------------


def read_area_code_file(spark: SparkSession, path: str) -> DataFrame:
    """A published area-code file: a header row, then one row per code."""
    return spark.read.option("header", True).csv(path)


def area_code_list(assignments: DataFrame) -> DataFrame:
    """General-purpose US codes in service as ``'NPA JURISDICTION'`` records, sorted."""
    kept = assignments.where("COUNTRY = 'US' and USE = 'G' and IN_SERVICE = 'Y'")
    return kept.select(F.concat_ws(" ", "NPA_ID", "LOCATION").alias("record")).distinct().orderBy("record")


def token_list(table_rows: DataFrame, columns: list[str]) -> DataFrame:
    """Every token of several columns once, sorted (primary names, common forms, abbreviations)."""
    tokens = table_rows.select(F.explode(F.array(*columns)).alias("record"))
    return tokens.where(F.col("record").rlike("^[A-Z]{2,}$")).distinct().orderBy("record")


# Outcomes of checking a reference list, in the order of the checks.
VALID = "SnapshotValid"
LIST_STATES = {
    "metadata": "SnapshotBuildFailureMissingMetadata",
    "version": "SnapshotBuildFailureUnsupportedVersion",
    "hash": "SnapshotBuildFailureHashMismatch",
    "records": "SnapshotBuildFailureDuplicateOrInvalidNormalizedRecord",
    "count": "SnapshotBuildFailureCountMismatch",
}


def read_list_files(spark: SparkSession, path: str) -> DataFrame:
    """List files whole, with their bytes: ``(list_id, content)``."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    return files.select(name.alias("list_id"), F.col("content").cast("string").alias("content"))


def list_records(content: Column) -> Column:
    unified = F.regexp_replace(content, "\r\n|\r", "\n")
    return F.filter(F.split(unified, "\n", -1), lambda r: r != "")


def validate_lists(contents: DataFrame, manifest: DataFrame) -> DataFrame:
    """State of each list against its manifest row; the first failing check names it."""
    m = manifest.select(
        "list_id", "version", "source_url", "retrieved_on", "record_count", F.col("sha256").alias("expected_sha256")
    )
    df = contents.join(m, "list_id", "left")
    records = list_records(F.col("content"))
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    incomplete = (
        blank("version") | blank("source_url") | F.col("retrieved_on").isNull() | F.col("record_count").isNull()
        | (F.col("record_count") < 0) | blank("expected_sha256")
    )
    padded = F.exists(records, lambda r: r.rlike(r"^[\s\x{85}\p{Z}]|[\s\x{85}\p{Z}]$"))
    broken = (
        (F.col("content") == "") | ~F.col("content").rlike(r"[\r\n]\z") | padded
        | (F.size(records) != F.size(F.array_distinct(records)))
    )
    state = (
        F.when(incomplete, LIST_STATES["metadata"])
        .when(F.col("version") != "1", LIST_STATES["version"])
        .when(F.lower(F.sha2("content", 256)) != F.lower("expected_sha256"), LIST_STATES["hash"])
        .when(broken, LIST_STATES["records"])
        .when(F.size(records) != F.col("record_count"), LIST_STATES["count"])
        .otherwise(VALID)
    )
    return df.select("list_id", state.alias("state"), F.size(records).alias("n_records"))


def scope_issues(ref_lists: DataFrame, required: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Coverage problems of lists: required codes that are missing, codes not allowed, codes listed twice.

    ``ref_lists(list_id, code, record)``, ``required(list_id, code)``, ``allowed(list_id, code)``; a list
    with any row here is not usable.
    """
    present = ref_lists.select("list_id", "code").distinct()
    missing = required.join(present, ["list_id", "code"], "left_anti").withColumn("issue", F.lit("missing"))
    extra = present.join(required if allowed is None else allowed, ["list_id", "code"], "left_anti").withColumn(
        "issue", F.lit("not allowed")
    )
    twice = (
        ref_lists.select("list_id", "code", "record").distinct().groupBy("list_id", "code").count()
        .where("count > 1").select("list_id", "code", F.lit("duplicate").alias("issue"))
    )
    return missing.unionByName(extra).unionByName(twice).distinct()


# --- policy lists ----------------------------------------------------------------------------


def policy_entries(entries: DataFrame) -> DataFrame:
    """Entries ``(pii_type, value)`` with a known type; others are dropped."""
    known = dims.pii_types(entries.sparkSession).select("pii_type")
    return entries.join(known, "pii_type", "left_semi").select("pii_type", "value")


def exception_upsert(entries: DataFrame, added: DataFrame) -> DataFrame:
    """Add entries once; only phone and e-mail values may be added."""
    return entries.unionByName(added.where(F.col("pii_type").isin(ADDABLE_TYPES))).distinct()


def exception_delete(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """Remove entries by exact (type, value)."""
    return entries.join(removed.select("pii_type", "value").distinct(), ["pii_type", "value"], "left_anti")


def exception_reset(entries: DataFrame) -> DataFrame:
    return entries.where(F.lit(False))


# --- gates -----------------------------------------------------------------------------------


def source_allowlist(docs: DataFrame, allowed: DataFrame, source: str = "source") -> DataFrame:
    """Add ``scan_status``: rows of a source that is not listed are "not_scanned", never clean."""
    listed = allowed.select(source).distinct().withColumn("_ok", F.lit(True))
    status = F.when(F.col("_ok"), "scanned").otherwise("not_scanned")
    return docs.join(listed, source, "left").withColumn("scan_status", status).drop("_ok")


def country_gate(tenants: DataFrame, choices: DataFrame, lists_usable: DataFrame) -> DataFrame:
    """Gate and scope of a country pack per tenant.

    ``choices(tenant, kind, state, revision)``: the latest revision of kind "activation" opens the gate
    (Unavailable / NotSelected / Unverifiable / OptedIn); once open, only a latest "setting" that is an
    authenticated Off stops the pack, a missing or damaged one does not.
    """
    latest = choices.groupBy("tenant", "kind").agg(F.max_by("state", "revision").alias("state"))
    by_kind = lambda k: latest.where(F.col("kind") == k).select("tenant", F.col("state").alias(k))
    df = (
        tenants.join(by_kind("activation"), "tenant", "left").join(by_kind("setting"), "tenant", "left")
        .join(lists_usable, "tenant", "left")
    )
    activation = F.coalesce("activation", F.lit("Missing"))
    gate = (
        F.when(~F.coalesce("usable", F.lit(False)), "Unavailable")
        .when(activation == "On", "OptedIn")
        .when(activation == "Missing", "NotSelected")
        .otherwise("Unverifiable")
    )
    off = F.coalesce(F.col("setting") == "Off", F.lit(False))
    return df.select("tenant", gate.alias("gate"), ((gate == "OptedIn") & ~off).alias("in_scope"))


def in_country_scope(findings: DataFrame, gates: DataFrame, country: str) -> DataFrame:
    """Keep a country's findings only for tenants in scope; findings of no country always stay."""
    owned = [d for d, _, _, c, _ in dims.DETECTORS if c == country]
    open_tenants = gates.where("in_scope").select("tenant")
    mine = F.col("detector_id").isin(owned)
    return findings.where(~mine).unionByName(findings.where(mine).join(open_tenants, "tenant", "left_semi"))


def invalid_findings(findings: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings outside their text or outside the closed domains, with the violation.

    Only text lengths travel to the join, never the texts.
    """
    sizes = docs.select(key, F.length("text").alias("_n"))
    c = F.col
    bad_span = (c("start") < 0) | (c("len") <= 0) | (c("start") > c("_n")) | (c("len") > c("_n") - c("start"))
    bad_domain = (
        ~c("risk").between(1, 3) | ~c("conf").between(1, 3) | ~c("evidence").between(0, 7)
        | ~c("pii_type").isin(list(dims.TYPE_ORD)) | ~c("detector_id").rlike(dims.DETECTOR_ID_PATTERN)
    )
    violation = F.when(c("_n").isNull() | bad_span, "InvalidCandidateSpan").when(bad_domain, "InvalidValueDomain")
    return findings.join(sizes, key, "left").withColumn("violation", violation).where("violation is not null").drop("_n")


def first_violation(invalid: DataFrame, key: str = "doc_id") -> DataFrame:
    """The reported violation of each document: smallest start, then smallest length."""
    return invalid.groupBy(key).agg(F.min_by("violation", F.struct("start", "len")).alias("violation"),
                                    F.min(F.struct("start", "len")).alias("span"))


def require_detectors(required: list[str], ready: DataFrame) -> None:
    """Fail before the scan when a required detector is not ready; a smaller scan never looks clean."""
    wanted = ready.sparkSession.createDataFrame([(d,) for d in required], "detector_id string")
    absent = wanted.join(ready.where("state = 'Ready'"), "detector_id", "left_anti")
    missing = sorted({r["detector_id"] for r in absent.collect()})  # at most the detectors asked for
    if missing:
        raise ValueError("required detectors are not ready: " + ", ".join(missing))
