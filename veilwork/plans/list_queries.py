"""Registered queries over sources, lists, gates, histories and streams (batch forms), with comparison SQL."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import scan_text
from ..operators import joins, reports
from ..operators.base_rules import gps_labelled_sides, nearest_pairs, scan_rule
from ..sources import sinks
from ..sources import tables as S
from ..streaming import jobs
from ..operators.us_rules import RefLists
from . import flagship
from . import oracle as O
from .decision_queries import SQL as DECISION_SQL
from .decision_queries import _adjusted_sql, spans
from .shape import new_folder
from .texts import case, documents, pad, sql_over, table, text_rows
from .us_queries import STAND_IN_PHONES

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- sources ---------------------------------------------------------------------------------
@query("text_source", """select 'documents' as kind, doc_id::varchar as doc_key, length(text) as n from documents
  union all select 'pages', page_id::varchar, length(html) from pages
  union all select 'conversations', conv_id::varchar || '/' || turn::varchar, length(text) from conversations""")
def text_source(spark, sf):
    t = lambda n: table(spark, sf, n)
    df = (
        S.text_source(t("documents"), "documents", ["doc_id"], "text")
        .unionByName(S.text_source(t("pages"), "pages", ["page_id"], "html"))
        .unionByName(S.text_source(t("conversations"), "conversations", ["conv_id", "turn"], "text"))
    )
    return df.select("kind", "doc_key", F.length("text").cast("bigint").alias("n"))


def _cells_sql(tag: str) -> str:
    clean = "regexp_replace(c, '<[^>]+>', ' ', 'g')"
    for e, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        clean = f"replace({clean}, '{e}', '{ch}')"
    return f"""select page_id, '{tag}' as tag, cast(i - 1 as integer) as pos, trim(regexp_replace({clean}, '\\s+', ' ', 'g')) as cell
      from (select page_id, unnest(cs) as c, unnest(range(1, len(cs) + 1)) as i from
        (select page_id, regexp_extract_all(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1) as cs from pages))"""


@query("html_text_source", " union all ".join(_cells_sql(t) for t in ("h1", "li", "p")))
def html_text_source(spark, sf):
    return S.html_cells(table(spark, sf, "pages"), "page_id", "html", ["h1", "li", "p"])


_page = ("concat('<table class=x><tr><th>id<th>', url, '</tr><tr><td>', page_id, '</td><td>a &amp; <b>b</b> <table><tr><td>in', page_id % 7, '</table> tail</td></table>', "
         "html, '</table></td><TABLE><td>z', page_id % 3, '<tr><td><!-- <td> -->y')")


@query("html_tables", """with u as (select page_id, 'in' || page_id % 7 as n, 'z' || page_id % 3 as z, trim(url) as url from pages)
  select page_id, 0 as "table", 0 as row, 'id|' || url as cells from u union all select page_id, 0, 1, page_id || '|a & b tail' from u
  union all select page_id, 1, 0, n from u union all select page_id, 2, 0, z from u union all select page_id, 2, 1, 'y' from u""")
def html_tables(spark, sf):
    pages = sql_over(spark, sf, "pages", "page_id", "url", f"{_page} as html")
    return S.html_tables(pages, "page_id", "html").select("page_id", "table", "row", F.array_join("cells", "|").alias("cells"))


_codes = "".join(dims.JURISDICTION_CODES)
_loc = f"substr('{_codes}', cast(c_nationkey as int) * 2 + 1, 2)"
_assigned = ["cast(200 + c_custkey % 800 as string) as NPA_ID", f"{_loc} as LOCATION", "case when c_custkey % 2 = 0 then 'US' else 'CA' end as COUNTRY",
             "case when c_custkey % 3 = 0 then 'N' else 'G' end as USE", "case when c_custkey % 5 = 0 then 'N' else 'Y' end as IN_SERVICE"]


@query("ref_list_build", f"""select 'us.npa' as list_id, cast(200 + c_custkey % 800 as varchar) || ' ' || {_loc} as record from customer
     where c_custkey % 2 = 0 and c_custkey % 3 <> 0 and c_custkey % 5 <> 0 group by all
   union all select 'words', w from (select unnest([upper(p_brand), upper(split_part(p_type, ' ', 1)), upper(split_part(p_type, ' ', 2))]) as w from part)
     where regexp_full_match(w, '[A-Z]{{2,}}') group by all""")
def ref_list_build(spark, sf):
    codes = S.area_code_list(sql_over(spark, sf, "customer", *_assigned)).withColumn("list_id", F.lit("us.npa"))
    parts = sql_over(spark, sf, "part", "upper(p_brand) as a", "upper(split_part(p_type, ' ', 1)) as b", "upper(split_part(p_type, ' ', 2)) as c")
    return codes.unionByName(S.token_list(parts, ["a", "b", "c"]).withColumn("list_id", F.lit("words")))


# each document is a list file: every fourth lacks the final line end, others break one manifest field
_content = "case when doc_id % 4 = 3 then text else text || chr(10) end"


@query("ref_list_validate", f"""
  with l as (select doc_id, {_content} as content, list_filter(string_split({_content}, chr(10)), lambda r: r <> '') as rs from documents)
  select doc_id::varchar as list_id, case when doc_id % 7 = 1 then '{S.LIST_STATES["metadata"]}' when doc_id % 7 = 2 then '{S.LIST_STATES["version"]}'
    when doc_id % 7 = 3 then '{S.LIST_STATES["hash"]}' when doc_id % 4 = 3 or len(rs) <> len(list_distinct(rs)) then '{S.LIST_STATES["records"]}'
    when doc_id % 7 = 4 then '{S.LIST_STATES["count"]}' else '{S.VALID}' end as state, cast(len(rs) as integer) as n_records from l""")
def ref_list_validate(spark, sf):
    files = documents(spark, sf).selectExpr("cast(doc_id as string) as list_id", f"{_content} as content", "doc_id")
    manifest = files.selectExpr(
        "list_id", "case when doc_id % 7 = 2 then '2' else '1' end as version", "case when doc_id % 7 = 1 then ' ' else 'https://example.org' end as source_url",
        "date'2024-01-01' as retrieved_on", "size(filter(split(content, chr(10)), r -> r <> '')) + case when doc_id % 7 = 4 then 1 else 0 end as record_count",
        "case when doc_id % 7 = 3 then 'ff' else upper(sha2(content, 256)) end as sha256")
    return S.validate_lists(files.drop("doc_id"), manifest)


@query("ref_scope_check", """
  with present as (select o_orderstatus as list_id, o_custkey as code, o_orderpriority as record from orders),
  required as (select s as list_id, c_custkey as code from customer, (select distinct o_orderstatus as s from orders) where c_custkey % 3 = 0)
  select list_id, code, 'missing' as issue from required r where not exists (select 1 from present p where p.list_id = r.list_id and p.code = r.code)
  union select list_id, code, 'not allowed' from present where code % 3 <> 0
  union select list_id, code, 'duplicate' from present group by list_id, code having count(distinct record) > 1""")
def ref_scope_check(spark, sf):
    lists = sql_over(spark, sf, "orders", "o_orderstatus as list_id", "o_custkey as code", "o_orderpriority as record")
    keys = sql_over(spark, sf, "customer", "c_custkey as code").where("code % 3 = 0")
    # the order status is one of three letters, so every key gets a handful of rows
    required = keys.select(F.explode(F.array(*[F.lit(s) for s in "FOP"])).alias("list_id"), "code")
    return S.scope_issues(lists, required)


# --- policy lists ----------------------------------------------------------------------------
_kinds = case("c_custkey", ["'Email'", "'Phone'", "'Nonsense'", "'UsSsn'"])


@query("policy_source", f"select {_kinds} as pii_type, c_name as value from customer where c_custkey % 4 <> 2")
def policy_source(spark, sf):
    return S.policy_entries(sql_over(spark, sf, "customer", f"{_kinds} as pii_type", "c_name as value"))


def _entries(spark, sf, where):
    return sql_over(spark, sf, "customer", f"{_kinds} as pii_type", "c_name as value", "c_custkey").where(where).drop("c_custkey")


@query("exception_upsert", f"""select {_kinds} as pii_type, c_name as value from customer where (c_custkey % 2 = 0 or (c_custkey % 3 = 0 and c_custkey % 4 < 2))""")
def exception_upsert(spark, sf):
    return S.exception_upsert(_entries(spark, sf, "c_custkey % 2 = 0"), _entries(spark, sf, "c_custkey % 3 = 0"))


@query("exception_delete", f"select {_kinds} as pii_type, c_name as value from customer where c_custkey % 2 = 0 and c_custkey % 3 <> 0")
def exception_delete(spark, sf):
    return S.exception_delete(_entries(spark, sf, "c_custkey % 2 = 0"), _entries(spark, sf, "c_custkey % 3 = 0"))


@query("exception_reset", "select count(*) as n, 0::bigint as n_after from customer")
def exception_reset(spark, sf):
    before = _entries(spark, sf, "true")
    after = S.exception_reset(before)
    both = before.withColumn("k", F.lit(0)).unionByName(after.withColumn("k", F.lit(1)))
    return both.agg(F.count_if(F.col("k") == 0).alias("n"), F.count_if(F.col("k") == 1).alias("n_after"))


# --- gates -----------------------------------------------------------------------------------
@query("source_allowlist_filter", """select doc_id, case when source in (select source from documents group by source having count(*) % 2 = 0) then 'scanned'
   else 'not_scanned' end as scan_status from documents""")
def source_allowlist_filter(spark, sf):
    docs = documents(spark, sf)
    allowed = docs.groupBy("source").count().where("count % 2 = 0").select("source")
    return S.source_allowlist(docs, allowed).select("doc_id", "scan_status")


_state = case("o_orderkey", ["'On'", "'Off'", "'Corrupt'"])


@query("country_scope_filter", f"""
  with ch as (select o_custkey as tenant, case when o_orderkey % 2 = 0 then 'activation' else 'setting' end as kind, {_state} as state, o_orderkey as revision from orders),
  l as (select tenant, kind, arg_max(state, revision) as state from ch group by all),
  g as (select c_custkey as tenant, case when c_custkey % 5 = 0 then 'Unavailable' when a.state = 'On' then 'OptedIn' when a.state is null then 'NotSelected' else 'Unverifiable' end as gate, s.state as setting
    from customer left join l a on a.tenant = c_custkey and a.kind = 'activation' left join l s on s.tenant = c_custkey and s.kind = 'setting')
  select tenant, gate, gate = 'OptedIn' and coalesce(setting, '') <> 'Off' as in_scope from g""")
def country_scope_filter(spark, sf):
    tenants = sql_over(spark, sf, "customer", "c_custkey as tenant")
    usable = sql_over(spark, sf, "customer", "c_custkey as tenant", "c_custkey % 5 <> 0 as usable")
    choices = sql_over(spark, sf, "orders", "o_custkey as tenant", "case when o_orderkey % 2 = 0 then 'activation' else 'setting' end as kind",
                       f"{_state} as state", "o_orderkey as revision")
    return S.country_gate(tenants, choices, usable)


@query("finding_validity_filter", f"""
  with f as (select o_orderkey as id, o_custkey as doc_id, {O.ints(start='o_orderkey % 3000 - 5', len='o_orderkey % 40', risk='o_orderkey % 4', conf=3, evidence=2)} from orders)
  select id, case when d.text is null or start < 0 or len <= 0 or start + len > length(d.text) then 'InvalidCandidateSpan' else 'InvalidValueDomain' end as violation
  from f left join documents d using (doc_id) where d.text is null or start < 0 or len <= 0 or start + len > length(d.text) or risk = 0""")
def finding_validity_filter(spark, sf):
    f = sql_over(spark, sf, "orders", "o_orderkey as id", "o_custkey as doc_id", "cast(o_orderkey % 3000 - 5 as int) as start", "cast(o_orderkey % 40 as int) as len",
                 "cast(o_orderkey % 4 as int) as risk", "3 as conf", "2 as evidence", "'Phone' as pii_type", "'kr.phone' as detector_id")
    return S.invalid_findings(f, documents(spark, sf)).select("id", "violation")


# --- joins -----------------------------------------------------------------------------------
_l1, _o1 = f"cast(p_partkey % 80 as string) || '.1'", f"cast(p_partkey % 170 as string) || '.2'"
_np_text = case("p_partkey", [
    f"'lat=' || {_l1} || ' lon=' || {_o1} || ' lat=' || {_l1} || ' lon=' || {_o1}", f"'lon=' || {_o1} || ' lat=' || {_l1} || ' lat=' || {_l1}",
    f"'lat=' || {_l1} || repeat('.', 41) || 'lon=' || {_o1}", f"'lat=' || {_l1} || repeat('.', 40) || 'lon=' || {_o1}",
])
_nl, _no = f"(4 + length({_l1}))", f"(4 + length({_o1}))"


@query("nearest_pair", " union all ".join(
    f"select p_partkey as doc_id, {O.ints(lat_start=a, lon_start=b)} from part where p_partkey % 4 = {k}" for k, a, b in [
        (0, "0", f"{_nl} + 1"), (0, f"{_nl} + {_no} + 2", f"2 * {_nl} + {_no} + 3"), (1, f"{_no} + 1", "0"), (3, "0", f"{_nl} + 40")]))
def nearest_pair(spark, sf):
    df = text_rows(spark, sf, "part", "p_partkey", _np_text).select("doc_id", F.inline_outer(nearest_pairs(gps_labelled_sides("text"))))
    return df.where("a is not null").select("doc_id", F.col("a.start").alias("lat_start"), F.col("b.start").alias("lon_start"))


@query("overlap_anti_join", f"""
  with s as (select l_orderkey as doc_id, l_linenumber, {O.ints(start='l_partkey % 200', len='l_quantity')} from lineitem)
  select * from s a where l_linenumber % 2 = 0 and not exists (select 1 from s b where b.doc_id = a.doc_id and b.l_linenumber % 2 = 1
    and a.start < b.start + b.len and b.start < a.start + a.len)""")
def overlap_anti_join(spark, sf):
    s = spans(spark, sf)
    return joins.overlap_anti_join(s.where("l_linenumber % 2 = 0"), s.where("l_linenumber % 2 = 1"))


@query("ref_list_semi_join", "select c_custkey as doc_id, (c_custkey % 1000)::varchar as npa from customer where c_custkey % 1000 >= 200 and c_custkey % 100 <> 11 and (c_custkey // 10) % 10 <> 9")
def ref_list_semi_join(spark, sf):
    rows = sql_over(spark, sf, "customer", "c_custkey as doc_id", "cast(c_custkey % 1000 as string) as npa")
    lists = dims.default_area_codes(spark).withColumn("list_id", F.lit("us.npa"))
    return joins.ref_list_semi_join(rows, "npa", lists, "us.npa")


@query("grant_match", """select l_orderkey, l_linenumber, l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) <= s_suppkey % 5 as granted
   from lineitem join supplier on s_suppkey = l_suppkey""")
def grant_match(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    rows = rows.join(table(spark, sf, "supplier").selectExpr("s_suppkey as l_suppkey"), "l_suppkey", "left_semi")
    grants = table(spark, sf, "supplier").selectExpr("s_suppkey as l_suppkey", "s_suppkey % 5 as n")
    return joins.grant_match(rows, grants, ["l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("asof_source_join", """select e.event_id, c.props as source from (select * from events where event_type <> 'view') e
   asof left join (select * from events where event_type = 'view') c on e.user_id = c.user_id and e.ts >= c.ts""")
def asof_source_join(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.col("props").alias("source"))
    copies = ev.where("event_type <> 'view'").drop("source")
    changes = ev.where("event_type = 'view'").select("user_id", "ts", "source")
    return joins.asof_source_join(copies, changes, "user_id", "ts", "source").select("event_id", "source")


# --- reports ---------------------------------------------------------------------------------
_us = ", ".join(f"('{d}')" for d in dims.US_DETECTORS)


@query("detector_readiness", f"""
  select c_custkey as scope, d as detector_id, case when d = 'us.phone' then case when c_custkey % 3 = 1 then 'ValidationFailed' else 'Ready' end
    when d = 'us.address' then case when c_custkey % 4 = 2 then 'ValidationFailed' when c_custkey % 4 = 3 then 'NotProvided' else 'Ready' end else 'Ready' end as state
  from customer, (values {_us}) t(d)""")
def detector_readiness(spark, sf):
    bad = S.LIST_STATES["hash"]
    one = lambda li, expr: sql_over(spark, sf, "customer", "c_custkey as scope", f"'{li}' as list_id", f"{expr} as state")
    states = (
        one("us.npa", f"case when c_custkey % 3 = 1 then '{bad}' else '{S.VALID}' end")
        .unionByName(one("usps.suffix", f"case when c_custkey % 4 = 2 then '{bad}' else '{S.VALID}' end"))
        .unionByName(one("usps.state", f"case when c_custkey % 4 = 3 then null else '{S.VALID}' end").where("state is not null"))
    )
    return reports.detector_readiness(states)


_terminals = "case event_type when 'view' then 'Success' when 'click' then 'NoActionRequired' when 'error' then 'ProcessingException' when 'purchase' then 'DecisionPending' else 'ReadRejected' end"


@query("scan_event_rollup", f"""select {_terminals} as terminal, count(*) as n, min(d) as min_ms, max(d) as max_ms, quantile_disc(d, 0.5) as p50, quantile_disc(d, 0.95) as p95,
   quantile_disc(d, 0.99) as p99 from (select event_type, cast(value * 100 as bigint) as d from events) group by 1""")
def scan_event_rollup(spark, sf):
    ev = sql_over(spark, sf, "events", f"{_terminals} as terminal", "cast(round(value * 100) as bigint) as duration_ms")
    return reports.scan_event_rollup(ev)


@query("scan_event_sink", f"""select f.doc_id, cast(count(*) as integer) as n_candidates, cast(count(*) filter (where risk < 3) as integer) as n_protect,
   cast(count(*) filter (where risk = 3) as integer) as n_pending, d.source from {_adjusted_sql} f join documents d using (doc_id) group by f.doc_id, d.source""")
def scan_event_sink(spark, sf):
    from ..operators.decide import redact_corpus

    out = redact_corpus(documents(spark, sf)).where("n_candidates > 0")
    return sinks.event_rows(out.select("doc_id", "n_candidates", "n_protect", "n_pending", "source"))


# --- histories and streams -------------------------------------------------------------------
def _versions(spark, sf):
    """Changes of one text per user: the text is the event type, so repeats are no new revision."""
    return sql_over(spark, sf, "events", "user_id as doc_id", "event_id as seq", "event_type as text")


_hist = "(select user_id as doc_id, event_id as seq, event_type as text, lag(event_type) over (partition by user_id order by event_id) as before from events)"


@query("changed_revisions", f"select doc_id, seq, coalesce(text <> before, true) as changed, cast(sum(case when text = before then 0 else 1 end) over (partition by doc_id order by seq) as bigint) as rev from {_hist}")
def changed_revisions(spark, sf):
    return reports.changed_revisions(_versions(spark, sf), "doc_id", "seq").select("doc_id", "seq", "changed", "rev")


@query("latest_wins", "select user_id as doc_id, max(event_id) as seq, arg_max(event_type, event_id) as text from events group by 1")
def latest_wins(spark, sf):
    return reports.latest_wins(_versions(spark, sf), "doc_id", "seq")


@query("self_write_filter", "select user_id as doc_id, event_id as seq from events where not (event_type = 'view' and user_id % 2 = 0)")
def self_write_filter(spark, sf):
    v = _versions(spark, sf)
    ours = v.where("doc_id % 2 = 0 and text = 'view'").selectExpr("doc_id", "upper(sha2(text, 256)) as text_sha256")
    return reports.self_write_filter(v, ours).select("doc_id", "seq")


# an attempt covers two events of a user; every ninth event is a late one of an older attempt
def _attempts(spark, sf):
    return sql_over(
        spark, sf, "events", "cast(user_id as string) as source", "event_id as seq",
        "case when event_id % 9 = 0 then 0 else cast(floor(event_id / 2) as bigint) end as attempt_id",
        f"case when event_id % 4 = 1 then null when event_id % 7 = 0 then 'UnauthorizedTarget' else {_terminals} end as terminal")


_status_marks = f"""
  (with a as (select user_id::varchar as source, event_id as seq, case when event_id % 9 = 0 then 0 else event_id // 2 end as attempt_id,
      case when event_id % 4 = 1 then null when event_id % 7 = 0 then 'UnauthorizedTarget' else {_terminals} end as terminal from events),
  b as (select * from (select *, max(attempt_id) over (partition by source order by seq rows between unbounded preceding and 1 preceding) as newest from a) where newest is null or attempt_id >= newest)
  select source, seq, attempt_id, terminal, case when terminal in ('ProcessingException') then 'Error' when terminal in ('ReadRejected') then 'Limited' when terminal in ('Success', 'NoActionRequired', 'DecisionPending') then 'none' end as mark from b)"""
_status_of = """case when terminal is null then 'Scanning' when terminal = 'Success' then 'Verified' when terminal = 'NoActionRequired' then 'Ready' when terminal = 'DecisionPending' then 'NeedsDecision'
     when terminal = 'ProcessingException' then 'Error' when terminal = 'ReadRejected' then 'Limited' else case when coalesce(standing, 'none') = 'none' then 'Ready' else standing end end"""
_status_sql = f"""
  (with s as (select *, last_value(mark ignore nulls) over (partition by source order by seq rows between unbounded preceding and current row) as standing from {_status_marks})
  select source, seq, attempt_id, {_status_of} as status from s)"""


@query("status_history", f"select source, seq, attempt_id, status from {_status_sql}")
def status_history(spark, sf):
    return reports.status_history(_attempts(spark, sf)).select("source", "seq", "attempt_id", "status")


@query("warning_notify", f"""select source, seq, status from (select *, lag(status) over (partition by source order by seq) as before from {_status_sql})
   where status in ('Limited', 'Error') and (before is null or before not in ('Limited', 'Error') or (before = 'Limited' and status = 'Error'))""")
def warning_notify(spark, sf):
    return reports.warning_notify(reports.status_history(_attempts(spark, sf))).select("source", "seq", "status")


def run_stream(spark, name: str, parts: list, job, schema=None):
    """Run a job over a table that arrives in parts: one run up to now after each, all from one checkpoint, into one table.

    Each part is one micro-batch, whatever its number of files, so the parts arrive in their order.
    """
    folder = new_folder(spark, name)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        source = S.stream_source(spark, f"{folder}/in", part.schema, 1_000_000)
        with jobs.state_store(spark):
            run = job(source).writeStream.format("parquet").option("path", f"{folder}/out").option(
                "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _by_range(df, column: str, n: int) -> list:
    """The table in ``n`` parts by ranges of a column; the last one is open."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    step = ((high or 0) - (low or 0)) // n + 1
    edges = [(low or 0) + i * step for i in range(n)]
    return [df.where((F.col(column) >= a) if i == n - 1 else (F.col(column) >= a) & (F.col(column) < a + step)) for i, a in enumerate(edges)]


# events of a user every minute or so, so that some scans end within half a minute
@query("status_stream", f"""
  with e as (select source, seq, attempt_id, status, mark, terminal from (
      select *, case when terminal is null then 'Scanning' end as status from {_status_marks})),
  n as (select *, lead(seq) over (partition by source order by seq) as next from e),
  late as (select source, seq + 0.5 as ord, -1 as seq, attempt_id, 'Limited' as mark, 'Timeout' as terminal from n
     where terminal is null and coalesce(next * 400 >= seq * 400 + 30000, (select max(event_id) * 400 - 10100 > n.seq * 400 + 30000 from events))),
  u as (select source, seq * 1.0 as ord, seq, attempt_id, mark, terminal from e union all select * from late),
  s as (select *, last_value(mark ignore nulls) over (partition by source order by ord rows between unbounded preceding and current row) as standing from u),
  t as (select *, {_status_of} as status from s),
  w as (select *, lag(status, 1, 'Ready') over (partition by source order by ord) as before from t)
  select source, seq, attempt_id, status, status in ('Limited', 'Error') and (before not in ('Limited', 'Error') or (before = 'Limited' and status = 'Error')) as warn from w""")
def status_stream(spark, sf):
    events = _attempts(spark, sf).withColumn("ts", F.timestamp_millis(F.col("seq") * 400 + 86_400_000))
    job = lambda source: jobs.status_stream(source.withWatermark("ts", "10100 milliseconds"), ts="ts")
    return run_stream(spark, "status", _by_range(events, "seq", 3), job)


# one event in five mints one or two passes, the others are matches, one in eleven of them of risk 3
_grants_sql = """(select user_id as doc_id, event_id as seq, event_id // 3000 as rev, event_type as detector_id, event_type as canonical,
   case when event_id % 11 = 0 then 3 else 1 end as risk, case when event_id % 5 = 0 then 1 + event_id % 2 else 0 end as n from events)"""


@query("grant_stream", f"""
  with g as (select *, case when n > 0 then n when risk = 1 then -1 else 0 end as step from {_grants_sql}),
  s as (select *, coalesce(sum(step) over w, 0) as total from g
     window w as (partition by doc_id, rev, detector_id order by seq rows between unbounded preceding and 1 preceding)),
  m as (select *, least(0, coalesce(min(total + step) over (partition by doc_id, rev, detector_id order by seq rows between unbounded preceding and 1 preceding), 0)) as low from s)
  select doc_id, seq, risk = 1 and total - low > 0 as granted from m where n = 0""")
def grant_stream(spark, sf):
    events = sql_over(spark, sf, "events", "user_id as doc_id", "event_id as seq", "cast(floor(event_id / 3000) as bigint) as rev", "event_type as detector_id",
                      "event_type as canonical", "case when event_id % 11 = 0 then 3 else 1 end as risk",
                      "case when event_id % 5 = 0 then cast(1 + event_id % 2 as int) else 0 end as n")
    return run_stream(spark, "grants", _by_range(events, "seq", 2), jobs.grant_stream)


@query("revision_stream", SQL["changed_revisions"])
def revision_stream(spark, sf):
    out = run_stream(spark, "revisions", _by_range(_versions(spark, sf), "seq", 2), jobs.revision_stream)
    return out.select("doc_id", "seq", "changed", "rev")


_old = "'old mail a@b.co'"


@query("stream_scan", f"""with x as ({DECISION_SQL["redact_corpus"].strip()})
  select doc_id, 0::bigint as seq, md5('old mail [이메일1]') as text_md5, 'protected' as status from documents where doc_id % 2 = 0
  union all select doc_id, 1::bigint, redacted_md5, status from x where status = 'protected' and doc_id % 2 = 1
  union all select doc_id, 2::bigint, redacted_md5, status from x where status = 'protected'""")
def stream_scan(spark, sf):
    """Two versions of each text, then our own rewrites.  The run is lost once after it has committed its second batch,
    so that this batch is run again."""
    docs, folder, seen = documents(spark, sf).select("doc_id", "text"), new_folder(spark, "scan"), []
    sink = jobs.scan_sink(spark, f"{folder}/out")

    def lost(number):
        seen.append(number)
        if number == 1 and seen.count(1) == 1:
            raise RuntimeError("lost after the commit")

    first = docs.selectExpr("doc_id", "doc_id % 2 as seq", f"if(doc_id % 2 = 0, {_old}, text) as text")
    for changes in (lambda: first, lambda: docs.selectExpr("doc_id", "cast(2 as bigint) as seq", "text"),
                    lambda: sink.rows().selectExpr("doc_id", "cast(3 as bigint) as seq", "text")):
        part = changes()
        part.write.mode("append").parquet(f"{folder}/in")
        source = S.stream_source(spark, f"{folder}/in", part.schema, 1_000_000)
        for _ in range(2):
            try:
                jobs.stream_scan(source, f"{folder}/out", f"{folder}/checkpoint", once=True, written=lost).awaitTermination()
                break
            except StreamingQueryException:
                if seen.count(1) > 1:
                    raise
    return sink.rows().select("doc_id", "seq", F.md5("text").alias("text_md5"), "status")


# --- the chain with the US pack --------------------------------------------------------------
_us_docs = STAND_IN_PHONES


@query("scan_findings_us", f"""select doc_id, start, len, canonical, risk, pii_type from {_adjusted_sql}
   union all select doc_id, start, len, canonical, risk, 'Phone' as pii_type from ({_us_docs})""")
def scan_findings_us(spark, sf):
    rows = flagship.scan_findings_us(documents(spark, sf), RefLists.stand_in())
    return rows.select("doc_id", "start", "len", "canonical", "risk", "pii_type")


_both_packs = f"""(select doc_id, start, len, canonical, risk, pii_type from {_adjusted_sql}
   union all select doc_id, start, len, canonical, risk, 'Phone' as pii_type from ({_us_docs}))"""


@query("redact_corpus_us", DECISION_SQL["redact_corpus"].replace(_adjusted_sql, _both_packs))
def redact_corpus_us(spark, sf):
    from ..operators.decide import redact_corpus

    out = redact_corpus(documents(spark, sf), us=RefLists.stand_in())
    return out.select("doc_id", F.md5("redacted").alias("redacted_md5"), "n_candidates", "n_protect", "n_pending", "status")


# tenants 0 and 4 have the US pack (4 with a damaged setting), 1 never chose it, 2 switched it off, 3 has a broken list
@query("redact_tenants", f"""with kr as ({DECISION_SQL["redact_corpus"]}), us as ({SQL["redact_corpus_us"]})
  select * from kr where doc_id % 5 in (1, 2) union all select * from us where doc_id % 5 in (0, 4)
  union all select doc_id, md5(text), 0, 0, 0, 'not_scanned' from documents where doc_id % 5 = 3""")
def redact_tenants(spark, sf):
    from ..operators.decide import redact_tenants, tenant_masks

    tenants = sql_over(spark, sf, "region", "r_regionkey as tenant")
    choices = tenants.where("tenant <> 1").selectExpr("tenant", "'activation' as kind", "'On' as state", "1 as revision").unionByName(
        tenants.where("tenant in (2, 4)").selectExpr("tenant", "'setting' as kind", "if(tenant = 2, 'Off', 'Corrupt') as state", "1 as revision"))
    states = tenants.selectExpr("tenant as scope", "explode(array('us.npa', 'usps.suffix', 'usps.state')) as list_id").selectExpr(
        "scope", "list_id", f"if(scope = 3 and list_id = 'us.npa', '{S.LIST_STATES['hash']}', '{S.VALID}') as state")
    gates = S.country_gate(tenants, choices, tenants.selectExpr("tenant", "true as usable"))
    masks = tenant_masks(gates, reports.detector_readiness(states))
    docs = documents(spark, sf).withColumn("tenant", F.col("doc_id") % 5)
    out = redact_tenants(docs, masks, us=RefLists.stand_in())
    return out.select("doc_id", F.md5("redacted").alias("redacted_md5"), "n_candidates", "n_protect", "n_pending", "status")


@query("redact_conversations_us", """
  with t as (select conv_id, turn, turn % 2 as p, turn % 3 as e, text from conversations),
  pn as (select conv_id, p, rank() over (partition by conv_id order by min(turn)) as n from t group by conv_id, p),
  en as (select conv_id, e, rank() over (partition by conv_id order by min(turn)) as n from t group by conv_id, e)
  select conv_id, turn, md5('Phone: [전화번호' || pn.n || '] or [이메일' || en.n || '] ' || text) as redacted_md5, 'protected' as status
  from t join pn using (conv_id, p) join en using (conv_id, e)""")
def redact_conversations_us(spark, sf):
    turns = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "concat('Phone: 212-555-010', turn % 2, ' or u', turn % 3, '@mail.kr ', text) as text")
    out = flagship.redact_conversations(turns, us=RefLists.stand_in())
    return out.select("conv_id", "turn", F.md5("redacted").alias("redacted_md5"), "status")


_pages = "(select 'pages' as kind, page_id::varchar as doc_key, html as t from pages union all select 'conversations', conv_id::varchar || '/' || turn::varchar, text from conversations)"
_label = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"


@query("scan_text_sources", f"""select doc_key, {O.ints(start='st', len='length(m)')}, lower(m) as canonical
   from {O.matches(_pages, "[A-Za-z0-9_+-]+(?:[.][A-Za-z0-9_+-]+)*@" + _label + "(?:[.]" + _label + ")*[.][A-Za-z]{2,}", "doc_key", "t")}
   where not regexp_matches(prev_c, '[A-Za-z0-9_+.@-]') and not regexp_matches(next_c, '[0-9@-]')
   union all select doc_key, {O.ints(start='st', len='length(m)')}, m from {O.matches(_pages, "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "doc_key", "t")}
   where not regexp_matches(prev_c, '[0-9A-Za-z.]') and not regexp_matches(next_2, '^([0-9A-Za-z]|[.][0-9])')
     and list_bool_and(list_transform(string_split(m, '.'), lambda o: o::int <= 255))""")
def scan_text_sources(spark, sf):
    """Addresses and hosts in raw pages and conversations, as they are."""
    t = lambda n: table(spark, sf, n)
    rows = S.text_source(t("pages"), "pages", ["page_id"], "html").unionByName(S.text_source(t("conversations"), "conversations", ["conv_id", "turn"], "text"))
    return scan_rule(rows, "global.email", "global.ip", key="doc_key").select("doc_key", "start", "len", "canonical")
