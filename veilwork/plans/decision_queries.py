"""Registered queries over resolution, decisions, redaction and the complete chains, with comparison SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import dims
from ..functions.spans import FINDING, run_stages
from ..operators import decide as J
from ..operators import joins, reports, us_rules
from ..operators import resolve as R
from ..operators.base_rules import explode_findings, scan_arrays, scan_rule
from ..operators.user_rules import RuleSet
from ..sources import sinks
from . import flagship
from . import oracle as O
from .base_queries import SQL as BASE_SQL
from .shape import materialize, new_folder, spread
from .texts import case, documents, pad, sql_over, table, text_rows

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- intervals from lineitem: an order is a document, its lines are spans ---------------------
_start, _len = "cast(l_partkey % 200 as int)", "cast(l_quantity as int)"


def spans(spark, sf):
    return sql_over(
        spark, sf, "lineitem", "l_orderkey as doc_id", "l_linenumber", f"{_start} as start", f"{_len} as len"
    )


_spans_sql = f"(select l_orderkey as doc_id, l_linenumber, {O.ints(start='l_partkey % 200', len='l_quantity')} from lineitem)"
_islands_sql = f"""(select *, sum(fresh) over (partition by doc_id order by start, len, l_linenumber) - 1 as island from (
  select *, case when start >= max(start + len) over (partition by doc_id order by start, len, l_linenumber rows between unbounded preceding and 1 preceding) then 1
    when row_number() over (partition by doc_id order by start, len, l_linenumber) = 1 then 1 else 0 end as fresh from {_spans_sql}))"""


@query("overlap_components", f"select doc_id, {O.ints(island='island')}, count(*) as n, {O.ints(lo='min(start)', hi='max(start + len)')} from {_islands_sql} group by doc_id, island")
def overlap_components(spark, sf):
    return R.overlap_components(spans(spark, sf)).groupBy("doc_id", "island").agg(
        F.count("*").alias("n"), F.min("start").alias("lo"), F.max(F.col("start") + F.col("len")).alias("hi"))


# Findings from lines: risk, confidence and detector by line, all distinct in strength within an order.
_LEGACY = ["kr.phone", "global.email", "kr.rrn", "global.card", "kr.bank_account", "global.secret", "global.ip"]
_CONTRACT = ["us.atin", "us.mbi", "us.sevis", "us.a_number", "us.i94", "us.phone", "us.name"]


def made_findings(spark, sf, mixed: bool):
    """One finding per line; with ``mixed``, odd orders use contract detectors and every third order both kinds."""
    legacy, contract = (F.array(*[F.lit(d) for d in ds]) for ds in (_LEGACY, _CONTRACT))
    i = (F.col("l_linenumber") - 1).cast("int")
    pick = F.get(legacy, i)
    if mixed:
        k = F.col("doc_id") % 3
        pick = F.when(k == 0, F.get(legacy, i)).when(k == 1, F.get(contract, i)).otherwise(
            F.when(i % 2 == 0, F.get(legacy, i)).otherwise(F.get(contract, i)))
    df = sql_over(
        spark, sf, "lineitem", "l_orderkey as doc_id", "l_linenumber", f"{_start} as start", f"{_len} as len",
        "cast(l_partkey % 3 + 1 as int) as risk", "cast(l_suppkey % 3 + 1 as int) as conf",
        "cast(l_suppkey % 6 + 1 as int) as evidence", "cast(l_partkey as string) as canonical",
    ).withColumn("detector_id", pick)
    pii_type = dims.lookup(dims.DETECTOR_TYPE, F.col("detector_id"), "string")
    return df.select(
        "doc_id", "start", "len", dims.type_ordinal(pii_type).alias("type_ord"), pii_type.alias("pii_type"), "detector_id",
        "canonical", F.lit("x").alias("surface"), "risk", "conf", dims.lookup(dims.RANK, F.col("detector_id"), "int").alias("rank"),
        "evidence", F.lit(None).cast("boolean").alias("owner_claim"),
    )


# Greedy acceptance has no closed SQL form over windows, but on an order of a few lines it is a short recursion:
# a candidate is accepted when no stronger accepted candidate overlaps it.
def _greedy_sql(order_by: str, extra: str = "") -> str:
    return f"""
  with recursive c as (select *, row_number() over (partition by doc_id order by {order_by}) as r from {_made_sql}),
  walk as (
    select doc_id, 0::bigint as r, []::struct(s integer, e integer, r bigint)[] as acc from (select distinct doc_id from c)
    union all
    select w.doc_id, c.r, case when len(list_filter(w.acc, lambda a: a.s < c.start + c.len and c.start < a.e)) > 0 then w.acc
      else list_append(w.acc, {{'s': c.start, 'e': c.start + c.len, 'r': c.r}}) end
    from walk w join c on c.doc_id = w.doc_id and c.r = w.r + 1),
  fin as (select doc_id, arg_max(acc, r) as acc from walk group by doc_id),
  won as (select f.doc_id, unnest(acc).r as r from fin f)
  {extra or "select c.doc_id, c.start, c.len, c.detector_id, c.canonical from c join won using (doc_id, r)"}"""


_lg = "[" + ", ".join(f"'{d}'" for d in _LEGACY) + "]"
_ord = "[" + ", ".join(str(dims.TYPE_ORD[dims.DETECTOR_TYPE[d]]) for d in _LEGACY) + "]"
_made_sql = f"""(select l_orderkey as doc_id, {O.ints(start='l_partkey % 200', len='l_quantity', risk='l_partkey % 3 + 1', conf='l_suppkey % 3 + 1')},
   ({_lg})[l_linenumber] as detector_id, ({_ord})[l_linenumber] as type_ord, cast(l_partkey as varchar) as canonical from lineitem)"""
_legacy_order = "risk desc, conf desc, len desc, start, type_ord, detector_id, canonical"


@query("resolve_overlaps", _greedy_sql(_legacy_order))
def resolve_overlaps(spark, sf):
    return R.resolve_overlaps(made_findings(spark, sf, False)).select("doc_id", "start", "len", "detector_id", "canonical")


# The same walk under the domain rules: components by island, one order for each domain, and the ties.
_ct = "[" + ", ".join(f"'{d}'" for d in _CONTRACT) + "]"
_domain_rows = ", ".join(
    f"('{d}', {dims.TYPE_ORD[dims.DETECTOR_TYPE[d]]}, {dims.RANK[d]}, {d in _LEGACY})" for d in _LEGACY + _CONTRACT)
_keys = "k1, k2, k3, k4, k5, k6"


def _domain_sql(final: str) -> str:
    order = "partition by doc_id order by start, len, ln"
    return f"""
  with recursive t(detector_id, type_ord, rank, legacy) as (values {_domain_rows}),
  m as (select l_orderkey as doc_id, l_linenumber as ln, {O.ints(start='l_partkey % 200', len='l_quantity', risk='l_partkey % 3 + 1',
        conf='l_suppkey % 3 + 1', evidence='l_suppkey % 6 + 1')}, cast(l_partkey as varchar) as canonical,
      case when l_orderkey % 3 = 0 or (l_orderkey % 3 = 2 and l_linenumber % 2 = 1) then ({_lg})[l_linenumber] else ({_ct})[l_linenumber] end as detector_id
    from lineitem),
  i as (select *, case when start >= max(start + len) over ({order} rows between unbounded preceding and 1 preceding) then 1
      when row_number() over ({order}) = 1 then 1 else 0 end as fresh from m join t using (detector_id)),
  j as (select *, sum(fresh) over ({order}) as island from i),
  d as (select *, case when bool_or(legacy) over w and bool_or(not legacy) over w then 'mixed' when bool_or(legacy) over w then 'legacy' else 'contract' end as domain
    from j window w as (partition by doc_id, island)),
  k as (select *, -risk as k1, case domain when 'legacy' then -conf when 'contract' then -evidence else -len end as k2,
      case domain when 'mixed' then rank else -len end as k3, case domain when 'legacy' then start when 'contract' then rank else 0 end as k4,
      case domain when 'legacy' then type_ord else 0 end as k5, case domain when 'legacy' then canonical else '' end as k6 from d),
  c as (select *, row_number() over (partition by doc_id order by island, {_keys}, start, len, type_ord) as r from k),
  walk as (
    select doc_id, 0::bigint as r, []::struct(s integer, e integer, r bigint)[] as acc from (select distinct doc_id from c)
    union all
    select w.doc_id, c.r, case when len(list_filter(w.acc, lambda a: a.s < c.start + c.len and c.start < a.e)) > 0 then w.acc
      else list_append(w.acc, {{'s': c.start, 'e': c.start + c.len, 'r': c.r}}) end
    from walk w join c on c.doc_id = w.doc_id and c.r = w.r + 1),
  fin as (select doc_id, arg_max(acc, r) as acc from walk group by doc_id),
  won as (select c.* from (select doc_id, unnest(acc).r as r from fin) join c using (doc_id, r)),
  tied as (select a.doc_id from c a join c b on a.doc_id = b.doc_id and a.island = b.island and a.r < b.r and ({', '.join('a.' + k for k in _keys.split(', '))})
      = ({', '.join('b.' + k for k in _keys.split(', '))}) and a.start < b.start + b.len and b.start < a.start + a.len)
  {final}"""


@query("resolve_candidates", _domain_sql(
    "select doc_id, start, len, detector_id, canonical from won where doc_id not in (select doc_id from tied)"))
def resolve_candidates(spark, sf):
    return R.resolve_candidates(made_findings(spark, sf, True)).select("doc_id", "start", "len", "detector_id", "canonical")


@query("suppression_audit", _domain_sql("""
  select l.doc_id, l.domain, l.start, l.detector_id as loser, w.detector_id as winner,
    case when l.risk <> w.risk then 'LowerLevel' when l.domain = 'contract' and l.evidence <> w.evidence then 'WeakerEvidence'
      when l.domain = 'legacy' and l.conf <> w.conf then 'LowerConfidence' when l.len <> w.len then 'ShorterOverlappingSpan'
      when l.domain <> 'legacy' and l.rank <> w.rank then 'HigherNumericRank' else 'LegacyCompatibilityOrder' end as reason
  from (select * from c anti join won using (doc_id, r)) l
  join won w on w.doc_id = l.doc_id and w.start < l.start + l.len and l.start < w.start + w.len
  qualify row_number() over (partition by l.doc_id, l.r order by w.r) = 1"""))
def suppression_audit(spark, sf):
    audit = R.suppression_audit(R.resolved_components(made_findings(spark, sf, True)))
    return audit.select("doc_id", "domain", F.col("loser.start").alias("start"), F.col("loser.detector_id").alias("loser"),
                        F.col("winner.detector_id").alias("winner"), "reason")


# Ties: in mixed and contract components two equal detectors on one span cannot be told apart.
_tie = "o_orderkey % 4"


def tied_findings(spark, sf):
    """Two findings per order; in half of the orders they are equal on every key."""
    df = sql_over(
        spark, sf, "orders", "o_orderkey as doc_id", "o_orderkey % 4 as k",
        "explode(array(0, 1)) as j").selectExpr(
        "doc_id", "cast(case when k = 2 then j * 20 when k = 3 then j else 5 + j end as int) as start", "10 as len", "0 as type_ord",
        "'UsMbi' as pii_type", "case when k = 1 and j = 1 then 'us.sevis' else 'us.mbi' end as detector_id",
        "concat(cast(doc_id as string), cast(j as string)) as canonical", "'x' as surface", "3 as risk", "3 as conf",
        "case when k = 1 and j = 1 then 90 else 80 end as rank", "5 as evidence", "cast(null as boolean) as owner_claim")
    return df


@query("ambiguous_ties", f"""select o_orderkey as doc_id, cast(case when {_tie} = 0 then 6 else 1 end as integer) as overlap_start, cast(9 as integer) as overlap_len,
   'contract' as domain from orders where {_tie} in (0, 3)""")
def ambiguous_ties(spark, sf):
    return R.ambiguous_ties(R.resolved_components(tied_findings(spark, sf))).select("doc_id", "overlap_start", "overlap_len", "domain")


@query("dedupe_findings", f"select doc_id, start, len, risk, count(distinct (conf, evidence, canonical)) as n from (select l_orderkey as doc_id, "
       f"{O.ints(start='l_partkey % 200', len='l_quantity', risk='l_partkey % 3 + 1', conf='l_suppkey % 3 + 1', evidence='l_suppkey % 6 + 1')}, "
       f"l_partkey as canonical, l_linenumber as d from lineitem) group by doc_id, start, len, risk, d")
def dedupe_findings(spark, sf):
    rows = made_findings(spark, sf, False)
    df = R.dedupe_findings(rows.unionByName(rows))
    return df.groupBy("doc_id", "start", "len", "risk", "detector_id").agg(F.count("*").alias("n")).drop("detector_id")


@query("first_per_span", "select l_orderkey as doc_id, cast(l_partkey % 10 as integer) as start, cast(min(l_linenumber) as integer) as pass from lineitem group by 1, 2")
def first_per_span(spark, sf):
    """The lines of an order as two arrays of spans; the first three lines are preferred."""
    item = "struct<start:int,len:int,pass:int>"
    lines = sql_over(spark, sf, "lineitem", "l_orderkey as doc_id", "l_linenumber <= 3 as first",
                     "struct(cast(l_partkey % 10 as int) as start, 1 as len, cast(l_linenumber as int) as pass) as x")
    arrays = lines.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("first"), F.col("x"))).alias("a"), F.collect_list(F.when(~F.col("first"), F.col("x"))).alias("b"))
    out = run_stages(arrays, [us_rules.first_per_span("o", F.col("a"), F.col("b"), item)], ["doc_id"], ["o"])
    return out.select("doc_id", F.inline("o")).drop("len")


@query("finding_sort_key", f"""select doc_id, detector_id || '|' || t.pii_type || '|' || start || '|' || len || '|' || risk || '|' || evidence || '|' || conf || '|' || rank || '|' ||
   t.pii_type || ':' || canonical || '|null|0' as key_text from (select l_orderkey as doc_id, ({_lg})[l_linenumber] as detector_id,
   {O.ints(start='l_partkey % 200', len='l_quantity', risk='l_partkey % 3 + 1', conf='l_suppkey % 3 + 1', evidence='l_suppkey % 6 + 1')}, l_partkey::varchar as canonical from lineitem)
   join (values {', '.join(f"('{d}', '{dims.DETECTOR_TYPE[d]}', {dims.RANK[d]})" for d in _LEGACY)}) t(detector_id, pii_type, rank) using (detector_id)""")
def finding_sort_key(spark, sf):
    return made_findings(spark, sf, False).orderBy(R.finding_sort_key()).select("doc_id", R.finding_key_text().alias("key_text"))


# --- context --------------------------------------------------------------------------------
_gap = "(o_orderkey % 8 + 20)"
_ctx_text = f"'test' || repeat('.', cast({_gap} as int)) || '010-1234-' || {pad('o_orderkey % 10000', 4)} || case when o_orderkey % 16 >= 8 then ' 900101-1234568' else '' end"


@query("adjust_context", f"""
  select o_orderkey as doc_id, 'kr.phone' as detector_id, cast(case when {_gap} < 24 then 2 else 3 end as integer) as conf from orders
  union all select o_orderkey, 'kr.rrn', cast(3 as integer) from orders where o_orderkey % 16 >= 8""")
def adjust_context(spark, sf):
    return flagship.scan_findings(text_rows(spark, sf, "orders", "o_orderkey", _ctx_text)).select("doc_id", "detector_id", "conf")


# --- decisions over findings made from lines ---------------------------------------------------
_listed = "l_partkey % 5 = 0"
_trusted_case = f"case when risk = 3 then false else listed end"
_decided_sql = f"""(select *, case when risk = 3 then 'NeedsDecision' when trusted then 'Bypass' when risk = 2 then 'Protect' when conf = 3 then 'Protect'
   when conf = 2 then 'NeedsDecision' else 'Bypass' end as disposition from (select *, {_trusted_case} as trusted from (
   select l_orderkey as doc_id, l_linenumber, {O.ints(start='l_partkey % 200', len='l_quantity', risk='l_partkey % 3 + 1', conf='l_suppkey % 3 + 1')},
     ({_lg})[l_linenumber] as detector_id, l_partkey::varchar as canonical, {_listed} as listed from lineitem)))"""


def listed_values(spark, sf, where: str):
    """Policy entries from the parts, for every type."""
    parts = table(spark, sf, "part").where(where).select(F.col("p_partkey").cast("string").alias("value"))
    types = F.explode(F.array(*[F.lit(t) for t in dims.TYPE_ORD]))
    return parts.select(types.alias("pii_type"), "value")


def policy(spark, sf, **settings):
    entries = listed_values(spark, sf, "p_partkey % 5 = 0")
    return J.Policy(trusted=entries, exceptions=entries, settings={**J.ALL_ON, **settings})


@query("trust_match", f"select doc_id, start, len, detector_id, canonical, trusted from {_decided_sql}")
def trust_match(spark, sf):
    p = policy(spark, sf)
    return J.trust_match(made_findings(spark, sf, False), p.trusted, p.exceptions).select(
        "doc_id", "start", "len", "detector_id", "canonical", "trusted")


@query("decide", f"select doc_id, start, len, detector_id, canonical, disposition from {_decided_sql}")
def decide(spark, sf):
    return J.decide_rows(made_findings(spark, sf, False), policy(spark, sf)).select(
        "doc_id", "start", "len", "detector_id", "canonical", "disposition")


@query("apply_category_settings", f"""select doc_id, start, len, detector_id, canonical,
   case when detector_id in ('kr.phone') and disposition = 'Protect' then 'Bypass' else disposition end as disposition from {_decided_sql}""")
def apply_category_settings(spark, sf):
    return J.decide_rows(made_findings(spark, sf, False), policy(spark, sf, phone=False)).select(
        "doc_id", "start", "len", "detector_id", "canonical", "disposition")


@query("user_exception_match", f"""select doc_id, start, len, detector_id, canonical,
   case when canonical::bigint % 7 = 0 and disposition = 'Protect' then 'Bypass' else disposition end as disposition from {_decided_sql}""")
def user_exception_match(spark, sf):
    p = policy(spark, sf)
    p.user_exceptions = listed_values(spark, sf, "p_partkey % 7 = 0")
    return J.decide_rows(made_findings(spark, sf, False), p).select(
        "doc_id", "start", "len", "detector_id", "canonical", "disposition")


def decided(spark, sf):
    return J.decide_rows(made_findings(spark, sf, False), policy(spark, sf))


_n = lambda cond: f"cast(count(*) filter (where {cond}) as integer)"
_counts_sql = f"""(select doc_id, cast(count(*) as integer) as n_candidates, {_n("trusted")} as n_trusted, {_n("disposition = 'Protect'")} as n_protect,
   {_n("disposition = 'NeedsDecision'")} as n_pending, {_n("disposition = 'Bypass'")} as n_bypass from {_decided_sql} group by doc_id)"""


@query("disposition_counts", f"select * from {_counts_sql}")
def disposition_counts(spark, sf):
    return J.disposition_counts(decided(spark, sf), "doc_id")


@query("doc_status", f"""select doc_id, case when n_pending > 0 then 'needs_decision' when n_protect = n_candidates then 'protected'
   when n_protect > 0 then 'partly_kept' else 'kept' end as status from {_counts_sql}""")
def doc_status(spark, sf):
    c = J.disposition_counts(decided(spark, sf), "doc_id")
    return c.select("doc_id", J.doc_status(F.col("n_candidates"), F.col("n_protect"), F.col("n_pending")).alias("status"))


@query("decision_items", f"""select doc_id, canonical, risk, detector_id, min(start) as first_start, cast(count(*) as integer) as n from {_decided_sql}
   where disposition = 'NeedsDecision' group by doc_id, canonical, risk, detector_id""")
def decision_items(spark, sf):
    return J.decision_items(decided(spark, sf)).drop("pii_type")


_pairs = "(select l_suppkey as doc_id, l_returnflag as canonical, case l_partkey % 3 when 0 then 'Protect' when 1 then 'NeedsDecision' else 'Bypass' end as disposition from lineitem)"


@query("strictest_disposition", f"""select doc_id, canonical, case max(case disposition when 'Protect' then 2 when 'NeedsDecision' then 1 else 0 end)
   when 2 then 'Protect' when 1 then 'NeedsDecision' else 'Bypass' end as disposition from {_pairs} group by doc_id, canonical""")
def strictest_disposition(spark, sf):
    df = sql_over(spark, sf, "lineitem", "l_suppkey as doc_id", "l_returnflag as canonical", "'Phone' as pii_type", "1 as risk", "'kr.phone' as detector_id",
                  "case l_partkey % 3 when 0 then 'Protect' when 1 then 'NeedsDecision' else 'Bypass' end as disposition")
    return J.strictest_disposition(df).select("doc_id", "canonical", "disposition")


# placeholders: a value is its order's line number pair, so values repeat inside a document
_val = "cast(l_partkey % 3 as varchar)"


@query("assign_aliases", f"""
  with f as (select l_suppkey as doc_id, l_linenumber, {O.ints(start='l_orderkey')}, {_val} as canonical, l_orderkey % 4 <> 0 as named from lineitem),
  firsts as (select doc_id, canonical, min(start) as first from f where named group by all),
  numbered as (select *, rank() over (partition by doc_id order by first, canonical) as n from firsts)
  select f.doc_id, f.start, f.canonical, cast(numbered.n as integer) as alias_no, '[전화번호' || numbered.n || ']' as alias
  from f left join numbered on f.named and f.doc_id = numbered.doc_id and f.canonical = numbered.canonical""")
def assign_aliases(spark, sf):
    df = sql_over(
        spark, sf, "lineitem", "l_suppkey as doc_id", "cast(l_orderkey as int) as start", "cast(l_partkey % 3 as string) as canonical",
        "cast(l_partkey % 3 as int) as len", "0 as type_ord", "'Phone' as pii_type", "'kr.phone' as detector_id",
        "case when l_orderkey % 4 <> 0 then 'Protect' else 'Bypass' end as disposition")
    return J.assign_aliases(df).select("doc_id", "start", "canonical", "alias_no", "alias")


@query("cross_doc_value_link", "select l_partkey::varchar as canonical, count(distinct l_orderkey) as n_docs, count(*) as n, min(l_orderkey) as first_doc from lineitem group by 1")
def cross_doc_value_link(spark, sf):
    df = sql_over(spark, sf, "lineitem", "l_orderkey as doc_id", "cast(l_partkey as string) as canonical", "'Phone' as pii_type")
    return joins.cross_doc_value_link(df).drop("pii_type")


# --- the documents ---------------------------------------------------------------------------
_names = {"kr_phone": "Phone", "email": "Email", "card": "CardNumber", "secret": "Secret", "ip": "IpAddress"}
_marks = O.matches("documents", "(?i)(sample|dummy|test|example|예시|테스트|샘플|더미)")


def _real(name: str) -> str:
    """The documents half of a scan's comparison SQL."""
    return BASE_SQL[f"scan_{name}"][BASE_SQL[f"scan_{name}"].rindex(" union all ") + 11:]


_found_sql = "(" + " union all ".join(f"select *, '{t}' as pii_type from ({_real(n)})" for n, t in _names.items()) + ")"
_adjusted_sql = f"""(select doc_id, start, len, canonical, risk, pii_type, cast(case when risk < 3 and exists (select 1 from {_marks} k where k.doc_id = f.doc_id
     and not regexp_matches(k.prev_c, '[\\pL\\pN_]') and not regexp_matches(k.next_c, '[\\pL\\pN_]')
     and k.st < f.start + f.len + 24 and k.st + length(k.m) > f.start - 24) then greatest(conf - 1, 1) else conf end as integer) as conf from {_found_sql} f)"""


@query("scan_findings", f"select * from {_adjusted_sql}")
def scan_findings(spark, sf):
    return flagship.scan_findings(documents(spark, sf)).select("doc_id", "start", "len", "canonical", "risk", "pii_type", "conf")


@query("union_findings", f"select pii_type, count(*) as n, count(distinct doc_id) as n_docs from {_found_sql} group by pii_type")
def union_findings(spark, sf):
    rows = explode_findings(scan_arrays(documents(spark, sf)), "candidates", "doc_id")
    return rows.groupBy("pii_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


_us_docs = """(select doc_id, start, len, canonical, risk, 'Phone' as pii_type, conf from ({}))"""


@query("redact_corpus", f"""
  with f as (select *, case when risk = 3 then 'NeedsDecision' else 'Protect' end as disposition from {_adjusted_sql}),
  c as (select doc_id, cast(count(*) as integer) as n_candidates, {_n("disposition = 'Protect'")} as n_protect, {_n("disposition = 'NeedsDecision'")} as n_pending from f group by doc_id),
  v as (select doc_id, pii_type, canonical, min(start) as first from f where disposition = 'Protect' group by all),
  a as (select *, '[' || case pii_type when 'Phone' then '전화번호' when 'Email' then '이메일' else 'IP주소' end
          || row_number() over (partition by doc_id, pii_type order by first) || ']' as token from v),
  e as (select f.doc_id, f.start, f.len, a.token, coalesce(lag(f.start + f.len) over (partition by f.doc_id order by f.start), 0) as prev_end
        from f join a using (doc_id, pii_type, canonical)),
  r as (select e.doc_id, string_agg(substr(d.text, prev_end + 1, start - prev_end) || token, '' order by start) as head, max(start + len) as stop
        from e join documents d using (doc_id) group by e.doc_id)
  select d.doc_id, md5(case when coalesce(n_protect, 0) > 0 and n_pending = 0 then r.head || substr(d.text, r.stop + 1) else d.text end) as redacted_md5,
    coalesce(n_candidates, 0) as n_candidates, coalesce(n_protect, 0) as n_protect, coalesce(n_pending, 0) as n_pending,
    case when n_candidates is null then 'no_findings' when n_pending > 0 then 'needs_decision' else 'protected' end as status
  from documents d left join c using (doc_id) left join r using (doc_id)""")
def redact_corpus(spark, sf):
    return J.redact_corpus(documents(spark, sf)).select(
        "doc_id", F.md5("redacted").alias("redacted_md5"), "n_candidates", "n_protect", "n_pending", "status")


_trusted = f"(select canonical from {_adjusted_sql} where pii_type = 'IpAddress' and doc_id % 2 = 0)"
_excepted = f"(select canonical from {_adjusted_sql} where pii_type = 'Email' and doc_id % 3 = 0)"


@query("redact_corpus_lists", SQL["redact_corpus"].replace("case when risk = 3 then 'NeedsDecision' else 'Protect' end as disposition",
    f"""case when risk = 3 then 'NeedsDecision' when pii_type = 'IpAddress' and canonical in {_trusted} then 'Bypass'
     when pii_type = 'Email' and canonical in {_excepted} then 'Bypass' else 'Protect' end as disposition""").replace(
    "when n_pending > 0 then 'needs_decision' else 'protected' end as status",
    "when n_pending > 0 then 'needs_decision' when n_protect = n_candidates then 'protected' when n_protect > 0 then 'partly_kept' else 'kept' end as status"))
def redact_corpus_lists(spark, sf):
    """With a trusted list and a user's exceptions: the values of some documents, wherever they stand; a choice for a secret
    is on the lists as well and changes nothing."""
    found = materialize(flagship.scan_findings(documents(spark, sf)).select("doc_id", "pii_type", F.col("canonical").alias("value")))
    entries = lambda test: found.where(test).select("pii_type", "value")
    policy = J.Policy(trusted=entries("pii_type = 'IpAddress' and doc_id % 2 = 0 or pii_type = 'Secret'"),
                      user_exceptions=entries("pii_type = 'Email' and doc_id % 3 = 0 or pii_type = 'Secret'"))
    out = J.redact_corpus(documents(spark, sf), policy)
    return out.select("doc_id", F.md5("redacted").alias("redacted_md5"), "n_candidates", "n_protect", "n_pending", "status")


QUERIES["redact"] = QUERIES["redact_corpus"]
SQL["redact"] = SQL["redact_corpus"]


def redacted(spark, sf):
    return J.redact_corpus(documents(spark, sf))


def _written_again(sink: sinks.BatchSink, rows) -> sinks.BatchSink:
    """Write a batch, leave an attempt unfinished, and write the batch again: the table holds it once."""
    sink.write(rows, 0)
    sink.stage(rows, 1, "unfinished")
    sink.write(rows, 0)
    return sink


@query("redacted_sink", f"""with x as ({SQL["redact_corpus"].strip()}) select doc_id, redacted_md5, n_protect, status from x where status = 'protected'""")
def redacted_sink(spark, sf):
    rows = materialize(sinks.redacted_rows(redacted(spark, sf)))
    sink = _written_again(sinks.redacted_sink(spark, new_folder(spark, "redacted")), rows)
    return sink.rows().select("doc_id", F.md5("text").alias("redacted_md5"), "n_protect", "status")


@query("decision_queue_sink", f"""select doc_id, pii_type, sha256(canonical) as canonical_sha256, risk, min(start) as first_start, cast(count(*) as integer) as n
   from {_adjusted_sql} where risk = 3 group by doc_id, pii_type, canonical, risk""")
def decision_queue_sink(spark, sf):
    rows = J.decide_rows(flagship.scan_findings(documents(spark, sf)), J.Policy())
    items = materialize(sinks.queue_rows(J.decision_items(rows)))
    sink = _written_again(sinks.decision_queue_sink(spark, new_folder(spark, "queue")), items)
    return sink.rows().drop("detector_id", "batch")


@query("protect_all", f"select pii_type, count(*) as n, sum(start) as starts from {_adjusted_sql} group by pii_type")
def protect_all(spark, sf):
    rows = J.protect_all(J.decide_rows(flagship.scan_findings(documents(spark, sf)), J.Policy()))
    return rows.where("disposition = 'Protect'").groupBy("pii_type").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


# a reviewer protects values whose start is even, keeps the others with one or two confirmations
_choice = "case when first_start % 2 = 0 then 'protect' else 'keep' end"


@query("resolve_decisions", f"""
  with items as (select doc_id, canonical, pii_type, min(start) as first_start from {_adjusted_sql} where risk = 3 group by all),
  settled as (select *, {_choice} as choice, first_start % 2 = 0 or first_start % 3 = 0 as ok from items where doc_id % 5 <> 0)
  select f.doc_id, f.start, case when f.risk < 3 then 'Protect' when s.ok is null or not s.ok then 'NeedsDecision' when s.choice = 'protect' then 'Protect' else 'Bypass' end as disposition
  from {_adjusted_sql} f left join settled s on f.risk = 3 and s.doc_id = f.doc_id and s.canonical = f.canonical and s.pii_type = f.pii_type""")
def resolve_decisions(spark, sf):
    docs = documents(spark, sf)
    rows = J.decide_rows(flagship.scan_findings(docs), J.Policy())
    # the choices of every fifth document were made for an older text and do not count
    hashes = docs.selectExpr("doc_id", "case when doc_id % 5 = 0 then 'old' else upper(sha2(text, 256)) end as text_sha256")
    decisions = J.decision_items(rows).join(hashes, "doc_id").selectExpr(
        "doc_id", "text_sha256", "pii_type", "canonical", "risk", "detector_id", f"{_choice} as choice",
        "case when first_start % 3 = 0 then 2 else 1 end as n_confirm")
    return J.resolve_decisions(docs, rows, decisions).select("doc_id", "start", "disposition")


def _review(spark, sf):
    """Texts, decided findings and choices of a review.  One text in five was reviewed in an older version; one in seven
    also with an item that its findings do not have."""
    docs = documents(spark, sf)
    rows = J.decide_rows(flagship.scan_findings(docs), J.Policy())
    hashes = docs.selectExpr("doc_id", "case when doc_id % 5 = 0 then 'old' else upper(sha2(text, 256)) end as text_sha256")
    choices = J.decision_items(rows).join(hashes, "doc_id").selectExpr(
        "doc_id", "text_sha256", "pii_type", "explode(if(doc_id % 7 = 0, array(canonical, 'gone'), array(canonical))) as canonical", "risk", "detector_id",
        "case when doc_id % 3 = 0 then 'keep' else 'protect' end as choice", "case when doc_id % 2 = 0 then 2 else 1 end as n_confirm")
    return docs, rows, choices


_release_f = f"""f as (select *, case when risk < 3 or doc_id % 3 <> 0 then 'Protect' else 'Bypass' end as disposition from {_adjusted_sql}
    where doc_id in (select doc_id from {_adjusted_sql} where risk = 3))"""
_labels = " ".join(f"when '{t}' then '{label}'" for t, _, label in dims.PII_TYPES)


@query("release_decisions", f"""
  with {_release_f},
  v as (select doc_id, pii_type, canonical, min(start) as first from f where disposition = 'Protect' group by all),
  a as (select *, '[' || case pii_type {_labels} end || row_number() over (partition by doc_id, pii_type order by first) || ']' as token from v),
  e as (select f.doc_id, f.start, f.len, a.token, coalesce(lag(f.start + f.len) over (partition by f.doc_id order by f.start), 0) as prev_end
        from f join a using (doc_id, pii_type, canonical) where disposition = 'Protect'),
  r as (select e.doc_id, string_agg(substr(d.text, prev_end + 1, start - prev_end) || token, '' order by start) as head, max(start + len) as stop
        from e join documents d using (doc_id) group by e.doc_id),
  c as (select doc_id, {_n("risk = 3")} as n_asked, {_n("disposition = 'Protect'")} as n_final, {_n("risk < 3")} as n_sure from f group by doc_id),
  x as (select c.*, doc_id % 5 <> 0 and (doc_id % 3 <> 0 or doc_id % 2 = 0) as settled, doc_id % 5 <> 0 and doc_id % 7 = 0 as stray from c),
  y as (select *, case when stray then 'stale' when not settled then 'waiting' when n_final = 0 then 'kept' when doc_id % 3 = 0 then 'released_partly' else 'released' end as status from x)
  select y.doc_id, md5(case when status like 'released%' then r.head || substr(d.text, r.stop + 1) else d.text end) as redacted_md5,
     cast(case when settled then n_final else n_sure end as integer) as n_protect, cast(case when settled then 0 else n_asked end as integer) as n_pending,
     cast(case when settled and doc_id % 3 = 0 then n_asked else 0 end as integer) as n_kept, status
  from y join documents d using (doc_id) left join r using (doc_id)""")
def release_decisions(spark, sf):
    docs, rows, choices = _review(spark, sf)
    out = J.release_decisions(docs, materialize(rows.drop("surface")), materialize(choices))
    return out.select("doc_id", F.md5("redacted").alias("redacted_md5"), "n_protect", "n_pending", "n_kept", "status")


@query("verify_rewrite", f"""with x as ({SQL["redact_corpus"].strip()}) select doc_id, case when doc_id % 3 = 0 then 'Limited' else 'Verified' end as status from x where status = 'protected'""")
def verify_rewrite(spark, sf):
    plan = redacted(spark, sf).where("n_protect > 0 and n_pending = 0")
    # every third write was changed behind our back
    sink = plan.selectExpr("doc_id", "case when doc_id % 3 = 0 then concat(redacted, ' ') else redacted end as text")
    return reports.verify_rewrite(plan, sink)


@query("residue_check", f"""select doc_id, substr(d.text, f.start + 1, f.len) as surface from {_adjusted_sql} f join documents d using (doc_id)
   where risk < 3 and exists (select 1 from {_adjusted_sql} g where g.doc_id = f.doc_id and g.risk = 3) group by all""")
def residue_check(spark, sf):
    """Protected values that are still in the output: only texts held back for a decision have any."""
    docs = documents(spark, sf)
    rows = J.decide_rows(flagship.scan_findings(docs), J.Policy())
    return reports.residue(rows, redacted(spark, sf), "redacted")


@query("diff_pipelines", f"select doc_id, start, len, canonical, 'only_a' as side from {_found_sql} where pii_type = 'Email'")
def diff_pipelines(spark, sf):
    docs, cols = documents(spark, sf), ["doc_id", "start", "len", "canonical"]
    a = scan_rule(docs, "global.email", "global.ip").select(*cols)
    return reports.diff_pipelines(a, scan_rule(docs, "global.ip").select(*cols))


@query("pii_inventory", f"""select source, lang, pii_type, count(*) as n, count(*) filter (where quality = 1) as n_good, count(*) filter (where toxic = 1) as n_toxic
   from {_adjusted_sql} join documents using (doc_id) left join labels using (doc_id) group by source, lang, pii_type""")
def pii_inventory(spark, sf):
    rows = explode_findings(J.scan_resolved(documents(spark, sf)), "findings", "doc_id", "source", "lang")
    return reports.pii_inventory(rows, table(spark, sf, "labels"))


def _with_values(spark, sf):
    """Conversation turns with a phone number (shared by turns of one parity) and an address of the turn."""
    return spread(table(spark, sf, "conversations"), "conv_id", "turn").selectExpr(
        "conv_id", "turn", "concat('call 010-1234-', lpad(cast(turn % 2 as string), 4, '0'), ' or u', cast(turn % 3 as string), '@mail.kr ', text) as text")


@query("redact_conversations", """
  with t as (select conv_id, turn, turn % 2 as p, turn % 3 as e, text from conversations),
  pn as (select conv_id, p, rank() over (partition by conv_id order by min(turn)) as n from t group by conv_id, p),
  en as (select conv_id, e, rank() over (partition by conv_id order by min(turn)) as n from t group by conv_id, e)
  select conv_id, turn, md5('call [전화번호' || pn.n || '] or [이메일' || en.n || '] ' || text) as redacted_md5, 'protected' as status
  from t join pn using (conv_id, p) join en using (conv_id, e)""")
def redact_conversations(spark, sf):
    return flagship.redact_conversations(_with_values(spark, sf)).select(
        "conv_id", "turn", F.md5("redacted").alias("redacted_md5"), "status")


def _tickets(text: str):
    return [(m.start(), len(m[0]), m[0].lower()) for m in re.finditer("[Nn]ote-[0-9]", text)]


def user_rule_set() -> RuleSet:
    """Two types of a user's own, one found by a pattern and one by a function; of hosts and addresses the address stays."""
    rules = RuleSet()
    rules.type("Ticket", "티켓")
    rules.type("Note", "메모")
    rules.pattern("my.ticket", "Ticket", r"TKT-[0-9]{6}(?![0-9])", valid=lambda x: ~x.endswith("00"))
    rules.pattern("my.host", "Note", "host-[a-z]+")
    rules.python("my.note", "Note", _tickets)
    rules.arbiter(["my.host", "global.email"], lambda found: F.filter(
        found, lambda f: (f["detector_id"] == "global.email") | ~F.exists(found, lambda g: g["detector_id"] == "global.email")))
    return rules


_user_text = """concat('see TKT-', lpad(cast(o_orderkey % 1000 as string), 6, '0'), ', TKT-', lpad(cast(o_orderkey % 3 as string), 6, '0'), ' Note-1 note-1 note-', o_orderkey % 5,
   ' host-a', if(o_orderkey % 2 = 0, ' a@b.co', ''))"""


@query("user_rules", """with k as (select o_orderkey as doc_id, o_orderkey % 1000 as a, o_orderkey % 3 as b, o_orderkey % 5 as n, o_orderkey % 2 = 0 as mail from orders),
  t as (select *, a % 100 <> 0 as first, b <> 0 as second from k)
  select doc_id, 'see ' || case when first then '[티켓1]' else 'TKT-' || lpad(a::varchar, 6, '0') end || ', ' ||
    case when second then '[티켓' || case when first and a <> b then 2 else 1 end || ']' else 'TKT-000000' end || ' [메모1] [메모1] [메모' || case when n = 1 then 1 else 2 end || '] ' ||
    case when mail then 'host-a [이메일1]' else '[메모' || case when n = 1 then 2 else 3 end || ']' end as redacted from t""")
def user_rules(spark, sf):
    rules = user_rule_set()
    docs = text_rows(spark, sf, "orders", "o_orderkey", _user_text)
    return J.redact_corpus(docs, J.Policy(renderer=rules.render), rules).select("doc_id", "redacted")
