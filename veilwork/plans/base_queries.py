"""Registered queries over the base scans, text functions and sources, with comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims, text as T
from ..functions import checks as C
from ..operators import base_rules, fields
from ..operators.base_rules import scan_rule
from . import oracle as O
from .texts import case, documents, letter, pad, sql_over, table, text_rows

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


OUT = ["doc_id", "start", "len", "canonical", "risk", "conf"]


def _scan(detector: str, source: str, key: str, text: str, sql_rows: str, real: str | None = None) -> None:
    """A scan over derived texts (positions known by arithmetic) and, with ``real``, over the documents as well.

    ``sql_rows`` lists (condition, start, len, canonical, risk, conf) rows over the source table.
    """
    name = "scan_" + detector

    def run(spark, sf):
        rows = text_rows(spark, sf, source, f"-1 - {key}", text)
        if real:
            rows = rows.unionByName(documents(spark, sf).select("doc_id", "text"))
        return scan_rule(rows, IDS[detector]).select(*OUT)

    QUERIES[name] = run
    SQL[name] = " union all ".join([r for r in [sql_rows, real] if r])


IDS = {"kr_phone": "kr.phone", "email": "global.email", "kr_rrn": "kr.rrn", "card": "global.card",
       "kr_bank_account": "kr.bank_account", "secret": "global.secret", "ip": "global.ip", "mac": "global.mac",
       "gps": "global.gps"}


def rows_sql(source: str, key: str, forms: list[tuple | None], extra: str = "") -> str:
    """One SELECT per form of a CASE text: (start, len, canonical, risk, conf)."""
    parts = []
    for i, f in enumerate(forms):
        for one in (f if isinstance(f, list) else [f]):
            if one is None:
                continue
            st, ln, canonical, risk, conf = one[:5]
            where = f" and ({one[5]})" if len(one) > 5 else ""
            parts.append(
                f"select cast(-1 - {key} as bigint) as doc_id, {O.ints(start=st, len=ln)}, {canonical} as canonical, "
                f"{O.ints(risk=risk, conf=conf)} from {source} where {key} % {len(forms)} = {i}{where}{extra}"
            )
    return " union all ".join(parts)


# --- phone
_mid, _last = pad("o_orderkey % 10000", 4), pad("(o_orderkey * 7) % 10000", 4)
_scan(
    "kr_phone", "orders", "o_orderkey",
    case("o_orderkey", [
        f"'연락처 010-' || {_mid} || '-' || {_last} || ' 입니다'", f"'전화 010 ' || {_mid} || ' ' || {_last}",
        f"'tel +82 10-' || {_mid} || '-' || {_last}", f"'010' || {_mid} || {_last}",
        f"'1010-' || {_mid} || '-' || {_last}", f"'02-555-' || {_last} || '.'",
    ]),
    rows_sql("orders", "o_orderkey", [
        (4, 13, f"'010' || {_mid} || {_last}", 2, 3), (3, 13, f"'010' || {_mid} || {_last}", 2, 3),
        (4, 16, f"'010' || {_mid} || {_last}", 2, 3), (0, 11, f"'010' || {_mid} || {_last}", 2, 3),
        None, (0, 11, f"'02555' || {_last}", 2, 3),
    ]),
    real=f"""select doc_id, {O.ints(start='st', len='length(m)')}, regexp_replace(m, '[^0-9]', '', 'g') as canonical,
      {O.ints(risk=2, conf=3)} from {O.matches("documents", r"0(?:2|3[1-3]|4[1-4]|5[1-5]|6[1-4]|10|70|50[2-9]?)[-\s]{0,3}[0-9]{3,4}[-\s]{0,3}[0-9]{4}")}
      where not regexp_matches(prev_c, '[0-9]') and not regexp_matches(next_c, '[0-9]')""",
)

# --- e-mail
_local = "[A-Za-z0-9_+-]+(?:\\.[A-Za-z0-9_+-]+)*"
_label = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_name = "'user' || cast(c_custkey as string)"
_scan(
    "email", "customer", "c_custkey",
    case("c_custkey", [
        f"'mail ' || {_name} || '@Example.com now'", f"{_name} || ' (at) example (dot) com'",
        f"'x ' || {_name} || '@example(dot)org'", f"{_name} || '..x@example.com'",
        f"'<' || {_name} || '.b@mail.example.co.kr>'", f"{_name} || '@example.com1'",
    ]),
    rows_sql("customer", "c_custkey", [
        (5, f"length({_name}) + 12", f"{_name} || '@example.com'", 2, 3),
        (0, f"length({_name}) + 23", f"{_name} || '@example.com'", 2, 2),
        (2, f"length({_name}) + 16", f"{_name} || '@example.org'", 2, 2),
        None,
        (1, f"length({_name}) + 21", f"{_name} || '.b@mail.example.co.kr'", 2, 3),
        None,
    ]),
    real=f"""select doc_id, {O.ints(start='st', len='length(m)')}, lower(m) as canonical, {O.ints(risk=2, conf=3)}
      from {O.matches("documents", _local + "@" + _label + r"(?:\." + _label + r")*\.[A-Za-z]{2,}")}
      where not regexp_matches(prev_c, '[A-Za-z0-9_+.@-]') and not regexp_matches(next_c, '[0-9@-]')""",
)

# --- resident number
_yy, _mm, _dd = pad("o_orderkey % 100", 2), pad("o_orderkey % 12 + 1", 2), pad("o_orderkey % 31 + 1", 2)
_sex, _back5 = "cast(o_orderkey % 8 + 1 as string)", pad("(o_orderkey * 13) % 100000", 5)
_body = f"({_yy} || {_mm} || {_dd} || {_sex} || {_back5})"
_weights = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]
_sum = " + ".join(f"cast(substr({_body}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(_weights))
_check = f"((11 - ({_sum}) % 11) % 10)"
_days = "case o_orderkey % 12 + 1 when 2 then 29 when 4 then 30 when 6 then 30 when 9 then 30 when 11 then 30 else 31 end"
_plaus = f"o_orderkey % 31 + 1 <= {_days}"
_front = f"{_yy} || {_mm} || {_dd} || '-' || {_sex}"
_scan(
    "kr_rrn", "orders", "o_orderkey",
    case("o_orderkey", [
        f"'id ' || {_front} || {_back5} || cast({_check} as string) || ' ok'",
        f"'id ' || {_front} || {_back5} || cast(({_check} + 1) % 10 as string)",
        f"'주민등록번호: ' || {_front} || {_back5} || cast(({_check} + 1) % 10 as string)",
        f"'id ' || {_front} || '******' || ' masked'",
        f"'id 9' || {_front} || {_back5} || '1'",
    ]),
    rows_sql("orders", "o_orderkey", [
        (3, 14, f"{_body} || cast({_check} as string)", 3, 3),
        (3, 14, f"{_body} || cast(({_check} + 1) % 10 as string)", 3, 2),
        (8, 14, f"{_body} || cast(({_check} + 1) % 10 as string)", 3, 3),
        (3, 14, f"{_yy} || {_mm} || {_dd} || {_sex} || '******'", 3, 2),
        None,
    ], f" and {_plaus}"),
)

# --- card
_c15 = f"('4' || {pad('o_orderkey % 10000000', 7)} || {pad('(o_orderkey * 11) % 10000000', 7)})"
_double = lambda d: f"case when {d} * 2 > 9 then {d} * 2 - 9 else {d} * 2 end"
_digit = lambda i: f"cast(substr({_c15}, {i}, 1) as int)"
_luhn_sum = " + ".join(_double(_digit(i)) if i % 2 == 1 else _digit(i) for i in range(1, 16))
_cd = f"((10 - ({_luhn_sum}) % 10) % 10)"
_good, _off = f"({_c15} || cast({_cd} as string))", f"({_c15} || cast(({_cd} + 1) % 10 as string))"
_four = lambda c, s: f" || '{s}' || ".join(f"substr({c}, {i}, 4)" for i in (1, 5, 9, 13))
_scan(
    "card", "orders", "o_orderkey",
    case("o_orderkey", [
        f"'pay ' || {_four(_good, '-')} || ' thanks'", f"'num ' || {_off}", f"'카드번호 ' || {_four(_off, ' ')}",
        f"'카드번호 ' || substr({_good}, 1, 4) || '-****-****-' || substr({_good}, 13, 4)",
        f"'see ' || substr({_good}, 1, 4) || '-****-****-' || substr({_good}, 13, 4)", f"{_good} || '7'",
    ]),
    rows_sql("orders", "o_orderkey", [
        (4, 19, _good, 3, 3), None, (5, 19, _off, 3, 2),
        (5, 19, f"substr({_good}, 1, 4) || '********' || substr({_good}, 13, 4)", 3, 3), None, None,
    ]),
    real=f"""select doc_id, {O.ints(start='st', len='length(m)')}, regexp_replace(m, '[^0-9]', '', 'g') as canonical,
      {O.ints(risk=3, conf=3)} from {O.matches("documents", r"[0-9]{4}[-\s]{0,3}[0-9]{4}[-\s]{0,3}[0-9]{4}[-\s]{0,3}[0-9]{4}")}
      where not regexp_matches(prev_c, '[0-9*]') and not regexp_matches(next_c, '[0-9*]')
        and {O.luhn("regexp_replace(m, '[^0-9]', '', 'g')")}""",
)

# --- Korean bank account: 88 in the middle keeps the number from reading as a date or a phone number
_b1, _b2 = pad("o_orderkey % 1000", 3), pad("(o_orderkey * 3) % 1000000", 6)
_scan(
    "kr_bank_account", "orders", "o_orderkey",
    case("o_orderkey", [
        f"'계좌 ' || '9' || {_b1} || '-88-' || {_b2} || ' 로'", f"'은행 ' || '9' || {_b1} || '-88-' || {_b2}",
        f"'order 9' || {_b1} || '-88-' || {_b2}", f"'예금주 9' || {_b1} || '-88-*******'",
        f"'은행 9' || {_b1} || '-88-*******'", "'계좌 010-1234-5678'",
    ]),
    rows_sql("orders", "o_orderkey", [
        (3, 14, f"'9' || {_b1} || '88' || {_b2}", 3, 3), (3, 14, f"'9' || {_b1} || '88' || {_b2}", 3, 2), None,
        (4, 15, f"'9' || {_b1} || '88*******'", 3, 3), None, None,
    ]),
)

# --- secret
_tok = "substr(md5(cast(c_custkey as string)), 1, 24)"
_scan(
    "secret", "customer", "c_custkey",
    case("c_custkey", [
        f"'api_key=A1' || {_tok} || ' end'", f"'?token=A1' || {_tok}", "'?token=abc123xyz'",
        f"'Authorization: Bearer A1' || {_tok}", "'password: letters'", f"'token = \"A1' || {_tok} || '\"'",
    ]),
    rows_sql("customer", "c_custkey", [
        (8, 26, f"'A1' || {_tok}", 3, 3), (7, 26, f"'A1' || {_tok}", 3, 3), None, (22, 26, f"'A1' || {_tok}", 3, 3), None,
        (9, 26, f"'A1' || {_tok}", 3, 3),
    ]),
    real=f"""select doc_id, {O.ints(start='st + 9', len=40)}, substr(m, 10, 40) as canonical, {O.ints(risk=3, conf=3)}
      from {O.matches("documents", 'token = "[0-9a-f]{40}"')} where not regexp_matches(prev_c, '[A-Za-z0-9]')""",
)

# --- IP
_oct = lambda e: f"cast({e} as string)"
_ip = f"'10.' || {_oct('c_custkey % 256')} || '.' || {_oct('(c_custkey * 7) % 256')} || '.' || {_oct('c_custkey % 200')}"
_hex = "substr('123456789abcdef', cast(c_custkey % 15 as int) + 1, 1)"
_scan(
    "ip", "customer", "c_custkey",
    case("c_custkey", [
        f"'host ' || {_ip} || ':8080'", f"{_ip} || '.log'", f"{_ip} || '.5'", "'256.1.1.' || cast(c_custkey % 250 as string)",
        f"'v6 2001:DB8:0:0:0:0:0:' || upper({_hex}) || ' x'", f"'::ffff:' || {_ip}", f"'fe80::' || {_hex} || ':0:0:1'",
        f"'bad 1:2:3:4:5:6:7:8:' || {_hex}", f"'12:34:' || {pad('c_custkey % 60', 2)}",
    ]),
    rows_sql("customer", "c_custkey", [
        (5, f"length({_ip})", _ip, 2, 3), (0, f"length({_ip})", _ip, 2, 3), None, None,
        (3, "length('2001:DB8:0:0:0:0:0:') + 1", f"'2001:db8::' || {_hex}", 2, 3), (0, f"7 + length({_ip})", f"'::ffff:' || {_ip}", 2, 3),
        (0, 13, f"'fe80::' || {_hex} || ':0:0:1'", 2, 3), None, None,
    ]),
    real=f"""select doc_id, {O.ints(start='st', len='length(m)')}, m as canonical, {O.ints(risk=2, conf=3)}
      from {O.matches("documents", r"(?:0|[1-9][0-9]{0,2})\.(?:0|[1-9][0-9]{0,2})\.(?:0|[1-9][0-9]{0,2})\.(?:0|[1-9][0-9]{0,2})")}
      where not regexp_matches(prev_c, '[0-9A-Za-z.]') and not regexp_matches(next_2, '^([0-9A-Za-z]|[.][0-9])')
        and list_bool_and(list_transform(string_split(m, '.'), lambda o: o::int <= 255))""",
)

# --- MAC
_hx = lambda e: f"substr('0123456789ABCDEF', cast(({e}) % 16 as int) + 1, 1)"
_pairs = [f"{_hx(f'p_partkey + {i}')} || {_hx(f'p_partkey * {i + 3}')}" for i in range(6)]
_join = lambda s: f" || '{s}' || ".join(_pairs)
_scan(
    "mac", "part", "p_partkey",
    case("p_partkey", [
        f"'mac ' || {_join(':')} || '.'", f"'mac ' || {_join('-')}", f"{_join(':')} || ':11'", f"'a' || {_join('-')}",
    ]),
    rows_sql("part", "p_partkey", [
        (4, 17, f"lower({_join(':')})", 2, 3), (4, 17, f"lower({_join(':')})", 2, 3), None, None,
    ]),
)

# --- coordinates
_lat = f"cast(p_partkey % 90 as string) || '.' || {pad('p_partkey % 1000', 3)} || '1'"
_lon = f"cast(p_partkey % 180 as string) || '.' || {pad('(p_partkey * 3) % 1000', 3)} || '2'"
_ll = f"length({_lat})"
_lo = f"length({_lon})"
_pair = f"{_lat} || ',' || {_lon}"
_scan(
    "gps", "part", "p_partkey",
    case("p_partkey", [
        f"'lat=' || {_lat} || ', lon=' || {_lon} || ' 근처'", f"'경도: ' || {_lon} || ' 위도: ' || {_lat}",
        f"'at ' || {_lat} || 'S ' || {_lon} || 'E here'", f"'위치 ' || {_lat} || ', ' || {_lon}", f"'v ' || {_lat} || ',' || {_lon}",
        f"'lat=' || {_lat} || ' and far away beyond the forty character gap lon=' || {_lon}", f"'a' || {_lat} || ', ' || {_lon}",
    ]),
    rows_sql("part", "p_partkey", [
        (4, f"{_ll} + 6 + {_lo}", _pair, 2, 3), (4, f"{_lo} + 5 + {_ll}", _pair, 2, 3),
        (3, f"{_ll} + {_lo} + 3", f"'-' || {_pair}", 2, 3), (3, f"{_ll} + {_lo} + 2", _pair, 2, 3),
        [(2, f"{_ll} + {_lo} + 1", _pair, 1, 1, "p_partkey % 180 < 90"), (2, f"{_ll} + {_lo} + 1", _pair, 1, 2, "p_partkey % 180 >= 90")],
        None, None,
    ]),
)

# --- normalisation and spans -----------------------------------------------------------------
_zw = "'\u200b'"
_fw = "translate(cast(o_orderkey as string), '0123456789', '０１２３４５６７８９')"
_norm_text = case("o_orderkey", [f"'n ' || {_fw} || ' x'", f"'a' || {_zw} || cast(o_orderkey as string) || {_zw} || 'b'", "'plain ' || cast(o_orderkey as string)"])


@query("normalize_text", f"""select o_orderkey as doc_id, {case('o_orderkey', ["'n ' || cast(o_orderkey as string) || ' x'", "'a' || cast(o_orderkey as string) || 'b'", "'plain ' || cast(o_orderkey as string)"])} as norm from orders""")
def normalize_text(spark, sf):
    df = text_rows(spark, sf, "orders", "o_orderkey", _norm_text)
    return df.select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


# zero-width characters before, inside and after a phone number
_split_phone = f"'t' || {_zw} || ' 010-' || {_zw} || {_mid} || '-' || {_last} || {_zw} || ' end'"


@query("raw_span_map", f"""select o_orderkey as doc_id, {O.ints(start=3, len=14)}, '010-' || {_zw} || {_mid} || '-' || {_last} as surface from orders""")
def raw_span_map(spark, sf):
    df = text_rows(spark, sf, "orders", "o_orderkey", _split_phone)
    return scan_rule(df, "kr.phone").select("doc_id", "start", "len", "surface")


@query("split_lines", """
  select doc_id, cast(i - 1 as integer) as line, cast(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) as integer) as start,
         cast(length(ls[i]) as integer) as len, regexp_full_match(ls[i], '[ \\t]*') as blank
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents))""")
def split_lines(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.inline(T.lines("text")))
    return rows.select("doc_id", "line", "start", F.length("line_text").alias("len"), "blank")


# --- scalar functions ------------------------------------------------------------------------
@query("luhn", f"select o_orderkey as doc_id, o_orderkey % 2 = 0 as ok from orders")
def luhn(spark, sf):
    df = sql_over(spark, sf, "orders", "o_orderkey as doc_id", f"case when o_orderkey % 2 = 0 then {_good} else {_off} end as d")
    return df.select("doc_id", C.luhn(F.col("d")).alias("ok"))


@query("rrn_checksum", "select o_orderkey as doc_id, o_orderkey % 2 = 0 as ok from orders")
def rrn_checksum(spark, sf):
    d = f"{_body} || cast(({_check} + o_orderkey % 2) % 10 as string) as d"
    return sql_over(spark, sf, "orders", "o_orderkey as doc_id", d).select("doc_id", C.rrn_checksum(F.col("d")).alias("ok"))


_aba8 = f"({pad('o_orderkey % 100', 2)} || {pad('(o_orderkey * 17) % 1000000', 6)})"
_ad = lambda i: f"cast(substr({_aba8}, {i}, 1) as int)"
_aba_sum = f"(3 * ({_ad(1)} + {_ad(4)} + {_ad(7)}) + 7 * ({_ad(2)} + {_ad(5)} + {_ad(8)}) + {_ad(3)} + {_ad(6)})"
_aba = f"({_aba8} || cast((10 - {_aba_sum} % 10) % 10 as string))"


@query("aba_checksum", """select o_orderkey as doc_id, (o_orderkey % 100 <= 12 or o_orderkey % 100 between 21 and 32
   or o_orderkey % 100 between 61 and 72 or o_orderkey % 100 = 80) as ok from orders""")
def aba_checksum(spark, sf):
    df = sql_over(spark, sf, "orders", "o_orderkey as doc_id", f"{_aba} as d")
    return df.select("doc_id", C.aba_checksum(F.col("d")).alias("ok"))


@query("is_plausible_date", f"select o_orderkey as doc_id, {_plaus} as ok from orders")
def is_plausible_date(spark, sf):
    df = sql_over(spark, sf, "orders", "o_orderkey as doc_id", f"{_mm} as mm", f"{_dd} as dd")
    return df.select("doc_id", C.is_plausible_date(F.col("mm"), F.col("dd")).alias("ok"))


_types_sql = ", ".join(f"('{t}', {o}, '{label}')" for t, o, label in dims.PII_TYPES)


@query("alias_label", f"""select p_partkey as doc_id, t.pii_type, t.label from part
   join (values {_types_sql}) t(pii_type, type_ord, label) on p_partkey % 21 = t.type_ord""")
def alias_label(spark, sf):
    types = dims.pii_types(spark).select("pii_type", "type_ord")
    df = table(spark, sf, "part").join(types, F.col("p_partkey") % 21 == F.col("type_ord"))
    return df.select(F.col("p_partkey").alias("doc_id"), "pii_type", dims.alias_label(F.col("pii_type")).alias("label"))


@query("alias_token", f"""select p_partkey as doc_id, '[' || t.label || cast(p_size as varchar) || ']' as token from part
   join (values {_types_sql}) t(pii_type, type_ord, label) on p_partkey % 21 = t.type_ord""")
def alias_token(spark, sf):
    types = dims.pii_types(spark).select("pii_type", "type_ord")
    df = table(spark, sf, "part").join(types, F.col("p_partkey") % 21 == F.col("type_ord"))
    return df.select(F.col("p_partkey").alias("doc_id"), dims.alias_token(F.col("pii_type"), F.col("p_size")).alias("token"))


@query("alias_family", f"""select t.pii_type as family, t.label as stem, count(*) as n from part
   join (values {_types_sql}) t(pii_type, type_ord, label) on p_partkey % 21 = t.type_ord group by all""")
def alias_family(spark, sf):
    # a family is named like its only type, and its stem is the type's label
    df = table(spark, sf, "part").join(dims.pii_types(spark), F.col("p_partkey") % 21 == F.col("type_ord"))
    return df.groupBy(F.col("pii_type").alias("family"), F.col("label").alias("stem")).agg(F.count("*").alias("n"))


QUERIES["frozen_stem"] = QUERIES["alias_family"]
SQL["frozen_stem"] = SQL["alias_family"]


@query("mask_back", f"select o_orderkey as doc_id, case when o_orderkey % 3 = 0 then {_back5} else '*****' end as v from orders")
def mask_back(spark, sf):
    df = sql_over(spark, sf, "orders", "o_orderkey as doc_id", f"case o_orderkey % 3 when 0 then {_back5} when 1 then 'xxxxx' else '**X**' end as d")
    return df.select("doc_id", T.mask_back(F.col("d")).alias("v"))


@query("strip_separators", f"select o_orderkey as doc_id, {_b1} || {_b2} as v from orders")
def strip_separators(spark, sf):
    df = sql_over(spark, sf, "orders", "o_orderkey as doc_id", f"{_b1} || {case('o_orderkey', [repr('-'), repr(' '), 'chr(160)'])} || {_b2} as d")
    return df.select("doc_id", T.strip_separators(F.col("d")).alias("v"))


@query("hemisphere_sign", f"select p_partkey as doc_id, case when p_partkey % 2 = 0 then '-' else '' end || {_lat} as v from part")
def hemisphere_sign(spark, sf):
    sign = case("p_partkey", ["''", "'+'", "'-'"])
    df = sql_over(spark, sf, "part", "p_partkey as doc_id", f"{sign} || {_lat} as d", "p_partkey % 2 = 0 as south")
    return df.select("doc_id", C.hemisphere_sign(F.col("d"), F.col("south")).alias("v"))


@query("normalize_number", f"""select p_partkey as doc_id, case when p_partkey % 3 = 2 then '-' else '' end || cast(p_partkey as varchar)
   || case when p_partkey % 10 = 0 then '' else '.' || cast(p_partkey % 10 as varchar) end as v from part""")
def normalize_number(spark, sf):
    sign = case("p_partkey", ["''", "'+'", "'-'"])
    df = sql_over(spark, sf, "part", "p_partkey as doc_id", f"{sign} || cast(p_partkey as string) || '.' || cast(p_partkey % 10 as string) || '00' as d")
    return df.select("doc_id", C.normalize_number(F.col("d")).alias("v"))


@query("ascii_upper", "select doc_id, md5(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) as v from documents")
def ascii_upper(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(T.ascii_upper(F.col("text"))).alias("v"))


@query("ascii_equals_ignore_case", "select c_custkey as doc_id, c_custkey % 3 <> 2 as same from customer")
def ascii_equals_ignore_case(spark, sf):
    # é and É are different letters here: only ASCII folds
    other = case("c_custkey", ["upper(c_name)", "lower(c_name)", "c_name || 'É'"])
    df = sql_over(spark, sf, "customer", "c_custkey as doc_id", "c_name || case when c_custkey % 3 = 2 then 'é' else '' end as a", f"{other} as b")
    return df.select("doc_id", T.ascii_equals_ignore_case(F.col("a"), F.col("b")).alias("same"))


_ssn = lambda sep: f"{pad('o_orderkey % 1000', 3)} || {sep} || {pad('o_orderkey % 100', 2)} || {sep} || {pad('(o_orderkey * 3) % 10000', 4)}"
_group = "(o_orderkey % 100)"
_area = "(o_orderkey % 1000)"


@query("ssn_range_violation", f"""select o_orderkey as doc_id, case when {_area} = 0 then 'Area000' when {_area} = 666 then 'Area666'
   when {_area} >= 900 then 'Area900To999' when {_group} = 0 then 'Group00' when (o_orderkey * 3) % 10000 = 0 then 'Serial0000' end as reason from orders""")
def ssn_range_violation(spark, sf):
    return sql_over(spark, sf, "orders", "o_orderkey as doc_id", f"{_ssn(repr(''))} as d").select(
        "doc_id", C.ssn_range_violation(F.col("d")).alias("reason"))


@query("itin_violation", f"""select o_orderkey as doc_id, case when {_area} < 900 then 'ItinAreaNotNine' when {_group} < 50 then 'ItinRangeBelow50'
   when {_group} between 66 and 69 then 'ItinRangeGap66To69' when {_group} = 89 then 'ItinRange89Excluded' when {_group} = 93 then 'ItinRange93Excluded' end as reason from orders""")
def itin_violation(spark, sf):
    return sql_over(spark, sf, "orders", "o_orderkey as doc_id", f"{_ssn(repr(''))} as d").select(
        "doc_id", C.itin_violation(F.col("d")).alias("reason"))


@query("atin_violation", f"""select o_orderkey as doc_id, case when {_area} < 900 then 'AtinAreaNotNine' when {_group} <> 93 then 'AtinRequires93' end as reason from orders""")
def atin_violation(spark, sf):
    return sql_over(spark, sf, "orders", "o_orderkey as doc_id", f"{_ssn(repr(''))} as d").select(
        "doc_id", C.atin_violation(F.col("d")).alias("reason"))


_shapes = ["compact", "dashed", "spaced", "mixed", "unsupported"]


@query("number_shape", f"select o_orderkey as doc_id, {case('o_orderkey', [repr(s) for s in _shapes] + ['null'])} as shape from orders")
def number_shape(spark, sf):
    mixed = _ssn("'-'").replace("'-'", "' '", 1)
    text = case("o_orderkey", [_ssn("''"), _ssn("'-'"), _ssn("' '"), mixed, _ssn("'.'"), _ssn("'a'")])
    return sql_over(spark, sf, "orders", "o_orderkey as doc_id", f"{text} as d").select(
        "doc_id", C.number_shape(F.col("d")).alias("shape"))


@query("text_sha256", "select doc_id, case when text = '' then '' else upper(sha256(text)) end as h from documents")
def text_sha256(spark, sf):
    return documents(spark, sf).select("doc_id", T.text_sha256(F.col("text")).alias("h"))


@query("evidence_code", """select p_partkey as doc_id, cast(case p_partkey % 8 when 7 then 6 when 3 then 5 when 5 then 4 when 6 then 3 when 1 then 2
   when 2 then 1 else 0 end as integer) as code from part""")
def evidence_code(spark, sf):
    df = sql_over(spark, sf, "part", "p_partkey as doc_id", "p_partkey % 2 = 1 as s", "floor(p_partkey / 2) % 2 = 1 as c", "floor(p_partkey / 4) % 2 = 1 as j")
    return df.select("doc_id", C.evidence_code(F.col("s"), F.col("c"), F.col("j")).alias("code"))
