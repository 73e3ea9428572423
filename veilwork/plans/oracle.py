"""Helpers that write the comparison SQL (for an engine without look-around in its patterns)."""

from __future__ import annotations


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def matches(source: str, pattern: str, key: str = "doc_id", text: str = "text") -> str:
    """Every match of ``pattern`` with its 0-based start and the character on either side."""
    return f"""(
      select {key}, m, st, substr({text}, st, 1) as prev_c, substr({text}, st + length(m) + 1, 1) as next_c,
             substr({text}, st + length(m) + 1, 2) as next_2, {text}
      from (
        select {key}, {text}, unnest(ms) as m,
               unnest(list_transform(range(1, len(ms) + 1), lambda i:
                 list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)
               ))::integer as st
        from (select {key}, {text}, regexp_extract_all({text}, {q(pattern)}) as ms,
                     string_split_regex({text}, {q(pattern)}) as gs from {source})
        where len(ms) > 0))"""


def luhn(digits: str) -> str:
    return f"""(list_sum(list_transform(range(1, length({digits}) + 1), lambda i:
      case when (length({digits}) - i) % 2 = 1
           then case when substr({digits}, i, 1)::int * 2 > 9 then substr({digits}, i, 1)::int * 2 - 9 else substr({digits}, i, 1)::int * 2 end
           else substr({digits}, i, 1)::int end)) % 10 = 0)"""


def ints(**cols: str) -> str:
    """``cast(expr as integer) as name`` for each keyword."""
    return ", ".join(f"cast({e} as integer) as {n}" for n, e in cols.items())
