"""Number checks and canonical forms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

# Checksum weights and the longest length of each month.
RRN_WEIGHTS = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]
ABA_WEIGHTS = [3, 7, 1, 3, 7, 1, 3, 7, 1]
DAYS_IN_MONTH = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def weighted_digit_sum(digits: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(digits, i + 1, 1).cast("int") * w
    return total


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def rrn_checksum(digits13: Column) -> Column:
    check = (F.lit(11) - weighted_digit_sum(digits13, RRN_WEIGHTS) % 11) % 10
    return check == F.substring(digits13, 13, 1).cast("int")


def aba_checksum(value: Column) -> Column:
    """Nine digits, an issued prefix range and a weighted sum divisible by ten."""
    return F.when(
        value.rlike("^(?:0[0-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)[0-9]{7}$"),
        weighted_digit_sum(value, ABA_WEIGHTS) % 10 == 0,
    ).otherwise(F.lit(False))


def is_plausible_date(mm: Column, dd: Column) -> Column:
    days = F.array(*[F.lit(d) for d in DAYS_IN_MONTH])
    month, day = mm.cast("int"), dd.cast("int")
    return month.between(1, 12) & (day >= 1) & (day <= F.get(days, month - 1))


def ssn_range_violation(digits: Column) -> Column:
    area, group, serial = F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4)
    return (
        F.when(area == "000", "Area000")
        .when(area == "666", "Area666")
        .when(area >= "900", "Area900To999")
        .when(group == "00", "Group00")
        .when(serial == "0000", "Serial0000")
    )


def itin_violation(digits: Column) -> Column:
    group = F.substring(digits, 4, 2)
    return (
        F.when(~digits.startswith("9"), "ItinAreaNotNine")
        .when(group < "50", "ItinRangeBelow50")
        .when(group.between("66", "69"), "ItinRangeGap66To69")
        .when(group == "89", "ItinRange89Excluded")
        .when(group == "93", "ItinRange93Excluded")
    )


def atin_violation(digits: Column) -> Column:
    return F.when(~digits.startswith("9"), "AtinAreaNotNine").when(
        F.substring(digits, 4, 2) != "93", "AtinRequires93"
    )


def number_shape(s: Column) -> Column:
    """Shape of a nine-digit number: compact, dashed, spaced, mixed or unsupported separators, or NULL."""
    d = r"\p{Nd}"
    return (
        F.when(s.rlike(rf"^{d}{{9}}\z"), "compact")
        .when(s.rlike(rf"^{d}{{3}}-{d}{{2}}-{d}{{4}}\z"), "dashed")
        .when(s.rlike(rf"^{d}{{3}} {d}{{2}} {d}{{4}}\z"), "spaced")
        .when(s.rlike(rf"^{d}{{3}}[- ]{d}{{2}}[- ]{d}{{4}}\z"), "mixed")
        .when(s.rlike(rf"(?s)^{d}{{3}}[^\p{{L}}\p{{Nd}}]{d}{{2}}[^\p{{L}}\p{{Nd}}]{d}{{4}}\z"), "unsupported")
    )


def hemisphere_sign(magnitude: Column, negative: Column) -> Column:
    unsigned = F.regexp_replace(magnitude, "^[+-]", "")
    return F.when(negative, F.concat(F.lit("-"), unsigned)).otherwise(unsigned)


def normalize_number(raw: Column) -> Column:
    """Drop a plus sign and trailing zeros of the fraction; keep the sign and leading digits."""
    unplussed = F.regexp_replace(raw, r"^\+", "")
    return F.when(raw.contains("."), F.regexp_replace(unplussed, r"\.?0+$", "")).otherwise(unplussed)


def evidence_code(structure: Column, context: Column, jurisdiction: Column) -> Column:
    """Combine evidence flags into the ordered code (1 C, 2 S, 3 C+J, 4 S+J, 5 S+C, 6 all)."""
    return (
        F.when(structure & context & jurisdiction, 6)
        .when(structure & context, 5)
        .when(structure & jurisdiction, 4)
        .when(context & jurisdiction, 3)
        .when(structure, 2)
        .when(context, 1)
        .otherwise(0)
    )


def ipv4_valid(s: Column) -> Column:
    return F.forall(F.split(s, r"\.", -1), lambda o: o.cast("int") <= 255)


def ipv6_groups(candidate: Column) -> Column:
    """The eight 16-bit groups of an IPv6 text, or NULL when it does not parse."""
    s = F.lower(candidate)
    dotted = F.regexp_extract(s, r":((?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3})$", 1)

    def hex_tail(q: Column) -> Column:
        octets = F.transform(F.split(q, r"\."), lambda o: o.cast("int"))
        word = lambda i: F.lower(F.hex(F.get(octets, i) * 256 + F.get(octets, i + 1)))
        return F.concat(word(F.lit(0)), F.lit(":"), word(F.lit(2)))

    def expand(q: Column) -> Column:
        flat = F.when(q == "", s).otherwise(F.concat(F.left(s, F.length(s) - F.length(q)), hex_tail(q)))
        bad_quad = (q != "") & ~ipv4_valid(F.when(q == "", F.lit("0")).otherwise(q))

        def groups(h: Column) -> Column:
            part = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
            left = part(F.substring_index(h, "::", 1))
            right = F.when(h.contains("::"), part(F.substring_index(h, "::", -1))).otherwise(F.array().cast("array<string>"))
            n = F.size(left) + F.size(right)
            run = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
            ok = h.rlike(rf"^(?:{run}|(?:{run})?::(?:{run})?)$") & F.when(h.contains("::"), n <= 7).otherwise(n == 8)
            filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - n, F.lit(0))), right)
            return F.when(ok & ~bad_quad, F.transform(filled, lambda g: F.conv(g, 16, 10).cast("int")))

        return let(flat, groups)

    return let(dotted, expand)


def ipv6_text(groups: Column) -> Column:
    """Compressed lower-case text: longest zero run of two or more, first on ties; dotted tail where the form embeds IPv4."""

    def render(g: Column) -> Column:
        n = lambda i: F.get(g, F.lit(i))
        lead = (n(0) == 0) & (n(1) == 0) & (n(2) == 0) & (n(3) == 0) & (n(6) != 0)
        embedded = (
            (lead & (n(4) == 0) & n(5).isin(0, 0xFFFF))
            | (lead & (n(4) == 0xFFFF) & (n(5) == 0))
            | ((n(4) == 0) & (n(5) == 0x5EFE))
        )
        octet = lambda v: v.cast("string")
        dotted = F.concat_ws(
            ".", octet(F.shiftright(n(6), 8)), octet(n(6) % 256), octet(F.shiftright(n(7), 8)), octet(n(7) % 256)
        )
        words = F.transform(g, lambda v: F.lower(F.hex(v)))
        parts = F.when(embedded, F.array_append(F.slice(words, 1, 6), dotted)).otherwise(words)

        def compress(ps: Column) -> Column:
            bits = F.array_join(F.transform(ps, lambda p: F.when(p == "0", "0").otherwise("1")), "")

            def cut(b: Column) -> Column:
                best = F.coalesce(*[
                    F.when(F.instr(b, "0" * k) > 0, F.struct((F.instr(b, "0" * k) - 1).alias("at"), F.lit(k).alias("n")))
                    for k in range(8, 1, -1)
                ])
                return let(
                    best,
                    lambda r: F.when(r.isNull(), F.array_join(ps, ":")).otherwise(
                        F.concat(
                            F.array_join(F.slice(ps, 1, r["at"]), ":"),
                            F.lit("::"),
                            F.array_join(F.slice(ps, r["at"] + r["n"] + 1, 8), ":"),
                        )
                    ),
                )

            return let(bits, cut)

        return let(parts, compress)

    return let(groups, render)
