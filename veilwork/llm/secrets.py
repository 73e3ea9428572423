"""Secret scans with an assignment-aware lexer.

Base patterns find the usual forms.  Beside them, source and configuration syntax is read into name-literal pairs
(``name = "literal"``, ``"name": "literal"``, ``export NAME=value``, ``--name value``, ``<name>value</name>``), constants
are propagated (a name or ``${NAME}`` on the right side stands for its latest earlier literal, concatenations for all
their parts), and each literal is scored by the most sensitive name it reaches and by its own randomness.

Spans count code points, end exclusive.  Defined results: a null text is empty and has no spans; repeated rows are
scanned each on its own; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, fresh, texts

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_ROOTS = ("passw", "secret", "token", "api")  # one stands in each of its names
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so a shorter one cannot match anywhere


@dataclass(frozen=True)
class SecretRules:
    min_score: float = 1.4
    min_length: int = 8


#: How sensitive a target is, by the parts of its name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.7, "auth": 0.5, "authorization": 0.6, "signature": 0.4, "salt": 0.4, "private": 0.4, "api": 0.3,
    "access": 0.3, "client": 0.1, "signing": 0.4, "encryption": 0.4, "session": 0.2, "key": 0.5, "cookie": 0.3,
}
#: Words of values that stand for a secret without being one.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$?\{.*\}|changeme|placeholder|example.*|your[_-].*|none|null|true|false|undefined|todo)$")
#: A name with any weight holds one of the parts; parts that hold another need no test of their own.
_ROOTS = tuple(x for x in SENSITIVE if not any(y in x for y in SENSITIVE if y != x))
_STRING = r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\''
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_PAIR = re.compile(rf"""(?<![A-Za-z0-9_.\-])["']?({_NAME})["']?[ \t]*+(?::=|=>|[:=])[ \t]*+(?=[^\s=])""")
_FLAG = re.compile(rf"(?<!\S)--({_NAME})[ \t]++(?=[^\s=-])")
_TAG = re.compile(rf"<({_NAME})>([^<>\n]++)</\1>")
#: Whatever may be the name of a pair, a flag or a tag.
_AIMED = re.compile(rf"""(?<![A-Za-z0-9_.\-])([A-Za-z0-9_.\-]++)["']?[ \t]*+[:=]|--({_NAME})[ \t]|<({_NAME})>""")
_PART = re.compile(rf"""(?P<string>{_STRING})|\$\{{(?P<env>{_NAME})\}}|(?P<word>[^\s,;"'#(){{}}\[\]<>+]++)""")
_JOIN = re.compile(r"[ \t]*+\+?[ \t]*+")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns; ``low`` is the text in lower case."""
    named = any(root in low for root in ASSIGN_ROOTS)
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if named else []
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def name_weight(name: str) -> float:
    """Sum of the weights of the name's parts (``db.clientSecret`` has db, client, secret), at most 1."""
    return min(1.0, sum(SENSITIVE.get(x.lower(), 0.0) for x in _CAMEL.findall(name)))


def randomness(value: str) -> float:
    """0 for a plain word, towards 1 for long mixed values."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, max(0.0, (bits - 2.0) / 2.5)) * (0.4 + 0.2 * min(3, kinds))


def read_value(text: str, at: int) -> tuple[list[tuple[str, int, int]], int]:
    """The parts of a value on one line, ``(kind, start, end)`` (strings without their quotes, names, bare words), and
    where reading goes on: behind the value, but inside a single string, which may hold pairs itself."""
    out, begin, end = [], at, at
    while m := _PART.match(text, at):
        kind = m.lastgroup
        a, b = m.span(kind)
        out.append((kind, a + 1, b - 1) if kind == "string" else (kind, a, b))
        end = m.end()
        gap = _JOIN.match(text, end)
        nxt = text[gap.end():gap.end() + 1]
        # parts go on after a plus sign, or when strings stand side by side
        if "+" in gap[0] or (kind == "string" and nxt in ('"', "'") and nxt):
            at = gap.end()
        else:
            break
    return out, begin if len(out) == 1 and out[0][0] == "string" else end


def read_pairs(text: str) -> list[tuple[int, str, list[tuple[str, int, int]]]]:
    """``(start, name, parts of the value)`` in order.  No part of a text is read twice as a value, so this is linear."""
    out = []
    for pattern in (_PAIR, _FLAG):
        at = 0
        while m := pattern.search(text, at):
            parts, at = read_value(text, m.end())
            out.append((m.start(1), m[1], parts))
    out += [(m.start(1), m[1], [("string", *m.span(2))]) for m in _TAG.finditer(text)]
    return sorted(out, key=lambda x: x[0])


def aims(text: str, low: str) -> bool:
    """Whether a name with any weight may have a value in the text; if not, no literal can reach one."""
    hints = lambda x: any(root in x for root in _ROOTS)
    return hints(low) and any(hints(m[m.lastindex].lower()) for m in _AIMED.finditer(text))


def literal_spans(text: str, low: str, rules: SecretRules) -> list[tuple[int, int, int]]:
    """Literals that reach a sensitive name with enough score."""
    if not aims(text, low):
        return []
    pairs = read_pairs(text)
    places: dict[str, tuple[list[int], list[list]]] = {}
    for at, name, parts in pairs:
        ats, values = places.setdefault(name, ([], []))
        ats.append(at)
        values.append(parts)

    def follow(part, at: int) -> tuple[str, int] | None:
        """The earlier assignment that a name stands for; None for a literal."""
        kind, a, b = part
        name = text[a:b].lstrip("$")
        if kind == "string" or name not in places:
            return None
        return name, max(0, bisect_left(places[name][0], at) - 1)  # the latest earlier one, else the first

    remembered: dict[tuple[str, int], list[tuple[int, int]]] = {}  # of values that are one name

    def resolve(parts, at: int) -> list[tuple[int, int]]:
        """The literals that a value is made of, each once.  A name is followed until it repeats on its way, and stands
        for itself there."""
        out: dict[tuple[int, int], None] = {}
        way, seen = set(), set()
        stack = [(None, at, iter(parts))]
        while stack:
            node, at, rest = stack[-1]
            for part in rest:
                to = follow(part, at)
                if to is None or to in way:
                    out[part[1:]] = None
                elif to in remembered:
                    out.update(dict.fromkeys(remembered[to]))
                elif to not in seen and places[to[0]][0][to[1]] != at:
                    way.add(to)
                    seen.add(to)
                    ats, values = places[to[0]]
                    stack.append((to, ats[to[1]], iter(values[to[1]])))
                    break
            else:
                way.discard(node)
                stack.pop()
        return list(out)

    found = set()
    for at, name, parts in pairs:
        weight = name_weight(name)
        if weight < 0.5:
            continue
        one = follow(parts[0], at) if len(parts) == 1 else None
        if one is None:
            spans = resolve(parts, at)
        elif one in remembered:
            spans = remembered[one]
        else:
            spans = remembered[one] = resolve(parts, at)
        value = "".join(text[a:b] for a, b in spans)
        if len(value) >= rules.min_length and not PLACEHOLDER.match(value) and weight + randomness(value) >= rules.min_score:
            found |= {(a, 3, b) for a, b in spans if b > a}
    return list(found)


def scan(text: str, rules: SecretRules) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each by start, then kind."""
    low = text.lower()
    base = base_spans(text, low)
    return sorted(base), sorted(base + literal_spans(text, low, rules))


def _write(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


OUT = [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("n_literal", "long"), ("spans", "string")]


def scan_secrets(docs: DataFrame, rules: SecretRules = SecretRules(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans of each row."""

    def make(batches):
        for (column,) in batches:
            rows = [scan(x, rules) for x in texts(column)]
            count = lambda k: pa.array([sum(s[1] == k for s in a) for _, a in rows], pa.int64())
            yield [count(0), count(1), count(2), pa.array([hashlib.sha256(_write(b).encode()).hexdigest() for b, _ in rows], pa.string()),
                   count(3), pa.array([_write(a) for _, a in rows], pa.string())]

    named = list(zip(fresh(docs.columns if keep is None else keep, *(n for n, _ in OUT)), (t for _, t in OUT)))
    return add_columns(docs, [text], named, make, keep)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, done = [], 0
    for a, _, b in spans:
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], mark]
        done = b
    return "".join([*out, text[done:]])


def redact_secrets(docs: DataFrame, rules: SecretRules = SecretRules(), text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span of ``text`` replaced; a null text stays null."""
    new, = fresh(docs.columns, "redacted")

    def make(batches):
        for (column,) in batches:
            yield [pa.array([x if not x else redact(x, scan(x, rules)[1], mark) for x in column.to_pylist()], pa.string())]

    out = add_columns(docs, [text], [(new, "string")], make)
    return out.select(*(F.col(f"`{new}`" if c == text else f"`{c}`").alias(c) for c in docs.columns))
