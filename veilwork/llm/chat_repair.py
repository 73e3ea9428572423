"""Chat formatting: minimum-cost repair of roles, then rendering.

A legal conversation is an optional system turn followed by user and assistant in turn, ending with the assistant.  Each
given turn keeps or changes its role, and either joins the turn before it (same role) or opens a new one, if need be after
empty turns; every deviation has a cost.  The cheapest way is found by dynamic programming over the automaton of the last
role.  Conversations of any length are cut into pieces: each piece gives a small matrix (entry state to exit state, and the
turns it opens), the matrices of a conversation are combined, and every piece is traced back on its own.

The result has one row per given turn with its rendered fragment; the fragments in order are the conversation, so no
conversation is gathered in one row.

Defined results: an unknown or null role may become any role at a lower cost; a null text is empty and still a turn; equal
turn numbers are ordered by text, repeated rows stay repeated turns; a null turn comes first; rows with a null conversation
form one conversation; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs_of, stored

ROLES = ("system", "user", "assistant")
START = 3  # state before the first turn; other states are the last turn's role
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}  # roles that may follow
NEVER = 1 << 50


@dataclass(frozen=True)
class RepairRules:
    merge: int = 1
    relabel: int = 2
    name: int = 1  # give a role to an unknown one
    insert: int = 3
    piece: int = 4096

    def between(self, state: int, role: int) -> tuple[int, tuple[int, ...]] | None:
        """Cost and roles of the empty turns needed before a new turn of ``role``."""
        for empties in ((), *((r,) for r in NEXT[state]), *((a, b) for a in NEXT[state] for b in NEXT[a])):
            if role in NEXT[empties[-1] if empties else state]:
                return self.insert * len(empties), empties
        return None

    def moves(self) -> dict[int, list[tuple[int, int, int, bool, tuple[int, ...]]]]:
        """By given role (3: unknown): ``(from, to, cost, joins, empties)``."""
        out = {}
        for given in range(4):
            out[given] = rows = []
            for state in range(4):
                for role in range(3):
                    cost = 0 if role == given else self.name if given == 3 else self.relabel
                    if state == role:
                        rows.append((state, role, cost + self.merge, True, ()))
                    if gap := self.between(state, role):
                        rows.append((state, role, cost + gap[0], False, gap[1]))
            rows.sort(key=lambda m: (m[2], not m[3], m[1]))
        return out

    def ending(self, state: int) -> tuple[int, tuple[int, ...]]:
        """Cost and roles of the empty turns after the last one."""
        return {2: (0, ()), 1: (self.insert, (2,)), 0: (2 * self.insert, (1, 2)), START: (2 * self.insert, (1, 2))}[state]


def role_number(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else 3


def forward(roles: list[int], entry: int, moves) -> tuple[list, list[list]]:
    """``(cost, turns opened)`` of each state after the piece, and the best move into each state at each step."""
    best = [None] * 4
    best[entry] = (0, 0)
    backs = []
    for given in roles:
        new, back = [None] * 4, [None] * 4
        for move in moves[given]:
            a, b, cost, joins, empties = move
            if best[a] is None:
                continue
            total = (best[a][0] + cost, best[a][1] + len(empties) + (not joins))
            if new[b] is None or total < new[b]:
                new[b], back[b] = total, move
        best = new
        backs.append(back)
    return best, backs


def trace(backs: list[list], exit_: int) -> list[tuple]:
    out = []
    for back in reversed(backs):
        out.append(back[exit_])
        exit_ = out[-1][0]
    return out[::-1]


def combine(pieces: list[list], rules: RepairRules) -> list[tuple[int, int, int, bool]]:
    """Of each piece of a conversation: entry and exit state, turns opened before it, whether it is the last.

    A piece is a 4 x 4 table of ``[cost, opened]`` (null where there is no way).
    """
    best, backs = [None, None, None, (0, 0)], []
    for table in pieces:
        new, back = [None] * 4, [None] * 4
        for a in range(4):
            for b in range(4):
                if best[a] is not None and table[a][b] is not None:
                    total = (best[a][0] + table[a][b][0], best[a][1] + table[a][b][1])
                    if new[b] is None or total < new[b]:
                        new[b], back[b] = total, a
        best = new
        backs.append(back)
    state = min((s for s in range(4) if best[s] is not None), key=lambda s: (best[s][0] + rules.ending(s)[0], s))
    path = [state]
    for back in reversed(backs):
        path.append(back[path[-1]])
    path.reverse()
    out, opened = [], 0
    for k, table in enumerate(pieces):
        out.append((path[k], path[k + 1], opened, k == len(pieces) - 1))
        opened += table[path[k]][path[k + 1]][1]
    return out


def opening(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSING = "<|end|>\n"


def escaped(text: str) -> str:
    """Text in which no mark of the format can stand."""
    return text.replace("<|", "<\\|")


def render(moves: list[tuple], texts: list[str], opened: int, exit_: int, last: bool, rules: RepairRules) -> list[tuple]:
    """Of each turn: number of its turn in the repaired conversation, role, action, empty turns before, fragment."""
    out = []
    for (state, role, _, joins, empties), text in zip(moves, texts):
        if joins:
            fragment = "\n\n" + escaped(text)
        else:
            fragment = CLOSING if state != START else ""
            fragment += "".join(opening(e) + CLOSING for e in empties) + opening(role) + escaped(text)
            opened += len(empties) + 1
        out.append([opened - 1, role, joins, empties, fragment])
    if last and out:
        end = rules.ending(exit_)[1]
        out[-1][4] += CLOSING + "".join(opening(e) + CLOSING for e in end)
    return out


def repair(turns: DataFrame, rules: RepairRules = RepairRules(), conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """``(conv, turn, out_turn, role, action, inserted, fragment)`` of each given turn."""
    moves = rules.moves()
    named = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"),
                         F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn")]

    def number(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            at = range(seq, seq + n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int64()), pa.array([i // rules.piece for i in at], pa.int64()),
                                              pa.array(at, pa.int64())], names=[*b.schema.names, "part", "piece", "seq"])
            seq += n

    # a total order over all turns: a conversation of any length is spread over as many tasks as it needs
    ordered = named.repartitionByRange(*order, F.xxhash64("text", "role")).sortWithinPartitions(*order, "text", "role")
    rows = stored(ordered.mapInArrow(number, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", part long, piece long, seq long"), "turns")
    def tables(conv, part, piece, seq, role):
        roles = [role_number(r) for r in role]
        table = [[None if x is None else list(x) for x in forward(roles, a, moves)[0]] for a in range(4)]
        return [(conv[0], part[0], piece[0], table)]

    def borders(conv, part, piece, table):
        # one small matrix for each piece of 4096 turns
        return [(*key, *found) for key, found in zip(zip(conv, part, piece), combine(list(table), rules))]

    def paths(conv, part, piece, seq, turn, given, text, entry, exit_, opened, last):
        roles = [role_number(r) for r in given]
        steps = trace(forward(roles, entry[0], moves)[1], exit_[0])
        out = render(steps, list(text), opened[0], exit_[0], last[0], rules)
        action = [("relabel" if x[1] != r else "") + ("+" if x[1] != r and x[2] else "") + ("merge" if x[2] else "") or "keep" for r, x in zip(roles, out)]
        return [(c, t, x[0], ROLES[x[1]], a, ",".join(ROLES[e] for e in x[3]), x[4]) for c, t, x, a in zip(conv, turn, out, action)]

    where = f"conv {kinds['conv']}, part long, piece long"
    pieces = runs_of(rows.select("conv", "part", "piece", "seq", "role"), ["conv", "part", "piece"], ["seq"], f"{where}, t array<array<array<long>>>", tables)
    known = stored(runs_of(pieces, ["conv"], ["part", "piece"], f"{where}, entry long, exit long, opened long, last boolean", borders), "borders")
    there = known.withColumnsRenamed({"conv": "conv_", "part": "part_", "piece": "piece_"})
    both = rows.join(there, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_")) & (F.col("piece") == F.col("piece_")))
    return runs_of(both.select("conv", "part", "piece", "seq", "turn", "role", "text", "entry", "exit", "opened", "last"), ["conv", "part", "piece"], ["seq"],
                   f"conv {kinds['conv']}, turn {kinds['turn']}, out_turn long, role string, action string, inserted string, fragment string", paths)
