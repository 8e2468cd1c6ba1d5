"""Chat formatting by minimum-cost role repair over a legal-turn automaton.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the assistant. Dynamic
programming over the automaton's states chooses for every turn to keep it, relabel it, merge it into the turn before or put an empty turn before
it, at the least total cost; the repaired sequence is then rendered, a piece for each input turn.

Turns are range-partitioned in conversation order, so a very long conversation spans partitions: the cost of passing through a
segment is a small matrix, the driver chains the matrices of the segments at partition borders (two per partition at most), and each segment
is then solved between its fixed entry and exit states.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import query, shared_folder, table

ROLES = ("system", "user", "assistant")
#: States: 0 before the first turn, i + 1 after a turn of ROLES[i]. The roles that may follow each state:
FOLLOW = ((0, 1), (1,), (2,), (1,))
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 3, 1, 2
#: Cost of ending in a state, and the empty turns that the end needs.
END = ((None, ()), (2 * INSERT, (1, 2)), (INSERT, (2,)), (0, ()))
BIG = 1 << 40


def moves(role: str | None) -> list[list[tuple]]:
    """For each state: (cost, next state, action, new role, inserted role), cheapest first and in this order of actions on ties."""
    known = ROLES.index(role) if role in ROLES else None
    label = lambda r: 0 if r == known else RELABEL if known is not None else RELABEL_UNKNOWN
    out = []
    for q in range(4):
        here = [(label(r), r + 1, "keep" if r == known else "relabel", r, None) for r in FOLLOW[q]]
        if q:
            here.append((MERGE + label(q - 1), q, "merge", q - 1, None))
        here += [(INSERT + label(r), r + 1, "insert", r, m) for m in FOLLOW[q] for r in FOLLOW[m + 1]]
        best: dict[int, tuple] = {}
        for m in here:
            if m[1] not in best or m[0] < best[m[1]][0]:
                best[m[1]] = m
        out.append(sorted(best.values(), key=lambda m: (m[0], m[1])))
    return out


_MOVES = {r: moves(r) for r in (*ROLES, None)}


def _moves(role):
    return _MOVES[role if role in ROLES else None]


def passing(roles: list) -> list[list[int]]:
    """Least cost from each entry state to each exit state of a segment."""
    cost = [[0 if i == j else BIG for j in range(4)] for i in range(4)]
    for role in roles:
        step = _moves(role)
        cost = [_advance(row, step) for row in cost]
    return cost


def _advance(row: list[int], step) -> list[int]:
    new = [BIG] * 4
    for q in range(4):
        if row[q] < BIG:
            for m in step[q]:
                if row[q] + m[0] < new[m[1]]:
                    new[m[1]] = row[q] + m[0]
    return new


def solve(roles: list, entry: int = 0, leave: int | None = None) -> list[tuple]:
    """The moves of a least-cost way from ``entry`` to ``leave`` (None: any legal end, its cost included)."""
    row, back = [BIG] * 4, []
    row[entry] = 0
    for role in roles:
        new, via = [BIG] * 4, [None] * 4
        for q, ways in enumerate(_moves(role)):
            if row[q] < BIG:
                for m in ways:
                    if row[q] + m[0] < new[m[1]]:
                        new[m[1]], via[m[1]] = row[q] + m[0], (q, m)
        row = new
        back.append(via)
    q = leave if leave is not None else min((i for i in range(1, 4) if row[i] < BIG), key=lambda i: row[i] + END[i][0])
    out = []
    for via in reversed(back):
        q, m = via[q]
        out.append(m)
    return out[::-1]


def _runs(conv: list) -> list[tuple[int, int]]:
    """Consecutive rows of one conversation; rows without conv_id stand alone."""
    cut = [i for i in range(len(conv)) if i == 0 or conv[i] is None or conv[i] != conv[i - 1]]
    return list(zip(cut, [*cut[1:], len(conv)]))


def _chain(rows: list) -> dict:
    """Entry and exit states and offsets of the segments of conversations that span partitions."""
    plan: dict = {}
    rows = sorted(rows, key=lambda r: (r["pid"], r["place"]))
    i = 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and rows[j]["conv_id"] == rows[i]["conv_id"] and rows[i]["conv_id"] is not None and rows[j]["pid"] > rows[j - 1]["pid"]:
            j += 1
        if j - i > 1:
            row, back = [0, BIG, BIG, BIG], []
            for r in rows[i:j]:
                m = np.asarray(r["cost"], np.int64).reshape(4, 4)
                total = np.asarray(row)[:, None] + m
                back.append(total.argmin(axis=0))
                row = np.minimum(total.min(axis=0), BIG).tolist()
            q = min((k for k in range(1, 4) if row[k] < BIG), key=lambda k: row[k] + END[k][0])
            at = sum(r["n"] for r in rows[i:j])
            for k in range(j - 1, i - 1, -1):
                entry, at = int(back[k - i][q]), at - rows[k]["n"]
                plan[(rows[k]["pid"], rows[k]["place"])] = (entry, q, at, k == j - 1)
                q = entry
        i = j
    return plan


def _piece(move: tuple, text: str, first: bool, last: bool) -> str:
    _, state, action, role, inserted = move
    text = text.replace("<|", "< |")
    if action == "merge":
        out = "\n" + text
    else:
        out = ("" if first else "<|end|>\n") + (f"<|{ROLES[inserted]}|>\n<|end|>\n" if inserted is not None else "") + f"<|{ROLES[role]}|>\n{text}"
    if last:
        out += "<|end|>\n" + "".join(f"<|{ROLES[r]}|>\n<|end|>\n" for r in END[state][1])
    return out


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id, position, turn, role, action, new_role, inserted, cost, rendered``: a row for each row of ``turns(conv_id, turn, role, text)``.

    The pieces of a conversation in order of position are its rendered text; the costs add up to the least cost. Order: turn, then role
    and text (nulls first); repeated turns are turns of their own. Roles are compared in lower case without blanks around; null and other roles are
    unknown and cheaper to label. A null text is empty; "<|" in a text is written "< |". A row without conv_id is a conversation of its
    own. Other columns are ignored; an empty table gives an empty result.
    """
    spark = turns.sparkSession
    shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    order = ["conv_id", "turn", "role", "text", "tie"]
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    # checkpoint() keeps partitions and their order, which both passes below rely on
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").checkpoint()
    clean = lambda r: r.strip().lower() if r is not None else None

    def borders(batches):
        conv, role = [], []
        for b in batches:
            conv += b.column("conv_id").to_pylist()
            role += b.column("role").to_pylist()
        runs = _runs(conv)
        pick = [(0, runs[0])] + ([(1, runs[-1])] if len(runs) > 1 else []) if runs else []
        pid = TaskContext.get().partitionId()
        cost = [sum(passing([clean(r) for r in role[a:b]]), []) for _, (a, b) in pick]
        yield pa.RecordBatch.from_arrays([pa.array([pid] * len(pick), pa.int32()), pa.array([p for p, _ in pick], pa.int32()), pa.array([conv[a] for _, (a, _) in pick], pa.int64()),
                                          pa.array([b - a for _, (a, b) in pick], pa.int64()), pa.array(cost, pa.list_(pa.int64()))], names=["pid", "place", "conv_id", "n", "cost"])

    kind = "pid int, place int, conv_id long, n long, cost array<long>"
    plan = spark.sparkContext.broadcast(_chain([r.asDict() for r in rows.select("conv_id", "role").mapInArrow(borders, kind).collect()]))

    def render(batches):
        parts = list(batches)
        if not parts:
            return
        data = pa.Table.from_batches(parts)
        conv, role = data["conv_id"].to_pylist(), data["role"].to_pylist()
        runs, pid = _runs(conv), TaskContext.get().partitionId()
        moved, position, first, last = [], [], [], []
        for k, (a, b) in enumerate(runs):
            place = 0 if k == 0 else 1 if k == len(runs) - 1 else None
            entry, leave, offset, ends = plan.value.get((pid, place), (0, None, 0, True))
            moved += solve([clean(r) for r in role[a:b]], entry, leave)
            position += range(offset, offset + b - a)
            first += [offset == 0] + [False] * (b - a - 1)
            last += [False] * (b - a - 1) + [ends]
        for at in range(0, len(conv), 2000):
            part, m = data.slice(at, 2000), moved[at:at + 2000]
            pieces = [_piece(x, t or "", f, e) for x, t, f, e in zip(m, part["text"].to_pylist(), first[at:], last[at:])]
            cost = [x[0] + (END[x[1]][0] if e else 0) for x, e in zip(m, last[at:])]
            yield pa.RecordBatch.from_arrays(
                [part["conv_id"].combine_chunks(), pa.array(position[at:at + 2000], pa.int64()), part["turn"].combine_chunks(), part["role"].combine_chunks(), pa.array([x[2] for x in m], pa.string()),
                 pa.array([ROLES[x[3]] for x in m], pa.string()), pa.array([ROLES[x[4]] if x[4] is not None else None for x in m], pa.string()), pa.array(cost, pa.int64()), pa.array(pieces, pa.string())],
                names=["conv_id", "position", "turn", "role", "action", "new_role", "inserted", "cost", "rendered"])

    return rows.mapInArrow(render, "conv_id long, position long, turn long, role string, action string, new_role string, inserted string, cost long, rendered string")


@query("op5_chat_role_repair")
def op5(spark, sf_dir):
    return repair(table(spark, sf_dir, "conversations"))
