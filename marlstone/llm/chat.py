"""Chat formatting with minimum-cost role repair.

Legal is an optional system turn, then user and assistant in turn, an assistant last. Dynamic programming over that
automaton chooses for each turn whether it keeps its role, takes another, joins the turn before, or has an empty turn
put before it; a last empty turn may be added. Costs are exact. Ties go to fewer turns; of equal repairs, the roles read
from the last turn to the first decide, in the order system, user, assistant. So each conversation has one repair,
however its turns are dealt out.

A conversation of any length is repaired without meeting in one task: turns are range-sorted, a partition's run of a
conversation is a matrix of least costs from state to state, with the rank its path has among those of other first
states. The matrices of runs that cross partitions multiply (in the min-plus sense) on the driver, two small ones a
partition at most. That fixes each run's end states and its first turn's number; the runs are then solved by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import checkpointed

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Other names of roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "developer": "system"}
COSTS = {"merge": 2, "relabel": 3, "insert": 4}
#: A sum of costs and the number of turns in one whole number, compared in that order.
UNIT, NEVER = 1 << 40, 1 << 100
HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"


def normal_role(role: str | None) -> str:
    r = (role or "").strip().lower()
    return ALIASES.get(r, r)


def moves(role: str, costs: dict = COSTS) -> list[list[tuple[int, tuple]]]:
    """moves[from][to] = (cost, move) of a turn of that role; a move is (joins, relabelled, inserted roles)."""
    out = [[(NEVER, ())] * 4 for _ in range(4)]
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            relabel = ROLES[b - 1] != role
            base = costs["relabel"] * relabel
            options = []
            if a == b:
                options.append(((base + costs["merge"]) * UNIT, (True, relabel, ())))
            if b in NEXT[a]:
                options.append((base * UNIT + 1, (False, relabel, ())))
            for mid in NEXT[a]:
                if b in NEXT[mid]:
                    options.append(((base + costs["insert"]) * UNIT + 2, (False, relabel, (ROLES[mid - 1],))))
            out[a][b] = min(options, key=lambda x: x[0], default=(NEVER, ()))
    return out


def last(costs: dict = COSTS) -> list[int]:
    """Cost of ending in each state: in USER, and after SYSTEM alone, empty turns are added."""
    return [0, 2 * costs["insert"] * UNIT + 2, costs["insert"] * UNIT + 1, 0]


def _times(vector: list[int], step: list[list[tuple[int, tuple]]]) -> list[int]:
    return [min(min(vector[a] + step[a][b][0] for a in range(4)), NEVER) for b in range(4)]


def solve(steps: list, first: int = START, end: int | None = None, costs: dict = COSTS) -> list[int]:
    """States after each step of the cheapest path from ``first``, to ``end`` or to the cheapest ending."""
    here = [NEVER] * 4
    here[first] = 0
    back = []
    for step in steps:
        back.append([min(range(4), key=lambda a: here[a] + step[a][b][0]) for b in range(4)])
        here = _times(here, step)
    ending = last(costs)
    state = min(range(4), key=lambda s: here[s] + ending[s]) if end is None else end
    path = []
    for b in reversed(back):
        path.append(state)
        state = b[state]
    return path[::-1]


def _longer(m: list[list[int]], rank: list[list[int]], step: list) -> tuple[list[list[int]], list[list[int]]]:
    """The matrix of a run and its ranks, one turn longer. rank[a][b] orders the first states a by their best path to b,
    read backwards."""
    costs, keys = [], []
    for a in range(4):
        row = [min((m[a][c] + step[c][b][0], c) for c in range(4)) for b in range(4)]
        costs.append([min(x, NEVER) for x, _ in row])
        keys.append([(c, rank[a][c]) for _, c in row])
    order = [sorted({keys[a][b] for a in range(4)}) for b in range(4)]
    return costs, [[order[b].index(keys[a][b]) for b in range(4)] for a in range(4)]


def repair(conversations: DataFrame, costs: dict = COSTS, head: str = HEAD, tail: str = TAIL) -> DataFrame:
    """The repaired, rendered turns of ``conversations`` (conv_id, turn, role, text): a row for each turn given or put in.

    conv_id, row_no (of the given turn in its conversation, from 0; for turns put in, of the one they stand before),
    piece (order among rows of one row_no), turn (null where put in), role (as repaired), action (keep, relabel, merge,
    merge+relabel or insert), out_turn (number of the repaired turn, from 0), n_rows, rendered. A conversation's text is
    its rendered pieces in order of row_no and piece.

    Turns stand by turn, role and text, nulls first; rows equal in all four columns count as one turn, n_rows of them
    (0 where put in). Null texts are empty; unknown and null roles have to be relabelled. Rows of null conv_id are one
    conversation. Other columns are not used. An empty table gives an empty result.
    """
    by = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").groupBy(*by).agg(F.count("*").alias("n_rows"))
    parts = checkpointed(rows.repartitionByRange(*by).sortWithinPartitions(*by)).withColumn("_part", F.spark_partition_id())

    def runs(batches: Iterator[pd.DataFrame]):
        """(conv_id, rows) of a partition, whose rows are sorted."""
        whole = lambda x: None if x is None else int(x)
        rows = (r for b in batches for r in zip(map(whole, b["conv_id"]), map(whole, b["turn"]), b["role"], b["text"], b["n_rows"], b["_part"], strict=True))
        return groupby(rows, key=lambda r: r[0])

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The least costs and the length of the first and of the last run of the partition."""
        known, kept = {}, []
        for k, group in runs(batches):
            m, n, part = [[0 if a == b else NEVER for b in range(4)] for a in range(4)], 0, 0
            rank = [[a] * 4 for a in range(4)]
            for r in group:
                role = normal_role(r[2])
                step = known[role] if role in known else known.setdefault(role, moves(role, costs))
                m, rank = _longer(m, rank, step)
                n, part = n + 1, r[5]
            kept = [*kept[:1], (part, str(k), n, ",".join(str(x) for v in m + rank for x in v))]
        yield pd.DataFrame(kept, columns=["part", "conv", "n", "costs"])

    # identifiers as text: pandas would turn integers beside nulls into floats
    parts = parts.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})
    found = parts.withColumn("text", F.lit("")).mapInPandas(edges, "part int, conv string, n long, costs string").collect()  # two rows a partition
    enter, leave, chain = {}, {}, []

    def close() -> None:
        """Fixes the states between the runs of a conversation that crosses partitions, and what stands before each."""
        if len(chain) > 1:
            before = [[0 if s == START else NEVER for s in range(4)]]  # least costs before each run, by state
            for *_, m in chain:
                before.append([min(min(before[-1][a] + m[4 * a + b] for a in range(4)), NEVER) for b in range(4)])
            ending = last(costs)
            after = min(range(4), key=lambda s: before[-1][s] + ending[s])
            path = []
            for (*_, m), costs_before in zip(reversed(chain), reversed(before[:-1]), strict=True):
                a = min(range(4), key=lambda a: (costs_before[a] + m[4 * a + after], m[16 + 4 * a + after]))  # noqa: B023
                path.append((a, after))
                after = a
            turns = gone = 0
            for (part, conv, n, m), (a, b) in zip(chain, reversed(path), strict=True):
                enter[part, conv], leave[part, conv] = (a, turns, gone), b
                turns, gone = turns + m[4 * a + b] % UNIT, gone + n
            del leave[chain[-1][:2]]

    for i, r in enumerate(found := sorted(found, key=lambda r: r["part"])):
        first_of_part = i == 0 or found[i - 1]["part"] != r["part"]
        if not (chain and first_of_part and chain[-1][1] == r["conv"]):
            close()
            chain = []
        chain.append((r["part"], r["conv"], r["n"], [int(x) for x in r["costs"].split(",")]))
    close()

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "row_no", "piece", "turn", "role", "action", "out_turn", "n_rows", "rendered"]
        frame = lambda: pd.DataFrame(out, columns=names, dtype=object).astype({"conv_id": "Int64", "turn": "Int64"})
        known, out = {}, []
        for k, group in runs(batches):
            rows = list(group)
            steps = [known[x] if (x := normal_role(r[2])) in known else known.setdefault(x, moves(x, costs)) for r in rows]
            own = rows[0][5], str(k)
            state, turn, row_no = enter.get(own, (START, 0, 0))
            end = leave.get(own)
            opening = lambda role, turn: (tail if turn else "") + head.format(role=role)
            for r, step, to in zip(rows, steps, solve(steps, state, end, costs), strict=True):
                joins, relabel, put = step[state][to][1]
                for i, role in enumerate(put):
                    out.append((k, row_no, i, None, role, "insert", turn, 0, opening(role, turn)))
                    turn += 1
                role = ROLES[to - 1]
                text = r[3] if isinstance(r[3], str) else ""
                action = "+".join(["merge"] * joins + ["relabel"] * relabel) or "keep"
                out.append((k, row_no, len(put), r[1], role, action, turn - joins, r[4], ("\n\n" if joins else opening(role, turn)) + text))
                turn, row_no, state = turn + (not joins), row_no + 1, to
            if end is None:
                for i, role in enumerate({USER: ("assistant",), SYSTEM: ("user", "assistant")}.get(state, ())):
                    out.append((k, row_no, i, None, role, "insert", turn, 0, opening(role, turn)))
                    turn += 1
                out[-1] = (*out[-1][:-1], out[-1][-1] + tail)
            if len(out) > 5000:
                yield frame()
                out.clear()
        yield frame()

    return parts.mapInPandas(
        render, "conv_id long, row_no long, piece int, turn long, role string, action string, out_turn long, n_rows long, rendered string"
    )


def op2_chat(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
