"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn and then user and assistant turns in
alternation, beginning with the user.  Every turn takes the automaton from state to state:
kept, relabelled, merged into the turn before, or after an empty turn put in.  Dynamic
programming finds the cheapest way, and the repaired sequence is rendered.

A step is a matrix of costs, and steps compose by the (min, +) product, so a conversation may
be cut anywhere.  Turns are dealt by range of (conv_id, turn): a conversation of any length is
spread over tasks.  Each run (a conversation's turns in one range) is reduced to its matrix,
the few conversations of several runs are scanned over these matrices, and then every run is
solved with its ends known.  The result is one row for each turn and each inserted turn, never
a conversation's whole text in one place; a conversation's rendering is its rows' in order.

Defined results: roles are trimmed and lower-cased, ``human`` and ``bot`` and the like are
synonyms, others and null are unknown and cheap to relabel; a null text is empty; null turns
come first, equal turns are ordered by role and text; rows without conv_id are dropped from no
conversation: they form one of their own (null); repeated rows are turns like others; ties
between repairs go to the state that comes first (system, user, assistant); other columns are
never read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
#: Names that stand for a role.
SYNONYMS = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "ai": "assistant", "model": "assistant", "gpt": "assistant", "developer": "system"}
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40
KEEP, MERGE, INSERT = "keep", "merge", "insert"


@dataclass(frozen=True)
class Costs:
    merge: int = 2
    relabel: int = 3
    relabel_unknown: int = 1
    insert: int = 4

    def between(self, a: int, b: int) -> tuple[int, str, int]:
        """The cheapest way from state a to a turn of role b: cost, how, the role put in before."""
        ways = [(0, KEEP, 0)] if b in NEXT[a] else []
        ways += [(self.merge, MERGE, 0)] if a == b else []
        ways += [(self.insert, INSERT, x) for x in NEXT[a] if b in NEXT[x]]
        return min(ways, default=(FAR, KEEP, 0))

    def steps(self) -> np.ndarray:
        """[role of the turn (0 unknown), from, to]: cost."""
        out = np.full((4, 4, 4), FAR, np.int64)
        for role in range(4):
            for a in range(4):
                for b in (SYSTEM, USER, ASSISTANT):
                    label = 0 if role == b else self.relabel if role else self.relabel_unknown
                    out[role, a, b] = min(FAR, self.between(a, b)[0] + label)
        return out


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = SYNONYMS.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def solve(roles: list[int], costs: Costs, enter: int = START, leave: int | None = None) -> tuple[int, list[int]]:
    """The cost and the states after each turn; leave: the last state, else any that may end."""
    steps = costs.steps()
    best = np.full(4, FAR, np.int64)
    best[enter] = 0
    back = np.zeros((len(roles), 4), np.int8)
    for i, role in enumerate(roles):
        ways = best[:, None] + steps[role]
        back[i] = ways.argmin(0)
        best = np.minimum(ways.min(0), FAR)
    ends = best + np.array([0, costs.insert, 0, 0]) if leave is None else np.where(np.arange(4) == leave, best, FAR)
    state = int(ends.argmin())
    cost, path = int(ends[state]), []
    for i in range(len(roles) - 1, -1, -1):
        path.append(state)
        state = int(back[i, state])
    return cost, path[::-1]


def matrix(roles: list[int], costs: Costs) -> np.ndarray:
    """The costs of a run from each state to each."""
    steps, out = costs.steps(), np.where(np.eye(4, dtype=bool), 0, FAR)
    for role in roles:
        out = np.minimum((out[:, :, None] + steps[role][None, :, :]).min(1), FAR)
    return out


def repaired(conv: int | None, turns: list, roles: list[int], texts: list[str], costs: Costs, enter: int, leave: int | None, last: bool) -> list[tuple]:
    """Rows (conv_id, turn, role, action, starts, rendered) of one run."""
    _, path = solve(roles, costs, enter, leave)
    out, state = [], enter
    for turn, role, text, to in zip(turns, roles, texts, path, strict=True):
        _, how, put_in = costs.between(state, to)
        line = "" if state == START else "\n"
        if how == INSERT:
            out.append((conv, turn, ROLES[put_in - 1], INSERT, True, f"{line}<|{ROLES[put_in - 1]}|>\n"))
            line = "\n"
        action = how if how == MERGE else KEEP if role == to else "relabel"
        if how == MERGE and role != to:
            action = "relabel+merge"
        out.append((conv, turn, ROLES[to - 1], action, how != MERGE, "\n\n" + text if how == MERGE else f"{line}<|{ROLES[to - 1]}|>\n{text}"))
        state = to
    if last and state == SYSTEM:
        out.append((conv, turns[-1], "user", INSERT, True, "\n<|user|>\n"))
    return out


SCHEMA = "conv_id long, turn long, role string, action string, starts boolean, rendered string"


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Stretches of rows that are equal in their first ``width`` columns, in a sorted stream."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != key:
                if held:
                    yield key, held
                key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield key, held


def apply(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """conv_id, turn, role, action, starts, rendered of ``conversations(conv_id, turn, role, text)``."""
    spark = conversations.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = common.materialize(rows.repartitionByRange(n, "conv_id", "turn").withColumn("run", F.spark_partition_id()), "turns")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [(conv, run, matrix([role_number(r[1]) for r in held], costs).ravel().tolist()) for (conv, run), held in _runs(batches, 2)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int64()))], names=["conv_id", "run", "matrix"])

    ends = rows.groupBy("conv_id").agg(F.min("run").alias("first_run"), F.max("run").alias("last_run")).where(F.col("first_run") < F.col("last_run"))
    ends = common.materialize(ends.select(F.col("conv_id").alias("cut_id"), "first_run", "last_run"), "cut")  # at most one for each border of ranges
    cut = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("cut_id"))).select("conv_id", "run", *order[1:])
    products = common.map_batches(cut.repartition(n, "conv_id", "run").sortWithinPartitions("conv_id", "run", *order[1:]), matrices, "conv_id long, run int, matrix array<long>")

    def scan(runs: pd.DataFrame) -> pd.DataFrame:
        runs = runs.sort_values("run")
        steps = [np.array(m, np.int64).reshape(4, 4) for m in runs["matrix"]]
        best, back = np.array([0, FAR, FAR, FAR]), []
        for m in steps:
            ways = best[:, None] + m
            back.append(ways.argmin(0))
            best = np.minimum(ways.min(0), FAR)
        state, path = int((best + np.array([0, costs.insert, 0, 0])).argmin()), []
        for b in reversed(back):
            path.append((int(b[state]), state))
            state = int(b[state])
        path.reverse()
        return pd.DataFrame({"cut_id": runs["conv_id"].to_numpy(), "cut_run": runs["run"].to_numpy(), "enter": [a for a, _ in path], "leave": [b for _, b in path], "last": [False] * (len(path) - 1) + [True]})

    known = products.groupBy("conv_id").applyInPandas(scan, "cut_id long, cut_run int, enter int, leave int, last boolean")
    known = common.materialize(known, "ends")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("starts", pa.bool_()), ("rendered", pa.string())])

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        out: list[tuple] = []
        for (conv, _, enter, leave, last), held in _runs(batches, 5):
            turns, roles, texts = zip(*held, strict=True)
            out += repaired(conv, list(turns), [role_number(r) for r in roles], [t or "" for t in texts], costs, enter or START, leave, last is not False)
            if len(out) > 2000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    solved = rows.join(known, F.col("conv_id").eqNullSafe(F.col("cut_id")) & (F.col("run") == F.col("cut_run")), "left")
    solved = solved.select("conv_id", "run", "enter", "leave", "last", *order[1:]).repartition(n, "conv_id", "run").sortWithinPartitions("conv_id", "run", *order[1:])
    return common.map_batches(solved, render, SCHEMA)
