"""Chat formatting by minimum-cost role repair: dynamic programming over an automaton of legal turns.

Legal conversations: an optional system turn, then user and assistant turns by turns, ending with the assistant.
Each turn may be kept, merged into the one before it, relabelled, or have an empty turn put before it; the
cheapest series of such repairs is chosen and the repaired sequence rendered as ChatML.

A conversation can be of any length. Rows are sorted over all partitions by conversation and turn; what a partition
holds of a conversation is summed up by a (min, +) matrix of the least cost from each state to each state. The
few matrices of a conversation that spans partitions are chained to give the states at its seams, and each
part is then repaired by itself. So no task gathers a conversation, and the result is that of one long pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.shared import materialize, table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: States that may follow a state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = ASSISTANT
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
INF = float("inf")
STATE_OF = {r: i + 1 for i, r in enumerate(ROLES)}


def _steps(role: str | None) -> list[tuple[float, str, int, int, tuple[int, ...]]]:
    """(cost, action, state before, state after, inserted states) of all repairs of one turn, in order of preference."""
    own, out = STATE_OF.get(role, 0), []
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            extra = 0.0 if after == own else RELABEL
            name = "" if after == own else "relabel"
            if after in LEGAL[before]:
                out.append((extra, name or "keep", before, after, ()))
            if after == before:
                out.append((extra + MERGE, f"{name}_merge" if name else "merge", before, after, ()))
            for mid in LEGAL[before]:
                if after in LEGAL[mid]:
                    out.append((extra + INSERT, f"{name}_insert" if name else "insert", before, after, (mid,)))
                for mid2 in LEGAL[mid]:
                    if after in LEGAL[mid2]:
                        out.append((extra + 2 * INSERT, f"{name}_insert" if name else "insert", before, after, (mid, mid2)))
    return sorted(out, key=lambda s: (s[0], len(s[4]), s[1], s[2], s[3], s[4]))


STEPS = {r: _steps(r) for r in (*ROLES, None)}
#: Least cost and inserted turns to end from a state.
ENDING = {START: (0.0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0.0, ())}


def _best(role: str | None) -> np.ndarray:
    m = np.full((4, 4), INF)
    for cost, _, a, b, _ in STEPS[role]:
        m[a, b] = min(m[a, b], cost)
    return m


MATRIX = {r: _best(r) for r in STEPS}


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def summarise(roles: list[str | None]) -> np.ndarray:
    m = np.where(np.eye(4, dtype=bool), 0.0, INF)
    for r in roles:
        m = chain(m, MATRIX[r if r in STATE_OF else None])
    return m


def repair(roles: list[str | None], first: int, last: int) -> list[tuple]:
    """The cheapest steps (cost, action, before, after, inserted) from state `first` to state `last`."""
    best = [np.where(np.arange(4) == first, 0.0, INF)]
    for r in roles:
        best.append((best[-1][:, None] + MATRIX[r if r in STATE_OF else None]).min(axis=0))
    out, state = [], last
    for i in range(len(roles) - 1, -1, -1):
        steps = STEPS[roles[i] if roles[i] in STATE_OF else None]
        step = next(s for s in steps if s[3] == state and best[i][s[2]] + s[0] == best[i + 1][state])
        out.append(step)
        state = step[2]
    return out[::-1]


def seams(parts: list[np.ndarray]) -> list[tuple[int, int]]:
    """The state before and after each part on a cheapest way through all of them."""
    best = [np.where(np.arange(4) == START, 0.0, INF)]
    for m in parts:
        best.append((best[-1][:, None] + m).min(axis=0))
    ends = np.array([ENDING[s][0] for s in range(4)])
    state = int((best[-1] + ends).argmin())
    out = []
    for i in range(len(parts) - 1, -1, -1):
        before = int((best[i] + parts[i][:, state]).argmin())
        out.append((before, state))
        state = before
    return out[::-1]


def _open(state: int) -> str:
    return f"<|im_start|>{ROLES[state - 1]}\n"


CLOSE = "<|im_end|>\n"


def _fragment(step: tuple, text: str) -> str:
    """What a turn adds to the rendered conversation: a turn is closed by what follows it."""
    _, action, before, after, inserted = step
    text = text.replace("<|", "< |")  # a text can't open or close a turn
    if action.endswith("merge"):
        return "\n\n" + text
    return "".join(("" if s == START else CLOSE) + _open(n) for s, n in zip((before, *inserted), (*inserted, after), strict=True)) + text


def _groups(batches, keys: tuple[str, ...]):
    """Runs of rows with equal keys in sorted batches, as lists of dicts."""
    held, at = [], None
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[x] for x in keys)
            if held and k != at:
                yield held
                held = []
            at = k
            held.append(row)
    if held:
        yield held


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Repairs and renders `turns` (conv_id, turn, role, text): one row per input turn, plus one for turns put at
    the end: conv_id, pos (place in the input from 1; that of an ending follows the last), turn, role (as
    repaired), action (keep, merge, relabel, insert, relabel_merge, relabel_insert, end), cost, rendered. Joined by
    pos, a conversation's `rendered` is its ChatML text.

    Turns are ordered by turn, then role and text; nulls first. Roles are trimmed and lower-cased; null and unknown
    ones must be relabelled. A null text is empty. `<|` in a text becomes `< |`, so that no text opens or closes a turn. Rows without a conv_id are one conversation. Repeated rows
    are turns of their own. Every conversation gets exactly one `end` row, whose `rendered` closes it. Other columns
    are ignored.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.lower(F.trim("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    tied = plain.withColumn("tie", F.xxhash64("role", "text"))
    dealt = tied.repartitionByRange(*order[:2], F.col("role").asc_nulls_first(), "tie").withColumn("part", F.spark_partition_id())
    # ties on role are ordered by the text's hash, then the text, so that equal turns can be dealt apart
    dealt = materialize(dealt, "chat-parts")
    sort = ["conv_id", "part", "turn", "role", "tie", "text"]
    sorted_ = dealt.repartition("conv_id", "part").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in sort))
    kind = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("m", pa.list_(pa.float64()))])

    def sum_up(batches):
        rows: list = []
        for g in _groups(batches, ("conv_id", "part")):
            rows.append((g[0]["conv_id"], g[0]["part"], len(g), summarise([x["role"] for x in g]).ravel().tolist()))
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    def states(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parts = sorted(r["parts"], key=lambda p: p["part"])
                at = 0
                for i, (p, (a, b)) in enumerate(zip(parts, seams([np.array(p["m"]).reshape(4, 4) for p in parts]), strict=True)):
                    rows.append((r["conv_id"], p["part"], at, a, b, i == len(parts) - 1))
                    at += p["n"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["c", "p", "at", "first", "last", "ends"])

    sums = sorted_.select("conv_id", "part", "turn", "role").mapInArrow(sum_up, "conv_id long, part int, n long, m array<double>")
    # a conversation has at most as many parts as there are partitions
    by_conv = sums.groupBy("conv_id").agg(F.collect_list(F.struct("part", "n", "m")).alias("parts"))
    known = by_conv.mapInArrow(states, "c long, p int, at long, first int, last int, ends boolean")
    ready = dealt.join(known, dealt["conv_id"].eqNullSafe(known["c"]) & (dealt["part"] == known["p"]))
    ready = ready.repartition("conv_id", "part").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in sort))
    out = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("cost", pa.float64()), ("rendered", pa.string())])

    def render(batches):
        rows: list = []
        for g in _groups(batches, ("conv_id", "part")):
            steps = repair([x["role"] for x in g], g[0]["first"], g[0]["last"])
            for i, (x, s) in enumerate(zip(g, steps, strict=True)):
                rows.append((x["conv_id"], x["at"] + i + 1, x["turn"], ROLES[s[3] - 1], s[1], s[0], _fragment(s, x["text"])))
            if g[0]["ends"]:
                cost, more = ENDING[g[0]["last"]]
                rows.append((g[0]["conv_id"], g[0]["at"] + len(g) + 1, None, ROLES[FINAL - 1], "end", cost, "".join(CLOSE + _open(s) for s in more) + CLOSE))
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return ready.mapInArrow(render, "conv_id long, pos long, turn long, role string, action string, cost double, rendered string")


def op9_chat(spark, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))
