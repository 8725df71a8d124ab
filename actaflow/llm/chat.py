"""Chat formatting with minimum-cost role repair.

Legal conversations are the paths of an automaton: an optional system turn, then
user and assistant turns in alternation, ending with the assistant.  Dynamic
programming over its states chooses for every turn whether it stays as it is, is
relabelled, is merged into the turn before it, or needs empty turns before it;
the cheapest repair of the whole conversation is rendered turn by turn.

Conversations are dealt whole by conv_id.  One of more than ``part_rows`` turns is
cut into parts: the recurrence is a product of small min-plus matrices, so each part
is summed up as one, the parts' matrices give the costs at their entries, the costs
give back the states at their exits, and each part is rendered by itself.  A part is
20,000 rows, so even the parts' summaries of a conversation with a third of all turns
fit one task; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaflow.llm.store import checkpoint

ROLES = ("system", "user", "assistant")
#: Costs of merging a turn into the one before, of an empty turn, of another role.
MERGE, INSERT, RELABEL = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
INF = np.int64(1 << 60)
#: Turns of one conversation in one task; longer ones are cut.
PART_ROWS = 20_000
#: Long conversations that may be broadcast (about 20 bytes each); beyond, the join shuffles.
MAX_BROADCAST = 100_000


def _empties() -> dict[tuple[int, int], tuple[int, ...]]:
    """For a state and the state wanted next: the empty turns in between, the fewest."""
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for s in range(4):
        level = [(t, ()) for t in _NEXT[s]]
        while level:
            fresh = []
            for t, path in level:
                if (s, t) not in out:
                    out[s, t] = path
                    fresh += [(u, (*path, t)) for u in _NEXT[t]]
            level = fresh
    return out


EMPTIES = _empties()
#: Empty turns that take a state to the end of a conversation.
CLOSING = {s: () if s in (START, ASSISTANT) else (*EMPTIES[s, ASSISTANT], ASSISTANT) for s in range(4)}
CLOSING_COST = np.array([INSERT * len(CLOSING[s]) for s in range(4)], np.int64)


def _step(role: str | None) -> np.ndarray:
    """Cost of going from each state to each state over a turn of this role; merging
    keeps the state."""
    m = np.full((4, 4), INF)
    for t in (SYSTEM, USER, ASSISTANT):
        label = 0 if ROLES[t - 1] == role else RELABEL
        for s in range(4):
            if (s, t) in EMPTIES:
                m[s, t] = label + INSERT * len(EMPTIES[s, t])
        m[t, t] = min(m[t, t], label + MERGE)
    return m


STEPS = {r: _step(r) for r in (*ROLES, None)}


def _known(role: str | None) -> str | None:
    role = role.strip().lower() if role else None
    return role if role in ROLES else None


def _forward(roles: list, v: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Costs after the turns and the states that they came from; ties go to the smaller state."""
    back = []
    for r in roles:
        through = v[:, None] + STEPS[r]
        back.append(through.argmin(axis=0))
        v = np.minimum(through.min(axis=0), INF)
    return v, back


def _trace(back: list[np.ndarray], state: int) -> list[int]:
    """States before and after each turn, from the one at the exit."""
    states = [state]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _summary(roles: list) -> np.ndarray:
    m = np.where(np.eye(4, dtype=bool), 0, INF)
    for r in roles:
        m = np.minimum((m[:, :, None] + STEPS[r][None]).min(axis=1), INF)
    return m


def _open_tag(state: int) -> str:
    return f"<|im_start|>{ROLES[state - 1]}\n"


CLOSE_TAG = "<|im_end|>\n"


def _piece(before: int, after: int, merged: bool, text: str | None, last: bool) -> str:
    body = (text or "").replace("<|", "<​|")
    empty = lambda states: "".join(_open_tag(s) + CLOSE_TAG for s in states)
    if merged:
        piece = "\n" + body
    else:
        piece = (CLOSE_TAG if before != START else "") + empty(EMPTIES[before, after]) + _open_tag(after) + body
    return piece + (CLOSE_TAG + empty(CLOSING[after]) if last else "")


def _is_merge(before: int, after: int, role: str | None) -> bool:
    return before == after and STEPS[role][before, after] == MERGE + (0 if ROLES[after - 1] == role else RELABEL)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The turns (conv_id, turn, role, text) of one conversation after the other."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
            if rows and row[0] != rows[0][0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


_START = np.where(np.arange(4) == START, 0, INF)


def _rendered(rows: list[tuple], entry: np.ndarray = _START, leave: int | None = None, first: int = 0) -> pa.Table:
    """Turns repaired and rendered, from the costs at the entry to the state at the exit
    (to the cheapest end, if this is not given)."""
    known = [_known(r[2]) for r in rows]
    v, back = _forward(known, entry)
    states = _trace(back, int((v + CLOSING_COST).argmin()) if leave is None else leave)
    out = []
    for i, (row, role) in enumerate(zip(rows, known)):
        a, b, last = states[i], states[i + 1], leave is None and i == len(rows) - 1
        merged, relabelled = _is_merge(a, b, role), ROLES[b - 1] != role
        action = "_".join(x for x, on in (("merge", merged), ("relabel", relabelled)) if on) or "keep"
        n = (0 if merged else len(EMPTIES[a, b])) + (len(CLOSING[b]) if last else 0)
        out.append((row[0], row[1], first + i, row[2], ROLES[b - 1], action, n, _piece(a, b, merged, row[3], last)))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=_NAMES)


def _columns(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


_LONGS = pa.list_(pa.int64())


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _long_conversations(turns: DataFrame, parts: int) -> DataFrame:
    """format_chats for conversations that are cut: parts of a range each."""
    keys = [*_ORDER, "salt"]
    # the salt parts turns that are equal in every respect
    ordered = turns.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)))
    ordered = ordered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = checkpoint(ordered.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")))
    key = ["conv", "part"]
    ordered = ordered.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    roles = ordered.select("conv", "part", "pos", "role")

    def summary(k: tuple, table: pa.Table) -> pa.Table:
        m = _summary([_known(r) for r in _ordered(table).column("role").to_pylist()])
        return _columns([(k[0].as_py(), k[1].as_py(), m.ravel().tolist())], conv=pa.string(), part=pa.int32(), m=_LONGS)

    def entries(table: pa.Table) -> pa.Table:
        out, v = [], _START
        for r in table.sort_by("part").to_pylist():
            out.append((r["conv"], r["part"], v.tolist()))
            v = np.minimum((v[:, None] + np.array(r["m"]).reshape(4, 4)).min(axis=0), INF)
        return _columns(out, conv=pa.string(), part=pa.int32(), entry=_LONGS)

    def ends(k: tuple, table: pa.Table, entry: pa.Table) -> pa.Table:
        given = entry.column("entry")[0].as_py()
        v, back = _forward([_known(r) for r in _ordered(table).column("role").to_pylist()], np.array(given))
        came = [_trace(back, s)[0] for s in range(4)]
        return _columns([(k[0].as_py(), k[1].as_py(), given, v.tolist(), came)], conv=pa.string(), part=pa.int32(), entry=_LONGS, v=_LONGS, came=_LONGS)

    def exits(table: pa.Table) -> pa.Table:
        rows, out, state = table.sort_by([("part", "descending")]).to_pylist(), [], None
        for r in rows:
            out.append((r["conv"], r["part"], r["entry"], state))
            state = r["came"][int((np.array(r["v"]) + CLOSING_COST).argmin()) if state is None else state]
        return _columns(out, conv=pa.string(), part=pa.int32(), entry=_LONGS, leave=pa.int64())

    def render(table: pa.Table, given: pa.Table) -> pa.Table:
        table, r = _ordered(table), given.to_pylist()[0]
        rows = list(zip(*(table.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))))
        return _rendered(rows, np.array(r["entry"]), r["leave"], table.column("pos")[0].as_py())

    summaries = roles.groupBy(*key).applyInArrow(summary, "conv string, part int, m array<long>")
    entry = summaries.groupBy("conv").applyInArrow(entries, "conv string, part int, entry array<long>")
    end = roles.groupBy(*key).cogroup(entry.groupBy(*key)).applyInArrow(ends, "conv string, part int, entry array<long>, v array<long>, came array<long>")
    leave = end.groupBy("conv").applyInArrow(exits, "conv string, part int, entry array<long>, leave long")
    return ordered.groupBy(*key).cogroup(leave.groupBy(*key)).applyInArrow(render, _SCHEMA)


_ORDER = ["conv_id", "turn", "role", "h", "h2"]
_SCHEMA = "conv_id long, turn long, nth long, role string, new_role string, action string, n_inserted long, piece string"


def format_chats(turns: DataFrame, part_rows: int = PART_ROWS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """conv_id, turn, nth, role, new_role, action, n_inserted, piece for every turn.

    The rendered form of a conversation is its pieces, one after the other in the order
    of nth; it is given in pieces because it may be longer than any value can be.
    ``action`` is keep, relabel, merge or merge_relabel and ``n_inserted`` counts the
    empty turns put before a turn (and, for the last one, after it).  In texts ``<|`` is
    parted by a zero-width space, so that no text can forge a tag.

    Turns are read in the order of turn, null first; equal turn numbers in the order of
    role and two hashes of the text.  A null or unknown role has to be relabelled, a
    null text is empty, a null conv_id is one conversation; repeated rows are turns of
    their own; an empty table gives no rows; other columns are not read.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    sizes = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > part_rows)
    cut = checkpoint(sizes.select(F.col("conv_id").alias("_conv"), "_n"))
    n_cut, n_turns = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    t = t.withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64("text", F.lit(1)))
    same = t["conv_id"].eqNullSafe(F.col("_conv"))
    small = F.broadcast(cut) if n_cut <= max_broadcast else cut
    whole = t.join(small, same, "left_anti") if n_cut else t
    whole = whole.repartition("conv_id").sortWithinPartitions(*_ORDER).select("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            yield from _rendered(rows).to_batches()

    out = whole.mapInArrow(render, _SCHEMA)
    if n_cut:
        out = out.unionByName(_long_conversations(t.join(small, same, "left_semi"), -(-n_turns // part_rows)))
    return out


_NAMES = ["conv_id", "turn", "nth", "role", "new_role", "action", "n_inserted", "piece"]
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())


def _sql_base(s: int, t: int) -> int | None:
    """Cost of going from a state to a turn's state, beside that of another role."""
    costs = [INSERT * len(EMPTIES[s, t])] if (s, t) in EMPTIES else []
    return min(costs + [MERGE] * (s == t), default=None)


def _sql_costs(t: int) -> list[tuple[int, int]]:
    return [(s, _sql_base(s, t)) for s in range(4) if _sql_base(s, t) is not None]


def _sql_least(t: int) -> str:
    return f"least({', '.join(f'v{s} + {c}' for s, c in _sql_costs(t))})"


def _sql_came(t: int) -> str:
    """The smallest of the states that a turn's state is reached from at the least cost."""
    return "CASE " + " ".join(f"WHEN v{s} + {c} = {_sql_least(t)} THEN {s}" for s, c in _sql_costs(t)) + " END"


def _sql_tags(states: tuple[int, ...]) -> str:
    return "'" + "".join(f"<|im_start|>{ROLES[x - 1]}|n<|im_end|>|n" for x in states) + "'"


def _sql_case(on: str, values: dict) -> str:
    return f"CASE {on} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"


_PAIR_LENGTHS = {f"{10 * s + t}": len(p) for (s, t), p in EMPTIES.items()}
_PAIR_TAGS = {f"{10 * s + t}": _sql_tags(p) for (s, t), p in EMPTIES.items()}
_ROLE_OF = {i + 1: f"'{r}'" for i, r in enumerate(ROLES)}
_FAR = 1 << 50
#: For tables in which conv_id and turn name one row; a line feed is written |n.
CHAT_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS nth,
    count(*) OVER (PARTITION BY conv_id) AS n, {_sql_case('lower(trim(role))', {f"'{r}'": i + 1 for i, r in enumerate(ROLES)})} AS own
  FROM conversations
),
f AS (
  SELECT conv_id, -1::BIGINT AS nth, 0::BIGINT AS v0, {', '.join(f'{_FAR}::BIGINT AS v{t}' for t in (1, 2, 3))}, {', '.join(f'0 AS b{t}' for t in (1, 2, 3))}
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT f.conv_id, f.nth + 1, {_FAR}, {', '.join(f'{_sql_least(t)} + CASE WHEN own = {t} THEN 0 ELSE {RELABEL} END' for t in (1, 2, 3))}, {', '.join(map(_sql_came, (1, 2, 3)))}
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.nth = f.nth + 1
),
g AS (
  SELECT f.conv_id, f.nth, CASE {' '.join(f"WHEN v{s} + {int(CLOSING_COST[s])} = least({', '.join(f'v{x} + {int(CLOSING_COST[x])}' for x in (1, 2, 3))}) THEN {s}" for s in (1, 2, 3))} END AS b
  FROM f JOIN t USING (conv_id, nth) WHERE f.nth = t.n - 1
  UNION ALL
  SELECT g.conv_id, g.nth - 1, CASE g.b WHEN 1 THEN f.b1 WHEN 2 THEN f.b2 ELSE f.b3 END
  FROM g JOIN f ON f.conv_id = g.conv_id AND f.nth = g.nth WHERE g.nth >= 0
),
p AS (
  SELECT t.*, x.b AS a, y.b AS b, t.nth = t.n - 1 AS last,
    x.b = y.b AND {MERGE} <= coalesce({INSERT} * {_sql_case('10 * x.b + y.b', _PAIR_LENGTHS)}, {MERGE}) AS merged
  FROM t JOIN g x ON x.conv_id = t.conv_id AND x.nth = t.nth - 1 JOIN g y ON y.conv_id = t.conv_id AND y.nth = t.nth
)
SELECT conv_id, turn, nth, role, {_sql_case('b', _ROLE_OF)} AS new_role,
  CASE WHEN merged AND own IS NOT DISTINCT FROM b THEN 'merge' WHEN merged THEN 'merge_relabel' WHEN own IS NOT DISTINCT FROM b THEN 'keep' ELSE 'relabel' END AS action,
  (CASE WHEN merged THEN 0 ELSE {_sql_case('10 * a + b', _PAIR_LENGTHS)} END + CASE WHEN last THEN {_sql_case('b', {s: len(c) for s, c in CLOSING.items()})} ELSE 0 END)::BIGINT AS n_inserted,
  replace(CASE WHEN merged THEN '|n' ELSE CASE WHEN a = {START} THEN '' ELSE '<|im_end|>|n' END || {_sql_case('10 * a + b', _PAIR_TAGS)} || '<|im_start|>' || {_sql_case('b', _ROLE_OF)} || '|n' END, '|n', chr(10))
    || replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|')
    || CASE WHEN last THEN replace('<|im_end|>|n' || {_sql_case('b', {s: _sql_tags(c) for s, c in CLOSING.items()})}, '|n', chr(10)) ELSE '' END AS piece
FROM p
"""
