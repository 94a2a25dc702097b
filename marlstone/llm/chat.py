"""Chat formatting: the cheapest repair that makes a conversation's turns legal, and its rendering.

Legal turns: at most one system turn, first; then user and assistant in turn, the assistant last. A message may be kept,
merged into the turn before it, or relabelled, and empty turns may be inserted; dynamic programming over the states
"nothing yet, system, user, assistant" finds the cheapest way.

A conversation is cut into blocks of `block` turn numbers. Each block gives the cheapest cost from every state to every
state (a 4 x 4 table), the tables of a conversation give the states between its blocks, and each block is then traced
back between its two states. A conversation with a third of all messages so spreads over many tasks; only its tables,
one for each block, meet in one.

Messages are ordered by turn, then role, then text; a null turn comes first. Edge cases: a null role, or one that is not
known, must be relabelled; a null text is empty; repeated rows are separate messages; a null conversation id is a
conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import stored, text_batches

ROLES = ("system", "user", "assistant")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    """Whole-number costs of the repairs."""

    merge: int = 1
    relabel: int = 2
    insert: int = 3


def _ways(state: int, most: int = 2) -> dict[int, tuple[int, ...]]:
    """The fewest empty turns that lead from a state to each other state, itself by none."""
    found, edge = {state: ()}, [state]
    for _ in range(most):
        edge = [(n) for s in edge for n in NEXT[s] if n not in found and not found.update({n: (*found[s], n)})]
    return found


def moves(role: int, costs: Costs) -> list[list[tuple[int, int, tuple[int, ...], bool]]]:
    """For a message of `role` (0: unknown) and each state before and after: cost, label, inserted turns, merged or not."""
    table = []
    for before in range(4):
        row = [(FAR, 0, (), False)] * 4
        for label in (SYSTEM, USER, ASSISTANT):
            relabel = costs.relabel * (label != role)
            options = [(relabel + costs.insert * len(way), label, way, False) for at, way in _ways(before).items() if label in NEXT[at]]
            if label == before:
                options.append((relabel + costs.merge, label, (), True))
            if options:
                row[label] = min([row[label], *options])
        table.append(row)
    return table


def ending(state: int, costs: Costs) -> tuple[int, tuple[int, ...]]:
    """The cost of ending after a state, and the empty turns that it takes. Nothing at all may stay nothing."""
    if state == NOTHING:
        return 0, ()
    way = _ways(state)[ASSISTANT]
    return costs.insert * len(way), way


def _codes(batch, names):
    known = {r: k for k, r in enumerate(ROLES, 1)}
    return [known.get(r, 0) for r in batch.column(names.index("_role")).to_pylist()]


def _blocks(batches, more: tuple[str, ...]):
    """The sorted rows as lists of one block each: key, then role codes and the columns `more`."""
    key, codes, rest = None, [], []
    for batch in batches:
        names = batch.schema.names
        keys = zip(batch.column(names.index("_conv")).to_pylist(), batch.column(names.index("_block")).to_pylist())
        extra = zip(*(batch.column(names.index(c)).to_pylist() for c in more)) if more else [()] * batch.num_rows
        for k, c, x in zip(keys, _codes(batch, names), extra):
            if k != key and codes:
                yield key, codes, rest
                codes, rest = [], []
            key = k
            codes.append(c)
            rest.append(x)
    if codes:
        yield key, codes, rest


def _tables(costs: Costs, kind):
    import pyarrow as pa

    steps = [[[cell[0] for cell in row] for row in moves(r, costs)] for r in range(4)]

    def run(batches):
        for (conv, block), codes, _ in _blocks(batches, ()):
            table = [[0 if a == b else FAR for b in range(4)] for a in range(4)]
            for c in codes:
                step = steps[c]
                table = [[min(row[m] + step[m][b] for m in range(4)) for b in range(4)] for row in table]
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([block], pa.int64()), pa.array([[min(x, FAR) for row in table for x in row]], pa.list_(pa.int64()))], ["_conv", "_block", "_table"])

    return run


def _borders(costs: Costs, kind):
    import pyarrow as pa

    def solve(conv, blocks, tables):
        best, back = [0, FAR, FAR, FAR], []
        for t in tables:
            pick = [min(range(4), key=lambda a, b=b: best[a] + t[4 * a + b]) for b in range(4)]
            best = [best[pick[b]] + t[4 * pick[b] + b] for b in range(4)]
            back.append(pick)
        last = min(range(4), key=lambda s: best[s] + ending(s, costs)[0])
        cost, ends = best[last] + ending(last, costs)[0], [last]
        for pick in reversed(back):
            ends.append(pick[ends[-1]])
        ends.reverse()
        n = len(blocks)
        return pa.RecordBatch.from_arrays(
            [pa.array([conv] * n, kind), pa.array(blocks, pa.int64()), pa.array(ends[:-1], pa.int32()), pa.array(ends[1:], pa.int32()), pa.array([k == n - 1 for k in range(n)]), pa.array([cost] * n, pa.int64())],
            ["_conv", "_block", "_from", "_to", "_last", "_cost"],
        )

    def run(batches):
        conv, blocks, tables = None, [], []
        for batch in batches:
            for c, b, t in zip(*(batch.column(batch.schema.names.index(n)).to_pylist() for n in ("_conv", "_block", "_table"))):
                if c != conv and blocks:
                    yield solve(conv, blocks, tables)
                    blocks, tables = [], []
                conv = c
                blocks.append(b)
                tables.append(t)
        if blocks:
            yield solve(conv, blocks, tables)

    return run


def trace(codes: list[int], start: int, end: int, costs: Costs) -> list[tuple[int, int, tuple[int, ...], bool]]:
    """The cheapest moves of a block between two states: cost, label, inserted turns, merged or not, by message."""
    tables = [moves(r, costs) for r in range(4)]
    best, back = [FAR] * 4, []
    best[start] = 0
    for c in codes:
        pick = [min(range(4), key=lambda a, b=b, t=tables[c]: best[a] + t[a][b][0]) for b in range(4)]
        best = [best[pick[b]] + tables[c][pick[b]][b][0] for b in range(4)]
        back.append(pick)
    out, state = [], end
    for c, pick in zip(reversed(codes), reversed(back)):
        out.append(tables[c][pick[state]][state])
        state = pick[state]
    return out[::-1]


def _repaired(costs: Costs, kind, turn_kind):
    import pyarrow as pa

    names = ["_conv", "_block", "_place", "_turn", "_label", "_action", "_text", "_rendered", "_cost"]
    kinds = [kind, pa.int64(), pa.int64(), turn_kind, pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for (conv, block), codes, rest in _blocks(batches, ("_turn", "_text", "_from", "_to", "_last", "_cost")):
            start, end, last, cost = rest[0][2:]
            rows, begun = [], start != NOTHING

            def say(turn, label, action, text, new, rows=rows):
                nonlocal begun
                head = ("<|end|>\n" if begun else "") + f"<|{ROLES[label - 1]}|>\n" if new else "\n\n"
                rows.append([turn, ROLES[label - 1], action, text, head + text])
                begun = True

            for code, (turn, text, *_), (_, label, inserted, merged) in zip(codes, rest, trace(codes, start, end, costs)):
                for x in inserted:
                    say(None, x, "insert", "", True)
                action = "+".join(a for a, on in (("relabel", label != code), ("merge", merged)) if on) or "keep"
                say(turn, label, action, text or "", not merged)
            if last:
                for x in ending(end, costs)[1]:
                    say(None, x, "insert", "", True)
                rows[-1][-1] += "<|end|>\n"
            n = len(rows)
            columns = [[conv] * n, [block] * n, list(range(n)), *map(list, zip(*rows)), [cost] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def repair_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs(), block: int = 512) -> DataFrame:
    """One row a message of the repaired conversations: id, block and place (their order in it), turn (null: inserted),
    role, action, text, rendered (a conversation's rendering is theirs in order) and cost (the conversation's)."""
    from pyspark.sql.pandas.types import to_arrow_type

    text_batches(messages.sparkSession)
    conv_type, turn_type = messages.schema[conv_col].dataType, messages.schema[turn_col].dataType
    kind, turn_kind = to_arrow_type(conv_type), to_arrow_type(turn_type)
    conv_name, turn_name = conv_type.simpleString(), turn_type.simpleString()
    rows = messages.select(
        F.col(conv_col).alias("_conv"),
        F.coalesce(F.floor(F.col(turn_col) / block), F.lit(-(1 << 62))).cast("long").alias("_block"),
        F.col(turn_col).alias("_turn"),
        F.col(role_col).alias("_role"),
        F.col(text_col).alias("_text"),
    )
    order = ["_conv", "_block", "_turn", "_role", "_text"]
    tables = rows.drop("_text").repartition("_conv", "_block").sortWithinPartitions(*order[:-1]).mapInArrow(_tables(costs, kind), f"_conv {conv_name}, _block long, _table array<long>")
    borders = tables.repartition("_conv").sortWithinPartitions("_conv", "_block").mapInArrow(_borders(costs, kind), f"_conv {conv_name}, _block long, _from int, _to int, _last boolean, _cost long")
    borders = stored(borders, "chat-borders").select(F.col("_conv").alias("_c"), F.col("_block").alias("_b"), "_from", "_to", "_last", "_cost")
    full = rows.join(borders, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b"))).drop("_c", "_b")
    done = (
        full.repartition("_conv", "_block")
        .sortWithinPartitions(*order)
        .mapInArrow(_repaired(costs, kind, turn_kind), f"_conv {conv_name}, _block long, _place long, _turn {turn_name}, _label string, _action string, _text string, _rendered string, _cost long")
    )
    return done.select(
        F.col("_conv").alias(conv_col),
        F.col("_block").alias("block"),
        F.col("_place").alias("place"),
        F.col("_turn").alias(turn_col),
        F.col("_label").alias("role"),
        F.col("_action").alias("action"),
        F.col("_text").alias("text"),
        F.col("_rendered").alias("rendered"),
        F.col("_cost").alias("cost"),
    )
