"""Role repair against exhaustive search, whatever the block size."""

import itertools
import random

import pytest

from marlstone.llm.chat import Costs, repair_conversations

COST = Costs()


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return bool(roles) and len(roles) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles))


def cheapest(roles):
    """The least cost over all labels, merges and insertions of up to two turns before each message and at the end."""
    best = None
    ways = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for labels in itertools.product(("system", "user", "assistant"), repeat=len(roles)):
        states = {(): 0}
        for role, label in zip(roles, labels):
            new = {}
            for seq, cost in states.items():
                cost += COST.relabel * (label != role)
                if seq and seq[-1] == label:
                    new[seq] = min(new.get(seq, 99), cost + COST.merge)
                for w in ways:
                    s = (*seq, *w, label)
                    new[s] = min(new.get(s, 99), cost + COST.insert * len(w))
            states = {s: c for s, c in new.items() if best is None or c < best}
        for seq, cost in states.items():
            for w in ways:
                if legal([*seq, *w]):
                    total = cost + COST.insert * len(w)
                    best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("block", [1, 2, 512])
def test_costs_and_rendering(spark, block):
    rnd = random.Random(4)
    names = ["system", "user", "assistant", "tool", None]
    convs = {k: [rnd.choice(names) for _ in range(rnd.randrange(1, 5))] for k in range(40)}
    convs[100] = ["user", "assistant"] * 400
    rows = [(k, t, r, f"{k}.{t}" if t % 3 else None, "x") for k, roles in convs.items() for t, r in enumerate(roles)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string").repartition(4)
    got: dict = {}
    for r in repair_conversations(messages, block=block).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == set(convs)
    for k, out in got.items():
        out.sort(key=lambda r: (r.block, r.place))
        turns = [r.role for r in out if "merge" not in r.action]
        assert legal(turns)
        if k < 100:
            assert out[0].cost == cheapest(convs[k]), convs[k]
        used = sum(COST.merge * ("merge" in r.action) + COST.relabel * ("relabel" in r.action) + COST.insert * (r.action == "insert") for r in out)
        assert used == out[0].cost
        assert [r.text for r in out if r.action != "insert"] == [f"{k}.{t}" if t % 3 else "" for t in range(len(convs[k]))]
        whole = "".join(r.rendered for r in out)
        assert whole.startswith("<|") and whole.endswith("<|end|>\n") and whole.count("<|end|>") == len(turns)


def test_edges(spark):
    rows = [(None, None, "user", "a"), (None, 1, "assistant", "b"), (2, 0, "user", "same"), (2, 0, "user", "same"), (3, 0, None, None)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair_conversations(messages).collect()
    assert sum(r.conv_id is None for r in got) == 2
    assert {(r.action, r.text) for r in got if r.conv_id == 2} == {("keep", "same"), ("relabel", "same")}
    assert repair_conversations(messages.where("false")).count() == 0
