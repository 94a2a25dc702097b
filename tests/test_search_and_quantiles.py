"""Block search and order statistics against plain numpy."""

import math
import random

import numpy as np
import pytest

from marlstone.functions.statistics import exclusive_quantile
from marlstone.operators.retrieval import vector_topk


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_blocks_find_what_a_full_scan_finds(spark, block):
    chance = np.random.default_rng(block)
    items = {f"i{k:03d}": chance.integers(-2, 3, 5).tolist() for k in range(150)}
    items |= {"i200": [0, 0, 0, 0, 0], "i000": items["i001"], "other": [1, 2, 3]}
    asked = {k: items[k] for k in ("i000", "i001", "i007", "i200")}
    frame = lambda rows, name: spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows.items()] + [("none", None)], f"{name} string, embedding array<float>").repartition(3)
    for itself in (False, True):
        got = {}
        for r in vector_topk(frame(asked, "query_id"), frame(items, "item_id"), 6, but_itself=itself, block_rows=block).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.item_id, r.similarity)
        for q, v in asked.items():
            unit = lambda x: np.array(x, float) / (np.linalg.norm(x) or 1)
            scored = sorted((-round(float(unit(v) @ unit(x)), 6) + 0.0, k) for k, x in items.items() if len(x) == 5 and not (itself and k == q))
            assert [got[q][n + 1][0] for n in range(6)] == [k for _, k in scored[:6]]
            assert np.allclose([got[q][n + 1][1] for n in range(6)], [-s for s, _ in scored[:6]])
    assert vector_topk(frame(asked, "query_id"), frame({}, "item_id"), 3).count() == 0


def exclusive(values, p):
    v, n = sorted(values), len(values)
    spot = p * (n + 1)
    j = max(min(math.floor(spot), n - 1), 1)
    return v[j - 1] + (v[min(j, n - 1)] - v[j - 1]) * (spot - j)


@pytest.mark.parametrize("few", [50, 10**6])
@pytest.mark.parametrize("p", [0.5, 0.95])
def test_quantiles_by_histograms(spark, few, p):
    rnd = random.Random(few)
    groups = {
        "many": [rnd.gauss(0, 1) for _ in range(900)], "clusters": [1e-9 * k for k in range(200)] + [1e12 + k for k in range(200)], "same": [4.0] * 300, "one": [2.5], "two": [1.0, 9.0],
        None: [float(rnd.randint(0, 3)) for _ in range(500)], "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 300) for _ in range(300)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("many", None), ("empty", None)]
    got = {r.g: r.quantile for r in exclusive_quantile(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], p, few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert math.isclose(got[g], exclusive(vs, p), rel_tol=1e-12, abs_tol=1e-300), g
    whole = exclusive_quantile(spark.createDataFrame(rows, "g string, v double").where("g = 'many'"), "v", [], p, few).first()
    assert math.isclose(whole.quantile, exclusive(groups["many"], p))
