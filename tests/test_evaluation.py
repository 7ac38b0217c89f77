"""Slices, running sums, budgets, medians and seed choices against plain loops."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brackwater.operators import evaluation, slices

CODE = """int total = 0;
Order order = load(id);
for (Item item : order.items) {
    total = total + item.price;
}
String name = user.name;
log(name);
if (total == limit) return total;
limit = total;"""


def plain_slice(lines, seed):
    words = lambda pattern, x: {m for m in re.findall(pattern, x)} - set(slices.KEYWORDS)
    defs = [words(slices.ASSIGNED, x) | words(slices.DECLARED, x) for x in lines]
    used = [words(slices.NAME, x) - d for x, d in zip(lines, defs, strict=True)]
    out = set(seed)
    while True:
        more = {j for i in out for v in used[i] for j in range(i + 1) if v in defs[j]} | {j for i in out for v in defs[i] for j in range(i, len(lines)) if v in used[j]}
        if more <= out:
            return out
        out |= more


def test_slices_match_plain_loops(spark):
    rng = np.random.default_rng(6)
    names = [f"v{i}" for i in range(9)]
    methods = {"code": CODE.split("\n"), "none": [], **{f"m{k}": [f"{rng.choice(names)} = {rng.choice(names)} + {rng.choice(names)};" if rng.random() < 0.7 else f"use({rng.choice(names)} == 1);" for _ in range(25)] for k in range(8)}}
    seeds = {"code": [6], **{f"m{k}": [int(x) for x in rng.choice(25, 2)] for k in range(8)}}
    lines = spark.createDataFrame([(m, i, x) for m, ls in methods.items() for i, x in enumerate(ls)] + [("code", 99, None)], "method string, line int, text string")
    got = {}
    for r in slices.slices(lines, spark.createDataFrame([(m, i) for m, ls in seeds.items() for i in ls] + [("absent", 1)], "method string, line int")).collect():
        got.setdefault(r["method"], set()).add(r["line"])
    assert got == {m: plain_slice(methods[m], seeds[m]) for m in seeds}
    assert got["code"] == {5, 6}


def test_running_sums_of_a_group_in_many_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][int(k)], int(o), int(c)) for k, o, c in zip(rng.choice(3, 900, p=[0.8, 0.1, 0.1]), rng.permutation(900), rng.integers(0, 9, 900), strict=True)]
    got = evaluation.running(spark.createDataFrame(rows, "g string, o int, c int").repartition(6), ["g"], ["o"], "c", parts=7).collect()
    assert len(got) == 900
    for g in ("a", "b", None):
        upto = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["o"]):
            upto += r["c"]
            assert r["upto"] == upto


def test_medians_count_values(spark):
    rows = [("a", v) for v in (5, 1, 1, 9)] + [("b", 3), ("c", None), ("d", 2), ("d", 8)]
    assert sorted(map(tuple, evaluation.upper_median(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").collect())) == [("a", 5), ("b", 3), ("d", 8)]


def test_budgets(spark):
    ranked = spark.createDataFrame([("q", "a", 1, 1500), ("q", "b", 2, 600), ("q", "c", 3, 3000), ("q", "d", 4, 0), ("r", "a", 1, 10)], "query string, id string, rank int, cost int")
    gold = spark.createDataFrame([("q", "b"), ("q", "d"), ("q", "b"), ("r", "a"), ("r", "z"), ("s", "a")], "query string, id string")
    got = {r["query"]: r.asDict() for r in evaluation.budget_curve(ranked, gold, (1000, 2000, 5100, 9000)).collect()}
    assert got["q"] == {"query": "q", "gold": 2, "full": 5101, "recall_1000": 0.0, "recall_2000": 0.5, "recall_5100": 0.5, "recall_9000": 1.0}
    assert (got["r"]["full"], got["r"]["recall_1000"]) == (10, 0.5) and (got["s"]["full"], got["s"]["recall_9000"]) == (0, 0.0)


def test_overlaps_across_bins(spark):
    targets = spark.createDataFrame([("f", 10, 200), ("f", 130, 131), ("g", 5, 1)], "file string, start int, end int")
    spans = spark.createDataFrame([("f", "whole", 1, 900), ("f", "low", 1, 10), ("f", "mid", 120, 140), ("f", "off", 201, 300), ("g", "x", 1, 9)], "file string, id string, start int, end int")
    got = {(r["t_start"], r["id"]): r["rank"] for r in evaluation.overlapping(targets, spans).collect()}
    assert got == {(10, "low"): 1, (10, "mid"): 2, (10, "whole"): 3, (130, "mid"): 1, (130, "whole"): 2}


def choices(score, floor=5, cap=30):
    order = sorted(score, key=lambda k: (-score[k], k))
    region, out = order[:cap], {f"top_{k}": order[:k] for k in (8, 15, 20)}
    for a, name in ((0.5, "near_5"), (0.35, "near_35")):
        near = [k for k in region if score[k] >= a * score[order[0]]]
        out[name] = near if len(near) >= floor else order[:floor]
    for m, name in ((0.85, "mass_85"), (0.9, "mass_9")):
        low = min(score[k] for k in region)
        total, upto, kept = sum(score[k] - low for k in region) or 1.0, 0.0, []
        for k in region:
            kept.append(k)
            upto += score[k] - low
            if upto / total >= m and len(kept) >= floor:
                break
        out[name] = kept
    gaps = [((score[region[i]] - score[region[i + 1]]) / score[region[i]] if score[region[i]] > 0 else 0.0, -i) for i in range(floor, len(region) - 1)]
    out["knee"] = region[: 1 - max(gaps)[1]] if gaps else region
    return out


@pytest.mark.parametrize("sizes", [(1, 4, 5, 6, 7), (12, 30, 31, 60)])
def test_seed_choices(spark, sizes):
    rng = np.random.default_rng(sum(sizes))
    groups = {f"g{n}": {f"i{k:02d}": float(s) for k, s in enumerate(rng.integers(-3, 40, n))} for n in sizes} | {f"flat{n}": {f"i{k:02d}": 2.0 for k in range(n)} for n in sizes}
    df = spark.createDataFrame([(g, k, s) for g, x in groups.items() for k, s in x.items()], "g string, id string, score double")
    got = evaluation.seed_choices(df, "g").collect()
    for g, score in groups.items():
        for name, want in choices(score).items():
            assert {r["id"] for r in got if r["g"] == g and r[name]} == set(want), (g, name)
