"""Trees grown through aggregates against a plain recursive version that draws the same numbers."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from kestrelog.operators import extra_trees, selection

SETTINGS = extra_trees.Settings(trees=5, depth=5, least=3, share=0.5, seed=11, together=2)
COLUMNS = ["a", "b", "c", "d"]


def draw(what, tree, node, f):
    return (int(hashlib.md5(f"{SETTINGS.seed}/{what}/{tree}/{node}/{f}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def slow_tree(rows, tree, weights, node=1, level=0):
    """rows (values, label) -> {node: (n, pos, feature, cut)}"""
    n, pos = len(rows), sum(y for _, y in rows)
    out = {node: (n, pos, None, None)}
    if level == SETTINGS.depth or pos in (0, n) or n < 2 * SETTINGS.least:
        return out
    lo, hi = [[f(x[i] for x, _ in rows) for i in range(len(COLUMNS))] for f in (min, max)]
    spread = sorted((draw("order", tree, node, i), i) for i in range(len(COLUMNS)) if hi[i] > lo[i])
    best = None
    for _, i in spread[: math.ceil(SETTINGS.share * len(COLUMNS))]:
        cut = lo[i] + (hi[i] - lo[i]) * draw("cut", tree, node, i)
        left = [y for x, y in rows if x[i] <= cut]
        right = [y for x, y in rows if x[i] > cut]
        if min(len(left), len(right)) < SETTINGS.least:
            continue

        def purity(ys):
            a, b = weights[0] * (len(ys) - sum(ys)), weights[1] * sum(ys)
            return (a * a + b * b) / (a + b)

        key = (round(purity(left) + purity(right), 9), -i, cut)
        best = max(best or key, key)
    if best:
        _, i, cut = best
        i = -i
        out[node] = (n, pos, i, cut)
        out |= slow_tree([r for r in rows if r[0][i] <= cut], tree, weights, 2 * node, level + 1)
        out |= slow_tree([r for r in rows if r[0][i] > cut], tree, weights, 2 * node + 1, level + 1)
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    rows = []
    for k in range(400):
        a, b, c = rng.random(), rng.randrange(5), rng.gauss(0, 1)
        rows.append((f"u{k}", 8 + k % 20, a, float(b), c, 1.0, a + 0.3 * b + 0.2 * c > 1.4 or rng.random() < 0.02))
    return rows


def frame(spark, data):
    return spark.createDataFrame(data, "user string, day int, a double, b double, c double, d double, label boolean").repartition(3)


def test_trees_and_scores_equal_plain_version(spark, data):
    rows = [(r[2:6], r[6]) for r in data]
    n, positives = len(rows), sum(y for _, y in rows)
    weights = n / (2 * (n - positives)), n / (2 * positives)
    df = frame(spark, data)
    trees = extra_trees.grow(df, COLUMNS, SETTINGS)
    got: dict = {}
    for r in trees.collect():
        got.setdefault(r.tree, {})[r.node] = (r.n, r.pos, r.feature, r.cut)
    want = {t: slow_tree(rows, t, weights) for t in range(SETTINGS.trees)}
    assert got == want and any(len(t) > 9 for t in want.values())

    def value(x, tree):
        node = 1
        while (at := want[tree][node])[2] is not None:
            node = 2 * node + (x[at[2]] > at[3])
        a, b = weights[0] * (at[0] - at[1]), weights[1] * at[1]
        return b / (a + b)

    for r in extra_trees.scores(df, ["user"], COLUMNS, trees).collect():
        x = next(d[2:6] for d in data if d[0] == r.user)
        assert r.score == pytest.approx(sum(value(x, t) for t in want) / len(want))


def test_one_class_and_no_rows(spark, data):
    df = frame(spark, data)
    same = extra_trees.grow(df.where("label"), COLUMNS, SETTINGS)
    assert {(r.node, r.value) for r in same.collect()} == {(1, 1.0)}
    empty = extra_trees.grow(df.limit(0), COLUMNS, SETTINGS)
    assert empty.count() == 0
    assert {r.score for r in extra_trees.scores(df, ["user"], COLUMNS, empty).collect()} == {None}


def test_choice_by_precision_then_f1_with_a_frozen_threshold(spark, data):
    """Two candidates with equal average precision on validation days, of which one has the better F1 threshold; a third is worse."""
    df = frame(spark, data).select("user", "day", "label", "a", "b", "c", "d")
    by = lambda expr: lambda train: lambda rows: rows.selectExpr("user", "day", "label", f"{expr} as score")
    found = selection.compare_classifiers(df, {"trees": selection.tree_classifier(COLUMNS, SETTINGS), "noise": by("cast(hash(user) as double)"), "constant": by("0.5")})
    rows = {(r.model, r.part): r for r in found.collect()}
    assert {m for (m, _), r in rows.items() if r.chosen} == {"trees"}
    for m in ("trees", "noise", "constant"):
        assert rows[m, "test"].threshold == rows[m, "validation"].threshold
    assert rows["trees", "test"].ap > 2 * rows["noise", "test"].ap and rows["constant", "validation"].recall == 1.0
