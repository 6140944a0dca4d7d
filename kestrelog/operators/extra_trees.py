"""Extremely randomised trees: many trees grown level by level through aggregates over all rows.

A level needs two aggregates: the range of every input in every open node, from which random
cuts are drawn, and the counts of both classes on each side of every cut. The cut of least
weighted impurity stays, and rows move on to the sides. Draws follow from (seed, tree, node,
input), so a tree is the same however rows are dealt out. Nodes are numbered from 1; the
sides of node n are 2n and 2n + 1. Only node tables are broadcast: trees x 2^depth rows at most.

A row is stored once and never copied per tree: tasks walk it through the broadcast nodes and
hand on a partial aggregate for each node, which Spark adds up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kestrelog.functions import tables


@dataclass(frozen=True)
class Settings:
    """share of the inputs are tried at a node, sides keep `least` rows; `together` trees are grown at a time."""

    trees: int = 50
    depth: int = 12
    least: int = 3
    share: float = 0.8
    seed: int = 42
    together: int = 25


def draw(seed: int, what: str, *parts: Column) -> Column:
    """A number in (0, 1) that follows from the seed and the parts."""
    text = F.concat_ws("/", F.lit(f"{seed}/{what}"), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def class_weights(rows: DataFrame) -> tuple[float, float]:
    """Weights of the negative and the positive class that give both half of the whole."""
    n, positives = rows.agg(F.count("*"), F.count_if("label")).first()
    return n / (2.0 * max(n - positives, 1)), n / (2.0 * max(positives, 1))


def _purity(low: float, high: float, n: Column, pos: Column) -> Column:
    """Sum of squared class weights over the weight of a side: large where a side is of one class."""
    a, b = low * (n - pos), high * pos
    return (a * a + b * b) / (a + b)


def _cuts(nodes: DataFrame, m: int, settings: Settings) -> DataFrame:
    """Nodes (tree, node, lo, hi) with `cuts`: a random cut of each input that is tried, null for the others."""
    tried = max(1, math.ceil(settings.share * m))
    spread = F.filter(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.struct(draw(settings.seed, "order", F.col("tree"), F.col("node"), i).alias("at"), i.alias("f"))), lambda s: F.get("hi", s["f"]) > F.get("lo", s["f"]))
    chosen = F.transform(F.slice(F.array_sort(spread), 1, tried), lambda s: s["f"])

    def cut(i: Column) -> Column:
        lo, hi = F.get("lo", i), F.get("hi", i)
        at = lo + (hi - lo) * draw(settings.seed, "cut", F.col("tree"), F.col("node"), i)
        return F.when(F.array_contains(F.col("chosen"), i), F.when(at < hi, at).otherwise(lo))

    return nodes.withColumn("chosen", chosen).withColumn("cuts", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), cut))


@dataclass(frozen=True)
class Nodes:
    """Nodes by tree and number; those without feature (-1) are ends. The last entry is where rows without a value go."""

    tree: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    kid: np.ndarray  # the place of 2n; that of 2n + 1 follows
    roots: np.ndarray

    @staticmethod
    def of(found: dict[tuple[int, int], tuple[int, float] | None]) -> Nodes:
        """(tree, node) -> (feature, cut) or None."""
        keys = sorted(found)
        place = {k: i for i, k in enumerate(keys)}
        feature, cut, kid = np.full(len(keys) + 1, -1), np.zeros(len(keys) + 1), np.zeros(len(keys) + 1, np.int64)
        for (tree, node), split in found.items():
            if split is not None:
                i = place[tree, node]
                feature[i], cut[i], kid[i] = *split, place[tree, 2 * node]
        tree, node = (np.array([*(k[j] for k in keys), 0], np.int64) for j in (0, 1))
        return Nodes(tree, node, feature, cut, kid, np.flatnonzero(node == 1))

    def ends(self, root: int, x: np.ndarray, missing: np.ndarray | None) -> np.ndarray:
        """The places of the ends that rows reach from a root; NaN is greater than any cut."""
        at, live = np.full(len(x), root), np.arange(len(x))
        while True:
            inner = self.feature[at[live]] >= 0
            live = live[inner]
            if not len(live):
                return at
            i = at[live]
            f = self.feature[i]
            at[live] = self.kid[i] + ~(x[live, f] <= self.cut[i])
            if missing is not None:
                at[live[missing[live, f]]] = -1


def _matrix(column: pa.Array, m: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Arrays of m values -> their matrix with NaN for nulls, and where nulls are if there are any."""
    values = column.flatten()
    missing = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, m) if values.null_count else None
    return values.to_numpy(zero_copy_only=False).reshape(-1, m), missing


def _groups(at: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by their places that are kept -> (rows in that order, where a place begins, places)."""
    rows = np.flatnonzero(kept[at])
    rows = rows[np.argsort(at[rows], kind="stable")]
    starts = np.flatnonzero(np.diff(at[rows], prepend=-2))
    return rows, starts, at[rows[starts]]


def _partial(shared, m: int, level: int, lists: tuple[str, str], measure):
    """A task's rows (label, x) -> (tree, node, n, pos, and two lists of m values) for the nodes of a level that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, cuts = shared.value
        kept = nodes.node >> level == 1
        slot = np.cumsum(kept) - 1
        size, empty, kind, merge = int(kept.sum()), *measure
        n, pos = np.zeros((2, size), np.int64)
        totals = [np.full((size, m), e, kind) for e in empty]
        for batch in batches:
            label = batch.column(0).fill_null(False).to_numpy(zero_copy_only=False)
            x, missing = _matrix(batch.column(1), m)
            for root in nodes.roots:
                at = nodes.ends(root, x, missing)
                rows, starts, places = _groups(at, kept)
                if len(rows):
                    to, y = slot[places], label[rows]
                    n[to] += np.diff(starts, append=len(rows))
                    pos[to] += np.add.reduceat(y, starts, dtype=np.int64)
                    merge(totals, to, starts, x[rows], None if missing is None else missing[rows], y, None if cuts is None else cuts[at[rows]])
        met = np.flatnonzero(n)
        spread = [pa.ListArray.from_arrays(pa.array(np.arange(0, m * len(met) + 1, m), pa.int32()), pa.array(t[met].reshape(-1))) for t in totals]
        at = np.flatnonzero(kept)[met]
        yield pa.RecordBatch.from_arrays([pa.array(nodes.tree[at], pa.int32()), pa.array(nodes.node[at], pa.int32()), pa.array(n[met]), pa.array(pos[met]), *spread], ["tree", "node", "n", "pos", *lists])

    return run


def _ranges(totals, to, starts, x, missing, y, cuts) -> None:
    lo, hi = totals
    lo[to] = np.fmin(lo[to], np.fmin.reduceat(x, starts))
    hi[to] = np.maximum(hi[to], np.maximum.reduceat(x if missing is None else np.where(missing, -np.inf, x), starts))


def _sides(totals, to, starts, x, missing, y, cuts) -> None:
    left = x <= cuts  # neither NaN nor null is
    totals[0][to] += np.add.reduceat(left, starts, dtype=np.int64)
    totals[1][to] += np.add.reduceat(left & y[:, None], starts, dtype=np.int64)


def _split(rows: DataFrame, nodes: Nodes, level: int, m: int, weights: tuple[float, float], settings: Settings, last: bool) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, float]]]:
    """Stored rows (label, x) -> the nodes of a level with counts, and (feature, cut) of those that split."""
    sc = rows.sparkSession.sparkContext
    each = lambda f: F.array(*[f(i) for i in range(m)])
    task = _partial(sc.broadcast((nodes, None)), m, level, ("lo", "hi"), ((np.nan, -np.inf), float, _ranges))
    found = rows.mapInArrow(task, "tree int, node int, n long, pos long, lo array<double>, hi array<double>")
    found = found.groupBy("tree", "node").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), each(lambda i: F.min(F.col("lo")[i])).alias("lo"), each(lambda i: F.max(F.col("hi")[i])).alias("hi"))
    found = tables.stored(found, "tree-nodes")
    counts = found.select("tree", "node", "n", "pos")
    open_ = _cuts(found.where(f"pos > 0 and pos < n and n >= {2 * settings.least}"), m, settings).select("tree", "node", "n", "pos", "cuts")
    drawn = [] if last else open_.collect()  # trees x 2^level rows at most, as the splits below
    if not drawn:
        return counts, {}
    cuts, place = np.full((len(nodes.node), m), np.nan), {k: i for i, k in enumerate(zip(nodes.tree.tolist(), nodes.node.tolist()))}
    for r in drawn:
        cuts[place[r.tree, r.node]] = [np.nan if c is None else c for c in r.cuts]
    task = _partial(sc.broadcast((nodes, cuts)), m, level, ("left", "left_pos"), ((0, 0), np.int64, _sides))
    sides = rows.mapInArrow(task, "tree int, node int, n long, pos long, left array<long>, left_pos array<long>")
    counted = sides.groupBy("tree", "node").agg(*[each(lambda i, c=c: F.sum(F.col(c)[i])).alias(c) for c in ("left", "left_pos")])
    counted = counted.join(tables.checked(tables.stored(open_, "tree-cuts")), ["tree", "node"])

    def worth(i: Column) -> Column:
        n, pos = F.get("left", i), F.get("left_pos", i)
        fits = F.get("cuts", i).isNotNull() & (n >= settings.least) & (F.col("n") - n >= settings.least)
        gain = F.round(_purity(*weights, n, pos) + _purity(*weights, F.col("n") - n, F.col("pos") - pos), 9)
        return F.when(fits, F.struct(gain.alias("gain"), (-i).alias("minus"), F.get("cuts", i).alias("cut")))

    best = F.array_max(F.filter(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), worth), lambda s: s.isNotNull()))
    split = counted.withColumn("best", best).where("best is not null").select("tree", "node", (-F.col("best.minus")).cast("int").alias("feature"), "best.cut")
    return counts, {(r.tree, r.node): (r.feature, r.cut) for r in split.collect()}


def grow(rows: DataFrame, features: list[str], settings: Settings = Settings()) -> DataFrame:
    """rows (label and features) -> trees (tree, node, n, pos, feature, cut, value): a row for each node.

    feature is null in leaves; value is the positives' share of the class-balanced weight. Rows
    at or below a cut go left. Every tree sees every row. Without rows there are no trees.
    """
    weights = class_weights(rows)
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows, out, splits = tables.stored(rows.select(F.col("label"), x.alias("x")), "tree-rows"), None, []
    for first in range(0, settings.trees, settings.together):
        found: dict = {(tree, 1): None for tree in range(first, min(settings.trees, first + settings.together))}
        for level in range(settings.depth + 1):
            counts, split = _split(rows, Nodes.of(found), level, len(features), weights, settings, level == settings.depth)
            out = counts if out is None else out.unionByName(counts)
            found |= split | {(tree, 2 * node + side): None for tree, node in split for side in (0, 1)}
            splits += [(*key, *at) for key, at in split.items()]
            if not split:
                break
    splits = rows.sparkSession.createDataFrame(splits, "tree int, node int, feature int, cut double")
    a, b = weights[0] * (F.col("n") - F.col("pos")), weights[1] * F.col("pos")
    return tables.stored(out.join(F.broadcast(splits), ["tree", "node"], "left").withColumn("value", b / (a + b)), "trees")


def scores(rows: DataFrame, keys: list[str], features: list[str], trees: DataFrame) -> DataFrame:
    """rows -> (keys, score): the mean value of the leaves that a row falls into. keys name a row. Null without trees."""
    grown = trees.collect()  # trees x 2^(depth + 1) rows at most
    found = {(r.tree, r.node): None if r.feature is None else (r.feature, r.cut) for r in grown}
    nodes, m = Nodes.of(found), len(features)
    worth = {(r.tree, r.node): r.value for r in grown}
    value = np.array([*(worth[k] for k in sorted(worth)), 0.0])
    shared = rows.sparkSession.sparkContext.broadcast((nodes, value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, value = shared.value
        for batch in batches:
            x, missing = _matrix(batch.column(len(keys)), m)
            total, n = np.zeros(len(x)), np.zeros(len(x), np.int64)
            for root in nodes.roots:
                at = nodes.ends(root, x, missing)
                total += value[at]
                n += at >= 0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(total / np.maximum(n, 1), mask=n == 0)], [*keys, "score"])

    held = rows.select(*keys, F.array(*[F.col(c).cast("double") for c in features]).alias("__x"))
    return held.mapInArrow(run, StructType([*held.schema.fields[:-1], StructField("score", DoubleType())]))
