"""Boosted regression trees for many targets, grown side by side in common passes over the rows.

Columns are cut into at most 63 bins once. A pass handles one level of the current tree of every model: tasks sum residuals
and counts by (model, node, feature, bin), a shuffle by model adds the tasks' sums and finds each node's best split, and only
those splits come to the driver. So 24 targets with 200 trees of depth 6 are 1,200 passes, whatever the number of targets.
The passes run on an RDD of blocks of binned rows: each is a short job, and a block keeps what the trees so far predict.
A pass costs a job, and most of it is not counting while a task can hold the table: up to four million rows (``ALONE`` blocks) each
model's passes follow each other in a task of its own, with the same sums, splits and trees.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import importable, shared_dir, written
from .ordered import BEFORE, SKETCH, SLACK, UP_TO

#: Bin 0 holds nulls and NaN, which go left of every cut; bins 1 to 63 lie between quantiles.
BINS = 64
#: Rows of a block at most; residuals are summed as integers of this many parts of a unit, so sums do not depend on order.
BLOCK, PARTS = 1 << 16, 1 << 20
#: Blocks of a table whose models are each grown in a task of its own: four million rows, a byte for each bin, two for each pair of bins.
ALONE = 64
#: Rows that are counted at a time, so that their numbers stay in the cache, and cells of a bundle at most.
CHUNK, CELLS = 1 << 16, BINS * BINS
#: Trees between two checkpoints of what the blocks predict.
CHECKPOINT = 25


@dataclass(frozen=True)
class Spec:
    """What to train: the label and the limits of its trees. ``rows`` and ``columns`` are the shares that each tree sees."""

    label: str
    trees: int = 200
    rate: float = 0.05
    depth: int = 6
    leaves: int = 31
    least: int = 50
    rows: float = 0.8
    columns: float = 0.8
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: the children of node i are 2 i + 1 (bins up to the cut) and 2 i + 2. Feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def of_depth(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.uint8), np.zeros(n))

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row reaches after ``depth`` steps."""
        at = np.zeros(len(bins), np.int32)
        for _ in range(depth):
            at = self.step(bins, at)
        return at

    def step(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        feature = self.feature[at]
        down = 2 * at + 1 + (bins[np.arange(len(bins)), feature] > self.cut[at])
        return np.where(feature >= 0, down, at).astype(np.int32)

    def full(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, cuts and values of the same tree with all leaves at ``depth``: from a leaf above it, rows go left down to its value."""
        feature, cut, value = self.feature.astype(np.int64), self.cut.copy(), self.value.copy()
        for level in range(depth):
            nodes = np.arange(2 ** level - 1, 2 ** (level + 1) - 1)
            leaves = nodes[self.feature[nodes] < 0]
            feature[leaves], cut[leaves], value[2 * leaves + 1] = 0, 255, value[leaves]
        return feature, cut, value


@dataclass
class Model:
    spec: Spec
    features: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def staged(self, bins: np.ndarray) -> Iterator[np.ndarray]:
        """Predictions after each tree."""
        out, flat, first = np.full(len(bins), self.start), np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
        for tree in self.trees:
            feature, cut, value = tree.full(self.spec.depth)
            at = np.zeros(len(bins), np.int64)
            for _ in range(self.spec.depth):
                right = flat.take(first + feature.take(at, mode="clip"), mode="clip") > cut.take(at, mode="clip")
                at += at
                at += right
                at += 1
            out = out + value.take(at, mode="clip")
            yield out

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for out in self.staged(bins):
            pass
        return out


def binned(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a batch, row by row: 1 plus the number of edges below the value, 0 for NaN."""
    out = np.empty((len(columns[0]), len(columns)), np.uint8)
    for i, (x, e) in enumerate(zip(columns, edges)):
        out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(e, x, side="left") + 1)
    return out


def _doubles(df: DataFrame, columns: Iterable[str]) -> list:
    return [F.col(f"`{c}`").cast("double").alias(c) for c in columns]


def _arrays(batch: pa.RecordBatch, columns: range) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in columns]


@dataclass
class Block:
    """Binned rows with the labels and present predictions of one group of models."""

    place: tuple[int, int]
    bins: np.ndarray
    models: list[int]
    labels: np.ndarray
    predicted: np.ndarray


def _unpack(row, n_features: int, groups: list[list[int]], label_of: list[int], starts: list[float]) -> list[tuple[int, Block]]:
    bins = np.frombuffer(row["bins"], np.uint8).reshape(row["n"], n_features)
    labels = np.frombuffer(row["labels"], np.float64).reshape(row["n"], -1)
    return [(row["block"] * len(groups) + g, Block((row["block"], g), bins, models, np.ascontiguousarray(labels[:, [label_of[m] for m in models]].T),
                                                   np.repeat([[starts[m]] for m in models], row["n"], axis=1)))
            for g, models in enumerate(groups)]


@dataclass
class Growth:
    """A tree on the way: the nodes whose split is looked for next, their level, and the features that this tree sees."""

    spec: Spec
    tree: Tree
    features: np.ndarray
    open: np.ndarray
    level: int = 0
    leaves: int = 1

    @staticmethod
    def start(spec: Spec, n_features: int, round_: int) -> Growth:
        seen = np.random.default_rng([spec.seed, round_]).permutation(n_features)[:max(1, round(spec.columns * n_features))]
        return Growth(spec, Tree.of_depth(spec.depth), np.sort(seen), np.array([0]))

    def take(self, found: list[tuple]) -> bool:
        """Split the open nodes, the best gains first, while there are leaves left. Whether nodes are open again."""
        spec, tree, opened = self.spec, self.tree, []
        best = dict(zip(self.open.tolist(), found))
        if self.level == 0 and best:
            tree.value[0] = spec.rate * best[0][5] / PARTS / max(best[0][6], 1)
        for node in sorted(best, key=lambda i: (-best[i][0], i)):
            gain, feature, cut, sl, cl, s, c = best[node]
            if gain <= 1e-9 or self.leaves >= spec.leaves:
                break
            self.leaves += 1
            tree.feature[node], tree.cut[node] = self.features[feature], cut
            for child, total, n in ((2 * node + 1, sl, cl), (2 * node + 2, s - sl, c - cl)):
                tree.value[child] = spec.rate * total / PARTS / n
                if n >= 2 * spec.least:
                    opened.append(child)
        self.open, self.level = np.array(sorted(opened), np.int64), self.level + 1
        return bool(opened) and self.level < spec.depth and self.leaves < spec.leaves


def _counted(block: Block, i: int, spec: Spec, round_: int) -> np.ndarray:
    """Rows of a block that a tree counts."""
    seen = ~np.isnan(block.labels[i])
    if spec.rows < 1:
        seen &= np.random.default_rng([spec.seed, round_, block.place[0]]).random(len(seen)) < spec.rows
    return np.flatnonzero(seen)


def _histogram(columns: np.ndarray, growth: Growth, rows: np.ndarray, residual: np.ndarray, at: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """[2, nodes, features, bins]: the sums of residuals and the counts of ``nodes``; ``at`` is the node of each of ``rows``.

    ``columns`` holds a row of bins for each feature: a feature's sums are a few thousand cells, which stay in the cache."""
    slots = np.full(len(growth.tree.feature), -1, np.int64)
    slots[nodes] = np.arange(len(nodes))
    own = np.flatnonzero(slots[at] >= 0)
    rows, residual, first = rows[own], residual[own], slots[at[own]] * BINS
    size = len(nodes) * BINS
    out = np.empty((2, len(nodes), len(growth.features), BINS), np.int64)
    for j, f in enumerate(growth.features.tolist()):
        cells = first + columns[f][rows]
        out[0, :, j] = np.bincount(cells, residual, size).reshape(-1, BINS)
        out[1, :, j] = np.bincount(cells, minlength=size).reshape(-1, BINS)
    return out


def _residual(block: Block, i: int, rows: np.ndarray) -> np.ndarray:
    return np.rint((block.labels[i][rows] - block.predicted[i][rows]) * PARTS)


def _paired(columns: np.ndarray, features: np.ndarray) -> np.ndarray:
    """[pairs of features, rows]: both bins of each pair as one number. An odd last feature goes with bin 0."""
    out = np.empty((-(-len(features) // 2), columns.shape[1]), np.uint16)
    for j, codes in enumerate(out):
        np.multiply(columns[features[2 * j]], np.uint16(BINS), out=codes)
        if 2 * j + 1 < len(features):
            np.add(codes, columns[features[2 * j + 1]], out=codes)
    return out


@dataclass
class Bundle:
    """Features whose bins occur in few combinations: ``codes`` numbers the combination of each row, ``bins`` [features, combinations]
    has what it stands for."""

    features: list[int]
    codes: np.ndarray
    bins: np.ndarray

    def joined(self, other: Bundle) -> Bundle | None:
        """Both bundles as one, if that has at most ``CELLS`` combinations."""
        n, size = other.bins.shape[1], self.bins.shape[1] * other.bins.shape[1]
        if size > 1 << 16:
            return None
        codes = self.codes * np.uint16(n) + other.codes
        seen = np.bincount(codes[:CHUNK], minlength=size) > 0
        if np.count_nonzero(seen) <= CELLS:
            seen = np.bincount(codes, minlength=size) > 0
        cells = np.flatnonzero(seen)
        if len(cells) > CELLS:
            return None
        number = (np.cumsum(seen) - 1).astype(np.uint16)
        return Bundle(self.features + other.features, number[codes], np.concatenate([self.bins[:, cells // n], other.bins[:, cells % n]]))


def _bundles(columns: np.ndarray) -> list[Bundle]:
    """Bundles of three features or more, those with the fewest bins first; what is not in them is better counted in pairs."""
    singles = []
    for f, column in enumerate(columns):
        seen = np.bincount(column, minlength=BINS) > 0
        singles.append(Bundle([f], (np.cumsum(seen) - 1).astype(np.uint16)[column] if seen.sum() < BINS // 2 else column.astype(np.uint16), np.flatnonzero(seen)[None]
                              if seen.sum() < BINS // 2 else np.arange(BINS)[None]))
    out: list[Bundle] = []
    for single in sorted(singles, key=lambda b: b.bins.shape[1]):
        joined = out[-1].joined(single) if out else None
        out[-1:] = [joined] if joined else [*out[-1:], single]
    return [b for b in out if len(b.features) > 2]


def _cells(codes: Iterable[np.ndarray], sizes: Iterable[int], rows: np.ndarray, residual: np.ndarray) -> list[np.ndarray]:
    """For each of ``codes`` [2, size]: the sums of residuals and the counts of ``rows`` by their number."""
    out = [np.zeros((2, size)) for size in sizes]
    for at in range(0, len(rows), CHUNK):
        some = rows[at:at + CHUNK]
        own = residual.take(some, mode="clip")
        for x, sums in zip(codes, out):
            cells = x.take(some, mode="clip").astype(np.int64)  # clip: no row lies outside, and it is the fastest
            sums[0] += np.bincount(cells, own, sums.shape[1])
            sums[1] += np.bincount(cells, minlength=sums.shape[1])
    return out


def _node_histogram(pairs: np.ndarray, n_features: int, rows: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """[2, features, bins]: the sums of residuals and the counts of one node's ``rows``.

    Rows are counted by pairs of bins, two features at a time; sums of whole numbers, so what is added up over the other bin is exact."""
    both = np.array(_cells(pairs, [BINS * BINS] * len(pairs), rows, residual)).reshape(-1, 2, BINS, BINS)
    sums = [np.einsum(f"pkij->kp{axis}", both) for axis in "ij"]
    return np.stack(sums, axis=2).reshape(2, -1, BINS)[:, :n_features].astype(np.int64)


@dataclass
class Coded:
    """How a tree's features are counted: those in bundles by bundle, the others in pairs. Places are those in the tree's features."""

    n_features: int
    rest: np.ndarray
    pairs: np.ndarray
    bundled: list[tuple[Bundle, list[tuple[int, int]]]]

    @staticmethod
    def of(columns: np.ndarray, bundles: list[Bundle], features: np.ndarray) -> Coded:
        place = {f: j for j, f in enumerate(features.tolist())}
        bundled = [(b, seen) for b in bundles if len(seen := [(i, place[f]) for i, f in enumerate(b.features) if f in place]) > 2]
        rest = np.setdiff1d(np.arange(len(features)), [j for _, seen in bundled for _, j in seen])
        return Coded(len(features), rest, _paired(columns, features[rest]), bundled)

    def histogram(self, rows: np.ndarray, residual: np.ndarray) -> np.ndarray:
        out = np.empty((2, self.n_features, BINS), np.int64)
        if len(self.rest):
            out[:, self.rest] = _node_histogram(self.pairs, len(self.rest), rows, residual)
        sums = _cells([b.codes for b, _ in self.bundled], [b.bins.shape[1] for b, _ in self.bundled], rows, residual)
        for (bundle, seen), both in zip(self.bundled, sums):
            for i, j in seen:
                out[:, j] = [np.bincount(bundle.bins[i], x, BINS) for x in both]
        return out


def _dealt(row, order: list[int], n_features: int, label_of: list[int]) -> Iterator[tuple[int, tuple]]:
    """For each model the number of a block, the model, the bins of each feature and the model's labels."""
    columns = np.ascontiguousarray(np.frombuffer(row["bins"], np.uint8).reshape(row["n"], n_features).T)
    labels = np.frombuffer(row["labels"], np.float64).reshape(row["n"], -1)
    for g, m in enumerate(order):
        yield row["block"] * len(order) + g, (row["block"], m, columns, labels[:, label_of[m]].copy())


def _alone(pairs: Iterator[tuple[int, tuple]], specs: list[Spec], starts: list[float]) -> Iterator[tuple[int, list[Tree]]]:
    """All trees of the model whose blocks, of a table of ``ALONE`` at most, are in this task. Each node keeps its rows, those that
    the tree counts and the others. Of two children only the smaller one is summed: the other is the rest of their parent."""
    dealt = sorted((b for _, b in pairs), key=lambda b: b[0])
    if not dealt:
        return
    m = dealt[0][1]
    spec, trees, numbers = specs[m], [], [b[0] for b in dealt]
    before = np.cumsum([0, *(len(b[3]) for b in dealt)]).tolist()
    columns, labels = np.empty((len(dealt[0][2]), before[-1]), np.uint8), np.concatenate([b[3] for b in dealt])
    for at, to in reversed([*zip(before, before[1:])]):
        columns[:, at:to] = dealt.pop()[2]
    predicted = np.full(len(labels), starts[m])
    whole = Block((0, 0), columns, [m], labels[None], predicted[None])
    blocks = [Block((number, 0), columns[:, at:to], [m], labels[None, at:to], predicted[None, at:to]) for number, at, to in zip(numbers, before, before[1:])]
    bundles = _bundles(columns)
    for round_ in range(spec.trees):
        growth = Growth.start(spec, len(columns), round_)
        tree = growth.tree
        rows = np.concatenate([x + _counted(b, 0, spec, round_) for x, b in zip(before, blocks)])
        residual, others = np.zeros(len(labels)), np.ones(len(labels), bool)
        residual[rows], others[rows] = _residual(whole, 0, rows), False
        coded = Coded.of(columns, bundles, growth.features)
        members = {0: (rows, np.flatnonzero(others))}
        known = {0: coded.histogram(rows, residual)}
        while growth.open.size:
            goes_on = growth.take(_best(np.stack([known[n] for n in growth.open.tolist()], axis=1), spec.least))
            opened = {(n - 1) // 2 for n in growth.open.tolist()} if goes_on else set()
            for node in sorted(opened):
                column, cut = columns[tree.feature[node]], tree.cut[node]
                sides = [(x, column.take(x, mode="clip") > cut) for x in members.pop(node)]
                members[2 * node + 1], members[2 * node + 2] = tuple(x.compress(~right) for x, right in sides), tuple(x.compress(right) for x, right in sides)
            if not goes_on:
                break
            following = {}
            for p in sorted(opened):
                small, other = sorted((2 * p + 1, 2 * p + 2), key=lambda n: len(members[n][0]))
                following[small] = coded.histogram(members[small][0], residual)
                following[other] = known[p] - following[small]
            known = {n: following[n] for n in growth.open.tolist()}
        trees.append(tree)
        for node, sides in members.items():
            feature, cut = tree.feature[node], tree.cut[node]
            for x in sides:  # a node whose children were not looked at still has the rows of both
                predicted[x] += tree.value[2 * node + 1 + (columns[feature].take(x, mode="clip") > cut)] if feature >= 0 else tree.value[node]
    yield m, trees


def _best(histogram: np.ndarray, least: int) -> list[tuple]:
    """For each node: (gain, feature, cut, residuals and rows left of it, residuals and rows in all); gain 0 without a split."""
    left = np.cumsum(histogram, axis=3)
    total = left[:, :, :1, -1:]
    (s, c), (sl, cl) = total.astype(np.float64), left.astype(np.float64)
    sr, cr = s - sl, c - cl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sl ** 2 / cl + sr ** 2 / cr - s ** 2 / c
    gain[(cl < max(least, 1)) | (cr < max(least, 1))] = 0
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    out = []
    for i, a in enumerate(at.tolist()):
        feature, cut = divmod(a, BINS)
        out.append((float(flat[i, a]) / PARTS ** 2, feature, cut, int(left[0, i, feature, cut]), int(left[1, i, feature, cut]), int(total[0, i, 0, 0]), int(total[1, i, 0, 0])))
    return out


def _local(pairs: Iterator[tuple[int, Block]], growing: dict[int, Growth], round_: int) -> Iterator[tuple[int, np.ndarray]]:
    """The histogram of each growing model's open nodes, over all blocks of a task."""
    sums: dict[int, np.ndarray] = {}
    for _, block in pairs:
        columns = np.ascontiguousarray(block.bins.T)
        for i, m in enumerate(block.models):
            if m in growing:
                growth = growing[m]
                rows = _counted(block, i, growth.spec, round_)
                h = _histogram(columns, growth, rows, _residual(block, i, rows), growth.tree.nodes(block.bins[rows], growth.level), growth.open)
                sums[m] = sums[m] + h if m in sums else h
    yield from sums.items()


def _split(pair: tuple[int, np.ndarray], specs: list[Spec]) -> tuple[int, list[tuple]]:
    m, histogram = pair
    return m, _best(histogram, specs[m].least)


def _add(pair: tuple[int, Block], trees: dict[int, Tree], specs) -> tuple[int, Block]:
    key, b = pair
    predicted = [p + trees[m].value[trees[m].nodes(b.bins, specs[m].depth)] if m in trees else p for m, p in zip(b.models, b.predicted)]
    return key, Block(b.place, b.bins, b.models, b.labels, np.array(predicted))


def quantile_edges(df: DataFrame, features: list[str], extra: Iterable = ()) -> tuple[list[np.ndarray], tuple]:
    """The distinct quantiles of each feature between its bins, exact, and ``extra`` aggregates of the first pass.

    A mergeable sketch brackets each quantile. A second pass counts the rows of the stretches between brackets and the values inside
    brackets, some 2 % of a table's; the ordered counts of a bracket run on top of the sums of the places before it.
    """
    n = BINS - 1
    places = [min(1.0, max(0.0, i / n + d)) for i in range(1, n) for d in (-SLACK, SLACK)]
    clean = [F.when(~F.isnan(c), c) for c in _doubles(df, features)]
    row = df.agg(*[F.percentile_approx(c, places, SKETCH) for c in clean], *extra).first()
    marks = [np.array(row[i] or [], np.float64) for i in range(len(features))]
    if not any(map(len, marks)):
        return marks, tuple(row)[len(features):]
    counted = _place_counts(df, features, marks).groupBy("feature", "place", "value").agg(F.sum("n").alias("n"))
    counted = written(counted, "quantile-places")
    ahead = Window.partitionBy("feature").orderBy("place").rowsBetween(*BEFORE)
    of_places = counted.groupBy("feature", "place").agg(F.sum("n").alias("_n")).withColumns(
        {"_before": F.coalesce(F.sum("_n").over(ahead), F.lit(0)), "_total": F.sum("_n").over(Window.partitionBy("feature"))}).drop("_n")
    upto = F.sum("n").over(Window.partitionBy("feature", "place").orderBy("value").rowsBetween(*UP_TO)) + F.col("_before")
    # The i-th of the n - 1 quantiles is the first value with i / n of the rows up to it.
    found = counted.join(of_places, ["feature", "place"]).where("value IS NOT NULL").withColumn("_upto", upto).where(
        f"{n} * _upto DIV _total > {n} * (_upto - n) DIV _total AND {n} * (_upto - n) DIV _total < {n - 1}")
    edges: list[list[float]] = [[] for _ in features]
    for r in found.select("feature", "value").collect():  # at most n - 1 a feature
        edges[r["feature"]].append(r["value"])
    return [np.array(sorted(e), np.float64) for e in edges], tuple(row)[len(features):]


def _place_counts(df: DataFrame, features: list[str], marks: list[np.ndarray]) -> DataFrame:
    """(feature, place, value, n): rows of each feature by their place between the ends of brackets, in pairs in ``marks``. Odd places
    are the ends themselves, even ones lie between; a place in no bracket has no values, only its rows."""
    ends = [np.unique(m) for m in marks]
    inside = []
    for m, e in zip(marks, ends):
        cover = np.zeros(2 * len(e) + 1, bool)
        for lo, hi in zip(np.searchsorted(e, m[::2]).tolist(), np.searchsorted(e, m[1::2]).tolist()):
            cover[2 * lo + 1:2 * hi + 2] = True
        inside.append(cover)

    def run(batches):
        for batch in batches:
            for f, x in enumerate(_arrays(batch, range(len(ends)))):
                x = x[~np.isnan(x)]
                if not len(x):
                    continue
                left = np.searchsorted(ends[f], x, side="left")
                place = 2 * left + (left < len(ends[f])) * (ends[f][np.minimum(left, len(ends[f]) - 1)] == x)
                own = inside[f][place]
                n_at = np.bincount(place[~own], minlength=0)
                out = np.flatnonzero(n_at)
                # A value lies in one place: sorted values have sorted places.
                values, first, n = np.unique(x[own], return_index=True, return_counts=True)
                places = np.r_[out, place[own][first]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(places), f, np.int32)), pa.array(places.astype(np.int32)),
                    pa.array([*[None] * len(out), *values.tolist()], pa.float64()), pa.array(np.r_[n_at[out], n].astype(np.int64))],
                    ["feature", "place", "value", "n"])

    inputs = [c.alias(f"c{i}") for i, c in enumerate(_doubles(df, features))]
    return df.select(*inputs).mapInArrow(run, "feature int, place int, value double, n long")


def fit(train: DataFrame, features: list[str], specs: list[Spec]) -> list[Model]:
    """A model for each of ``specs``, all grown together. Rows whose label is null or NaN do not count for that model.

    Each tree starts from the residuals of those before it; a level's best splits are taken by gain until the tree has
    its leaves. The blocks are written once below the shared folder, so a lost executor reads its blocks again; what they
    predict is checkpointed every few trees. Same table, same specs, same models.
    """
    spark = train.sparkSession
    context = spark.sparkContext
    importable(spark)
    labels = sorted({s.label for s in specs})
    edges, (n_rows, *starts) = quantile_edges(train, features, [F.count("*"), *[F.avg(F.when(~F.isnan(c), c)) for c in _doubles(train, labels)]])
    start_of = dict(zip(labels, [x or 0.0 for x in starts]))
    models = [Model(s, list(features), edges, start_of[s.label]) for s in specs]
    if not n_rows or not features:
        return models

    packed = _packed(train.coalesce(-(-n_rows // BLOCK)), features, edges, labels)
    n_blocks = packed.count()
    label_of = [labels.index(s.label) for s in specs]
    unpack = partial(_unpack, n_features=len(features), label_of=label_of, starts=[m.start for m in models])
    if n_blocks <= ALONE:
        order = sorted(range(len(specs)), key=lambda m: -specs[m].trees * specs[m].depth)  # the longest tasks begin first
        dealt = packed.rdd.flatMap(partial(_dealt, order=order, n_features=len(features), label_of=label_of)).partitionBy(len(order), operator.index)
        for m, trees in dealt.mapPartitions(partial(_alone, specs=specs, starts=[m.start for m in models])).collect():
            models[m].trees = trees
        return models
    parts = max(1, min(n_blocks, context.defaultParallelism * -(-n_blocks // (16 * context.defaultParallelism))))
    state = packed.rdd.flatMap(partial(unpack, groups=[list(range(len(specs)))])).partitionBy(parts, operator.index).persist(StorageLevel.MEMORY_AND_DISK)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    before = None
    try:
        for round_ in range(max(s.trees for s in specs)):
            trees = _grow_round(state, models, round_, parts)
            if before is not None:
                before.unpersist()
            before, state = state, state.map(partial(_add, trees=trees, specs=specs), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
            if (round_ + 1) % CHECKPOINT == 0:
                state.checkpoint()
    finally:
        for rdd in (before, state):
            if rdd is not None:
                rdd.unpersist()
    return models


def _packed(df: DataFrame, features: list[str], edges: list[np.ndarray], labels: list[str]) -> DataFrame:
    """A row for each block: its number, rows, bins and labels as bytes."""
    n_features = len(features)

    def run(batches):
        held, size = [], 0

        def block():
            bins, y = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([len(bins)], pa.int32()), pa.array([bins.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["n", "bins", "labels"])

        for batch in batches:
            if batch.num_rows:
                x, y = _arrays(batch, range(n_features)), _arrays(batch, range(n_features, batch.num_columns))
                held.append((binned(x, edges), np.stack(y, axis=1)))
                size += batch.num_rows
            if size >= BLOCK:
                yield block()
                held, size = [], 0
        if size:
            yield block()

    named = [c.alias(f"c{i}") for i, c in enumerate(_doubles(df, [*features, *labels]))]
    blocks = df.select(*named).mapInArrow(run, "n int, bins binary, labels binary")
    made = written(blocks.withColumn("id", F.monotonically_increasing_id()), "boosting-blocks")
    ids = [r[0] for r in made.select("id").orderBy("id").collect()]  # a number a block
    numbers = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids)], "id long, block int")
    return made.join(F.broadcast(numbers), "id").select("block", "n", "bins", "labels")


def _grow_round(state: RDD, models: list[Model], round_: int, parts: int) -> dict[int, Tree]:
    """The next tree of every model that is not finished, by one pass a level."""
    specs = [m.spec for m in models]
    growing = {m: Growth.start(s, len(models[m].features), round_) for m, s in enumerate(specs) if round_ < s.trees}
    trees = {m: g.tree for m, g in growing.items()}
    while growing:
        sums = state.mapPartitions(partial(_local, growing=growing, round_=round_)).reduceByKey(operator.add, min(parts, len(growing)))
        found = dict(sums.map(partial(_split, specs=specs)).collect())
        growing = {m: g for m, g in growing.items() if g.take(found.get(m, []))}
    for m, tree in trees.items():
        models[m].trees.append(tree)
    return trees


def score(df: DataFrame, models: dict[str, Model]) -> DataFrame:
    """``df`` plus a column for each model: rows are binned once, then every model walks its trees. Models must share their features."""
    importable(df.sparkSession)
    first = next(iter(models.values()))
    if any(m.features != first.features or any(not np.array_equal(a, b) for a, b in zip(m.edges, first.edges)) for m in models.values()):
        raise ValueError("models of one table only")
    kept, n, shared = df.columns, len(first.features), df.sparkSession.sparkContext.broadcast(list(models.values()))
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name in models)])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bins = binned(_arrays(batch, range(len(kept), len(kept) + n)), first.edges)
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *(pa.array(m.predict(bins)) for m in shared.value)], schema.names)

    inputs = [c.alias(f"__feature{i}") for i, c in enumerate(_doubles(df, first.features))]
    return df.select(*[F.col(f"`{c}`") for c in kept], *inputs).mapInArrow(run, schema)


def staged_errors(df: DataFrame, models: list[Model]) -> DataFrame:
    """(model, trees, n, sse, sst) on ``df`` after every tree of every model, from one scoring of each row."""
    importable(df.sparkSession)
    first, labels = models[0], [m.spec.label for m in models]
    n, shared = len(first.features), df.sparkSession.sparkContext.broadcast(models)
    names = ["model", "trees", "n", "sse", "sum", "squares"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = binned(_arrays(batch, range(n)), first.edges)
            for m, model in enumerate(shared.value):
                y = _arrays(batch, range(n + m, n + m + 1))[0]
                own = ~np.isnan(y)
                errors = [float(((y[own] - p[own]) ** 2).sum()) for p in model.staged(bins)]
                size = len(errors)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(size, m, np.int32)), pa.array(np.arange(1, size + 1, dtype=np.int32)), pa.array(np.full(size, own.sum(), np.int64)), pa.array(errors, pa.float64()),
                    pa.array(np.full(size, y[own].sum())), pa.array(np.full(size, (y[own] ** 2).sum()))], names)

    inputs = [c.alias(f"c{i}") for i, c in enumerate(_doubles(df, [*first.features, *labels]))]
    parts = df.select(*inputs).mapInArrow(run, "model int, trees int, n long, sse double, sum double, squares double")
    total = parts.groupBy("model", "trees").agg(*[F.sum(c).alias(c) for c in names[2:]])
    return total.select("model", "trees", "n", "sse", (F.col("squares") - F.col("sum") * F.col("sum") / F.col("n")).alias("sst"))


def first_splits(models: dict[str, Model], spark: SparkSession) -> DataFrame:
    """(model, feature, bin, cut): the root of each model's first tree; bins up to ``bin`` go left, values up to ``cut``."""
    rows = []
    for name, m in models.items():
        if m.trees and m.trees[0].feature[0] >= 0:
            feature, cut = int(m.trees[0].feature[0]), int(m.trees[0].cut[0])
            rows.append((name, m.features[feature], cut, float(m.edges[feature][cut - 1]) if cut else None))
    return spark.createDataFrame(rows, "model string, feature string, bin int, cut double")
