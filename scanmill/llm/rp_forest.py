"""Near-duplicate vectors by a forest of random-projection trees.

Each tree cuts the space by one random direction per level; a node's threshold is the median of a bounded sample (the level's
median where the sample is thin). A vector lies in its own leaf and, where it is near a cut, also in the leaf on the other
side of its nearest cut. Vectors are compared with all others of their leaf and label; many trees make it unlikely that
a close pair never shares a leaf. The depth grows with the logarithm of the label's vectors.

Medians of a node that a dense group fills would cut the group again and again. So dense groups are taken out first: round
each centre found in the sample lie the group's members, and all vectors that can link with one of them lie in the group's
cell, which is wider by the angle of the threshold. Members are compared with their whole cell, so none of their links is
lost; all other pairs are left to the trees. A leaf or cell of any size is compared in units of `UNIT` by `UNIT` vectors, by many tasks.

A pair is counted in the first tree and leaf that it shares, so counts are exact for the pairs found, and each unit writes
one row per linked vector, not its pairs. Equal vectors are compared once and counted by their number.

Defined cases: vectors that are null, empty or zero or hold null or non-finite numbers, and vectors with null label, link with nothing;
vectors of different lengths are not compared; rows that share an id count as different vectors with one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanmill.llm.components import components
from scanmill.llm.dealt import runs
from scanmill.session import stored

TREES, LEAF, UNIT, LEVELS = 12, 256, 2048, 30
#: Rows the thresholds are fitted on: those with the smallest hashes of their vectors.
SAMPLE = 20_000
#: Links with others of the sample from which a vector is in a dense group; a group that moves medians has more.
DENSE = 16


@dataclass
class Forest:
    """Trees for vectors of one length, fitted on unit vectors."""

    directions: np.ndarray  # length x (trees * levels)
    medians: np.ndarray  # trees x levels
    nodes: list[list[np.ndarray]] = field(default_factory=list)  # by tree and level, thresholds of the nodes
    width: np.ndarray = field(default_factory=lambda: np.zeros(0))  # trees x levels: the band that spills

    @staticmethod
    def fit(sample: np.ndarray, spill: float = 0.25, thin: int = 40, seed: int = 11) -> Forest:
        length = sample.shape[1]
        directions = np.random.default_rng([seed, length]).standard_normal((length, TREES * LEVELS))
        seen = (sample @ directions).reshape(len(sample), TREES, LEVELS)
        medians = np.median(seen, axis=0) if len(sample) else np.zeros((TREES, LEVELS))
        width = np.quantile(np.abs(seen - medians), spill, axis=0) if len(sample) else np.zeros((TREES, LEVELS))
        forest = Forest(directions, medians, [], width)
        for t in range(TREES):
            node, levels = np.zeros(len(sample), np.int64), []
            for level in range(LEVELS):
                if len(sample) < thin << level:
                    break
                cut = np.full(1 << level, medians[t, level])
                for v in np.unique(node):
                    inside = seen[node == v, t, level]
                    if len(inside) >= thin:
                        cut[v] = np.median(inside)
                levels.append(cut)
                node = node * 2 + (seen[:, t, level] > cut[node])
            forest.nodes.append(levels)
        return forest

    def leaves(self, unit: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """vectors x trees x 2 leaf numbers; the second is -1 unless the vector is near a cut."""
        seen = (unit @ self.directions).reshape(len(unit), TREES, LEVELS)
        out = np.full((len(unit), TREES, 2), -1, np.int32)
        for t in range(TREES):
            first, gap = self._descend(t, seen[:, t], depth, None)
            out[:, t, 0] = first
            flip = gap.argmin(1)
            other, _ = self._descend(t, seen[:, t], depth, flip)
            near = (gap.min(1) < 1) & (other != first)
            out[near, t, 1] = other[near]
        return out

    def _descend(self, t: int, seen: np.ndarray, depth: np.ndarray, flip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        node, gap = np.zeros(len(seen), np.int64), np.full((len(seen), LEVELS), np.inf)
        for level in range(int(depth.max(initial=0))):
            cut = self.nodes[t][level][node] if level < len(self.nodes[t]) else self.medians[t, level]
            away = seen[:, level] - cut
            side = (away > 0) != (flip == level) if flip is not None else away > 0
            on = level < depth
            node = np.where(on, node * 2 + side, node)
            gap[on, level] = np.abs(away[on]) / max(self.width[t, level], 1e-12)
        return node.astype(np.int32), gap


@dataclass
class Groups:
    """Dense groups of vectors of one length: members lie within `inner` of a centre, all that they can link with within `outer` (cosines)."""

    centres: np.ndarray  # groups x length
    inner: np.ndarray
    outer: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, threshold: float, dense: int = DENSE) -> Groups:
        def links(some: np.ndarray) -> np.ndarray:
            parts = [(sample[k : k + 512] @ some.T >= threshold).sum(1) for k in range(0, len(sample), 512)]
            return np.concatenate(parts) if parts else np.zeros(0, np.int64)

        reach, free, count = np.arccos(threshold), np.ones(len(sample), bool), links(sample) - 1
        centres, radii = [], []
        while len(sample):
            top = int(np.where(free, count, -1).argmax())
            if not free[top] or count[top] < dense:
                break
            near = free & (sample @ sample[top] >= threshold)
            near[top] = True
            centre = _unit(sample[near].mean(0, keepdims=True))[0]
            away = np.arccos(np.clip(sample @ centre, -1, 1))
            radius = float(np.clip(1.1 * np.quantile(away[near], 0.99), reach / 2, 1.25 * reach))
            inside = free & (away <= radius)
            inside[top] = True
            centres.append(centre)
            radii.append(radius)
            free &= ~inside
            count = count - links(sample[inside])
        r = np.array(radii, np.float64)
        return Groups(np.array(centres).reshape(-1, sample.shape[1]), np.cos(r), np.cos(np.minimum(r + reach + 1e-6, np.pi)))

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each vector (-1: none), and vectors x groups: whether it stands in the cell, where no earlier group has it as a member."""
        if not len(self.centres):
            return np.full(len(unit), -1, np.int32), np.zeros((len(unit), 0), bool)
        seen = unit @ self.centres.T
        member = seen >= self.inner
        home = np.where(member.any(1), member.argmax(1), -1).astype(np.int32)
        return home, (seen >= self.outer) & ((home < 0)[:, None] | (np.arange(len(self.centres)) <= home[:, None]))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link, as (vec_id, label, embedding, h1, h2); equal vectors of a label have equal hashes."""
    sound = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    return vectors.select("vec_id", "label", "embedding").where(f"vec_id is not null and label is not null and embedding is not null and {sound}").withColumns(
        {"h1": F.xxhash64(F.lit(1), "label", "embedding"), "h2": F.xxhash64(F.lit(2), "embedding", "label")}
    )


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_forests(points: DataFrame, threshold: float, sample: int = SAMPLE) -> dict[int, tuple[Groups, Forest]]:
    rows = points.orderBy("h1", "h2").limit(sample).select("embedding").toArrow().column("embedding").to_pylist()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r), []).append(r)
    out = {}
    for n, x in by.items():
        unit = _unit(np.array(x, np.float64))
        groups = Groups.fit(unit, threshold)
        out[n] = groups, Forest.fit(unit[groups.place(unit)[0] < 0])
    return out


def neighbours(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    every = vectors.select("vec_id", "label", "embedding")
    sound = usable(every)
    folded = sound.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    points = stored(folded)
    sized = points.withColumn("length", F.size("embedding"))
    fitted = spark.sparkContext.broadcast(fit_forests(points, threshold))

    def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray, Groups, Forest]]]]:
        unknown: dict[int, tuple[Groups, Forest]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                lengths, found = part.column("length").to_numpy(), []
                for n in np.unique(lengths).tolist():
                    if n not in fitted.value and n not in unknown:
                        none = np.zeros((0, n))
                        unknown[n] = Groups.fit(none, threshold), Forest.fit(none)
                    at = np.flatnonzero(lengths == n)
                    found.append((at, _unit(_matrix(part.column("embedding").take(pa.array(at)), n)), *(fitted.value.get(n) or unknown[n])))
                yield part, found

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in by_length(batches):
            out = np.zeros(part.num_rows, np.int64)
            for at, x, groups, _ in found:
                out[at] = groups.place(x)[0] < 0
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("length"), pa.array(out)], names=["label", "length", "free"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in by_length(batches):
            codes = np.full((part.num_rows, TREES * 2), -1, np.int32)
            home, cells = np.full(part.num_rows, -1, np.int32), [np.zeros(0, np.int32)] * part.num_rows
            for at, x, groups, forest in found:
                home[at], inside = groups.place(x)
                alone = home[at] < 0
                codes[at[alone]] = forest.leaves(x[alone], part.column("depth").to_numpy()[at[alone]]).reshape(int(alone.sum()), -1)
                for k in np.flatnonzero(inside.any(1)):
                    cells[at[k]] = np.flatnonzero(inside[k]).astype(np.int32)
            ends = np.cumsum([0, *map(len, cells)], dtype=np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), TREES * 2).cast(pa.list_(pa.int32()))
            more = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *cells])))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(home), lists, more], names=[*names, "home", "codes", "cells"])

    names = ["label", "length", "id", "copies", "embedding"]
    kind = dict(points.dtypes)
    many = sized.select("label", "length", "embedding").mapInArrow(free, f"label {kind['label']}, length int, free long").groupBy("label", "length").agg(F.sum("free").alias("n"))
    depth = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF)))).cast("int")
    deep = sized.join(many.select("label", "length", depth.alias("depth")), ["label", "length"])
    schema = f"label {kind['label']}, length int, id long, copies long, embedding {kind['embedding']}, home int, codes array<int>, cells array<int>"
    placed = stored(deep.select(*names, "depth").mapInArrow(place, schema))
    # Slots: the leaves of the trees, then the cells, which count as leaves of one more tree.
    at = placed.select("*", F.posexplode(F.concat("codes", "cells")).alias("slot", "leaf")).where("leaf >= 0").drop("cells")
    at = at.withColumn("tree", F.least(F.expr("cast(slot div 2 as int)"), F.lit(TREES))).withColumn("inner", F.expr(f"tree < {TREES} or home = leaf"))
    key = ["label", "length", "tree", "leaf"]
    blocks = lambda n: F.ceil(n / UNIT).cast("int")
    sizes = at.groupBy(*key).agg(F.count_if("inner").alias("n_inner"), F.count("*").alias("n")).where("n > 1 and n_inner > 0")
    sizes = sizes.select(*key, blocks(F.col("n_inner")).alias("blocks"), blocks(F.col("n") - F.col("n_inner")).alias("outer"))
    # Members come in the first blocks and meet all; the others of a cell meet members only.
    block = "cast(if(inner, pmod(xxhash64(id), blocks), blocks + pmod(xxhash64(id), greatest(outer, 1))) as int)"
    rows = at.join(sizes, key).withColumn("block", F.expr(block))
    rows = rows.withColumn("other", F.expr("explode(sequence(0, if(inner, blocks + outer, blocks) - 1))"))
    units = rows.select(*key, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") <= F.col("other")).alias("left"), "id", "copies", "embedding", "home", "codes")
    unit_key = [*key, "x", "y"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, unit_key):
            yield _links(rows, threshold)

    dealt = units.repartition(*unit_key).sortWithinPartitions(*unit_key)
    found = stored(dealt.mapInArrow(compare, "id long, n long, low long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    whole = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    groups = points.join(counts, "id", "left").join(whole, F.col("id") == F.col("node"), "left")
    groups = groups.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = sound.select("vec_id", "h1", "h2").join(groups, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    flat = "coalesce(vec_id is null or label is null or embedding is null or not ({}), true)"
    rest = every.where(flat.format("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"))
    out = linked.unionAll(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(rows: pa.Table, threshold: float) -> pa.RecordBatch:
    """For each vector of a unit that has links first met here: how many vectors, and the smallest id of its local group."""
    ids, copies = rows.column("id").to_numpy(), rows.column("copies").to_numpy()
    length, tree, leaf = (rows.column(c)[0].as_py() for c in ("length", "tree", "leaf"))
    x = _unit(_matrix(rows.column("embedding").combine_chunks(), length))
    codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), TREES, 2)
    same = rows.column("x")[0].as_py() == rows.column("y")[0].as_py()
    left = rows.column("left").to_numpy()
    one, two = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
    home = rows.column("home").to_numpy()
    n, group = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for start in range(0, len(one), 256):
        part = one[start : start + 256]
        hit = x[part] @ x[two].T >= threshold
        hit &= ids[part][:, None] < ids[two] if same else ids[part][:, None] != ids[two]
        if tree == TREES:  # a pair counts in the first cell that has one of the two as a member
            hit &= (home[part] == leaf)[:, None] | (home[two] == leaf)
        else:
            a, b = np.nonzero(hit)
            i, j = part[a], two[b]
            keep = np.ones(len(i), bool)
            for t in range(tree + 1):  # met before: in an earlier tree, or in a smaller leaf of this one
                for p in (0, 1):
                    for q in (0, 1):
                        met = (codes[i, t, p] == codes[j, t, q]) & (codes[i, t, p] >= 0)
                        keep &= ~(met & (t < tree)) & ~(met & (codes[i, t, p] < leaf))
            hit[a[~keep], b[~keep]] = False
        pairs = hit.astype(np.float64)
        n[part] += (pairs @ copies[two].astype(np.float64)).astype(np.int64)
        n[two] += (copies[part].astype(np.float64) @ pairs).astype(np.int64)
        for k in np.flatnonzero(hit.any(1)):
            met = group[two[hit[k]]]
            if (met != group[part[k]]).any():
                group[np.isin(group, np.append(met, group[part[k]]))] = group[part[k]]
    at = np.flatnonzero(n)
    lowest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(lowest, group, ids)
    low = lowest[group[at]]
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at]), pa.array(low)], names=["id", "n", "low"])
