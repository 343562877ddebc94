"""Exact n-gram Jaccard join with count vectors in R-trees.

Hashed n-grams fall into groups, and a set becomes the point of its group counts. Two sets cannot share more than the sum
of the smaller counts, and no set below an R-tree node can share more with a query than the sum of the minima of its
counts and the node's largest counts; only pairs that pass this bound are verified on the sets themselves.

How the join is spread: sets that are equal are one point. Sets with Jaccard at least t share one of the first
n - ceil(t n) + 1 n-grams in any common order, so points meet by those; the order takes rare n-grams first, by a table of
counts over all documents in a fixed number of cells. A pair is looked at where it meets first: two sets whose n-grams before
a shared one are equal too have met there, and from their first shared n-gram on they share at most what is left of either.
Keys at which no pair meets first or has enough left go no further. Among the points that meet, an R-tree is searched in units of at most
`UNIT` by `UNIT` points, so a frequent n-gram is shared by many tasks. First the pairs with the largest bounds that would
join points into one tree are verified, at most one per point; then all pairs that pass the bound and are not yet in one
component. No pair that could change a component is left out, and pairs inside a component are not written.

Defined cases: a null or blank text has an empty set and links with nothing (its component is its own id); rows that share an
id are one document, which links by each of its texts; a row with a null id gets the component of the documents with the
same set, or null where there is none; n-grams are compared by 64-bit hashes, sets by 128-bit hashes. Only `doc_id` and `text`
are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanmill.llm.components import components
from scanmill.llm.words import hashes, pieces, split
from scanmill.session import stored

#: Cells of the count table (a byte each when sent), groups of a point, points on one side of a unit of work, points of a leaf.
CELLS, GROUPS, UNIT, LEAF = 1 << 23, 256, 2048, 32
#: Ids (8 bytes each) up to which the documents to verify are found by a broadcast.
SMALL_IDS = 1_000_000


def grams(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its n-grams; with fewer words, of all its words as one."""
    found = split(batch.column("text"), lower=True)
    word = hashes(found.words)[found.codes] if len(found.words) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        mixed = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for k in range(n):
            mixed = (mixed ^ word[k : len(word) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    out = []
    for a, b in zip(found.start[:-1], found.start[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(mixed[a : b - n + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(word[a:b].tobytes(), seed=int(b - a))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def cell_ranks(docs: DataFrame, n: int) -> np.ndarray:
    """For each cell a byte that grows with the logarithm of the n-grams of all documents in it; CELLS bytes, however large the input.

    A task sends its counts in parts, deflated: cells are many, so most counts are small.
    """
    parts = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in pieces(batches):
            cells, times = np.unique((np.concatenate(grams(batch, n)) % np.uint64(CELLS)).astype(np.int64), return_counts=True)
            total[cells] += times
        if total.any():
            for k, part in enumerate(np.split(total, parts)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_deflate(part)], pa.binary())], names=["part", "counts"])

    def add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS // parts, np.int64)
        for pdf in rows:
            for x in pdf["counts"]:
                total += _inflate(x)
        # steps of a sixth of a doubling, fine enough to tell a rare n-gram's cell from a frequent one's
        ranks = np.minimum(255, np.round(6 * np.log2(total + 1))).astype(np.uint8)
        yield pd.DataFrame({"part": [key[0]], "ranks": [ranks.tobytes()]})

    counted = docs.select("text").mapInArrow(count, "part int, counts binary")
    out = np.zeros((parts, CELLS // parts), np.uint8)
    for r in counted.groupBy("part").applyInPandas(add, "part int, ranks binary").collect():
        out[r["part"]] = np.frombuffer(r["ranks"], np.uint8)
    return out.ravel()


def _deflate(counts: np.ndarray) -> bytes:
    kind = np.uint8 if counts.max() < 256 else np.uint32 if counts.max() < 1 << 32 else np.int64
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _inflate(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), {1: np.uint8, 4: np.uint32, 8: np.int64}[data[0]])


def points(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(doc_id, sid, n_grams, keys, point): the hash of the set, its size, the n-grams it meets others by, its group counts."""
    ranks = docs.sparkSession.sparkContext.broadcast(cell_ranks(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sid, size, keys, point = [], [], [], []
            for g in grams(batch, n):
                sid.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                size.append(len(g))
                first = len(g) - -(-threshold.numerator * len(g) // threshold.denominator) + 1 if len(g) else 0
                order = np.lexsort((g, ranks.value[(g % np.uint64(CELLS)).astype(np.int64)]))[:first]
                keys.append(g[order].astype(np.int64))
                point.append(np.bincount((g >> np.uint64(56)).astype(np.int64), minlength=GROUPS).astype(np.int32))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sid, pa.binary()),
                    pa.array(size, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))),
                    pa.array([_pack(p) for p in point], pa.binary()),
                ],
                names=["doc_id", "sid", "n_grams", "keys", "point"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sid binary, n_grams long, keys array<long>, point binary")


def _pack(counts: np.ndarray) -> bytes:
    """A byte per group where all counts fit, else four."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int32).tobytes()


def _unpack(packed: list[bytes]) -> np.ndarray:
    if all(len(p) == GROUPS for p in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(-1, GROUPS)
    return np.stack([np.frombuffer(p, np.uint8 if len(p) == GROUPS else np.int32) for p in packed]).astype(np.int32)


def _needed(a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """Least overlap of sets of sizes a and b with Jaccard at least t."""
    return -(-t.numerator * (a + b) // (t.numerator + t.denominator))


class RTree:
    """A packed R-tree of two levels over points in order of set size and main counts; nodes hold the largest counts."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((*counts[:, :2].T, sizes))
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        starts = np.arange(0, len(sizes), LEAF)
        self.starts, self.highest = starts, np.maximum.reduceat(self.counts, starts, axis=0)
        self.least, self.most = self.sizes[starts], np.maximum.reduceat(self.sizes, starts)

    def search(self, count: np.ndarray, size: int, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the points whose overlap bound allows Jaccard t, and the bounds."""
        fits = (self.most * t.denominator >= size * t.numerator) & (self.least * t.numerator <= size * t.denominator)
        leaves = np.flatnonzero(fits)
        if len(leaves):
            bound = np.minimum(self.highest[leaves], count).sum(1, dtype=np.int64)
            leaves = leaves[bound >= _needed(np.maximum(self.least[leaves], -(-size * t.numerator // t.denominator)), size, t)]
        if not len(leaves):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = (self.starts[leaves][:, None] + np.arange(LEAF)).ravel()
        at = at[at < len(self.sizes)]
        bound = np.minimum(self.counts[at], count).sum(1, dtype=np.int64)
        ok = bound >= _needed(self.sizes[at], size, t)
        return self.order[at[ok]], bound[ok]


def _forest(a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Numbers of the pairs that make a forest, those with the largest share of bound first."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    used = []
    for i in np.lexsort((b, a, -bound)):
        x, y = root(int(a[i])), root(int(b[i]))
        if x != y:
            parent[x] = y
            used.append(i)
    return np.array(used, np.int64)


def _unit_pairs(
    ids: np.ndarray, label: np.ndarray, size: np.ndarray, count: np.ndarray, rest: np.ndarray, prev: np.ndarray, left: np.ndarray, same: bool, t: Fraction, forest: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one unit that meet here first, pass the bound and have two labels: within its points, or between its left and right ones."""
    one, two = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
    if not len(one) or not len(two):
        return ids[:0], ids[:0]
    tree = RTree(count[two], size[two])
    a, b, bounds = [], [], []
    for i in one:
        found, bound = tree.search(count[i], int(size[i]), t)
        j = two[found]
        ok = (label[j] != label[i]) & ((j > i) if same else True)
        ok &= (prev[j] != prev[i]) & (np.minimum(rest[j], rest[i]) >= _needed(size[j], size[i], t))
        if ok.any():
            j, bound = j[ok], bound[ok]
            a.append(np.full(len(j), i))
            b.append(j)
            bounds.append(bound / (size[j] + size[i]))
    if not a:
        return ids[:0], ids[:0]
    x, y, bound = np.concatenate(a), np.concatenate(b), np.concatenate(bounds)
    if forest:
        use = _forest(label[x], label[y], bound)
        x, y = x[use], y[use]
    return ids[x], ids[y]


def _meetings(reps: DataFrame, t: Fraction) -> DataFrame:
    """(key, id, n_grams, rest, prev): keys at which two points meet first, and of their points those with enough n-grams left.

    `rest` counts the n-grams of the set from the key on, `prev` is the n-gram before it; the first has its id there. Where all
    have one `prev`, all have met before. With a set of b n-grams, a set of a shares its first n-gram at a key only if both
    have t (a + b) / (1 + t) n-grams left.
    """
    keyed = reps.select(F.col("doc_id").alias("id"), "n_grams", "keys", F.posexplode("keys").alias("pos", "key"))
    prev = F.coalesce(F.get("keys", F.col("pos") - 1), F.col("id"))
    keyed = keyed.select("key", "id", "n_grams", (F.col("n_grams") - F.col("pos")).alias("rest"), prev.alias("prev"))
    room = (t.numerator + t.denominator) * F.col("rest") - t.numerator * F.col("n_grams")
    each = Window.partitionBy("key")
    seen = keyed.withColumns({
        "_lo": F.min("prev").over(each), "_hi": F.max("prev").over(each), "_room": F.max(room).over(each), "_least": F.min("n_grams").over(each),
    })
    enough = (F.col("_room") >= t.numerator * F.col("n_grams")) & (room >= t.numerator * F.col("_least"))
    return seen.where((F.col("_lo") < F.col("_hi")) & enough).select(*keyed.columns)


def _candidates(meet: DataFrame, points: DataFrame, labels: DataFrame | None, t: Fraction, forest: bool) -> DataFrame:
    """Distinct pairs (a, b) of points that share a key, have two labels and pass the bounds."""
    if labels is None:
        labelled = meet.withColumn("label", F.col("id"))
    else:
        labelled = meet.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    # keys at which two labels meet, and how many units their points need
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", F.ceil(F.col("n") / UNIT).cast("int").alias("blocks"))
    rows = labelled.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = rows.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") <= F.col("other")).alias("left"), "id", "label", "n_grams", "rest", "prev")
    units = units.join(points.select(F.col("doc_id").alias("id"), "n_grams", "point"), ["id", "n_grams"])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        names = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = table.schema
            table = table if rest is None else pa.concat_tables([rest, table])
            mark = np.stack([table.column(c).to_numpy() for c in ("key", "x", "y")])
            ends = np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(0)) + 1
            if not len(ends):
                rest = table
                continue
            yield from solve(table.slice(0, ends[-1]), np.concatenate([[0], ends]))
            rest = table.slice(ends[-1])
        if names is not None and rest is not None:
            yield from solve(rest, np.array([0, rest.num_rows]))

    def solve(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, label, size, left_over, prev, x, y = (table.column(c).to_numpy() for c in ("id", "label", "n_grams", "rest", "prev", "x", "y"))
        left = table.column("left").to_numpy()
        packed = table.column("point").to_pylist()
        a, b = [], []
        length = np.diff(ends)
        two = ends[:-1][length == 2]  # most units: one pair, without a tree
        two = two[(label[two] != label[two + 1]) & (prev[two] != prev[two + 1])]
        two = two[np.minimum(left_over[two], left_over[two + 1]) >= _needed(size[two], size[two + 1], t)]
        for part in np.array_split(two, len(two) // 4096 + 1):
            if len(part):
                p, q = _unpack([packed[i] for i in part]), _unpack([packed[i + 1] for i in part])
                ok = np.minimum(p, q).sum(1, dtype=np.int64) >= _needed(size[part], size[part + 1], t)
                a.append(ids[part[ok]])
                b.append(ids[part[ok] + 1])
        for start, n in zip(ends[:-1][length > 2], length[length > 2], strict=True):
            s = slice(start, start + n)
            i, j = _unit_pairs(ids[s], label[s], size[s], _unpack(packed[s]), left_over[s], prev[s], left[s], bool(x[start] == y[start]), t, forest)
            a.append(i)
            b.append(j)
        if a and sum(map(len, a)):
            p, q = np.concatenate(a), np.concatenate(b)
            pairs = pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)}).drop_duplicates()
            yield pa.RecordBatch.from_pandas(pairs, schema=schema, preserve_index=False)

    dealt = units.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, n: int, t: Fraction) -> DataFrame:
    """The pairs whose sets have Jaccard at least t, on the n-grams of the two whole texts."""
    pairs = stored(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = stored(ids)
    if ids.count() <= SMALL_IDS:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [g.astype(np.int64) for g in grams(batch, n)]
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["id", "grams"])

    sets = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(run, "id long, grams array<long>")
    sets = stored(sets)
    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    shared = both.select("a", "b", (F.size("ga") + F.size("gb")).alias("total"), F.size(F.array_intersect("ga", "gb")).alias("shared"))
    return shared.where(f"{t.denominator} * shared >= {t.numerator} * (total - shared)").select("a", "b")


def join(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """One row per row of `docs`: (doc_id, n_shingles, component_id)."""
    docs = docs.select("doc_id", "text")
    every = stored(points(docs, n, threshold))
    members = every.where("sid is not null")
    first = members.groupBy("sid").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    first = stored(first)
    same_row = (F.col("doc_id") == F.col("rep")) & (F.col("sid") == F.col("_sid"))
    reps = every.join(first.withColumnRenamed("sid", "_sid"), same_row, "left_semi").dropDuplicates(["doc_id", "sid"])
    meet = stored(_meetings(reps, threshold))
    at = reps.select("doc_id", "n_grams", "point")
    links = stored(verified(_candidates(meet, at, None, threshold, True), docs, n, threshold))
    rest = stored(verified(_candidates(meet, at, components(links), threshold, False), docs, n, threshold))
    texts = members.select("doc_id", "sid").distinct()
    several = texts.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    ties = texts.join(several, "doc_id").join(first, "sid").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    whole = components(links.unionAll(rest).unionAll(ties))
    of_set = first.join(whole, F.col("rep") == F.col("node"), "left").select("sid", F.coalesce("component", "rep").alias("component_id"))
    out = every.select("doc_id", "sid", F.col("n_grams").alias("n_shingles")).join(of_set, "sid", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
