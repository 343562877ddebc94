"""How filters of a corpus interact: what each removes at every place of every order, from decision diagrams.

A document fails some of the filters: its failure mask. Per part there are at most 2 to the number of filters masks, counted by
Spark. From these counts a task builds a decision diagram: a level for each filter, a low edge for pass and a high edge for
fail, equal subdiagrams shared, and in each node how many documents reach it below. The path of all low edges is a run of the
filters in the diagram's order: what goes off to the high side at a level is what this step removes. Swapping two adjacent
levels gives the diagram of the neighbouring order, and a chain of such swaps (plain changes) visits every order once.

Defined cases: a null text is empty, a null lang is the part ''; equal texts are those with the same SHA-256; a row without
an id neither fails the filter for repeated texts nor makes another fail it, and has no label; rows that share an id and a
text pass or fail together; a label counts if any of its document's label rows has it; an empty table gives no rows.
Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanmill.llm.words import pieces, raw, split
from scanmill.session import stored

#: The filters in the order of their bits: few words, few different words, capitals, symbols, repeated text.
FILTERS = "ABCDE"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True


def text_failures(texts: pa.Array) -> np.ndarray:
    """Bits 0 to 3 of the failure mask of each text: filters A to D."""
    found = split(texts)
    n = found.counts
    kinds = max(1, len(found.words))
    different = np.bincount(np.unique(found.rows * kinds + found.codes) // kinds, minlength=len(n))
    data, start = raw(texts)
    per_row = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[start])
    points, upper, symbols = per_row((data & 0xC0) != 0x80), per_row(_UPPER[data]), per_row(_SYMBOL[data])
    fails = [n < 200, 100 * different < 50 * n, 100 * upper > 3 * points, symbols > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of each row; a text is read once and does not leave its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text")
            data, start = raw(texts)
            view = memoryview(data)
            digest = [hashlib.sha256(view[a:b]).digest() for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
            part = pc.fill_null(batch.column("lang"), "")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), part, pa.array(text_failures(texts)), pa.array(digest, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by failure mask, and those with a label among them.

    Only the first row of a text passes the filter for repeated texts. Copies are folded to a row per text, part and label
    before their smallest id is looked up, so that a text that a third of all rows share is as cheap as any.
    """
    slim = stored(failures(docs))
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    known = slim.where("doc_id is not null").join(flags.where("good or toxic"), "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    unknown = slim.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    kind = ["digest", "part", "mask", "good", "toxic"]
    rows = known.unionByName(unknown).groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    folded = rows.groupBy(*kind, F.col("doc_id").isNull().alias("nameless")).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    least = folded.withColumn("least", F.min("first").over(Window.partitionBy("digest")))
    passed = F.expr("case when nameless then n when first = least then n_first else 0L end")
    both = least.withColumn("passed", passed).select("part", "good", "toxic", F.expr("inline(array(struct(mask, passed as m), struct(mask | 16 as mask, n - passed as m)))"))
    sums = [F.sum("m").alias("n"), *(F.sum(F.expr(f"if({c}, m, 0L)")).alias(c) for c in ("good", "toxic"))]
    return both.where("m > 0").groupBy("part", "mask").agg(*sums)


class Diagram:
    """A decision diagram over count vectors; `order[i]` is the filter tested at level i."""

    def __init__(self, leaves: dict[int, Sequence[int]], n_filters: int) -> None:
        self.order = list(range(n_filters))
        width = len(next(iter(leaves.values())))
        self.low: list[int] = []
        self.high: list[int] = []
        self.weight: list[np.ndarray] = []
        self.tables: list[dict[tuple[int, int], int]] = [{} for _ in self.order]
        ends: dict[tuple[int, ...], int] = {}
        nodes = []
        # level i tests bit i; the masks are laid out so that the last filter is the fastest
        for k in range(1 << n_filters):
            mask = sum(1 << i for i in self.order if k >> (n_filters - 1 - i) & 1)
            counts = tuple(int(x) for x in leaves.get(mask, [0] * width))
            if counts not in ends:
                ends[counts] = self._add(-1, -1, np.array(counts, np.int64))
            nodes.append(ends[counts])
        for level in reversed(self.order):
            nodes = [self._node(level, a, b) for a, b in zip(nodes[::2], nodes[1::2], strict=True)]
        self.root = nodes[0]

    def _add(self, low: int, high: int, weight: np.ndarray) -> int:
        self.low.append(low)
        self.high.append(high)
        self.weight.append(weight)
        return len(self.low) - 1

    def _node(self, level: int, low: int, high: int) -> int:
        table = self.tables[level]
        if (low, high) not in table:
            table[low, high] = self._add(low, high, self.weight[low] + self.weight[high])
        return table[low, high]

    def swap(self, level: int) -> None:
        """Exchange the filters of `level` and the next; nodes of `level` keep their place, so those above stay valid."""
        upper = list(self.tables[level].values())
        self.tables[level], self.tables[level + 1] = {}, {}
        for x in upper:
            a, b = self.low[x], self.high[x]
            self.low[x], self.high[x] = self._node(level + 1, self.low[a], self.low[b]), self._node(level + 1, self.high[a], self.high[b])
            self.tables[level][self.low[x], self.high[x]] = x
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def path(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(filter, removed, kept) of each step of the all-pass path."""
        out, node = [], self.root
        for f in self.order:
            out.append((f, self.weight[self.high[node]], self.weight[self.low[node]]))
            node = self.low[node]
        return out


def plain_changes(n: int) -> Iterator[int]:
    """Places i such that swapping i and i + 1, one after the other, visits all orders of n things."""
    place, step = list(range(n)), [-1] * n  # thing -> place, direction
    at = list(range(n))
    while True:
        for x in reversed(range(n)):
            to = place[x] + step[x]
            if 0 <= to < n and at[to] < x:
                break
            step[x] = -step[x]
        else:
            return
        y, here = at[to], place[x]
        at[here], at[to], place[x], place[y] = y, x, to, here
        yield min(here, to)


def steps(leaves: dict[int, Sequence[int]], filters: str) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), all orders.

    What a filter removes when it comes first are all its failures; what it removes when it comes last, those it alone finds.
    """
    diagram = Diagram(leaves, len(filters))
    orders = [(tuple(diagram.order), diagram.path())]
    for level in plain_changes(len(filters)):
        diagram.swap(level)
        orders.append((tuple(diagram.order), diagram.path()))
    first, last, total = {}, {}, dict.fromkeys(range(len(filters)), 0)
    for order, path in orders:
        first[order[0]], last[order[-1]] = path[0][1][0], path[-1][1][0]
        for f, removed, _ in path:
            total[f] += int(removed[0])
    return [
        ("".join(filters[f] for f in order), k, kept[0], removed[0], first[f] - removed[0], last[f], removed[1], removed[2], total[f])
        for order, path in orders
        for k, (f, removed, kept) in enumerate(path, 1)
    ]


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order and step, from (part, mask, n, good, toxic); a part has at most 2 to the number of filters rows."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        leaves = {int(r.mask): (r.n, r.good, r.toxic) for r in rows.itertuples()}
        part = rows["part"].iloc[0]
        return pd.DataFrame([(part, *s) for s in steps(leaves, filters)], columns=names)

    return counts.groupBy("part").applyInPandas(run, SCHEMA)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(mask_counts(docs, labels))
