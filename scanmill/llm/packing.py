"""Token sequences packed into as few bins as found: Martello-Toth dominance reduction, then best fit.

A document's tokens, with an end token, are cut into pieces of at most a bin's capacity. Pieces of equal length are alike, so
the plan is made from the number of pieces of each length, at most as many numbers as a bin has places. The reduction
takes the lengths from the longest on and looks for a set of pieces which, put in a bin with this one, dominates every other set that
holds it (each of the other set's members can be dealt out under members of this one without exceeding them); such a bin is
in some best packing and is fixed for good. What is left is packed by best fit, longest first. Both work on whole classes of
equal bins, so the plan has a size bound by the capacity and not by the data. Pieces are numbered within their length where
they are made and find their place by that number.

Defined cases: a null text is empty and holds the end token alone; strings of special tokens in a text are ordinary text; a
word of any length is encoded; repeated rows are documents of their own; an empty table gives no rows; only the id and
the text are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanmill.llm.words import pieces, split
from scanmill.session import stored

#: Bytes of remembered words in a Python worker; the memory starts afresh beyond.
KEPT_BYTES = 160 << 20
#: A word of Latin letters between ASCII punctuation without apostrophes: lower-casing and splitting it need no tables.
_PLAIN = regex.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCoder:
    """Ids of words, as the tokenizer of a file gives them; it drops white space, so a text's ids are those of its words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, core: str) -> bytes:
        found = self.known.get(core)
        if found is None:
            spelt = core.encode().decode("latin-1").translate(self.letters)
            found = np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()
            self._keep(core, found)
        return found

    def _marks(self, run: str) -> bytes:
        found = self.known.get(run)
        if found is None:
            found = self._whole(run)
            self._keep(run, found)
        return found

    def _keep(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        self.size += 200 + 2 * len(word) + len(ids)

    def encode(self, words: Sequence[str]) -> list[bytes]:
        """The ids of each word as little-endian bytes."""
        if self.size > KEPT_BYTES:
            self.known.clear()
            self.size = 0
        out = []
        known, plain = self.known, _PLAIN.fullmatch
        for w in words:
            ids = known.get(w)
            if ids is None:
                m = plain(w)
                if m is None:
                    ids = self._whole(w)
                else:
                    before, core, after = m.groups()
                    ids = self._letters(core.lower())
                    if before:
                        ids = self._marks(before) + ids
                    if after:
                        ids += self._marks(after)
                self._keep(w, ids)
            out.append(ids)
        return out


@lru_cache(maxsize=2)
def _coder(path: str) -> WordCoder:
    return WordCoder(path)


def encode_rows(texts: pa.Array, coder: WordCoder, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, where each row starts): the ids of the words of each text and the end token."""
    found = split(texts)
    coded = coder.encode(found.words.to_pylist())
    size = np.fromiter((len(c) >> 2 for c in coded), np.int32, len(coded))
    flat = np.frombuffer(b"".join(coded), "<u4")
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int32) if len(size) else size
    each = size[found.codes]
    upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
    start = upto[found.start] + np.arange(len(found.start))
    ids = np.empty(int(start[-1]), "<u4")
    inside = np.ones(len(ids), bool)
    inside[start[1:] - 1] = False
    ids[~inside] = end
    ids[inside] = flat[np.repeat(first[found.codes] - upto[:-1], each) + np.arange(int(upto[-1]))]
    return ids, start


def cut(docs: DataFrame, path: str, capacity: int, end: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth[, ids]): pieces, numbered from 0 within their length and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = _coder(path), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for batch in pieces(batches):
            ids, begin = encode_rows(batch.column("text"), coder, end)
            n = np.diff(begin)
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            a = begin[row] + start
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            of = length[order]
            nth = np.empty(len(of), np.int64)
            nth[order] = np.arange(len(of)) - np.searchsorted(of, of) + met[of]
            met += np.bincount(length, minlength=capacity + 1)
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            columns += [pa.array(np.full(len(row), part, np.int32)), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:  # pieces of a row lie one after the other
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(a, len(ids)), pa.int32()), pa.array(ids.view("<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long{more}")


@dataclass
class Bins:
    """`times` equal bins, each holding `copies` pieces of each length in `runs` (length, copies)."""

    times: int
    runs: list[tuple[int, int]] = field(default_factory=list)


def dominating(left: np.ndarray, length: int, capacity: int) -> tuple[int, ...] | None:
    """What to put beside a piece of `length` so that no other choice beside it can be better; None where that is not known.

    `left[x]` pieces of each length x are there besides this one. A set dominates another one if the other's members can be
    dealt out under its members without exceeding them.
    """
    room = capacity - length
    there = np.flatnonzero(left[: room + 1])
    if not len(there):
        return ()
    largest = int(there[-1])
    small = np.repeat(there[:3], np.minimum(left[there[:3]], 3))[:3]
    if largest == room or len(small) < 2 or small[:2].sum() > room:
        return (largest,)  # fills the bin, or nothing else fits beside any piece
    if len(small) > 2 and small.sum() <= room:
        return None
    # at most two fit: for each x the largest y with y <= x and x + y <= room
    limit = np.minimum(there, room - there)
    limit = np.where((limit == there) & (left[there] < 2), limit - 1, limit)
    at = np.searchsorted(there, limit, side="right") - 1
    second = np.where(at >= 0, there[np.maximum(at, 0)], 0)
    if (there + second)[second > 0].max(initial=0) <= largest:
        return (largest,)  # one piece is as large as any two
    if second[-1] and second[-1] == second.max():
        return (largest, int(second[-1]))  # the largest first and the largest second of all pairs
    return None


def reduce(counts: np.ndarray, capacity: int) -> tuple[list[Bins], np.ndarray]:
    """(bins fixed for good, what is left of `counts`), where counts[x] is the number of pieces of length x.

    A fixed set stays dominating as long as its lengths last, so it is repeated at once; every fix uses up a length, hence
    there are at most about two for each length.
    """
    left, fixed = counts.astype(np.int64).copy(), []
    again = True
    while again:
        again = False
        for length in range(capacity, 0, -1):
            while left[length]:
                left[length] -= 1
                beside = dominating(left, length, capacity)
                left[length] += 1
                if beside is None:
                    break
                copies: dict[int, int] = {}
                for x in (length, *beside):
                    copies[x] = copies.get(x, 0) + 1
                times = int(min(left[x] // k for x, k in copies.items()))
                for x, k in copies.items():
                    left[x] -= times * k
                fixed.append(Bins(times, list(copies.items())))
                again = True
    return fixed, left


def best_fit(counts: np.ndarray, capacity: int) -> list[Bins]:
    """Best fit, longest first: each piece goes where the least room is left that it fits in. Equal bins are one class."""
    open_bins: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(room: int, bins: Bins) -> None:
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append(bins)

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, Bins(n // each, [(length, each)]))
                if n % each:
                    put(capacity - n % each * length, Bins(1, [(length, n % each)]))
                break
            room = rooms[at]
            bins = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            each = room // length
            full = min(bins.times, n // each)
            n -= full * each
            if full:
                put(room - each * length, Bins(full, [*bins.runs, (length, each)]))
            rest = bins.times - full
            if rest and n:  # fewer than a bin's worth
                put(room - n * length, Bins(1, [*bins.runs, (length, n)]))
                rest, n = rest - 1, 0
            if rest:
                put(room, Bins(rest, bins.runs))
    return [b for same in open_bins.values() for b in same]


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """(key, rank, copies, sequence, offset), sorted by key: runs of pieces of a length and the bins they go to.

    The piece of number k within its length is in the last run with key <= length << 44 | k; counted from the run's first
    number `rank`, it is in bin sequence + i // copies at offset + i % copies * length.
    """
    fixed, left = reduce(counts, capacity)
    used = np.zeros(capacity + 1, np.int64)
    sequence, rows = 0, []
    for bins in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for length, copies in bins.runs:
            rows.append((length << 44 | int(used[length]), int(used[length]), copies, sequence, offset))
            used[length] += bins.times * copies
            offset += copies * length
        sequence += bins.times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 5))


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of each piece of each document.

    The driver sees the number of pieces of each length (at most `capacity` numbers) and sends back the plan made from them: at
    most some ten thousand classes of bins, whatever the data.
    """
    made = stored(cut(docs, path, capacity, end, with_ids))
    by_task = made.groupBy("part", "length").count()
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect():
        counts[row["length"]] = row["n"]
    sent = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = made.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, copies, sequence, offset = sent.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            run = np.searchsorted(key, length << 44 | rank, side="right") - 1
            bin_, nth = np.divmod(rank - first[run], copies[run])
            columns = [batch.column(c).cast(pa.int64()) if c == "length" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[run] + bin_), pa.array(offset[run] + nth * length)], names=[*kept, "sequence_id", "offset"])

    more = "ids array<int>, " if with_ids else ""
    return ranked.select(*kept, "rank").mapInArrow(place, f"doc_id long, piece int, start long, length long, ids_crc32 long, {more}sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token sequences, from `pack` with ids; a group is at most one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("flatten(transform(parts, p -> p.ids))").alias("ids"))
