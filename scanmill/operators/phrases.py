"""Documents and the phrases they contain, for rule tables of any size.

A table of some dozen keywords is written into the plan (`joins.keyword_matches`). Here the phrases are rows. Each phrase
is indexed by a rare one of its q-grams, counted over the documents that are searched, and documents meet phrases by an
equi-join on their q-grams; `contains` then decides. A q-gram is Q bytes of UTF-8 as one number, so all of a text are a view of
its bytes. Only q-grams whose cell in a map of the index, of fixed size, is taken leave the scan of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.session import stored

#: Bytes of a gram; counters for the grams of all texts; cells in the map of the index; bytes of text worked on at once, unless one text is longer.
Q, BUCKETS, CELLS, PIECE = 8, 1 << 16, 1 << 24, 2 << 20


def cells(gram: np.ndarray, n: int) -> np.ndarray:
    """The cell of each gram, of n (a power of two)."""
    with np.errstate(over="ignore"):
        x = gram ^ (gram >> np.uint64(32))
        return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - n.bit_length())).astype(np.int64)


def text_grams(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(piece, row, gram) of every gram of the column ``low``: Q bytes each, and those of the smaller ``sizes``, which end in their size.

    A null text has none. Grams of two sizes may be one number: they are then counted together and met in vain.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("low")), 0)
        at, upto = 0, np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        while at < len(upto):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE, side="right")))
            piece = batch.slice(at, end - at)
            at = end
            text = pc.fill_null(piece.column("low").cast(pa.large_binary()), b"")
            start = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            if start[0] == start[-1]:
                continue
            data, start = np.frombuffer(text.buffers()[2], np.uint8)[start[0] : start[-1]], start - start[0]
            padded = np.concatenate([data, np.zeros(Q - 1, np.uint8)])
            window = np.ndarray(len(data), np.dtype("<u8"), padded, strides=(1,))
            row = np.repeat(np.arange(piece.num_rows, dtype=np.int32), np.diff(start))
            left = start[1:][row] - np.arange(len(data))
            for n in [Q, *sizes]:
                ok = left >= n
                yield piece, row[ok], window[ok] if n == Q else short(window[ok], n)


def short(window: np.ndarray, n: int) -> np.ndarray:
    """The first n < Q bytes of each window, and n in the last."""
    return (window & np.uint64((1 << 8 * n) - 1)) | np.uint64(n << 56)


def phrase_grams(names: DataFrame) -> DataFrame:
    """(phrase, gram, bucket, cell) of each different gram of each phrase; a phrase of less than Q bytes is its own gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = []
            for p in batch.column("phrase").cast(pa.large_binary()).to_pylist():
                window = np.ndarray(max(1, len(p) - Q + 1), np.dtype("<u8"), p.ljust(Q, b"\0"), strides=(1,))
                grams.append(np.unique(window) if len(p) >= Q else short(window, len(p)))
            each = np.concatenate([np.zeros(0, np.uint64), *grams])
            phrase = batch.column("phrase").take(pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams])))
            rows = [phrase, pa.array(each.view(np.int64)), pa.array(cells(each, BUCKETS)), pa.array(cells(each, CELLS))]
            yield pa.RecordBatch.from_arrays(rows, names=["phrase", "gram", "bucket", "cell"])

    return names.select("phrase").mapInArrow(run, "phrase string, gram long, bucket long, cell long")


def phrase_index(texts: DataFrame, of_phrase: DataFrame, sizes: list[int]) -> DataFrame:
    """(phrase, gram, cell) with a gram of each phrase that is rare in the texts (``low``), the smallest of equals.

    Occurrences are counted in each task by bucket of the gram's hash, so a task shuffles at most BUCKETS rows however much
    it reads; a count is never too low. A phrase with a gram in an empty bucket is in no text and gets no row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, _, gram in text_grams(batches, sizes):
            total += np.bincount(cells(gram, BUCKETS), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    seen = texts.select("low").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counted = of_phrase.join(seen, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("phrase").agg(F.min(F.struct("n", "gram", "cell")).alias("m"))
    return rarest.where("m.n > 0").select("phrase", "m.gram", "m.cell")


def taken_cells(index: DataFrame) -> np.ndarray:
    """A bit for each of the CELLS cells: whether a gram of the index is in it."""
    part = 1 << 16

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(part, bool)
        bits[pdf["cell"].to_numpy() % part] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros((CELLS // part, part // 8), np.uint8)
    rows = index.select("cell", F.shiftright("cell", 16).alias("part")).distinct().groupBy("part").applyInPandas(pack, "part long, bits binary")
    for r in rows.collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def phrase_matches(docs: DataFrame, phrases: DataFrame, text: str = "text", phrase: str = "phrase") -> DataFrame:
    """A row for each row of ``docs`` and each row of ``phrases`` whose phrase it contains, case aside: the columns of both but the text.

    A null or empty phrase is in no text, a null text holds none; repeated rows on either side give repeated rows. Candidates name a
    text by its hash, so ids may repeat or be null. The two tables may share no column name. Planning reads the lengths of the
    phrases below Q bytes (at most Q numbers) and the map of cells (CELLS bits), and writes the index, of one row per phrase; the texts
    are read for the counts, for the candidates and for the rows.
    """
    table = phrases.where(F.length(phrase) > 0).withColumn("_p", F.lower(phrase))
    names = table.select(F.col("_p").alias("phrase")).distinct()
    sizes = [r[0] for r in names.select(F.octet_length("phrase").alias("n")).where(F.col("n") < Q).distinct().collect()]
    # Texts of equal hash share their candidates; the text itself decides.
    others = [c for c in docs.columns if c != text]
    keyed = docs.where(F.col(text).isNotNull()).select(*others, F.xxhash64(text).alias("_t"), F.lower(text).alias("_low"))
    texts = keyed.select("_t", F.col("_low").alias("low"))
    # Written, so that the engine knows its size: where it is small it is broadcast and the candidates are not shuffled.
    index = stored(phrase_index(texts, phrase_grams(names), sizes))
    taken = docs.sparkSession.sparkContext.broadcast(taken_cells(index))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, row, gram in text_grams(batches, sizes):
            at = cells(gram, CELLS)
            hit = np.flatnonzero(taken.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            pairs = pd.DataFrame({"row": row[hit], "gram": gram[hit].view(np.int64)}).drop_duplicates()
            t = piece.column("_t").take(pa.array(pairs["row"].to_numpy()))
            yield pa.RecordBatch.from_arrays([t, pa.array(pairs["gram"].to_numpy())], names=["_t", "gram"])

    met = texts.mapInArrow(find, "_t long, gram long").join(index, "gram").select("_t", F.col("phrase").alias("_p")).distinct()
    found = keyed.join(met, "_t").where(F.contains("_low", "_p"))
    return found.join(table, "_p").select(*others, *phrases.columns)
