"""Exact and near duplicates.

Near duplicates are distinct 64-bit hashes within a Hamming distance. Copies of one hash are folded
to one row first, so a large group of copies costs one row here. Hashes are compared only when they
agree on three blocks of bits: of distance+3 blocks at least three stay whole under ``distance``
flips, so no pair is missed. For a distance of 5 these are 56 keys of 24 bits. One key may still be
held by very many hashes; its rows are cut into cells of ``unit`` x ``unit``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
#: Hashes of one key on each side of a cell.
UNIT = 2000


def blocks(positions: list[int], n: int) -> list[list[int]]:
    """Split bit positions into n runs of nearly equal length."""
    size, rest = divmod(len(positions), n)
    out, at = [], 0
    for i in range(n):
        step = size + (1 if i < rest else 0)
        out.append(positions[at : at + step])
        at += step
    return out


def mask_of(positions: list[int]) -> int:
    m = sum(1 << p for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def covering(distance: int) -> tuple[list[int], list[list[int]]]:
    """Masks of the choices of three blocks, and for each the masks of the blocks before its last that it leaves out."""
    parts = blocks(list(range(BITS)), distance + 3)
    choices = list(combinations(range(distance + 3), 3))
    masks = [mask_of([p for b in c for p in parts[b]]) for c in choices]
    return masks, [[mask_of(parts[b]) for b in range(c[2]) if b not in c] for c in choices]


def keyed(hashes: DataFrame, distance: int) -> DataFrame:
    """A row per choice of blocks: its number c and the bits v of the hash in it."""
    masks, _ = covering(distance)
    keys = [F.struct(F.lit(i).alias("c"), F.col("h").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)]
    return hashes.select(*hashes.columns, F.inline(F.array(*keys)))


def cells(a: DataFrame, b: DataFrame | None, distance: int, unit: int = UNIT) -> DataFrame:
    """Rows of a and b (of a and itself without b) that share a key, as a.* and b.*; a pair may share several keys.

    Keys that only one row holds go no further. A key with more rows than ``unit`` on a side is cut into a grid of
    cells by the hash of the row, so that no task holds all of its rows.

    The keyed rows are joined by sort and merge, those dealt to cells too: the engine takes the rows before the choices
    of blocks for their size, 56 times too few at a distance of 5, and would broadcast them through the driver.
    """
    ka = keyed(a, distance).hint("merge")
    na = ka.groupBy("c", "v").agg(F.count("*").alias("na")).hint("merge")
    if b is None:
        kb, sizes = ka, na.where("na > 1").withColumn("nb", F.col("na"))
    else:
        # Only the keys of the first side are counted on the second, which may be much larger.
        kb = keyed(b, distance).hint("merge").join(na.select("c", "v"), ["c", "v"], "left_semi").hint("merge")
        sizes = na.join(kb.groupBy("c", "v").agg(F.count("*").alias("nb")), ["c", "v"])
    sizes = sizes.select("c", "v", F.ceil(F.col("na") / unit).alias("pa"), F.ceil(F.col("nb") / unit).alias("pb"))
    own = lambda n: F.pmod(F.xxhash64("h"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = ka.join(sizes, ["c", "v"]).withColumn("i", own("pa")).withColumn("j", every("pb")).drop("pa", "pb").alias("a")
    right = kb.join(sizes, ["c", "v"]).withColumn("j", own("pb")).withColumn("i", every("pa")).drop("pa", "pb").alias("b")
    same = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in ("c", "v", "i", "j")]
    near = hamming(F.col("a.h"), F.col("b.h")) <= distance
    return left.hint("merge").join(right.hint("merge"), same[0] & same[1] & same[2] & same[3] & near)


def distinct_hashes(df: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """One row per hash with its first id and number of copies; counted map-side."""
    return df.filter(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(
        F.min(id_col).alias("first_id"), F.count("*").alias("copies")
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(hashes: DataFrame, distance: int = 5, unit: int = UNIT) -> DataFrame:
    """Every unordered pair of distinct hashes within the distance, once.

    A pair is kept in the first choice of blocks that it shares, so no distinct is needed: there the blocks
    before the last of the choice that are not in it all differ.
    """
    _, left_out = covering(distance)
    before = F.array(*[F.array(*[F.lit(m) for m in masks]).cast("array<bigint>") for masks in left_out])
    x = F.col("a.h").bitwiseXOR(F.col("b.h"))
    first = F.forall(F.element_at(before, F.col("a.c") + 1), lambda m: x.bitwiseAND(m) != 0)
    met = cells(hashes.select("h", "first_id", "copies"), None, distance, unit)
    return met.where((F.col("a.first_id") < F.col("b.first_id")) & first).select(
        F.col("a.h").alias("h1"), F.col("b.h").alias("h2"),
        F.col("a.first_id").alias("id1"), F.col("b.first_id").alias("id2"),
        F.bit_count(x).alias("distance"),
        F.col("a.copies").alias("copies1"), F.col("b.copies").alias("copies2"),
    )


def earliest_within(new: DataFrame, registered: DataFrame | None = None, distance: int = 5, unit: int = UNIT) -> DataFrame:
    """(h, first_id, m): m is the earliest registered hash (id, distance) within the distance of each hash of ``new``.

    Without a registry the hashes are compared among themselves and only earlier ones count. Both sides hold
    distinct hashes. The smallest id is taken inside each cell before anything is shuffled, so a hash leaves one
    row per cell and no list of pairs is written.
    """
    met = cells(new.select("h", "first_id"), None if registered is None else registered.select("h", "first_id"), distance, unit)
    if registered is None:
        met = met.where(F.col("b.first_id") < F.col("a.first_id"))
    first = F.min(F.struct(F.col("b.first_id").alias("id"), hamming(F.col("a.h"), F.col("b.h")).alias("distance")))
    return met.groupBy(F.col("a.h").alias("h"), F.col("a.first_id").alias("first_id")).agg(first.alias("m"))


def first_duplicates(df: DataFrame, hashes: DataFrame, id_col: str, hash_col: str, distance: int = 5, unit: int = UNIT) -> DataFrame:
    """For each row the earliest earlier row within the distance, if any: that of its hash, else the first row of its hash."""
    own = F.struct(F.col("first_id").alias("id"), F.lit(0).alias("distance"))
    stars = earliest_within(hashes, None, distance, unit).select("h", "m")
    best = hashes.select("h", own.alias("own")).join(stars, "h", "left").select(F.col("h").alias(hash_col), F.least("own", "m").alias("m"))
    found = df.join(best, hash_col).where(F.col("m.id") < F.col(id_col))
    return found.select(id_col, F.col("m.id").alias("matching_id"), F.col("m.distance").alias("distance"))


def exact_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Groups of rows with the same SHA-256 of their text: size and first id, counted map-side."""
    return (
        df.groupBy(F.sha2(text_col, 256).alias("content_hash"))
        .agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id"))
        .filter("copies > 1")
    )
