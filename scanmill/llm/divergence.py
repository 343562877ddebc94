"""How far the word use of sources of a language lies apart, in exact whole numbers, by row accumulation.

For each language, sources and terms form a sparse matrix of counts. The divergence of a source from another is a sum over all
terms of the language, yet nearly all counts are zero, and a term that both lack adds the same for all such terms. So each
source's row is worked through the term-major index: for each of its terms the index gives the sources that have it too, and what the
pair adds beyond the values for zero counts is scattered into a dense array with a place per peer (Gustavson's row
accumulation). No pair of postings leaves the task. Terms that one of the two lacks are added by how often each count
occurs, terms that both lack by their number.

The matrix is cut into blocks of terms, each with all sources of a language; sums of blocks are added by Spark. A hot
source or language is only a longer row in each of more blocks.

Defined cases: null text, lang and source read as ''; a source without terms and a language without kept terms still have
all their pairs (value 0 where the language keeps no term); repeated rows count each time; an empty table gives no rows; other columns
are not read. Counts are exact up to 9 * 10^15 terms in a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanmill.llm.words import PIECE_BYTES, pieces, raw, split
from scanmill.session import stored

#: Counts (a source and a term each) in a block, about; pairs of postings worked on at once in it.
POSTINGS, AT_ONCE = 200_000, 2_000_000
#: Byte -> itself if part of a term (A-Z as a-z), else a space.
_TERM = np.full(256, 0x20, np.uint8)
_TERM[128:] = np.arange(128, 256)
_TERM[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TERM[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _letters_only(texts: pa.Array) -> pa.Array:
    """Texts with a space for each ASCII character that is no letter, and A-Z in lower case."""
    data, start = raw(texts)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(start.astype(np.int64)), pa.py_buffer(_TERM[data]))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within pieces of the table only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=2 * PIECE_BYTES):
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
            found = split(_letters_only(batch.column("text")))
            kinds = max(1, len(found.words))
            in_row, n = np.unique(found.rows * kinds + found.codes, return_counts=True)
            key = group[in_row // kinds] * kinds + in_row % kinds
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            if not len(first):
                continue
            of, term = np.divmod(key[first], kinds)
            of_lang, of_source = np.divmod(of, max(1, len(source.dictionary)))
            columns = [lang.dictionary.take(pa.array(of_lang)), source.dictionary.take(pa.array(of_source)), found.words.take(pa.array(term)).cast(pa.string())]
            columns += [pa.array(np.add.reduceat(n, first)), pa.array(np.diff(first, append=len(key)).astype(np.int64))]
            for at in range(0, len(first), 50_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 50_000) for c in columns], names=["lang", "source", "term", "n", "docs"])

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: np.ndarray, total: int | np.ndarray, alpha: int = 1) -> np.ndarray:
    """1 + floor(10^9 * (count + alpha) / total), by long division so that no product leaves 64 bits."""
    whole, rest = np.divmod(count + np.int64(alpha), total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return 1 + whole


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _histogram(peer: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(peer, value, times), once for each pair that occurs, in order."""
    order = np.lexsort((value, peer))
    peer, value = peer[order], value[order]
    first = np.flatnonzero(np.diff(peer, prepend=-1).astype(bool) | np.diff(value, prepend=-1).astype(bool))
    return peer[first], value[first], np.diff(first, append=len(peer))


def row_sums(peer: np.ndarray, term: np.ndarray, p: np.ndarray, zero: np.ndarray, n_terms: int) -> np.ndarray:
    """sums[i, j] over all terms of gap(share of peer i, share of peer j).

    The counts are (peer, term, share p), sorted by term; `zero` is each peer's share of a term it lacks.
    """
    peers = len(zero)
    sums = n_terms * gap(zero[:, None], zero[None, :])
    # terms of one of the two only, as if the other lacked them all
    who, value, times = _histogram(peer, p)
    ends = np.searchsorted(who, np.arange(peers + 1))
    for i in range(peers):
        v, t = value[ends[i] : ends[i + 1], None], times[ends[i] : ends[i + 1], None]
        if len(v):
            sums[i] += ((gap(v, zero[None, :]) - gap(zero[i], zero)[None, :]) * t).sum(0)
            sums[:, i] += ((gap(zero[None, :], v) - gap(zero, zero[i])[None, :]) * t).sum(0)
    # terms of both: through the index from term to postings, scattered into the row's accumulator
    index = np.searchsorted(term, np.arange(n_terms + 1))
    rows = np.argsort(peer, kind="stable")
    row_ends = np.searchsorted(peer[rows], np.arange(peers + 1))
    for i in range(peers):
        row = rows[row_ends[i] : row_ends[i + 1]]
        many = index[term[row] + 1] - index[term[row]]
        upto = np.cumsum(many)
        at = 0
        while at < len(row):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right")))
            mine = row[at:end]
            n = many[at:end]
            posting = np.arange(int(n.sum())) + np.repeat(index[term[mine]] - (np.cumsum(n) - n), n)
            other, q, own = peer[posting], p[posting], np.repeat(p[mine], n)
            z = zero[other]
            np.add.at(sums[i], other, gap(own, q) - gap(own, z) - gap(zero[i], q) + gap(zero[i], z))
            at = end
    return sums


def _block(counts: pa.Table, peers: pa.Table, top: int) -> pa.Table:
    """(lang, source, part, item, value) of one block of terms: all pairs' sums, and the `top` terms of each source."""
    peers = peers.sort_by("peer")
    names, lang = peers.column("source").combine_chunks(), peers.column("lang")[0].as_py()
    own, kept, of_lang = peers.column("n").to_numpy(), peers.column("terms")[0].as_py(), peers.column("lang_n")[0].as_py()
    s = len(names)
    pair = np.arange(s)
    a, b = np.repeat(pair, s), np.tile(pair, s)
    sums, out = np.zeros((s, s), np.int64), []
    if counts.num_rows:
        coded = counts.column("term").combine_chunks().dictionary_encode()
        term = coded.indices.to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")
        term, n, peer, total = term[order], *(counts.column(c).to_numpy()[order] for c in ("n", "peer", "total"))
        totals = own + kept
        p = share(n, totals[peer])
        sums = row_sums(peer, term, p, share(np.zeros(s, np.int64), totals), len(coded.dictionary))
        q = share(total, of_lang + kept)
        above = np.flatnonzero(p > q)
        value = gap(p[above], q[above])
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()] = np.arange(len(place))
        best = np.lexsort((place[term[above]], -value, peer[above]))
        who = peer[above][best]
        best, who = (x[np.arange(len(who)) - np.searchsorted(who, who) < top] for x in (best, who))
        out.append((who, "term", coded.dictionary.take(pa.array(term[above][best])), value[best]))
    out.append((a[a != b], "pair", names.take(pa.array(b[a != b])), sums[a[a != b], b[a != b]]))
    return pa.concat_tables(
        pa.table([pa.array([lang] * len(who), pa.string()), names.take(pa.array(who)), pa.array([part] * len(who), pa.string()), item, pa.array(value)], names=["lang", "source", "part", "item", "value"])
        for who, part, item, value in out
    )


def index(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, total, first): counts of terms in at least `min_docs` documents of their language.

    `total` is the term's count in the language; `first` holds once per term. A term has at most one row per source here.
    """
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    over = counts.withColumns({"in_docs": F.sum("docs").over(same), "total": F.sum("n").over(same), "first": F.col("source") == F.min("source").over(same)})
    return stored(over.where(F.col("in_docs") >= min_docs).drop("docs", "in_docs"))


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against each other one of its language, and its most typical terms."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    terms = index(docs, min_docs)
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("firsts"), F.count("*").alias("rows"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "firsts", "rows")}
    known = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").withColumns(zero)
    lang = Window.partitionBy("lang")
    sums = {"terms": F.sum("firsts").over(lang), "lang_n": F.sum("n").over(lang), "rows": F.sum("rows").over(lang)}
    numbered = known.withColumns(sums).withColumn("peer", F.row_number().over(lang.orderBy("source")) - 1)
    # one row per source and language: small beside the counts, and read by both sides below
    peers = stored(numbered.withColumn("blocks", F.ceil(F.greatest("rows", F.lit(1)) / POSTINGS).cast("int")).drop("firsts", "rows"))
    cut = terms.join(peers.select("lang", "source", "peer", "blocks"), ["lang", "source"])
    cut = cut.select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term", "n", "peer", "total")
    each = peers.toDF(*peers.columns).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def run(counts: pa.Table, of: pa.Table) -> pa.Table:
        return _block(counts, of, top)

    found = cut.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInArrow(run, "lang string, source string, part string, item string, value long")
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(best))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
