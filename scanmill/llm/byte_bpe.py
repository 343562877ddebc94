"""Byte-level BPE by recursive DuckDB queries in every partition; decoding by ordered aggregation.

A word is a set of rows (word, position, token). Each step of the recursion joins neighbouring rows with the merge table and
contracts the leftmost pair of the smallest rank in each word, until no pair of a word is in the table. Long words
contract all pairs of the smallest rank at once where that gives the same: where no merge of the new token has a smaller
rank, the leftmost smallest pair stays one of them until all are gone.

Words that a Python worker met before, in this task or an earlier one, are taken from a memory of results that is bounded in bytes:
when the young generation is full it becomes the old one, and words that are met again move back. The connection lives in
memory and within a bound of its own; nothing is written to local disk.

Defined cases: a null text is empty; an empty text has no tokens; every byte has a token, so any text can be encoded, and
decoding gives back its bytes; `docs` columns other than the id and text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from scanmill.llm.words import pieces

#: Bytes of results kept in a generation, of which there are two; bytes of words in one query; bytes from which a word counts as long.
KEPT_BYTES, QUERY_BYTES, LONG = 64 << 20, 400_000, 64
#: Bytes of text worked on at once, unless one text is longer.
PIECE = 4 << 20

_FINISH = """
SELECT w, list(id ORDER BY p) AS ids FROM t WHERE done GROUP BY w ORDER BY w
"""
_PAIRS = """
WITH RECURSIVE t(w, p, id, done) AS (
  SELECT w, p, id, false FROM start
  UNION ALL (
    WITH pair AS (
      SELECT w, p, id, lead(p) OVER x AS q, lead(id) OVER x AS nid FROM t WHERE NOT done WINDOW x AS (PARTITION BY w ORDER BY p)
    ), ranked AS (
      SELECT w, p, pair.id, q, m FROM pair LEFT JOIN merges ON l = pair.id AND r = nid
    )"""
SHORT_SQL = (
    _PAIRS
    + """, best AS (
      SELECT w, min(m) AS m, arg_min(p, m * 65536::BIGINT + p) AS p, arg_min(q, m * 65536::BIGINT + p) AS q FROM ranked GROUP BY w
    )
    SELECT k.w, k.p, CASE WHEN k.p = b.p THEN b.m ELSE k.id END, b.m IS NULL FROM ranked k JOIN best b ON k.w = b.w WHERE b.q IS NULL OR k.p <> b.q
  )
)"""
    + _FINISH
)
LONG_SQL = (
    _PAIRS
    + """, best AS (
      SELECT *, min(m) OVER (PARTITION BY w) AS least, row_number() OVER (PARTITION BY w ORDER BY p) AS k FROM ranked
    ), hit AS (
      SELECT *, coalesce(m = least, false) AS h, min(CASE WHEN m = least THEN p END) OVER (PARTITION BY w) AS first FROM best
    ), run AS (
      SELECT *, k - row_number() OVER (PARTITION BY w, h ORDER BY p) AS g FROM hit
    ), taken AS (
      SELECT *, h AND (p = first OR least NOT IN (SELECT id FROM unsafe) AND row_number() OVER (PARTITION BY w, h, g ORDER BY p) % 2 = 1) AS take FROM run
    ), after AS (
      SELECT *, coalesce(lag(take) OVER (PARTITION BY w ORDER BY p), false) AS gone FROM taken
    )
    SELECT w, p, CASE WHEN take THEN least ELSE id END, least IS NULL FROM after WHERE NOT gone
  )
)"""
    + _FINISH
)
DECODE_SQL = "SELECT w, unhex(string_agg(piece, '' ORDER BY p)) AS bytes FROM coded JOIN vocab USING (id) GROUP BY w ORDER BY w"


@dataclass
class Merges:
    """All splits of each token into two, as (left, right, token); ranks are token numbers."""

    left: np.ndarray
    right: np.ndarray
    token: np.ndarray
    single: np.ndarray
    vocab: list[bytes]
    ids: np.ndarray

    @staticmethod
    def read(path: str) -> Merges:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, token = np.array(rows, np.int32).reshape(-1, 3).T.copy()
        return Merges(left, right, token, np.array([ranks[bytes([b])] for b in range(256)], np.int32), list(ranks), np.array(list(ranks.values()), np.int32))


class Coder:
    """Encodes and decodes words within one task."""

    def __init__(self, merges: Merges, memory: str = "400MB", kept: int = KEPT_BYTES) -> None:
        import duckdb

        self.kept = kept
        self.single, self.known, self.old, self.size = merges.single, {}, {}, 0
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        self._table("merges", {"l": merges.left, "r": merges.right, "m": merges.token})
        low = merges.token < np.maximum(merges.left, merges.right)
        self._table("unsafe", {"id": np.unique(np.concatenate([np.where(merges.token < x, x, -1)[low] for x in (merges.left, merges.right)]))})
        self._table("vocab", {"id": merges.ids, "piece": [t.hex() for t in merges.vocab]})

    def _table(self, name: str, columns: dict) -> None:
        rows = pa.table(columns)
        self.db.register("rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
        self.db.unregister("rows")

    def learn(self, words: set[str]) -> None:
        """Add words to `known`: word -> (its ids as int32 bytes, the bytes that these ids decode to; None for the word's own)."""
        if self.size > self.kept:
            self.known, self.old, self.size = {}, self.known, 0
        known, old, new = self.known, self.old, []
        for w in words:
            if w not in known:
                if w in old:
                    self._keep(w, old[w])
                else:
                    new.append(w)
        new.sort(key=len)
        raw = [w.encode() for w in new]
        start, size = 0, 0
        for i, r in enumerate(raw):
            size += len(r)
            last = i + 1 == len(raw)
            if last or size >= QUERY_BYTES or (len(raw[i + 1]) >= LONG) != (len(r) >= LONG):
                self._solve(new[start : i + 1], raw[start : i + 1])
                start, size = i + 1, 0

    def _keep(self, word: str, coded: tuple[bytes, bytes | None]) -> None:
        self.known[word] = coded
        self.size += 250 + 2 * len(word) + len(coded[0])

    def decoded(self, word: str) -> bytes:
        own = self.known[word][1]
        return word.encode() if own is None else own

    def _solve(self, words: list[str], raw: list[bytes]) -> None:
        lengths = np.array([len(r) for r in raw])
        first = np.cumsum(lengths) - lengths
        rows = pa.table(
            {
                "w": np.repeat(np.arange(len(raw), dtype=np.int32), lengths),
                "p": (np.arange(lengths.sum()) - np.repeat(first, lengths)).astype(np.int32),
                "id": self.single[np.frombuffer(b"".join(raw), np.uint8)],
            }
        )
        self.db.register("start", rows)
        coded = self.db.sql(LONG_SQL if lengths[-1] >= LONG else SHORT_SQL).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("start")
        offsets, ids = coded.offsets.to_numpy(), coded.values.to_numpy().astype(np.int32)
        n = np.diff(offsets)
        self.db.register("coded", pa.table({"w": np.repeat(np.arange(len(n), dtype=np.int32), n), "p": np.arange(len(ids), dtype=np.int32), "id": ids}))
        decoded = self.db.sql(DECODE_SQL).to_arrow_table().column("bytes").to_pylist()
        self.db.unregister("coded")
        flat = ids.tobytes()
        for w, r, a, b, d in zip(words, raw, (offsets[:-1] * 4).tolist(), (offsets[1:] * 4).tolist(), decoded, strict=True):
            self._keep(w, (flat[a:b], None if d == r else d))


_CODERS: dict[tuple[str, int], Coder] = {}


def _coder(path: str, kept: int, merges: Merges) -> Coder:
    """The worker's coder for a vocabulary file; one at a time."""
    if (path, kept) not in _CODERS:
        _CODERS.clear()
        _CODERS[path, kept] = Coder(merges, kept=kept)
    return _CODERS[path, kept]


def encode_decode(docs: DataFrame, path: str, pattern: str, piece: int = PIECE, kept: int = KEPT_BYTES) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for each row of `docs`: the tokens of the text and the bytes they decode to.

    Smaller pieces and a smaller memory of words (both in bytes) cost more CPU and less memory of a worker; results do not change.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Merges.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, find = _coder(path, kept, sent.value), regex.compile(pattern).findall
        for batch in pieces(batches, most=piece):
            found = [find(t or "") for t in batch.column("text").to_pylist()]
            coder.learn({w for words in found for w in words})
            known = coder.known
            ids = [b"".join([known[w][0] for w in words]) for words in found]
            decoded = [b"".join(map(coder.decoded, words)) for words in found]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
