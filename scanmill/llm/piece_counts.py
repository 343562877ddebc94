"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie of byte strings. A node that cannot be extended pops the longest pieces of what it has read and
goes on from its failure link; how many pieces that pops is stored with the node, so a word is counted in one pass over
its bytes and no piece is ever cut out. A word is matched with the space before it, as the vocabulary spells words.

Defined cases: a null or blank text has no words and no pieces; a byte that is in no piece counts as one piece; words of any
length take time in proportion to it; columns of `docs` other than the id and text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanmill.llm.words import pieces, split


def vocabulary(path: str) -> list[bytes]:
    """The byte strings of a file of base64 strings and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """goto: node * 256 + byte -> node; fail and popped by node. Node 0 is the root."""

    def __init__(self, vocab: list[bytes]) -> None:
        self.goto: dict[int, int] = {}
        self.fail, self.popped = [0], [0]
        ends, parents, depth = {0: False}, [(0, 0)], [0]
        for piece in [*(bytes([b]) for b in range(256)), *vocab]:
            node = 0
            for b in piece:
                child = self.goto.get(node << 8 | b)
                if child is None:
                    child = self.goto[node << 8 | b] = len(parents)
                    parents.append((node, b))
                    depth.append(depth[node] + 1)
                    ends[child] = False
                node = child
            ends[node] = True
        self.fail, self.popped = [0] * len(parents), [0] * len(parents)
        for node in sorted(range(1, len(parents)), key=depth.__getitem__):
            parent, b = parents[node]
            if ends[node]:
                self.popped[node] = 1
                continue
            at, n = self.fail[parent], self.popped[parent]
            while (at << 8 | b) not in self.goto:
                n += self.popped[at]
                at = self.fail[at]
            self.fail[node], self.popped[node] = self.goto[at << 8 | b], n

    def count(self, word: bytes) -> int:
        goto, fail, popped = self.goto, self.fail, self.popped
        node = n = 0
        for b in word:
            while (child := goto.get(node << 8 | b)) is None:
                n += popped[node]
                node = fail[node]
            node = child
        while node:
            n += popped[node]
            node = fail[node]
        return n


@lru_cache(maxsize=2)
def _automaton(vocab: tuple[bytes, ...]) -> Automaton:
    return Automaton(list(vocab))


def count_pieces(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of `docs`; the vocabulary file is read by the driver and sent once."""
    vocab = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _automaton(vocab.value).count
        for batch in pieces(batches):
            found = split(batch.column("text"))
            each = np.fromiter((count(b" " + w) for w in found.words.cast(pa.large_binary()).to_pylist()), np.int64, len(found.words))
            total = np.concatenate([[0], np.cumsum(each[found.codes])])
            tokens = total[found.start[1:]] - total[found.start[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.counts), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
