"""Scoring whole texts by a gated recurrent language model.

Counts of all training tokens come first. The most frequent `VOCAB` words are the model's own; any other word is predicted as
"another word" and then by its share of the counts of those. A class of about equal mass is predicted before the word in it,
so a step costs the classes and one class, not the vocabulary. Training is truncated backpropagation through windows of
`WINDOW` tokens in numpy, with the state carried from window to window: each task passes once over its share of the
training texts, the models are averaged by their number of tokens, and the next round starts from the average. Every
training text is used in exactly one round, so the work grows with the input. Scoring carries the state through the whole
of each text.

Words: runs of characters other than \\x20 and \\x09-\\x0D, A-Z lower-cased; each text ends with one more token.

Defined cases: a null text is empty, an empty text is its end alone; a null id is trained on as the id ''; rows that repeat are
scored alike and each counts for training; without training texts N and V are 0 and the model is the even start.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.words import pieces, split
from scanmill.session import stored

#: Words with an output of their own; words whose counts are sent to all tasks (a few MB); rounds of training.
VOCAB, SENT, CLASSES, SIZE, WINDOW, LANES, ROUNDS = 4096, 100_000, 64, 16, 32, 512, 2
#: Lanes in training: fewer tokens for each step of the weights.
TRAIN_LANES = 384
#: Bytes of text that are laid out in lanes at once: many texts, so that the longest leaves few steps for itself. Their words are
#: read in the smaller pieces of `words.pieces`, which leave only a number for each token.
PIECE = 16 << 20
#: Rows whose outputs are worked on at once.
BLOCK = 2048
#: Tokens of which scoring takes the outputs at once, from as many windows as hold them: those at the end of long texts hold few.
TOGETHER = 32768
#: Windows over which a task's rate rises to its full value.
WARM = 20
OTHER, END = 0, 1
SEED = 7


@dataclass
class Counts:
    """Of the training tokens: the SENT most frequent words with counts, and the totals."""

    words: list[str]
    count: np.ndarray
    texts: int
    tokens: int
    distinct: int

    @property
    def floor(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    @property
    def other_floor(self) -> float:
        """Of the words that the model does not hold itself."""
        own = min(VOCAB, len(self.words))
        rest = self.distinct - own - (self.texts > 0)
        return self.tokens - self.texts - int(self.count[:own].sum()) + 0.5 * (rest + 1)


#: Spread of logits up to which their exponentials are taken from one bound for all rows, without each row's largest.
SAFE = 60.0


def _reach(weights: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group of rows from `first` on: what no logit exceeds, and what the largest one reaches. No component of a state exceeds 1."""
    size = np.abs(weights[:, :-1]).sum(1)
    return np.maximum.reduceat(weights[:, -1] + size, first), np.maximum.reduceat(weights[:, -1] - size, first)


def _lowered(weights: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights whose biases lack what no logit of their group exceeds, which groups of rows this is safe for)."""
    most, least = _reach(weights, first)
    safe = most - least < SAFE
    weights = weights.copy()
    weights[:, -1] -= np.repeat(np.where(safe, most, 0), np.diff(first, append=len(weights))).astype(weights.dtype)
    return weights, safe


def _softmax(hs: np.ndarray, weights: np.ndarray, own: np.ndarray, safe: bool, learn: bool) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """(log probability of each row's own column, gradients of their negative sum: of weights, of biases, of the rows).

    The shares are never written out: what multiplies them is divided by their sums, which is a quarter as wide."""
    x = hs @ weights.T
    if not safe:
        x -= x.max(1, keepdims=True)
    at = np.arange(len(x))
    logit = x[at, own]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    logp = logit - np.log(total)
    if not learn:
        return logp, None
    x[at, own] -= total
    part = 1 / total
    back = x @ weights[:, :SIZE]
    back *= part[:, None]
    return logp, (x.T @ (hs[:, :SIZE] * part[:, None]), part @ x, back)


def _sigmoid(x: np.ndarray) -> None:
    """In place; by exponentials, which take half the time of tanh."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


class Model:
    """Parameters in one vector: embedding, recurrent, class and word weights; the last two start as the shares of the counts."""

    def __init__(self, counts: Counts) -> None:
        own = counts.count[:VOCAB].astype(np.float64)
        mass = np.concatenate([[max(0.0, counts.tokens - counts.texts - own.sum()), counts.texts], own]) + 0.5
        n, share = len(mass), mass / mass.sum()
        # OTHER and END are classes of their own; then words by falling counts, cut at equal shares of the mass
        part = np.cumsum(share[2:]) - share[2:] / 2
        self.cls = np.concatenate([[0, 1], 2 + np.unique(np.minimum((part / max(part.max(initial=0), 1e-9) * (CLASSES - 2)).astype(int), CLASSES - 3), return_inverse=True)[1]]).astype(np.int16)
        self.first = np.concatenate([np.flatnonzero(np.diff(self.cls, prepend=-1)), [n]])
        n_cls = len(self.first) - 1
        rng = np.random.default_rng(SEED)
        shapes = {"e": (n, SIZE), "w": (SIZE, 3 * SIZE), "u": (SIZE, 3 * SIZE), "b": (2, 3 * SIZE), "cw": (SIZE, n_cls), "cb": (n_cls,), "ow": (n, SIZE), "ob": (n,)}
        ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
        self.vector = np.zeros(ends[-1], np.float32)
        self.views = {k: (slice(e - int(np.prod(s)), e), s) for (k, s), e in zip(shapes.items(), ends, strict=True)}
        for k, scale in (("e", 0.5), ("w", SIZE**-0.5), ("u", SIZE**-0.5)):
            self.part(self.vector, k)[...] = rng.standard_normal(shapes[k]) * scale
        self.rooms: dict[str, np.ndarray] = {}
        self.part(self.vector, "cb")[...] = np.log(np.add.reduceat(share, self.first[:-1]))
        self.part(self.vector, "ob")[...] = np.log(share)

    def part(self, vector: np.ndarray, name: str) -> np.ndarray:
        where, shape = self.views[name]
        return vector[where].reshape(shape)

    def room(self, name: str, *shape: int, dtype: np.dtype | type = np.float32) -> np.ndarray:
        """Memory that windows share: to get it anew from the system for each window takes a sixth of the time."""
        size, held = int(np.prod(shape)), self.rooms.get(name)
        if held is None or held.size < size or held.dtype != dtype:
            held = self.rooms[name] = np.empty(size, dtype)
        return held[:size].reshape(shape)

    def after(self, trace: list[tuple[np.ndarray, ...]], at: np.ndarray) -> np.ndarray:
        """The states after the steps, as rows; `at` are their numbers by step, then by lane. Held until the next call."""
        lanes = len(trace[0][0])
        out = self.room("after", len(trace), lanes, SIZE, dtype=trace[0][0].dtype)
        for t, (h, z, _, _, n) in enumerate(trace):
            x = h - n
            x *= z
            x += n
            out[t] = x
        out = out.reshape(-1, SIZE)
        return out if len(at) == len(out) else out.take(at, 0)

    def steps(self, prev: np.ndarray, new: np.ndarray, h: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
        """Run the cell over prev (lanes x steps), from state h; new marks the start of a text.

        States and gates are lanes x components, but each component's lanes lie together, so that a gate is one run of memory. The
        trace is held until the next call."""
        e, w, u, b = (self.part(self.vector, k) for k in "ewub")
        lanes, steps = prev.shape
        kind = h.dtype
        # one product over all steps, in order of time: a step reads its own rows
        read = self.room("read", steps, lanes, SIZE, dtype=kind)
        np.take(e, prev.T, 0, out=read, mode="clip")
        gx = np.matmul(w.T, read.transpose(0, 2, 1), out=self.room("gx", steps, 3 * SIZE, lanes, dtype=kind))
        gx += b[0][:, None]
        fresh, ut, bias = new.any(0), np.ascontiguousarray(u.T), b[1][:, None]
        hs, zrs, ghs, ns = (self.room(k, steps, n * SIZE, lanes, dtype=kind) for k, n in (("h", 1), ("zr", 2), ("gh", 3), ("n", 1)))
        h, trace = h.T, []
        with np.errstate(over="ignore"):
            for t in range(steps):
                h0, zr, gh, n = hs[t], zrs[t], ghs[t], ns[t]
                h0[...] = h
                if fresh[t]:
                    h0[:, new[:, t]] = 0
                np.matmul(ut, h0, out=gh)
                gh += bias
                np.add(gx[t, : 2 * SIZE], gh[: 2 * SIZE], out=zr)
                _sigmoid(zr)
                z, r, q = zr[:SIZE], zr[SIZE:], gh[2 * SIZE :]
                np.multiply(r, q, out=n)
                n += gx[t, 2 * SIZE :]
                # tanh(x) = 2 sigmoid(2 x) - 1
                n += n
                _sigmoid(n)
                n += n
                n -= 1
                h = h0 - n
                h *= z
                h += n
                trace.append((h0.T, z.T, r.T, q.T, n.T))
        return trace, h.T

    def through(self, lanes: Lanes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(states, their positions in `lanes`), at least TOGETHER at a time but the last; the model must not change meanwhile."""
        h, held = np.zeros((len(lanes.length), SIZE), np.float32), []
        for at, valid in lanes.windows():
            trace, h = self.steps(lanes.prev.take(at), lanes.new.take(at), h[: len(at)])
            used = np.flatnonzero(valid.T)
            held.append((self.after(trace, used).copy(), at.T.take(used)))
            if sum(len(x) for _, x in held) >= TOGETHER:
                yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                held = []
        if held:
            yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])

    def outputs(self, h: np.ndarray, token: np.ndarray, grad: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each token given its state; with `grad`, adds the gradients of their negative sum and returns that of h."""
        cw, cb, ow, ob = (self.part(self.vector, k) for k in ("cw", "cb", "ow", "ob"))
        learn = grad is not None
        # classes of 16 bits are sorted by counting
        order = np.argsort(self.cls.take(token), kind="stable")
        token = token.take(order)
        cls = self.cls.take(token)
        # a last component of one takes the bias into the products
        hs = np.ones((len(h), SIZE + 1), h.dtype)
        hs[:, :SIZE] = h.take(order, 0)
        logp, dh = np.empty(len(h)), np.empty_like(hs[:, :SIZE]) if learn else None
        classes, safe = _lowered(np.concatenate([cw.T, cb[:, None]], 1), np.zeros(1, int))
        for a in range(0, len(h), BLOCK):
            rows = slice(a, a + BLOCK)
            logp[rows], g = _softmax(hs[rows], classes, cls[rows], safe[0], learn)
            if g:
                self.part(grad, "cw")[...] += g[0].T
                self.part(grad, "cb")[...] += g[1]
                dh[rows] = g[2]
        words, safe = _lowered(np.concatenate([ow, ob[:, None]], 1), self.first[:-1])
        ends = np.concatenate([[0], np.flatnonzero(np.diff(cls)) + 1, [len(cls)]])
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if a == z:
                continue
            c = cls[a]
            i, j = self.first[c], self.first[c + 1]
            if j - i == 1:
                continue
            of_words, g = _softmax(hs[a:z], words[i:j], token[a:z] - i, safe[c], learn)
            logp[a:z] += of_words
            if g:
                self.part(grad, "ow")[i:j] += g[0]
                self.part(grad, "ob")[i:j] += g[1]
                dh[a:z] += g[2]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return logp.take(back), None if dh is None else dh.take(back, 0)

    def train_window(self, prev: np.ndarray, new: np.ndarray, token: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after the window, gradient of the mean negative log-likelihood); nothing flows back beyond the window."""
        grad = np.zeros_like(self.vector)
        trace, last = self.steps(prev, new, h)
        lanes, steps = prev.shape
        kind = h.dtype
        used = np.flatnonzero(valid.T)
        dh = self.outputs(self.after(trace, used), token.T.take(used), grad)[1]
        if len(used) < valid.size:
            dh, given = np.zeros((valid.size, SIZE), kind), dh
            dh[used] = given
        dout = self.room("dout", steps, SIZE, lanes, dtype=kind)
        dout[...] = dh.reshape(steps, lanes, SIZE).transpose(0, 2, 1)
        e, w, u = (self.part(self.vector, k) for k in "ewu")
        gate = self.room("gate", steps, 3 * SIZE, lanes, dtype=kind)  # gradients of what the recurrent weights give
        cell = self.room("cell", steps, SIZE, lanes, dtype=kind)
        dh = np.zeros((SIZE, lanes), kind)
        fresh = new.any(0)
        for t in range(steps - 1, -1, -1):
            h0, z, r, q, n = (x.T for x in trace[t])
            dh += dout[t]
            rest = 1 - z
            dn = np.multiply(dh, rest, out=cell[t])
            dn *= 1 - n * n
            g = gate[t]
            rest *= z
            rest *= dh
            np.multiply(rest, h0 - n, out=g[:SIZE])
            np.multiply(dn, r, out=g[2 * SIZE :])
            x = 1 - r
            x *= q
            np.multiply(x, g[2 * SIZE :], out=g[SIZE : 2 * SIZE])
            dh *= z
            dh += u @ g
            if fresh[t]:
                dh[:, new[:, t]] = 0
        before, read = (self.room(k, steps, n, lanes, dtype=kind) for k, n in (("h", SIZE), ("read", SIZE)))
        self.part(grad, "u")[...] += (gate @ before.transpose(0, 2, 1)).sum(0).T
        self.part(grad, "b")[1] += gate.sum((0, 2))
        gate[:, 2 * SIZE :] = cell
        self.part(grad, "b")[0] += gate.sum((0, 2))
        self.part(grad, "w")[...] += (gate @ read.reshape(steps, lanes, SIZE)).sum(0).T
        de = np.matmul(w, gate, out=self.room("de", steps, SIZE, lanes, dtype=kind))
        of, ge = prev.T.astype(np.intp).ravel(), self.part(grad, "e")
        for k in range(SIZE):
            ge[:, k] += np.bincount(of, de[:, k].ravel(), len(ge))
        grad /= max(1, int(valid.sum()))
        return last, grad


@dataclass
class Lanes:
    """Texts one after the other in lanes of about equal length, the longest first; read in windows."""

    token: np.ndarray
    prev: np.ndarray
    new: np.ndarray
    text: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(ids: list[np.ndarray], lanes: int = LANES) -> Lanes:
        """From the tokens of each text, with its end."""
        heap = [(0, k) for k in range(min(lanes, len(ids)))]
        own: list[list[int]] = [[] for _ in heap]
        for i in sorted(range(len(ids)), key=lambda i: (-len(ids[i]), i)):
            total, k = heap[0]
            own[k].append(i)
            heapq.heapreplace(heap, (total + len(ids[i]), k))
        own.sort(key=lambda x: -sum(len(ids[i]) for i in x))
        order = [i for lane in own for i in lane]
        lengths = np.array([len(ids[i]) for i in order], np.int64)
        token = np.concatenate([ids[i] for i in order]) if order else np.zeros(0, np.int32)
        new = np.zeros(len(token), bool)
        new[np.cumsum(lengths) - lengths] = True
        prev = np.concatenate([[END], token[:-1]]).astype(np.int32) if len(token) else token
        prev[new] = END
        length = np.array([sum(len(ids[i]) for i in lane) for lane in own], np.int64)
        return Lanes(token, prev, new, np.repeat(np.array(order, np.int32), lengths), np.cumsum(length) - length, length)

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, valid), lanes x WINDOW each; lanes that have ended are left out."""
        for t in range(0, int(self.length.max(initial=0)), WINDOW):
            lanes = int((self.length > t).sum())
            at = t + np.arange(WINDOW)
            valid = at[None, :] < self.length[:lanes, None]
            yield self.start[:lanes, None] + np.minimum(at[None, :], self.length[:lanes, None] - 1), valid


class Reader:
    """Words of texts as numbers: 0.. by falling count, -1 for those that were not sent."""

    def __init__(self, counts: Counts) -> None:
        self.words = pa.array(counts.words, pa.large_string())

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(starts, number of each word, dictionary, code of each word)."""
        found = split(texts, lower=True)
        number = pc.fill_null(pc.index_in(found.words, self.words), -1).to_numpy().astype(np.int64)
        return found.start, number[found.codes] if len(number) else np.zeros(0, np.int64), found.words, found.codes

    @staticmethod
    def texts(start: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
        """Model tokens of each text, with its end."""
        own = np.where((number >= 0) & (number < VOCAB), number + 2, OTHER).astype(np.int32)
        end = np.array([END], np.int32)
        return [np.concatenate([own[a:b], end]) for a, b in zip(start[:-1], start[1:], strict=True)]


def with_fold(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)).alias("fold"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts: counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = split(batch.column("text"), lower=True)
            each = np.bincount(found.codes, minlength=len(found.words))
            yield pa.RecordBatch.from_arrays([found.words.cast(pa.string()), pa.array(each.astype(np.int64))], names=["word", "c"])

    return docs.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def gather(counted: DataFrame, texts: int) -> Counts:
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counted.orderBy(F.desc("c"), "word").limit(SENT).collect()
    return Counts([r["word"] for r in top], np.array([r["c"] for r in top], np.int64), texts, total["n"] + texts, total["v"] + (texts > 0))


def _add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen, total = 0, 0.0
    for pdf in rows:
        for s, x in zip(pdf["seen"], pdf["total"], strict=True):
            seen, total = seen + int(s), total + np.frombuffer(x, np.float64)
    yield pd.DataFrame({"part": [key[0]], "seen": [seen], "total": [total.tobytes()]})


def train(docs: DataFrame, counts: Counts, rounds: int = ROUNDS, rate: float = 0.01) -> np.ndarray:
    """The parameters after all rounds; `docs` are the training texts with their fold."""
    sc = docs.sparkSession.sparkContext
    start = Model(counts).vector
    known = sc.broadcast(counts)
    parts = 16

    for k in range(rounds):
        given = sc.broadcast(start)

        def run(batches: Iterator[pa.RecordBatch], given: Broadcast = given) -> Iterator[pa.RecordBatch]:
            model, reader = Model(known.value), Reader(known.value)
            model.vector[...] = given.value
            mean, var, step = (np.zeros_like(model.vector) for _ in range(3))
            t, seen = 0, 0
            salt = 0
            for batch in pieces(batches, most=PIECE):
                lanes = Lanes.of([x for part in pieces(iter([batch])) for x in reader.texts(*reader.read(part.column("text"))[:2])], TRAIN_LANES)
                salt ^= xxhash.xxh3_64_intdigest(lanes.token.tobytes())
                h = np.zeros((len(lanes.length), SIZE), np.float32)
                for at, valid in lanes.windows():
                    last, g = model.train_window(lanes.prev.take(at), lanes.new.take(at), lanes.token.take(at), valid, h[: len(at)])
                    h = last
                    t, seen = t + 1, seen + int(valid.sum())
                    # a window of few lanes tells less and moves the weights less
                    g *= min(1.0, valid.sum() / (TRAIN_LANES * WINDOW / 4))
                    mean *= 0.9
                    mean += np.multiply(g, 0.1, out=step)
                    var *= 0.999
                    g *= g
                    var += np.multiply(g, 0.001, out=step)
                    np.sqrt(var, out=step)
                    step += 1e-6
                    np.divide(mean, step, out=step)
                    step *= rate * min(1.0, t / WARM) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                    model.vector -= step
            for i, x in enumerate(np.array_split(model.vector.astype(np.float64) * seen, parts) if seen else []):
                row = [pa.array([i], pa.int32()), pa.array([salt % 32], pa.int32()), pa.array([seen], pa.int64()), pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["part", "salt", "seen", "total"])

        share = docs.where(F.pmod(F.crc32(F.concat(F.lit("r"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), F.lit(rounds)) == k)
        local = share.select("text").mapInArrow(run, "part int, salt int, seen long, total binary")
        schema = "part int, seen long, total binary"
        merged = local.groupBy("part", "salt").applyInPandas(_add, schema).groupBy("part").applyInPandas(_add, schema).orderBy("part").collect()
        if merged:
            start = np.concatenate([np.frombuffer(r["total"], np.float64) / r["seen"] for r in merged]).astype(np.float32)
    return start


def score(docs: DataFrame, held_out: int = 1) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = with_fold(docs)
    training = docs.where(F.col("fold") != held_out)
    counted = stored(word_counts(training))
    counts = gather(counted, training.select("fold").count())
    vector = spark.sparkContext.broadcast(train(training, counts))
    known = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        model, reader = Model(counts), Reader(counts)
        model.vector[...] = vector.value
        logc = np.log10(np.append(counts.count, 0) + 0.5)
        for batch in pieces(batches, most=PIECE):
            ids, parts = [], []
            for part in pieces(iter([batch])):
                tokens, columns = counted_words(part, reader, counts, logc)
                ids += tokens
                parts.append(columns)
            lanes, n_rows = Lanes.of(ids), len(ids)
            del ids
            likely = np.zeros(n_rows)
            for states, at in model.through(lanes):
                logp, _ = model.outputs(states, lanes.token.take(at))
                likely += np.bincount(lanes.text.take(at), logp, n_rows)
            first = 0
            for columns in parts:
                of_part = likely[first : first + len(columns["doc_id"])] / np.log(10)
                first += len(of_part)
                columns["part_score"] = pa.array(of_part + columns["part_score"])
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def counted_words(part: pa.RecordBatch, reader: Reader, counts: Counts, logc: np.ndarray) -> tuple[list[np.ndarray], dict]:
        """(model tokens of each text, columns); `part_score` lacks what the recurrent model gives."""
        start, number, words, codes = reader.read(part.column("text"))
        n_rows, n_words = part.num_rows, np.diff(start)
        rows = np.repeat(np.arange(n_rows), n_words)
        sent, own = number >= 0, (number >= 0) & (number < VOCAB)
        base = np.bincount(rows, np.where(sent, logc[number], 0.0), n_rows) + np.log10(counts.texts + 0.5)
        other = np.bincount(rows, np.where(sent & ~own, logc[number], 0.0), n_rows)
        n_other = np.bincount(rows, ~own, n_rows)
        # words that were not sent go on with their number in the text
        rare = np.flatnonzero(~sent)
        pairs, times = np.unique(rows[rare] * max(len(words), 1) + codes[rare], return_counts=True)
        ends = np.searchsorted(pairs // max(len(words), 1), np.arange(n_rows + 1)).astype(np.int32)
        taken = words.take(pa.array(pairs % max(len(words), 1))).cast(pa.string())
        texts = pc.fill_null(part.column("text"), "").to_pylist()
        return reader.texts(start, number), {
            "doc_id": part.column("doc_id"),
            "fold": part.column("fold"),
            "h": pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).astype(np.int64)),
            "n_tokens": pa.array(n_words + 1),
            "n_sent": pa.array(np.bincount(rows, sent, n_rows).astype(np.int64)),
            "base": pa.array(base),
            "part_score": other - n_other * np.log10(counts.other_floor),
            "rare": pa.ListArray.from_arrays(pa.array(ends), taken),
            "times": pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int64))),
        }

    schema = "doc_id long, fold long, h long, n_tokens long, n_sent long, base double, part_score double, rare array<string>, times array<long>"
    scored = stored(docs.mapInArrow(run, schema))
    rare = scored.select("doc_id", "h", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("doc_id", "h", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    found = rare.join(counted, "word", "left").groupBy("doc_id", "h").agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("s"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("k"), F.sum("times").alias("t")
    )
    # rows that agree in id and text meet in one sum: each has its part of it
    n_rare = F.col("n_tokens") - 1 - F.col("n_sent")
    part = F.coalesce(n_rare / F.col("t"), F.lit(0.0))
    right = found.withColumnRenamed("doc_id", "_id").withColumnRenamed("h", "_h")
    out = scored.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    s = F.coalesce(F.col("s") * part, F.lit(0.0))
    return out.select(
        "doc_id",
        (F.col("fold") == held_out).alias("held_out"),
        "n_tokens",
        (F.col("n_sent") + F.coalesce(F.round(F.col("k") * part).cast("long"), F.lit(0)) + int(counts.texts > 0)).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + s - F.col("n_tokens") * F.lit(float(np.log10(counts.floor)))).alias("base_score"),
        (F.col("part_score") + s).alias("score"),
    )
