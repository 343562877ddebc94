"""Personal data in whole texts: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns (the base) are checked by fixed rules; a match that fails a rule is dropped. The random field looks at the places with
digits or an at sign. It scores whole candidate spans by features of the span (digit count, check sum, groups, separators,
what stands before and after) and picks boundaries and types jointly: a dynamic program over the tokens of a place, with
spans of at most `MOST_TOKENS` tokens. It finds what the patterns lose, such as a card number inside a longer run of digits.

It is trained on the base spans of at most `max_texts` texts, as they stand and with digits and marks put before and after
them, so that it learns where a span ends. Candidates that no kind could have are outside its support, so places without digits or an
at sign need no scoring.

Defined cases: a null or empty text has no spans; spans are in code points, the end exclusive; repeated rows give equal spans;
without any base span to learn from nothing is added; added spans never overlap base spans.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.words import pieces

KINDS = ("email", "ip", "card", "phone")
#: The longest form of the kinds: a card of 19 digits with a mark between each two.
MOST_TOKENS = 37
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# Possessive, and only from the start of a run of digits: the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PLACE = re.compile(r"(?<!\S)[^\s@0-9]*+[@0-9]\S*")
_TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\s+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its rule, in the order of KINDS, then by start."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in (("card", _CARD, 16, 19), ("phone", _PHONE, 8, 15)):
        for m in pattern.finditer(text):
            d = _digits(m[0])
            if least <= len(d) <= most and (kind == "phone" or luhn(d)):
                out.append((kind, *m.span()))
    return out


def places(text: str) -> Iterator[tuple[int, int]]:
    """Chunks with a digit or an at sign; those with one space between them are one place."""
    start = end = -1
    for m in _PLACE.finditer(text):
        if m.start() == end + 1 and text[end] == " ":
            end = m.end()
            continue
        if start >= 0:
            yield start, end
        start, end = m.span()
    if start >= 0:
        yield start, end


def _possible(kind: str, s: str) -> bool:
    """Whether a span of this text is in the support of the kind."""
    if kind == "email":
        at = s.find("@")
        return at > 0 and s.find("@", at + 1) < 0 and "." in s[at:-1] and not re.search(r"[\s\"'<>(),;:]", s) and s[-1].isalnum()
    if not "0" <= s[-1] <= "9" or s[0] not in "+(0123456789":
        return False
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", s))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[ -]?[0-9]){12,18}", s))
    return bool(re.fullmatch(r"[+(]?[0-9(][ ().0-9-]{5,}[0-9]", s)) and 7 <= len(_digits(s)) <= 15


def _side(c: str) -> str:
    return "none" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else "join" if c in ".@+_-" else "mark"


def span_features(kind: str, text: str, start: int, end: int) -> list[str]:
    """Names of the features that hold for the span text[start:end] as one of this kind."""
    s, d = text[start:end], _digits(text[start:end])
    before, after = text[start - 1 : start], text[end : end + 1]
    names = [
        "bias",
        f"before={_side(before)}",
        f"after={_side(after)}",
        f"digits={len(d)}",
        f"groups={len(re.findall('[0-9]+', s))}",
        f"marks={''.join(sorted(set(re.sub('[0-9A-Za-z]', '', s))))[:6]}",
        f"more_before={bool(re.search(r'[0-9][ .-]?$', text[max(0, start - 2) : start]))}",
        f"more_after={bool(re.match(r'[ .-]?[0-9]', text[end : end + 2]))}",
    ]
    if kind == "card":
        names += [f"luhn={luhn(d)}", f"even={len({len(g) for g in re.split('[ -]', s)}) == 1}"]
    elif kind == "ip":
        names.append(f"bytes={all(int(p) <= 255 for p in s.split('.'))}")
    elif kind == "phone":
        names += [f"plus={s[0] == '+'}", f"pairs={s.count('(') == s.count(')')}"]
    else:
        names.append(f"plain={bool(re.fullmatch(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', s))}")
    return [f"{kind}:{n}" for n in names]


@dataclass
class Lattice:
    """A place: its token bounds and the candidate spans by their last token, as (first token, kind, features)."""

    bounds: list[int]
    ending: list[list[tuple[int, str, list[str]]]]

    @staticmethod
    def of(text: str, start: int, end: int) -> Lattice:
        bounds = [m.start() for m in _TOKEN.finditer(text, start, end)] + [end]
        ending: list[list[tuple[int, str, list[str]]]] = [[] for _ in bounds]
        for i in range(len(bounds) - 1):
            if text[bounds[i]].isspace():
                continue
            for j in range(i + 1, min(len(bounds), i + 1 + MOST_TOKENS)):
                s = text[bounds[i] : bounds[j]]
                for kind in KINDS:
                    if _possible(kind, s):
                        ending[j].append((i, kind, span_features(kind, text, bounds[i], bounds[j])))
        return Lattice(bounds, ending)

    def decode(self, weights: dict[str, float]) -> list[Span]:
        """The segmentation with the highest score; tokens outside spans score 0."""
        best, back = [0.0], [None]
        for j in range(1, len(self.bounds)):
            score, how = best[j - 1], None
            for i, kind, names in self.ending[j]:
                s = best[i] + sum(weights.get(n, 0.0) for n in names)
                if s > score:
                    score, how = s, (i, kind)
            best.append(score)
            back.append(how)
        out, j = [], len(self.bounds) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((kind, self.bounds[i], self.bounds[j]))
                j = i
        return out[::-1]


def fit(examples: list[tuple[Lattice, list[Span]]], steps: int = 80, rate: float = 0.3, ridge: float = 1e-3) -> dict[str, float]:
    """Maximum conditional likelihood of the segmentations, by forward and backward sums over all of them."""
    number: dict[str, int] = {}
    rows = []
    for lattice, gold in examples:
        wanted, cand = set(gold), []
        for j, ends in enumerate(lattice.ending):
            for i, kind, names in ends:
                cand.append((i, j, np.array([number.setdefault(n, len(number)) for n in names]), (kind, lattice.bounds[i], lattice.bounds[j]) in wanted))
        rows.append((len(lattice.bounds), cand))
    w, square = np.zeros(len(number)), np.full(len(number), 1e-8)
    for _ in range(steps):
        grad = ridge * w * len(rows)
        for n, cand in rows:
            if not cand:
                continue
            score = np.array([w[f].sum() for _, _, f, _ in cand])
            at: list[list[int]] = [[] for _ in range(n)]
            of: list[list[int]] = [[] for _ in range(n)]
            for k, (i, j, _, _) in enumerate(cand):
                at[j].append(k)
                of[i].append(k)
            forward, backward = np.zeros(n), np.zeros(n)
            for j in range(1, n):
                forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[cand[k][0]] + score[k] for k in at[j])])
            for i in range(n - 2, -1, -1):
                backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[cand[k][1]] + score[k] for k in of[i])])
            for k, (i, j, f, gold) in enumerate(cand):
                grad[f] += np.exp(min(0.0, forward[i] + score[k] + backward[j] - forward[-1])) - gold
        square += grad * grad
        w -= rate * grad / np.sqrt(square)
    return {n: float(w[k]) for n, k in number.items()}


def examples_of(texts: list[str], seed: int = 5, copies: int = 3) -> list[tuple[Lattice, list[Span]]]:
    """Places of the texts with their base spans, copies of the spans among other digits and marks, and broken copies."""
    rng, out = random.Random(seed), []
    for text in texts:
        spans = base_spans(text)
        for start, end in places(text):
            gold = [s for s in spans if start <= s[1] and s[2] <= end]
            if end - start > 400:
                continue
            out.append((Lattice.of(text, start, end), _apart(gold)))
            for kind, a, b in gold:
                for _ in range(copies):
                    left, right = (rng.choice(("", f"{rng.randrange(1000)} ", "(", "#", "x", f"{rng.randrange(10**5)}-", "no. ", '"')), rng.choice(("", f" {rng.randrange(1000)}", ")", ".", ",", f" - {rng.randrange(10**4)}", '"', "!!", f".{rng.randrange(10)}")))
                    if kind == "phone" and left[-1:].isdigit():
                        left = ""
                    made = left + text[a:b] + right
                    out.append((Lattice.of(made, 0, len(made)), [(kind, len(left), len(left) + b - a)]))
                    if kind in ("card", "ip"):  # what breaks the rule of the kind is no span
                        broken = text[a : b - 1] + str((int(text[b - 1]) + 1 + rng.randrange(8)) % 10) if kind == "card" else f"{rng.randrange(256, 1000)}{text[text.index('.', a) : b]}"
                        out.append((Lattice.of(made := left + broken + right, 0, len(made)), []))
    return out


def _apart(spans: list[Span]) -> list[Span]:
    """Without spans that overlap an earlier kind's."""
    out: list[Span] = []
    for s in spans:
        if all(s[2] <= t[1] or t[2] <= s[1] for t in out):
            out.append(s)
    return out


def train(docs: DataFrame, max_texts: int = 300) -> dict[str, float]:
    """Weights from at most `max_texts` different texts that hold an at sign or eight digits close together, those with the smallest hashes.

    Of each text the first 20 places with their neighbours are used, and at most 400 characters of a place.
    """
    likely = docs.select("text").where(F.col("text").rlike(r"@|[0-9](?:[ ().-]{0,2}[0-9]){7}")).withColumn("h", F.xxhash64("text"))
    near = F.transform(
        F.regexp_extract_all("text", F.lit(r"((?:\S{1,40}\s){0,3}\S{0,80}[@0-9]\S{0,80}(?: \S{0,80}[@0-9]\S{0,80}){0,6}(?:\s\S{1,40}){0,2})"), 1), lambda x: F.substring(x, 1, 400)
    )
    chosen = F.broadcast(likely.select("h").distinct().orderBy("h").limit(max_texts))  # at most max_texts hashes
    places = likely.join(chosen, "h", "left_semi").select("h", F.array_join(F.slice(near, 1, 20), "\n").alias("text")).distinct()
    rows = places.orderBy("h", "text").collect()
    return fit(examples_of([r["text"] for r in rows]))


def all_spans(text: str, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """(base, base and added), each in the order of KINDS, then by start."""
    base = base_spans(text)
    added: list[Span] = []
    for start, end in places(text) if weights else ():
        inside = [s for s in base if s[1] < end and start < s[2]]
        for s in Lattice.of(text, start, end).decode(weights):
            if all(s[2] <= t[1] or t[2] <= s[1] for t in inside):
                added.append(s)
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<kind:string,start:bigint,end:bigint>>"


def _column(spans: list[list[Span]]) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], _SPANS)


def find(docs: DataFrame, max_texts: int = 300) -> DataFrame:
    """(doc_id, base, spans) for each row of `docs`, arrays of (kind, start, end)."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, max_texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [all_spans(t, weights.value) if t else ([], []) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _column([x[0] for x in found]), _column([x[1] for x in found])], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {_SPANS_SQL}, spans {_SPANS_SQL}")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then the longest, is named."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, max_texts: int = 300) -> DataFrame:
    """Every row of `docs` with the spans of its text replaced; all other columns as they are."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, max_texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [redacted(t, all_spans(t, weights.value)[1]) if t else t for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
