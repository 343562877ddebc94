"""Source divergence, filter interactions and packing against plain versions."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanmill.llm import divergence, filter_audit, packing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string"


# --- divergence


def diverged(docs, top=200):
    """All rows by dense sums in Python's whole numbers."""
    docs = [tuple(x or "" for x in d) for d in docs]
    out = []
    for lang in {d[1] for d in docs}:
        rows = [(s, TERM.findall(t.translate(LOWER))) for t, la, s in docs if la == lang]
        spread = collections.Counter(t for _, w in rows for t in set(w))
        kept = sorted(t for t, n in spread.items() if n >= 3)
        count = {s: collections.Counter() for s, _ in rows}
        for s, w in rows:
            count[s].update(t for t in w if spread[t] >= 3)
        whole = sum(count.values(), collections.Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        gap = lambda a, b: (a - b) ** 2 // b
        for s, c in count.items():
            pairs = [(sum(gap(p(c, t), p(o, t)) for t in kept), other) for other, o in count.items() if other != s]
            terms = [(gap(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, rows_, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(rows_, key=lambda r: (-r[0], r[1].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def divergence_rows(spark, docs, **kw):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], DOCS).repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df, **kw).collect())


@pytest.mark.parametrize("postings", [200_000, 40])
def test_divergence(spark, monkeypatch, postings):
    monkeypatch.setattr(divergence, "POSTINGS", postings)
    monkeypatch.setattr(divergence, "AT_ONCE", 7)
    rng = random.Random(3)
    vocab = [f"{a}{b}" for a in "xyzé" for b in ("a", "Bb", "ñ", "c", "zz")] + ["𐐷", "ö k"]
    docs = [(" ".join(rng.choices(vocab, k=rng.randint(0, 30))) + "1x,X", rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None])) for _ in range(60)]
    docs += [("one two", "fr", "a"), (None, "fr", "b"), ("", "it", "a"), *[("hot word", "en", "a")] * 40]
    assert divergence_rows(spark, docs) == diverged(docs)


def test_divergence_ranks_to_top(spark):
    docs = [(" ".join(f"t{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(13)), "en", "a")] * 3 + [("z z z", "en", "b")] * 3
    got = divergence_rows(spark, docs)
    assert got == diverged(docs)
    assert max(r[5] for r in got if r[2] == "term") == 200


def test_share_is_exact_beyond_64_bits():
    counts = np.array([0, 1, 10**12, 8 * 10**15], np.int64)
    total = 9 * 10**15
    assert divergence.share(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_divergence_odd_rows(odd, empty):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in divergence.audit(odd).collect()) == diverged(rows)
    assert divergence.audit(empty).collect() == []


# --- filter interactions


def interactions(docs, labels):
    """All rows by running every order over every document; docs are (id, text, lang)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = collections.defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        caps, sign = sum("A" <= c <= "Z" for c in t), any(c in "#$%&*|" for c in t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * caps > 3 * len(t), "D": sign, "E": i is not None and i > first[t]}
        rows[lang or ""].append((frozenset(f for f in bad if bad[f]), i in good, i in toxic))
    out = []
    for part, of in rows.items():
        removed = {o: [[] for _ in o] for o in map("".join, itertools.permutations("ABCDE"))}
        for r in of:
            for o, steps in removed.items():
                hit = [k for k, f in enumerate(o) if f in r[0]]
                if hit:
                    steps[hit[0]].append(r)
        total = collections.Counter()
        for o, steps in removed.items():
            for f, s in zip(o, steps, strict=True):
                total[f] += len(s)
        for o, steps in removed.items():
            left = len(of)
            for k, (f, s) in enumerate(zip(o, steps, strict=True), 1):
                left -= len(s)
                again = sum(f in r[0] for r in of) - len(s)
                out.append((part, o, k, left, len(s), again, sum(r[0] == {f} for r in of), sum(r[1] for r in s), sum(r[2] for r in s), total[f]))
    return sorted(out)


def test_filter_interactions(spark):
    rng = random.Random(5)
    texts = [None, "", "Few Words", "a#b", " ".join(f"w{i}" for i in range(250)), "same " * 300, " ".join(f"X{i}|" for i in range(300)), "Big " + "x" * 90, "ÀÉ é" * 60]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(150)]
    docs += [(1000 + i, "hot copy of a text", "en") for i in range(80)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 40, 2), *range(0, 40, 4), None, 1001]]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in filter_audit.audit(d, lab).collect()) == interactions(docs, labels)


def test_filter_interactions_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    want = interactions([(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()], [tuple(r) for r in labels.collect()])
    assert sorted(tuple(r) for r in filter_audit.audit(odd, labels).collect()) == want
    assert filter_audit.audit(empty, labels.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_plain_changes_visit_each_order_once(n):
    at, seen = list(range(n)), {tuple(range(n))}
    for i in filter_audit.plain_changes(n):
        at[i], at[i + 1] = at[i + 1], at[i]
        assert tuple(at) not in seen
        seen.add(tuple(at))
    assert len(seen) == len(list(itertools.permutations(range(n))))


def test_level_swaps_keep_the_counts():
    rng = random.Random(0)
    leaves = {m: (rng.randint(0, 3), m) for m in range(16) if rng.random() < 0.7}
    d = filter_audit.Diagram(leaves, 4)
    for level in (0, 2, 1, 1, 2, 0, 1):
        d.swap(level)
        for m in range(16):
            node = d.root
            for f in d.order:
                node = (d.high if m >> f & 1 else d.low)[node]
            assert tuple(d.weight[node]) == leaves.get(m, (0, 0))
        assert d.weight[d.root].tolist() == [sum(x) for x in zip(*leaves.values(), strict=True)]


# --- packing


def fewest(items, capacity):
    """The least number of bins, by trying all."""
    best = len(items)
    items = sorted(items, reverse=True)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, [r - items[i] if j == k else r for j, r in enumerate(rooms)])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def filled(bins):
    return collections.Counter(x for b in bins for x, k in b.runs for _ in range(k * b.times))


@settings(max_examples=300, deadline=None)
@given(st.integers(4, 24).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_reduction_keeps_a_best_packing(case):
    capacity, items = case
    counts = np.bincount(items, minlength=capacity + 1)
    fixed, left = packing.reduce(counts, capacity)
    rest = np.repeat(np.arange(capacity + 1), left).tolist()
    assert filled(fixed) + collections.Counter(rest) == collections.Counter(items)
    assert sum(b.times for b in fixed) + fewest(rest, capacity) == fewest(items, capacity)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_in_classes_is_best_fit_by_piece(items):
    bins = packing.best_fit(np.bincount(items, minlength=31), 30)
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= x]
        room = min(fits, default=30)
        if fits:
            rooms.remove(room)
        rooms.append(room - x)
    assert filled(bins) == collections.Counter(items)
    assert sorted(30 - sum(x * k for x, k in b.runs) for b in bins for _ in range(b.times)) == sorted(rooms)


def test_plan_size_is_bound_by_the_capacity():
    rng = np.random.default_rng(1)
    counts = np.concatenate([[0], rng.integers(0, 10**9, 512)])
    key, _, copies, sequence, offset = packing.plan(counts, 512)
    assert len(key) < 20 * 512
    bins = int(sequence.max()) + 1
    assert bins * 512 >= (counts * np.arange(513)).sum()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aZ é́ßİΣ's1.,!$<|>\n "), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words_have_the_ids_of_the_whole_text(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    ids, start = packing.encode_rows(pa.array([text, None, text + " it's <|endoftext|> don't $$rent!!"]), packing._coder(WORDS), 1)
    want = [whole.encode(t, add_special_tokens=False).ids + [1] for t in (text, "", text + " it's <|endoftext|> don't $$rent!!")]
    assert [ids[a:b].tolist() for a, b in zip(start[:-1], start[1:], strict=True)] == want


def check_packing(rows, docs, capacity=4096):
    """Every piece of every document once, gapless in its sequence, with the ids' checksum."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    want = []
    for i, t in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            want.append((i, k, a, len(part), zlib.crc32(part.tobytes())))
    none = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=none) == sorted(want, key=none)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing_of_the_table(spark, sf, table):
    rows = queries.QUERIES["op13_best_fit_packing"](spark, sf).collect()
    bins = check_packing(rows, [(r["doc_id"], r["text"]) for r in table("documents").select("doc_id", "text").collect()])
    assert bins <= 1.02 * -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packing_odd_rows(odd, empty):
    rows = packing.pack(odd, WORDS).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert packing.pack(empty, WORDS).collect() == []


def test_packed_sequences_hold_the_ids(make):
    docs = [(i, " ".join(["word", "ünï", "it's"] * (i * 7 % 40)), "a") for i in range(60)]
    packed = packing.pack(make(docs), WORDS, capacity=64, with_ids=True)
    rows = packed.collect()
    check_packing(rows, [d[:2] for d in docs], 64)
    of = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in rows:
        assert of[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert sum(map(len, of.values())) == packed.agg(F.sum("length")).first()[0]
