"""Joins, neighbours, mixing, main text and the pipeline against plain versions."""

import collections
import itertools
import pathlib
import re
import time
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from scanmill.llm import jaccard_join, main_text, mixing, queries, rp_forest
from scanmill.llm.components import components
from scanmill.llm.dealt import runs
from scanmill.session import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def same_rows(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    cur = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cur.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, sf, name):
    same_rows(spark, duck, sf, name)


# --- components


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 50)], [(5, 5)], [(9, 3), (3, 9), (9, 4), (20, 10), (10, 30)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in components(df).collect()} == roots(nodes, [x for x in links if x[0] != x[1]])


def test_keys_across_batches():
    import pyarrow as pa

    key = [1, 1, 1, 1, 2, 3, 3, 3, 4, 4, 5]
    for cuts in itertools.combinations(range(1, len(key)), 3):
        ends = [0, *cuts, len(key)]
        batches = [pa.RecordBatch.from_pydict({"k": key[a:b], "v": list(range(a, b))}) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert [t.column("k").to_pylist() for t in runs(iter(batches), ["k"])] == [[1] * 4, [2], [3] * 3, [4] * 2, [5]]


# --- n-gram join


def grams(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def joined(docs):
    """(id, size, component) by all pairs; equal ids are one document."""
    sets = [(i, grams(t)) for i, t in docs if i is not None]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b)]
    of = roots({i for i, _ in sets}, links)
    return sorted((i, len(s), of[i]) for i, s in sets)


def near_copies(seed, n, words, change):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 500, words)]
    out = []
    for _ in range(n):
        t = list(base)
        for k in rng.integers(0, words, int(rng.integers(0, change + 1))):
            t[k] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(t))
    return out


def test_join_with_near_copies_and_shared_passages(make):
    passage = " ".join(f"p{k}" for k in range(60))
    texts = near_copies(1, 60, 80, 4) + near_copies(2, 60, 200, 6) + near_copies(3, 20, 7, 1) + [f"{t} {passage}" for t in near_copies(4, 40, 30, 30)]
    texts += ["A b c", "a B c", "a b c d", "a b c d e", "A B C D E", *[passage] * 5]
    rows = [((i * 37) % 1009, t, "a") for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in jaccard_join.join(make(rows)).collect())
    assert got == joined([(i, t) for i, t, _ in rows])


def test_units_of_a_frequent_key(make, monkeypatch):
    monkeypatch.setattr(jaccard_join, "UNIT", 8)
    rows = [(i, t, "a") for i, t in enumerate(near_copies(7, 70, 60, 5))]
    assert sorted(tuple(r) for r in jaccard_join.join(make(rows)).collect()) == joined([(i, t) for i, t, _ in rows])


def test_copies_meet_once_not_at_each_shared_ngram(make, monkeypatch):
    met = []
    candidates = jaccard_join._candidates

    def spy(meet, *args):
        pairs = candidates(meet, *args)
        met.append((meet.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(jaccard_join, "_candidates", spy)
    words = [[f"w{k}x{i}" for i in range(200)] for k in range(20)]
    rows = [(2 * k + c, " ".join([*w[: 100 + 80 * c], "other", *w[101 + 80 * c :]]), "a") for k, w in enumerate(words) for c in (0, 1)]
    assert sorted(tuple(r) for r in jaccard_join.join(make(rows)).collect()) == joined([(i, t) for i, t, _ in rows])
    # each of the 40 texts has 41 n-grams to meet by, of which its copy has nearly all
    assert met[0][0] < 40 * 41 / 3 and met[0][1] == 20


def test_a_stored_table_leaves_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {p.name for folder in manager.localDirsString() for p in pathlib.Path(folder).rglob("shuffle_*.data")}

    before = files()
    df = spark.range(10_000).selectExpr("id % 100 AS k", "id").repartition(4, "k")
    got = stored(df)
    end = time.monotonic() + 30
    while (left := files() - before) and time.monotonic() < end:
        time.sleep(0.2)
    assert not left and got.count() == stored(got.join(df.select("id"), "id")).count() == df.count() == 10_000


def test_tree_loses_no_pair():
    rng = np.random.default_rng(0)
    t = Fraction(4, 5)
    sets = [np.unique(rng.integers(0, 4000, int(rng.integers(1, 150)))) for _ in range(120)]
    sets += [np.unique(np.concatenate([rng.choice(s, max(1, int(len(s) * 0.93)), replace=False), rng.integers(0, 4000, 2)])) for s in sets]
    counts = np.stack([np.bincount(s % jaccard_join.GROUPS, minlength=jaccard_join.GROUPS) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = jaccard_join.RTree(counts, sizes)
    links = 0
    for i, s in enumerate(sets):
        found = set(tree.search(counts[i], int(sizes[i]), t)[0].tolist())
        for j, o in enumerate(sets):
            shared = len(np.intersect1d(s, o))
            if 5 * shared >= 4 * (len(s) + len(o) - shared):
                links += i != j
                assert j in found
    assert links > 20


def test_join_odd_rows(odd, empty):
    got = jaccard_join.join(odd).collect()
    assert len(got) == odd.count()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] in (1, 2, 3, 4, 5)} == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 1, 5)}
    assert sorted((r["n_shingles"], r["component_id"] or -1) for r in got if r["doc_id"] is None) == [(0, -1), (2, 4)]
    assert jaccard_join.join(empty).count() == 0


def test_one_id_with_several_texts(make):
    a, b = "a b c d e f g", "h i j k l m n"
    got = jaccard_join.join(make([(7, a, "x"), (7, b, "x"), (2, a, "x"), (9, b, "x"), (5, "o p q r s", "x")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(7, 2), (2, 2), (9, 2), (5, 5)} and len(got) == 5


# --- neighbours


VECTORS = "vec_id long, embedding array<float>, label int"


def linked(rows):
    sound = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [
        (i, j)
        for (i, a, x), (j, b, y) in itertools.combinations(sound, 2)
        if x == y and len(a) == len(b) and (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) >= 0.93
    ]
    n = collections.Counter(x for p in links for x in p)
    of = roots({i for i, _, _ in rows if i is not None}, links)
    return sorted((i, n[i], of[i], of[i] == i) for i, _, _ in rows if i is not None)


def clusters(seed, n, length=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        centre = rng.normal(size=length)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows) * 3 % 5003, (centre + rng.normal(size=length) * 0.12).astype(np.float32).tolist(), int(k % 3)))
    return rows


@pytest.mark.parametrize("unit", [2048, 16])
def test_neighbours_recall(spark, monkeypatch, unit):
    monkeypatch.setattr(rp_forest, "UNIT", unit)
    monkeypatch.setattr(rp_forest, "LEAF", 16)
    rows = clusters(5, 150) + [(9000 + i, [1.0] * 16, 1) for i in range(40)]
    got = sorted(tuple(r) for r in rp_forest.neighbours(spark.createDataFrame(rows, VECTORS).repartition(5)).collect())
    want = linked(rows)
    assert [r[0] for r in got] == [r[0] for r in want] and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)


@pytest.mark.parametrize(("noise", "unit"), [(0.24, 2048), (0.1, 500)])
def test_neighbours_of_a_dense_group_in_deep_trees(spark, monkeypatch, noise, unit):
    monkeypatch.setattr(rp_forest, "LEAF", 8)
    monkeypatch.setattr(rp_forest, "UNIT", unit)
    rng = np.random.default_rng(21)
    centre, single = rng.normal(size=64), rng.normal(size=(3000, 64))
    group = centre / np.linalg.norm(centre) + noise * rng.normal(size=(2000, 64)) / 8
    pairs = np.concatenate([single[:1000], single[:1000] + 0.25 * rng.normal(size=(1000, 64)), single[1000:]])
    x = np.concatenate([group, pairs]).astype(np.float32)
    assert 8 < np.log2(len(pairs) / 8) < 10
    x64 = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (x64 @ x64.T >= 0.93).sum(1) - 1
    rows = [(i, v, 1) for i, v in enumerate(x.tolist())]
    got = {r["vec_id"]: r for r in rp_forest.neighbours(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    print("links of the group", found[:2000].sum() / want[:2000].sum(), "others", found[2000:].sum() / want[2000:].sum())
    assert (found <= want).all() and found[:2000].sum() >= 0.999 * want[:2000].sum() and found[2000:].sum() >= 0.95 * want[2000:].sum()
    assert all(got[i]["component_id"] == 0 for i in range(2000) if want[i] > 20)


def test_cells_of_groups_that_overlap_lose_no_link():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=8) + 0.8 * rng.normal(size=(12, 8))
    x = np.concatenate([centres[k % 12] + 0.25 * rng.normal(size=8) for k in range(1500)]).reshape(-1, 8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    groups = rp_forest.Groups.fit(x[:700], 0.93)
    home, inside = groups.place(x)
    assert len(groups.centres) > 3 and (home >= 0).any() and (inside.sum(1) > 1).any()
    i, j = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    last = len(groups.centres)
    first = np.minimum(np.where(home[i] < 0, last, home[i]), np.where(home[j] < 0, last, home[j]))
    some = first < last
    assert inside[i[some], first[some]].all() and inside[j[some], first[some]].all()


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, None], 1), (6, [1.0, 2.0], None), (7, [1.0, 2.0], 1), (8, [2.0, 4.0], 1)]
    rows += [(9, [1.0, 2.0], 1), (10, [1.0, 2.0], 2), (11, [], 1), (12, [1.0, 2.0, 0.0], 1), (13, [1e-30, 2e-30], 1), (14, [1e30, 2e30], 1), (None, [1.0, 2.0], 1), (15, [-1.0, -2.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("mine") for c in ("id", "n_links", "kept", "codes")})
    got = rp_forest.neighbours(df).collect()
    assert sorted(tuple(r) for r in got if r["vec_id"] is not None) == linked(rows)
    assert [tuple(r) for r in got if r["vec_id"] is None] == [(None, 0, None, True)]
    assert rp_forest.neighbours(df.limit(0)).count() == 0


# --- mixing


def filled(sizes, weights):
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while free:
        share = sum(weights[i] for i in free)
        over = {i for i in free if rest * weights[i] / share > 3 * sizes[i]}
        if not over:
            for i in free:
                target[i] = rest * weights[i] / share
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
        rest -= sum(target[i] for i in over)
        free -= over
    return target


@pytest.mark.parametrize("per", [[10, 400, 30, 5, 900, 2, 60], [100], [0, 0, 50], [1, 1, 1000, 1]])
def test_targets_are_the_reshared_ones(make, per):
    rows = [(k * 100 + j, " ".join(["w"] * (n // 5)), None if k == len(per) - 1 else chr(97 + k)) for k, n in enumerate(per) for j in range(5)]
    got = mixing.mix(make(rows)).groupBy("source").agg(F.first("target").alias("t"), F.first("source_size").alias("s"), F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [n // 5 * 5 for n in per]
    np.testing.assert_allclose([r["t"] for r in got], filled(sizes, [(1, 2, 3)[k % 3] for k in range(len(per))]), rtol=1e-12, atol=1e-9)
    assert [r["s"] for r in got] == sizes
    assert all(r["taken"] <= 3 * r["s"] and abs(r["taken"] - r["t"]) <= max(1, r["s"] / 5) for r in got)


def test_fill_is_exact_where_a_subset_is():
    rng = np.random.default_rng(8)
    for exact in (50, 20_000):
        for _ in range(30):
            lengths = np.sort(rng.choice(np.arange(1, 60), 8, replace=False))
            counts = rng.integers(1, 6, 8)
            budget = int(rng.integers(0, (lengths * counts).sum() + 1))
            take = mixing.fill(lengths, counts, budget, exact)
            got = int((take * lengths).sum())
            assert (take >= 0).all() and (take <= counts).all() and got <= budget
            reach = {0}
            for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
                reach = {r + k * n for r in reach for k in range(c + 1)}
            best = max(r for r in reach if r <= budget)
            assert best - got <= 60


@pytest.mark.parametrize("lengths,counts,budget,best", [([21_000, 22_000, 23_000], [1, 1, 1], 50_000, 45_000), ([25_000, 30_000], [2, 1], 50_000, 50_000), ([25_000, 33_000], [4, 3], 100_000, 100_000), ([90_000, 100_001], [3, 2], 290_001, 280_001)])
def test_fill_with_very_long_documents(lengths, counts, budget, best):
    take = mixing.fill(np.array(lengths), np.array(counts), budget)
    assert (take <= counts).all() and int((take * lengths).sum()) == best


def test_fill_of_long_documents_is_the_best_subset():
    rng = np.random.default_rng(12)
    for _ in range(25):
        lengths = np.sort(rng.choice(np.arange(1_000, 90_000), 5, replace=False))
        counts = rng.integers(1, 4, 5)
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fill(lengths, counts, budget)
        sums = {sum(k * n for k, n in zip(ks, lengths.tolist(), strict=True)) for ks in itertools.product(*(range(c + 1) for c in counts))}
        assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == max(x for x in sums if x <= budget)


def test_equal_rows_are_split(make):
    rows = [(1, "w " * 10, "a")] * 40 + [(k, "w " * 7, "b") for k in range(2, 42)] + [(99, "w " * 3, None)] * 50
    mixed = mixing.mix(make(rows).withColumn("_nth", F.lit("mine"))).cache()
    assert mixed.count() == len(rows)
    for r in mixed.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.max("mix_size").alias("size")).collect():
        assert abs(r["taken"] - r["t"]) <= r["size"]
    a = {r["mix_copies"] for r in mixed.where("source = 'a'").collect()}
    assert len(a) == 2


def test_documents_without_words_beside_others(make):
    assert mixing.fill(np.array([0, 3, 5]), np.array([4, 2, 2]), 8).tolist() == [0, 1, 1]
    texts = {"a": [None, "", " \n", *["w " * n for n in (3, 4, 5, 6)]], "b": ["", *["w " * n for n in (2, 5, 7)]], "c": [None, "w w", "w"]}
    got = mixing.mix(make([(k * 100 + i, t, s) for k, (s, ts) in enumerate(texts.items()) for i, t in enumerate(ts)])).collect()
    assert len(got) == sum(map(len, texts.values()))
    for s in texts:
        rows = [r for r in got if r["source"] == s]
        whole = int(rows[0]["target"] // rows[0]["source_size"])
        assert all(r["mix_copies"] == whole for r in rows if r["mix_size"] == 0)
        assert abs(sum(r["mix_size"] * r["mix_copies"] for r in rows) - rows[0]["target"]) <= 2
    partial = {r["target"] % r["source_size"] for r in got}
    assert any(0 < p for p in partial)


def test_mix_on_the_table(spark, sf):
    query = queries.QUERIES["op10_source_mix"]
    got = sorted(tuple(r) for r in query(spark, sf).collect())
    assert got == sorted(tuple(r) for r in query(spark, sf).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs}
    assert {r[0]: r[1] for r in got} == size
    assert all(r[4] in (0, r[1], 2 * r[1], 3 * r[1]) for r in got)
    by = collections.defaultdict(lambda: [0.0, 0])
    source = {r["doc_id"]: r["source"] for r in docs}
    for i, _, _, target, taken in got:
        by[source[i]] = [target, by[source[i]][1] + taken]
    assert all(abs(t - n) <= 0.02 * t + 1 for t, n in by.values())


def test_mix_odd_rows(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["mix_copies"] <= 3 for r in got) and {r["label"] for r in got} == {"mine"}
    assert mixing.repeated(mixing.mix(odd), odd.columns[:5]).count() == sum(r["mix_copies"] for r in got)
    assert mixing.mix(empty).count() == 0


# --- main text


@pytest.mark.parametrize("page", ["<b>x" * 20_000, "<a " * 40_000, "<p>x" + "<a " * 40_000 + ">", "<b>" * 20_000 + "</b>" * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<p><b>x" * 20_000])
def test_pages_of_unclosed_tags_take_linear_time(page):
    """Twice the page takes about twice the time; walks over all open tags would take seconds."""
    start = time.process_time()
    main_text.extract(page, main_text.Weights())
    assert time.process_time() - start < 2


def test_what_goes_on_to_the_end_of_a_page():
    for tail in ("<!-- a <b>c</b> d", "<!-- no end", "<script>x > y", "<style>p", "<!-->x"):
        assert main_text.extract("<p>one two</p>" + tail, main_text.Weights({}, {"p": -0.1, "/p": -0.1})) == "one two"
    assert main_text.extract("<p>one two 3 < 4", main_text.Weights({}, {"p": -0.1})) == "one two 3 < 4"


def test_main_text_of_pages(spark, sf):
    got = {r["page_id"]: r for r in queries.QUERIES["op9_main_text"](spark, sf).collect()}
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1].replace("<br>", " ")
        blocks = re.split(r"</?(?:p|h1)>", article)
        want = "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub("<[^>]*>", "", b)).split())))
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


PAGE = """<html><head><title>A title of five words</title><style>p{}</style></head><body><div class="cookie-notice">We use many cookies on this site today</div>
<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">News &amp; more</a></li></ul></nav><header><p>Some header words here</p></header>
<div id="content"><h2>Head &mdash; line</h2><p>First   para&shy;graph with <b>bold</b> and <a href="x>y">a link</a>.<p>Second one,
unclosed<div class="ad">Buy this thing now it is cheap</div><!-- not <p>this</p> --><ul><li>item one<li>item two</ul>
<form><label>Your name please</label></form><script>var p = "<p>no</p>";</script><p>Last words of the article 1 &lt; 2 &#x41;</p></div>
<section class="comments"><p>Nice article, I liked reading it a lot</p></section><aside>Related things to read</aside><footer><p>Copyright and all that</p></footer></body></html>"""


def test_boilerplate_and_blocks():
    text = main_text.extract(PAGE, main_text.Weights())
    want = ["Head — line", "First para\xadgraph with bold and a link.", "Second one, unclosed", "item one", "item two", "Last words of the article 1 < 2 A"]
    assert text.split("\n")[-6:] == want


BODY = "<p>First words of the text here.</p><p>More words follow in this one.</p>"
TEXT = "First words of the text here.\nMore words follow in this one."


@pytest.mark.parametrize("kind", ["no-sidebar", "has-sidebar", "content with-nav", "post header-image", "search-results", "not-ad", "main_no_comments"])
def test_classes_that_only_hold_a_boilerplate_word(kind):
    for page in (f'<html><body class="{kind}">{BODY}</body></html>', f'<div class="{kind}">{BODY}</div><div>Other words that stand outside, as many as there are inside, or some more of them</div>'):
        assert main_text.extract(page, main_text.Weights({}, {"body": -0.1})).startswith(TEXT)


@pytest.mark.parametrize("tag", ["body", "article", "main", "html"])
def test_page_elements_are_never_boilerplate(tag):
    assert main_text.extract(f'<{tag} class="header search">{BODY}</{tag}>', main_text.Weights()) == TEXT


def test_wrappers_of_the_whole_page():
    nav = "<nav>Home and more</nav>"
    for start, end in (("<form>", "</form>"), ('<div class="modal">', "</div>"), ("<header>", "</header>")):
        assert main_text.extract(f"<body>{start}{nav}<h1>Head</h1>{BODY}<footer>Foot of it</footer>{end}</body>", main_text.Weights()).replace("\nHead", "Head").endswith(TEXT)
        assert "Home" not in main_text.extract(f"<body>{start}{nav}{BODY}{end}</body>", main_text.Weights())
    for more in ('<section class="comments">', '<div class="ad-banner">', "<form>", "<nav>", '<div id="cookie_notice" class="x">'):
        page = f"<article>{BODY}</article>{more}{'<p>many other words that are no text</p>' * 9}</{more[1:].split()[0].strip('>')}>"
        assert main_text.extract(page, main_text.Weights()) == TEXT


def test_best_run_is_the_maximum():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(-5, 5, int(rng.integers(0, 12))).tolist()
        a, b = main_text.best_run(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


def test_pages_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "v", "just words, no tags at all"), (None, "w", "<p>x"), (3, "v", "just words, no tags at all"), (4, "x", "<!-- open"), (5, "y", "<" * 2000 + '<a "' * 300), (6, "z", "<p>" + "word " * 60_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = main_text.main_text(df).collect()
    assert sorted((r["page_id"] or 0, r["text"][:30]) for r in got if r["page_id"] != 5) == sorted([(1, ""), (2, ""), (3, "just words, no tags at all"), (0, "x"), (3, "just words, no tags at all"), (4, ""), (6, ("word " * 6))])
    assert len(got) == len(rows) and main_text.main_text(df.limit(0)).count() == 0


# --- pipeline


def test_stages_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = (docs, out := stage(spark, docs, sf))
        out = out.cache()
        docs = out
        if name != "encoding":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = steps["near_duplicates"]
    groups = joined([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, _, c in groups})
    before, after = steps["personal_data"]
    assert before.count() == after.count() and not after.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count()
    assert after.where("n_chars <> length(text)").count() == 0
    before, after = steps["source_mix"]
    copies = {r["doc_id"]: r["mix_copies"] for r in mixing.mix(before).collect()}
    assert collections.Counter(r["doc_id"] for r in after.collect()) == {k: v for k, v in copies.items() if v}
    before, after = steps["encoding"]
    import hashlib

    want = collections.Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in before.collect())
    assert collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in after.collect()) == want


def test_stages_on_odd_rows(spark, odd, empty, sf):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "encoding" or out.columns == odd.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert stage(spark, empty, sf).count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
