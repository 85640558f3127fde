"""WARC, Jaccard, top-k, dedup, HTML, pipeline: against brute force and round trips."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm import op03_warc as w
from quern.llm import op04_jaccard as j
from quern.llm import op05_topk as k
from quern.llm import op07_dedup as d
from quern.llm import op08_html as h
from quern.llm import suffix


def test_components(spark):
    rng = random.Random(1)
    for n in (0, 5, 60):
        edges = [(rng.randint(0, 50), rng.randint(0, 50)) for _ in range(n)] + [(i, i + 1) for i in range(100, 100 + n)]
        got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        parent = {x: x for e in edges for x in e}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# WARC


def test_warc_round_trip(spark):
    big, inner = "x" * 1500, gzip.compress(w.record("response", 99, "u", "00" * 20, 3, b"abc")).decode("latin-1")
    rows = [(1, "u1", big), (2, "u2", big), (3, "u3", "short"), (4, "u4", "short"), (5, None, None), (6, "u\r\nX: y", inner * 50), (None, "n", big), (7, "l", "long é " * 100_000), (2, "u2", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    root = common.shared_path(spark, "warc-test")
    files = w.write_archives(df, root)
    for split in (97, 5000, 1 << 20):
        out = w.read_archives(files, root, split).collect()
        assert len(out) == len(rows)
        for r in out:
            html = next((x or "" for i, _, x in rows if i == r["page_id"]), None)
            assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest() and r["digest_ok"]
            assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if html == big and r["page_id"] != 2 else ("response", None))
    empty = w.write_archives(df.limit(0), common.shared_path(spark, "warc-test"))
    assert empty.count() == 0 and w.read_archives(empty, root).count() == 0


def test_magic_inside_payloads_is_rejected(spark, tmp_path):
    """A stored member that holds whole archives without compression: all inner records are candidates."""
    import zlib

    fake = b"".join(w.member(w.record("response", i, "f", "00" * 20, 5, b"inner")) for i in range(20))

    def stored(data):
        c = zlib.compressobj(0, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    real = [w.record("response", i, "r", hashlib.sha1(fake).hexdigest(), len(fake), fake) for i in range(100, 130)]
    data = b"".join(stored(x) for x in real)
    (tmp_path / "a.warc.gz").write_bytes(data)
    files = spark.createDataFrame([("a.warc.gz", len(data), 30)], "file string, bytes long, records long")
    for split in (64, 1000, 1 << 20):
        found = w.read_archives(files, f"file://{tmp_path}", split)
        assert sorted(r["page_id"] for r in found.collect()) == list(range(100, 130))
        assert w.candidates(files, f"file://{tmp_path}", split).count() > 100


# Jaccard


def brute_classes(rows):
    sets = [(i, j.shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for m, y in sets[:a]:
            if i is not None and m is not None and len(x) and len(y) and j.similar(len(np.intersect1d(x, y)), len(x), len(y)):
                p, q = find(i), find(m)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets if i is not None}


@pytest.mark.parametrize("block", [2, 1000])
def test_classes_equal_brute_force(spark, block):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        base = [f"v{rng.randint(0, 500)}" for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"z{rng.randint(0, 9999)}"
            rows.append((len(rows) * 3 + 1, " ".join(own) if g % 2 else "\n".join(own).upper()))
    rows += [(900, None), (901, ""), (902, " \t "), (903, "a b"), (904, "A  B"), (905, "word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.jaccard_classes(df, block_sets=block).collect()}
    assert got == brute_classes(rows)


def test_jaccard_of_odd_tables(spark):
    # a null id is no row but a link between others; two texts of one id join the classes of both
    long = " ".join(f"n{i}" for i in range(40))
    three = [(20, long + " x"), (None, long), (30, long[: long.index("n1 ")] + "y " + long[long.index("n1 ") :])]
    assert {tuple(r) for r in j.jaccard_classes(spark.createDataFrame(three, "doc_id long, text string")).collect()} == {(20, 37, 20), (30, 37, 20)}
    other = " ".join(f"m{i}" for i in range(40))
    several = [(1, long), (1, other), (2, long + " x"), (3, other + " y")]
    assert {(r["doc_id"], r["component_id"]) for r in j.jaccard_classes(spark.createDataFrame(several, "doc_id long, text string")).collect()} == {(1, 1), (2, 1), (3, 1)}
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "other words that are not the same")], "doc_id long, text string")
    assert sorted(tuple(r) for r in j.jaccard_classes(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 3, 2)]
    assert j.jaccard_classes(df.limit(0)).count() == 0
    rows = [(5, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (4, None, 3), (None, "a b c d e f", 4), (None, None, None)]
    kept = j.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, c int"))
    assert sorted(((r["doc_id"], r["c"]) for r in kept.collect()), key=str) == [(3, 2), (4, 3), (None, 4), (None, None)]
    assert j.one_of_each(kept.limit(0)).count() == 0


def test_rows_of_an_id_with_other_texts_stay(spark):
    a, b, c, e = ("a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x")
    rows = [(1, a, 1), (5, b, 2), (5, a.upper(), 3), (5, b, 4), (5, c, 5), (7, c, 6), (7, e, 7), (8, None, 8), (8, b + " y", 9), (8, e, 10)]
    kept = j.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, c int").repartition(3))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (5, c), (7, e), (8, None), (8, b + " y")], key=str)


def test_sift_keeps_every_pair_that_fits():
    rng = random.Random(4)
    for _ in range(300):
        sets = {i: (rng.randint(1, 30), i) for i in range(8)}
        rows = sorted({(t, sets[i][0], i, rng.randrange(sets[i][0])) for t in range(4) for i in rng.sample(range(8), rng.randint(0, 6))} | {(9, 4, i, 0) for i in range(rng.choice([0, 6]))})
        rows = [r for k, r in enumerate(rows) if k == 0 or r[:3] != rows[k - 1][:3]]
        rows = sorted(rows + rng.sample(rows, len(rows) // 3))
        most = rng.choice([3, 1000])
        a = np.array(rows, np.int64).reshape(-1, 4)
        cuts = sorted(rng.randint(0, len(a)) for _ in range(rng.randint(0, 5)))
        got = {(t, i): k for p in j.sift(iter([(p[:, 0], p[:, 2], p[:, 1], p[:, 3], np.zeros(len(p), np.int64)) for p in np.split(a, cuts)]), 80, most) for t, i, _, _, k in zip(*(c.tolist() for c in p), strict=True)}
        of = Counter(t for t, *_ in set(rows))
        for t, n, i, x in rows:
            fits = any(u == t and m != i and 80 * n <= 100 * k and 80 * k <= 100 * n and k <= j.widest(n, x) and n <= j.widest(k, y) for u, k, m, y in rows)
            assert (t, i) in got or not fits
            assert of[t] > 1 or (t, i) not in got
        assert not got or max(got.values()) <= max(most, max(of.values()))


def test_bitmaps_lose_no_similar_pair():
    rng = np.random.default_rng(5)
    lost = 0
    for _ in range(300):
        base = rng.integers(0, 1 << 63, rng.integers(2, 400)).astype(np.uint64)
        other = base.copy()
        other[rng.random(len(base)) < rng.random() * 0.3] += np.uint64(1)
        x, y = np.unique(base), np.unique(np.r_[other, rng.integers(0, 1 << 63, rng.integers(0, 30)).astype(np.uint64)])
        n = np.array([len(x), len(y)])
        close = list(j.close_pairs(n, n * 2, np.array([0, 1]), [j.bitmap(x), j.bitmap(y)], np.array([0]), np.array([1])))
        if j.similar(len(np.intersect1d(x, y)), *n.tolist()):
            assert close
        lost += not close
    assert lost > 20


def letters(n, seed=3):
    """Form letters of 6 out of 40 passages each, with a few near copies among them."""
    rng = random.Random(seed)
    passages = [" ".join(f"p{k}w{rng.randint(0, 10**6)}" for _ in range(20)) for k in range(40)]
    rows = []
    for i in range(n):
        if i % 50 == 49:
            words = rows[-1][1].split()
            words[rng.randrange(len(words))] = "changed"
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.sample(passages, 6))))
    return rows


def test_form_letters_make_no_giant_units(spark, monkeypatch):
    """Nearly all letters share passages, hardly any two are near copies."""
    moved = {}
    keep = j.stored

    def stored(df, name):
        out = keep(df, name)
        if name in ("jaccard-shared", "jaccard-left", "jaccard-units"):
            moved.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(j, "stored", stored)
    for n in (1000, 2000):
        rows = letters(n)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        got = {r["doc_id"]: r["component_id"] for r in j.jaccard_classes(df, block_sets=100).collect()}
        sets = [frozenset(j.shingle_set(t).tolist()) for _, t in rows]
        by = defaultdict(list)
        for i, s in enumerate(sets):
            for x in s:
                by[x].append(i)
        want = list(range(n))

        def find(x):
            while want[x] != x:
                x = want[x]
            return x

        for i, s in enumerate(sets):
            for m, k in Counter(m for x in s for m in by[x] if m < i).items():
                if j.similar(k, len(s), len(sets[m])):
                    a, b = find(i), find(m)
                    want[max(a, b)] = min(a, b)
        assert got == {i: find(i) for i in range(n)}
    # rows grow in proportion, and what comes to trees by bitmaps is little
    assert moved["jaccard-shared"][1] < 3 * moved["jaccard-shared"][0] + 1000
    assert moved["jaccard-left"][1] < 5 * moved["jaccard-left"][0] + 1000
    assert moved["jaccard-units"][1] < 200


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(150)] = f"x{rng.randint(0, 10**9)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for together in (1 << 16, 64):
        got = {r["doc_id"]: r["component_id"] for r in j.jaccard_classes(df, block_sets=10, together=together).collect()}
        assert got == {i: c for i, (_, c) in brute_classes(rows).items()}


def test_positions_of_long_texts_fit_their_bits():
    rng = np.random.default_rng(8)
    texts = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in (d.TOGETHER - 1, d.TOGETHER + d.LEAST - 1)]
    of = lambda some: [x for runs in d.runs_of(some) for x in zip(*(c.tolist() for c in runs), strict=True)]
    assert [x[1:] for x in of(texts)] == [x[1:] for t in texts for x in of([t])]


# top-k


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (400, 8)).astype(np.float32)
    v[50:150] = v[50]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1100, [None] * 8), (1200, [float("nan")] * 8), (1300, [float("inf")] * 8), (None, [1.0] * 8), (1400, [1.0, 2.0]), (1500, []), (1600, [3e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    vectors = common.stored(k.quantise(df), "t")
    got = defaultdict(list)
    for r in k.top_k(vectors, vectors.where("id % 100 = 0"), block=2, pivots=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ints = {i: [int(np.floor(1024 * np.float64(np.float32(a)))) for a in x] for i, x in rows if i is not None and x is not None and all(a is not None and np.isfinite(a) for a in x)}
    for q in [i for i in ints if i % 100 == 0]:
        s = sorted((-max(-k.LONG, min(k.LONG, sum(a * b for a, b in zip(ints[q], x, strict=True)))), i) for i, x in ints.items() if i != q and len(x) == len(ints[q]))[:10]
        assert got.get(q, []) == [(i, -p) for p, i in s], q
    assert not {1000, 1100, 1200, 1300} & set(got)
    none = k.quantise(df.limit(0))
    assert k.top_k(none, none).count() == 0


def test_topk_of_queries_that_repeat_an_id(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(6)]
    asked = [(100, [2.0, 1.0]), (100, [1.0, 2.0]), (101, [1.0, 2.0]), (101, [2.0, 1.0]), (101, [1.0, 2.0])]
    vectors, queries = (common.stored(k.quantise(spark.createDataFrame(x, "vec_id long, embedding array<float>").coalesce(1)), "t") for x in (rows, asked))
    got = k.top_k(vectors, queries, k=3).orderBy("query_id", "rank").collect()
    # the smaller vector, (1, 2), is nearest to the even ones
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(q, i) for q in (100, 101) for i in (0, 2, 4)]


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(0, 500, (300, 16)) * rng.choice([1, 1, 20, 1e12], (300, 1)))
    n2 = (x * x).sum(1)
    p = k.PivotTable(k.far_apart(x, 12))
    for pivots in (p, k.PivotTable(k.far_apart(np.r_[x[:3], x[:3] * 2, x[:1] + x[1:2]], 12))):
        rows = k.Rows(np.arange(300), x, n2, pivots.rows(x, n2), pivots)
        for i in range(20):
            q = k.Query(i, x[i], pivots)
            assert (pivots.alone(rows.table, n2, q.far, q.q2) >= x @ q.q).all()
            assert (pivots.together(*rows.span, q) >= x @ q.q).all()


def test_most_rows_of_clusters_are_not_evaluated():
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1000, (40, 32))
    x = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 120, (6000, 32)))
    x[0] *= 30  # a vector of large norm spoils no other's bound
    ids, n2 = np.arange(len(x)), (x * x).sum(1)
    some = rng.choice(len(x), 600, replace=False)
    p = k.PivotTable(k.far_apart(x[some], 24))
    rows = k.Rows(ids, x, n2, p.rows(x, n2), p)
    asked = [(int(i), x[i]) for i in rng.choice(np.arange(1, len(x)), 40, replace=False)]
    evaluated = 0
    for (i, q), least in zip(asked, k.least_scores(ids[some], x[some], asked, 10), strict=True):
        best, n = k.search_block(rows, k.Query(i, q, p, least), 10, [])
        evaluated += n
        s = (x @ q).astype(np.int64)
        assert best == sorted((-int(s[j]), j) for j in range(len(x)) if j != i)[:10]
    assert evaluated < 0.3 * 40 * len(x)


def test_pivots_together_leave_out_most_random_vectors():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (20_000, 64))
    x = np.floor(1024 * x / np.sqrt((x * x).sum(1))[:, None])
    n2, ids = (x * x).sum(1), np.arange(len(x))
    p = k.PivotTable(k.far_apart(x[:4096], k.PIVOTS))
    rows = k.Rows(ids, x, n2, p.rows(x, n2), p)
    asked = [(i, x[i]) for i in range(5000, 5020)]
    evaluated = sum(k.search_block(rows, k.Query(i, q, p, t), 10, [])[1] for (i, q), t in zip(asked, k.least_scores(ids[:4096], x[:4096], asked, 10), strict=True))
    assert evaluated < 0.2 * 20 * len(x)


# dedup


def brute_dedup(rows, least):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = []
        for a in range(len(raw) - least + 1):
            s = raw[a : a + least]
            if s in seen:
                gone.append((a, a + least))
            seen.add(s)
        g, kept, at = d.merged(gone), b"", 0
        for a, b in g:
            kept, at = kept + raw[at:a], b
        out[i] = (len(raw), sum(b - a for a, b in g), len(g), kept + raw[at:])
    return out


@pytest.mark.parametrize("hot,shard", [(4000, 1 << 20), (2, 500)])
def test_dedup_equals_brute_force(spark, hot, shard):
    rng = random.Random(7)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(60, 260))) for _ in range(6)]
    rows = []
    for i in range(60):
        rows.append((i * 2, "".join(rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 150))) for _ in range(rng.randint(0, 5)))))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, "a" * 700), (505, "ab" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in d.dedup(df, hot_runs=hot, shard_bytes=shard).collect()}
    assert got == brute_dedup(rows, 100)


def test_dedup_of_odd_rows(spark):
    rng = random.Random(8)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (3, "x" + t), (3, "y" * 150)], "doc_id long, text string")
    out = Counter((r["doc_id"], r["n_removed"]) for r in d.dedup(df).collect())
    assert out == Counter({(1, 0): 2, (2, 300): 1, (None, 0): 1, (3, 300): 1, (3, 149): 1})
    assert d.dedup(df.limit(0)).count() == 0


def test_suffix_arrays():
    rng = random.Random(9)
    for _ in range(400):
        t = np.array([rng.randint(0, rng.choice([0, 1, 2, 25])) for _ in range(rng.randint(1, 50))])
        t = np.tile(t, 3) if rng.random() < 0.4 else t
        x = t.tolist()
        want = sorted(range(len(x)), key=lambda i: x[i:])
        assert suffix.suffix_array(t).tolist() == want
    # names that recur need more than one recursion; wide alphabets are scanned by place
    for wide in (np.array([rng.randint(0, 3000) for _ in range(4000)]), np.tile([rng.randint(0, 2000) for _ in range(300)], 4), np.tile([2, 1, 2, 0, 1], 300)):
        x = wide.tolist()
        want = sorted(range(len(x)), key=lambda i: x[i:])
        assert suffix.suffix_array(wide).tolist() == want
        t = np.r_[wide + 1, 0]
        assert suffix._array_of(t, int(t.max()) + 1).tolist()[1:] == want


# HTML


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<nav>n</nav><article><h1>T</h1><p>a <b>b</b>\n c<br>d</p></article><footer>f</footer>", "T\na b c d"),
    ("<body><div class='comments'>c</div><p>x &amp;lt; &eacute;&nbsp; y</p><script>var a='</p>';</script></body>", "x &lt; é y"), ("<main><p>m</p><aside>s</aside></main><p>out</p>", "m"),
    ("<article><header>h</header><p>k</p><form>f</form><ul><li>1<li>2</ul></article>", "k\n1\n2"), ("<article><p>a</p><section id='comments'><article class='comment'><p>c</p></article></section></article>", "a"),
    ("<div id=cookie-notice>ok?</div><div hidden>h</div><p>t", "t"), ("<p>unclosed <a href='x", "unclosed"), ("<article>a < b<!-- no --></article>", "a < b"),
])
def test_main_text(page, text):
    assert h.main_text(page) == text


def test_wrappers():
    pages = [f"<body><div class=top>Site</div><ul>{'<li>i</li>' * n}</ul><p>{c}</p>{'<h2>opt</h2>' if n > 2 else ''}</body>" for n, c in ((1, "x"), (3, "y"), (4, "z"))]
    whole = h.wrapper_of(pages)
    assert h.constants(whole) >= {"Site"} and not {"x", "y", "z"} & h.constants(whole)
    assert any(x[0] == "+" for x in whole) and any(x[0] == "h2" and x[2] for x in whole)
    assert h.main_text(pages[0], h.constants(whole)) == "i\nx" or "x" in h.main_text(pages[0], h.constants(whole))


def test_extract(spark):
    rows = [(1, "http://a.com/1", "<p>x</p>"), (2, None, None), (3, "https://A.com:80/2", "<article>y</article>"), (3, "https://A.com:80/2", "<article>y</article>"), (4, "http://b.org", "<p>" + "w " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    ws = h.learn_wrappers(df)
    one = sorted(tuple(r) for r in h.extract(df, ws).select("page_id", "text").collect())
    two = sorted(tuple(r) for r in h.extract(df, ws, limit=0).select("page_id", "text").collect())
    assert one == two and one[:4] == [(1, "x"), (2, ""), (3, "y"), (3, "y")]
    assert h.extract(df.limit(0), h.learn_wrappers(df.limit(0))).count() == 0


def test_copies_of_div_pages_keep_their_text(spark):
    body = "<h1>Heading</h1><p>Some words of the body.</p><blockquote>More words of it.</blockquote>"
    menu = "<div>Home</div><div>News</div><div>About</div>"
    rows = [(i, "http://copies.com/", f"<a href=/{i}>{body}</a><script>{i}</script>") for i in range(6)]  # one text, other links
    rows += [(10 + i, "http://near.com/", f"<div>Day {i}</div>{body}") for i in range(6)]  # near copies
    rows += [(20 + i, "http://tail.com/", f"<div id=s{i}>{body}{'<div>The tail.</div>' * (i > 1)}</div>") for i in range(6)]  # two texts, one with a tail
    rows += [(30 + i, "http://menu.com/", f"{menu}<div>Article number {i} is of {i * i} words and no more.</div>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    text = "Heading\nSome words of the body.\nMore words of it."
    for limit in (1 << 20, 0):
        got = {r["page_id"]: r["text"] for r in h.extract(df, h.learn_wrappers(df, limit=limit), limit=limit).collect()}
        assert [got[i] for i in range(6)] == [text] * 6
        assert [got[10 + i] for i in range(6)] == [f"Day {i}\n{text}" for i in range(6)]
        assert [got[20 + i] for i in range(6)] == [text] * 2 + [text + "\nThe tail."] * 4
        assert [got[30 + i] for i in range(6)] == [f"Article number {i} is of {i * i} words and no more." for i in range(6)]


def test_wrappers_decide_on_all_pages():
    def texts(pages):
        whole = h.wrapper_of(pages)
        return [h.main_text(p, h.constants(whole), h.region_of(whole)) for p in pages]

    words = [f"Article {i} has {i * i} words, all of its own, and a second sentence number {i + 7} that makes it long enough." for i in range(6)]
    menu = "<div>Home</div><div>News</div><div>About</div>"
    # a folded menu, a varying line beside the region, a title outside
    assert texts([f"<div class=m>{menu}</div><h1>T{i}</h1><div class=c><div>{w}</div><div>More {i}</div></div><div class=x>v{i}</div>" for i, w in enumerate(words)]) == [f"T{i}\n{w}\nMore {i}" for i, w in enumerate(words)]
    # of two articles that of the region; a constant line in it goes, its short first line stays
    assert texts([f"<article><i>By {i}</i><p>{w}</p><p>Send us a letter</p></article><div><article>v{i}</article></div>" for i, w in enumerate(words)]) == [f"By {i}\n{w}" for i, w in enumerate(words)]
    # the article is the check: a region outside it is not followed
    assert texts([f"<div class=c>{w}</div><article>v{i}</article>" for i, w in enumerate(words)]) == [f"v{i}" for i in range(6)]


# pipeline


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = common.stored(stage(spark, docs, sf), "t")
        assert out.columns == docs.columns, name
        if name.startswith("n-gram"):
            want = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
            assert {r["doc_id"] for r in out.collect()} == {i for i, (_, c) in want.items() if c == i}
        docs = out
    last = p.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and last.where("size(ids) <> n_tokens").count() == 0
    assert sorted(r["doc_id"] for r in p.run(spark, sf).collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null, empty and very long texts, repeated rows, null ids, an item of the benchmark and columns that clash."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id = 0 or length(text) > 60").orderBy("item_id").first()["text"]
    clean = base.where("doc_id = 0").first()["text"] or "a b c"
    rng = random.Random(12)
    words = clean.split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    odd = [(9001, None), (9002, ""), (9003, prose(60_000)), (9004, prose(40)), (9004, None), (None, prose(30)), (None, None), (9005, prose(50) + " " + item + " " + prose(50)), (9006, prose(30) + " password=abcdefgh12 " + prose(30))]
    odd += [odd[3], odd[3]]
    extra = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("odd"), "n_chars": F.length("text").cast("long")})
    docs = base.select("doc_id", "text", "lang", "source", "n_chars").union(extra)
    docs = docs.withColumns({"component_id": F.lit(1), "keep": F.lit("x"), "ids": F.lit(2.5), "item_id": F.lit(3), "hash": F.lit(4), "set": F.lit(5), "n": F.lit(6), "__id": F.lit(7)})
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in now.collect()]
        now = common.stored(stage(spark, now, str(tmp_path)), "t")
        after = Counter((r["doc_id"], r["text"]) for r in now.collect())
        assert now.columns == docs.columns, name
        if name.startswith("quality"):
            assert after[9001, None] == 1 and after[9002, ""] == 1 and after[None, None] == 1
        if name.startswith("n-gram"):
            assert sum(n for (i, t), n in after.items() if i == 9004 and t) == min(1, sum(i == 9004 and bool(t) for i, t in before)) and after[9004, None] == 1 and after[None, None] == 1
            ids = {i for i, t in before if i is not None}
            classes = brute_classes([(i, t) for i, t in dict(before).items() if i in ids and i < 9000])
            assert {i for i, _ in after if i is not None and i < 9000} == {i for i, (_, c) in classes.items() if c == i}
        if name.startswith("benchmark"):
            assert 9005 not in {i for i, _ in after} and after[9001, None] == 1
        if name.startswith("secret"):
            assert all("password=abcdefgh12" not in (t or "") for _, t in after)
            assert len(before) == sum(after.values())
    last = p.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert len(last) == now.count() and {r["n_tokens"] for r in last if r["doc_id"] in (9001, 9002)} == {0}
    assert Counter(r["doc_id"] for r in p.run(spark, str(tmp_path)).collect()) == Counter(r["doc_id"] for r in last)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
