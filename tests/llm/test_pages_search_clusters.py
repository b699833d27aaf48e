"""Main text of pages, ranked lexical search and centroid clustering, against SQL and brute force."""

import hashlib
import os
import random
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import clustering, lexical, pages, queries


def against_sql(sf_dir, name, result):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert Counter(map(tuple, result.select(*columns).collect())) == Counter(want.fetchall())


@pytest.mark.parametrize("name", ["op12_lexical", "op13_clustering"])
def test_queries_equal_sql(spark, sf_dir, name):
    against_sql(sf_dir, name, queries.QUERIES[name](spark, sf_dir))


def test_op11_equals_sql(spark, small_dir):
    against_sql(small_dir, "op11_pages", queries.op11_pages(spark, small_dir))


# Pages


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("just text &amp; more &copy; &#x41; &nbsp; end", "just text & more © A end"),
        ("<article><h1>T</h1><p>a<b>b</b>\n c<br>d<p>e</article><footer>f</footer>", "T\nab c d\ne"),
        ("<nav>m</nav><article><header><h1>T</h1></header><p>x<aside>side</aside><p>y<section class='comments'><p>c</section></article>", "T\nx\ny"),
        ('<article><p title="a > b">x</p><script>var t="</p><p>no";</script><style>p{}</style><form><p>f<input></form>z</article>', "x\nz"),
        ("<main><h1>M</h1><article><p>a</article><div class=cookie-notice>c</div></main><p>out", "M\na"),
        ("<article><p>a<article class='comment'>reader</article></article>", "a"),
        ("<ul><li>a<ul><li>b</ul><li class=ad>x<li>c</ul>", "a\nb\nc"),
        ("<article>a<!-- <p>no</p> --><p>b <b>c<p>d</b> e", "a\nb c\nd e"),
        ("<div role=banner>x</div><div id=siteNav>y</div><p>z</p><div aria-hidden=1>w", "z\nw"),
        ("a < b <1 &lt;p&gt; <p/>c", "a < b <1 <p>\nc"),
        ("<body class='has-sidebar'><p>ok</p><!-- unclosed", "ok"),
        ("<p>" + "<b>" * 3000 + "deep</p>tail", "deep\ntail"),
    ],
)
def test_blocks(html, want):
    assert "\n".join(t for t, m in pages.blocks_of(html) if m > pages.OTHER) == want


class Plain(HTMLParser):
    """Blocks of flat pages, by the library's own parser: only <p> and <nav> are known."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.nav = [], "", 0
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        if self.held.split():
            self.out.append((" ".join(self.held.split()), 0 if self.nav else 1))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.nav += tag == "nav"

    def handle_endtag(self, tag):
        self.flush()
        self.nav -= tag == "nav"

    def handle_data(self, data):
        self.held += data


def by_brute_force(rows, least, distinct, share):
    """Counts every run of every page in a dictionary."""
    read = [(u.split("/")[2] if u and "://" in u else "", Plain(h or "").out) for _, u, h in rows]
    where, of_host = defaultdict(set), defaultdict(set)
    streams = []
    for host, blocks in read:
        tokens, of = ["\n"], [-1]
        for i, (t, _) in enumerate(blocks):
            tokens += t.split(" ") + ["\n"]
            of += [i] * len(t.split(" ")) + [-1]
        streams.append((tokens, of))
        digest = tuple(t for t, _ in blocks)
        of_host[host].add(digest)
        for i in range(len(tokens) - least + 1):
            where[host, tuple(tokens[i : i + least])].add(digest)
    out = []
    for (host, blocks), (tokens, of), (page, url, _) in zip(read, streams, rows):
        covered = [False] * len(tokens)
        for i in range(len(tokens) - least + 1):
            n = len(where[host, tuple(tokens[i : i + least])])
            if host and n >= distinct and n >= share * len(of_host[host]):
                covered[i : i + least] = [True] * least
        own = {b for b, c in zip(of, covered) if not c}
        out.append((page, url, "\n".join(t for i, (t, m) in enumerate(blocks) if m and i in own)))
    return out


@pytest.fixture(scope="module")
def soup():
    """Hosts whose pages declare nothing; menus and notices stand in some of them, articles quote each other, pages repeat."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(240):
        host = ["a.example", "a.example", "b.example", "c.example"][i % 4]
        own = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(0, 4))]
        menu = ["Home", "News", "About us", f"Contact {host}", "Help"] if rng.random() < 0.8 else []
        legal = ["All rights reserved by the owners of this site and others"] if rng.random() < 0.5 else []
        side = [f"<nav>{rng.choice(words)} All rights reserved by the owners of this site</nav>"] if rng.random() < 0.3 else []
        rows.append((i, f"http://{host}/{i}", "".join(f"<p>{b}</p>" for b in menu + own) + "".join(side) + "".join(f"<p>{b}</p>" for b in legal)))
    rows += [rows[5], rows[6], rows[7], (None, None, rows[8][2]), (3, "no scheme", rows[9][2]), (4, "http://d.example/", None), (5, "http://a.example/", "<p>Home</p><p>News</p>")]
    return rows


@pytest.mark.parametrize("shard, least, distinct, share", [(8 << 20, 6, 3, 0.05), (3000, 6, 3, 0.05), (500, 4, 2, 0.3)])
def test_host_runs_equal_brute_force(spark, soup, monkeypatch, shard, least, distinct, share):
    monkeypatch.setattr(pages, "SHARD", shard)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in soup], "page_id long, url string, html string, text string, host string, row string").repartition(5)
    found = pages.extract(df, least, distinct, share)
    want = by_brute_force(soup, least, distinct, share)
    assert Counter(map(tuple, found.collect())) == Counter(want)
    assert any("Home" not in t for _, u, t in want if u) and any("Home" in t for _, u, t in want)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 9))
def test_suffix_array(codes, depth):
    order, rank = pages.suffix_array(np.array(codes, np.int64), depth)
    runs = [tuple(codes[i : i + depth]) for i in range(len(codes) - depth + 1)]
    assert order.tolist() == sorted(range(len(runs)), key=lambda i: (runs[i], i))
    assert all((rank[i] == rank[j]) == (runs[i] == runs[j]) for i in range(len(runs)) for j in range(i))


# Search


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(0, 5), max_size=30), max_size=6), st.integers(1, 5))
def test_best_documents_equal_all_sums(lists, k):
    total = Counter()
    for x in lists:
        total.update(x)
    want = sorted(((s, d) for d, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    assert lexical.best([(sorted(x), [x[d] for d in sorted(x)]) for x in lists], k) == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=30))
def test_packed_numbers(values):
    octets, at = lexical.packed(np.array(values, np.uint64))
    assert lexical.unpacked(octets.tobytes()).tolist() == values and len(at) == len(values) + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aZé09 _-\U0001f600", max_size=12)), max_size=8))
def test_terms(texts):
    import re

    found, at = lexical.terms_of(pa.array(texts, pa.string()))
    want = [("".join(c.lower() if "A" <= c <= "Z" else c for c in m), i) for i, t in enumerate(texts) for m in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    assert list(zip(found.to_pylist(), at.tolist())) == want


def test_small_shards_and_blocks_find_the_same(spark, tricky, small_dir, monkeypatch):
    for at in (tricky, small_dir):
        docs, items = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "benchmark"))
        want = Counter(map(tuple, lexical.search(lexical.build_index(docs), items, 4).collect()))
        monkeypatch.setattr(lexical, "SHARD", 20_000)
        monkeypatch.setattr(lexical, "BLOCK", 3)
        monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
        assert Counter(map(tuple, lexical.search(lexical.build_index(docs.repartition(3)), items, 4).collect())) == want
        monkeypatch.undo()


# Clusters


def lloyd(vectors, k, rounds):
    points = np.array([v for _, v in vectors], np.int64)
    digest = [hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest() for i, _ in vectors]
    at = sorted(range(len(vectors)), key=lambda i: (digest[i], vectors[i][1]))[:k]
    centroids = points[at]
    for step in range(rounds + 1):
        far = ((points[:, None] - centroids[None]) ** 2).sum(2)
        of = far.argmin(1)
        if step < rounds:
            centroids = np.array([points[of == c].sum(0) // (of == c).sum() if (of == c).any() else centroids[c] for c in range(len(centroids))])
    return [(vectors[i][0], int(of[i]), int(far[i].min())) for i in range(len(vectors))]


@pytest.mark.parametrize("n, k, block", [(700, 13, 64), (40, 8, 4096), (5, 8, 2), (300, 1, 100)])
def test_clusters_equal_full_scans(spark, monkeypatch, n, k, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    rng = random.Random(n)
    middles = [[rng.randrange(-6, 6) for _ in range(4)] for _ in range(k)]
    vectors = [(i, [float(rng.choice(middles)[j] + rng.choice([0, 0, 1, -1])) for j in range(4)]) for i in range(n)]  # many ties
    vectors += [(1, vectors[1][1]), (1, vectors[1][1]), (None, vectors[2][1])]
    bad = [(7, None), (8, [1.0] * 3), (9, [None] * 4), (10, [float("nan")] * 4), (11, [float("-inf")] + [0.0] * 3)]
    df = spark.createDataFrame([(*v, "x", "y") for v in vectors + bad], "vec_id long, embedding array<double>, cluster string, points string").repartition(3)
    found = clustering.cluster(df, k, 6, 4, 2)
    want = lloyd([(i, [int(np.floor(2 * x)) for x in v]) for i, v in vectors], k, 6)
    assert Counter(tuple(r) for r in found.select("vec_id", "cluster", "distance").collect()) == Counter(want)
    totals = found.groupBy("cluster").agg(F.sum("distance").alias("d"), F.min("cluster_inertia").alias("c"), F.min("inertia").alias("i"), F.countDistinct("centroid_sha256").alias("n")).collect()
    assert all(t["d"] == t["c"] and t["n"] == 1 for t in totals) and sum(t["d"] for t in totals) == totals[0]["i"]


def test_bounds_leave_out_distances_and_nothing_else():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (20, 8))
    points = centroids[rng.integers(0, 20, 3000)] + rng.integers(-60, 60, (3000, 8))
    groups = 5
    group = clustering.grouped(centroids, groups)
    assigned, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros((3000, groups))
    drift, measured = None, []
    for _ in range(5):
        if drift is not None:
            upper = (upper + drift[assigned]) * (1 + 1e-9)
            lower = np.maximum(0, (lower - np.array([drift[group == g].max(initial=0) for g in range(groups)])) * (1 - 1e-9))
        measured.append(clustering.nearest(points, centroids, group, assigned, upper, lower))
        far = ((points[:, None] - centroids[None]) ** 2).sum(2)
        assert (assigned == far.argmin(1)).all()
        assert (np.sqrt(far.min(1)) <= upper + 1e-6).all()
        moved = centroids + rng.integers(-30, 30, centroids.shape)
        drift, centroids = np.sqrt(((moved - centroids) ** 2).sum(1)), moved
    assert measured[-1] < 3000 * 20 / 3


def test_components_too_large_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\^27"):
        clustering.cluster(df, 1, 1, 2, 1024).collect()
