"""Parts of the operators: trees, packings, media streams, structures, bootstrapping, mixing, pipeline."""

import base64
import json
import random
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import langid, media, mixing, neighbours, packing, pii, secrets, simhash, urls


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60))
def test_tree_finds_all_within_the_radius(seed, n):
    rng = random.Random(seed)
    base = rng.getrandbits(64)
    values = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for _ in range(n)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert {tree.values[i] for i in tree.near(v)} == {w for w in values if (v ^ w).bit_count() <= 3}


@pytest.mark.parametrize("limit", [2, 8, 2048])
def test_large_shards_split_without_losing_links(limit):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)})

    def roots(limit):
        parent = {v: v for v in values}
        simhash._unite(values, list(range(64)), parent, 3, limit)
        return [simhash._find(parent, v) for v in values]

    parent = {v: v for v in values}
    for v in values:
        for w in values:
            if (v ^ w).bit_count() <= 3:
                a, b = simhash._find(parent, v), simhash._find(parent, w)
                parent[max(a, b)] = min(a, b)
    assert roots(limit) == [simhash._find(parent, v) for v in values]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}


@pytest.mark.parametrize("octets", [1, 4 << 20])
def test_components_join_what_a_task_reads(spark, monkeypatch, octets):
    """Edges that a task reads together take no rounds, of which each leaves jobs, plans and threads at the driver; others still meet in rounds."""
    monkeypatch.setattr(simhash, "_EDGE_OCTETS", octets)
    rng = random.Random(11)
    pairs = [(rng.randint(-400, 400), rng.randint(-400, 400)) for _ in range(500)] + [(k, k + 1) for k in range(1000, 1200)]
    parent = {x: x for pair in pairs for x in pair}
    for a, b in pairs:
        a, b = simhash._find(parent, a), simhash._find(parent, b)
        parent[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(8)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    before = jobs()
    found = simhash.components(edges)
    took = jobs() - before
    rows = sorted((r["node"], r["root"]) for r in found.collect())
    assert rows == sorted({(x, simhash._find(parent, x)) for a, b in pairs if a != b for x in (a, b)})
    assert octets == 1 or took <= 8


def test_the_language_model_is_fitted_in_little_memory():
    counts = [(lang, n, f"{lang}{'x' * n}{k}", k + 1) for n in (0, *langid.GRAMS) for lang in ("de", "en", "es", "fr") for k in range(4000)]
    tracemalloc.start()
    model = langid.fit(iter(counts))
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert {n: len(x) for n, x in model["logs"].items()} == dict.fromkeys((0, *langid.GRAMS), 16_000)
    assert most < 3 * kept


@pytest.mark.parametrize("count", [1_000, 10_000_000, 10**11])
def test_more_blocks_keep_every_pair(count):
    b = simhash._blocks(count, 3)
    assert 4 <= b <= 7


def test_genetic_packing_is_whole_and_no_worse_than_best_fit():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 1200) for _ in range(500)]
    plain = packing.best_fit(sorted(range(500), key=lambda i: -sizes[i]), sizes, 2048)
    found = packing.evolve(sizes, [], 2048, seed=4)
    assert sorted(i for b in found.bins for i in b) == list(range(500))
    assert all(sum(sizes[i] for i in b) + left == 2048 and left >= 0 for b, left in zip(found.bins, found.left, strict=True))
    assert found.fitness() >= plain.fitness()


@pytest.mark.parametrize(("low", "high", "n"), [(200, 1000, 2000), (500, 1000, 1500)])
def test_genetic_packing_beats_best_fit_where_that_misses_the_bound(low, high, n):
    rng = random.Random(1)
    sizes = [rng.randrange(low, high) for _ in range(n)]
    plain = packing.best_fit(packing.longest_first(range(n), sizes), sizes, 2048)
    found = packing.evolve(sizes, [], 2048, seed=1)
    assert sorted(i for b in found.bins for i in b) == list(range(n))
    assert packing.least_bins(sizes, 2048) <= len(found.bins) < len(plain.bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_the_bound_is_no_more_than_the_fewest_bins(sizes):
    fewest = len(sizes)

    def place(i, left):
        nonlocal fewest
        if len(left) >= fewest and i < len(sizes):
            return
        if i == len(sizes):
            fewest = min(fewest, len(left))
            return
        for k, room in enumerate(left):
            if room >= sizes[i]:
                place(i + 1, left[:k] + [room - sizes[i]] + left[k + 1 :])
        place(i + 1, [*left, 12 - sizes[i]])

    place(0, [])
    assert packing.least_bins(sizes, 12) <= fewest
    assert fewest <= len(packing.evolve(sizes, [], 12, seed=3).bins)


def test_packing_agrees_under_other_splits_and_packs_shards_together(spark, small_dir, tmp_path):
    rng = random.Random(9)
    rows = [(i // 2, rng.choice([2048, rng.randrange(1, 2048), rng.randrange(1, 300)])) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, length long")
    frame.repartition(7).write.parquet(f"{tmp_path}/items")
    found = []
    for split in ("1m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            out = packing.pack(spark.read.parquet(f"{tmp_path}/items"), shard=100).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        bins = {}
        for r in out:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"]))
        for parts in bins.values():
            assert [o for o, _, _ in sorted(parts)] == [sum(n for _, n, _ in sorted(parts)[:k]) for k in range(len(parts))]
            assert sum(n for _, n, _ in parts) <= 2048
        found.append(sorted(sorted((n, d) for _, n, d in parts) for parts in bins.values()))
    assert found[0] == found[1] and sorted(x[::-1] for parts in found[0] for x in parts) == sorted(rows)
    lengths = [n for _, n in rows if n < 2048]
    assert len(found[0]) <= packing.least_bins(lengths, 2048) + 2 + sum(n == 2048 for _, n in rows)
    for bad in (0, 2049, None):
        with pytest.raises(Exception, match="no length of a piece"):
            packing.pack(spark.createDataFrame([(1, bad)], "doc_id long, length long")).collect()


def test_crossover_keeps_whole_bins_of_the_donor():
    sizes = [1000, 1000, 1048, 500, 600, 900]
    a, b = packing.best_fit([0, 1, 2, 3, 4, 5], sizes, 2048), packing.best_fit([5, 4, 3, 2, 1, 0], sizes, 2048)
    child = packing.crossover(a, b, sizes, random.Random(1))
    assert sorted(i for x in child.bins for i in x) == list(range(6))
    assert any(set(x) >= set(y) for x in child.bins for y in b.bins)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_media_round_trip_of_any_octets(data):
    found = media.read(media.write(data))
    assert found["payload"] == data and found["bad"] == 0 and found["skipped"] == 0
    assert found["table"]["frames"] == len(found["offsets"])


def test_media_reader_resynchronises_and_checks():
    stream = media.write(bytes(range(256)) * 40)
    at = media.read(stream)["offsets"]
    assert media.read(b"junk\xff\x00" + stream[len(stream) - (len(stream) - at[0]) :])["skipped"] == 6
    broken = bytearray(stream)
    broken[at[1] + 8] ^= 1
    assert media.read(bytes(broken))["bad"] == 1
    assert media.read(stream)["duration"] * 32000 == 1152 * len(at)


def _der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_secrets_need_structure():
    key = _der(0x30, b"".join(_der(0x02, bytes([1]) * k) for k in (1, 64, 3, 64, 32, 32)))
    body = base64.b64encode(key).decode()
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256", "typ": "JWT"}).encode(), json.dumps({"sub": "1"}).encode(), b"s" * 32))
    kinds = lambda text: [secrets.KINDS[k] for _, k, _ in secrets.scan(text)[1]]
    assert kinds(f"x -----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY----- y") == ["pem"]
    assert kinds(f"see {body} here") == ["der"]
    assert "der" in kinds(f"see {key.hex().upper()} here") and "der" not in kinds(f"see {key.hex().upper()}00 here")
    assert kinds(f"bearer {token} here") == ["token"]
    assert kinds(f"see {base64.b64encode(key[:-1]).decode()} here") == []
    assert kinds("bearer eyJhbGciOjF9.eyJhIjoxfQ.abcdefghijklmnopqrst here") == []
    ssh = b"openssh-key-v1\x00" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"k" * 40
    assert kinds(f"see {base64.b64encode(ssh).decode()} here") == ["openssh"]


def test_patterns_discover_unseen_identifiers(spark):
    texts = [f"hello my card number: 411111111111{k:04d} thanks" for k in range(300)]  # some of them pass the checksum
    valid = [t for t in texts if pii_valid(t)]
    texts = valid + ["please card number: 12345-678 thanks", "and then of 12345-678 x"] + [f"page of 10{k}00 x" for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.spans(docs).collect()}
    n = len(valid)
    assert [pii.KINDS[s["kind"]] for s in found[n]] == ["context"]
    assert all(not found[k] for k in range(n + 1, len(texts)))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] == "hello my card number: <CARD> thanks" and clean[n] == "please card number: <CONTEXT> thanks" and clean[n + 1] == texts[n + 1]


def pii_valid(text):
    digits = text.split()[4]
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_water_filling_clamps_and_shares_again(spark):
    frame = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5), ("z", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.fill(frame).collect()}
    assert got["a"] == 20 and got["z"] == 0 and got[None] == 10
    assert abs(sum(got.values()) - 1.5 * 2015) < 1e-6
    assert all(v <= 2 * s for v, s in ((got["b"], 1000), (got["c"], 1000)))


def test_materialised_words_are_those_taken(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    words = mixing.materialise(docs).agg(F.sum(mixing.size_of())).first()[0]
    assert words == taken


def test_url_rules_with_nulls_and_repeats(spark):
    rules = spark.createDataFrame([("block", "a.com", "/"), ("block", "a.com", "/"), (None, "b.com", "/"), ("allow", "a.com", "/x")], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://w.a.com/y"), (2, "http://a.com/xy"), (3, "http://b.com/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect()}
    assert got == {1: ("a.com/", "block"), 2: ("a.com/x", "allow"), 3: (None, "allow")}


def test_walk_visits_cells_by_summed_distance():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.random(5), rng.random(5)
    cells = neighbours.walk(a, b, np.ones(25, int), 25)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(25)) and sums == sorted(sums)


def test_pipeline_stages(spark, tricky):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = step(spark, docs, tricky)
        if k < 4:
            assert docs.columns == before.columns
        docs = corpus_pipeline.stage(docs, "test")
    assert docs.count() > 0


def test_pipeline_takes_an_empty_table(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0


def test_cached_tokens_equal_whole_texts():
    from array import array

    import public_tokenizers
    from tokenizers import Tokenizer

    from orrery.llm.packing import Tokens

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " ", "don't 'S it'S!!! ABC,DEF word$$$ ié... über!!! <|endoftext|> a<|ENDOFTEXT|>b", "İ! ıI ǅ ㎏! ⅷ! ﬁn. ̈! a ̈b = ̸ x y", "日本語。日本語! \x1c\x1d אַ! ​zero​ naïve,", "plain words " * 300]
    whole = Tokenizer.from_file(path)
    assert list(Tokens(path).ids([t.encode() for t in texts])) == [array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
