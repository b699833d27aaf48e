"""Main text of web pages: what the markup declares, and per host a suffix array of the rest.

A page is read into blocks: text between the borders of block elements, character references decoded, white space made one space. Markup
settles most blocks. Text in an `article` is main text. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are furniture, told by their element, ARIA role or the words of their class and id (`FURNITURE`); so is, on a page with an `article`
or `main`, what stands outside both. Blocks of `main` outside an article, and all others of a page that declares neither, are open.

Open blocks are judged by their host. The token streams of its pages (words of furniture and open blocks, a border after each) are put end to end, and a
suffix array, sorted by prefix doubling to the depth of `least` tokens, brings equal runs together: positions whose runs of that length occur
on at least `pages` distinct pages and a `share` of the host's are covered, which is what all longer repeats cover too. An open block that is
covered as a whole is furniture; one with a token of its own stays whole. Repetition alone can't tell: menus, adverts and footers
differ from page to page, while articles quote each other, so text that markup declares is not judged by it.

Hosts are dealt into shards of up to `SHARD` octets by the digest of a page's stream, so that equal pages, which count once, meet. Counts of
equal runs (by a hash of 128 bits) add up over shards. Runs that pass are at most the tokens of an average page over `share` for a host, so they go to the shards.

Null and empty html has an empty text. Pages without a host (null url, no `://`) are not compared with others. Repeated rows and ids have a
row each. Empty tables give empty results. Columns other than page_id, url and html are ignored. Long pages are read whole; unclosed elements end with their parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._shared import Staged, groups, partitions, slices, stage
from orrery.llm.urls import host_of

#: Octets of stream text in a shard of a host, about; hosts of more than SMALL octets have up to SPREAD shards before theirs are that large.
SHARD, SMALL, SPREAD = 8 << 20, 32 << 10, 64

ARTICLE, OPEN, OTHER = 2, 1, 0

_PIECE = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_CLOSED_BY = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}

#: What is not main text: elements, ARIA roles, and words of class and id. Page headers count outside articles only.
FURNITURE = {
    "element": frozenset("nav aside footer form dialog menu button select template svg canvas audio video object head search".split()),
    "role": frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar toolbar form banner".split()),
    "word": frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription comment comments disqus respond share sharing social related recommended widget pagination pager login signup search".split()),
}
_HEADER = frozenset("header masthead topbar".split())


def _is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE["element"]:
        return True
    if name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, *values in _NAMED.findall(attributes):
        value = unescape("".join(values))
        if key.lower() == "role":
            if value.strip().lower() in FURNITURE["role"]:
                return True
            continue
        words = {w.lower() for w in _PART.findall(value)}
        if words & FURNITURE["word"] or (not in_article and words & _HEADER):
            return True
    return False


def blocks_of(html: str) -> list[tuple[str, int]]:
    """The blocks of a page in order, each with ARTICLE, OPEN or OTHER."""
    found: list[tuple[str, bool, bool, bool]] = []
    held: list[str] = []
    open_: list[tuple[str, bool, bool, bool]] = []  # name, and whether it lies in furniture, in an article, in main
    counts: dict[str, int] = {}
    here = ("", False, False, False)

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            found.append((text, *here[1:]))

    def pop(depth: int) -> None:
        nonlocal here
        while len(open_) > depth:
            counts[open_.pop()[0]] -= 1
        here = open_[-1] if open_ else ("", False, False, False)

    at, end = 0, len(html)
    while at < end:
        piece = _PIECE.search(html, at)
        stop = piece.start() if piece else end
        if stop > at:
            held.append(unescape(html[at:stop]))
        if not piece:
            break
        at = piece.end()
        if piece[2] is None:
            continue
        closing, name, attributes = piece[1], piece[2].lower(), piece[3]
        block = name in _BLOCKS
        if block:
            flush()
        elif name == "br":
            held.append(" ")
        if closing:
            if counts.get(name):
                for depth in range(len(open_) - 1, -1, -1):
                    if open_[depth][0] == name:
                        pop(depth)
                        break
                    if not block and open_[depth][0] in _BLOCKS:
                        break
            continue
        if name in _VOID:
            continue
        if name in _RAW:
            after = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = after.end() if after else end
            continue
        if attributes.endswith("/") and name in ("svg", "path"):
            continue
        if block and counts.get("p"):
            pop(max(i for i, x in enumerate(open_) if x[0] == "p"))
        if name in _CLOSED_BY:
            ended, limits = _CLOSED_BY[name]
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][0] in limits:
                    break
                if open_[depth][0] in ended.split():
                    pop(depth)
                    break
        furniture = here[1] or _is_furniture(name, attributes, here[2])
        is_main = name == "main" or "main" in attributes and any(k.lower() == "role" and "".join(v).strip().lower() == "main" for k, *v in _NAMED.findall(attributes))
        here = (name, furniture, here[2] or (name == "article" and not furniture), here[3] or (is_main and not furniture))
        open_.append(here)
        counts[name] = counts.get(name, 0) + 1
    flush()
    declared = any((article or main) and not furniture for _, furniture, article, main in found)
    return [(text, OTHER if furniture or (declared and not (article or main)) else ARTICLE if article else OPEN) for text, furniture, article, main in found]


_PARSED = "row long, page_id long, url string, host string, text string, blocks array<string>, marks array<tinyint>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 4):
        rows = []
        for html in part.column(4).to_pylist():
            blocks = blocks_of(html)
            if any(m == OPEN for _, m in blocks):
                rows.append((None, [t for t, _ in blocks], [m for _, m in blocks]))
            else:
                other = [t for t, m in blocks if m == OTHER]
                rows.append(("\n".join(t for t, m in blocks if m == ARTICLE), other, [OTHER] * len(other)))
        made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.list_(pa.string()), pa.list_(pa.int8())))]
        yield pa.record_batch([part.column(i) for i in range(4)] + made, ["row", "page_id", "url", "host", "text", "blocks", "marks"])


_BORDER = "\n"


def stream_of(blocks: list[str], marks: list[int]) -> tuple[list[str], list[int]]:
    """A page's tokens, and the block of each (-1 for borders). Declared article text has no part in it."""
    tokens, of = [_BORDER], [-1]
    for i, (text, mark) in enumerate(zip(blocks, marks)):
        if mark != ARTICLE:
            words = text.split(" ")
            tokens += words
            of += [i] * len(words)
            tokens.append(_BORDER)
            of.append(-1)
    return tokens, of


def _hashes(tokens: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the tokens, and two hashes of the run of `least` tokens from each place; the last places have none."""
    coded = tokens.dictionary_encode()
    words = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False)
    codes = np.asarray(coded.indices).astype(np.int64)
    n = max(0, len(codes) - least + 1)
    out = []
    for factor, mix in ((0x9E3779B97F4A7C15, 1), (0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)):
        h, total = (words * np.uint64(mix) ^ (words >> np.uint64(29)))[codes], np.zeros(n, np.uint64)
        for j in range(least):
            total = total * np.uint64(factor) + h[j : j + n]
        out.append(total.view(np.int64))
    return codes, *out


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, compared up to `depth` tokens, and the rank of each place; equal ranks agree that far. Places nearer to the end than that are left out."""
    rank, length = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while length < depth:
        step = min(length, depth - length)
        n = len(rank) - step
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank = np.unique(rank[:n] * (int(rank.max()) + 1) + rank[step : step + n], return_inverse=True)[1].astype(np.int64)
        length += step
    return np.argsort(rank, kind="stable"), rank


def _joined(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, list[list[int]]]:
    """Tokens of a shard's pages end to end, the page of each, where a run may not start (it would cross pages), and the blocks of each page's tokens."""
    tokens, lengths, of = [], [], []
    for blocks, marks in zip(table["blocks"].to_pylist(), table["marks"].to_pylist()):
        t, b = stream_of(blocks, marks)
        tokens += t
        lengths.append(len(t))
        of.append(b)
    ends = np.cumsum(lengths)
    return pa.array(tokens, pa.string()), np.repeat(np.arange(len(lengths)), lengths), np.repeat(ends, lengths), of


def _counted(least: int):
    """For each run of a shard: its hashes and on how many distinct pages it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "place"):
            digests = np.unique(np.asarray(table["digest"]), return_inverse=True)[1]
            tokens, page, ends, _ = _joined(table)
            codes, one, two = _hashes(tokens, least)
            order, rank = suffix_array(codes, least)
            order = order[order + least <= ends[order]]
            if not len(order):
                continue
            borders = np.flatnonzero(np.diff(rank[order], prepend=-1))
            run_of = np.repeat(np.arange(len(borders)), np.diff(np.append(borders, len(order))))
            pairs = np.unique(run_of * (int(digests.max()) + 1) + digests[page[order]])
            pages = np.bincount(pairs // (int(digests.max()) + 1))
            first = order[borders]
            yield pa.record_batch([pa.array([table["host"][0].as_py()] * len(first)), pa.array(one[first]), pa.array(two[first]), pa.array(pages)], ["host", "one", "two", "pages"])

    return run


def _judged(least: int):
    """The main text of pages with open blocks; a shard's rows begin with the runs that passed, if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "place"):
            runs = {x for one, two in zip(table["one"].to_pylist(), table["two"].to_pylist()) if one for x in zip(one, two)}
            table = table.filter(pa.compute.is_valid(table["row"]))
            if not table.num_rows:
                continue
            tokens, page, ends, of = _joined(table)
            _, one, two = _hashes(tokens, least)
            hits = np.zeros(len(tokens) + 1, np.int64)
            if runs and len(one):
                near = np.flatnonzero(np.isin(one, np.array([r[0] for r in runs])))
                at = np.array([i for i in near.tolist() if i + least <= ends[i] and (int(one[i]), int(two[i])) in runs], np.int64)
                np.add.at(hits, at, 1)
                np.add.at(hits, at + least, -1)
            covered = np.cumsum(hits)[:-1] > 0
            start, texts = 0, []
            for blocks, marks, place in zip(table["blocks"].to_pylist(), table["marks"].to_pylist(), of):
                own = {b for b, c in zip(place, covered[start : start + len(place)]) if not c}
                start += len(place)
                texts.append("\n".join(t for i, (t, m) in enumerate(zip(blocks, marks)) if m == ARTICLE or (m == OPEN and i in own)))
            yield pa.record_batch([table["page_id"].combine_chunks(), table["url"].combine_chunks(), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, least: int = 6, distinct_pages: int = 3, share: float = 0.05) -> DataFrame:
    """page_id, url, text of every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    read = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", host_of().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    held = Staged(read.mapInArrow(_parse, _PARSED), "parsed")
    parsed = held.df
    octets = F.coalesce(F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.length(b) + 2), F.lit(0))
    streams = parsed.select("row", "page_id", "url", "host", "text", "blocks", "marks", F.xxhash64("blocks").alias("digest"), octets.alias("octets"))
    sizes = streams.where("host <> ''").groupBy("host", "digest").agg(F.sum("octets").alias("octets"))
    hosts = stage(sizes.groupBy("host").agg(F.greatest(F.ceil(F.sum("octets") / F.lit(SHARD)), F.least(F.lit(SPREAD), F.ceil(F.sum("octets") / F.lit(SMALL)))).cast("int").alias("shards"), F.count("*").alias("distinct")), "hosts")
    several = hosts.where("shards > 1").select("host", "shards")
    placed = streams.where("host <> '' AND size(blocks) > 0").join(several, "host", "left").withColumn("place", F.concat_ws("#", "host", F.pmod("digest", F.coalesce("shards", F.lit(1)))))
    tasks = partitions(spark, held.octets())
    dealt = placed.select("place", "host", "digest", "blocks", "marks").repartition(tasks, "place").sortWithinPartitions("place")
    counted = dealt.mapInArrow(_counted(least), "host string, one long, two long, pages long").groupBy("host", "one", "two").agg(F.sum("pages").alias("pages"))
    passed = stage(counted.where(F.col("pages") >= distinct_pages).join(hosts, "host").where(F.col("pages") >= share * F.col("distinct")), "passed")
    runs = passed.groupBy("host", "shards").agg(F.collect_list("one").alias("one"), F.collect_list("two").alias("two"))
    runs = runs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.greatest("shards", F.lit(1)) - 1))).select(F.concat_ws("#", "host", "shard").alias("place"), "one", "two")
    asked = placed.where("text IS NULL").select("place", "row", "page_id", "url", "blocks", "marks").unionByName(runs, allowMissingColumns=True)
    judged = asked.repartition(tasks, "place").sortWithinPartitions("place").mapInArrow(_judged(least), "page_id long, url string, text string")
    alone = parsed.where("host = '' AND text IS NULL").select("page_id", "url", F.array_join(F.filter("blocks", lambda b, i: F.get("marks", i) > OTHER), "\n").alias("text"))
    return parsed.where("text IS NOT NULL").select("page_id", "url", "text").unionByName(judged).unionByName(alone)
