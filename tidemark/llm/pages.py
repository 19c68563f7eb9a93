"""Main text of web pages: markup tells the declared article, a host suffix array the boilerplate.

The token streams of a host's pages are concatenated and their suffixes sorted; a run of words that
several distinct pages share is boilerplate. A large host does not fit in one task, so streams travel as
super-k-mers: each task holds the suffixes of one range of minimisers, sorts them, and finds every run of
at least WINDOW words; a shorter block is a run by itself. Pages are parsed once and written to the shared folder; the runs found
decide on the blocks of every page, and markup says how much they must prove. Where markup leaves a block
undecided the runs grow together to their full length: a block goes if they cover most of it, and otherwise
loses long runs only, so a phrase that many pages use stays in the prose around it. A block of a declared
article goes if runs that stand on nearly every page of the host cover most of it.

Articles are most of the text and nearly all of it is unique, so a batch sends only the windows that stand
on more than half of its pages of the host: what stands on ARTICLE_SHARE of all pages does so in batches that
hold a share of them, and is counted page by page before it takes anything away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, tidied, written
from tidemark.llm.markup import BODY, OPEN, Block, blocks
from tidemark.llm.substrings import _mixed, _ranges, pack, super_kmers, unpack, word_hashes, word_spans

WINDOW = 5
DISTINCT_PAGES = 3
PAGE_SHARE = 0.01  # of the undecided pages of a host
MOSTLY = 0.8  # of a block's words
LONG_RUN = 15
ARTICLE_SHARE = 0.8  # of the pages of a host, for what is left out of a declared article
ARTICLE_PAGES = 10  # different ones, below which a host proves nothing about its articles
ARTICLE_LEFT = 0.5  # of an article's words; if more would go, the pages are near copies of each other
BATCH_SHARE = 0.5  # of a host's pages in a batch, above which windows of articles are sent
PROSE_WORDS = 25
LINK_SHARE = 0.5
BUCKET_BYTES = 8 << 20
ROWS_AT_ONCE = 64


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` tokens, by prefix doubling; equal prefixes share one.

    Suffixes that end before ``depth`` tokens rank as if padded with a token smaller than all others.
    """
    ranks = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    known = 1
    while known < depth:
        step = min(known, depth - known)
        after = np.zeros(len(ranks), np.int64)
        after[: max(0, len(ranks) - step)] = ranks[step:]
        ranks = np.unique(ranks * (ranks.max(initial=0) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        known += step
    return ranks


def undecided(found: list[Block]) -> bool:
    """Whether a page has a block that is kept if the host does not repeat it."""
    has_body = any(b.region == BODY for b in found)
    return any(b.region == OPEN and _readable(b, has_body) for b in found)


def _readable(block: Block, has_body: bool) -> bool:
    """Beside a declared article only prose counts; anywhere, what is mostly links is a menu."""
    if block.linked > LINK_SHARE * len(block.text):
        return False
    if not has_body:
        return True
    return block.text.count(" ") + 1 >= PROSE_WORDS and any(c in block.text for c in ".!?")


def _covered(words: list[str], windows: set[str]) -> np.ndarray:
    """Which of the words stand in one of the windows."""
    gone = np.zeros(len(words), bool)
    for at in range(max(1, len(words) - WINDOW + 1)):
        if " ".join(words[at : at + WINDOW]) in windows:
            gone[at : at + WINDOW] = True
    return gone


def _template(found: list[Block], windows: set[str]) -> set[int]:
    """Which blocks of a declared article the host puts on nearly every page; none where that would be most of it."""
    gone, lost, total = set(), 0, 0
    for i, block in enumerate(found):
        if block.region == BODY:
            words = block.text.split(" ")
            total += len(words)
            if len(words) >= WINDOW and _covered(words, windows).sum() >= MOSTLY * len(words):
                gone.add(i)
                lost += len(words)
    return gone if lost <= (1 - ARTICLE_LEFT) * total else set()


def assembled(found: list[Block], covered: set[str], everywhere: set[str] = frozenset()) -> str:
    """The text of a page, given the windows that its host repeats, and those that stand on nearly all its pages."""
    has_body = any(b.region == BODY for b in found)
    template = _template(found, everywhere) if everywhere else ()
    out = []
    for i, block in enumerate(found):
        if block.region == BODY:
            if i not in template:
                out.append(block.text)
        elif block.region == OPEN and _readable(block, has_body):
            words = block.text.split(" ")
            gone = _covered(words, covered)
            if gone.sum() >= MOSTLY * len(words):
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            for begin, end in zip(edges[::2], edges[1::2]):
                gone[begin:end] = end - begin >= LONG_RUN
            kept = [w for w, g in zip(words, gone) if not g]
            if kept and (not has_body or len(kept) >= PROSE_WORDS):
                out.append(" ".join(kept))
    return " ".join(out)


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return rest.partition("/")[0].partition("?")[0].partition("#")[0].rpartition("@")[2].partition(":")[0].lower()


def _parsed(pages: DataFrame) -> DataFrame:
    """The blocks of every page, once; ``page`` tells pages with different words apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        kinds = pa.list_(pa.struct([("region", pa.string()), ("text", pa.string()), ("linked", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                urls = part.column("url").to_pylist()
                found = [blocks(h) for h in part.column("html").to_pylist()]
                every = [b for f in found for b in f]
                regions, texts, linked = zip(*every) if every else ((), (), ())
                flat = pa.StructArray.from_arrays(
                    [pa.array(regions, pa.string()), pa.array(texts, pa.string()), pa.array(linked, pa.int32())], fields=list(kinds.value_type)
                )
                stops = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
                pages = [int.from_bytes(_digest("\n".join([b.text for b in f]).encode()), "little", signed=True) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(row, row + part.num_rows), pa.int64()), part.column("page_id"), part.column("url"),
                        pa.array([host_of(u) for u in urls], pa.string()), pa.array(pages, pa.int64()),
                        pa.array([undecided(f) for f in found], pa.bool_()), pa.ListArray.from_arrays(pa.array(stops), flat).cast(kinds),
                    ],
                    ["row", "page_id", "url", "host", "page", "undecided", "blocks"],
                )
                row += part.num_rows

    schema = "row long, page_id long, url string, host string, page long, undecided boolean, blocks array<struct<region:string,text:string,linked:int>>"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return written(rows.mapInArrow(tidied(run), schema), "pages-parsed")


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def _texts(region: str, inside: bool) -> Column:
    return F.transform(F.filter("blocks", lambda b: (b["region"] == region) == inside), lambda b: b["text"])


def _in_most_pages(hosts: list[str], articles: list[list[str]], seen: dict[tuple[str, bytes], list]) -> None:
    """Add to ``seen`` the super-k-mers of articles with a window on more than BATCH_SHARE of a host's pages here.

    Windows are told apart by a hash and counted as often as they stand in a page, so at worst too many are sent.
    """
    parts = [(who, b.encode()) for who, found in enumerate(articles) for b in found if b.count(" ") + 1 >= WINDOW]
    if not parts:
        return
    place = {h: i for i, h in enumerate(dict.fromkeys(hosts))}
    host = np.array([place[h] for h in hosts])
    least_pages = BATCH_SHARE * np.bincount(host)
    data = np.frombuffer(b" ".join([b for _, b in parts]), np.uint8)
    counts = np.array([b.count(b" ") + 1 for _, b in parts], np.int64)
    starts, ends = word_spans(data)
    hashes = word_hashes(data, starts, ends)
    stops = np.cumsum(counts)
    at = _ranges(stops - counts, counts - WINDOW + 1)
    mine = np.repeat(host[[who for who, _ in parts]], counts - WINDOW + 1)
    keys = mine.astype(np.uint64)
    for step in range(WINDOW):
        keys = _mixed(keys ^ hashes[at + step])
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    times = times[inverse]
    often = np.zeros(len(hashes) + 1, np.int64)
    often[at + 1] = np.where(times > least_pages[mine], times, 0)
    running = np.cumsum(often > 0)
    firsts, windows, least = super_kmers(hashes, counts, WINDOW)
    sent = np.flatnonzero(running[firsts + windows] > running[firsts])
    owner = np.repeat(np.array([who for who, _ in parts]), counts)[firsts[sent]]
    text = data.tobytes()
    for who, first, size, smallest in zip(owner.tolist(), firsts[sent].tolist(), windows[sent].tolist(), least[sent].tolist()):
        string = text[starts[first] : ends[first + size + WINDOW - 2]]
        seen.setdefault((hosts[who], string), [smallest, set(), 0])[2] += 1


def _repeated(parsed: DataFrame) -> DataFrame:
    """``host, window, shared, times``: the runs of WINDOW words, and shorter blocks, that pages of a host share.

    ``shared``: outside of articles DISTINCT_PAGES different pages have it. ``times``: how often articles have
    it in the batches where it stands on most of the host's pages, so never less than the pages there that do.

    Pages whose streams agree word for word count once, so copies of a page do not make boilerplate of
    its text. A batch sends each super-k-mer of a host once, with at most DISTINCT_PAGES page hashes:
    enough to tell whether so many different ones exist.
    """
    spark = parsed.sparkSession
    size = parsed.agg(F.sum(F.octet_length(F.array_join(F.col("blocks.text"), " ")))).first()[0] or 0
    buckets = max(4 * partitions(spark), 3 * size // BUCKET_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, bytes], list] = {}
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hosts, edges = part.column("host").to_pylist(), part.column("edges").to_pylist()
                streams = [[b.encode() for b in e] for e in edges]
                pages = [int.from_bytes(_digest(b"\n".join(s)), "little") for s in streams]
                owner = [i for i, s in enumerate(streams) for _ in s]
                data = np.frombuffer(b" ".join([b for s in streams for b in s]), np.uint8)
                counts = np.array([b.count(b" ") + 1 for s in streams for b in s], np.int64)
                starts, ends = word_spans(data)
                text = data.tobytes()
                firsts, windows, least = super_kmers(word_hashes(data, starts, ends), counts, WINDOW)
                inside = np.repeat(np.arange(len(counts)), counts)[firsts]
                for block, first, size, smallest in zip(inside.tolist(), firsts.tolist(), windows.tolist(), least.tolist()):
                    string = text[starts[first] : ends[first + size + WINDOW - 2]]
                    who = owner[block]
                    entry = seen.setdefault((hosts[who], string), [smallest, set(), 0])
                    if len(entry[1]) < DISTINCT_PAGES:
                        entry[1].add(pages[who])
                for who, block in zip(owner, [b for s in streams for b in s]):
                    if block.count(b" ") + 1 < WINDOW:
                        entry = seen.get((hosts[who], block))
                        if entry is None:
                            entry = seen[hosts[who], block] = [int.from_bytes(_digest(block), "little"), set(), 0]
                        if len(entry[1]) < DISTINCT_PAGES:
                            entry[1].add(pages[who])
            _in_most_pages(batch.column("host").to_pylist(), batch.column("articles").to_pylist(), seen)
            yield from _blocks_of(seen, buckets)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                if bucket != current:
                    if held:
                        yield _found(held)
                    current, held = bucket, []
                held.append(payload.as_py())
        if held:
            yield _found(held)

    sent = parsed.select("host", _texts(BODY, False).alias("edges"), _texts(BODY, True).alias("articles")).mapInArrow(tidied(send), "bucket long, payload binary")
    owned = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return owned.mapInArrow(tidied(sort), "host string, window string, shared boolean, times long")


def _blocks_of(seen: dict, buckets: int) -> Iterator[pa.RecordBatch]:
    by_bucket: dict[int, list] = {}
    for (host, string), (least, pages, times) in seen.items():
        key = int(_mixed(np.array([least ^ int.from_bytes(_digest(host.encode()), "little")], np.uint64))[0])
        by_bucket.setdefault(key % buckets, []).append((host, string, pages, times))
    for bucket, rows in by_bucket.items():
        hosts = sorted({r[0] for r in rows})
        place = {h: i for i, h in enumerate(hosts)}
        payload = pack(
            np.frombuffer("\n".join(hosts).encode(), np.uint8),
            np.array([place[r[0]] for r in rows], "<i4"),
            np.frombuffer(b"\n".join([r[1] for r in rows]), np.uint8),
            np.array([len(r[2]) for r in rows], "<i4"),
            np.array([p for r in rows for p in r[2]], "<u8"),
            np.array([r[3] for r in rows], "<i8"),
        )
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([payload], pa.binary())], ["bucket", "payload"])


def _found(payloads: list[bytes]) -> pa.RecordBatch:
    """Of one bucket: concatenate its streams, sort the suffixes, and report the runs of several pages."""
    hosts, streams, pages, often = [], [], [], []
    for payload in payloads:
        names, place, text, sizes, hashes, times = unpack(payload, "u1", "<i4", "u1", "<i4", "<u8", "<i8")
        names = names.tobytes().decode().split("\n")
        hosts += [names[i] for i in place.tolist()]
        streams += text.tobytes().split(b"\n")
        pages += np.split(hashes, np.cumsum(sizes)[:-1])
        often.append(times)
    ids: dict[bytes, int] = {}
    words = [s.split(b" ") for s in streams]
    # a block under WINDOW words is one run; what fills it up is no word
    words = [w + [b""] * (WINDOW - len(w)) for w in words]
    # the host is a token of its own before each word, so suffixes of two hosts never agree
    place = {h: i for i, h in enumerate(sorted(set(hosts)))}
    tokens = np.array([place[h] * (1 << 40) + ids.setdefault(w, len(ids)) for h, s in zip(hosts, words) for w in s], np.int64)
    counts = np.array([len(s) for s in words], np.int64)
    stops = np.cumsum(counts)
    at = _ranges(stops - counts, counts - WINDOW + 1)
    owner = np.repeat(np.arange(len(counts)), counts - WINDOW + 1)
    ranks = suffix_ranks(tokens, WINDOW)[at]
    order = np.argsort(ranks, kind="stable")
    begins = np.flatnonzero(np.r_[len(order) > 0, np.diff(ranks[order]) > 0]) if len(order) else np.zeros(0, np.int64)
    times = np.concatenate(often)[owner[order]]
    held = np.array([len(p) for p in pages], np.int64)[owner[order]]
    times, held = (np.add.reduceat(x, begins) if len(begins) else x for x in (times, held))
    rows = []
    for k in np.flatnonzero((held >= DISTINCT_PAGES) | (times >= DISTINCT_PAGES)).tolist():
        group = order[begins[k] : begins[k + 1] if k + 1 < len(begins) else len(order)]
        distinct: set[int] = set()
        for stream in owner[group].tolist():
            distinct.update(pages[stream].tolist())
            if len(distinct) >= DISTINCT_PAGES:
                break
        shared = len(distinct) >= DISTINCT_PAGES
        if shared or times[k] >= DISTINCT_PAGES:
            first = int(at[group[0]])
            mine = int(owner[group[0]])
            begin = first - int(stops[mine] - counts[mine])
            rows.append((hosts[mine], b" ".join(words[mine][begin : begin + WINDOW]).rstrip(b" ").decode(), shared, int(times[k])))
    columns = zip(*rows) if rows else ((), (), (), ())
    types = (pa.string(), pa.string(), pa.bool_(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["host", "window", "shared", "times"])


def _words(region: str) -> Column:
    """The words of each block of a region."""
    found = F.filter("blocks", lambda b: b["region"] == region)
    return F.transform(found, lambda b: F.split(b["text"], " ", -1))


def _windows(words: Column) -> Column:
    """The windows of a block; a shorter block is one. ``words`` is a column, not an expression: it is used at each place."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - F.lit(WINDOW - 1)))
    return F.transform(places, lambda at: F.array_join(F.slice(words, at, WINDOW), " "))


def _everywhere(parsed: DataFrame, runs: DataFrame) -> DataFrame:
    """``row, window``: the windows of a page's article that stand on nearly every page of its host.

    A window on ARTICLE_SHARE of the pages stands, in the batches that sent it, on at least the share of all pages
    by which that exceeds BATCH_SHARE; few others do, so only their hosts' articles are looked at.
    """
    hosts = parsed.groupBy("host").agg(F.count("*").alias("pages"), F.count_distinct("page").alias("different"))
    hosts = hosts.filter(F.col("different") >= ARTICLE_PAGES)
    likely = runs.filter(F.col("times") > 0).join(hosts, "host").filter(F.col("times") >= F.floor((ARTICLE_SHARE - BATCH_SHARE) * F.col("pages")))
    likely = written(likely.select("host", "window", "pages", "different"), "pages-likely")
    asking = parsed.join(likely.select("host").distinct(), "host", "left_semi")
    asking = asking.select("row", "host", "page", F.explode(_words(BODY)).alias("words"))
    asking = asking.select("row", "host", "page", F.explode(_windows(F.col("words"))).alias("window"))
    met = written(asking.join(likely.select("host", "window"), ["host", "window"]).distinct(), "pages-article-met")
    counted = met.groupBy("host", "window").agg(F.count("*").alias("on"), F.count_distinct("page").alias("kinds")).join(likely, ["host", "window"])
    enough = (F.col("on") / F.col("pages") >= ARTICLE_SHARE) & (F.col("kinds") / F.col("different") >= ARTICLE_SHARE)
    return met.join(counted.filter(enough), ["host", "window"], "left_semi").select("row", "window")


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    The text is the declared article without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles and reader comments, and without blocks of WINDOW words or more that the host puts on
    nearly every page: those that are covered for MOSTLY by runs on ARTICLE_SHARE of its pages, counted with
    and without copies, where it has ARTICLE_PAGES different ones. If that would take more than half of
    a page's article, the pages are near copies and the article stays whole. On a page without a declared
    article the text is every block that markup does not rule out, less what the host repeats; prose beside
    an article is judged the same way.
    Repeated is a run of WINDOW words or more, or a whole shorter block, that DISTINCT_PAGES different
    pages of the host share and that stands on PAGE_SHARE of its undecided pages. A block is left out if
    repeated runs cover MOSTLY of its words, else it loses the runs of LONG_RUN words or more and keeps
    every other word. Character references are decoded, white
    space inside a block becomes one blank, blocks are joined by one blank in page order. A null html
    counts as empty and has an empty text; a null url is a host of its own. Repeated rows give repeated
    results; other columns are not read; an empty table gives no rows.
    """
    parsed = _parsed(pages)
    runs = written(_repeated(parsed), "pages-repeated")
    result = ["page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")]

    # undecided pages ask for the windows of their blocks; a window of a large host meets one row
    waiting = parsed.filter("undecided")
    asked = waiting.select("row", "host", F.explode(_words(OPEN)).alias("words"))
    asked = asked.select("row", "host", F.explode(F.array_distinct(_windows(F.col("words")))).alias("window")).distinct()
    met = written(asked.join(runs.filter("shared"), ["host", "window"]), "pages-met")
    # pages are counted in part before they are exchanged, so a run of a whole host is no hot group
    least = waiting.groupBy("host").agg(F.ceil(F.count("*") * F.lit(PAGE_SHARE)).alias("least"))
    often = met.groupBy("host", "window").count().join(least, "host").filter("count >= least").select("host", "window")
    covered = met.join(often, ["host", "window"], "left_semi").select("row", "window", F.lit(True).alias("open"))
    everywhere = _everywhere(parsed, runs).withColumn("open", F.lit(False))
    marks = covered.unionByName(everywhere).groupBy("row").agg(
        F.collect_set(F.when(F.col("open"), F.col("window"))).alias("covered"), F.collect_set(F.when(~F.col("open"), F.col("window"))).alias("everywhere")
    )
    marks = written(marks, "pages-marks")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                found = [[Block(**b) for b in page] for page in part.column("blocks").to_pylist()]
                marked = zip(part.column("covered").to_pylist(), part.column("everywhere").to_pylist())
                texts = [assembled(f, set(c or ()), set(e or ())) for f, (c, e) in zip(found, marked)]
                arrays = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text"])

    joined = parsed.select("row", "page_id", "url", "undecided", "blocks").join(marks, "row", "left")
    # an article of which the host repeats nothing is put together as it is
    whole = joined.filter("covered IS NULL AND NOT undecided").withColumn("text", F.array_join(_texts(BODY, True), " "))
    parts = joined.filter("covered IS NOT NULL OR undecided").select("page_id", "url", "blocks", "covered", "everywhere")
    settled = parts.mapInArrow(tidied(settle), "page_id long, url string, text string")
    return whole.select(*result).unionByName(settled.select(*result))
