"""Main text of pages by differencing with the page of the nearest URL; structure breaks ties.

A page is cut into lines of text, each with a zone by its place: of an article, a
link line of an article, open, or named (in an element whose class, id or role says
that it is furniture). Elements that are never article (menus, headers, footers, sidebars, forms,
scripts) give no lines. The distinct pages of a host stand in the order of their URL paths;
every page, with an article or without, is aligned with the nearer of its two neighbours by the
longest common subsequence of the lines. Shared lines are furniture of the site and are
deleted, but for prose of an article: there the structure decides, since pages
of one site quote each other. What stays of the open lines is told apart from
the article by size: the larger part is the main text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.base import schema, small_batches

#: Fixed values, by the HTML standard: elements whose content is no text of the page.
RAW = "script style template noscript textarea title iframe noembed noframes xmp".split()
HIDDEN = "head svg math object canvas audio video select option datalist map button".split()
#: Elements that are never a part of an article.
FURNITURE = "nav aside footer form dialog menu".split()
#: Elements that begin and end a block.
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Words in a class, id or role that name furniture.
NAMED = (
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer masthead menu nav navbar navigation "
    "newsletter notice notices popup modal promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget alert contentinfo complementary search"
).split()
#: Words that say nothing alone. A name is furniture if all its words are of these two lists and one is of the first.
LAYOUT = (
    "area bar block body bottom box button buttons col column container content form global group holder icon icons inner item items left link links list main outer page panel "
    "region reply respond right row section side signup site text thread title top unit widgets wrap wrapper"
).split()
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|$)",
    re.S,
)
#: An attribute: its whole name, and its value if it has one.
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_RAW, _HIDDEN, _FURNITURE, _BLOCKS, _VOID, _NAMED, _LAYOUT = map(frozenset, (RAW, HIDDEN, FURNITURE, BLOCKS, VOID, NAMED, LAYOUT))
#: The end tag of each raw element, in any case of ASCII letters; the page itself is searched, so places stay right.
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I | re.A) for name in RAW}
#: A class that only says what stands beside an element.
_BESIDE = ("has-", "with-", "no-", "without-")
#: Attributes that may tell furniture.
_TELLING = frozenset("class id role hidden aria-hidden style".split())
#: Zones of a line: prose of an article, a link line of one, outside of any, in an element that is named as furniture.
ARTICLE, LINKS, OPEN, CALLED = "a", "l", "o", "n"


def _names_furniture(token: str) -> bool:
    """Whether a class, id or role is furniture: all its words are known, and one names a kind of it."""
    words = set(_PART.findall(token))
    return not words.isdisjoint(_NAMED) and words <= _NAMED | _LAYOUT


def _furniture(name: str, attrs: str, in_article: bool) -> str:
    """``"gone"`` for an element that is furniture by its kind or hidden, ``"called"`` for one that is called so, else empty."""
    if name in _HIDDEN or name in _FURNITURE or (name == "header" and not in_article):
        return "gone"
    if not attrs or name in ("html", "body", "main"):
        return ""
    called = ""
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key not in _TELLING:
            continue
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return "gone"
        if key in ("class", "id", "role") and (name != "article" or "comment" in value):
            if any(_names_furniture(x) for x in value.split() if not x.startswith(_BESIDE)):
                called = "called"
    return called


def lines(page: str | None) -> list[tuple[str, str]]:
    """The page's lines as (zone, text) in page order, without elements that are furniture by their kind."""
    page = page or ""
    out, text, stack, open_ = [], [], [], Counter()  # stack: (name, gone, called, article, link)
    gone = called = in_article = link = at = 0
    prose = False

    def flush():
        nonlocal prose
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            if joined:
                out.append((CALLED if called else OPEN if not in_article else ARTICLE if prose else LINKS, joined))
            text.clear()
        prose = False

    def put(words: str):
        nonlocal prose  # a line is prose if any of it stands outside links
        text.append(words)
        prose = prose or not (link or words.isspace())

    def pop():
        nonlocal gone, called, in_article, link
        name, a, b, c, d = stack.pop()
        open_[name] -= 1
        gone, called, in_article, link = gone - a, called - b, in_article - c, link - d

    while found := _TAG.search(page, at):
        if not gone and found.start() > at:
            put(entities.unescape(page[at : found.start()]))
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            if found["cdata"] and not gone:
                put(found["cdata"])
            continue
        if name in _BLOCKS:
            flush()
        if found["close"]:
            if open_[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _RAW:
            end = _END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID:
            if name == "br" and not gone:
                text.append(" ")
            continue
        if name in _BLOCKS and open_["p"]:  # a p has no blocks in it, so an open one ends here
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                if k < len(stack) and stack[k][0] in _BLOCKS:
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
            pop()
        what = _furniture(name, found["attrs"], in_article > 0)
        if what == "called" and name not in _BLOCKS:  # a part of a line goes without breaking it
            what = "gone"
        own = (name, int(what == "gone"), int(what == "called"), int(name in ("article", "main")), int(name == "a"))
        stack.append(own)
        open_[name] += 1
        gone, called, in_article, link = gone + own[1], called + own[2], in_article + own[3], link + own[4]
    if not gone and at < len(page):
        put(entities.unescape(page[at:]))
    flush()
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; the scheme, query and fragment are no part of either."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or "")
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = rest.partition("/")
    return host.lower(), path.rstrip("/")


#: Cells of an alignment that is kept as bits at once; a larger one is halved first.
CELLS = 1 << 28


def common_subsequence(a: list[str], b: list[str]) -> set[int]:
    """Indexes of ``a`` in a longest common subsequence.

    Common ends and lines that only one side has are set aside; the rest is aligned by rows of
    bits, one whole number for each line of ``a``, in halves where that would not fit.
    """
    low, end = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while end < min(len(a), len(b)) - low and a[-1 - end] == b[-1 - end]:
        end += 1
    out = set(range(low)) | set(range(len(a) - end, len(a)))
    x, y = a[low : len(a) - end], b[low : len(b) - end]
    known, other = set(y), set(x)
    place = [i for i, s in enumerate(x) if s in known]
    _align([x[i] for i in place], [s for s in y if s in other], [low + i for i in place], out)
    return out


def _rows(a: list[str], b: list[str], every: bool) -> list[int]:
    """Bit j of row i is 0 where the first i lines of ``a`` have one line more in common with the first j + 1 of ``b`` than with the first j."""
    match, all_ = {}, (1 << len(b)) - 1
    for j, s in enumerate(b):
        match[s] = match.get(s, 0) | 1 << j
    row, rows = all_, []
    for s in a:
        hit = row & match.get(s, 0)
        row = ((row + hit) | (row - hit)) & all_
        if every:
            rows.append(row)
    return rows if every else [row]


def _align(a: list[str], b: list[str], place: list[int], out: set[int]) -> None:
    """Add to ``out`` the places of lines of ``a`` in a longest common subsequence."""
    if not a or not b:
        return
    if len(a) == 1 or len(a) * len(b) <= CELLS:
        rows = [(1 << len(b)) - 1, *_rows(a, b, True)]
        i, j = len(a), len(b)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.add(place[i])
        return
    half = len(a) // 2

    def gains(x: list[str], y: list[str]) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(_rows(x, y, False)[0].to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
        return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))

    cut = int(np.argmax(gains(a[:half], b) + gains(a[half:][::-1], b[::-1])[::-1]))
    _align(a[:half], b[:cut], place[:half], out)
    _align(a[half:], b[cut:], place[half:], out)


def nearness(a: tuple[str, str], b: tuple[str, str]) -> int:
    """Common leading characters of two paths of one host; -1 for different hosts."""
    if a[0] != b[0]:
        return -1
    n = 0
    for x, y in zip(a[1], b[1], strict=False):
        if x != y:
            break
        n += 1
    return n


def comparable(own: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The lines that differencing judges. Where furniture by name is all that a page has, the name says nothing and its lines are open."""
    plain = [x for x in own if x[0] != CALLED]
    return plain or [(OPEN, t) for _, t in own]


def main_text(own: list[tuple[str, str]], other: list[tuple[str, str]] | None) -> str:
    """What stays of a page beside its neighbour.

    Lines that both share go, but for prose of an article. Of two pages one of which shares
    all its lines nothing is told, so that one stays whole. Of what stays, the article or the
    open lines are left out, whichever has fewer characters; a tie is for the article.
    """
    own = comparable(own)
    shared = common_subsequence([t for _, t in own], [t for _, t in comparable(other)]) if other else set()
    if len(shared) == len(own):
        shared = set()
    stay = [x for i, x in enumerate(own) if x[0] == ARTICLE or i not in shared]
    size = Counter()
    for zone, t in stay:
        size[zone == OPEN] += len(t)
    return "\n".join(t for zone, t in stay if (zone == OPEN) == (size[True] > size[False]))


#: Pages of the sample from which the borders of the URL order are read, for each border; ranges for each task; bytes of input that a task should sort, about.
SAMPLE_PER_BUCKET, RANGES, TASK_BYTES = 12, 4, 64 << 20


def _page(url: Column) -> Column:
    """Host and path of a URL, as in :func:`split_url`, between a byte that sorts before all others of a URL."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#][\s\S]*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/]*)", 1))
    return F.concat_ws("\x01", host, F.regexp_replace(F.regexp_extract(rest, r"^[^/]*/([\s\S]*)$", 1), r"/+$", ""))


def _in_ranges(df: DataFrame, cuts: list[str]) -> DataFrame:
    """The number of borders at or before each key, by bisection."""
    borders, steps, step = F.array(*map(F.lit, cuts)).cast("array<string>"), [], 1
    while step <= len(cuts):
        steps.insert(0, F.lit(step))
        step *= 2
    if not steps:
        return df.withColumn("bucket", F.lit(0))
    found = F.aggregate(F.array(*steps), F.lit(0), lambda low, by: F.when(F.get(borders, low + by - 1) <= F.col("key"), low + by).otherwise(low))
    return df.withColumn("bucket", found)


def _tasks(pages: DataFrame) -> int:
    """Shuffle partitions of the session, or more where the files are large."""
    size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 52  # where Spark knows nothing it assumes far more
    return max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES if known else 0)


def _borders(pages: DataFrame, keyed: DataFrame) -> list[str]:
    """Borders between ranges of keys, a few ranges for each task, from a bounded sample; results do not depend on them."""
    buckets = RANGES * _tasks(pages)
    sample = keyed.select("key").orderBy(F.xxhash64("key"), "key").limit(buckets * SAMPLE_PER_BUCKET).collect()
    order = sorted((r[0] for r in sample), key=str.encode)
    return sorted({order[i * len(order) // buckets] for i in range(1, buckets)}, key=str.encode) if order else []


def _visits(keyed: DataFrame, cuts: list[str]) -> list[tuple[str, int]]:
    """(key, range): the last other page before each range and the first after it, from four keys of each range.

    Copies of a page (one host, path and html) are one page, and may fill whole ranges.
    """
    placed = _in_ranges(keyed.select("page", "key"), cuts)
    low, high = F.min(F.struct("key", "page")), F.max(F.struct("key", "page"))
    ends = {r["bucket"]: r for r in placed.groupBy("bucket").agg(low.alias("low"), high.alias("high")).collect()}  # one row for each range
    end = lambda name: F.get(F.array(*[F.lit(ends[k][name]["page"] if k in ends else None) for k in range(len(cuts) + 1)]).cast("array<string>"), F.col("bucket"))
    told = placed.groupBy("bucket").agg(
        low.alias("low"), high.alias("high"),
        F.max(F.when(F.col("page") != end("high"), F.struct("key", "page"))).alias("earlier"),
        F.min(F.when(F.col("page") != end("low"), F.struct("key", "page"))).alias("later"),
    )
    rows = told.orderBy("bucket").collect()
    out = []
    for i, row in enumerate(rows):
        before = (x for r in rows[:i][::-1] for x in (r["high"], r["earlier"]) if x and x["page"] != row["low"]["page"])
        after = (x for r in rows[i + 1 :] for x in (r["low"], r["later"]) if x and x["page"] != row["high"]["page"])
        out += [(x["key"], row["bucket"]) for x in (next(before, None), next(after, None)) if x]
    return out


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``(page_id, url, html)``; other columns are ignored.

    A null or textless page has an empty text. A null url is the empty one, on the empty host.
    Rows with one host, path and html are copies of one page: all get its text, and none is
    another's neighbour. Repeated rows come out repeated, an empty table stays empty. Neighbours are by the order of path and
    html, so the result does not depend on the partitions: ranges know the pages next to them.
    A page is parsed once, where it is compared; a very long one costs its lines times
    its neighbour's through 64, and its memory is bounded by that of ``CELLS`` bits and the pages themselves.
    """
    spark = pages.sparkSession
    small_batches(spark)
    page = F.concat_ws("\x01", _page(F.col("url")), F.sha2(F.coalesce("html", F.lit("")), 256))
    keyed = pages.select("page_id", "url", "html", page.alias("page")).withColumn("key", F.concat_ws("\x01", "page", F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    cuts = _borders(pages, keyed)
    placed = _in_ranges(keyed, cuts).withColumn("own", F.lit(True))
    visits = F.broadcast(spark.createDataFrame(_visits(keyed, cuts), "key string, visited int"))  # two rows for each range
    guest = keyed.join(visits, "key").withColumn("own", F.lit(False)).withColumnRenamed("visited", "bucket")
    dealt = placed.unionByName(guest.select(*placed.columns)).repartition(_tasks(pages), "bucket").sortWithinPartitions("bucket", "key", "own")
    told = dealt.select("page_id", "url", "html", "page", "bucket", "own").mapInArrow(_compared, schema(pages, "page_id", "url", text="string"))
    return told.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _compared(batches):
    """Walk the sorted pages with the other page before and the one after at hand; copies of a page wait for its text together."""
    out, copies, before, here, page = [], [], None, None, None
    kinds = None

    def told(after):
        if copies:
            near = [(nearness(here[0], x[0]), x[2]) for x in (before, after) if x is not None and x[1] == here[1]]
            near = [x for x in near if x[0] >= 0]
            text = main_text(here[2], max(near, key=lambda x: x[0])[1] if near else None)
            out.extend((*x, text) for x in copies)
            copies.clear()

    def arrow():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["page_id", "url", "text"])

    for batch in batches:
        kinds = (batch.schema.field(0).type, batch.schema.field(1).type, pa.string())
        for page_id, url, html, name, bucket, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (name, bucket) != page:
                next_ = (split_url(url), bucket, lines(html))
                told(next_)
                before, here, page = here, next_, (name, bucket)
            if own:
                copies.append((page_id, url))
            if len(out) >= 256:
                yield arrow()
                out.clear()
    told(None)
    if out:
        yield arrow()
