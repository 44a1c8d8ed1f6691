"""Main text of web pages: a tolerant parser, and a suffix array for each host that finds repeated boilerplate.

The parser makes blocks and marks each as main (inside article or main), open (the page has neither) or boilerplate
(inside an element that by its tag, role, class or id is a menu, header, footer, sidebar, notice, advert, form or
reader comments, or is hidden; inside an article only what is put into one counts, so its headings and paragraphs stay
whatever they are called). A block's pieces of text keep their own kinds, so a button within a paragraph goes and the paragraph stays. Scripts, styles and comments give no blocks.

The blocks of a page outside its article are a stream of words. The streams of a host are concatenated, with a
separator of its own after each page, and their suffixes sorted to a depth of RUN words by prefix doubling; suffixes
that agree so far are neighbours. Words in a run of RUN or more that occurs on PAGES or more distinct pages are
covered. Open blocks lose their covered words and keep their unique runs; a page that would keep nearly nothing is
a copy of others, not boilerplate, and stays whole. Articles are never cut. A host of over HOST_WORDS words would fill
a task; there each page gives its distinct runs of RUN words, the pages of each run are counted by a hash aggregate,
and the runs on PAGES or more meet the open pages in a join. The cuts are those of the suffix array.

Defined results: null or empty html has empty text; a null url belongs to the host ""; repeated rows are separate
pages; truncated markup, unclosed elements and stray end tags are tolerated; white space is what str.split takes for
it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import in_batches, small, staged

RUN, PAGES = 8, 3
#: Words of a host that one task takes.
HOST_WORDS = 1_000_000

#: Element names of HTML, by what they mean here.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas select option audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
ASIDE = frozenset("head nav header footer aside form menu dialog search button".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside related recommended cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup login share sharing social comment comments reply replies discussion disqus pagination pager toolbar copyright legal".split()
)

#: What counts inside an article. Names of things that are put into one, whatever else is in the name; names that say so
#: alone or beside words of layout ("related-posts", but not "related-work"); and, of boxes, names of menus and notices, unless
#: the element has a name of the article's own ("entry-alert", "post-content menu").
INSERTED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored disqus pagination pager breadcrumb breadcrumbs cookie cookies consent gdpr popup modal sidebar newsletter nav navbar".split())
UNSURE = frozenset("social related recommended share sharing comment comments replies subscribe signup promo promotion overlay".split())
LAYOUT = frozenset("area articles article bar block body bottom box button buttons col container content entry feed footer form group header icon icons inner items item left link links list main media menu module more page panel post posts reader readers right row section site stories story text thread title tools top unit user users widget wrap wrapper".split())
NOTICES = frozenset("notice notices alert toolbar login aside menu navigation footer banner masthead discussion copyright".split())
OWN = frozenset("article post entry story content text body title main page".split())
BOXES = frozenset("div section aside ul ol dl table details figure fieldset dialog form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

MAIN, OPEN, BOILERPLATE = 0, 1, 2


def _is_aside(tag: str, raw: str, in_main: bool) -> bool:
    if tag in ASIDE and not (tag == "header" and in_main):
        return True
    if not raw.strip() or tag in ("html", "body", "article", "main"):
        return False
    at = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)}
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(at.get("style", "")):
        return True
    if at.get("role", "").lower() in ROLES:
        return True
    names = [(n, set(re.split(r"[^a-z0-9]+", n)) - {""}) for n in f"{at.get('class', '')} {at.get('id', '')}".lower().split()]
    if not in_main:
        return any(WORDS & parts for _, parts in names)
    if tag in BOXES:
        own = any(OWN & parts for _, parts in names)
        return any(INSERTED & parts or UNSURE & parts and all(x in UNSURE | NOTICES | LAYOUT or x.isdigit() for x in parts) or NOTICES & parts and not own for _, parts in names)
    return any(n in INSERTED | UNSURE for n, _ in names)


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the non-empty blocks, in page order."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, in boilerplate, in main
    opened: Counter = Counter()  # tags on the stack, so that one that isn't there isn't searched for
    text: list[tuple[int, str]] = []  # each piece with its own kind, as an element needn't be closed when the block ends
    has_main = skipping = None
    pos, page = 0, page or ""

    def flush() -> None:
        for kind in dict.fromkeys(k for k, _ in text):
            if words := html.unescape("".join(t for k, t in text if k == kind)).split():
                found.append((kind, " ".join(words)))
        text.clear()

    def add(piece: str) -> None:
        _, aside, main = stack[-1] if stack else ("", False, False)
        text.append((BOILERPLATE if aside else MAIN if main else OPEN, piece))

    def cut(i: int) -> None:
        opened.subtract(t for t, _, _ in stack[i:])
        del stack[i:]

    size = len(page)
    while pos < size:
        m = _TOKEN.match(page, pos)
        if m is None:  # a quote that isn't closed
            end = page.find(">", pos)
            pos = size if end < 0 else end + 1
            continue
        pos, tag = m.end(), m[2]
        if tag is None:
            if not (piece := m[0]).startswith("<!") and not piece.startswith("<?"):
                add(piece)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                add(" ")
            if tag in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    cut(i)
                    break
                if tag not in BLOCKS and stack[i][0] in BLOCKS:
                    break  # an end of an inline element doesn't end blocks
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = close.end() if close else size
            continue
        if tag in BLOCKS:
            flush()
        if tag == "br":
            add(" ")
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        if tag == "body":  # a head that wasn't closed
            kept = [s for s in stack if s[0] == "html"]
            cut(0)
            stack += kept
            opened["html"] += len(kept)
        if tag in ENDS_P and opened["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    cut(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            cut(len(stack) - 1)
        _, aside, main = stack[-1] if stack else ("", False, False)
        main = main or (tag in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main\b", m[3], re.I))) and not aside
        has_main = has_main or main
        stack.append((tag, aside or _is_aside(tag, m[3], main), main))
        opened[tag] += 1
    flush()
    # with an article, what is outside of it isn't main text
    return [(BOILERPLATE if has_main and k == OPEN else k, t) for k, t in found]


def covered(streams: list[np.ndarray], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each page's words, which are in a run of `run` words on at least `pages` of the pages; run is a power of 2."""
    lengths = np.array([len(s) for s in streams], np.int64)
    n = int(lengths.sum()) + len(streams)
    words, page = np.empty(n, np.int64), np.repeat(np.arange(len(streams)), lengths + 1)
    at = np.cumsum(lengths + 1) - lengths - 1
    for k, s in enumerate(streams):
        words[at[k] : at[k] + len(s)] = s
        words[at[k] + len(s)] = -1 - k  # the page's separator
    rank, depth = np.unique(words, return_inverse=True)[1], 1
    while depth < run:
        after = np.zeros(n, np.int64)
        after[:-depth] = rank[depth:] + 1
        rank, depth = np.unique(rank * (n + 1) + after, return_inverse=True)[1], 2 * depth
    suffixes = np.argsort(rank, kind="stable")  # sorted to depth `run`; pages ascend among equals
    first = np.ones(n, bool)
    first[1:] = (rank[suffixes][1:] != rank[suffixes][:-1]) | (page[suffixes][1:] != page[suffixes][:-1])
    distinct = np.bincount(rank[suffixes], first)
    starts = np.flatnonzero(distinct[rank] >= pages)
    edge = np.zeros(n + run + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    mask = np.cumsum(edge)[:n] > 0
    return [mask[a : a + k] for a, k in zip(at, lengths, strict=True)]


def word_number(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


_PAGES = "key long, page_id long, url string, host string, kinds array<int>, texts array<string>, words array<int>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = TaskContext.get().partitionId() << 40
    for batch in batches:
        rows = []
        for page, url, source in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
            blocks = blocks_of(source.as_py())
            host = re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)", url or "")
            # open blocks first, so that places in the stream are places in the open text
            words = [w for kind in (OPEN, BOILERPLATE) for k, t in blocks if k == kind for w in t.split(" ")]
            numbers = np.fromiter(map(word_number, words), np.uint32, len(words)).view(np.int32)
            # boilerplate is only in the stream; its text isn't needed again
            rows.append((key, page, url, host[1].lower() if host else "", [k for k, _ in blocks], [None if k == BOILERPLATE else t for k, t in blocks], numbers.tolist()))
            key += 1
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], names=[f.split()[0] for f in _PAGES.split(", ")])


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("key")
    masks = covered([np.asarray(w, np.int64) for w in pdf["words"]])
    cut = [(k, np.flatnonzero(m).astype(np.int32)) for k, m, o in zip(pdf["key"], masks, pdf["is_open"], strict=True) if o and m.any()]
    return pd.DataFrame(cut, columns=["key", "covered"])


def _large_host_runs(streams: DataFrame) -> DataFrame:
    """What _repeated gives, for hosts of any size: pages are counted for each run of a host, then runs meet their pages."""
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - RUN + 1), lambda i: F.slice("words", i, RUN))
    streams = streams.where(F.size("words") >= RUN)
    counts = streams.select("host", F.explode(F.array_distinct(runs)).alias("run")).groupBy("host", "run").count()
    common = staged(counts.where(F.col("count") >= PAGES).select("host", "run"), "html-common")
    places = streams.where("is_open").select("host", "key", F.posexplode(runs).alias("at", "run"))
    found = places.join(small(common), ["host", "run"]).groupBy("key").agg(F.collect_list("at").alias("starts"))
    steps = F.transform("starts", lambda i: F.sequence(i, i + (RUN - 1)))
    return found.select("key", F.array_sort(F.array_distinct(F.flatten(steps))).alias("covered"))


def host_runs(parsed: DataFrame, host_words: int = HOST_WORDS) -> DataFrame:
    """key, covered (places of the stream's covered words) of the pages with open blocks that have any."""
    streams = parsed.where(F.size("words") > 0).select("host", "key", "words", F.array_contains("kinds", OPEN).alias("is_open"))
    # a host without open pages has nothing to cut
    sizes = streams.groupBy("host").agg(F.sum(F.size("words")).alias("host_words"), F.max("is_open").alias("any_open")).where("any_open")
    hosts = small(staged(sizes.select("host", "host_words"), "html-hosts"), 100_000)
    dealt = streams.join(hosts, "host")
    fits = dealt.where(F.col("host_words") <= host_words).select("host", "key", "words", "is_open").groupBy("host").applyInPandas(_repeated, "key long, covered array<int>")
    if not hosts.where(F.col("host_words") > host_words).limit(1).count():
        return fits
    return fits.union(_large_host_runs(dealt.where(F.col("host_words") > host_words)))


@F.arrow_udf(T.StringType())
def _assembled(kinds: pa.Array, texts: pa.Array, cuts: pa.Array) -> pa.Array:
    out = []
    for k, t, c in zip(kinds.to_pylist(), texts.to_pylist(), cuts.to_pylist(), strict=True):
        n = sum(len(b.split(" ")) for kind, b in zip(k, t, strict=True) if kind == OPEN) if c else 0
        gone = {i for i in c or () if i < n}
        if gone:
            if n - len(gone) < max(5, 0.1 * n):
                gone = set()
        at, blocks = 0, []
        for kind, block in zip(k, t, strict=True):
            if kind == OPEN:
                words = block.split(" ")
                block = " ".join(w for i, w in enumerate(words, at) if i not in gone)
                at += len(words)
            if kind != BOILERPLATE and block:
                blocks.append(block)
        out.append("\n\n".join(blocks))
    return pa.array(out, pa.string())


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_words: int = HOST_WORDS) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages; a host of over shard_words words is spread over tasks."""
    source = in_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = staged(source.mapInArrow(_parsed, _PAGES), "html-pages")
    cuts = staged(host_runs(parsed, shard_words), "html-runs")
    rows = parsed.select("key", "page_id", "url", "kinds", "texts").join(small(cuts), "key", "left")
    return rows.withColumn("text", _assembled("kinds", "texts", "covered")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
