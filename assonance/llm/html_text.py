"""Main text of pages by site style trees.

The DOMs of a host are merged: an element is the path of tags, classes and
ids that leads to it, and for each element the tree counts the pages that
have it, the presentations (sequences of child elements) and the contents
(blocks of text below it).  With m pages, the importance of an element is

    GAMMA * (1 - mean over contents of log_m(pages with that content))
    + (1 - GAMMA) * (entropy to base m of its presentations):

what says the same on every page, in the same form, has none.  The tree also
holds what part of a page's text an element has and how much of that is link
text.  An element that stands on ``MIN_PAGES`` pages is judged; it is low, and
is cut from all pages, if its importance is under ``LEAST``, if over ``LINKS``
of its text is link text (a menu of other words on each page), or if it stands
beside the article with less than ``SHARE`` of the text.  Hosts of fewer than
``MIN_HOST`` pages have no statistics of their own: they share one tree, in
which equal paths of all of them count together.

Pages of a tree with equal html (by MD5) count as one page.  Inside an article
or main element the tree may cut only containers, never paragraphs, headings,
lists or tables, and what is around an article can't cut it.

What HTML itself says isn't shown or isn't text (script, style, form, hidden
...) goes on every page, and so do reader comments, whose words differ on
every page.  Landmarks (nav, footer, aside, a header beside the article, and
elements of such roles) and names of classes and ids (adverts, sidebars,
notices) are only a presumption: what an element so called has goes unless the
tree has judged it and found at least ``NAMED`` of its pages' text in it, or,
where it hasn't been judged, at least half of the article's text on the page
at hand stands in it.  A name counts by its last word (``share-prices`` are
prices), after words such as list or box.  Of what the tree hasn't judged,
nothing beside an article stays.  A page is never cut to nothing: what leaves
no text is undone, first the tree's cuts, then the names', never landmarks.

A null or empty page has an empty text.  Null hosts form one host.  Unclosed
and truncated markup is closed at the end of the page; a tag that isn't ended
is dropped.  Pages may be long and deep.  Repeated rows have results of their
own; an empty table gives no rows; further columns stay inside ``row``.
Memory: one batch of pages, and the judged elements (up to ``VERDICTS`` in
each worker; beyond that each page meets its own by a join).
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assonance.llm.batches import small_batches
from assonance.plans.durable import durable
from assonance.plans.joins import bounded_join, skewed_join

GAMMA, LEAST, LINKS, SHARE, NAMED = 0.9, 0.4, 0.6, 0.15, 0.3
MIN_PAGES, MIN_HOST = 10, 30
#: Judged elements that every worker may hold (17 bytes each).
VERDICTS = 1_000_000

# HTML's own lists, and words that name what isn't the article.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
    "thead": ("thead tbody tfoot tr td th", ("table",)), "tbody": ("thead tbody tfoot tr td th", ("table",)),
}
NOT_TEXT = frozenset(
    "head script style noscript template form button select textarea input iframe svg canvas object dialog menu "
    "title xmp noembed noframes audio video map".split()
)
LANDMARKS = frozenset("nav footer aside".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
COMMENTS = frozenset("comment comments commentlist disqus replies".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "sidebar footer cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login share "
    "sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar contentinfo complementary "
    "alertdialog dialog search reply respond".split()
)
#: Words of a name that say nothing behind another, and words before which a name says what isn't there.
BEHIND = frozenset("list area section wrapper wrap container box block slot unit left right top bottom inner outer panel form item items posts articles stories".split())
BEFORE = frozenset("no not has with without is".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody tr td th article main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z|<([a-zA-Z][^\s/>]*)[^>]*>", re.S)
#: One attribute after the other, so that nothing inside a value or a longer name is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


#: What speaks against an element: nothing, a name of a class or id, a landmark.
UNNAMED, NAME, LANDMARK = range(3)


class Node:
    __slots__ = ("tag", "path", "parent", "noise", "says", "named", "inside", "holds", "children", "chars", "links")

    def __init__(self, tag: str, path: int, parent: Node | None, noise: bool, says: int, named: int, inside: bool) -> None:
        self.tag, self.path, self.parent, self.noise, self.inside = tag, path, parent, noise, inside
        #: What its own name says, and the most that those around it say.
        self.says, self.named = says, named
        self.children: list[int] = []
        #: Whether an article or main element is inside; characters of its own text, and of links in it.
        self.holds, self.chars, self.links = False, 0, 0


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _says(names: str) -> set[str]:
    """The word that each name of a class or id attribute comes to."""
    out = set()
    for name in names.split():
        parts = [w.lower() for w in _NAME_PART.findall(name)]
        while len(parts) > 1 and parts[-1] in BEHIND:
            parts.pop()
        if parts and parts[0] not in BEFORE:
            out.add(parts[-1])
    return out


def _attributes(told: str) -> dict[str, str]:
    """Attributes by their lower-case names; of one name the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(told):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _open(tag: str, attributes: str, parent: Node) -> Node:
    found = _attributes(attributes) if attributes else {}
    names = f"{found.get('class', '')} {found.get('id', '')}" if found else ""
    form = _hash(f"{tag} {_DIGITS.sub('#', ' '.join(sorted(names.split())))}") if names.strip() else _hash(tag)
    noise, says = parent.noise, UNNAMED
    article = tag in ("article", "main")
    if not noise and not article and tag not in ("html", "body"):
        said = _says(names) if names else set()
        noise = (
            tag in NOT_TEXT
            or not COMMENTS.isdisjoint(said)
            or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        )
        if tag in LANDMARKS or found.get("role", "").lower() in ROLES or tag == "header" and not parent.inside:
            says = LANDMARK
        elif tag not in PLAIN and (not NAMES.isdisjoint(said) or not parent.inside and "header" in said):
            says = NAME
    parent.children.append(form)
    path = _hash(f"{parent.path} {form}")
    named = max(parent.named, says)
    inside = parent.inside or article and not noise and named < LANDMARK
    if inside and not parent.inside:
        # What is around an article doesn't speak for it.
        named = UNNAMED
        around: Node | None = parent
        while around is not None and not around.holds:
            around.holds = True
            around = around.parent
    return Node(tag, path, parent, noise, says, named, inside)


def blocks(page: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """Blocks of text with the element each stands in, in page order, and all elements that aren't inline."""
    root = Node("", 0, None, False, UNNAMED, UNNAMED, False)
    now, every, out, held = root, [], [], []
    at, size = 0, len(page)
    in_link, linked = False, 0

    def flush() -> None:
        nonlocal in_link, linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((now, text))
                now.chars += len(text)
                now.links += min(linked, len(text))
        in_link, linked = False, 0

    def pop_to(node: Node) -> None:
        nonlocal now
        flush()
        now = node.parent

    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            held.append(page[at:])
            break
        start, end = found.span()
        if start > at:
            held.append(page[at:start])
            if in_link:
                linked += start - at
        at = end
        tag = found[2] or found[4]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            if tag in INLINE or tag in VOID:
                in_link = in_link and tag != "a"
                continue
            node = now
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                pop_to(node)
            continue
        attributes = found[3] or ""
        if tag in RAW:
            flush()
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            every.append(_open(tag, "", now))
            at = close.end() if close else size
            continue
        if tag in INLINE:
            in_link = in_link or tag == "a"
            continue
        if tag in VOID:
            held.append(" ")
            continue
        flush()
        if now.tag == "p":
            now = now.parent
        if tag in CLOSES:
            ended, stops = CLOSES[tag]
            node, last = now, None
            while node is not root and node.tag not in stops:
                if node.tag in ended.split():
                    last = node
                node = node.parent
            if last is not None:
                now = last.parent
        now = _open(tag, attributes, now)
        every.append(now)
        if attributes.endswith("/") and tag in ("svg", "path", "math"):
            now = now.parent
    flush()
    return out, every


Paths = frozenset[int] | set[int]
TOP = ("", "html", "body")


def _large_here(told: list[tuple[Node, str]], article: bool) -> set[int]:
    """Elements with a name that speaks against them, but with half of the article's text (without one, of all text) or more."""
    bound = [(n, len(t)) for n, t in told if n.inside or not article]
    below: Counter = Counter()
    for node, size in bound:
        at: Node | None = node
        while at is not None and at.named:
            if at.says == NAME:
                below[id(at)] += size
            at = at.parent
    half = sum(size for _, size in bound) / 2
    return {k for k, size in below.items() if size >= half}


def main_text(page: str | None, low: Paths, known: Paths = frozenset(), large: Paths = frozenset()) -> str:
    """The text of a page; ``low`` are the paths that the tree cuts, ``known`` and ``large`` (and these) those that it has judged, ``large`` those with much of their pages' text."""
    if not page:
        return ""
    found, _ = blocks(page)
    told = [(n, t) for n, t in found if not n.noise]
    article = any(n.inside for n, _ in told)
    here = _large_here(told, article) if article and any(n.named for n, _ in told) else ()
    states: dict[int, tuple[bool, bool, bool]] = {}

    def state(node: Node) -> tuple[bool, bool, bool]:
        """Whether the element or one around it (an article looks no further) is low, is judged, is cut for what it's called; pages may nest deeper than calls can."""
        chain: list[Node] = []
        at: Node | None = node
        while at is not None and at.tag not in TOP and id(at) not in states:
            chain.append(at)
            at = at.parent
        last = (False, False, False) if at is None or at.tag in TOP else states[id(at)]
        for n in reversed(chain):
            if n.tag in ("article", "main") and n.inside and not n.parent.inside:
                last = (False, False, False)
            else:
                judged = n.path in low or n.path in known or n.path in large
                named = n.says and n.path not in large and (judged or id(n) not in here)
                if n.holds:
                    last = (last[0], last[1], last[2] or bool(named))
                else:
                    is_low = n.path in low and not (n.inside and n.tag in PLAIN)
                    last = (last[0] or is_low, last[1] or judged, last[2] or bool(named))
            states[id(n)] = last
        return last

    def stays(node: Node) -> bool:
        cut, judged, named = state(node)
        return not cut and not named and (node.inside or not article or judged)

    kept = [t for n, t in told if stays(n)]
    if not kept:
        bound = [(n, t) for n, t in told if n.inside] if article else told
        kept = [t for n, t in bound if not n.named] or [t for n, t in bound if n.named < LANDMARK]
    return " ".join(kept)


PRESENCE, STYLE, CONTENT, PART, LINKED, BESIDE = range(6)
#: Verdicts, in the order in which ``main_text`` takes their paths.
LOW, KNOWN, LARGE = range(3)


def _page_counts(page: str, counts: Counter, pool: int, share: float) -> None:
    found, every = blocks(page)
    every = [n for n in every if not n.noise and n.tag not in ("html", "body", "head")]
    seen: set[tuple[int, int, int]] = set()
    for node in every:
        seen.add((node.path, PRESENCE, 0))
        if node.children:
            form = [c for c, before in zip(node.children, [None, *node.children], strict=False) if c != before]
            seen.add((node.path, STYLE, hash(tuple(form))))
    sizes: dict[int, list[int]] = {}
    total, article = 0, any(n.inside for n in every)
    for node, text in found:
        if node.noise:
            continue
        total += len(text)
        content = _hash(text)
        at: Node | None = node
        while at is not None and at.tag not in TOP:
            seen.add((at.path, CONTENT, content))
            at = at.parent
    for node in every:
        at, above = node, set()
        while at is not None and at.tag not in TOP and (node.chars or node.links):
            if at.path not in above:
                above.add(at.path)
                size = sizes.setdefault(at.path, [0, 0])
                size[0] += node.chars
                size[1] += node.links
            at = at.parent
    for x in seen:
        counts[(pool, *x)] += share
    for path, (chars, links) in sizes.items():
        counts[(pool, path, PART, 0)] += share * chars / max(total, 1)
        counts[(pool, path, LINKED, 0)] += share * links / max(chars, 1)
    if article:
        for path in {n.path for n in every if not n.inside and not n.holds}:
            counts[(pool, path, BESIDE, 0)] += share


def site_counts(pages: DataFrame) -> DataFrame:
    """``pool``, ``path``, ``kind``, ``feature``, ``n`` of ``pool``, ``html`` and ``copies``, summed within a batch.

    Each of the ``copies`` rows of a page counts for its part, so that together they are one page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for pool, page, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page:
                    _page_counts(page, counts, pool, 1 / copies)
            keys = list(zip(*counts, strict=True)) if counts else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.int32()), pa.array(keys[3], pa.int64()), pa.array(counts.values(), pa.float64())],
                names=["pool", "path", "kind", "feature", "n"],
            )

    return pages.mapInArrow(run, "pool long, path long, kind int, feature long, n double")


def importance(counts: DataFrame) -> DataFrame:
    """``pool``, ``path``, ``pages``, ``importance``, ``part``, ``linked`` and ``beside`` (shares) of each element of each tree."""
    total = F.sum("n")
    each = counts.groupBy("pool", "path", "kind", "feature").agg(total.alias("n"))
    each = each.withColumn("n", F.when(F.col("kind") <= CONTENT, F.round("n")).otherwise(F.col("n")))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    sums = each.groupBy("pool", "path").agg(
        of(PRESENCE, F.col("n")).alias("pages"),
        of(STYLE, F.col("n")).alias("styled"),
        of(STYLE, F.col("n") * F.log("n")).alias("style_logs"),
        of(CONTENT, F.log("n")).alias("content_logs"),
        of(CONTENT, F.lit(1)).alias("contents"),
        *[of(k, F.col("n")).alias(c) for k, c in ((PART, "part"), (LINKED, "linked"), (BESIDE, "beside"))],
    )
    base = F.log("pages")
    content = F.when(F.col("contents") > 0, 1 - F.col("content_logs") / F.col("contents") / base).otherwise(0.0)
    style = F.coalesce((F.log("styled") - F.col("style_logs") / F.col("styled")) / base, F.lit(0.0))
    shares = [(F.coalesce(c, F.lit(0.0)) / F.col("pages")).alias(c) for c in ("part", "linked", "beside")]
    return sums.where(F.col("pages") > 1).select("pool", "path", "pages", (GAMMA * content + (1 - GAMMA) * style).alias("importance"), *shares)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def verdicts(pages: DataFrame, url: str = "url", html: str = "html", least: float = LEAST, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame, int]:
    """``pool``, ``path`` and ``verdict`` of all judged elements; the hosts that have a tree of their own, and how many."""
    keyed = pages.select(F.xxhash64(host_of(F.col(f"`{url}`"))).alias("host"), F.col(f"`{html}`").alias("html"), F.unhex(F.md5(f"`{html}`")).alias("digest"))
    distinct = durable(keyed.where(F.col("digest").isNotNull()).groupBy("host", "digest").agg(F.count("*").alias("copies")))
    large = durable(distinct.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_HOST).select("host", F.col("host").alias("own")))
    n_large = large.count()
    pooled = lambda t: bounded_join(t, large, ["host"], "left", n_large, spread=F.xxhash64("digest")).withColumn("pool", F.coalesce("own", F.lit(0)))
    copied = durable(pooled(distinct).groupBy("pool", "digest").agg(F.sum("copies").alias("copies")).where(F.col("copies") > 1))
    told = bounded_join(pooled(keyed), copied, ["pool", "digest"], "left", copied.count(), spread=F.monotonically_increasing_id())
    counts = site_counts(told.select("pool", "html", F.coalesce("copies", F.lit(1)).alias("copies")))
    low = (F.col("importance") < least) | (F.col("linked") > LINKS) | (F.col("beside") > 0.5) & (F.col("part") < SHARE)
    judged = importance(counts).where(F.col("pages") >= min_pages)
    kind = F.when(low, LOW).when(F.col("part") >= NAMED, LARGE).otherwise(KNOWN).cast("tinyint").alias("verdict")
    return durable(judged.select("pool", "path", kind)), large, n_large


class _Judged:
    """All verdicts in a worker, as sorted arrays; those of a pool as sets once a page of it is met."""

    def __init__(self, pool: np.ndarray, path: np.ndarray, verdict: np.ndarray) -> None:
        order = np.argsort(pool, kind="stable")
        self.pool, self.path, self.verdict = pool[order], path[order], verdict[order]
        self.met: dict[int, tuple[frozenset[int], ...]] = {}

    def of(self, pool: int) -> tuple[frozenset[int], ...]:
        if pool not in self.met:
            if len(self.met) >= 64:
                self.met.clear()
            here = slice(*np.searchsorted(self.pool, [pool, pool + 1]).tolist())
            path, verdict = self.path[here], self.verdict[here]
            self.met[pool] = tuple(frozenset(path[verdict == v].tolist()) for v in (LOW, KNOWN, LARGE))
        return self.met[pool]


def extract(pages: DataFrame, url: str = "url", html: str = "html", least: float = LEAST, min_pages: int = MIN_PAGES, limit: int = VERDICTS) -> DataFrame:
    """Columns ``row`` (the page without its html, as a struct) and ``text``."""
    small_batches(pages.sparkSession)
    judged, large, n_large = verdicts(pages, url, html, least, min_pages)
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html]).alias("row"), F.xxhash64(host_of(F.col(f"`{url}`"))).alias("host"), F.col(f"`{html}`").alias("html")
    )
    rows = bounded_join(rows, large, ["host"], "left", n_large, spread=F.xxhash64("row")).select("row", F.coalesce("own", F.lit(0)).alias("pool"), "html")
    if judged.count() > limit:
        return _joined(rows, judged)
    table = judged.toArrow()
    held = pages.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pool", "path", "verdict")))

    @F.arrow_udf("string")
    def text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = _Judged(*held.value)
        for page, pool in batches:
            yield pa.array([main_text(p, *known.of(x)) for p, x in zip(page.to_pylist(), pool.to_pylist(), strict=True)], pa.string())

    return rows.select("row", text("html", "pool").alias("text"))


def _joined(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """As ``extract`` where the verdicts are too many for a worker: each page meets those of its own elements."""
    stored = durable(rows.withColumn("id", F.monotonically_increasing_id()))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, pool, path) for i, pool, page in zip(*(c.to_pylist() for c in batch.columns), strict=True) if page for path in {n.path for n in blocks(page)[1]}]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["id", "pool", "path"])

    each = stored.select("id", "pool", "html").mapInArrow(paths, "id long, pool long, path long")
    met = skewed_join(durable(each), judged, ["pool", "path"], spread=F.xxhash64("id"))
    of = lambda v: F.collect_list(F.when(F.col("verdict") == v, F.col("path")))
    own = stored.join(met.groupBy("id").agg(of(LOW).alias("low"), of(KNOWN).alias("known"), of(LARGE).alias("large")), "id", "left")

    @F.arrow_udf("string")
    def text(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(p, *(set(x or ()) for x in paths)) for p, *paths in zip(*(c.to_pylist() for c in batch), strict=True)], pa.string())

    return own.select("row", text("html", "low", "known", "large").alias("text"))
