"""Main text of web pages by site style trees."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Tables, fresh

#: A comment, a closing or opening tag (quotes may hold >), or a declaration.  What matches nothing here is text.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements whose text is not markup: it ends only at their own closing tag.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
#: Elements whose text no page shows, or that hold no text of a reader's.
_NEVER = set("script style template noscript iframe object embed svg math canvas audio video map head title form button select textarea input option datalist dialog noembed noframes xmp search".split())
#: Elements that by HTML's meaning lie beside the main text.
_BESIDE = set("nav menu aside footer".split())
#: An opening tag here ends an open element of the second kind.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that name what is not the main text.
_ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banners?|nav(?:bar|igation)?|menus?|breadcrumbs?|header|masthead|topbar|footer|bottombar|side(?:bar)?|aside|complementary|contentinfo|widgets?|cookies?|consent|gdpr|notices?|notifications?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|login|search|forms?|share|sharing|social|related|recommended|comments?|commentlist|respond|disqus|replies|pagination|pager|toolbar|tags|tagcloud|copyright|legal|skip(?:link)?)(?=$|[\s_-])",
    re.I,
)
#: Names that only say how a page is laid out, such as has-sidebar or no-comments.
_LAYOUT = re.compile(r"(?:^|\s)(?:has|no|with|without|is)[_-]\S*", re.I)
_READERS = re.compile(r"comment|repl(?:y|ies)|respond|disqus", re.I)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|articlebody)(?=$|[\s_-])", re.I)
#: Branches with a lower importance go; what names and elements call an aside has BESIDE times the importance of its branch, unless
#: only a name does and the branch holds MASS of the text on its host's pages: that is what the pages are about.
LEAST, BESIDE, GAMMA, MASS = 0.2, 0.1, 0.9, 0.5
#: Added to the importance of a branch that holds so much.
HOLDS = 2.0


class _Node:
    """drop: never text; beside: 0, or 1 for an aside that an article or main element may lie in, or 2."""

    __slots__ = ("beside", "drop", "main", "style", "tag")

    def __init__(self, tag: str, style: str, drop: bool, beside: int, main: int):
        self.tag, self.style, self.drop, self.beside, self.main = tag, style, drop, beside, main


def _open(tag: str, attrs: str, parent: _Node) -> _Node:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
    names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    names = html.unescape(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names)) if names.strip() else ""
    first = names.split()
    names = _LAYOUT.sub(" ", names) if names else ""
    main, beside = parent.main, parent.beside
    drop = parent.drop or tag in _NEVER or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    if tag in ("article", "main"):
        # a wrapper may be named after the sidebar that it also holds; what readers write stays what it is
        beside = 2 if names and _READERS.search(names) else beside if beside == 2 else 0
    elif tag in _BESIDE or tag == "header" and not main:  # a header inside the article holds its title
        beside = 2
    elif tag not in ("html", "body", "header") and names and (m := _ASIDE.search(names)):
        beside = max(beside, 2 if main or _READERS.search(m[0]) else 1)
    if tag == "article" or found.get("itemprop") == "articleBody":
        if main == 3 and tag == "article":
            beside = 2  # an article inside an article is a reader's comment
        main = 3
    elif tag == "main" or found.get("role") == "main":
        main = max(main, 2)
    elif names and _MAIN.search(names):
        main = max(main, 1)
    return _Node(tag, tag + ("." + first[0] if first else ""), drop, beside, main)


def blocks(page: str | None) -> list[tuple[str, str, int, int, float]]:
    """The page's text blocks: (path, text, main, beside, link share).

    path: the styles from the root; main: 3 inside <article>, 2 inside <main>, 1 inside an element named like one,
    0 elsewhere; beside: 2 if elements, or names of readers' parts or inside an article, call it a menu, header, footer, advert,
    comment and the like, 1 if another name does, else 0.  Character references are decoded, white space is one space, the ends are trimmed, empty blocks go.
    """
    page = page or ""
    stack, out, parts, linked = [_Node("", "", False, 0, 0)], [], [], [0, 0]
    at, size, anchors = 0, len(page), 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                block = stack[-1]
                path = ">".join(n.style for n in stack[1:] if n.tag in _BLOCKS)
                out.append((path, text, block.main, block.beside, linked[0] / max(1, linked[1])))
            parts.clear()
        linked[:] = [0, 0]

    def data(raw: str) -> None:
        if raw and not stack[-1].drop:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            linked[1] += len(text)
            linked[0] += len(text) if anchors else 0

    while at < size:
        m = _MARKUP.search(page, at)
        if m is None:
            data(page[at:])
            break
        data(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in _BLOCKS:
                flush()
            if tag == "a":
                anchors = max(0, anchors - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "nav", "aside", "footer", "header", "table") and tag not in ("body", "html", "article", "main", "section", "div"):
                    break  # a stray closing tag ends nothing outside
            continue
        if tag in _BLOCKS:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag in _ENDS.get(tag, ()):
                    del stack[k:]
                    if tag not in _ENDS:
                        break
                elif stack[k].tag in _BLOCKS and stack[k].tag not in ("li", "dt", "dd", "tr") or stack[k].tag in ("ul", "ol", "dl", "table"):
                    break
        elif tag in ("td", "th", "br", "img"):
            data(" ")
            if tag in _ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ("tr", "table"):
                        break
                    if stack[k].tag in _ENDS[tag]:
                        del stack[k:]
                        break
        if tag in _VOID:
            continue
        node = _open(tag, m[3] or m[6] or "", stack[-1])
        if tag == "a":
            anchors += 1
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not node.drop:
                data(page[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        stack.append(node)
    flush()
    return out


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-zA-Z][\w+.-]*://", "", url or "").split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].lower()


def _key(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) >> 1


def style_tree(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, key, pages, importance, share): the site style trees, a row for each branch and each leaf of each host.

    Pages of a host are merged: blocks with the same path of styles are one node, known by the hash of its path, and
    equal texts under it are one leaf, known by the hash of its text.  Pages with the same blocks outside asides are
    copies and count once.  A leaf's importance is 1 - log(pages with it) / log(pages with the node).  A node's content
    importance is the mean of its leaves', its presentation importance the entropy, over log(pages), of how many blocks
    it has on a page; combined they are (1 - g^k) presentation + g^k content for k distinct presentations.  So it is near
    0 where every page shows the same, and 1 where all differ.  What few pages tell is drawn to 1: of m pages
    1 - 1 / m counts.  share is the mean part of a page's text that a branch holds, drawn to 0 likewise; null for leaves.  Counts are combined before each shuffle, so one host may hold most of the pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, copies, paths, kinds, values = [], [], [], [], []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                host, own, found = host_of(url), {}, blocks(page.as_py())
                copy = _key("\n".join(b[1] for b in found if not b[3]))
                size = {}
                for path, text, *_ in found:
                    own.setdefault(path, []).append(_key(text))
                    size[path] = size.get(path, 0) + len(text)
                whole = max(1, sum(size.values()))
                for path, texts in own.items():
                    for kind, value in [*((0, t) for t in set(texts)), (1, len(texts)), (2, 1000 * size[path] // whole)]:
                        hosts.append(host)
                        copies.append(copy)
                        paths.append(_key(path))
                        kinds.append(kind)
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(copies, pa.int64()), pa.array(paths, pa.int64()), pa.array(kinds, pa.int32()), pa.array(values, pa.int64())], names=["host", "copy", "path", "kind", "value"])

    seen = pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "host string, copy long, path long, kind int, value long")
    counts = seen.groupBy("host", "path", "kind", "value").agg(F.count_distinct("copy").alias("n"))
    sums = counts.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("pages"),
        F.avg(F.when(F.col("kind") == 0, F.log(F.col("n").cast("double")))).alias("shared"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log(F.col("n").cast("double")))).alias("x"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("k"),
        F.sum(F.when(F.col("kind") == 2, F.col("n") * F.col("value") / 1000)).alias("held"),
    )
    most = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    told = lambda low: 1 - low * (1 - 1 / F.col("pages"))
    presentation = (F.log(F.col("pages").cast("double")) - F.col("x") / F.col("pages")) / most
    weight = F.pow(F.lit(GAMMA), F.col("k"))
    node = (1 - weight) * presentation + weight * (1 - F.col("shared") / most)
    nodes = sums.select("host", F.col("path").alias("key"), "pages", told(1 - node).alias("importance"), (F.col("held") / F.col("pages") * (1 - 1 / F.col("pages"))).alias("share"))
    leaves = counts.where("kind = 0 AND n > 1").join(sums.select("host", "path", "pages"), ["host", "path"])
    leaves = leaves.select("host", F.col("path").bitwiseXOR(F.col("value")).alias("key"), "pages", told(F.log(F.col("n").cast("double")) / most).alias("importance"), F.lit(None).cast("double").alias("share"))
    return nodes.unionByName(leaves)


def _chosen(found: list[tuple], low: dict[int, float], least: float) -> list[str]:
    """The texts that stay: important branches and leaves of the innermost marked root that holds most of them.

    low: importance of the host's branches and leaves, where it may be under 1, and HOLDS more for branches with MASS of the text.
    """
    kept = []
    for path, text, main, beside, links in found:
        p = _key(path)
        branch = low.get(p, 1.0)
        holds = branch >= HOLDS
        importance = min(branch - HOLDS if holds else branch, low.get(p ^ _key(text), 1.0))
        if (BESIDE if beside == 2 or beside and not holds else 1.0) * importance * (1.0 if main else 1 - links) >= least:
            kept.append((main, text))
    kept = kept or [(b[2], b[1]) for b in found if not b[3]]
    mass = sum(len(t) for _, t in kept)
    for root in (3, 2, 1):
        if 2 * sum(len(t) for main, t in kept if main >= root) > mass:
            return [t for main, t in kept if main >= root]
    return [t for _, t in kept]


def main_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None, least: float = LEAST, broadcast_rows: int = 200_000) -> DataFrame:
    """The `keep` columns of pages (all by default) with main_text string.

    The site style tree of the page's host gives every branch and leaf its importance.  Elements and names that call a
    branch a menu, header, footer, advert or comments lower it, but for a name on a branch that holds half of the text on the
    host's pages, and so does being made of links outside any marked root;
    what falls under `least` goes.  Of the rest the innermost root that the page marks (<article>, <main>, an element named
    so) and that holds over half of the text is the main text; without one, all of it.  If nothing is important, all
    outside asides stays.

    Branches and leaves under `least` reach the workers by broadcast up to `broadcast_rows` of them; beyond, pages' blocks
    meet them in a join by host and branch, and pages are never grouped by host.  Null, empty or text-free pages give ''; broken
    markup is read as far as it goes; pages without a URL share the host ''; repeated rows stay and count once.  A clashing name gets an underscore.
    """
    keep, spark = keep or pages.columns, pages.sparkSession
    (name,) = fresh(pages, "main_text")
    made = Tables(spark)
    low = style_tree(pages, url_col=url_col, html_col=html_col)
    holds = F.coalesce(F.col("share") >= MASS, F.lit(False))  # of two branches of a host at most
    low = made.put(low.where((F.col("importance") < least) | holds).select("host", "key", (F.col("importance") + F.when(holds, HOLDS).otherwise(0.0)).alias("importance")))
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` string"

    def texts(batch: pa.RecordBatch, of) -> pa.RecordBatch:
        out = ["\n".join(_chosen(blocks(page.as_py()), of(i), least)) for i, page in enumerate(batch.column(html_col))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, name])

    if low.count() <= broadcast_rows:
        known: dict[str, dict[int, float]] = {}
        for r in low.collect():  # at most broadcast_rows
            known.setdefault(r["host"], {})[r["key"]] = r["importance"]
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                urls = batch.column(url_col).cast(pa.string()).to_pylist()
                yield texts(batch, lambda i: shared.value.get(host_of(urls[i]), {}))

        return pages.mapInArrow(run, schema)

    page, found = fresh(pages, "page_key", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, host_of(u), x) for k, u, h in zip(*(c.to_pylist() for c in batch.columns)) for x in {x for path, text, *_ in blocks(h) for x in (_key(path), _key(path) ^ _key(text))}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["page", "host", "key"])

    at = pages.withColumn(page, F.xxhash64(F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.coalesce(F.col(html_col).cast("string"), F.lit(""))))
    own = at.select(page, F.col(url_col).cast("string"), F.col(html_col).cast("string")).dropDuplicates([page]).mapInArrow(cut, "page long, host string, key long")
    poor = own.join(low, ["host", "key"]).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("key", "importance"))).alias(found))
    joined = at.join(poor.withColumnRenamed("page", page), page, "left")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows = batch.column(found).to_pylist()
            yield texts(batch, lambda i: dict(lows[i] or ()))

    return joined.mapInArrow(run_joined, schema)
