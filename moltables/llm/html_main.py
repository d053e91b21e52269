"""Main text of web pages: templates of a site go by counting element subtrees, other furniture by what it is called.

Every page is parsed into elements. The hash of a block element covers its tag,
its texts and its children, without attributes. Spark counts, for each host,
the pages in which a subtree occurs; one that recurs across many pages of its
host is part of the site's template and is deleted with all that is in it.

Repeated articles must not go that way: inside an ``article`` or ``main``
element only subtrees that consist mainly of links are deleted, and elsewhere
running text only if it is on a tenth of the host's pages and is less than
half of the page's running text. What a template does not repeat often enough
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) is known by its tag, role, class or id.

Pages meet the templates of their host in one sorted stream for each
partition; hosts with a large share of the pages are dealt over many of them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltables.llm.common import query, slices
from moltables.session import shuffle_width, stable

#: A subtree is part of a template from this many pages and this share of its host's pages on; running text from a larger share on.
MIN_PAGES, SHARE, TEXT_SHARE = 5, 0.01, 0.1

# Fixed values of HTML and of common markup.
BLOCKS = frozenset("""address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot
    th thead tr ul xmp""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset("body caption colgroup head html legend optgroup option tbody td tfoot th thead tr".split())
#: Elements that end when one of these starts, and where the search for them stops.
ENDED_BY = {
    "li": ("li", "ol ul menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tr td th thead tbody tfoot caption", "table"), "tfoot": ("tr td th thead tbody tfoot caption", "table"), "thead": ("tr td th caption", "table"),
}
ENDED_BY = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDED_BY.items()}
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript template".split())
SCOPE = frozenset("html table td th caption button object template".split())
DROPPED = frozenset("""head script style noscript template iframe noembed noframes object embed svg math canvas audio video map title textarea select button input
    datalist nav aside footer menu dialog search""".split())
MAYBE_DROPPED = frozenset(["form", "header"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored
    promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments
    disqus replies related recommended footer header masthead toolbar pagination pager widget copyright skip""".split())
ARTICLE_NAMES = frozenset("comment comments reply ad ads advert advertisement sponsored promo related teaser".split())
#: A header of one of these is the article's.
OWN_HEADER = frozenset("article post entry content story title main page".split())
NEGATED = frozenset("has no with without".split())

_ATTRS = r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)"""
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # comments, the last one maybe open
    rf"|<(?P<raw>(?i:script|style|iframe|noembed|noframes|textarea|title))(?=[\s/>]){_ATTRS}>.*?(?:</(?i:(?P=raw))(?=[\s/>])[^>]*+>|\Z)"
    rf"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS[1:-1]})>"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<[!?/][^>]*+>"
    r"|<[a-zA-Z!?/].*", re.S)  # a tag that never ends takes the rest with it
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_NAME = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Element:
    """An element with its children; ``size`` and ``linked`` count characters of text and of text in links below it."""

    __slots__ = ("tag", "kids", "drop", "size", "linked", "hash", "block", "hidden_by_name")

    def __init__(self, tag: str, drop: bool = False, by_name: bool = False):
        self.tag, self.kids, self.drop, self.hidden_by_name = tag, [], drop, by_name
        self.size = self.linked = self.hash = 0
        self.block = tag in BLOCKS

    @property
    def mostly_links(self) -> bool:
        return 2 * self.linked >= self.size


def _names(value: str) -> set[str]:
    out, skip = set(), False
    for w in _NAME.findall(_CAMEL.sub(" ", value).lower()):
        if not skip:
            out.add(w)
        skip = w in NEGATED
    return out


def _furniture(tag: str, attrs: str) -> tuple[bool, bool]:
    """(always dropped, dropped because of its name) for a start tag."""
    if tag in DROPPED:
        return True, False
    if tag in ("html", "body", "main"):
        return False, False
    names: set[str] = set()
    if "=" in attrs or "hidden" in attrs:
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" and value != "until-found" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return True, False
            if key == "role" and value.lower() in ROLES:
                return False, True
            if key in ("class", "id"):
                names |= _names(value)
    if tag == "article":
        return False, bool(names & ARTICLE_NAMES)
    hit = names & NAMES
    if names & OWN_HEADER:
        hit -= {"header"}
    return False, bool(hit) or tag in MAYBE_DROPPED and not names & OWN_HEADER


def _text(raw: str) -> str:
    return html.unescape(raw) if "&" in raw else raw


def parse(source: str) -> Element:
    """The root of a page's elements; tags that are missing or crossed are mended, nothing is dropped here but comments and raw text."""
    root = Element("html")
    stack, opened = [root], Counter()

    def close(n: int) -> None:
        """Close the elements from position n of the stack on, the last first."""
        while len(stack) > n:
            e = stack.pop()
            opened[e.tag] -= 1
            _finish(e)
            stack[-1].size += e.size
            stack[-1].linked += e.size if e.tag == "a" else e.linked

    def add(raw: str) -> None:
        t = _text(raw)
        if stack[-1].tag == "head" and t.strip():
            close(len(stack) - 1)
        stack[-1].kids.append(t)
        stack[-1].size += len(t.strip())

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            add(source[at:m.start()])
        at = m.end()
        if tag := m["start"]:
            tag = tag.lower()
            if tag in ("html", "body") and len(stack) > 1:
                if tag == "html" or opened["body"]:
                    continue
            if tag in CLOSES_P and opened["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in SCOPE:
                        break
            ends = ENDED_BY.get(tag)
            if ends and any(opened[x] for x in ends[0]):
                last = 0
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends[1]:
                        break
                    if stack[i].tag in ends[0]:
                        last = i
                        if tag in ("li", "td", "th", "dt", "dd", "option"):
                            break
                if last:
                    close(last)
            if tag == "body":
                close(1)
            elif stack[-1].tag == "head" and tag not in IN_HEAD:
                close(len(stack) - 1)
            if tag == "br":
                stack[-1].kids.append("\n")
                continue
            drop, by_name = _furniture(tag, m["attrs"])
            e = Element(tag, drop, by_name)
            stack[-1].kids.append(e)
            if tag not in VOID:
                stack.append(e)
                opened[tag] += 1
        elif tag := m["end"]:
            tag = tag.lower()
            if tag in ("html", "body") or not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                # An inline end tag does not close blocks, and no end tag closes a table's cell from inside.
                if stack[i].block and tag not in BLOCKS or stack[i].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") and tag not in SCOPE:
                    break
    if at < len(source):
        add(source[at:])
    close(1)
    _finish(root)
    return root


def _finish(e: Element) -> None:
    h = xxhash.xxh3_64(e.tag)
    for k in e.kids:
        if isinstance(k, str):
            t = " ".join(k.split())
            if t:
                h.update(f"\0{t}")
        elif k.size:
            h.update(b"\1" + k.hash.to_bytes(8, "little"))
    e.hash = h.intdigest()


def _walk(top: Element) -> Iterator[Element]:
    stack = [top]
    while stack:
        e = stack.pop()
        yield e
        stack.extend(k for k in reversed(e.kids) if not isinstance(k, str))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def subtrees(root: Element) -> set[int]:
    """Hashes of the block subtrees that have text, but for the page itself."""
    return {signed(e.hash) for e in _walk(root) if e.block and e.size and e.tag not in ("html", "body", "head")}


def _regions(root: Element) -> tuple[list[Element], bool]:
    """(the elements that hold the article, whether the page marks them): outermost articles, else main elements, else the page.

    Those below dropped elements count only if there are no others, and never
    below elements that are always dropped.
    """
    for tag in ("article", "main"):
        for by_name in (False, True):
            found, stack = [], [root]
            while stack:
                e = stack.pop()
                if e.drop or e.hidden_by_name and (not by_name or e.tag == tag):
                    continue
                if e.tag == tag:
                    found.append(e)
                else:
                    stack.extend(k for k in reversed(e.kids) if not isinstance(k, str))
            if any(e.size for e in found):
                return found, True
    return [root], False


def _has_heading(e: Element) -> bool:
    return any(x.tag == "h1" for x in _walk(e))


def main_text(source: str | None, recurring: frozenset | set = frozenset(), widely: frozenset | set = frozenset()) -> str:
    """Main text of a page, given the subtrees (hashes) that recur on its host, and those that recur on a larger share of its pages."""
    if not source:
        return ""
    root = parse(source)
    regions, marked = _regions(root)

    def furniture(e: Element) -> bool:
        if e.drop:
            return True
        if not e.hidden_by_name:
            return False
        if marked and e.tag == "header":
            return False  # the article's own
        # A container with the heading and most of the text is the page, whatever it is called.
        return marked or not (2 * e.size > root.size and _has_heading(e))

    def templates(copies: bool) -> Iterator[Element]:
        stack = list(regions)
        while stack:
            e = stack.pop()
            if furniture(e):
                continue
            h = signed(e.hash)
            if e.block and e.size and h in recurring and e.tag not in ("html", "body", "article", "main") and (e.mostly_links or copies and h in widely):
                yield e
                continue
            stack.extend(k for k in e.kids if not isinstance(k, str))
    gone = {id(e) for e in templates(False)}
    if not marked and widely:
        wide = list(templates(True))
        left = sum(e.size - e.linked for e in regions) - sum(e.size - e.linked for r in regions for e in _outermost(r, furniture))
        if 2 * sum(e.size - e.linked for e in wide) < left:  # else the page is one of many copies
            gone = {id(e) for e in wide}

    blocks, line = [], []

    def flush() -> None:
        t = " ".join("".join(line).split())
        line.clear()
        if t:
            blocks.append(t)
    for r in regions:
        stack: list = [r]
        while stack:
            k = stack.pop()
            if k is None:
                flush()
            elif isinstance(k, str):
                line.append(k)
            elif furniture(k) or id(k) in gone:
                if k.block:
                    flush()
            else:
                if k.block:
                    flush()
                    stack.append(None)
                stack.extend(reversed(k.kids))
        flush()
    return "\n".join(blocks)


def _outermost(top: Element, furniture) -> Iterator[Element]:
    stack = [top]
    while stack:
        e = stack.pop()
        if furniture(e):
            yield e
        else:
            stack.extend(k for k in e.kids if not isinstance(k, str))


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; the empty string where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, subtree, pages) of each batch; a null subtree counts the host's pages."""
    for b in slices(batches, "html"):
        n: Counter = Counter()
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            n[host, None] += 1
            if page:
                n.update((host, h) for h in subtrees(parse(page.decode("utf-8", "replace"))))
        hosts, trees = zip(*n)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(trees, pa.int64()), pa.array(list(n.values()), pa.int64())], ["host", "tree", "pages"])


def subtree_counts(pages: DataFrame) -> DataFrame:
    """(host, tree, pages) from (host, html): in how many pages of a host each block subtree occurs."""
    counts = pages.select("host", F.col("html").cast("binary").alias("html")).mapInArrow(_count, "host string, tree long, pages long")
    return counts.groupBy("host", "tree").agg(F.sum("pages").alias("pages"))


def templates(counts: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, text_share: float = TEXT_SHARE) -> DataFrame:
    """(host, trees, wide) of each host that has any template.

    A host's list is short: a page has few subtrees, and each template is on
    ``share`` of the pages, so it has at most 1 / share times the subtrees of a page.
    """
    total = counts.filter("tree is null").select("host", F.col("pages").alias("all"))
    d = counts.filter(F.col("tree").isNotNull() & (F.col("pages") >= min_pages)).join(total, "host").filter(F.col("pages") >= share * F.col("all"))
    return d.groupBy("host").agg(F.collect_list("tree").alias("trees"), F.collect_list(F.when(F.col("pages") >= text_share * F.col("all"), F.col("tree"))).alias("wide"))


def hot_hosts(counts: DataFrame, cells: int) -> DataFrame:
    """(host, salts) of the hosts that have more than 1 / cells of all pages: fewer than ``cells`` rows."""
    total = counts.filter("tree is null")
    every = total.agg(F.sum("pages").alias("every"))
    d = total.join(F.broadcast(every)).filter(F.col("pages") * cells > F.col("every"))
    return d.select("host", F.ceil(F.col("pages") * cells / F.col("every")).cast("int").alias("salts"))


_OUT = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a stream in which the templates of a host, if any, come before its pages."""
    host, trees, wide = None, frozenset(), frozenset()
    for b in slices(batches, "html"):
        out = []
        for row_host, page_id, url, page, some, many in zip(*(b.column(c).to_pylist() for c in ("host", "page_id", "url", "html", "trees", "wide"))):
            if some is not None:
                host, trees, wide = row_host, frozenset(some), frozenset(many)
                continue
            known = host == row_host
            text = main_text((page or b"").decode("utf-8", "replace"), trees if known else frozenset(), wide if known else frozenset())
            out.append((page_id, url, text, len(text)))
        if out:
            ids, urls, texts, sizes = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, text_share: float = TEXT_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: blocks joined by line feeds, white space inside a block one space.

    Null and empty html give an empty text. Pages without a host in their URL
    count as one host. Repeated rows count as pages of their own and get equal
    texts. Null ids are kept. Other columns are not read. An empty table gives
    no rows.
    """
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    counts = stable(subtree_counts(d))
    known = templates(counts, min_pages, share, text_share)
    hot = hot_hosts(counts, 4 * shuffle_width(pages.sparkSession))
    salted = d.join(F.broadcast(hot), "host", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "url"), "salts")).cast("int"))
    empty = F.lit(None).cast("array<long>")
    rows = salted.select("host", "salt", F.lit(1).alias("kind"), "page_id", "url", F.col("html").cast("binary").alias("html"), empty.alias("trees"), empty.alias("wide"))
    lists = known.join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    lists = lists.select("host", "salt", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "trees", "wide")
    stream = rows.unionByName(lists).repartition("host", "salt").sortWithinPartitions("host", "salt", "kind")
    return stream.drop("salt", "kind").mapInArrow(_extract, _OUT)


#: SQL for pages with one article element without furniture inside, as those of the tables are.
_SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?is)<article(?:\s[^>]*)?>(.*)</article>', 1) h from pages),
b as (select page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<!--.*?-->', '', 'g'), '(?i)<br\s*/?>', ' ', 'g'),
  '(?i)</?(?:p|h[1-6]|div|section|ul|ol|li|blockquote|pre|table|tr|td|th|figure|figcaption)(?:\s[^>]*)?>', chr(1), 'g'), chr(1)) parts from a),
c as (select page_id, url, list_transform(parts, lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) parts from b),
d as (select page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
  '&quot;?', '"', 'g'), '&#39;', '''', 'g'), '&amp;?', '&', 'g')) parts from c),
e as (select page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') parts from d)
select page_id, url, array_to_string(parts, chr(10)) "text", length(array_to_string(parts, chr(10)))::bigint n_chars from e
"""


@query(_SQL)
def op11_html_main_text(spark, sf_dir):
    """Main text of every page."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
