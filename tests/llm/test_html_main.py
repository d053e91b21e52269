"""Main text of pages: made pages with known texts, markup in every state, and subtree counts against a plain walk."""

import random
from collections import Counter
from html.parser import HTMLParser

import pytest

from moltables.llm import html_main as H

NAV = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul>"


def sentence(r, n=8):
    return " ".join("".join(r.choice("aeioustrn") for _ in range(r.randint(2, 7))) for _ in range(n)).capitalize() + "."


def page(seed, marked, notice):
    """(html, text): a page whose furniture has no telling names where ``notice`` repeats on every page of the site."""
    r = random.Random(seed)
    paras = [sentence(r) for _ in range(r.randint(2, 5))]
    title = sentence(r, 4)
    inner = f"<h2>{title}</h2>" + "".join(f"<p>{p.replace(' ', chr(10) + ' ', 1)}</p>" for p in paras)
    body = f"<article>{inner}</article>" if marked else f"<div class=x1>{inner}</div>"
    return (f"<html><head><title>t {seed}</title></head><body><div class=q7>{NAV}</div>{body}<div class=z>{notice}</div><div class=ad>{sentence(r)}</div></body></html>", "\n".join([title, *paras]))


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>a&nbsp;b\n\tc<p>d<br>e", "a b c\nd e"),
    ("<p>x<b>y</b>z &lt;i&gt; &copy &am &#x41;&#0;</p>", "xyz <i> © &am A�"),
    ("<title>t</title><style>p{}</style><script>if (a<b) '</p>'</script><p>ok", "ok"),
    ("<script>never closed <p>no", ""), ("<p>a<!-- <p>b --><p>c<!-- open", "a\nc"), ("<p>a <3 b < c</p>", "a <3 b < c"),
    ("<p>a<div class='broken", "a"), ("<p title='a > b'>c</p><p title=\"x>y\" data-z=\"it's\">d", "c\nd"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"), ("<table><tr><td>a<td>b<tr><th>c</table>d", "a\nb\nc\nd"),
    ("<article><header><h1>T</h1></header><p>a</p><footer>f</footer><div class='comment-list'>c</div><form>q</form></article><p>out", "T\na"),
    ("<body class='has-sidebar'><main><div class='entry-header'>h</div><div id=cookieBanner>c</div><p>a</main><aside>s</aside>", "h\na"),
    ("<div role=navigation>n</div><div hidden>h</div><div style='display: none'>s</div><p>a</p><section id=comments>c</section>", "a"),
    ("<div class=sidebar-layout><h1>T</h1><p>a long enough article text</p></div><div class=sidebar>s</div>", "T\na long enough article text"),
    ("<div class=related><article>teaser</article></div><article>real</article>", "real"), ("<article class=comment>c</article><article><b>r<br><p>s</article>", "r\ns"),
    ("<p><b>Title.<br><p>one</p><p>two</p></article><footer>f</footer>", "Title.\none\ntwo"),
    ("<head><meta charset=x><p>a</p>", "a"), ("<head><title>x</title>words<p>a</p>", "words\na"), ("</p></div>a</b>b", "ab"), ("<p>é 日本 🙂", "é 日本 🙂"),
])
def test_markup(source, text):
    assert H.main_text(source) == text


def test_bad_markup_takes_linear_time():
    for source in ("<a " * 200_000, "<" * 300_000, "<!--" * 200_000, "<script>" * 100_000, "<a x='" * 100_000, "</" * 200_000, "&" * 300_000, "=\"" * 200_000):
        assert isinstance(H.main_text(source + "<p>x"), str)
    assert H.main_text("<div>" * 50_000 + "x") == "x"
    assert H.main_text("<p>" + "word " * 400_000) == ("word " * 400_000).strip()


class Plain(HTMLParser):
    """Subtrees of well-formed pages as strings."""

    def __init__(self):
        super().__init__()
        self.stack, self.seen = [["", []]], set()

    def handle_starttag(self, tag, attrs):
        self.stack.append([tag, []])

    def handle_data(self, data):
        if data.split():
            self.stack[-1][1].append(" ".join(data.split()))

    def handle_endtag(self, tag):
        name, kids = self.stack.pop()
        whole = f"<{name}>" + "|".join(kids) + f"</{name}>"
        if kids:
            self.stack[-1][1].append(whole)
            if tag in H.BLOCKS and tag not in ("html", "body", "head"):
                self.seen.add(whole)


def site(n, marked, host, first=0):
    notice = "<p>Please read our rules before you write to us.</p>"
    return [(first + k, f"https://user@{host.upper()}:80/x/{k}?q=//no", *page(first + k, marked, notice)) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")


def test_counts_equal_a_plain_walk(spark):
    rows = site(12, True, "a.example") + site(7, False, "b.example", 100)
    rows = [(i, u, h.replace("<li>", "<li>").replace("class=q7", "class='q7'"), t) for i, u, h, t in rows]
    want = Counter()
    for _, u, h, _ in rows:
        p = Plain()
        p.feed(h)
        host = "a.example" if "A.EX" in u else "b.example"
        want.update((host, s) for s in p.seen)
    d = frame(spark, rows).repartition(4).select(H.host_of(__import__("pyspark.sql.functions").sql.functions.col("url")).alias("host"), "html")
    got = H.subtree_counts(d).collect()
    assert {(r["host"], r["pages"]) for r in got if r["tree"] is None} == {("a.example", 12), ("b.example", 7)}
    assert Counter((r["host"], r["pages"]) for r in got if r["tree"] is not None) == Counter((host, n) for (host, _), n in want.items())


def test_templates_without_telling_names_are_deleted(spark):
    """The menu and the notice are known only by recurring; hosts with few pages keep them."""
    rows = site(40, False, "big.example") + site(3, False, "small.example", 1000)
    got = {r["page_id"]: r["text"] for r in H.extracted(frame(spark, rows).repartition(5)).collect()}
    for i, _, _, text in rows[:40]:
        assert got[i] == text
    for i, _, _, text in rows[40:]:
        assert got[i] == "\n".join(["Home", "News", text, "Please read our rules before you write to us."])


def test_repeated_articles_are_kept(spark):
    copies = site(1, True, "c.example") * 30 + site(1, False, "d.example", 50) * 30
    near = [(200 + k, "http://e.example/", f"<body><div>{NAV}</div><div><p>The very same long paragraph of text here.</p><p>And one more that is equal.</p><p>No {k}</p></div></body>", None) for k in range(30)]
    got = H.extracted(frame(spark, copies + near)).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 90 and texts[0] == copies[0][3] and texts[50].startswith(copies[30][3])
    assert texts[205] == "The very same long paragraph of text here.\nAnd one more that is equal.\nNo 5"


def test_awkward_rows_and_empty_tables(spark):
    rows = [(1, None, "<p>a", ""), (1, None, "<p>a", ""), (None, "", None, ""), (2, "no url", "", ""), (3, "http:///x", "<p>" + "w " * 300_000, ""), (None, None, None, None)]
    d = frame(spark, rows).selectExpr("*", "'x' host", "1 salt", "2 kind", "'t' text", "3 trees")
    got = sorted(((r["page_id"], r["url"], r["n_chars"], r["text"][:3]) for r in H.extracted(d).collect()), key=str)
    assert got == sorted([(1, None, 1, "a"), (1, None, 1, "a"), (None, "", 0, ""), (2, "no url", 0, ""), (3, "http:///x", 599_999, "w w"), (None, None, 0, "")], key=str)
    assert H.extracted(frame(spark, [])).count() == 0


def test_hot_hosts_are_dealt_over_several_cells(spark):
    rows = site(60, False, "hot.example") + [r for k in range(40) for r in site(1, True, f"h{k}.example", 500 + k)]
    d = frame(spark, rows)
    counts = H.subtree_counts(d.select(H.host_of(d.url).alias("host"), "html"))
    hot = {r["host"]: r["salts"] for r in H.hot_hosts(counts, 32).collect()}
    assert hot == {"hot.example": 20}
