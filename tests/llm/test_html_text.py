import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from planarflow.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu {i}</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="{box}"><h2>Title {i}</h2><p>First &amp; <b>bold</b>
 text&nbsp;{i}<br>goes on<p>Second &lt;p&gt; {i}<!-- no --><div class="share">Share</div><form><input>Send</form>
<ul><li>one<li>two</ul><section id="comments"><p>I disagree</p></section></div>
<aside>Related</aside><div class="ad">Buy {i}</div><footer>&copy; all</footer></body></html>"""
WANT = "Title {i}\nFirst & bold text {i} goes on\nSecond <p> {i}\none\ntwo"


@pytest.mark.parametrize("box", ["article-body", "q17"])
def test_main_text(spark, box):
    rows = [(i, f"https://h{i % 2}.example/{i}", PAGE.format(i=i, box=box)) for i in range(8)]
    got = {r.page_id: r for r in h.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, url, _ in rows:
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, WANT.format(i=i), len(WANT.format(i=i)))


def key(*labels):
    """The token of a path of tags."""
    out = 0
    for label in labels:
        out = h._signed(h.xxhash.xxh64_intdigest(label, out % (1 << 64)))
    return out


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return [r.asDict() for r in h.host_tokens(df).collect()]


def test_tokens_with_equal_vectors_form_the_template(spark):
    tokens = rows_of(spark, [(i, "https://h.example/", PAGE.format(i=i, box="x") + "<i>x</i>" * i) for i in range(6)])
    by = {t["token"]: t["vector"] for t in tokens}
    top = ("html", "body")
    assert by[key("html")] == by[key(*top, "nav")] == by[key(*top, "footer")] != by[key(*top, "div.x", "ul", "li")]
    assert by[key("i")] != by[key("html")]
    template = h.deduce([t for t in tokens if t["pages"] >= 3], 6)
    assert template["main"] == key(*top, "div.x") and max(len(c["tokens"]) for c in template["classes"]) > 5
    assert {c["slot"] for c in template["classes"]} <= {0, *(k for c in template["classes"] for k in c["tokens"])}


class Tree(HTMLParser):
    """Counts of paths and of texts in them, of a page whose tags are all closed."""

    def __init__(self, html):
        super().__init__()
        self.path, self.count, self.said = (), Counter(), []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.path += (tag + "".join("." + re.sub("[0-9]+", "#", v) for _, v in attrs),)
        self.count[self.path] += 1

    def handle_endtag(self, tag):
        self.path = self.path[:-1]

    def handle_data(self, data):
        if text := " ".join(data.split()):
            self.count[self.path, text] += 1
            self.said.append((self.path, text))


def by_hand(pages):
    """Texts of one host's pages: vectors as lists, classes by equal ones, the innermost box that holds all that varies."""
    trees = [Tree(p) for p in pages]
    vectors = {t: tuple(x.count[t] for x in trees) for t in {t for x in trees for t in x.count}}
    frequent = {t: v for t, v in vectors.items() if 2 * sum(map(bool, v)) >= len(trees) and (isinstance(t[-1], str) and isinstance(t[0], str) or sum(map(bool, v)) >= 3)}
    fixed = {t for t in frequent if isinstance(t[0], tuple)}
    paths = [t for t in frequent if not isinstance(t[0], tuple)]
    inside = lambda box, path: path[: len(box)] == box
    vary = lambda box: sum(len(s) for x in trees for p, s in x.said if inside(box, p) and (p, s) not in fixed)
    boxes = [p for p in paths if p[-1].split(".")[0] in ("html", "body", "div", "section") and vary(p) == vary(())]
    box = max(boxes, key=len)

    def gone(p, s):
        if (p, s) not in fixed:
            return False
        for n in range(len(box) + 1, len(p) + 1):
            all_ = sum(len(t) for x in trees for q, t in x.said if inside(p[:n], q))
            if "." in p[n - 1] and 10 * sum(len(t) for x in trees for q, t in x.said if inside(p[:n], q) and (q, t) in fixed) >= 9 * all_:
                return True
        return False

    classes = {}
    for t, v in frequent.items():
        classes.setdefault(v, set()).add(t)
    return classes, ["\n".join(s for p, s in x.said if inside(box, p) and not gone(p, s)) for x in trees]


def neutral(rng, pages):
    """Pages of a host whose class names say nothing, with the same sentences on each of them inside and outside of the article."""
    words = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    welcome, rights, extra = words(9), words(8), words(5)
    out = []
    for _ in range(pages):
        body = "".join(f"<p>{words(rng.randrange(15, 40))}</p>" for _ in range(rng.randrange(2, 6)))
        maybe = f"<div class='k{rng.randrange(99)}x'><p>{words(6)}</p></div>" if rng.random() < 0.3 else ""
        out.append(f"<html><body><div class='a'><p>{welcome}</p></div><div class='b'><h1>{words(3)}</h1><div class='c'>{extra}</div>{body}{maybe}<p>The end.</p></div><div class='d'>{rights}</div></body></html>")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_template_equals_one_made_by_hand(spark, seed):
    rng = random.Random(seed)
    hosts = {f"h{k}.example": neutral(rng, rng.randrange(4, 12)) for k in range(3)}
    rows = [(i, f"http://{name}/{i}", p) for name, pages in hosts.items() for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {(r.url, r.page_id): r.text for r in h.page_texts(df).collect()}
    tokens = h.host_tokens(df).collect()
    for name, pages in hosts.items():
        classes, want = by_hand(pages)
        assert [got[f"http://{name}/{i}", i] for i in range(len(pages))] == want
        assert all("The end." in w for w in want)
        found = {}
        for t in tokens:
            if t.host == name and t.token and 2 * t.pages >= len(pages) and (t.tag or t.pages >= 3):
                found.setdefault(t.vector, set()).add(t.token)
        labels = lambda t: h._signed(h.xxhash.xxh64_intdigest(t[1], ~key(*t[0]) % (1 << 64))) if isinstance(t[0], tuple) else key(*t)
        assert sorted(map(sorted, found.values())) == sorted(sorted(map(labels, c)) for c in classes.values())


def test_without_the_template_the_same_sentences_stay(spark):
    pages = neutral(random.Random(9), 10)
    alone = [h.extract(p) for p in pages]
    rows = [(i, "http://h/", p) for i, p in enumerate(pages)]
    got = [r.text for r in h.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert all(g != a and g in a.replace("\n".join(a.split("\n")[2:3]) + "\n", "") for g, a in zip(got, alone))


def test_names_do_not_drop_the_text_of_an_article():
    page = "<nav>Menu</nav><article><h1>T</h1><div class='reply-body'><p>Long answer</p></div><p class='social'>Social life</p><figure class='banner'><img><figcaption>A banner</figcaption></figure><div class='related'><a>More</a><a>Still more</a></div><div class='comments'><p>No!</p></div><p class='ad'>Buy</p></article><div class='reply'>I say</div>"
    assert h.extract(page) == "T\nLong answer\nSocial life\nA banner"


@pytest.mark.parametrize("page", ["<div>a" * 160_000, "<b>a" * 250_000, '<a b="' * 150_000, "<p><table>" + "<i><h1>" * 140_000, "<" * 900_000 + ">", "<li>x" * 200_000 + "</ul>" * 9])
def test_long_and_deep_pages_take_time_in_proportion(page):
    began = time.process_time()
    h.extract(page[: len(page) // 8])
    part = time.process_time() - began
    began = time.process_time()
    h.extract(page)
    h.page_tokens(page)
    assert time.process_time() - began < 40 * part + 3


def test_copies_of_one_page_lose_nothing(spark):
    page = neutral(random.Random(3), 1)[0]
    rows = [(i, "http://h/", page) for i in range(7)] + [(7, "http://h/", neutral(random.Random(4), 1)[0])]
    got = {r.page_id: r.text for r in h.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(w in got[3] for w in page.split("<p>")[2].split("</p>")[0].split())


def test_awkward_pages(spark):
    rows = [(0, None, None), (1, "", ""), (2, "x", "plain &amp; text"), (2, "x", "plain &amp; text"), (3, "http://a/", "<p>open <b>ends"), (None, "http://a/", "<article>a<script>never closed"), (4, "http://a/", "<" * 2000), (5, "http://b/", "<article>" + "<p>w " * 5000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in h.page_texts(df).collect()}
    assert got[0] == got[1] == "" and got[2] == "plain & text" and got[3] == "open ends" and got[None] == "a"
    assert got[4].startswith("<") and got[5] == "\n".join(["w"] * 5000)
    assert h.page_texts(df).count() == len(rows)
    assert h.page_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "word " * 400
OPEN_PAGE = """<html><body><ul><li><a href="/">Home</a><li><a href="/b">More</a></ul>{lead}<div class="q17"><h2><a href="#">Title {i}</a></h2><p>{long}{i}</p>
<ul><li>one<li>two</ul><blockquote>said</blockquote><table><tr><td>cell</td></tr></table><div><p>end</p></div></div></body></html>"""


@pytest.mark.parametrize("lead", ["", "<div class='k'>A lead {i}</div>"])
def test_long_paragraphs_do_not_displace_what_stands_beside_them(spark, lead):
    rows = [(i, "https://h.example/", OPEN_PAGE.format(i=i, long=LONG, lead=lead.format(i=i))) for i in range(6)]
    for r in h.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        want = [f"Title {r.page_id}", f"{LONG}{r.page_id}", "one", "two", "said", "cell", "end"]
        assert r.text.split("\n") == ([f"A lead {r.page_id}"] if lead else []) + want


def test_a_small_named_part_is_not_the_article(spark):
    page = "<html><body><div><div class='post-meta'>May {i}</div><h1 class='entry-title'>T</h1><p>{long}</p></div></body></html>"
    rows = [(i, "https://h.example/", page.format(i=i, long=LONG)) for i in range(4)] + [(9, None, "<div class='post-meta'>May</div><p>" + LONG), (8, None, "<div>in</div>out <i>side</i>")]
    got = {r.page_id: r.text for r in h.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == f"May 1\nT\n{LONG.strip()}" and got[9] == f"May\n{LONG.strip()}" and got[8] == "in\nout side"


@pytest.mark.parametrize("mark", ["post-{i}", "slug-{w}"])
def test_articles_whose_id_varies_by_page(spark, mark):
    page = "<html><body><div><p>Weather</p></div><article id='{m}'><h1>T{i}</h1><p>{long}</p></article></body></html>"
    rows = [(i, "https://h.example/", page.format(i=i, long=LONG, m=mark.format(i=i, w="abcdef"[i]))) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(r.text == f"T{r.page_id}\n{LONG.strip()}" for r in h.page_texts(df).collect())
    template = h.deduce([t for t in rows_of(spark, rows) if t["pages"] >= 3], 6)
    assert (template["main"] == key("html", "body", "article.post-#")) == (mark == "post-{i}")


@pytest.mark.parametrize(("box", "menu"), [("qa", "qb"), ("q1", "q9"), ("7", "8"), ("post-1", "post-2")])
@pytest.mark.parametrize("count", [2, 3, 6])
@pytest.mark.parametrize("flip", [False, True])
def test_unnamed_siblings_on_small_hosts(spark, box, menu, count, flip):
    """The article, all of it and nothing else, whatever the number of pages and though classes differ by a digit only."""
    words = "alpha bravo charlie delta echo foxtrot".split()
    rows = []
    for i in range(count):
        parts = [f"<div class='{menu}'><p>Pages of the site</p><p>Home</p></div>", f"<div class='{box}'><p>Same lead on all pages.</p><h2>About {words[i]}</h2><p>The story of {words[i]} goes on.</p></div>"]
        rows.append((i, "https://small.example/x", f"<html><body>{''.join(parts[:: -1 if flip else 1])}</body></html>"))
    got = {r.page_id: r.text for r in h.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Same lead on all pages.\nAbout {words[i]}\nThe story of {words[i]} goes on." for i in range(count)}


def test_ids_that_vary_by_page_are_one_token(spark):
    rows = [(i, "https://small.example/x", f"<html><body><div id='p{i * 7}'><p>Text {'abc'[i]} here</p></div><div id='p{i * 7 + 1}'><p>Pages</p></div></body></html>") for i in range(3)]
    got = {r.page_id: r.text for r in h.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {'abc'[i]} here" for i in range(3)}
