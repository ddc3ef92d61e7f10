"""HTML extraction by deducing each host's template from classes of tokens that occur alike on its pages.

A token is a start tag with its class and id or a run of text, each with the path of tags above it. Numbers in classes and ids are
replaced by #, since they often differ from page to page; siblings that only differ by them are told apart by their order. Its occurrence vector has its count on every page of the host; vectors are compared by a sum of hashes of (page, count),
which adds up in any order, so no page list is gathered. Tokens of equal vectors on half of the pages or more form a class,
parted by the slot that its tokens lie in; classes whose places follow their nesting are valid. They nest in each other, a class
in the slot of the token above it, and make the template. What its text tokens say on page after page is part of the template; the
rest fills its slots.

The main slot is the article: an element named as one that holds half of the slots' text outside of links or more, else the
innermost container that holds all of it. A page's text is what fills the main slot and the slots nested in it: text that is
part of the template goes if its element has a class or id of its own or it is a link, and says the same wherever it occurs. Where
less than a tenth of a host's text varies (copies of one page), and on hosts of a single page, no text counts as part of
the template; a page that would lose more than it keeps loses nothing.

Names break ties: elements that name themselves menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments
are set aside. Inside the article a name of the list WEAK sets an element aside only if half of its text is links. Links in headings
count as text, and text outside of all block elements always stays. A page on which the slot is missing is read by names alone.

Whole pages are read, in time and memory in proportion to their length at any depth of nesting. Blocks are block elements;
references are decoded; white space in a block becomes one space. Nulls and empty pages give an empty text, a null url is a host
of its own. Repeated rows give equal rows; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Templates of so many numbers in all are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_NUMBERS = 2_000_000
#: Pages on which a text must stand to be part of a host's template: what stands once has no like to be compared with.
LEAST = 2
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math select".split())
BLOCK = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
ASIDE = frozenset("nav header footer aside form head title script style noscript template textarea iframe svg math select button dialog menu".split())
#: Words in class, id or role that mark an element as no part of the article, anywhere; and those that do so outside of it.
STRONG = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies disqus footer menu nav navbar navigation newsletter pager pagination promo promotion share sharing sidebar sponsor sponsored".split())
WEAK = frozenset("banner form header masthead modal notice notices popup recommended related reply replies signup social subscribe toolbar widget".split())
MAIN_WORDS = frozenset("article content entry main post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a text, which are no container of one.
LEAVES = HEADINGS | frozenset("address blockquote caption dd details dl dt fieldset figcaption figure hgroup hr legend li ol option p pre summary table tbody td tfoot th thead title tr ul".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_KEEPS = frozenset("html body div article section main table ul ol dl td th nav aside header footer form blockquote".split())
_P_ENDS = BLOCK - {"caption", "option", "tr", "td", "th", "tbody", "thead", "tfoot"}


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


class Element:
    """An open element: its token's key and what holds for all that stands in it."""

    __slots__ = ("tag", "key", "above", "marked", "aside", "weak", "main", "slot", "inside", "link", "heading", "block", "plain", "linked", "lines", "parts", "forms")

    def __init__(self, tag: str, attrs: str, above: Element | None, main: int | None):
        self.tag, self.above = tag, above
        self.plain = self.linked = 0
        self.forms: dict[str, dict[str, int]] | None = None  # labels of children: their spellings with numbers, in order
        if above is None:
            self.key, self.marked, self.aside, self.weak = 0, False, False, None
            self.main = self.slot = self.inside = self.link = self.heading = self.block = False
            return
        label, classes, words = tag, (), frozenset()
        if "=" in attrs:
            found = [v.strip("\"'").lower() for _, v in _MARKS.findall(attrs)]
            classes = " ".join(found).split()
            words = frozenset(w for c in classes for w in re.split(r"[^a-z0-9]+", c) if w)
            spelled = ".".join(classes)
            label += "." + re.sub("[0-9]+", "#", spelled)
            if "#" in label:
                above.forms = above.forms or {}
                known = above.forms.setdefault(label, {})
                if order := known.setdefault(spelled, len(known)):
                    label += f"~{order}"
        self.marked = bool(classes)
        self.key = _signed(xxhash.xxh64_intdigest(label, above.key % (1 << 64)))
        named = tag in ("article", "main") or bool(words & MAIN_WORDS)
        self.main, self.slot = above.main or named, above.slot or self.key == main
        whole = tag in ("html", "body", "article", "main")
        # Inside the article a single paragraph goes only if the word is its class, and a header is the article's own.
        inside = above.inside
        self.inside = inside or named or (self.key == main and not whole)
        strong = not whole and bool(words & STRONG if not inside or tag not in LEAVES else STRONG.intersection(classes))
        weak = not whole and bool(words & WEAK)
        self.aside = above.aside or strong or (tag in ASIDE and not (inside and tag == "header")) or (weak and not inside)
        self.weak = self if weak and inside else above.weak
        self.link, self.heading, self.block = above.link or tag == "a", above.heading or tag in HEADINGS, above.block or tag in BLOCK


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_key(text: str, element: Element) -> int:
    """The key of a run of text in an element."""
    return _signed(xxhash.xxh64_intdigest(text, ~element.key % (1 << 64)))


def events(html: str, main: int | None = None) -> Iterator[tuple[str, str, Element]]:
    """(kind, value, element): an opened, closed or void element, or text in element.

    Omitted end tags are supplied; unknown end tags are passed over; what raw elements hold is no text."""
    root = Element("", "", None, None)
    stack = [root]
    opened: dict[str, list[int]] = {}  # places in the stack of the open elements of a tag
    keeps: list[int] = [0]  # places of those that no omitted end tag closes
    at = begin = 0
    last = -1  # place of a > that was looked for

    def close() -> Element:
        top = stack.pop()
        opened[top.tag].pop()
        if top.tag in _KEEPS:
            keeps.pop()
        return top

    while (at := html.find("<", at)) >= 0:
        if html.startswith(("<!", "<?"), at):
            end = html.find("-->", at + 4) if html.startswith("<!--", at) else html.find(">", at)
            if end < 0 and not html.startswith("<!--", at):
                break
            after = len(html) if end < 0 else end + (3 if html.startswith("<!--", at) else 1)
            m = None
        else:
            m = _TAG.match(html, at) or _LOOSE.match(html, at)
            if m is None:
                if last < at and (last := html.find(">", at)) < 0:
                    break
                at += 1
                continue
            after = m.end()
        if at > begin:
            yield "text", html[begin:at], stack[-1]
        at = begin = after
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                while True:
                    top = close()
                    yield "close", top.tag, top
                    if top.tag == tag:
                        break
            continue
        ends = _CLOSES.get(tag, ()) + (("p",) if tag in _P_ENDS else ())
        place = max((opened[t][-1] for t in ends if opened.get(t)), default=-1)
        if place >= keeps[-1] and place > 0:
            while len(stack) > place:
                top = close()
                yield "close", top.tag, top
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            yield "void", tag, stack[-1]
            continue
        top = Element(tag, m[3], stack[-1], main)
        opened.setdefault(tag, []).append(len(stack))
        if tag in _KEEPS:
            keeps.append(len(stack))
        stack.append(top)
        yield "open", tag, top
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = begin = end.end() if end else len(html)
            close()
            yield "close", tag, top
    if begin < len(html):
        yield "text", html[begin:], stack[-1]
    while len(stack) > 1:
        top = close()
        yield "close", top.tag, top


#: Columns of a token: tag and the token above it; then sums: pages, times, first places, text outside of links and in them (less
#: that of parts set aside), whether it is named as the article, set aside, marked by a class or id.
SUMS = ("vector", "pages", "times", "places", "plain", "linked", "main", "aside", "marked")


def page_tokens(html: str) -> dict[int, list]:
    """A page's tokens by key: tag (empty for text), key above, count, first place, text outside of links and in links, main, aside, marked.

    Key 0 stands for the page: all text of its block elements but that of parts set aside."""
    out: dict[int, list] = {0: ["html", 0, 1, 0, 0, 0, 0, 0, 0]}
    place = 0
    for kind, value, e in events(html):
        if kind == "open":
            place += 1
            row = out.get(e.key)
            if row is None:
                out[e.key] = row = [e.tag, e.above.key, 0, place, 0, 0, int(e.main), int(e.aside), int(e.marked)]
            row[2] += 1
        elif kind == "text" and e.block and (text := " ".join(value.split())):
            place += 1
            size, linked = len(text), e.link and not e.heading
            e.linked += size * linked
            e.plain += size * (not linked)
            row = out.setdefault(text_key(text, e), ["", e.key, 0, place, 0, 0, 0, int(e.aside), 0])
            row[2] += 1
            row[4 + linked] += size
        elif kind == "close":
            row = out[e.key]
            row[4] += e.plain
            row[5] += e.linked
            # Text of a part set aside counts for that part, not for what holds it.
            if e.above.aside or not e.aside:
                e.above.plain += e.plain
                e.above.linked += e.linked
            if not e.above.key:
                out[0][4], out[0][5] = e.above.plain, e.above.linked
    return out


def host_tokens(pages: DataFrame) -> DataFrame:
    """Per host and token: sums over its pages, and its occurrence vector's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def flush() -> pa.RecordBatch:
            keys, rows = list(held), list(held.values())
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
            columns += [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([_signed(r[2] % (1 << 64)) for r in rows], pa.int64())]
            columns += [pa.array([r[i] for r in rows], pa.int64()) for i in range(3, 11)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["host", "token", "tag", "above", *SUMS])

        for batch in batches:
            for host, page, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                name = str(page)
                for token, (tag, above, n, *sums) in page_tokens(html or "").items():
                    row = held.setdefault((host, token), [tag, above] + [0] * 9)
                    row[2] += xxhash.xxh64_intdigest(f"{name}\n{n}")
                    for i, v in enumerate((1, n, *sums), 3):
                        row[i] += v
                if len(held) > 50_000:
                    yield flush()
        yield flush()

    x = pages.select(host_of(F.col("url")).alias("host"), "page_id", "html").mapInArrow(run, "host string, token long, tag string, above long, " + ", ".join(f"{c} long" for c in SUMS))
    # The vectors' hashes add up modulo 2^64; as the sum of longs may not overflow, their halves are added apart.
    low, high = F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("vector", 32)
    whole = F.concat_ws(":", (F.sum(high) % (1 << 32)).cast("string"), F.sum(low).cast("string"))
    return x.groupBy("host", "token").agg(F.min("tag").alias("tag"), F.min("above").alias("above"), whole.alias("vector"), *(F.sum(c).alias(c) for c in SUMS[1:]))


def nest(tokens: dict[int, dict]) -> list[dict]:
    """The valid classes of a host's frequent tokens: each with its tokens in order and the slot (a token, 0: the page) it nests in."""
    under: dict[int, list[int]] = {}
    for k, t in tokens.items():
        under.setdefault(t["above"], []).append(k)
    classes: dict[tuple, list[int]] = {}
    slot: dict[int, int] = {}
    todo = list(under.get(0, ()))
    for k in todo:  # from the page downwards, so what holds a token comes first
        up, vector = tokens[k]["above"], tokens[k]["vector"]
        slot[k] = slot[up] if up and tokens[up]["vector"] == vector else up
        classes.setdefault((slot[k], vector), []).append(k)
        todo += under.get(k, ())
    mean = {k: t["places"] / t["pages"] for k, t in tokens.items()}
    out: list[dict] = []
    held = {0}
    for (up, _), members in classes.items():
        # A class in the slot of an invalid one is none either.
        if up in held and all(mean[tokens[k]["above"]] <= mean[k] for k in members if tokens[k]["above"] in members):
            out.append({"slot": up, "tokens": sorted(members, key=lambda k: (mean[k], k))})
            held.update(members)
    return out


def deduce(rows: Iterable[dict], pages: int) -> dict:
    """A host's template from its frequent tokens: nested classes, the main slot, and the texts in it that are part of the template."""
    every = {t["token"]: t for t in rows}
    page = every.pop(0)
    classes = nest(every)
    held = {k: every[k] for c in classes for k in c["tokens"]}
    texts = [t for t in held.values() if not t["tag"] and pages >= LEAST]
    plain, linked = dict.fromkeys([0, *every], 0), dict.fromkeys([0, *every], 0)
    for t in texts:
        up, below = t["above"], 0
        # Text of a part set aside counts for that part, not for what holds it.
        while not below or (every[up]["aside"] if up else 0) or not every[below]["aside"]:
            plain[up] += t["plain"]
            linked[up] += t["linked"]
            if not up:
                break
            up, below = every[up]["above"], up
    if 10 * (page["plain"] + page["linked"] - plain[0] - linked[0]) < page["plain"] + page["linked"]:
        texts, plain, linked = [], dict.fromkeys(plain, 0), dict.fromkeys(linked, 0)
    free = {k: t["plain"] - plain[k] for k, t in held.items()}
    total = page["plain"] - plain[0]
    depth = {0: 0}
    for k, t in held.items():
        depth[k] = depth.get(t["above"], 0) + 1
    slots = [k for k, t in held.items() if t["tag"] in BLOCK | {"html"} and t["tag"] not in LEAVES and not t["aside"] and free[k] > 0]
    named = [k for k in slots if held[k]["main"] and 2 * free[k] >= total]
    # Without a named element, the innermost one outside of which there are only the template, links and parts set aside.
    main = max(named or [k for k in slots if free[k] == total], key=lambda k: (free[k], depth[k], k), default=0)
    said = []
    for t in texts:
        up, alone = t["above"], bool(t["linked"])
        while up and up != main:
            own = 10 * (plain[up] + linked[up]) >= 9 * (every[up]["plain"] + every[up]["linked"])
            alone |= bool(every[up]["marked"]) and own
            up = every[up]["above"]
        if up == main and alone:
            said.append(t["token"])
    return {"classes": classes, "main": main, "texts": sorted(said), "tag": held[main]["tag"] if main else ""}


def _read(html: str, wanted: str, main: int | None = None, texts: frozenset = frozenset()) -> tuple[list[str], int, bool, int]:
    """Lines of the main slot, of what names itself the article, or of the page; their length outside of links; whether the slot was
    found; the length of what is part of the template."""
    out: list[str] = []
    block: list[str] = []
    plain = said = 0
    found = wanted != "slot"

    def end() -> None:
        if text := " ".join(unescape("".join(block)).split()):
            out.append(text)
        block.clear()

    for kind, value, e in events(html, main):
        if kind == "text":
            if e.aside or e.weak and wanted == "all":
                continue
            size = len(value.strip())
            if wanted == "slot" and e.block:
                if not e.slot:
                    continue
                found |= size > 0
                if texts and size and text_key(" ".join(value.split()), e) in texts:
                    said += size
                    continue
            elif wanted == "main" and not e.main:
                continue
            block.append(value)
            linked = e.link and not e.heading
            plain += size * (not linked)
            if e.weak:
                e.weak.plain += size * (not linked)
                e.weak.linked += size * linked
            continue
        if value in BLOCK:
            end()
        elif value == "br":
            block.append(" ")
        if kind != "void" and e.weak is e:
            if kind == "open":
                e.lines, e.parts = len(out), len(block)
            elif e.linked >= e.plain:
                del out[e.lines :]
                del block[e.parts :]
                plain -= e.plain
            elif e.above.weak:
                e.above.weak.plain += e.plain
                e.above.weak.linked += e.linked
    end()
    return out, plain, found, said


def extract(html: str | None, main: int | None = None, texts: Iterable[int] = (), tag: str = "") -> str:
    """Text of a page by its host's template, or of what names itself the article, or of the page."""
    if not html:
        return ""
    texts = frozenset(texts)
    if main and (tag not in ("html", "body") or texts):
        lines, plain, found, said = _read(html, "slot", main, texts)
        if said > sum(map(len, lines)):
            lines, plain, found, said = _read(html, "slot", main)
        if found and lines and tag not in ("html", "body"):
            return "\n".join(lines)
    else:
        lines, found = [], False
    named, held, _, _ = _read(html, "main")
    whole, total, _, _ = _read(html, "all")
    if named and 2 * held >= total:
        return "\n".join(named)
    return "\n".join(lines if found and lines else whole)


def host_templates(pages: DataFrame) -> DataFrame:
    """host, main (the main slot's token), tag, texts (text tokens in it that are part of the template), template (JSON: nested classes)."""

    def run(t: pa.Table) -> pa.Table:
        got = deduce(t.drop_columns(["host", "n"]).to_pylist(), t["n"][0].as_py())
        row = {"host": t["host"][0].as_py(), "main": got["main"], "tag": got["tag"], "texts": got["texts"], "template": json.dumps(got["classes"])}
        return pa.table({k: pa.array([v], kind) for (k, v), kind in zip(row.items(), (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()))})

    # Only tokens of half of a host's pages can belong to its template, so no more than twice a page's tokens are gathered for a host.
    count = pages.groupBy(host_of(F.col("url")).alias("_host")).agg(F.count("*").alias("n"))
    tokens = host_tokens(pages).join(count, F.col("host") == F.col("_host")).where(f"pages * 2 >= n AND (tag <> '' OR pages >= {LEAST})").drop("_host")
    return tokens.groupBy("host").applyInArrow(run, "host string, main long, tag string, texts array<long>, template string")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    templates = cut(host_templates(pages), "templates").select(F.col("host").alias("_host"), F.col("main").alias("_main"), F.col("tag").alias("_tag"), F.col("texts").alias("_texts"))
    if (templates.select(F.sum(4 + F.size("_texts"))).first()[0] or 0) <= BROADCAST_NUMBERS:
        templates = F.broadcast(templates)

    @F.arrow_udf("string")
    def text_of(html: pa.Array, main: pa.Array, tag: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([extract(h, m, x or (), t or "") for h, m, t, x in zip(*(c.to_pylist() for c in (html, main, tag, texts)))], pa.string())

    x = pages.select("page_id", "url", "html").join(templates, host_of(F.col("url")) == F.col("_host"), "left")
    x = x.select("page_id", "url", text_of("html", "_main", "_tag", "_texts").alias("text"))
    return x.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
