"""Main-text extraction by equivalence-class template deduction over the pages of a host.

A page is a sequence of tokens: element openings, told apart by their path from the root (tag, first name, place among
its like), and texts, told apart by path and content. Elements without blocks inside them (paragraphs, headings,
cells) hold data and are no tokens of their own. Tokens of a host with the same occurrence vector (on which pages) form
an equivalence class. The vector is never written out: a commutative hash of its pages stands for it, so classes come
from one aggregation that combines before it shuffles, however many pages a host has. A class is valid if it is large
(half of the host's pages at least, and `min_pages` different ones), has an element, and its outermost elements hang in
one other class: so classes nest, from the class of the whole page down, and their elements make the host's template.

The template's elements delimit slots, and what is in a slot on the host's pages together decides about it:
- From the whole page the walk goes down into the one slot that holds `share` of the varying text outside links, as
  long as it has two blocks a page. Where it ends is the main slot. Names only break ties: an article or main element
  ends the walk, and is taken where no slot has that share; parts with the names of BESIDE count a quarter.
- Slots inside the main slot go if most of their text is in links or the same on all pages. So do short texts of valid
  classes.
- A page without the main slot has the deepest element of the walk that it has. With none but the root, or on hosts with
  too few pages to deduce anything, fixed lists of tags and names (MAIN, LEFT_OUT, BESIDE) choose.
Parts that names mark as menus, adverts, forms, comments and the like are left out of the main slot in any case.

Only tokens of half of a host's pages are gathered by host, at most twice as many as a page has on average, so no
host is too large for the task that deduces its template. Templates (a few numbers a host) are broadcast up to a
checked number of tokens, else joined by host.

Defined results: null or empty html gives an empty text; a null url is a host of its own; broken markup is read
like a browser does (unclosed elements end with their parent) in time linear in the page, however deep it nests;
a host with fewer than `min_pages` different pages has no template; equal slots are decided for the smaller token;
repeated rows give repeated results and one page to the template; other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import in_arrow, slices
from corvane.llm.store import Tables, join_checked

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+>|[^>]*(?:>|\Z)))", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s/>=])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title template iframe svg math canvas object audio video".split())
LEFT_OUT = RAW | frozenset("head nav footer aside form button select option datalist dialog menu label fieldset".split())
MAIN = frozenset(("article", "main"))
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening of the first kind ends an open element of the second kind.
ENDS = {k: frozenset(("p",)) for k in "p div ul ol dl table section article aside nav header footer form h1 h2 h3 h4 h5 h6 pre blockquote figure hr main".split()} | {
    "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",)),
}
#: Elements that an implied end does not reach through.
SCOPE = frozenset("ul ol dl table div section article aside nav header footer form main body html blockquote figure button".split())
#: Parts of class, id or role names that mark elements beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr "
    "notice notices alert comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login popup modal "
    "overlay footer header masthead copyright widget toolbar pagination pager complementary contentinfo search".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass(frozen=True)
class TemplateParams:
    min_pages: int = 4
    share: float = 0.6
    short: int = 100
    max_broadcast: int = 2_000_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _beside(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in LEFT_OUT or (tag == "header" and not in_main):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if HIDDEN.search(attrs):
        return True
    for m in NAMES.finditer(attrs):
        parts = {p.lower() for p in PART.findall(m[2] or m[3] or m[4] or "")}
        if found := parts & BESIDE:
            if tag in MAIN and not found & COMMENTS:
                continue
            if found == {"header"} and in_main:
                continue
            return True
    return False


#: The token of the whole page, and what makes a token a seed.
ROOT, SEED = 1, (1 << 64) - 1


@dataclass
class Page:
    """Elements in page order, each with its parent's index; the root is 0. Texts in page order with the index of
    their element, and None for a break between blocks."""

    parent: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [ROOT])
    tag: list[str] = field(default_factory=lambda: [""])
    attrs: list[str] = field(default_factory=lambda: [""])
    texts: list[tuple[int, str | None]] = field(default_factory=list)

    def sides(self, main: int = 0) -> tuple[list[bool], list[bool]]:
        """(names put the element beside the article, it is in the main part), with `main` as the main part if given."""
        side, inside = [False], [False]
        for k in range(1, len(self.path)):
            tag, attrs, up = self.tag[k], self.attrs[k], self.parent[k]
            inside.append(inside[up] or k == main or tag in MAIN or ("main" in attrs.lower() and any("role" in m[1].lower() and "main" in m[0].lower() for m in NAMES.finditer(attrs))))
            side.append(k != main and (side[up] or _beside(tag, attrs, inside[up])))
        return side, inside


def parse(html: str) -> Page:
    page, keys = Page(), defaultdict(lambda: defaultdict(int))
    stack, where, scope = [0], defaultdict(list), []
    at, end = 0, len(html)

    def cut(k: int) -> None:
        while len(stack) > k:
            tag = page.tag[stack.pop()]
            where[tag].pop()
            if tag in SCOPE:
                scope.pop()

    while at < end:
        m = TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            text = html[at:stop]
            page.texts.append((stack[-1], entities.unescape(text) if "&" in text else text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            page.texts.append((stack[-1], None))
        if m[1]:
            if where[tag]:
                cut(where[tag][-1])
            continue
        if kinds := ENDS.get(tag):
            k = max((where[x][-1] for x in kinds if where[x]), default=-1)
            if k > (scope[-1] if scope else -1):
                cut(k)
        attrs = m[3][:-1]
        if tag in RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if tag in VOID or attrs.endswith("/"):
            continue
        up = stack[-1]
        if tag in INLINE:
            path = page.path[up]
        else:
            name = NAMES.search(attrs) if attrs else None
            key = f"{tag} {name[0]}" if name else tag
            keys[up][key] += 1
            path = _signed(xxhash.xxh3_64_intdigest(f"{key} {keys[up][key]}", seed=page.path[up] & SEED))
        where[tag].append(len(stack))
        if tag in SCOPE:
            scope.append(len(stack))
        stack.append(len(page.path))
        page.parent.append(up)
        page.path.append(path)
        page.tag.append(tag)
        page.attrs.append(attrs)
    return page


@dataclass(frozen=True)
class Template:
    """The walk from the page to its main slot, slots inside it that go, and texts that go."""

    walk: tuple[int, ...] = ()
    drop: frozenset[int] = frozenset()
    texts: frozenset[int] = frozenset()


NO_TEMPLATE = Template()


def _text_token(path: int, text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text, seed=path & SEED))


def extract(html: str | None, template: Template = NO_TEMPLATE) -> str:
    page = parse(html or "")
    main = 0
    if len(template.walk) > 1:
        first = {p: k for k, p in reversed(list(enumerate(page.path)))}
        main = next((first[p] for p in reversed(template.walk) if p in first), 0)
    side, inside = page.sides(main)
    if main:
        under = [False] * len(page.path)
        for k in range(main, len(under)):
            under[k] = k == main or under[page.parent[k]]
            side[k] = side[k] or (k != main and under[k] and page.path[k] in template.drop)
            side[k] = side[k] or (k != main and side[page.parent[k]])
        inside = under
    use = [inside[k] and not side[k] for k in range(len(side))]
    if not any(use[k] and t and not t.isspace() for k, t in page.texts) and not main:
        use = [not s for s in side]
    kept = [(k, t) for k, t in page.texts if t is None or use[k]]
    left = [(k, t) for k, t in kept if t is None or _text_token(page.path[k], " ".join(t.split())) not in template.texts] if template.texts else kept
    join = lambda parts: " ".join("".join(" " if t is None else t for _, t in parts).split())
    return join(left) or join(kept)


def _counts(html: str, short: int) -> Iterator[tuple]:
    """(token, element, parent token, weighted text outside links, text, text in links, blocks, main by name, hash of
    what is inside) for the tokens of a page."""
    page = parse(html)
    side, inside = page.sides()
    n = len(page.path)
    block = [t not in INLINE for t in page.tag]
    link = [False] * n
    prose, text, linked, blocks, inner = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    own = list(range(n))  # the element itself, or the block around an inline one
    for k in range(1, n):
        up = page.parent[k]
        link[k] = link[up] or page.tag[k] == "a"
        if not block[k]:
            own[k] = own[up]
    seen = set()
    for k, t in page.texts:
        if t is None or not (t := " ".join(t.split())):
            continue
        b, size = own[k], len(t)
        token = _text_token(page.path[k], t)
        text[b] += size
        inner[b] += token
        if link[k]:
            linked[b] += size
        else:
            prose[b] += size if side[k] else 4 * size
        if size <= short and token not in seen:
            seen.add(token)
            yield token, False, 0, 0, 0, 0, 0, False, 0
    for k in range(n - 1, 0, -1):
        if block[k]:
            up = own[page.parent[k]]
            blocks[up] += 1 + blocks[k]
            for sums in (prose, text, linked, inner):
                sums[up] += sums[k]
    for k in range(n):
        if block[k] and (blocks[k] or not k):
            yield page.path[k], True, page.path[own[page.parent[k]]], prose[k], text[k], linked[k], blocks[k], inside[k], inner[k]


#: What is known of a token of a host, in the order of the columns.
SUMS = ("pages", "prose", "text", "linked", "blocks")
STATS = "host string, token bigint, element boolean, parent bigint, main boolean, vec bigint, bits bigint, inner bigint, pages bigint, prose bigint, text bigint, linked bigint, blocks bigint"


def _page_counts(pages: DataFrame, short: int) -> DataFrame:
    """Per host and token, over the pages of a slice of a batch: STATS. A page that comes twice in it counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STATS.split(", ")]
        kinds = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in STATS.split(", ")]
        for batch in batches:
            for b, htmls in slices(batch, "html", 8_000_000):
                out: dict[tuple, list] = {}
                for host, html in zip(b.column("host").to_pylist(), htmls, strict=True):
                    if not html:
                        continue
                    key = xxhash.xxh3_64_intdigest(html)
                    for token, element, parent, prose, text, linked, blocks, main, inner in _counts(html, short):
                        row = out.setdefault((host, token), [element, parent, False, 0, 0, 0, 0, 0, 0, 0, 0])
                        row[2] |= main
                        row[3] = (row[3] + key) & ((1 << 53) - 1)
                        row[4] |= 1 << (key & 63)
                        row[5] |= 1 << (inner & 63)
                        row[6] += 1
                        row[7] += prose
                        row[8] += text
                        row[9] += linked
                        row[10] += blocks
                cols = list(zip(*((h, t, r[0], r[1], r[2], r[3], _signed(r[4]), _signed(r[5]), *r[6:]) for (h, t), r in out.items()), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return in_arrow(pages.select("host", "html"), run, STATS)


def deduce(rows: list[dict], p: TemplateParams = TemplateParams()) -> Template:
    """The template of a host from what is known of its large tokens."""
    home = {r["token"]: (r["pages"], r["vec"]) for r in rows if r["element"]}
    classes = defaultdict(list)
    for r in rows:
        classes[r["pages"], r["vec"]].append(r)
    valid = set()
    for c, members in classes.items():
        outer = {home.get(r["parent"]) for r in members if r["element"] and home.get(r["parent"]) != c}
        if any(r["element"] for r in members) and len(outer) <= 1:
            valid.add(c)
    elements = {r["token"]: r for r in rows if r["element"] and (r["pages"], r["vec"]) in valid}
    if ROOT not in elements:
        return NO_TEMPLATE
    inner = defaultdict(list)
    for t, r in sorted(elements.items()):
        if t != ROOT:
            inner[r["parent"]].append(t)

    def variety(r: dict) -> float:
        """Share of the pages on which the inside differs, as far as 64 bits tell."""
        zero = 64 - (r["inner"] & SEED).bit_count()
        distinct = 64 * math.log(64 / zero) if zero else 64.0
        return min(1.0, 2 * (distinct - 0.5) / min(r["pages"], 64)) if r["pages"] > 1 else 1.0

    weight = {t: r["prose"] * max(variety(r), 0.02) for t, r in elements.items()}
    walk, here = [ROOT], ROOT
    while not elements[here]["main"]:
        best = max(inner[here], key=lambda t: weight[t], default=None)
        if best is None or weight[best] < p.share * weight[here] or elements[best]["blocks"] < 2 * elements[best]["pages"]:
            break
        walk.append(here := best)
    if not elements[here]["main"]:
        named = [t for t, r in elements.items() if r["main"] and not elements.get(r["parent"], r)["main"] and 5 * weight[t] >= weight[ROOT]]
        if named:
            walk.append(here := max(named, key=lambda t: weight[t]))
    drop, todo = set(), list(inner[here])
    while todo:
        t = todo.pop()
        r = elements[t]
        if 2 * r["linked"] > r["text"] or (variety(r) < 0.1 and 10 * r["prose"] < 3 * elements[here]["prose"]):
            drop.add(t)
        else:
            todo += inner[t]
    texts = {r["token"] for c in valid for r in classes[c] if not r["element"]}
    return Template(tuple(walk), frozenset(drop), frozenset(texts))


def templates(pages: DataFrame, p: TemplateParams = TemplateParams()) -> DataFrame:
    """(host, walk, drop, texts) of every host with a template; pages: host, html."""
    vectors = _page_counts(pages, p.short).groupBy("host", "token").agg(
        *[F.sum(c).alias(c) for c in SUMS], *[F.bit_or(c).alias(c) for c in ("bits", "inner")], *[F.max(c).alias(c) for c in ("element", "parent", "main")],
        F.pmod(F.sum(F.col("vec").cast("decimal(38,0)")), F.lit(1 << 53).cast("decimal(20,0)")).cast("bigint").alias("vec"),
    )
    large = vectors.where((F.col("pages") >= p.min_pages) & (F.bit_count("bits") >= p.min_pages))
    of = large.where((F.col("token") == ROOT) & F.col("element")).select("host", F.col("pages").alias("of"))
    known = ["token", "element", "parent", "main", "vec", "inner", *SUMS]
    hosts = large.join(of, "host").where("2 * pages >= of").groupBy("host").agg(F.collect_list(F.struct(*known)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.list_(pa.int64())] * 3]
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                made = [deduce(rows, p) for rows in part.column("rows").to_pylist()]
                cols = [part.column("host"), [list(t.walk) for t in made], [sorted(t.drop) for t in made], [sorted(t.texts) for t in made]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, x) for c, x in zip(cols, kinds, strict=True)], names=["host", "walk", "drop", "texts"])

    return in_arrow(hosts, run, "host string, walk array<bigint>, drop array<bigint>, texts array<bigint>")


def main_texts(pages: DataFrame, p: TemplateParams = TemplateParams()) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", host.alias("host"), F.col("html").cast("string").alias("html"))
    found = Tables(pages.sparkSession, "templates").write(templates(rows, p), "hosts")
    size = found.agg(F.coalesce(F.sum(F.size("walk") + F.size("drop") + F.size("texts") + 8), F.lit(0))).first()[0]
    both = join_checked(rows, found, "host", "left", size, p.max_broadcast).select("page_id", "url", "html", "walk", "drop", "texts")
    kept = rows.select("page_id", "url").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, htmls in slices(batch, "html"):
                parts = (b.column(c).to_pylist() for c in ("walk", "drop", "texts"))
                out = [extract(html, Template(tuple(w), frozenset(d), frozenset(t)) if w else NO_TEMPLATE) for html, w, d, t in zip(htmls, *parts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return in_arrow(both, run, f"{ddl}, text string").withColumn("n_chars", F.length("text").cast("bigint"))


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
