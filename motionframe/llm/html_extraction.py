"""Main text of web pages by site template removal.

Pages are parsed twice. The first pass hashes every element with its whole subtree, and Spark counts on how
many pages of a host each hash stands; the second pass deletes the subtrees that recur. Nothing is decided
before the count but what a browser doesn't show (scripts, styles, form fields, hidden elements).

Marks of a subtree, by grade:

* its markup and text (``PLAIN``): a template on ``LEAST_PAGES`` pages that are also ``LEAST_SHARE`` of the
  pages of one section (first directory of the address) or one layout (containers outside the article) of
  its host, or on ``MANY_PAGES``, whatever the size of the host;
* the same for articles and the paragraphs, headings, lists and tables in them (``STRICT``): on
  ``ARTICLE_PAGES`` pages that are ``ARTICLE_SHARE`` of a section or layout, so that passages which pages
  really share stay;
* the same where a class or tag hints at page furniture (``HINTED``): on two pages;
* its markup without the text (``FORM``), for menus, footers, sidebars, adverts, comments and the like, whose
  texts change from page to page: on two pages. Lists of links outside articles have such a mark as well,
  counted like plain ones.

Names of tags and classes break the tie for what no count reaches (hosts of one page, furniture that is on a
single page). Outside articles strong names do, and hints on what has no heading. Inside articles names count
for less: strong tags (``nav``, ``form`` and the like) and whole names on containers (``comments``, not
``comments-intro``) do, names on paragraphs, headings, lists and tables don't. An ``article`` that is named as
a comment is one. Where the blocks left in articles hold ``ARTICLE_TEXT`` of the text left, the main text is
those, else all that is left (in ``main``, if there is any). Text of hidden elements, inline ones too, is
nowhere part of a block. Pages with one text (copies under several addresses) count once.

Only hashes are shuffled. Template hashes are broadcast if they are at most ``BROADCAST`` and joined by page
otherwise.

Defined cases: null or empty html gives an empty text; a null URL belongs to the host without a name; unclosed
and stray tags close as browsers close them; time is linear in the length of a page, however it is nested or
left open; ties don't arise, for a limit that is just reached counts; repeated rows get equal texts each; null
ids stay null; an empty table gives an empty result; only id, url and html are read, so further columns can
have any names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Set

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.llm._common import ascii_lower, long_id, table, text_id, written

LEAST_PAGES, LEAST_SHARE = 5, 0.2
ARTICLE_PAGES, ARTICLE_SHARE = 10, 0.8
MANY_PAGES = 100
NAMED_PAGES = 2
ARTICLE_TEXT = 0.02
#: So many template hashes (8 bytes each) go to every task at most.
BROADCAST = 1_000_000

PLAIN, STRICT, HINTED, FORM = range(4)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z!?][^>]*+>|<!\[CDATA\[|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")
_RAW = {tag: re.compile(f"</{tag}(?![a-z0-9])", re.I) for tag in "script style textarea title xmp iframe noembed noframes".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_UNSHOWN = frozenset("head script style noscript template button select option textarea title iframe object embed svg canvas audio video noembed noframes input label fieldset".split())
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr td th figure figcaption".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_SCOPE = frozenset("ul ol dl table body html article main section div".split())
_STRONG_TAGS = frozenset("nav aside footer form menu dialog".split())
_STRONG_ROLES = frozenset("navigation contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
_STRONG = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr comment comments disqus respond newsletter subscribe subscription pagination pager modal".split())
_HINTS = frozenset("banner header masthead topbar aside notice notices alert replies reply share sharing social related recommended signup login popup overlay widget search toolbar promo promotion".split())
_NEGATIONS = frozenset("no has with without hide".split())
_COMMENT = re.compile(r"(?:div-)?comments?|(?:div-)?comment[-_].*")
#: What a name says of an element: nothing, a hint, furniture, a reader's comment.
UNNAMED, HINT, FURNITURE, COMMENT = range(4)


class _Element:
    __slots__ = ("tag", "name", "up", "named", "unshown", "inside", "parts", "forms", "chars", "linked", "heading", "exact", "form", "gone")

    def __init__(self, tag: str, name: str, up: _Element | None, named: int, unshown: bool, inside: str):
        self.tag, self.name, self.up, self.named, self.unshown, self.inside = tag, name, up, named, unshown, inside
        self.parts: list[str] = []
        self.forms: list[str] = []
        self.chars = self.linked = 0
        self.heading, self.exact, self.form, self.gone = tag in _HEADINGS, 0, 0, False

    def close(self) -> None:
        """Hashes the subtree from its children's hashes and hands sums to the parent."""
        own = f"<{self.tag} {self.name}"
        self.exact = xxhash.xxh3_64_intdigest("\x00".join((own, *self.parts)).encode("utf-8", "surrogatepass"))
        self.form = xxhash.xxh3_64_intdigest("\x00".join((own, *self.forms)).encode("utf-8", "surrogatepass"))
        if self.tag == "a":
            self.linked = self.chars
        if up := self.up:
            up.parts.append(f"{self.exact:x}")
            if (form := f"{self.form:x}") != (up.forms[-1] if up.forms else ""):
                up.forms.append(form)
            up.chars += self.chars
            up.linked += self.linked
            up.heading |= self.heading
        self.parts = self.forms = []

    def grade(self) -> int:
        if self.named >= FURNITURE:
            return FORM
        if self.named == HINT:
            return HINTED
        return STRICT if self.tag in ("article", "main") or self.inside == "article" and self.tag in _TEXTUAL else PLAIN


def _attributes(raw: str) -> tuple[int, bool, bool, str]:
    """How class, id and role name an element, whether by a whole name, whether it is hidden, its class."""
    named, whole, hidden, name = UNNAMED, False, False, ""
    for key, a, b, c in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id"):
            words = _WORDS.split(value)
            words = [w for w, before in zip(words, ["", *words]) if before not in _NEGATIONS]
            tokens = value.split()
            if any(map(_COMMENT.fullmatch, tokens)):
                named = COMMENT
            named = max(named, FURNITURE if not _STRONG.isdisjoint(words) else HINT if not _HINTS.isdisjoint(words) else UNNAMED)
            whole |= named == COMMENT or not _STRONG.isdisjoint(tokens)
            name = value if key == "class" else name
        elif key == "role":
            strong = value.strip() in _STRONG_ROLES
            whole |= strong
            named = max(named, FURNITURE if strong else HINT if value.strip() in ("banner", "alert") else UNNAMED)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return named, whole, hidden, name


def _parse(page: str | None) -> tuple[list[tuple[str, _Element]], list[_Element], str]:
    """Blocks with their innermost elements, all block elements (parents first), and the layout of a page."""
    page = page or ""
    root = _Element("", "", None, 0, False, "")
    stack, elements, blocks, pending, layout = [root], [], [], [], set()
    opened: Counter[str] = Counter()

    def flush() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text and not stack[-1].unshown:
                blocks.append((text, stack[-1]))

    def pop_to(k: int) -> None:
        while len(stack) > k:
            done = stack.pop()
            opened[done.tag] -= 1
            done.close()

    # Past the last ">" no tag can end, so nothing is searched there.
    at, n, last = 0, len(page), page.rfind(">") + 1
    while at < n:
        m = _TOKEN.search(page, at, last) if at < last else None
        if not m and (comment := page.find("<!--", at)) >= 0:
            n = comment
        text = page[at : m.start() if m else n]
        if text:
            if not stack[-1].unshown:
                text = html.unescape(text) if "&" in text else text
                pending.append(text)
                if text := " ".join(text.split()):
                    stack[-1].parts.append(text)
                    stack[-1].chars += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in _BLOCKS:
                flush()
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if tag not in _BLOCKS and stack[k].tag in _BLOCKS or tag == "p" and stack[k].tag in _ENDS_SCOPE:
                    break
            continue
        if tag == "br":
            pending.append("\n")
            continue
        if tag in _BLOCKS:
            flush()
            ends = _CLOSES.get(tag, ())
            for k in range(len(stack) - 1, 0, -1) if opened["p"] or any(opened[x] for x in ends) else ():
                own = stack[k].tag
                if own == "p" or own in ends:
                    pop_to(k)
                    if own != "p":
                        break
                elif own in _ENDS_SCOPE:
                    break
        if tag in _VOID:
            continue
        raw = m[3] or ""
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = (page.find(">", end.end()) + 1 or n) if end else n
            continue
        named, whole, hidden, name = _attributes(raw) if raw else (UNNAMED, False, False, "")
        up = stack[-1]
        inside = up.inside
        if tag in ("article", "main") and (tag == "article" or not inside):
            if not inside and named != COMMENT:
                for e in stack:  # a wrapper around the article isn't furniture, whatever its class says
                    e.named = e.named if e.tag in _STRONG_TAGS or e.named == COMMENT else UNNAMED
            inside = tag
        if tag in ("html", "body", "main") or tag == "article" and named != COMMENT:
            named = UNNAMED
        elif tag in _STRONG_TAGS:
            named = max(named, FURNITURE)
        elif tag == "header" and inside != "article":
            named = max(named, HINT)
        elif inside == "article" and tag != "article" and (tag in _TEXTUAL or not whole):
            named = min(named, HINT)
        if inside != "article" and tag in _BLOCKS and tag not in _TEXTUAL:
            layout.add(f"{tag} {name}")
        e = _Element(tag, name, up, named, up.unshown or hidden or tag in _UNSHOWN, inside)
        stack.append(e)
        opened[tag] += 1
        if tag in _BLOCKS and tag not in ("html", "body"):
            elements.append(e)
        if raw.rstrip().endswith("/") and tag in ("svg", "path", "rect", "circle", "use"):
            pop_to(len(stack) - 1)
    flush()
    pop_to(1)
    return blocks, elements, "\n".join(sorted(layout))


def _marks(e: _Element, host: int) -> list[int]:
    """Signed 64-bit marks of a closed element on its host; the last two bits are the grade."""
    grade = e.grade()
    found = [(e.form if grade == FORM else e.exact, grade)]
    if grade == PLAIN and e.inside != "article" and 10 * e.linked >= 6 * e.chars:
        found.append((e.form, PLAIN))
    return [((h * 0x9E3779B97F4A7C15 ^ host) & (2**62 - 1) << 2 | g) - (1 << 63) for h, g in found]


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def main_text(page: str | None, host: str = "", templates: Set[int] = frozenset()) -> tuple[str, int, int]:
    """The main text; code points of blocks that a template took, and that a name took."""
    blocks, elements, _ = _parse(page)
    return _chosen(blocks, elements, _hash(host), templates)


def _chosen(blocks: list[tuple[str, _Element]], elements: list[_Element], key: int, templates: Set[int] = frozenset()) -> tuple[str, int, int]:
    # Inline elements aren't marked and pass on what their parents are.
    why: dict[int, int] = {}
    if templates:
        for e in elements:
            if e.chars and not templates.isdisjoint(_marks(e, key)):
                e.gone = True

    def cause(e: _Element) -> int:
        """1 for a template around ``e``, 2 for a name, 0 for neither; each element is looked at once."""
        path = []
        while e is not None and id(e) not in why:
            path.append(e)
            e = e.up
        found = why[id(e)] if e is not None else 0
        for x in reversed(path):
            if found != 1:
                alone = x.named >= FURNITURE or x.named == HINT and x.inside != "article" and not x.heading
                found = 1 if x.gone else found or 2 * alone
            why[id(x)] = found
        return found

    causes = [cause(e) for _, e in blocks]
    left = [(t, e.inside) for (t, e), c in zip(blocks, causes) if not c]
    sizes: Counter[str] = Counter()
    for t, inside in left:
        sizes[inside] += len(t)
    levels = {"article"} if sizes["article"] > ARTICLE_TEXT * sizes.total() else {"article", "main"}
    levels = levels if levels & sizes.keys() else sizes.keys()
    text = "\n\n".join(t for t, inside in left if inside in levels)
    return text, *(sum(len(t) for (t, _), c in zip(blocks, causes) if c == k) for k in (1, 2))


def blocks_of(page: str | None) -> list[str]:
    """Blocks of the main text of a page on its own."""
    text = main_text(page)[0]
    return text.split("\n\n") if text else []


def _host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def _section(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*/([^/?#]+)/", 1), F.lit(""))


def subtrees(pages: DataFrame) -> DataFrame:
    """(content, groups, marks) of every row of (host, section, html) with a main text: hashes only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for host, section, page in zip(f["host"], f["section"], f["html"]):
                blocks, elements, layout = _parse(page)
                key = _hash(host)
                marks = {m for e in elements if e.chars for m in _marks(e, key)}
                if marks:
                    groups = [_signed(_hash(host, "section", section)), _signed(_hash(host, "layout", layout))]
                    rows.append((_signed(_hash(host, _chosen(blocks, elements, key)[0])), groups, sorted(marks)))
            yield pd.DataFrame(rows, columns=["content", "groups", "marks"])

    return pages.select("host", "section", "html").mapInPandas(run, "content long, groups array<long>, marks array<long>")


def templates(found: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(mark) of the templates among ``subtrees``."""
    grade = F.col("mark").bitwiseAND(3)
    once = written(found.groupBy("content").agg(F.min(F.struct("marks", "groups")).alias("p")).select("p.*"), "page-subtrees")
    counts = once.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count("*").alias("n")).where(F.col("n") >= min(NAMED_PAGES, least_pages))
    counts = written(counts, "subtree-counts")
    needed = F.when(grade == STRICT, F.lit(max(ARTICLE_PAGES, least_pages))).otherwise(F.lit(least_pages))
    asked = counts.where((grade <= STRICT) & (F.col("n") >= needed)).select("mark")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST else asked
    inside = once.select("groups", F.explode("marks").alias("mark")).join(asked, "mark").select("mark", F.explode("groups").alias("group")).groupBy("mark", "group").agg(F.count("*").alias("n"))
    size = once.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("pages"))
    share = F.when(grade == STRICT, F.greatest(F.lit(ARTICLE_SHARE), F.lit(least_share))).otherwise(F.lit(least_share))
    often = inside.where(F.col("n") >= needed).join(size, "group").where(F.col("n") >= share * F.col("pages")).select("mark")
    named = counts.where((grade >= HINTED) & (F.col("n") >= NAMED_PAGES)).select("mark")
    many = counts.where((grade == PLAIN) & (F.col("n") >= max(MANY_PAGES, least_pages))).select("mark")
    return written(often.union(named).union(many).distinct(), "templates")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, broadcast: int = BROADCAST) -> DataFrame:
    """(page_id, url, text, template_chars, named_chars) of every row of ``pages``.

    The last two count the code points of blocks that recurring subtrees took, and that names alone took.
    """
    url = F.col("url")
    rows = pages.select(text_id("page_id"), url.cast("string").alias("url"), _host(url).alias("host"), _section(url).alias("section"), F.col("html").cast("string").alias("html"))
    marked = subtrees(rows)
    known = templates(marked, least_pages, least_share)
    few = known.count() <= broadcast
    shared = pages.sparkSession.sparkContext.broadcast(frozenset(r["mark"] for r in known.collect()) if few else None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            gone = [shared.value] * len(f) if shared.value is not None else [frozenset(() if g is None else g) for g in f["gone"]]
            texts = [main_text(page, host, g) for host, page, g in zip(f["host"], f["html"], gone)]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"]}).join(pd.DataFrame(texts, columns=["text", "template_chars", "named_chars"]))

    if not few:  # each page gets its own templates by a key made of its whole row
        rows = rows.withColumn("key", F.xxhash64("page_id", "url", "html"))
        own = subtrees_by_key(rows).join(known, "mark").groupBy("key").agg(F.collect_set("mark").alias("gone"))
        rows = rows.join(own, "key", "left").drop("key")
    schema = "page_id string, url string, text string, template_chars long, named_chars long"
    return long_id(rows.mapInPandas(run, schema), "page_id")


def subtrees_by_key(rows: DataFrame) -> DataFrame:
    """(key, mark) of the subtrees of each page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(k, m) for k, host, page in zip(f["key"], f["host"], f["html"]) for m in {m for e in _parse(page)[1] if e.chars for m in _marks(e, _hash(host))}]
            yield pd.DataFrame(out, columns=["key", "mark"])

    return rows.select("key", "host", "html").mapInPandas(run, "key long, mark long").distinct()


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "template_chars", "named_chars")


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLE: dict[str, str] = {}
