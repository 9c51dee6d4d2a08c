"""HTML pages as a small tree, and what retrieval reads from it: clean text, title, category, images.

The tree comes from the standard library's event parser with the usual implied end
tags.  Column functions are Arrow-batched; everything that is a rule on strings
(boilerplate lines, title precedence) is a column expression where it can be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Tags, selectors and lines that must equal the specification's.
BLOCK_TAGS = "p div li tr td th br h1 h2 h3 h4 h5 h6 table ul ol section article blockquote pre".split()
REMOVED_TAGS = "script style nav header footer aside noscript title".split()
REMOVED_CLASSES = "navbar nav sidebar menu breadcrumb footer ticket__params".split()
REMOVED_IDS = ["menu"]
BOILERPLATE_LINES = [
    "skip to main content", "help desk", "knowledgebase", "knowledge base", "suggested knowledgebase articles:",
    "suggested knowledgebase articles", "go back", "related articles", "was this article helpful?", "yes", "no", "rating :",
    "rating:", "article details", "home", "print", "email",
]
BOILERPLATE_PREFIXES = ["article id:", "category:", "rating :", "rating:", "views:"]
GENERIC_TITLES = [
    "article details", "knowledgebase", "knowledge base", "help desk", "home", "suggested knowledgebase articles", "skip to main content",
]
BOILERPLATE_IMAGES = ["logo.png", "spacer.gif"]
#: A site's own lines, titles and image files, in lower case, which count like those above; set them for the site at hand.
SITE_LINES: list[str] = []
SITE_TITLES: list[str] = []
SITE_IMAGES: list[str] = []
CAPTION_BLOCKS = "p li td h1 h2 h3 h4".split()
TEMPLATE_NOISE = re.compile("custom code to be included", re.I)

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_RAW = {"script", "style"}
#: A start tag ends these open ones.
_ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
_CLOSE_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            else:
                stack.extend(reversed(node.children))

    def above(self, tags: list[str]) -> Node | None:
        node = self.parent
        while node is not None and node.tag not in tags:
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = _ENDS.get(tag, set()) | ({"p"} if tag in _CLOSE_P else set())
        node = self.now
        while node.parent is not None and node.tag not in ("table", "ul", "ol", "div", "body"):
            if node.tag in ends:
                self.now = node.parent
                break
            node = node.parent
        child = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(child)
        if tag not in _VOID:
            self.now = child

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.now
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.now = node.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def block_text(root: Node) -> str:
    """Text with line breaks around blocks; inline tags add nothing; removed parts are left out."""
    out: list[str] = []
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        classes = node.attrs.get("class", "").split()
        if node.tag in REMOVED_TAGS or node.attrs.get("id") in REMOVED_IDS or any(c in REMOVED_CLASSES for c in classes):
            continue
        inner = list(reversed(node.children))
        stack.extend(["\n", *inner, "\n"] if node.tag in BLOCK_TAGS else inner)
    return "".join(out)


def _flat(node: Node) -> str:
    return " ".join(" ".join(node.strings()).split())


def _bare(node: Node) -> str:
    """All strings stripped and joined without a separator."""
    return "".join(s.strip() for s in node.strings())


@F.pandas_udf(StringType())
def raw_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: block_text(parse(h)))


_HEADS = StructType([StructField("h1", StringType()), StructField("title", StringType()), StructField("others", ArrayType(StringType())), StructField("category", StringType())])


@F.pandas_udf(_HEADS)
def _heads(html: pd.Series) -> pd.DataFrame:
    rows = []
    for h in html:
        h1 = title = category = crumbs = None
        others = []
        for node in parse(h).walk():
            if node.tag == "h1" and h1 is None:
                h1 = _bare(node)
            elif node.tag == "title" and title is None:
                title = "".join(node.strings()).strip()
            elif node.tag in ("h2", "h3", "h4"):
                others.append(_bare(node))
            if category is None and node.tag in ("span", "div", "p", "a"):
                text = _flat(node)
                if text.lower().startswith("category:"):
                    category = text.split(":", 1)[1].strip()
            if crumbs is None and {"breadcrumb", "breadcrumbs"} & set(node.attrs.get("class", "").split()):
                parts = [s.strip() for s in node.strings() if s.strip(" \t\r\n/»>|")]
                crumbs = parts[-2] if len(parts) >= 2 else None
        rows.append((h1, title, others, category or crumbs))
    return pd.DataFrame(rows, columns=["h1", "title", "others", "category"])


def drop_boilerplate(text: Column) -> Column:
    """Lines stripped; chrome lines, lines without a letter or digit and repeats of the last content line dropped; blank ones stay blank."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    state = F.struct(F.expr("cast(array() as array<string>)").alias("kept"), F.lit("").alias("last"))

    def step(acc: Column, line: Column) -> Column:
        low = F.lower(line)
        chrome = low.isin(BOILERPLATE_LINES + SITE_LINES) | ~line.rlike(r"(?U)[\p{L}\p{N}]")
        for prefix in BOILERPLATE_PREFIXES:
            chrome = chrome | low.startswith(prefix)
        keep = lambda value, last: F.struct(F.concat(acc["kept"], F.array(value)).alias("kept"), last.alias("last"))
        return F.when(line == "", keep(F.lit(""), acc["last"])).when(chrome | (low == acc["last"]), acc).otherwise(keep(line, low))

    return F.aggregate(lines, state, step, lambda acc: F.array_join(acc["kept"], "\n"))


def clean_html(html: Column) -> Column:
    text = F.replace(F.replace(raw_text(html), F.lit(" "), F.lit(" ")), F.lit("​"), F.lit(""))
    kept = drop_boilerplate(F.regexp_replace(text, r"[ \t]+", " "))
    return F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def _named(title: Column) -> Column:
    """The title, or null if it is empty or generic."""
    return F.when((title != "") & ~F.lower(F.trim(title)).isin(GENERIC_TITLES + SITE_TITLES), title)


def extract_title(html: Column) -> Column:
    """The first h1, else the title without the site's name, else the first long enough lower heading; none of them generic."""
    heads = _heads(html)
    title = F.trim(F.regexp_replace(heads["title"], r"(?i)\s*-\s*Help Desk.*$", ""))
    others = F.filter(heads["others"], lambda t: (F.char_length(t) > 3) & _named(t).isNotNull())
    return F.coalesce(_named(heads["h1"]), _named(title), F.try_element_at(others, F.lit(1)))


def extract_category(html: Column) -> Column:
    return _heads(html)["category"]


def _caption_of(img: Node, order: dict[int, int], blocks: list[Node]) -> str:
    block = img.above(["p", "li", "td", "div"])
    if block is None:
        return ""
    own = _flat(block)
    if 20 <= len(own) <= 400 and not TEMPLATE_NOISE.search(own):
        return own[:160].strip()
    for node in reversed(blocks):
        if order[id(node)] < order[id(block)] and len(text := _flat(node)) >= 20 and not TEMPLATE_NOISE.search(text):
            return text[:160].strip()
    return ""


def _context_of(img: Node, order: dict[int, int], blocks: list[Node]) -> str:
    """Two blocks before, else the block itself, else those after, until 400 characters."""
    block = img.above(["p", "li", "td", "div"])
    if block is None:
        return ""
    here = order[id(block)]
    parts: list[str] = []

    def full(node: Node) -> bool:
        text = _flat(node)
        if len(text) < 20 or TEMPLATE_NOISE.search(text) or text in parts:
            return False
        parts.append(text)
        return sum(map(len, parts)) >= 400

    before = [b for b in blocks if order[id(b)] < here][-2:]
    after = [b for b in blocks if order[id(b)] > here]
    any(full(node) for node in [*before, block, *after])
    return " ".join(parts)[:400].strip()


def page_images(html: str | None, base_url: str) -> list[dict[str, str]]:
    """src, alt, caption and context of a page's images, but for logos and what is no image."""
    root = parse(html)
    nodes = list(root.walk())
    order = {id(n): i for i, n in enumerate(nodes)}
    blocks = [n for n in nodes if n.tag in CAPTION_BLOCKS]
    base, out = base_url.rstrip("/"), []
    for img in nodes:
        src = img.attrs.get("src", "") if img.tag == "img" else ""
        inline = src.startswith("data:")
        if not src or inline and not src.startswith("data:image/"):
            continue
        if not inline:
            src = "https:" + src if src.startswith("//") else src if src.startswith("http") else f"{base}/{src.lstrip('/')}"
            if src.rsplit("/", 1)[-1].lower() in [*BOILERPLATE_IMAGES, *SITE_IMAGES]:
                continue
        alt = (img.attrs.get("alt") or img.attrs.get("title") or "").strip()
        figure = img.above(["figure"])
        captions = [_bare(n) for n in figure.walk() if n.tag == "figcaption"] if figure is not None else []
        out.append({"src": src, "alt": alt, "caption": (captions[0] if captions else "") or alt or _caption_of(img, order, blocks), "context": _context_of(img, order, blocks)})
    return out


def images(base_url: str):
    """A column function: array of (src, alt, caption, context)."""
    item = StructType([StructField(n, StringType()) for n in ("src", "alt", "caption", "context")])

    @F.pandas_udf(ArrayType(item))
    def extract(html: pd.Series) -> pd.Series:
        return html.map(lambda h: page_images(h, base_url))

    return extract


def embed_text(title: Column, caption: Column, alt: Column, context: Column, category: Column) -> Column:
    """What an image is found by: its distinct descriptions (first wins, case ignored), joined."""
    parts = F.filter(F.transform(F.array(title, caption, alt, context, category, F.lit("screenshot")), lambda p: F.trim(p)), lambda p: F.coalesce(p, F.lit("")) != "")
    first = F.aggregate(
        parts, F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when(F.exists(acc, lambda q: F.lower(q) == F.lower(p)), acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(first, " | ")


def image_records(pages: DataFrame, base_url: str) -> DataFrame:
    """image_id, src, article_id, title, category, caption, alt_text, context, keywords, embed_text of all images of pages (article_id, title, category, html)."""
    found = pages.select("article_id", "title", "category", F.explode(images(base_url)("html")).alias("i")).select("article_id", "title", "category", "i.*")
    caption = F.coalesce(F.nullif("caption", F.lit("")), F.nullif("title", F.lit("")), F.concat(F.lit("Image from article "), F.col("article_id").cast("string")))
    identity = F.when(F.col("src").startswith("data:"), inline_image_id(F.col("src"))).otherwise(image_id(F.col("src")))
    words = F.array_join(F.array_compact(F.array(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("article_id", "category", "title", "alt")])), ",")
    return found.select(
        identity.alias("image_id"), "src", "article_id", "title", "category", caption.alias("caption"), F.col("alt").alias("alt_text"), "context", words.alias("keywords"),
        embed_text(F.col("title"), F.col("caption"), F.col("alt"), F.col("context"), F.col("category")).alias("embed_text"),
    )


def image_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def inline_image_id(data: Column) -> Column:
    """Of a data address: the hash of the hash of its bytes."""
    return F.substring(F.sha2(F.sha2(F.unbase64(F.regexp_extract(data, r"^data:image/[^;,]+;base64,(.*)$", 1)), 256), 256), 1, 16)
