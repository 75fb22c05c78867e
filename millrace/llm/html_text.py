"""Main text of web pages by consensus host paths.

Pass 1 reads each page into a light tree, scores its containers by the text of their paragraphs and notes the path of
the best one, generalised to tags and classes without digits.  Spark adds up one vote per page and host; the path with
most votes wins its host.  Pass 2 reads each page again and takes the text of all containers of the winning path, or of the
page's own best one where the page has no such path, each widened to the article or main around it or else to the nearest
wrapper it shares with other text, so that short parts of an article stay.  Votes are combined before the shuffle, so a host with a third of all
pages is one row per task; pages meet the winners in a join by host (a broadcast while the winners' file is small).

Blocks are separated by a newline, white space inside a block is one space, references are decoded.  Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out by tag or by the first or last word of a
class or id.  Names that only qualify (no-sidebar, category-legal) do not count; an element with such a name is a plain
wrapper if an article or main in it has more than half of its text, and so is a form around the page's text.  Ids of
headings and paragraphs do not count, nor do ids of sections and the share of links inside an article, main or chosen
container: there they are slugs and sources, but for the ids of comment sections.  Of headers inside the article headings stay.

Defined cases: null or empty html gives an empty text; a page without container text falls back to its body; null urls
share the empty host; unclosed tags and comments end with the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import annotate, staged, text_slices

# HTML element names by their part in a page.
CONTAINERS = frozenset(["article", "main", "section", "div", "td", "body"])
PARAGRAPHS = frozenset(["p", "pre", "blockquote", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
BLOCKS = CONTAINERS | PARAGRAPHS | frozenset(
    ["ul", "ol", "dl", "table", "tr", "th", "thead", "tbody", "tfoot", "caption", "figure", "figcaption", "hr", "br", "address",
     "details", "summary", "header", "footer", "nav", "aside", "form", "fieldset", "html", "head", "hgroup", "center", "dialog", "menu", "search"]
)
DROPPED = frozenset(["nav", "header", "footer", "aside", "form", "button", "select", "option", "input", "label", "menu", "dialog", "head", "search"])
RAW = frozenset(["script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes", "video", "audio"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
NOISE = frozenset(
    ["ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation",
     "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "related", "recommended", "share",
     "sharing", "social", "comment", "comments", "respond", "disqus", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
     "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "form", "search", "pagination", "pager",
     "toc", "skip", "toolbar", "copyright", "legal", "disclaimer", "tags"]
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# Names that say where readers write.
COMMENTS = frozenset(["comment", "comments", "respond", "disqus"])
COMMENT_IDS = frozenset(["comments", "respond", "disqus_thread", "comment-list", "comments-list", "comments-area", "reader-comments"])
QUALIFIERS = frozenset(["no", "has", "with", "without", "category", "tag", "format", "type", "status", "is", "js"])

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
_TAG_STEP = re.compile(r"""=\s*(["'])|>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    path: str
    parent: Node | None
    mark: int = 0  # 1: noise by a name or form tag, 2: noise for certain
    noise: bool = False
    slug: str = ""  # the id of a section
    header: bool = False
    aside: bool = False  # in a section with a noise id: left out unless it is inside the chosen container
    inside: bool = False  # in the chosen container, where ids of sections are slugs and lists of links are content
    parts: list = field(default_factory=list)  # texts and child nodes in page order
    own: float = 0.0
    links: float = 0.0
    score: float = 0.0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def _mark(tag: str, attributes: dict[str, str]) -> int:
    if tag in DROPPED:
        return 1 if tag == "form" else 2
    if not attributes or tag in ("html", "body", "article", "main"):
        words = attributes.get("class", "").lower().split() if tag == "article" else []
        return 2 if "hidden" in attributes or any(w.startswith("comment") for w in words) else 0
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return 2
    if attributes.get("role", "") in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"):
        return 2
    words = _noise_words(attributes.get("class", ""))
    if tag not in PARAGRAPHS:
        slug = attributes.get("id", "")
        if slug.lower() in COMMENT_IDS:
            return 2
        if tag != "section":  # its id is often the slug of a heading
            words |= _noise_words(slug)
    return 2 if words & COMMENTS else 1 if words else 0


def _noise_words(names: str) -> set[str]:
    """Noise words that open or close a name; those that only qualify say nothing of the element."""
    found: set[str] = set()
    for name in names.split():
        parts = [p.lower() for p in _NAME_PART.findall(name)]
        if parts and parts[0] not in QUALIFIERS:
            found |= {parts[0], parts[-1]} & NOISE
    return found


def _step(tag: str, attributes: dict[str, str]) -> str:
    """The tag with its classes, without digits; an id counts where there is no class."""
    names = attributes.get("class") or attributes.get("id") or ""
    kept = sorted({re.sub(r"[\d_-]+", "", n.lower()) for n in names.split()} - {""})
    return ".".join([tag, *kept])


class _Tags:
    """Finds the end of a tag: the next ``>`` outside quoted values.

    If there is none the first ``>`` ends the tag, here and for the rest of the page, so that no page is read over and over.
    """

    def __init__(self, source: str) -> None:
        self.source, self.plain = source, False
        self.last = source.rfind(">")
        self.closed = {q: source.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """Position of the ``>``; -1 if the page has no more."""
        if at > self.last:
            return -1
        here = at
        while not self.plain:
            step = _TAG_STEP.search(self.source, here)
            if step is None:
                self.plain = True
                break
            quote, here = step[1], step.end()
            if quote is None:
                return step.start()
            if self.closed[quote] >= here:
                here = self.source.find(quote, here) + 1
        return self.source.find(">", at)


def read_page(source: str) -> Node:
    """A tree of block elements; inline tags only matter for link text."""
    root = Node("html", "", None)
    node, link, at, size = root, 0, 0, len(source)
    tags, raw_ends = _Tags(source), {}
    while at < size:
        match = _TAG.search(source, at)
        if not match:
            _add_text(node, source[at:], link)
            break
        comment, declaration, closing, name = match.groups()
        start, inner = match.start(), match.end()
        if name:
            end = tags.end(inner)
            if end < 0:
                _add_text(node, source[at:], link)
                break
        if start > at:
            _add_text(node, source[at:start], link)
        if comment or declaration:
            end = source.find("-->" if comment else ">", inner)
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        raw, at = source[inner:end], end + 1
        tag = name.lower()
        if tag == "a":
            link = 0 if closing else 1
        elif tag in RAW:
            if not closing and not raw.endswith("/"):
                found = None
                if tag not in raw_ends:
                    raw_ends[tag] = source.lower().rfind(f"</{tag}")
                if at <= raw_ends[tag]:
                    found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(source, at)
                at = found.end() if found else size
        elif tag in BLOCKS or tag in DROPPED:
            if closing:
                node = _close(node, tag)
            elif tag in ("br", "hr"):
                node.parts.append(None)
            elif tag in VOID:
                continue
            else:
                node, link = _open(node, tag, _attributes(raw)), 0
    _settle(root)
    return root


def _settle(root: Node) -> None:
    """Decide which marked elements are noise, from the text they hold, and pass that on to what is inside them."""
    nodes = list(_walk(root))
    sure = {id(root): False}  # certain noise
    marked = {id(root): False}  # inside any marked element
    for n in nodes[1:]:
        sure[id(n)] = sure[id(n.parent)] or n.mark == 2
        marked[id(n)] = marked[id(n.parent)] or n.mark > 0
    mass = {id(n): 0 if sure[id(n)] or 2 * n.links > n.own else n.own for n in nodes}
    # Text outside all marks.
    clean = sum(mass[id(n)] for n in nodes if not marked[id(n)])
    bare = dict(mass)  # text of all descendants but that of marked elements inside
    article: dict[int, float] = {}  # the most text of one article or main inside
    divided: set[int] = set()  # holds a container
    for n in reversed(nodes):
        above = id(n.parent)
        if n.parent is None:
            continue
        bare[above] += 0 if n.mark else bare[id(n)]
        article[above] = max(article.get(above, 0), article.get(id(n), 0), bare[id(n)] if n.tag in ("article", "main") else 0)
        if n.tag in CONTAINERS or id(n) in divided:
            divided.add(above)
    for n in nodes:
        wrapper = n.mark == 1 and 2 * article.get(id(n), 0) > bare[id(n)]
        wrapper = wrapper or (n.mark == 1 and n.tag == "form" and id(n) in divided and bare[id(n)] > 9 * clean)
        n.noise = (n.parent is not None and n.parent.noise) or (n.mark > 0 and not wrapper)
        n.inside = (n.parent is not None and n.parent.inside) or (n.tag in ("article", "main") and not n.noise)
        n.aside = (n.parent is not None and n.parent.aside) or (n.tag == "section" and not n.inside and bool(_noise_words(n.slug)))


def _open(node: Node, tag: str, attributes: dict[str, str]) -> Node:
    if tag == "html":
        return node
    if node.tag == "p" or (node.tag == "head" and tag != "head"):
        node = node.parent  # a block ends an open paragraph
    if node.tag in _CLOSES.get(tag, ()):
        node = node.parent
        if tag == "tr" and node.tag == "tr":
            node = node.parent
    child = Node(tag, f"{node.path}>{_step(tag, attributes)}", node, _mark(tag, attributes), slug=attributes.get("id", ""))
    child.header = tag == "header" or bool(_noise_words(attributes.get("class", "")) & {"header"})
    node.parts.append(child)
    return child


def _close(node: Node, tag: str) -> Node:
    at = node
    while at is not None and at.tag != tag:
        at = at.parent
    return node if at is None or at.parent is None else at.parent


def _add_text(node: Node, text: str, link: int) -> None:
    node.parts.append(text)
    length = len(text.strip())
    if length:
        node.own += length
        node.links += link * length


def _rate(node: Node) -> None:
    """Paragraph text counts for its container, half for the next one; page order recursion without the stack."""
    todo = [node]
    while todo:
        current = todo.pop()
        todo += [p for p in current.parts if isinstance(p, Node)]
        if current.noise or current.aside or not current.own or 2 * current.links > current.own:
            continue
        above = current if current.tag in CONTAINERS else current.parent
        share = current.own
        for _ in range(2):
            while above is not None and above.tag not in CONTAINERS:
                above = above.parent
            if above is None:
                break
            above.score += share
            share, above = share / 2, above.parent


_BONUS = {"article": 1.6, "main": 1.3, "body": 0.7}


def _walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [p for p in reversed(node.parts) if isinstance(p, Node)]


def best_container(root: Node) -> Node | None:
    _rate(root)
    best = None
    for node in _walk(root):
        if node.tag in CONTAINERS and not node.noise and not node.aside:
            node.score *= _BONUS.get(node.tag, 1.0)
            if node.score > 0 and (best is None or node.score > best.score):
                best = node
    return best


def container_text(container: Node) -> str:
    """Blocks in page order, one per line."""
    blocks: list[str] = []
    line: list[str] = []

    def end_line() -> None:
        if line:
            words = html.unescape("".join(line)).split()
            if words:
                blocks.append(" ".join(words))
            line.clear()

    todo: list = [container]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            line.append(part)
        elif part is None:
            end_line()
        else:
            if part is not container:
                end_line()
                if part.noise and not (part.header and not container.noise):
                    continue
                if part.noise:  # of a header inside the article only headings belong to it
                    todo += [p for p in reversed([n for n in _walk(part) if n.tag in HEADINGS]) if _unnoise(p)]
                    continue
                if not part.inside and (part.aside or part.tag in ("ul", "ol", "div") and _only_links(part)):
                    continue
            todo.append(None)
            todo += reversed(part.parts)
    end_line()
    return "\n".join(blocks)


def _unnoise(node: Node) -> bool:
    node.noise = False
    return True


def _only_links(node: Node) -> bool:
    nodes = list(_walk(node))
    links, own = sum(n.links for n in nodes), sum(n.own for n in nodes)
    return len(nodes) > 3 and own > 0 and links >= 0.9 * own


def page_choice(source: str) -> tuple[str, float]:
    best = best_container(read_page(source))
    return (best.path, best.score) if best else ("", 0.0)


def page_text(source: str, path: str | None) -> str:
    """Text around the containers at ``path``, else around those at the path of the best container."""
    root = read_page(source)
    best = best_container(root)
    for wanted in (path, best.path if best else ""):
        found = [n for n in _walk(root) if n.path == wanted and not n.noise and not n.aside] if wanted else []
        if any(n.score > 0 for n in found):
            for node in (part for n in found for part in _walk(n)):
                node.inside = True
            whole = {id(w): w for w in map(_widened, found)}
            return "\n".join(t for n in whole.values() if not _within(n.parent, whole) and (t := container_text(n)))
    return container_text(next((n for n in _walk(root) if n.tag == "body"), root))


def _within(node: Node | None, picked: dict[int, Node]) -> bool:
    while node is not None and id(node) not in picked:
        node = node.parent
    return node is not None


def _widened(node: Node) -> Node:
    """The nearest article or main around the container, else the nearest wrapper below the body that adds something."""
    at = node
    while at is not None:
        if at.tag in ("article", "main"):
            return at
        at = at.parent
    while (above := node.parent) is not None and above.tag in CONTAINERS and above.tag != "body":
        rest = (p for p in above.parts if p is not node)
        if any(p.strip() if isinstance(p, str) else p is not None and not p.noise and not p.aside and container_text(p) for p in rest):
            return above
        node = above
    return node


def host_of(column):
    return F.coalesce(F.lower(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_slices(batch, "html"):
            choices = [page_choice(t) for t in texts.to_pylist()]
            yield pa.record_batch([rows.column("host"), pa.array([c[0] for c in choices]), pa.array([c[1] for c in choices], pa.float64())], names=["host", "path", "score"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the container path with most votes of the host's pages."""
    ballots = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, score double")
    votes = ballots.filter("path <> ''").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("score").cast("long")).alias("score"))
    rank = F.struct("votes", "score", "path")
    return votes.groupBy("host").agg(F.max(rank).alias("top")).select("host", F.col("top.path").alias("path"))


def extract_pages(pages: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """``pages`` (url, html, ...) with text; ``paths`` as of :func:`host_paths`, computed here if not given."""
    winners = staged(host_paths(pages)) if paths is None else paths
    joined = pages.withColumn("_host", host_of(F.col("url"))).join(winners.select(F.col("host").alias("_host"), F.col("path").alias("_path")), "_host", "left")
    # The path travels in front of the page, split off inside the task.
    packed = joined.withColumn("_page", F.concat(F.coalesce("_path", F.lit("")), F.lit("\x00"), F.coalesce("html", F.lit("")))).drop("_host", "_path")

    def make():
        def one(packed_page: str) -> str:
            path, _, source = packed_page.partition("\x00")
            return page_text(source, path)

        return lambda texts: [[one(t) for t in texts.to_pylist()]]

    return annotate(packed, make, "text string", "_page").drop("_page")


def page_digest(pages: DataFrame) -> DataFrame:
    found = extract_pages(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
