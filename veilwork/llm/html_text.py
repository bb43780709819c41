"""Operator 10, HTML extraction: paragraphs score their ancestors, the best container and its siblings are the text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names, and the words of classes and ids that mark what isn't article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text to read.
DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video select option textarea head title".split())
#: Controls, but words where they stand in a paragraph.
CONTROLS = frozenset(["button", "label"])
MARKED = frozenset("nav footer aside form dialog menu".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody "
    "tfoot tr td th figure figcaption address header hgroup details summary fieldset hr center nav footer aside form dialog menu".split()
)
CLOSES_P = BLOCKS - frozenset("html body caption thead tbody tfoot tr td th li dt dd".split())
#: Elements that an opening tag of their kind ends, and inside of what they are no longer in reach.
REACH = {
    "p": frozenset("td th li table button".split()), "li": frozenset("ul ol".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
    "tr": frozenset(["table"]), "td": frozenset("tr table".split()), "th": frozenset("tr table".split()), "option": frozenset(["select"]),
}
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = frozenset().union(*REACH.values())
PARAGRAPHS = frozenset("p pre td blockquote li h1 h2 h3 h4 h5 h6 dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main".split())
LISTS = frozenset("ul ol dl div section table figure".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of a class or id that speak for something other than the article, and how strongly; stems stand for all words that begin so.
EVIDENCE = {
    "ad": 2, "ads": 2, "adv": 2, "nav": 2, "pager": 2, "social": 2, "related": 2, "search": 2, "skip": 2, "hidden": 2, "notice": 2,
    "notices": 2, "alert": 2, "alerts": 2, "modal": 2, "login": 2, "form": 1, "header": 1,
}
STEMS = tuple(
    "advert adsense sponsor promo banner cookie consent gdpr notific popup overlay newsletter subscri signup signin sidebar widget menu "
    "navbar navig breadcrumb paginat footer masthead toolbar share sharing recommend dropdown taboola outbrain".split()
)
COMMENTS = ("comment", "disqus")
ANSWERS = frozenset("respond reply replies".split())
#: Parts that speak for the article, and parts that say what a page has, not what an element is.
ARTICLE = frozenset("article articles content body main entry post posts text story".split())
STATES = frozenset("has with no without is enabled open closed on off".split())
COMMENT_HEADING = re.compile(
    r"(?:\d+\s+)?(?:(?:reader|user|visitor)\S*\s+)?(?:comments?|kommentare|commentaires|comentarios)\s*[:(\[]?\s*\d*\s*[)\]]?"
    r"|\d+\s+(?:replies|responses)|(?:replies|responses)\s*[(\[]\s*\d+\s*[)\]]"
    r"|(?:leave|post|add|write) a (?:comment|reply)|(?:join|add to) the (?:discussion|conversation)",
    re.I,
)
#: Headings that can be the article's own: what follows must look like comments.
MAYBE_HEADING = re.compile(r"(?:(?:reader|user|visitor)\S*\s+)?(?:replies|responses|reactions|discussion)\s*:?", re.I)
#: Short parts of a comment: who wrote or can answer, and when.
SAYS = re.compile(r"\b(?:says?|said|wrote|writes|replied|reply|schrieb|sagt|antworten|r[ée]pondre|dijo|responder)\b", re.I)
WHEN = re.compile(r"\b\d{1,2}[:.]\d{2}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d+ (?:minutes?|hours?|days?|weeks?|months?|years?) ago\b|\b(?:jan|feb|m[aä]r|apr|ma[yi]|jun|jul|aug|sep|o[ck]t|nov|de[cz])\w*\.? \d{1,2}\b|\b\d{1,2}\.? (?:jan|feb|m[aä]r|apr|ma[yi]|jun|jul|aug|sep|o[ck]t|nov|de[cz])", re.I)
#: The longest such part, and the elements of a comment that are looked at.
SHORT, LOOKED_AT = 60, 24
COMMA = re.compile("[,،、，;；]")
#: What a marked element's points count for, outside and in it, by the strength of the evidence.
DAMPED = (1.0, 0.1, 0.01)
WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = (
        "tag", "parent", "kids", "before", "drop", "mark", "weight", "shade", "by_class", "like", "near", "inside", "para", "head", "title", "kept", "titled", "text", "links",
        "n_links", "commas", "score", "direct", "direct_commas", "block", "link", "own", "own_links", "own_commas",
    )

    def __init__(self, tag: str, parent: Node | None, drop: bool = False):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.mark, self.weight, self.shade, self.by_class, self.like = "", 1.0, 1.0, False, ""
        self.kids: list[Node | str] = []
        self.near: dict[str, Node] = {}
        self.inside = self.para = self.kept = self.titled = self.link = False
        self.head: Node | None = None
        self.block: Node | None = None
        self.before: Node | None = None
        self.title = ""
        self.text = self.links = self.n_links = self.commas = self.direct = self.direct_commas = self.own = self.own_links = self.own_commas = 0
        self.score = 0.0


def _evidence(word: str) -> tuple[str, int]:
    """What one class or id speaks for (comment, header, layout) and how strongly: its parts' evidence less 1 for parts of the article's."""
    parts = [x.lower() for x in WORDS.findall(word)]
    if not STATES.isdisjoint(parts):
        return "", 0
    kind, total = "", 0
    for x in parts:
        if x.startswith(COMMENTS) or x in ANSWERS:
            kind, total = "comment", total + 2
        elif n := EVIDENCE.get(x, 2 * x.startswith(STEMS)):
            kind, total = kind or ("header" if x == "header" else "layout"), total + n
            if x != "header" and kind == "header":
                kind = "layout"
    return kind, total - (not ARTICLE.isdisjoint(parts))


def _mark(node: Node, attrs: list[tuple[str, str | None]]) -> None:
    """Sets a node's mark and weight: by its element and role, or by the strongest evidence of its classes and id.

    Strong evidence of comments is taken as certain; weaker one damps like that of layout, so that an element which holds
    most of the text stays the text.
    """
    if node.tag in MARKED:
        node.mark, node.weight = "layout", DAMPED[1]
    if node.tag in CONTENT:
        return
    for name, value in attrs:
        value = value or ""
        if name in ("class", "id"):
            node.like += f" {value}" if name == "class" else ""
            for word in value.split():
                kind, strength = _evidence(word)
                if strength < 1:
                    continue
                weight = 0.0 if kind == "comment" and strength > 1 else DAMPED[2 if kind == "comment" else min(strength, 2)]
                if weight < node.weight:
                    node.mark, node.weight = "comment" if not weight else kind if kind == "header" else "layout", weight
                    node.by_class = node.tag not in MARKED
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            node.mark, node.weight, node.by_class = node.mark or "layout", min(node.weight, DAMPED[1]), False
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            node.mark, node.weight, node.by_class = node.mark or "layout", min(node.weight, DAMPED[1]), False


class Tree(HTMLParser):
    """Lenient tree of a page; ``nodes`` has parents before their children. Every tag costs the same, however deep it lies."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.nodes, self.open = [self.root], Counter()
        self.feed(html)
        self.close()

    def _leave(self, node: Node) -> None:
        """Close ``node`` and all that is open in it."""
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P and (p := self.at.near.get("p")):
            self._leave(p)
        for ended in ENDS.get(tag, ()):
            if other := self.at.near.get(ended):
                self._leave(other)
        up = self.at
        node = Node(tag, up, up.drop or tag in DROPPED or tag in CONTROLS and not up.para)
        _mark(node, attrs)
        node.inside, node.para = up.inside or tag in CONTENT, up.para or tag in PARAGRAPHS
        if tag == "header" and not up.inside and not node.mark:
            node.mark, node.weight = "layout", DAMPED[1]
        node.head = node if node.mark == "header" else up.head
        up.kids.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            node.near = up.near
            if tag in LIMITS:
                node.near = {k: v for k, v in node.near.items() if tag not in REACH[k]}
            if tag in REACH:
                node.near = {**node.near, tag: node}
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag] > 0:
            node = self.at
            while node.tag != tag:
                node = node.parent
            self._leave(node)

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def _line(text: str) -> str:
    """A text with single spaces, and none around it."""
    return " ".join(text.split())


def _weigh_titles(tree: Tree) -> None:
    """Notes the headings' titles, and takes marks back where they say so.

    What a class marks isn't layout or comments if it holds the page's title or main element. A header in an article is
    kept if it holds a heading that no other heading of the page repeats.
    """
    everywhere: Counter[str] = Counter()
    own: dict[Node, Counter[str]] = {}
    for n in reversed(tree.nodes):
        n.titled = n.titled or n.tag in ("h1", "main")
        if n.titled and n.by_class and n.mark != "header":
            n.mark, n.weight = "", 1.0
        if n.titled and n.parent is not None:
            n.parent.titled = True
        if n.tag in HEADINGS and not n.drop and 0 < n.text:
            n.title = _line("".join(_texts(n)))
            everywhere[n.title] += 1
            if n.head is not None:
                own.setdefault(n.head, Counter())[n.title] += 1
    for n in reversed(tree.nodes):
        if n.mark != "header":
            continue
        n.kept = n.inside and (n.kept or any(k == everywhere[t] for t, k in own.get(n, Counter()).items()))
        if n.kept and n.parent.head is not None:
            n.parent.head.kept = True


def _byline(item: Node) -> tuple[bool, bool]:
    """Whether one of the first short parts of an element says who wrote, or when."""
    says = when = False
    stack, seen = [k for k in reversed(item.kids) if not isinstance(k, str)], 0
    while stack and seen < LOOKED_AT:
        n, seen = stack.pop(), seen + 1
        if n.drop and n.tag not in CONTROLS:
            continue
        if n.tag == "time":
            when = True
        if 0 < n.text <= SHORT:
            text = "".join(_texts(n))
            says, when = says or bool(SAYS.search(text)), when or bool(WHEN.search(text))
        else:
            stack.extend(k for k in reversed(n.kids) if not isinstance(k, str))
    return says, when


def _discussions(tree: Tree) -> None:
    """Marks comments by their structure: two or more siblings alike, in a row, each with a short part that says who and one that says when."""

    def judged(run: list[Node]) -> None:
        if len(run) > 1 and all(all(_byline(k)) for k in run):
            for k in run:
                k.mark, k.weight = "comment", 0.0

    for n in tree.nodes:
        if n.drop or n.weight == 0.0:
            continue
        elements = [k for k in n.kids if not isinstance(k, str)]
        if len(elements) < 2:
            continue
        run: list[Node] = []
        for k in elements:
            # only an element that has elements can have a byline
            if k.text and not k.drop and any(not isinstance(x, str) for x in k.kids):
                if run and (run[0].tag, run[0].like) != (k.tag, k.like):
                    judged(run)
                    run = []
                run.append(k)
            else:
                judged(run)
                run = []
        judged(run)


def _comments(tree: Tree) -> None:
    """Marks what a heading says to be reader comments: the container that it opens, else what follows up to the next such heading.

    Where the heading can be one of the article's own, what follows must have a comment's short parts, who and when.
    """
    for n in tree.nodes:
        if n.drop or n.mark or n.tag not in ("h2", "h3", "h4", "h5", "h6"):
            continue
        sure = COMMENT_HEADING.fullmatch(n.title)
        if not sure and not MAYBE_HEADING.fullmatch(n.title):
            continue
        top = n
        while (up := top.parent) is not None and up is not tree.root and up.tag not in CONTENT and not _before(up, top):
            if up.text > top.text:
                if sure or any(any(_byline(k)) for k in up.kids if not isinstance(k, str) and k is not top):
                    up.mark, up.weight = "comment", 0.0
                break
            top = up
        else:
            if up is None:
                continue
            first, last = up.kids.index(top), len(up.kids)
            for i in range(first + 1, last):
                k = up.kids[i]
                if not isinstance(k, str) and k.tag in HEADINGS and k.tag <= n.tag:
                    last = i
                    break
            if not sure and not any(any(_byline(k)) for k in up.kids[first + 1 : last] if not isinstance(k, str)):
                continue
            for i in range(first, last):
                if isinstance(k := up.kids[i], str):
                    up.direct -= len(_line(k))
                    up.direct_commas -= len(COMMA.findall(k))
                    up.kids[i] = Node("span", up)
                    up.kids[i].kids = [k]
                up.kids[i].mark, up.kids[i].weight = "comment", 0.0


def _before(up: Node, top: Node) -> bool:
    """Whether text stands before ``top`` in its parent."""
    for k in up.kids:
        if k is top:
            return False
        if (k.strip() if isinstance(k, str) else k.text):
            return True
    return False


def _texts(node: Node) -> Iterator[str]:
    """Text below a node in page order, without what is dropped."""
    stack = [node]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            yield k
        elif not k.drop:
            stack.extend(reversed(k.kids))


def _measure(tree: Tree) -> None:
    """Sums text, link text and commas of each element from the leaves up, and notes the last sibling with text before it.

    Each piece of text is measured once: what an element has directly is noted for the sums of blocks.
    """
    for n in reversed(tree.nodes):
        if n.drop:
            continue
        before = None
        for k in n.kids:
            if not isinstance(k, str):
                k.before = before
                if k.text and not k.drop:
                    before = k
            elif size := len(_line(k)):
                n.direct += size
                n.direct_commas += len(COMMA.findall(k))
        n.text += n.direct
        n.commas += n.direct_commas
        if n.tag == "a":
            n.links, n.n_links = n.text, n.n_links + 1
        if n.parent is not None:
            n.parent.text += n.text
            n.parent.links += n.links
            n.parent.n_links += n.n_links
            n.parent.commas += n.commas


def _own(tree: Tree) -> set[Node]:
    """Sums a block's own text, direct or in inline elements; the blocks (or the root) that have some outside paragraphs."""
    out = set()
    for n in tree.nodes:
        up = n.parent
        n.block = n if up is None or n.tag in BLOCKS else up.block
        n.link = n.tag == "a" or up is not None and up.link
        if n.direct and not n.drop:
            n.block.own += n.direct
            n.block.own_links += n.direct * n.link
            n.block.own_commas += n.direct_commas
            if not n.para:
                out.add(n.block)
    return out


def points(size: int, commas: int, links: int) -> float:
    """A paragraph's points: 1, its commas, and its length in hundreds up to 3, less the share of link text."""
    return (1 + commas + min(size / 100, 3)) * (1 - links / size)


def _score(tree: Tree) -> None:
    """A paragraph's points go to its parent, half of them to the next, a quarter to the one above, and so on up the tree.

    Text that lies in no paragraph makes one of its nearest block or of the page, which then has the points itself. An
    element's sum is discounted by its share of link text. What a marked element has counts for its weight, in it and above.
    """
    loose = _own(tree)
    for n in reversed(tree.nodes):
        if n.drop or not n.text:
            continue
        given = 0.0  # to the parent in full
        if n.tag in PARAGRAPHS:
            given = points(n.text, n.commas, n.links)
        elif n.direct and n.tag in ("div", "section", "article", "main"):
            n.score += points(n.text, n.commas, n.links)
        elif n in loose:
            n.score += points(n.own, n.own_commas, n.own_links)
        if n.parent is not None:
            n.parent.score += n.weight * (given + n.score / 2)
        n.score *= n.weight * (1 - n.links / n.text)
    # a marked element's points are damped for all that it holds, by the strongest mark around it
    for n in tree.nodes:
        if n.parent is not None:
            n.shade = min(n.parent.shade, n.parent.weight)
            n.score *= n.shade


def _link_list(n: Node) -> bool:
    """Whether an element is a list of links outside an article, and not one that a paragraph introduces."""
    if n.inside or n.tag not in LISTS or n.n_links < 2 or n.links <= 0.6 * n.text:
        return False
    before = n.before
    return not (before is not None and before.tag in ("p", "blockquote") and before.links < 0.5 * before.text)


def _left_out(k: Node, enough: float, lists: bool) -> bool:
    """Whether an element isn't part of the text: reader comments, marked ones that don't hold most of the points, lists of links."""
    if k.drop or k.mark == "comment":
        return True
    return bool(k.mark) and not k.kept and k.score < enough or not lists and _link_list(k)


def _blocks(node: Node, enough: float, lists: bool = False) -> list[str]:
    """Each block's text with single spaces, in page order; lists of links only if asked for."""
    out, parts = [], []

    def end() -> None:
        if line := _line("".join(parts)):
            out.append(line)
        parts.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        k = stack.pop()
        if k is None:
            end()
        elif isinstance(k, str):
            parts.append(k)
        elif k.tag == "br":
            parts.append(" ")
        elif k is node or not _left_out(k, enough, lists):
            block = k.tag in BLOCKS
            if block:
                end()
                stack.append(None)
            stack.extend(reversed(k.kids))
    end()
    return out


def _with_siblings(best: Node, enough: float) -> list[Node]:
    """The best container and the siblings that belong to it, in page order; runs of loose text are containers of their own.

    Inside an article, what stands beside the container's own parents belongs to it too.
    """
    chosen, top = [best], best
    while (up := top.parent) is not None:
        first, last, run, after = [], [], None, False
        inside = up.inside
        loose = best.tag not in CONTENT and up.own_links < 0.25 * up.own
        for k in up.kids:
            if k is top:
                after, run = True, None
                continue
            if loose and (isinstance(k, str) or k.tag not in BLOCKS and not k.score and not _left_out(k, enough, False)):
                if run is None:
                    (last if after else first).append(run := Node("div", None))
                run.kids.append(k)
                continue
            if isinstance(k, Node) and k.tag in BLOCKS:
                run = None
            if isinstance(k, Node) and not _left_out(k, enough, False) and _joins(k, best, inside):
                (last if after else first).append(k)
                run = None
        chosen, top = [*first, *chosen, *last], up
        if not inside:
            break
    return chosen


def _joins(k: Node, best: Node, inside: bool) -> bool:
    """Whether a sibling is part of the text: few links, and in one article with the container, a paragraph, or enough points itself."""
    if not k.text or k.links >= 0.25 * k.text and not (inside and k.tag in PARAGRAPHS):
        return False
    if inside:
        return True
    if k.tag in PARAGRAPHS:
        return best.tag not in CONTENT
    return k.score >= max(10.0, 0.2 * best.score) and (best.tag not in CONTENT or k.tag == best.tag)


def _unmarked(tree: Tree) -> int:
    return tree.root.text - sum(n.text for n in tree.nodes if n.mark and n.shade == 1.0 and not n.drop)


def main_text(html: str) -> str:
    """The main text of one page.

    Where no container has points, as all text is links, or only a marked one that has less text than there is outside
    marked ones, it is all that isn't dropped or marked.
    """
    tree = Tree(html)
    _measure(tree)
    _weigh_titles(tree)
    _discussions(tree)
    _comments(tree)
    _score(tree)
    best = max((n for n in tree.nodes if not n.drop and n.mark != "comment" and n.text), key=lambda n: n.score, default=None)
    if best is None or best.score <= 0 or (best.mark or best.shade < 1) and best.text < _unmarked(tree):
        return "\n".join(_blocks(tree.root, 1.0, lists=True))
    enough = 0.5 * best.score
    return "\n".join(line for n in _with_siblings(best, enough) for line in _blocks(n, enough))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, ``text`` (blocks joined by line breaks; empty if none) and ``n_chars`` (code points).

    The whole html is parsed; a null one is empty. Paragraphs pass points to their ancestors, discounted by link density;
    the best container with the siblings that belong to it is the text. Menus, headers, footers, sidebars, notices,
    adverts and forms, known by element, role or the parts of a class, weigh the less the stronger the evidence, and are
    left out where they don't hold most of the points; scripts, styles and reader comments, known by class, heading or
    structure, always are. Every page is judged by itself
    in one pass without a shuffle, in time that grows with its length, however deep its elements lie; repeated rows stay,
    other columns are ignored, an empty table gives an empty result.
    """
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py() or "") for h in b.column(2)]
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("a"), F.col(url_col).alias("b"), F.col(html_col).alias("c"))
    return rows.mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint")
