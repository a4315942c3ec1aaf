"""Main text of web pages by composite text density.

A page is parsed into a DOM with HTML's implied end tags. Nodes that are boilerplate by element,
role, class or id are cut; in the text, ambiguous names only if what they hold confirms it. Each
other node gets its characters per tag, adjusted by its links, and the sum of its children's
densities. The node with the largest sum is the seed, and the smallest density on its path to the
body is the threshold. What stands beside the path goes unless it reaches the threshold or belongs
to the text: bare text, what shares an article element with the seed, paragraphs and headed sections
that aren't mostly links, and headings of what is kept.

Defined results: a null or empty page has an empty text; pages without body tags, with unclosed
tags or stray end tags are read as browsers do; white space inside a block becomes one space, <br>
included; repeated rows each get a row; other columns are kept. Of nodes with equal sums the
outermost and first is the seed. Very deep and very long pages are read whole, without recursion.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td template tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd blockquote pre table figcaption".split())
CLOSES_P = BLOCK - frozenset("body head html td th tr tbody thead tfoot option optgroup legend title template".split())
#: An end tag that is implied: a start tag of the key closes an open one of the values, within the scope.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "optgroup"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
SCOPE = frozenset("html body table td th caption article section main div template button object".split())

#: Elements that never hold main text.
CUT_ELEMENTS = frozenset("head script style noscript template nav footer aside form button select input textarea iframe object embed svg canvas audio video dialog menu title xmp noembed noframes datalist map".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
_CUT_WORD = re.compile(
    r"(?:ads?|adv|advert\w*|adsense|dfp|\w*banner|sponsor\w*|promo\w*|comments?|commentlist|\w+comments?|discussion|disqus|replies|reply|respond|responses|\w*sidebar\w*|side|rail|nav|navs|navbar|navigation|menus?|breadcrumbs?|header|masthead|footer|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|paywall|share|sharing|social|related|recommend\w*|widgets?|toolbar|pager|pagination|skip|login|search|copyright|disclaimer|outbrain|taboola|feedback|ratings?|toc)\Z"
)
#: Of those, words that name ordinary parts of a text as well, and names that nothing else bears.
_AMBIGUOUS = re.compile(r"(?:discussion|replies|reply|respond|responses|side|rail|notices?|alerts?|share|sharing|social|related|recommend\w*|skip|search|copyright|disclaimer|feedback|ratings?)\Z")
_VENDOR = re.compile(r"(?:adsense|dfp|commentlist|disqus|gdpr|outbrain|taboola)\Z")
#: Words that a boilerplate name may hold besides; with any other word it names something else.
_NEUTRAL = re.compile(
    r"(?:\d+|[a-z]|the|of|and|to|us|this|site|page|web|main|primary|secondary|global|local|top|bottom|left|right|middle|mid|upper|lower|col|column|list|lists|links?|items?|buttons?|btns?|bar|bars|box|boxes|blocks?|wrap|wrapper|container|inner|outer|holder|section|area|panel|pane|zone|slots?|unit|units|row|grid|group|entry|entries|posts?|articles?|stories|story|content|body|text|form|field|icons?|title|heading|label|message|messages|msg|info|user|users|reader|readers|thread|threads|tree|view|views|count|counts|load|lazy|mobile|desktop|sticky|fixed|small|large|mini|wide|full|js|ui|module|component|region|policy|more|you|may|like|also|next|prev|previous|old|new|latest|popular|default|style|ar|type|media|network|google|gpt|square|leaderboard|skyscraper|in|on|by|leave|trail|center|drop|down|dropdown|toggle|hidden|visible|print|no)\Z"
)
#: Characters of text that a class of an ambiguous name needs to count as part of the article.
PROSE_CHARS = 80
_NOT_OWN = re.compile(r"(?:has|with|no|without|is)\Z")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden|aria-label)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: A heading that opens reader comments.
_COMMENTS = re.compile(r"(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|responses|replies)(?:\s*\(?\d+\)?)?:?\Z|leave a (?:reply|comment)\Z", re.I)
#: What stands in small print beside an article.
_SMALL_PRINT = re.compile(r"\u00a9|\(c\)|copyright|all rights reserved|\bcookies?\b|subscribe|newsletter|sign up|advertisement|sponsored", re.I)
SMALL_PRINT_CHARS = 200
_LETTER = re.compile(r"[^\W\d_]")
_ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
_AMBIGUOUS_TITLE = re.compile(r"(?:responses|replies):?\Z", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)


class Node:
    __slots__ = ("name", "children", "cut", "chars", "tags", "link_chars", "link_tags", "density", "total", "top", "parent", "suspect", "in_article", "foreign")

    def __init__(self, name: str, parent: Node | None, cut: bool = False):
        self.name, self.parent, self.cut = name, parent, cut
        self.children: list[Node | str] = []
        self.top: Node = self
        self.suspect = ""
        self.in_article = name in ("article", "main") or parent is not None and parent.in_article
        self.foreign = name in ("svg", "math") or parent is not None and parent.foreign


def _is_cut(name: str, attrs: str, in_article: bool, in_text: bool) -> bool | str:
    """Whether an element is cut. In the text, 'class' or 'id' if its class, or its id or label, only
    suggests it, so that what it holds has to confirm it."""
    if name in CUT_ELEMENTS or name == "header" and not in_article:
        return True
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False
    found = {}
    for key, value in _ATTR.findall(attrs):
        found.setdefault(key.lower(), value.strip("\"'"))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return True
    if name in ("html", "body", "main"):
        return False
    if found.get("role", "").lower() in CUT_ROLES:
        return True
    if in_text and name in HEADINGS:
        return False
    suspect = ""
    for key in ("class", "id", "aria-label"):
        value = found.get(key, "")
        for token in [value] if in_text and key == "aria-label" else value.split():
            words = [w.lower() for w in _WORDS.findall(token)]
            named = [w for w in words if _CUT_WORD.match(w) and not (in_article and w == "header")]
            if not named or _NOT_OWN.match(words[0]) or not all(w in named or _NEUTRAL.match(w) for w in words):
                continue
            if name == "article" and not any(w.startswith(("comment", "repl", "respon", "promo", "ad", "sponsor", "related")) for w in words):
                return False
            plain = [w for w in named if not _AMBIGUOUS.match(w)]
            if not in_text or plain and (key == "class" or len(words) == 1) or any(_VENDOR.match(w) for w in plain):
                return True
            suspect = suspect or ("class" if key == "class" else "id")
    return suspect


def parse(page: str) -> Node:
    """The DOM of a page, with cut nodes marked; text is kept undecoded."""
    root = Node("html", None)
    stack = [root]
    whole = not _ARTICLE.search(page)  # without an article's element, the text may be anywhere
    at, n = 0, len(page)

    opened = Counter(["html"])

    def pop_to(i: int) -> None:
        opened.subtract(x.name for x in stack[i:])
        del stack[i:]

    for_tag = _TAG.search
    while at < n:
        m = for_tag(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if closing:
            if name in ("html", "body") or not opened[name]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    pop_to(i)
                    break
                if stack[i].name in BLOCK and (name not in BLOCK or name == "p" and stack[i].name in SCOPE or stack[i].name in ("table", "td", "th") and name not in IMPLIED and name != "table"):
                    break
            continue
        if name in ("html", "body"):
            if name == "body" and opened["head"]:
                pop_to(next(i for i, x in enumerate(stack) if x.name == "head"))
            continue
        if name in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    pop_to(i)
                    break
                if stack[i].name in SCOPE:
                    break
        if name in BLOCK and name not in ("head", "title", "template") and len(stack) > 1 and stack[1].name == "head" and stack[-1] is stack[1]:
            pop_to(1)  # a head that isn't closed ends where the body's content begins
        if name in IMPLIED:
            ends, within = IMPLIED[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in within:
                    break
                if stack[i].name in ends:
                    pop_to(i)
                    if name not in ("tr", "tbody", "tfoot"):
                        break
        parent = stack[-1]
        cut = parent.cut or _is_cut(name, attrs or "", parent.in_article, parent.in_article or whole)
        node = Node(name, parent, cut is True)
        if cut is not True and cut:
            node.suspect = cut
        parent.children.append(node)
        if node.foreign and (attrs or "").endswith("/"):
            continue  # svg and math have tags that close themselves
        if name in RAW and not node.foreign:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID:
            stack.append(node)
            opened[name] += 1
    return root


def measure(root: Node) -> None:
    """Characters and tags of each node, and densities and their sums, bottom up."""
    order, work = [], [root]
    while work:
        node = work.pop()
        order.append(node)
        work += [c for c in node.children if not isinstance(c, str) and not c.cut]
    for node in reversed(order):
        node.chars, node.tags, node.link_chars, node.link_tags = 0, 1, 0, 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(" ".join(c.split()))
            elif not c.cut:
                node.chars, node.tags = node.chars + c.chars, node.tags + c.tags
                node.link_chars, node.link_tags = node.link_chars + c.link_chars, node.link_tags + c.link_tags
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    page_links = root.link_chars / max(root.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, node.tags, max(node.link_chars, 1), max(node.link_tags, 1)
        base = math.log(c * lc / max(c - node.link_chars, 1) + page_links * c + math.e)
        node.density = c / t * math.log(max(c * t / (lc * lt), 1.0)) / math.log(base) if c and base > 1 else 0.0
    for node in reversed(order):
        node.total = sum(c.density for c in node.children if not isinstance(c, str) and not c.cut)
        node.total += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        node.top = max([node, *(c.top for c in node.children if not isinstance(c, str) and not c.cut)], key=lambda x: x.total)


def cut_comments(root: Node) -> None:
    """Cut what a heading in a section or division names as reader comments.

    A section that the heading opens goes whole. Otherwise the heading goes, and its siblings after
    it up to the next heading of its rank or above. In an article, bare 'Responses' or 'Replies'
    may be a heading of the text, and stays.
    """
    for node in list(_walk(root)):
        if node.name not in HEADINGS or node.parent is None or node.parent.name not in ("section", "div"):
            continue
        title = " ".join(blocks(node))
        if not _COMMENTS.match(title) or _AMBIGUOUS_TITLE.match(title) and _inside(node, "article"):
            continue
        siblings = node.parent.children
        at = next(i for i, c in enumerate(siblings) if c is node)
        if node.parent.name == "section" and not any(c.strip() if isinstance(c, str) else blocks(c) for c in siblings[:at]):
            node.parent.cut = True
            continue
        end = next((i for i in range(at + 1, len(siblings)) if not isinstance(c := siblings[i], str) and c.name in HEADINGS and c.name <= node.name), len(siblings))
        for c in siblings[at:end]:
            if not isinstance(c, str):
                c.cut = True
        siblings[at:end] = [c for c in siblings[at:end] if not isinstance(c, str)]


def cut_suspects(root: Node) -> None:
    """Cut what a class, id or label suggests to be boilerplate and is mostly links, or, by its class, short."""
    found = [x for x in _walk(root) if x.suspect]
    if found:
        measure(root)
        for x in found:
            if x.link_chars * 2 > x.chars or x.suspect == "class" and x.chars < PROSE_CHARS:
                x.cut = True


def _inside(node: Node, name: str) -> bool:
    while (node := node.parent) is not None:
        if node.name == name:
            return True
    return False


def _linked(node: Node) -> bool:
    return node.link_chars * 2 > node.chars


def _belongs(node: Node, threshold: float, in_article: bool) -> bool:
    """Whether a block beside the path is part of the text; headings are judged by what they head."""
    if not node.chars or _linked(node):
        return False
    if in_article or node.density >= threshold:
        return True
    if node.chars < SMALL_PRINT_CHARS and _SMALL_PRINT.search(" ".join(blocks(node))):
        return False
    return any(x.name in PROSE and x.chars and not _linked(x) for x in _walk(node))


def keep_text(root: Node) -> None:
    """Cut what isn't in the subtree with the largest density sum, nor beside its path and part of the text."""
    measure(root)
    path = [root.top]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    on = set(path)
    if not path[0].in_article or path[0].name == "main":
        for c in path[0].children:  # lists of links that the seed holds beside its text
            if not isinstance(c, str) and c.name in BLOCK and c.name not in PROSE and not c.cut and _linked(c) and any(not isinstance(x, str) and not x.cut and x.name in BLOCK for x in c.children):
                c.cut = True
    for node in path[1:]:
        in_article = _of_article(node)
        reach = ""  # headings above this rank have something kept below them
        for at in range(len(node.children) - 1, -1, -1):  # from the end, so that what a heading heads is known
            c = node.children[at]
            if isinstance(c, str):
                reach = "h9" if c.strip() else reach
            elif c.cut:
                continue
            elif c.name in HEADINGS and c not in on:
                if in_article or c.name < reach and not _linked(c):
                    reach = c.name
                else:
                    c.cut = True
            elif c in on or (_belongs(c, threshold, in_article) if c.name in BLOCK else not _linked(c) or _beside_text(node.children, at)):
                reach = "h9" if c.chars else reach
            else:
                c.cut = True


def _of_article(node: Node | None) -> bool:
    """Whether a node is an article element or in one."""
    while node is not None and node.in_article:
        if node.name == "article":
            return True
        node = node.parent
    return False


def _beside_text(children: list[Node | str], at: int) -> bool:
    """Whether words stand in an inline element's line, so that it's a link in a sentence."""
    for step in (-1, 1):
        i = at + step
        while 0 <= i < len(children) and (isinstance(x := children[i], str) or x.name not in BLOCK):
            if isinstance(x, str) and _LETTER.search(x):
                return True
            i += step
    return False


def _walk(node: Node) -> Iterator[Node]:
    work = [node]
    while work:
        x = work.pop()
        yield x
        work += [c for c in reversed(x.children) if not isinstance(c, str) and not c.cut]


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under a node, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                out.append(text)
            run.clear()

    work: list[Node | str | None] = [node]
    while work:
        x = work.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.cut:
            if x.name == "br":
                run.append(" ")
            elif x.name in BLOCK:
                flush()
                work += [None, *reversed(x.children)]
            else:
                work += reversed(x.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    cut_comments(root)
    cut_suspects(root)
    keep_text(root)
    return "\n".join(blocks(root))


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the html column of pages by the text of its main content."""
    kept = [c for c in pages.columns if c not in (html, "text")]
    schema = T.StructType([*pages.select(*kept).schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([main_text(p) for p in batch.column(len(kept)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*kept, "text"])

    return pages.select(*kept, html).mapInArrow(run, schema)


def html_query(pages: DataFrame) -> DataFrame:
    return extract_text(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
