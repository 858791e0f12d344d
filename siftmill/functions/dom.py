"""HTML to trees: tokenizer, tree construction, navigation, text, cleaning, body scoring.

The tree builder follows the HTML5 rules that news pages need: void and raw-text
elements, implied ends (p, li, dt/dd, table parts, options, headings), synthesised html,
head and body, and formatting elements (b, i, a, ...) that are opened again in the next
block. What it leaves out is the foster-parenting of misplaced table content.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections.abc import Iterator

from . import dims

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
HEAD = frozenset("title meta link script style base noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
BLOCK = CLOSES_P | frozenset("body html head td th tr tbody thead tfoot caption button object applet marquee select option textarea title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element on the left is closed by a start tag on the right, up to the element that bounds the search.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset("ul ol menu".split())),
    "dd": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "dt": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "tr": (frozenset("tr td th".split()), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th".split()), frozenset({"table"})),
    "thead": (frozenset("tbody thead tfoot tr td th".split()), frozenset({"table"})),
    "tfoot": (frozenset("tbody thead tfoot tr td th".split()), frozenset({"table"})),
}
#: Open elements, as browsers have it.
MAX_DEPTH = 512
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag", "info")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs or {}, None
        self.children: list[Node | str] = []
        self.info: dict[str, float] = {}

    def add(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    @property
    def level(self) -> int:
        """0 for html."""
        return sum(1 for a in self.ancestors()) - 1

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def copy(self) -> Node:
        out = Node(self.tag, dict(self.attrs))
        todo = [(self, out)]
        while todo:
            old, new = todo.pop()
            for c in old.children:
                if isinstance(c, Node):
                    twin = Node(c.tag, dict(c.attrs))
                    new.add(twin)
                    todo.append((c, twin))
                else:
                    new.add(c)
        return out


class Index:
    """A document that no longer changes, with its elements by tag and its metas by name."""

    def __init__(self, doc: Node) -> None:
        self.doc, self.nodes = doc, list(doc.walk())
        self.tags: dict[str, list[Node]] = {}
        for n in self.nodes:
            self.tags.setdefault(n.tag, []).append(n)
        self.named: dict[tuple[str, str], list[Node]] = {}
        for m in self.tags.get("meta", []):
            for key in ("name", "property", "itemprop"):
                if key in m.attrs:
                    self.named.setdefault((key, m.attrs[key]), []).append(m)

    def walk(self) -> Iterator[Node]:
        return iter(self.nodes)

    def find(self, *tags: str) -> list[Node]:
        return self.tags.get(tags[0], []) if len(tags) == 1 else [n for n in self.nodes if n.tag in tags]


def parse(text: str | None) -> Node:
    """The document of an HTML text: a node '#document' over html, head and body."""
    text = text or ""
    if text.startswith("<?"):
        text = re.sub(r"^<\?.*?\?>", "", text, count=1, flags=re.S)
    doc, root, head, body = Node("#document"), Node("html"), Node("head"), Node("body")
    doc.add(root)
    root.add(head)
    root.add(body)
    stack: list[Node] = []
    active: list[Node] = []
    in_body = False

    def here() -> Node:
        return stack[-1] if stack else body if in_body else head

    def close(tag: str, bounds: frozenset[str] = frozenset()) -> bool:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return True
            if stack[i].tag in bounds:
                return False
        return False

    def reopen() -> None:
        for k, f in enumerate(active):
            if f not in stack and len(stack) < MAX_DEPTH:
                again = Node(f.tag, dict(f.attrs))
                here().add(again)
                stack.append(again)
                active[k] = again

    def write(s: str) -> None:
        nonlocal in_body
        if not in_body and not stack:
            if not s.strip():
                return
            in_body = True
        if active and s.strip():
            reopen()
        here().add(s)

    at, n = 0, len(text)
    last = text.rfind(">") + 1  # no tag ends behind it
    while at < n:
        m = _TAG.search(text, at, last) if at < last else None
        if not m:
            rest = text.find("<!--", at)
            write(htmllib.unescape(text[at : n if rest < 0 else rest]))
            break
        if m.start() > at:
            write(htmllib.unescape(text[at : m.start()]))
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break  # a comment that does not end
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in ("html", "body", "head"):
                in_body = in_body or tag == "head"
            elif tag == "p":
                if not close("p", frozenset({"td", "th", "button"})):
                    here().add(Node("p"))
            elif tag in HEADINGS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in HEADINGS:
                        del stack[i:]
                        break
            elif tag in FORMATTING:
                place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
                f = next((f for f in reversed(active) if f.tag == tag), None)
                if f is not None:
                    active.remove(f)
                if place is not None:
                    if any(x.tag in BLOCK for x in stack[place + 1 :]):
                        del stack[place]
                    else:
                        del stack[place:]
            else:
                close(tag, frozenset({"td", "th", "table"}) if tag not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot") else frozenset())
            continue
        attrs: dict[str, str] = {}
        for a in _ATTR.finditer(rest):
            name = a[1].lower()
            if name not in attrs:
                value = a[2] if a[2] is not None else a[3] if a[3] is not None else (a[4] or "")
                attrs[name] = htmllib.unescape(value)
        if tag in ("html", "body", "head"):
            target = {"html": root, "body": body, "head": head}[tag]
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            in_body = in_body or tag == "body"
            continue
        if not in_body and not stack and tag not in HEAD:
            in_body = True
        if tag in CLOSES_P:
            close("p", frozenset({"td", "th", "button"}))
        if tag in HEADINGS and stack and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    if tag in ("li", "dd", "dt", "option"):
                        break
                    continue
        if tag == "a":
            old = next((f for f in active if f.tag == "a"), None)
            if old is not None:
                active.remove(old)
                close("a", BLOCK)
        if active and tag not in BLOCK and tag not in HEAD:
            reopen()
        node = Node(tag, attrs)
        here().add(node)
        if tag in VOID or rest.rstrip().endswith("/") and tag in ("path", "use", "circle", "rect"):
            continue
        if tag in RAW or tag in ("title", "textarea"):
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(text, at)
            inner = text[at : end.start()] if end else text[at:]
            if inner:
                node.add(inner if tag in RAW else htmllib.unescape(inner))
            at = (text.find(">", end.start()) + 1 or n) if end else n
            continue
        if len(stack) >= MAX_DEPTH:
            continue  # what would lie deeper lies beside it
        stack.append(node)
        if tag in FORMATTING:
            active.append(node)
    return doc


_SILENT = frozenset("script style select option textarea".split())
_SPACES = re.compile(r"[ \t\n\f\r]+")
_MARKUP = re.compile(r"<[^>]+>")


def raw_text(node: Node, skip: frozenset[str] = frozenset()) -> str:
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in skip or x is node:
            todo += reversed(x.children)
    return "".join(out)


def text(node: Node) -> str:
    """Text below a node without scripts and controls; entities resolved again, markup and white space collapsed."""
    s = _MARKUP.sub(" ", htmllib.unescape(raw_text(node, _SILENT)))
    return _SPACES.sub(" ", s).strip()


def serialise(node: Node | str) -> str:
    out: list[str] = []
    todo: list[tuple[Node | str, bool]] = [(node, False)]  # with whether it is an end tag or raw text
    while todo:
        x, plain = todo.pop()
        if isinstance(x, str):
            out.append(x if plain else htmllib.escape(x, quote=False))
        elif plain:
            out.append(f"</{x.tag}>")
        else:
            if x.tag != "#document":
                out.append("<" + x.tag + "".join(f' {k}="{htmllib.escape(v)}"' for k, v in x.attrs.items()) + ">")
                if x.tag in VOID:
                    continue
                todo.append((x, True))
            todo += [(c, isinstance(c, str) and x.tag in RAW) for c in reversed(x.children)]
    return "".join(out)


# selection


def tags(node: Node, tag: str = "", attribs: dict[str, str] | None = None, match: str = "exact") -> list[Node]:
    """Elements by tag and attributes (any of them; duplicates stay): exact, substring, word or regex."""
    found = [n for n in node.walk() if not tag or n.tag == tag]
    if not attribs:
        return found
    test = {
        "exact": lambda v, w: v == w,
        "substring": lambda v, w: w in v,
        "word": lambda v, w: w in v.split(),
        "regex": lambda v, w: re.search(w, v) is not None,
    }[match]
    return [n for k, w in attribs.items() for n in found if k in n.attrs and test(n.attrs[k], w)]


def metas(doc: Node | Index, name: str) -> list[Node]:
    """Meta elements by name, then property, then itemprop."""
    if isinstance(doc, Index):
        return [m for key in ("name", "property", "itemprop") for m in doc.named.get((key, name), [])]
    every = doc.find("meta")
    return [m for key in ("name", "property", "itemprop") for m in every if m.get(key) == name and key in m.attrs]


def meta_field(doc: Node | Index, *names: str) -> str:
    """The first content that is not blank."""
    return next((m.get("content").strip() for n in names for m in metas(doc, n) if m.get("content").strip()), "")


def at_level(root: Node, level: int) -> list[Node]:
    """Nodes so many steps below root (itself at 0)."""
    now = [root]
    for _ in range(level):
        now = [c for n in now for c in n.elements()]
    return now


def depth(node: Node) -> int:
    """One more than the most children that an element below has; 1 for an element without any."""
    return 1 + max((len(n.elements()) for n in (node, *node.walk())), default=0)


def drop_tags(node: Node, tag: str, keep: frozenset[str] = frozenset()) -> None:
    """Remove the elements of a tag below node; elements of kept tags in them take their place."""
    for n in list(node.walk()):
        if n.tag == tag and n.parent is not None:
            parent = n.parent
            at = next(i for i, c in enumerate(parent.children) if c is n)
            saved = [c for c in n.walk() if c.tag in keep]
            saved = [c for c in saved if not any(a in saved for a in c.ancestors())]
            for c in saved:
                c.parent = parent
            parent.children[at : at + 1] = saved
            n.parent = None


def tree_path(node: Node) -> list[str]:
    return [a.tag for a in reversed(list(node.ancestors()))] + [node.tag]


def distance(a: list[str], b: list[str]) -> int:
    """Steps between two tag paths beyond what they share."""
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return len(a) - i + len(b) - i
    return abs(len(a) - len(b))


_WORDS = re.compile(r"[^\W_]+")
_TOKENS = re.compile(r"[^\W_]+|[^\w\s]|_")


def link_dense(node: Node) -> bool:
    """Are most words of the node links? The share allowed shrinks as the text grows."""
    links = [n for n in node.walk() if n.tag in ("a", "button")]
    if not links:
        return False
    words = len(_WORDS.findall(text(node)))
    if not words:
        return True
    share = 100.0 * sum(len(_WORDS.findall(text(a))) for a in links) / words
    allowed = 87 - 70 / (1.3 + math.exp(1 - words / 200))
    return share > allowed or (words < 50 and len(links) > 2 and share > 50)


# cleaning

_BAD = re.compile(
    "|".join(
        "^fn$ ^inset$ ^print$ ^side$ KonaFilter PopularQuestions ajoutVideo articleheadings author-dropdown breadcrumbs byline cnnStryHghLght cnn_html_slideshow cnn_stryspcvbx cnn_strycaptiontxt "
        "cnn_strylftcntnt combx comment communitypromo contact contentTools2 date foot Footer inline-share-tools js_replies konafilter legende links mediaarticlerelated menucontainer meta$ navbar "
        "pagetools popup post-attributes retweet runaroundLeft shoutbox socialNetworking socialnetworking sponsor storytopbar-bucket subscribe tags the_answers timestamp tools utility-bar vcard "
        "welcome_form wp-caption-text".split()
    )
)
_KINDS = "article content info links media search tags topics".split()
_RELATED = re.compile(rf"related[-\s_]?(?:{'|'.join(_KINDS)})|(?:{'|'.join(_KINDS)})[-\s_]?related")
_CONSENT = re.compile("cookie|consent|gdpr|ccpa")
_BY_NAME = [re.compile("^caption$"), re.compile(" google "), re.compile("^[^entry-]more.*$"), re.compile("facebook"), re.compile("twitter"), _CONSENT, _RELATED]
_KEEP = frozenset("p br img h1 h2 h3 h4 h5 h6 ul body article section".split())


def _drop(node: Node, test) -> None:  # noqa: ANN001
    for n in list(node.walk()):
        if test(n):
            n.remove()


def _holds_article(node: Node) -> bool:
    return any(n.tag == "article" or n.get("id") == "article" or "articleBody" in n.get("itemprop") for n in node.walk())


def _captions(node: Node) -> None:
    for tag in ("figure", "figcaption"):
        for n in node.find(tag):
            if n.parent is not None:
                parent = n.parent
                for img in n.find("img"):
                    img.remove()
                    parent.add(img)
                n.remove()
    _drop(node, lambda n: n.get("itemprop") == "caption" or n.get("class") in ("instagram-media", "image-caption") or (n.tag in ("div", "span") and "caption" in n.get("class")))


def clean(node: Node) -> Node:
    """The node without what is not its article; works on the node itself."""
    for n in node.walk():
        if n.tag == "body":
            n.attrs.pop("class", None)
        if n.tag == "article":
            for k in ("id", "name", "class"):
                n.attrs.pop(k, None)
    _drop(node, lambda n: n.tag == "em" and not n.find("img"))
    _drop(node, lambda n: n.tag == "span" and {"dropcap", "drop_cap"} & set(n.get("class").split()))
    _drop(node, lambda n: n.tag in ("script", "style"))
    for key in ("id", "class"):
        _drop(node, lambda n, key=key: key in n.attrs and _BAD.search(n.attrs[key]) and not _holds_article(n))
    _drop(node, lambda n: "name" in n.attrs and _BAD.search(n.attrs["name"]))
    _drop(node, lambda n: n.tag in ("aside", "nav", "noscript", "menu"))
    by = lambda rx: _drop(node, lambda n: any(k in n.attrs and rx.search(n.attrs[k]) for k in ("id", "class")))
    by(_BY_NAME[0])
    _captions(node)
    for rx in _BY_NAME[1:]:
        by(rx)
    _drop(node, lambda n: n.tag == "span" and any(a.tag == "p" for a in n.ancestors()))
    for body in node.find("body"):
        _drop(body, lambda n: n.tag not in _KEEP and not raw_text(n) and not n.elements())
    return node


def clean_whitespace(s: str) -> str:
    """Tabs to spaces, lines trimmed, blank ones dropped, an empty line between the others."""
    return "\n\n".join(x for x in (line.strip() for line in s.replace("\t", " ").split("\n")) if x)


# body

_BOOSTS = [
    ({"tag": "article", "role": "article"}, 25), ({"itemprop": "articlebody"}, 100), ({"itemprop": "articletext"}, 40),
    *[({"itemtype": f"https://schema.org/{kind}".lower()}, 30 if "Article" in kind and kind in ("Article", "NewsArticle") else 20) for kind in ("Article", "NewsArticle", "BlogPosting", "ScholarlyArticle", "SocialMediaPosting", "TechArticle")],
]
_BODY_CLASS = re.compile("paragraph|entry-content|article-text|article-body", re.I)
_PARENT2, _BOOST, _STEPS, _MIN_STOP, _MANY, _BOTTOM, _NEGATIVE, _FIVE = 0.4, 30.0, 3, 5, 15, 0.25, 40.0, 5.0


_TEXTUAL = "p pre td article div".split()


def _likely(node: Node) -> int:
    best = 0
    for rule, boost in _BOOSTS:
        if all((node.tag == v) if k == "tag" else node.get(k).lower() == v for k, v in rule.items()):
            best = max(best, boost)
    return max(best, 15) if _BODY_CLASS.search(node.get("class")) else best


def _candidates(doc: Node | Index) -> list[Node]:
    nodes = [n for tag in _TEXTUAL[:4] for n in doc.find(tag)]
    divs = doc.find("div")
    named = [n for word in ("articlebody", "article", "story") for key in ("id", "class") for n in divs if word in n.get(key).split()]
    named += [n for n in divs if "paragraph" in n.get("class")]
    if not named and len(nodes) < 5:
        named = divs
    out = dict.fromkeys([*nodes, *named])
    marked = [(n, n.attrs["itemprop"].split()) for n in doc.walk() if "itemprop" in n.attrs]
    for prop in ("articleBody", "articlebody", "articleText", "articleSection"):
        out |= dict.fromkeys(n for n, words in marked if prop in words)
    return list(out)


def stop_stats(s: str, stop: frozenset[str]) -> tuple[int, int]:
    tokens = _TOKENS.findall(s.lower())
    return sum(t in stop for t in tokens), len(tokens)


def top_node(doc: Node | Index, stop: frozenset[str]) -> Node | None:
    """The element with the highest gravity: its paragraphs' stop words, boosts for likely and neighbouring ones."""
    for n in doc.walk():
        if n.tag in _TEXTUAL:
            boost = _likely(n)
            if boost:
                n.info["score"] = n.info.get("score", 0.0) + boost
    order = {id(n): i for i, n in enumerate(doc.walk())}
    kept: list[Node] = []
    for n in sorted(_candidates(doc), key=lambda n: (-n.level, order[id(n)])):
        s = text(n)
        if not s:
            continue
        total, _ = stop_stats(s, stop)
        n.info["stop"] = total - sum(int(c.info["stop"]) for c in n.walk() if c.info.get("stop", 0) > 0)
        if total > 2 and not link_dense(n):
            kept.append(n)
    touched: dict[int, Node] = {}
    count, discount, bottom = len(kept), 1.0, _BOTTOM * len(kept)
    for i, n in enumerate(kept):
        boost = 0.0
        if n.parent is not None:
            family = n.parent.elements()
            place = next(k for k, c in enumerate(family) if c is n)
            if any(c.tag == n.tag and c.info.get("stop", 0) > _MIN_STOP for c in family[max(0, place - _STEPS) : place]):
                boost, discount = _BOOST / discount, discount + 1
        if count > _MANY and count - i <= bottom:
            away = bottom - (count - i)
            boost = _FIVE if away * away > _NEGATIVE else -(away * away)
        up = n.info["stop"] + boost
        for above, share in ((n.parent, 1.0), (n.parent.parent if n.parent else None, _PARENT2)):
            if above is not None and above.tag != "#document":
                above.info["score"] = above.info.get("score", 0.0) + up * share
                touched[id(above)] = above
    best = max(touched.values(), key=lambda n: (n.info["score"], -order[id(n)]), default=None)
    return best if best is not None else next(iter(doc.find("body")), None)


def body(doc: Node | Index, stop: frozenset[str], compat: bool = False) -> Node | None:
    """The article's element: the top node, with siblings of its level that belong to it.

    compat: look one level higher for siblings.
    """
    top = top_node(doc, stop)
    if top is None or top.tag in ("body", "article"):
        return top
    scores = [p.info["score"] for p in top.find("p") if p.info.get("score", 0) > 0]
    base = sum(scores) / len(scores) if scores else top.info.get("score", 0.0)
    out = Node("body")
    html = next(iter(doc.find("html")))
    for n in at_level(html, max(0, top.level - int(compat))):
        if n is top:
            out.add(n.copy())
        elif n.tag == top.tag:
            if n.info.get("score", 0.0) > base * 0.3 and not link_dense(n):
                out.add(n.copy())
            elif n.tag == "p":
                if text(n) and not link_dense(n):
                    out.add(n.copy())
            else:
                for p in n.find("p"):
                    if p.info.get("stop", 0) > max(0.0, base * 0.3) and not link_dense(p):
                        new = Node("p")
                        new.add(text(p))
                        out.add(new)
    return out


def stop_for(lang: str | None) -> frozenset[str]:
    return dims.stopwords_for(lang)
