"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a binary variable, content or not. A factor joins each element to its parent;
others join it to its tag, to each word of its class, id and role, to its link density, its own text
and its form fields. The weights of words are learned and bounded, so no word decides by itself, and
a word never seen says nothing. Sum-product messages pass up and down the tree once and give the exact marginal
of every element; a block of text is kept when that of its element is above one half. The
factors are counts with smoothing from labelled pages, which `labelled_pages` writes by rule.
"""

from __future__ import annotations

import html
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from metrolith.llm._spark import extended, filled_name, plus
from metrolith.llm._text import filled, held

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content a browser does not show as text.
RAW = frozenset("script style noscript template textarea iframe title".split())
INLINE = frozenset("math mi mn mo ms mtext mrow msup msub mfrac msqrt svg g tspan a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul body".split())
#: An open element of the values ends where one of the key begins, up to the nearest of the bounds.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BOUNDS = frozenset("ul ol dl table select body html article section div".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
_HIDDEN = re.compile(r"\saria-hidden\s*=\s*[\"']?true|\sstyle\s*=\s*(?:\"[^\"]*|'[^']*|\S*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_BARE_HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("fields", "hidden", "label", "linked", "names", "own", "parent", "tag", "total")

    def __init__(self, tag: str, parent: int, names: tuple[str, ...] = (), label: int = -1, hidden: bool = False):
        self.tag, self.parent, self.names, self.label, self.hidden = tag, parent, names, label, hidden
        self.own = self.total = self.linked = self.fields = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in page order (parents first), and the blocks of text with their element."""
    nodes = [Node("#", -1)]
    stack = [(0, 0, False)]  # element, nearest block element, whether inside a link
    open_tags: dict[str, int] = {}
    blocks: list[tuple[int, list[str]]] = []
    open_block = None

    def text(s: str) -> None:
        nonlocal open_block
        if not s:
            return
        if "&" in s:
            s = html.unescape(s)
        _, k, link = stack[-1]
        if nodes[stack[-1][0]].hidden:
            return
        if open_block is None or blocks[open_block][0] != k:
            if not s.strip():
                return
            open_block = len(blocks)
            blocks.append((k, []))
        blocks[open_block][1].append(s)
        n = len(s.split())
        nodes[k].own += n
        if link:
            nodes[k].linked += n

    def close_to(depth: int) -> None:
        for i, _, _ in stack[depth:]:
            open_tags[nodes[i].tag] -= 1
        del stack[depth:]

    def tag_at(depth: int) -> str:
        return nodes[stack[depth][0]].tag

    at, end, size = 0, 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        closing, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        block = tag not in INLINE
        if tag == "br":
            if open_block is not None:
                blocks[open_block][1].append(" ")
            continue
        if block:
            open_block = None
        if closing:
            if open_tags.get(tag):
                for d in range(len(stack) - 1, 0, -1):
                    if tag_at(d) == tag:
                        close_to(d)
                        break
                    if not block and tag_at(d) not in INLINE:
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else (size if tag in ("script", "style", "textarea", "title") else at)
            if tag == "textarea":
                nodes[stack[-1][1]].fields += 1
            continue
        if tag in VOID:
            if tag == "input":
                nodes[stack[-1][1]].fields += 1
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            for d in range(len(stack) - 1, 0, -1):
                if tag_at(d) == "p":
                    close_to(d)
                    break
                if tag_at(d) not in INLINE:
                    break
        if any(open_tags.get(t) for t in SIBLINGS.get(tag, ())):
            for d in range(len(stack) - 1, 0, -1):
                t = tag_at(d)
                if t in SIBLINGS[tag]:
                    close_to(d)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif t in BOUNDS:
                    break
        if tag in ("html", "body") and open_tags.get(tag):
            continue
        attrs = m[3]
        names = tuple(dict.fromkeys(w.lower() for x in _ATTR.findall(attrs) for w in _WORD.findall(x[1] or x[2] or x[3]))) if attrs and "=" in attrs else ()
        parent, owner, link = stack[-1]
        hidden = nodes[parent].hidden
        if attrs and not hidden and ("hidden" in attrs.lower() or "none" in attrs.lower()):
            hidden = bool(_HIDDEN.search(attrs) or _BARE_HIDDEN.search(_QUOTED.sub("=x", attrs)))
        node = Node(tag, parent, names, hidden=hidden)
        if "data-y=" in attrs:
            node.label = int("data-y=1" in attrs)
        if tag in ("select", "button"):
            nodes[owner].fields += 1
        nodes.append(node)
        k = len(nodes) - 1
        stack.append((k, k if block else owner, link or tag == "a"))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    for n in nodes:
        n.total = n.own
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[nodes[i].parent]
        p.total += nodes[i].total
        p.linked += nodes[i].linked
        p.fields += nodes[i].fields
    out = []
    for k, parts in blocks:
        s = " ".join("".join(parts).split())
        if s:
            out.append((k, s))
    return nodes, out


_KINDS = {**dict.fromkeys(("article", "main"), "article"), **dict.fromkeys(("p", "blockquote", "pre", "figcaption"), "p"), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "h"), **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"), **dict.fromkeys(("li", "dt", "dd"), "li"), **dict.fromkeys(("table", "tbody", "thead", "tr", "td", "th"), "table"), **dict.fromkeys(("form", "fieldset", "select", "button", "label", "dialog"), "form")}


def features(n: Node) -> tuple[str, ...]:
    kind = n.tag if n.tag in ("nav", "header", "footer", "aside", "#", "html", "body", "div", "section") else _KINDS.get(n.tag, "inline" if n.tag in INLINE else "other")
    density = n.linked / n.total if n.total else -1
    return (
        "tag " + kind,
        "named" if n.names else "no name",
        "links " + ("none" if density < 0 else "0" if density == 0 else "few" if density < 0.4 else "many"),
        "own " + ("0" if not n.own else "1" if n.own < 4 else "4" if n.own < 15 else "15"),
        "fields" if n.fields else "no fields",
    )


#: Weight that one word of a name, and all of them together, have at most (log odds).
WORD_WEIGHT, NAME_WEIGHT = 2.5, 4.0


_PLAIN = frozenset(("p", "h", "list", "li", "table", "inline"))


def group(n: Node) -> bool:
    """Whether an element marks a part of the page rather than a piece of running text."""
    return bool(n.names) or not (n.tag in INLINE or _KINDS.get(n.tag) in _PLAIN)


class Model:
    """log P(feature | label) and log P(label | label of parent, group) by counting with smoothing."""

    def __init__(self, pages: list[str]):
        seen, pair, word, label, named = {}, {}, {}, [1.0, 1.0], [1.0, 1.0]
        for page in pages:
            nodes, _ = parse(page)
            for n in nodes:
                if n.label < 0:
                    n.label = nodes[n.parent].label if n.parent >= 0 else 0
            for n in nodes:
                label[n.label] += 1
                for f in features(n):
                    seen.setdefault(f, [0.5, 0.5])[n.label] += 1
                named[n.label] += bool(n.names)
                for w in n.names:
                    word.setdefault(w, [0, 0])[n.label] += 1
                if n.parent >= 0:
                    pair.setdefault((group(n), nodes[n.parent].label), [0.5, 0.5])[n.label] += 1
        self.prior = [math.log(x / sum(label)) for x in label]
        self.unary = {f: tuple(math.log(c / t) for c, t in zip(v, label, strict=True)) for f, v in seen.items()}
        clip = lambda x: max(-WORD_WEIGHT, min(WORD_WEIGHT, x))
        self.word = {w: clip(math.log((v[1] + 0.5) / named[1]) - math.log((v[0] + 0.5) / named[0])) for w, v in word.items()}
        self.pair = {p: tuple(math.log(x / sum(v)) for x in v) for p, v in pair.items()}
        for g in (False, True):
            for p in (0, 1):
                self.pair.setdefault((g, p), (math.log(0.5), math.log(0.5)))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each element: messages from the leaves up, then from the root down."""
        n = len(nodes)
        unary = self.unary
        here = []
        for x in nodes:
            a = b = 0.0
            for f in features(x):
                u = unary.get(f)
                if u:
                    a += u[0]
                    b += u[1]
            if x.names:
                b += max(-NAME_WEIGHT, min(NAME_WEIGHT, sum(self.word.get(w, 0.0) for w in x.names)))
            here.append([a, b])
        here[0][0] += self.prior[0]
        here[0][1] += self.prior[1]
        pair = [self.pair[g, 0] + self.pair[g, 1] for g in map(group, nodes)]
        up = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            a, b = here[i]
            p00, p01, p10, p11 = pair[i]
            m = up[i] = (_plus(p00 + a, p01 + b), _plus(p10 + a, p11 + b))
            h = here[nodes[i].parent]
            h[0] += m[0]
            h[1] += m[1]
        down = [(0.0, 0.0)] * n
        out = [0.0] * n
        for i in range(n):
            if i:
                p = nodes[i].parent
                a, b = here[p][0] + down[p][0] - up[i][0], here[p][1] + down[p][1] - up[i][1]
                p00, p01, p10, p11 = pair[i]
                top = max(a, b)
                down[i] = (_plus(a + p00, b + p10) - top, _plus(a + p01, b + p11) - top)
            a, b = here[i][0] + down[i][0], here[i][1] + down[i][1]
            out[i] = 1 / (1 + math.exp(min(700.0, a - b)))
        return out


def _plus(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def labelled_pages(count: int = 700, seed: int = 7) -> list[str]:
    """Pages of several layouts with the label of each part in `data-y` (children inherit it)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "be", "co", "di", "er", "fo", "in", "ka", "lo", "me", "on", "ra", "st", "ti", "un")) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    items = lambda a, b: "".join(f"<li>{link()}</li>" for _ in range(r.randint(a, b)))

    def prose() -> str:
        k = r.random()
        if k < 0.72:
            body = words(1, 90) + "."
            if r.random() < 0.3:
                body += f" {link()} {words(2, 20)}."
            return f"<p>{body}</p>" if r.random() < 0.6 else f"<p><b>{words(2, 9)}.<br>" if r.random() < 0.3 else f"<p>{body}"
        if k < 0.8:
            return f"<h2>{words(1, 8)}</h2>"
        if k < 0.88:
            return "<ul>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if k < 0.92:
            return f"<blockquote><p>{words(5, 40)}</p></blockquote>"
        if k < 0.96:
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 6)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<figure><img src=x><figcaption>{words(2, 10)}</figcaption></figure>"

    pick = lambda x: r.choice(x.split())
    MENU, TOP = "menu nav navbar navigation topnav breadcrumb breadcrumbs main-menu site-nav mobile-menu nav-links pager pagination tabs toolbar toc", "header site-header masthead branding topbar page-header banner logo global-header"
    FOOT, SIDE = "footer site-footer colophon copyright legal page-footer footer-links disclaimer", "sidebar rail widget widgets side secondary related related-posts recommended trending popular most-read teaser teasers outbrain side-bar right-column read-next"
    NOTE, ADVERT = "cookie cookie-notice cookie-banner consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall site-notice privacy-notice", "ad ads advert advertisement adsense ad-slot banner sponsor sponsored promo promotion ad-container"
    SAY, TALK = "share sharing social share-buttons follow post-tags tags skip skip-link print-link", "comments reader-comments comment-list discussion replies disqus responses comment-section"
    MAIN = "content post-content entry story main article article-body entry-content post body-text rich-text page-content story-body markdown-body main-content post-body document prose"
    WITHIN = "header-image post-header entry-header article-header related-work search-results side-by-side comments-policy footnotes footnote section chapter intro lead summary abstract figure caption gallery quote pullquote note table wrapper row column paragraph text block highlight code example references video embed list steps content-block title headline subtitle menu-guide navigation-systems social-studies ad-hoc banner-year share-prices alert-levels"

    def bad(cls: str, tag: str = "div") -> str:
        inner = f"<p>{words(2, 40)}.</p>" if r.random() < 0.5 else words(1, 25)
        return f'<{tag} data-y=0 class="{cls}">{inner}</{tag}>'

    def comments() -> str:
        one = lambda: f'<{(t := pick("div li article"))} class="{pick("comment reply comment-body response")}"><p>{words(1, 50)}.</p></{t}>'
        return f'<{(t := pick("section div"))} data-y=0 id="{pick("comments responses discussion")}" class="{pick(TALK)}"><h3>{words(1, 2)}</h3>' + "".join(one() for _ in range(r.randint(1, 5))) + f"</{t}>"

    def form() -> str:
        name = f' class="{pick("search search-form login contact-form signup-form")}"' if r.random() < 0.5 else ""
        return f"<form data-y=0 action=/x{name}><label>{words(1, 4)}</label><input name=q>" + (f"<p>{words(2, 15)}</p>" if r.random() < 0.4 else "") + f"<button>{words(1, 2)}</button></form>"

    def within(body: str) -> str:
        """A part of the article with a name of its own, which may hold words that elsewhere name other parts."""
        return f'<{(t := pick("div div section figure"))} {pick("class class id")}="{pick(WITHIN)}">{body}</{t}>'

    extras = [
        lambda: f"<nav data-y=0><ul>{items(2, 9)}</ul></nav>",
        lambda: f'<div data-y=0 class="{pick(MENU)}">{link()} {link()} {link()}</div>',
        lambda: f'<header data-y=0 class="{r.choice(("", pick(TOP)))}"><h1>{words(1, 4)}</h1><p>{words(1, 9)}</p></header>',
        lambda: f'<aside data-y=0 class="{r.choice(("", pick(SIDE)))}"><h3>{words(1, 3)}</h3>' + (f"<ul>{items(1, 6)}</ul>" if r.random() < 0.5 else f"<p>{words(3, 50)}.</p>") + "</aside>",
        lambda: bad(pick(ADVERT)),
        lambda: bad(pick(NOTE)),
        lambda: bad(pick(SIDE)) if r.random() < 0.5 else bad(pick(SAY)),
        form,
        lambda: f'<div data-y=0 {pick("class id")}="{pick(TOP)}"><a href=/>{words(1, 3)}</a> {words(1, 8)}</div>',
        lambda: f'<div data-y=0 {pick("class id")}="{pick(SIDE)}"><h3>{words(1, 3)}</h3><ul>{items(2, 6)}</ul></div>',
        lambda: "<!-- x -->",
        lambda: "<script>var a=1;</script>",
    ]
    out = []
    for _ in range(count):
        h = f"<h1>{words(1, 12)}</h1>"
        if r.random() < 0.15:
            h = f"<header>{h}</header>"
        if r.random() < 0.2:
            h = within(h + (f"<p>{words(2, 12)}</p>" if r.random() < 0.5 else ""))
        pieces = [prose() for _ in range(r.choice((1, 1, 2, 2, 4, 8, 15)))]
        pieces = [within(x) if r.random() < 0.15 and x.endswith(">") else x for x in pieces]
        body = h * (r.random() < 0.85) + "".join(pieces)
        for _ in range(r.choice((0, 0, 0, 1, 2))):  # what stands amid the article
            cut = body.rfind("<p", 0, r.randint(1, max(2, len(body))))
            if cut > 0:
                body = body[:cut] + r.choice([extras[4], extras[5], extras[7], extras[3]])() + body[cut:]
        kind = r.random()
        if kind < 0.55:
            name = f' class="{pick(MAIN + " " + WITHIN)}"' if r.random() < 0.4 else ""
            main = f"<article data-y=1{name}>{body}</article>"
        elif kind < 0.75:
            main = f"<main data-y=1><article>{body}</article></main>"
        elif kind < 0.9:
            main = f'<div data-y=1 {pick("class class id")}="{pick(MAIN)}">{body}</div>'
        else:
            main = f"<main data-y=1>{body}</main>"
        before = "".join(r.choice(extras)() for _ in range(r.randint(0, 5)))
        after = "".join(r.choice(extras)() for _ in range(r.randint(0, 3))) + (comments() if r.random() < 0.35 else "")
        named = f' class="{pick(FOOT)}"' if r.random() < 0.4 else ""
        foot = f"<{(t := pick('footer footer footer div') if named else 'footer')} data-y=0{named}>{r.choice(('', '&copy; '))}{words(1, 12)} {link() if r.random() < 0.4 else ''}</{t}>" if r.random() < 0.85 else ""
        if r.random() < 0.2:
            main = f'<div class="{r.choice(("wrapper", "container", "page"))}">{before}{main}{after}</div>'
            before = after = ""
        out.append(f"<html><head><title>{words(1, 5)}</title></head><body data-y=0>{before}{main}{after}{foot}</body></html>")
    return out


def main_text(page: str, model: Model) -> str:
    nodes, blocks = parse(page)
    p = model.marginals(nodes)
    return "\n".join(s for k, s in blocks if p[k] > 0.5)


def extract(pages: DataFrame, column: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """Adds text string and n_chars long (its code points): the main text of every whole page.

    `labelled` pages mark content by a `data-y` attribute of 1 and the rest by 0; the default is
    `labelled_pages()`. References are decoded, white space within a block becomes one space, blocks are
    joined by one newline in page order. Unclosed and cut tags are borne as browsers do. What a browser
    does not show (hidden elements, noscript, iframe, template, title) is no text; math, object and svg are.

    A null or empty page, or one without content, has an empty text. Rows are handled in place, one
    by one; an empty table gives no rows and an older column of an added name is replaced.
    """

    def run(batches):
        if labelled is not None:
            model = Model(labelled)
        else:
            model = held("html", 0, lambda: Model(labelled_pages()))
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in filled(batch.column(batch.schema.get_field_index(filled_name(batch, column))))]
            yield extended(batch, text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    return pages.mapInArrow(run, plus(pages.schema, "text string, n_chars bigint"))
