"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A scanner cuts a page into leaf blocks (text between block-level tags, with character references decoded and white space
turned into one space), each with its open ancestors. Features are the ancestors' tags and naming (class, id, role), the
block's own tag, its length, link share, marks and neighbours; the field is trained on labelled pages (``labelled_pages``:
layouts of several kinds whose every block is marked) and decoded by Viterbi. Content blocks are joined by one space.

Defined results: null or empty html, or a page without content -> empty text, n_chars 0; an unclosed comment, script, style,
noscript or template reaches to the end, an unclosed textarea or select to the next tag of a form or region; a head without its end tag ends before the first thing that no head
may hold, a drawing without its own before the first tag that no drawing may hold; self-closed tags of these, but for scripts and
styles, are skipped alone; a cut tag at the end is dropped; a null page_id or url stays null; repeated pages are extracted alike; an
empty table gives no rows; only page_id, url and html are read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm import crf

#: What a head may hold: it ends at its end tag or else before the first thing that is none of these.
HEAD = "|".join([
    r"\s+", r"<!--.*?(?:-->|\Z)", r"<[!?][^>]*(?:>|\Z)", r"<title\b[^>]*+>(?:(?:[^<]++|<(?!/?(?:title|head|body)\b))*+</title\s*>|[^<]*+)", r"<(?:base|basefont|bgsound|link|meta|head|html)\b[^>]*(?:>|\Z)", r"</(?!(?:head|body|html|br)\b)[a-z][^>]*(?:>|\Z)",
    *(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\Z)" for t in ("script", "style")), *(rf"<{t}\b[^>]*+>(?:(?<=/>)|.*?(?:</{t}\s*>|\Z))" for t in ("noscript", "template", "noframes")),
])
#: Tags that end an open drawing, as they do in a browser.
BREAKS = "b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta|nobr|ol|p|pre|ruby|s|small|span|strong|strike|sub|sup|table|tt|u|ul|var"
SVG = "|".join([r"[^<]++|<!--.*?(?:-->|\Z)", *(rf"<{t}\b[^>]*+>(?:(?<=/>)|(?:[^<]++|<(?!/?{t}\b))*+</{t}\s*>)" for t in ("foreignObject", "style", "script", "title", "desc")), rf"<(?!/svg\b|(?:{BREAKS})(?=[\s/>]))"])
REGION = "nav|header|footer|aside|article|main|section"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|(?P<head><head(?=[\s>])[^>]*>(?:{HEAD})*+(?:</head\s*>)?)|(?P<svg><svg\b[^>]*+>(?:(?<=/>)|(?:{SVG})*+(?:</svg\s*>)?))"
    r"|<(?P<skip>script|style)\b[^>]*>.*?(?:</(?P=skip)\s*>|\Z)|<(?P<closed>noscript|template)\b[^>]*+>(?:(?<=/>)|.*?(?:</(?P=closed)\s*>|\Z))"
    rf"|<(?P<field>textarea|select)\b[^>]*+>.*?(?:</(?P=field)\s*>|(?=</(?:form|{REGION})\s*>|<(?:form|{REGION})[\s>])|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z|(?=<))",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Formula tags, which alone close themselves with a slash here.
FOREIGN = set("math mfrac mi mn mo mover mprescripts mroot mrow mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
#: Tags that end an open paragraph.
REGIONS = "nav header footer aside form article main section ul ol table figure button dialog div body blockquote".split()
NAMES = {
    "ad": r"\bads?\b|advert|sponsor|promo|banner|outbrain|taboola",
    "menu": r"menu|nav|breadcrumb|toolbar|tabs?\b|pagination|pager",
    "head": r"header|masthead|topbar|logo",
    "foot": r"footer|copyright|legal|colophon",
    "side": r"side-?bar|aside|widget|related|recommend|popular|trending|rail",
    "notice": r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|paywall|toast",
    "form": r"form|search|login|sign-?up|signin|input",
    "talk": r"comment|disqus|reply|replies|discuss|respond",
    "share": r"share|social|follow|tags?\b|meta|byline-links",
    "main": r"article|content|post|entry|main|story|body|text",
}
NAME_PATTERNS = {k: re.compile(v, re.I) for k, v in NAMES.items()}
OWN = ["h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "pre", "blockquote", "figcaption", "caption", "button", "option", "legend", "summary", "plain"]
#: Elements that hold paragraphs of text alike: sites write them as p, as div, or bare.
PLAIN = {"p", "div", "section", "article", "main", "center", "span", "body", ""}
OTHER, CONTENT = 0, 1
FEATURES = {x: i + 1 for i, x in enumerate([*(f"in:{r}" for r in REGIONS), *(f"named:{n}" for n in NAMES), *(f"own:{o}" for o in [*OWN, "other"]), *(f"long:{i}" for i in range(14)), *(f"links:{i}" for i in range(5)), *(f"after:{r}" for r in REGIONS), "stop", "sign", "first", "last", "early", "late"])}
TEXTS = "page_id long, url string, text string, n_chars long"


class Block:
    __slots__ = ("ancestors", "linked", "names", "own", "text")

    def __init__(self, text: str, linked: int, own: str, ancestors: frozenset, names: frozenset):
        self.text, self.linked, self.own, self.ancestors, self.names = text, linked, own, ancestors, names


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset, frozenset]] = [("", frozenset(), frozenset())]
    run: list[str] = []
    linked = in_link = at = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), next((t for t, _, _ in reversed(stack) if t not in INLINE), ""), stack[-1][1], stack[-1][2]))
            run.clear()
        linked = 0

    page = page or ""
    for m in TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at : m.start()])
            linked += in_link and m.start() - at
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["head"] or m["svg"] or m["skip"] or m["closed"] or m["field"]:
                flush()
            continue
        inline = name in INLINE
        if name == "a":
            in_link = int(not m["end"])
        if name in VOID:
            if not inline:
                if name == "br":
                    run.append(" ")
                else:
                    flush()
            continue
        if m["end"]:
            if not inline:
                flush()
                in_link = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if inline and stack[i][0] not in INLINE:
                    break
            continue
        if not inline:
            flush()
            in_link = 0
            while len(stack) > 1 and (stack[-1][0] in INLINE or stack[-1][0] == "p" or (name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0] == name)):
                stack.pop()
        if name not in FOREIGN or not (m["rest"] or "").rstrip().endswith("/"):  # elsewhere browsers pass over the slash
            _, above, names = stack[-1]
            given = " ".join(a or b or c for a, b, c in NAMED.findall(m["rest"])) if m["rest"] and "=" in m["rest"] else ""
            if given:
                names = names | {k for k, p in NAME_PATTERNS.items() if p.search(given)}
            stack.append((name, above | {name}, names))
    if at < len(page):
        run.append(page[at:])
        linked += in_link and len(page) - at
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """(blocks, slots) feature numbers; 0 fills up."""
    rows, before = [], frozenset()
    for i, b in enumerate(found):
        n = len(b.text)
        row = [f"in:{t}" for t in b.ancestors if f"in:{t}" in FEATURES] + [f"named:{x}" for x in b.names]
        row += [f"own:{'plain' if b.own in PLAIN else b.own if b.own in OWN else 'other'}", f"long:{min(13, n.bit_length())}", f"links:{min(4, 5 * b.linked // n)}"]
        row += [f"after:{t}" for t in before if f"after:{t}" in FEATURES and t not in b.ancestors]
        row += [x for x, on in (("stop", b.text[-1] in ".?!:;\"”»"), ("sign", bool(re.search("[©®™|›»·]", b.text))), ("first", i == 0), ("last", i == len(found) - 1), ("early", 10 * i < len(found)), ("late", 10 * i >= 9 * len(found))) if on]
        rows.append([FEATURES[x] for x in row])
        before = b.ancestors
    width = max(map(len, rows), default=1)
    return np.array([r + [0] * (width - len(r)) for r in rows], np.int64).reshape(len(rows), width)


def labelled_pages(n: int = 400, seed: int = 11) -> list[list[tuple[str, int]]]:
    """Pages as lists of (html fragment, label of its blocks): the layouts that sites use, with made-up words."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ka", "lo", "min", "ter", "su", "ve", "ran", "do", "pi", "es", "tion", "al"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]

    def say(a: int, b: int, stop: str = ".") -> str:
        w = [rng.choice(words) for _ in range(rng.randint(a, b))]
        return " ".join(w).capitalize() + (stop if rng.random() < 0.9 else "")

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{say(1, 3, "")}</a></li>' for i in range(k))

    def named(tag: str, *names: str) -> str:
        return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(names)}">'

    def body() -> list[tuple[str, int]]:
        para = rng.choice(["p", "p", "p", "div", "div", "section"])
        out = [(f"<{h}>{say(2, 9, '')}</{h}>", CONTENT) for h in [rng.choice(["h1", "h1", "h2"])] if rng.random() < 0.85]
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.66:
                open_b = "<b>" if rng.random() < 0.15 else ""
                out.append((f"<{para}>{open_b}{say(1, 110)}{'<br>' if rng.random() < 0.1 else ''}{f'</{para}>' if para != 'p' or rng.random() < 0.8 else ''}", CONTENT))
            elif r < 0.72:
                out.append((f'<{para}>{say(4, 20, "")} <a href="/x">{say(1, 4, "")}</a> {say(3, 20)}</{para}>', CONTENT))
            elif r < 0.78:
                out.append((f"<h{rng.randint(2, 4)}>{say(1, 7, '')}</h{2}>", CONTENT))
            elif r < 0.84:
                out.append(("<ul>" + "".join(f"<li>{say(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>", CONTENT))
            elif r < 0.88:
                out.append(("<table>" + "".join(f"<tr><td>{say(1, 3, '')}</td><td>{say(1, 5, '')}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>", CONTENT))
            elif r < 0.92:
                out.append((f"<blockquote>{say(5, 40)}</blockquote>", CONTENT))
            elif r < 0.95:
                out.append((f"<pre>{say(4, 30)}</pre>", CONTENT))
            elif r < 0.98:
                out.append((named("div", "ad", "ads", "advert", "ad-slot", "sponsored", "promo", "ad", "advert", "sidebar", "related-posts", "newsletter", "share-buttons") + say(2, 25) + "</div>", OTHER))
            else:
                out.append((f'<figure><img src="i"><figcaption>{say(3, 12)}</figcaption></figure>', CONTENT))
        return out

    pages = []
    for _ in range(n):
        bare = 0.1 if rng.random() < 0.2 else 1.0  # pages of little but the article
        page: list[tuple[str, int]] = [(f"<head><title>{say(2, 6)}</title></head><body>" if rng.random() < bare else "", OTHER)]
        for f, chance in (
            (lambda: f"<header><a href='/'>{say(1, 3, '')}</a><p>{say(2, 8)}</p></header>", 0.4),
            (lambda: f"<nav><ul>{links(rng.randint(3, 9))}</ul></nav>", 0.75),
            (lambda: named("div", "menu", "navbar", "top-nav", "breadcrumbs") + f"<ul>{links(4)}</ul></div>", 0.3),
            (lambda: named("div", "cookie-notice", "consent", "alert", "notice", "newsletter-popup") + f"<p>{say(6, 30)}</p><button>{say(1, 2, '')}</button></div>", 0.35),
            (lambda: named("div", "ad", "advert", "banner", "ads") + say(3, 30) + "</div>", 0.5),
            (lambda: f"<form action='/s'><label>{say(1, 3, '')}</label><input name=q><button>{say(1, 1, '')}</button></form>", 0.3),
            (lambda: f"<aside><h3>{say(1, 3, '')}</h3><ul>{links(3)}</ul><p>{say(4, 30)}</p></aside>", 0.3),
        ):
            if rng.random() < chance * bare:
                page.append((f(), OTHER))
        tag = rng.choice(["article", "article", "article", "main", "section", named("div", "content", "post", "entry-content", "story", "article-body")[1:-1]])
        page += [(f"<{tag}>", OTHER), *body(), (f"</{tag.split()[0]}>", OTHER)]
        for f, chance in (
            (lambda: named("div", "share", "social-links", "tags") + f"<ul>{links(3)}</ul></div>", 0.3),
            (lambda: named("section", "comments", "comment-list", "disqus_thread", "replies") + f"<h3>{say(1, 3, '')}</h3>" + "".join(f"<div class='comment'><p>{say(3, 60)}</p></div>" for _ in range(rng.randint(1, 5))) + "</section>", 0.45),
            (lambda: named("div", "sidebar", "related", "widget", "recommended") + f"<h4>{say(1, 3, '')}</h4><ul>{links(4)}</ul><p>{say(5, 40)}</p></div>", 0.4),
            (lambda: f"<aside>{say(5, 30)}</aside>", 0.25),
            (lambda: named("div", "ad", "sponsor", "promo") + f"<p>{say(3, 30)}</p></div>", 0.3),
            (lambda: f"<form><p>{say(2, 10)}</p><textarea>{say(1, 4)}</textarea><button>{say(1, 2, '')}</button></form>", 0.25),
            (lambda: f"<footer><p>© {say(2, 12)}</p><ul>{links(rng.randint(0, 5))}</ul></footer>", 0.6),
            (lambda: f"<footer>{say(1, 6)} &copy; 2020 &middot; {say(1, 8)}</footer>", 0.3),
        ):
            if rng.random() < chance * bare:
                page.append((f(), OTHER))
        pages.append(page)
    return pages


def learn() -> crf.Crf:
    sequences = []
    for page in labelled_pages():
        found, marks, text = [], [], ""
        for fragment, label in page:
            text += fragment
            found = blocks(text)
            marks += [label] * (len(found) - len(marks))
            del marks[len(found) :]
        sequences.append((features(found), np.array(marks, np.int64)))
    return crf.train(sequences, len(FEATURES) + 1, epochs=40, l2=1e-4)


def main_text(page: str | None, model: crf.Crf) -> str:
    found = blocks(page)
    marks = model.viterbi(features(found)) if found else []
    return " ".join(b.text for b, m in zip(found, marks, strict=True) if m == CONTENT)


def extract(pages: DataFrame, model: crf.Crf | None = None) -> DataFrame:
    sent = pages.sparkSession.sparkContext.broadcast(model or learn())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), sent.value) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, TEXTS)
