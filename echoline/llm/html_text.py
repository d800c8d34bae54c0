"""Main text of web pages by belief propagation over the DOM tree.

Every element of a page is content or boilerplate.  How likely its own features
(tag, words of class and id, share of linked text, length, punctuation) are in
either state, and how likely a child's state is given its parent's, is learned
from pages that mark their article themselves; priors stand for what those
pages may not show.  Sum-product messages go from the leaves to the
root and back, which gives each element's marginal over the whole tree.  The
text is that of the blocks whose element is content.

What is said of a tag or name beforehand counts like so many elements seen, so
pages that show otherwise overrule it.  The labels come from where a page's
article begins and ends and not from those lists: elements inside an article that the
lists call boilerplate have no label and teach nothing.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import map_texts, ship_package

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head svg canvas object audio video select datalist button math".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul body".split())
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
# Containers whose tag says nothing about their content.
NEUTRAL = frozenset("html body center dd div dl dt fieldset figure hgroup li ol section table tbody td tfoot th thead tr ul".split())
# Prior log odds of content for tags and for words of class, id, role and itemprop.
PRIOR_TAGS = {"article": 4.0, "main": 3.0, "blockquote": 1.0, "pre": 1.0, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "header": -4.0, "menu": -6.0, "dialog": -6.0}
PRIOR_CONTENT, CONTENT_WORDS = 2.0, "article articlebody body content entry main post story text".split()
PRIOR_BOILERPLATE, BOILERPLATE_WORDS = -8.0, "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright discussion disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar tracking widget".split()
#: Weight of the features' overall frequency in that of either state: no feature decides alone.
BLUR = 0.1
#: Learned weights of an element's form count half: they go along with each other.
TEMPER = 0.5
#: What is known beforehand of a tag or name counts like so many elements; of others it is even odds and less.
PRIOR_SEEN, EVEN_SEEN = 20.0, 4.0
#: A part of an article may be no content, also where the labelled pages have none such.
MOST_ALIKE = 0.9

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^<]*\Z", re.S)
NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")


@lru_cache(maxsize=None)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


@dataclass
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    text: int = 0
    linked: int = 0
    marks: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (node, text) of each block, in page order.
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _name_words(attributes: str) -> tuple[str, ...]:
    found: list[str] = []
    for m in NAMES.finditer(attributes):
        parts = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "")
        found += WORDS.findall(parts.lower())
    return tuple(dict.fromkeys(found))


def parse(source: str) -> Page:
    """Elements and text blocks of a page.  Unclosed and misplaced tags are mended as browsers do in
    the usual cases; a tag that the page's end cuts off is dropped.  Inline elements are no nodes."""
    page = Page([Node("html", -1)])
    nodes, stack = page.nodes, [("html", 0)]  # stack: (tag, node); inline elements share their block's node
    parts: list[str] = []
    hidden = links = 0

    def close_block() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            page.blocks.append((stack[-1][1], text))

    def pop(to: int) -> None:
        nonlocal hidden, links
        while len(stack) > to:
            tag, _ = stack[-1]
            if tag not in INLINE:
                close_block()
            stack.pop()
            hidden -= tag in HIDDEN
            links -= tag == "a"

    def add(text: str) -> None:
        if hidden or not text:
            return
        text = html.unescape(text)
        n = len(text) - text.count(" ")
        if n:
            node = nodes[stack[-1][1]]
            node.text += n
            node.linked += n if links else 0
            node.marks += text.count(".") + text.count(",")
        parts.append(text)

    at = 0
    while True:
        m = TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and all(t != "p" for t, _ in stack):
                close_block()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            end = _raw_end(tag).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in ("html", "body") and any(t == tag for t, _ in stack):
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag == "body" or (tag not in INLINE and stack[-1][0] == "head" and tag not in VOID):
            while len(stack) > 1 and stack[-1][0] == "head":
                pop(len(stack) - 1)
        if tag in SAME_KIND:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SAME_KIND[tag]:
                    pop(k)
                elif stack[k][0] in SCOPE[tag]:
                    break
        if tag in VOID:
            if tag == "hr":
                close_block()
            continue
        if tag not in INLINE:
            close_block()
            nodes.append(Node(tag, stack[-1][1], _name_words(m[3])))
            stack.append((tag, len(nodes) - 1))
        else:
            stack.append((tag, stack[-1][1]))
            links += tag == "a"
        hidden += tag in HIDDEN
        if m[3].endswith("/") and tag in ("svg", "math"):
            pop(len(stack) - 1)
    pop(1)
    close_block()
    return page


def features(node: Node) -> list[str]:
    """What the model looks at: tag, name words, and bins of the element's own text."""
    out = [] if node.tag in NEUTRAL else [f"tag={node.tag}"]
    out += [f"word={w}" for w in node.words]
    if node.text:
        share = node.linked / node.text
        out.append(f"links={0 if share == 0 else 1 if share < 0.5 else 2}")
        out.append(f"length={min(int(math.log2(node.text) / 2), 5)}")
        out.append(f"marks={min(int(math.log2(1 + node.marks)), 4)}")
    return out


MARKED = {"article", "main"}
TOP = {"html", "body"}
FREE = ((0.5, 0.5), (0.5, 0.5))


def own_labels(page: Page) -> list[bool | None] | None:
    """Which elements are content by the page's own marking: those inside its article and those that hold
    it.  None if it marks no article, and None for elements (with all inside them) that stand in an article
    but whose kind or name the priors call boilerplate: whether they are content isn't known."""
    inside: list[bool | None] = [False] * len(page.nodes)
    found, bad = False, set(BOILERPLATE_WORDS)
    for k, n in enumerate(page.nodes):
        marked = n.tag in MARKED or "articlebody" in n.words
        found |= marked
        above = inside[n.parent] if n.parent >= 0 else False
        doubtful = PRIOR_TAGS.get(n.tag, 0) < 0 or any(w in bad for w in n.words)
        inside[k] = True if marked else None if above is None or (above and doubtful) else above
    if not found:
        return None
    # What holds an article passes for content, or messages from above would hide it.
    for k in range(len(page.nodes) - 1, 0, -1):
        if inside[k]:
            p = page.nodes[k].parent
            while p >= 0 and not inside[p]:
                inside[p] = True
                p = page.nodes[p].parent
    return inside


@dataclass
class Model:
    #: log(content / boilerplate) of a feature.
    weights: dict[str, float]
    #: probability of a child's state given its parent's: [parent][child], state 1 is content.
    child: tuple[tuple[float, float], tuple[float, float]]
    root: float

    def marginals(self, page: Page) -> list[float]:
        """Probability of content for each element: messages up to the root, then down."""
        nodes, n = page.nodes, len(page.nodes)
        odds = [math.exp(max(-30.0, min(30.0, sum(self.weights.get(f, 0.0) for f in features(x))))) for x in nodes]
        own = [(1 / (1 + o), o / (1 + o)) for o in odds]
        below = [[b, c] for b, c in own]  # own evidence times messages of the children
        up = [(1.0, 1.0)] * n
        # What stands right below the page's top takes after nothing.
        tables = [FREE if x.parent < 0 or nodes[x.parent].tag in TOP else self.child for x in nodes]
        for k in range(n - 1, 0, -1):  # children come after their parents
            t = tables[k]
            b0, b1 = below[k]
            m0, m1 = t[0][0] * b0 + t[0][1] * b1, t[1][0] * b0 + t[1][1] * b1
            s = m0 + m1
            up[k] = (m0 / s, m1 / s)
            p = below[nodes[k].parent]
            p[0] *= up[k][0]
            p[1] *= up[k][1]
            if p[0] + p[1] < 1e-100:
                p[0], p[1] = p[0] * 1e100, p[1] * 1e100
        out, belief = [0.0] * n, [(0.0, 0.0)] * n
        b0, b1 = below[0][0] * (1 - self.root), below[0][1] * self.root
        belief[0] = (b0 / (b0 + b1), b1 / (b0 + b1))
        out[0] = belief[0][1]
        for k in range(1, n):
            t = tables[k]
            q = belief[nodes[k].parent]
            # The parent's belief without this child's own message.
            p0, p1 = q[0] / max(up[k][0], 1e-300), q[1] / max(up[k][1], 1e-300)
            d0, d1 = p0 * t[0][0] + p1 * t[1][0], p0 * t[0][1] + p1 * t[1][1]
            b0, b1 = below[k][0] * d0, below[k][1] * d1
            s = b0 + b1
            belief[k] = (b0 / s, b1 / s) if s > 0 else (0.5, 0.5)
            out[k] = belief[k][1]
        return out

    def text(self, source: str, threshold: float = 0.5) -> str:
        page = parse(source)
        if not page.blocks:
            return ""
        p = self.marginals(page)
        return "\n\n".join(t for k, t in page.blocks if p[k] >= threshold)


def count_labels(source: str) -> Counter:
    """(feature, content) and (what the parent is, content) of a page's labelled elements; nothing if it marks no article."""
    page = parse(source)
    labels, c = own_labels(page), Counter()
    for x, y in zip(page.nodes, labels or []):
        if y is None:
            continue
        c.update((f, y) for f in features(x))
        c[("state", y)] += 1
        if x.parent >= 0 and labels[x.parent] is not None and page.nodes[x.parent].tag not in TOP:
            c[("child of content" if labels[x.parent] else "child of boilerplate", y)] += 1
    return c


def fit(pages: DataFrame, max_pages: int = 3000) -> Model:
    """Learn from at most ``max_pages`` pages that mark their article, taken by the hash of page_id.

    Without such pages the priors alone decide.
    """
    ship_package(pages.sparkSession)
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)\\b|articlebody")).select("page_id", "html")
    ids = marked.select("page_id").where("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            for source in pdf["html"]:
                c.update(count_labels(source or ""))
            yield pd.DataFrame([(f, y, n) for (f, y), n in c.items()], columns=["feature", "content", "n"])

    sample = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").select("html")
    counted = sample.mapInPandas(count, "feature string, content boolean, n long").groupBy("feature", "content").agg(F.sum("n").alias("n"))
    return model_of({(r["feature"], r["content"]): r["n"] for r in counted.collect()})


def model_of(counts: dict[tuple[str, bool], int]) -> Model:
    """Weights from counts of (feature, content) and the priors."""
    total = {y: counts.get(("state", y), 0) for y in (True, False)}
    both = max(sum(total.values()), 1)
    priors = {f"tag={t}": w for t, w in PRIOR_TAGS.items()}
    priors |= {f"word={w}": PRIOR_CONTENT for w in CONTENT_WORDS} | {f"word={w}": PRIOR_BOILERPLATE for w in BOILERPLATE_WORDS}
    weights = {}
    for f in {f for f, _ in counts if "=" in f} | set(priors):
        good, bad = counts.get((f, True), 0), counts.get((f, False), 0)
        if f in priors or f.startswith("word="):
            # As if so many elements of an even mix of both states had been seen, in these shares.
            seen = PRIOR_SEEN if f in priors else EVEN_SEEN
            share = 1 / (1 + math.exp(-priors.get(f, 0.0)))
            even = both / 2
            good, bad = good * even / max(total[True], 1), bad * even / max(total[False], 1)
            weights[f] = math.log((good + seen * share) / (bad + seen * (1 - share)))
        else:
            common = BLUR * (good + bad + 1) / both
            odds = ((1 - BLUR) * good / max(total[True], 1) + common) / ((1 - BLUR) * bad / max(total[False], 1) + common)
            weights[f] = TEMPER * math.log(odds)
    # Children take after their parents, in boilerplate more than in content; pseudo-counts stand for pages not seen.
    share = {}
    for p, (good, bad) in {"content": (15, 5), "boilerplate": (1, 50)}.items():
        good, bad = good + counts.get((f"child of {p}", True), 0), bad + counts.get((f"child of {p}", False), 0)
        share[p] = min(max(good / (good + bad), 0.002), MOST_ALIKE)
    t = ((1 - share["boilerplate"], share["boilerplate"]), (1 - share["content"], share["content"]))
    return Model(weights, t, 0.9)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """Per row: page_id, url, text (blocks joined by two line ends; empty if none), n_chars.

    Null and empty html give empty text; repeated rows are handled each; whole pages are read.
    Other columns aren't looked at.  An empty table gives an empty result.
    """

    def make():
        def work(sources: list[str]) -> dict:
            texts = [model.text(s) for s in sources]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_texts(pages.select("page_id", "url", "html"), "html", make, "text string, n_chars long")
