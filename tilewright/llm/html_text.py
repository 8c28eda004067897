"""HTML extraction by minimum cut.

A page is cut into blocks: runs of text between block-level tags, character references decoded and white space
closed up. A logistic classifier over a block's own text and its ancestors' names, classes and roles gives each
block a cost of being content and of being boilerplate; these are the terminal capacities. Blocks next to each other
and blocks close in the tree are tied by smoothness edges. The maximum flow from content to boilerplate finds the
cheapest cut; the blocks on the content side are the text, in page order, joined by two line ends.

Scripts, styles, comments, templates, the head and what RAW_TAGS names are no blocks. Unclosed scripts, styles and
comments reach to the end; of others of RAW_TAGS only the tag is left out where nothing closes it, and an open head ends
at the first element or text that cannot stand in it. Null html is the empty page; a page without content has the empty text. Rows are independent: repeated rows stay, an empty table
gives an empty one. The classifier is trained on a small set of labelled pages that ``training_blocks`` makes.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, deque
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Names of elements.
BLOCK_TAGS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW_TAGS = frozenset("script style noscript template svg textarea title iframe canvas audio video".split())
HEAD_TAGS = frozenset("html head base basefont bgsound link meta title script style noscript noframes template".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - {"button"}
#: Words in classes, ids and roles.
BAD_WORDS = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar side aside footer bottom comment comments disqus reply replies respond responses discussion share sharing social related recommended cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe subscription signup login search breadcrumb breadcrumbs pagination pager widget toolbar tags meta copyright legal masthead topbar header complementary contentinfo dialog form feedback rating".split())
GOOD_WORDS = frozenset("article main content post entry story body text maintext prose".split())
BAD_STEMS = ("advert", "sponsor", "promo", "banner", "sidebar", "comment", "cookie", "newslet", "subscri", "breadcrumb", "popup", "related", "social", "footer", "navbar")
LIGHT = {"header", "meta", "side", "bottom", "body", "form", "text", "warning", "rating"}

_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_TAG_END = re.compile(r"""[^'">]*(?:(?:"[^"]*"|'[^']*')[^'">]*)*>""")
_WORDS = re.compile(r"[a-z]+")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")


class Element:
    """An open element; deep pages share their ancestors instead of carrying a path each."""

    __slots__ = ("name", "serial", "marks", "above", "depth", "block", "in_head")

    def __init__(self, name: str, serial: int, marks: frozenset[str], above: Element | None):
        self.name, self.serial, self.marks, self.above = name, serial, marks, above
        self.depth = above.depth + 1 if above else 1
        self.block = name if name in BLOCK_TAGS else above.block if above else "body"  # the nearest block-level name
        self.in_head = name == "head" or bool(above and above.in_head)


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    at: Element  # the innermost open element
    features: list[str] = field(default_factory=list)

    @property
    def marks(self) -> frozenset[str]:  # what the ancestors say
        return self.at.marks


class OpenElements:
    """The open elements, with how many there are of each name, so that a search for an absent one costs nothing."""

    def __init__(self) -> None:
        self.root = Element("", 0, frozenset(), None)
        self.stack: list[Element] = []
        self.count: Counter[str] = Counter()

    def top(self) -> Element:
        return self.stack[-1] if self.stack else self.root

    def push(self, name: str, serial: int, attributes: str) -> None:
        self.stack.append(Element(name, serial, _marks(name, attributes, self.top().marks), self.top()))
        self.count[name] += 1

    def close_from(self, i: int) -> None:
        self.count.subtract(e.name for e in self.stack[i:])
        del self.stack[i:]

    def close(self, names: Container[str], until: Container[str]) -> None:
        """Close the innermost element of these names and all in it, unless one of ``until`` comes before."""
        if not any(self.count[n] > 0 for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i].name
            if name in names:
                return self.close_from(i)
            if name in until:
                return None


def _marks(name: str, attributes: str, above: frozenset[str]) -> frozenset[str]:
    """What an element adds to what its ancestors say."""
    out = set()
    if name in ("nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "fieldset"):
        out.add("bad:tag")
        out.add(f"bad:{name}")
    elif name == "header":
        out.add("soft:header" if "good:tag" in above else "bad:header")
    elif name in ("article", "main"):
        out.add("good:tag")
        above = frozenset(x for x in above if x not in ("bad:form", "bad:tag")) if "bad:form" in above else above
    if attributes and (found := _ATTRIBUTE.findall(attributes)):
        words = set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(v.strip("\"'") for _, v in found)).lower()))
        bad = {w for w in words if w in BAD_WORDS or w.startswith(BAD_STEMS)}
        good = words & GOOD_WORDS
        if bad and not (good and bad <= LIGHT) and not (bad <= LIGHT and "good:tag" in above) and name not in ("body", "html", "article", "main"):
            out.add("bad:word")
        elif good:
            out.add("good:word")
    return above | out if out else above


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; text that is only white space makes none."""
    out: list[Block] = []
    opened = OpenElements()
    stack = opened.stack
    parts: list[str] = []
    linked, serial, at, n = 0, 0, 0, len(page)
    where: Element | None = None
    never_closed: set[str] = set()

    def end_head() -> None:
        i = len(stack) if opened.count["head"] else 0
        while i and stack[i - 1].name in HEAD_TAGS:  # nothing else stands in an open head
            i -= 1
            if stack[i].name == "head":
                end_block()
                opened.close_from(i)

    def end_block() -> None:
        nonlocal linked, where
        if parts:
            text = " ".join("".join(parts).split())
            if text and where is not None:
                out.append(Block(text, min(linked, len(text)), where))
            parts.clear()
        linked, where = 0, None

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = page[at:lt]
            if not text.isspace() or parts:
                if where is None and not text.isspace():
                    if opened.top().name == "head":
                        end_head()
                    where = opened.top()
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                if opened.count["a"]:
                    linked += len(text)
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        c = page[lt + 1 : lt + 2]
        if c in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = c == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if closing:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                if where is None:
                    where = opened.top()
                parts.append("<")
                at = lt + 1
            continue
        name = m[0].lower()
        e = _TAG_END.match(page, m.end())
        end = e.end() - 1 if e else page.find(">", m.end())
        if end < 0:
            break  # a tag that the page's end cuts off
        attributes = page[m.end() : end]
        at = end + 1
        if name == "br":
            parts.append(" ")
            continue
        if closing:
            if name in BLOCK_TAGS:
                end_block()
            opened.close((name,), () if name in BLOCK_TAGS else BLOCK_TAGS)
            continue
        if name not in HEAD_TAGS:
            end_head()
        if name in RAW_TAGS and not attributes.endswith("/") and name not in never_closed:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if close or name in ("script", "style"):
                at = close.end() if close else n
                continue
            never_closed.add(name)
        if name in BLOCK_TAGS:
            end_block()
            if name in CLOSES_P:
                opened.close(("p",), BLOCK_TAGS)
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = {"dt", "dd"} if name in ("dt", "dd") else {"td", "th"} if name in ("td", "th") else {name}
                opened.close(same, ("ul", "ol", "dl", "table", "select", "menu", "div", "section", "article"))
        if name not in VOID_TAGS and not (attributes.endswith("/") and name not in BLOCK_TAGS):
            serial += 1
            opened.push(name, serial, attributes)
    end_block()
    return [b for b in out if not b.at.in_head]


def describe(all_blocks: list[Block]) -> None:
    """Fill in each block's features."""
    for b in all_blocks:
        n = len(b.text)
        words = b.text.count(" ") + 1
        link = b.linked / n
        tag = b.at.block
        f = ["bias", f"len{min(8, int(math.log2(n)))}", f"words{min(6, int(math.log2(words)))}", "linked" if link > 0.5 else "some_links" if link > 0.1 else "no_links", f"tag:{tag if len(tag) < 3 or tag in ('div', 'body', 'pre', 'blockquote') else 'other'}"]
        if b.text[-1:] in ".!?…:\"')”»。":
            f.append("ends")
        if b.text[:1] in "©" or "©" in b.text[:40]:
            f.append("copyright")
        if b.text.count(",") > 1:
            f.append("commas")
        b.features = f + ["own:" + x for x in f[1:4] if not b.marks] + sorted(b.marks) + ([] if any(x.startswith("bad") for x in b.marks) else ["no_bad"])


@dataclass
class PageModel:
    weights: dict[str, float]
    most: float = 8.0
    near: float = 0.8

    def odds(self, b: Block) -> float:
        z = sum(self.weights.get(f, 0.0) for f in b.features)
        return max(-self.most, min(self.most, z))

    def content(self, all_blocks: list[Block]) -> list[bool]:
        """The content side of the minimum cut."""
        describe(all_blocks)
        return min_cut([self.odds(b) for b in all_blocks], ties(all_blocks, self.near))

    def text(self, page: str | None) -> str:
        found = blocks(page or "")
        return "\n\n".join(b.text for b, keep in zip(found, self.content(found), strict=True) if keep)


def ties(all_blocks: list[Block], near: float) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block to the one before it, and to the last ones before under its parent and grandparent.

    The weight falls with the steps through the tree between them, and is small where the ancestors say different things.
    Steps are counted along the tree: over a page as many as it has elements, and at most four to a relative.
    """
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(all_blocks):
        near_by = [e for e in (b.at.above, b.at.above and b.at.above.above) if e]
        tied = {last[e.serial] for e in near_by if e.serial in last} | ({i - 1} if i else set())
        for j in tied:
            a = all_blocks[j]
            weight = near * math.exp(-(max(_steps(a.at, b.at), 2) - 2) / 2) * (1.0 if a.marks == b.marks else 0.15)
            out.append((j, i, weight))
        for e in near_by:
            last[e.serial] = i
    return out


def _steps(a: Element, b: Element) -> int:
    """Edges of the tree between two elements."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.above
        else:
            b = b.above
        n += 1
    return n


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side: positive odds are capacity from the source, negative ones to the sink.

    Augmenting paths, each found backwards from a node that still needs flow. What a search without an end has seen no
    source reaches any more, so later searches leave it out: the work is that of the paths found and one pass over the
    rest. Zero odds and nothing upstream: the sink's side.
    """
    n = len(odds)
    spare = [max(0.0, o) for o in odds]
    need = [max(0.0, -o) for o in odds]
    if not any(need):
        return [o > 0 for o in odds]
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        room[a][b] = room[a].get(b, 0.0) + w
        room[b][a] = room[b].get(a, 0.0) + w
    small = 1e-9
    cut_off = [False] * n
    for goal in range(n):
        while need[goal] > small and not cut_off[goal]:
            onward, queue, start = {goal: -1}, deque([goal]), -1
            while queue:
                i = queue.popleft()
                if spare[i] > small:
                    start = i
                    break
                for j in room[i]:
                    if j not in onward and not cut_off[j] and room[j][i] > small:
                        onward[j] = i
                        queue.append(j)
            if start < 0:
                for i in onward:
                    cut_off[i] = True
                break
            flow, i = min(spare[start], need[goal]), start
            while onward[i] >= 0:
                flow = min(flow, room[i][onward[i]])
                i = onward[i]
            spare[start] -= flow
            need[goal] -= flow
            i = start
            while onward[i] >= 0:
                j = onward[i]
                room[i][j] -= flow
                room[j][i] += flow
                i = j
    reached = [s > small for s in spare]
    queue = deque(i for i in range(n) if reached[i])
    while queue:
        i = queue.popleft()
        for j, r in room[i].items():
            if r > small and not reached[j]:
                reached[j] = True
                queue.append(j)
    return reached


# --- the training set


def training_blocks(pages: int = 240, seed: int = 7) -> list[tuple[list[str], int]]:
    """Features and labels of blocks of made-up pages with every kind of boilerplate, in semantic or class markup."""
    rng = random.Random(seed)
    syllables = "an be co di el fo ga hi in jo ka le mo ne or pa re si ta un".split()

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    def sentence() -> str:
        return ", ".join(words(rng.randint(1, 12)) for _ in range(rng.randint(1, 4))).capitalize() + "."

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(rng.randint(1, 3))}</a></li>' for i in range(rng.randint(3, 7))) + "</ul>"

    bad = [
        lambda: ("nav", rng.choice(["menu", "nav", "navbar", "breadcrumb"]), links()),
        lambda: ("header", rng.choice(["header", "masthead", "topbar"]), f"<p>{words(4)}</p>" + links()),
        lambda: ("footer", rng.choice(["footer", "copyright", "legal"]), f"&copy; {words(3)} {sentence()}"),
        lambda: ("aside", rng.choice(["sidebar", "related", "widget"]), f"<h3>{words(3)}</h3>" + links() + f"<p>{sentence()}</p>"),
        lambda: ("aside", rng.choice(["ad", "ads", "advert", "sponsored", "promo"]), f"<p>{sentence()}</p>"),
        lambda: ("div", rng.choice(["ad", "ads", "advert", "banner", "sponsored"]), sentence()),
        lambda: ("div", rng.choice(["cookie", "notice", "consent", "popup", "alert"]), f"{sentence()} <button>{words(1)}</button>"),
        lambda: ("form", rng.choice(["login", "newsletter", "search", "subscribe"]), f"<p>{sentence()}</p><label>{words(2)}</label><input>"),
        lambda: ("section", rng.choice(["comments", "comment", "responses"]), "".join(f"<div><p>{sentence()} {sentence()}</p></div>" for _ in range(rng.randint(1, 5)))),
        lambda: ("div", rng.choice(["share", "social", "tags", "pagination"]), links()),
    ]
    out = []
    for _ in range(pages):
        semantic = rng.random() < 0.6

        def part(label: int, tag: str, word: str, inner: str) -> str:
            if semantic and tag != "div" and rng.random() < 0.5:
                return f"<{tag} data-y={label}>{inner}</{tag}>"
            return f'<{tag if semantic else "div"} data-y={label} class="{word}">{inner}</{tag if semantic else "div"}>'

        body = f"<h1>{words(rng.randint(2, 9))}</h1>" + "".join(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>"]).format(" ".join(sentence() for _ in range(rng.randint(1, 6)))) for _ in range(rng.randint(2, 12)))
        if rng.random() < 0.5:
            body += part(0, *rng.choice(bad[3:])())
        kind = rng.random()
        if semantic:
            main = f"<article>{body}</article>" if kind < 0.7 else f"<main>{body}</main>"
        else:
            main = f'<div class="{rng.choice(["article", "post", "entry content", "story", "main"])}">{body}</div>' if kind < 0.7 else f"<div>{body}</div>"
        before = [part(0, *b()) for b in rng.sample(bad[:7], rng.randint(1, 3))]
        after = [part(0, *b()) for b in rng.sample(bad[2:], rng.randint(1, 4))]
        page = "".join([*before, main, *after])
        # labels travel as a word in front of each boilerplate part's blocks: they are read off the tree instead
        marked = re.sub(r"<(\w+) data-y=0", r"<\1 data-y", page)
        found = blocks(marked)
        zones = _zones(marked)
        describe(found)
        for b in found:
            y = 0 if any(e.serial in zones for e in _line(b.at)) else 1
            out.append((b.features, y))
            out.append(([f for f in b.features if ":" not in f or f.startswith("tag:")], y))  # as if nothing was marked
    return out


def _line(e: Element | None) -> Iterator[Element]:
    """An element and its ancestors."""
    while e:
        yield e
        e = e.above


def _zones(page: str) -> set[int]:
    """Numbers (as in ``Element.serial``) of the elements with a data-y attribute."""
    serial, out = 0, set()
    for m in re.finditer(r"<([a-z][a-z0-9]*)([^>]*)>", page):
        if m[1] not in VOID_TAGS:
            serial += 1
            if "data-y" in m[2]:
                out.add(serial)
    return out


def train(data: list[tuple[list[str], int]] | None = None, steps: int = 300, rate: float = 1.0, ridge: float = 2e-4) -> PageModel:
    """Logistic regression by gradient descent on the small labelled set."""
    data = training_blocks() if data is None else data
    names = sorted({f for fs, _ in data for f in fs})
    at = {f: i for i, f in enumerate(names)}
    row = np.repeat(np.arange(len(data)), [len(f) for f, _ in data])
    col = np.array([at[f] for fs, _ in data for f in fs])
    y = np.array([label for _, label in data], float)
    w = np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(row, w[col], len(data))))
        w -= rate * (np.bincount(col, (p - y)[row], len(names)) / len(data) * 8 + ridge * w)
    return PageModel(dict(zip(names, w.tolist(), strict=True)))


def extract(pages: DataFrame, model: PageModel | None = None, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, text and n_chars of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    return pages.select(*keep, source).mapInArrow(run, f"{kinds}, text string, n_chars long")
