"""Main text of web pages by a minimum cut between content and boilerplate.

A page is cut into blocks: runs of text between the tags that break lines. A classifier gives each block the log-odds of
being content, and these are its capacity to the source (content) or the sink (boilerplate). Two parts add up to them:

- words, links and sentence marks of the block, and how surely names in class and id speak of a side part, with weights
  that are fitted by logistic regression. Blocks in landmark tags (article and main; nav, footer, aside and the
  like) are the labelled ones; FIT_PAGES pages by hash, and FIT_BLOCKS of their blocks, are the bounded sample. The weights
  are drawn to PRIOR, which they are without a sample. What words say counts in full from FULL words on;
- bounded log-odds of landmark tags and of content names.

A name tells more the more of it speaks of a side part: all of sidebar and of cookie-notice, a third of share-price-report, and
nothing of has-comments, which is a state. What a name or a tag says fades on an element that holds most of the page's sentences.

Where a block is tells by the edges alone. Smoothness edges join blocks that follow each other, the more so the nearer they are
in the tree, and each block to its holder, the element around it. Holders are nodes of their own: those inside the part of the page that
holds most sentences have a capacity to the source, those apart from it one to the sink, unless they hold many sentences too. A maximum flow separates
the two labels at least cost. So a short line between paragraphs is content though its own words do not tell, a sentence among links is
not, and neither is one that stands alone far from the text. What the cut leaves open (a tie) is boilerplate. The content blocks' text is joined in page order.

Null and empty pages, and pages without text, have an empty text. Broken markup is read as browsers do in the main:
unclosed tags end with what holds them, an angle bracket without a name is text. Whole pages are read, of any length and
depth, in time that grows with the length. Repeated rows get rows each; rows without a page_id are rows like others.
Without pages the result is empty. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_session

#: Fixed values.
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("script style noscript template iframe object applet svg math canvas audio video select option optgroup datalist button textarea input head title noembed noframes xmp".split())
SIDE_TAGS = frozenset("nav aside footer form menu dialog search fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status note".split())
SIDE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promos promotion promoted sidebar sidebars aside rail widget widgets comment comments commentlist respond disqus discussion replies reply cookie cookies consent gdpr notice notices notification notifications alert disclaimer nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pagination pager footer foot masthead topbar toolbar header share sharing social socials related recommended recommendations newsletter subscribe subscription signup signin login register popup modal overlay paywall search searchbox skip skiplink tags taglist copyright legal outbrain taboola".split())
CONTENT_NAMES = frozenset("article content post entry story main body text articlebody postcontent entrycontent maincontent".split())
READERS = frozenset("comment comments commentlist respond disqus discussion replies reply".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
LIST_ENDS = frozenset("ul ol dl table select".split())
WRAPS = frozenset("form fieldset header".split())
SECTIONS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
TAG_END = re.compile(r"[^\"'>]*(?:(?:\"[^\"]*\"|'[^']*')[^\"'>]*)*>")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]")
WHITE = re.compile(r"\s+")
MARKS, ENDS = ".!?。！？;:,", ".!?。！？\"”»"

#: Parts of names that do not tell a role, and such that make a name a state.
PLAIN_NAMES = frozenset("list box area wrap wrapper container block section item items inner outer top bottom left right col column row widget id js module panel group bar".split())
STATES = frozenset("has have with without no not is show hide hidden enable enabled disable disabled allow can".split())
#: Weights without a sample: of 1, ln(1 + words), the share of link text, sentence marks up to 3, a mark at the end, a heading, and how surely names speak of a side.
PRIOR = (-2.0, 0.9, -4.0, 0.4, 0.6, 1.5, -6.0)
#: Log-odds of places: of a side's tags, and of content landmarks and names. What the words say is MOST at most, in full from FULL words on.
PLACE = {"side": -6.0, "landmark": 1.5, "name": 1.0}
MOST, FULL = 4.0, 8
#: The share of the page's sentences that its main part has, that which keeps a part from being apart from it, and words of a sentence.
MAIN, MANY, SENTENCE = 0.6, 0.3, 8
#: Costs of parting blocks that follow each other (SMOOTH for siblings, less by DECAY for each step more, FAR at least and beyond a landmark), and a block and its holder.
SMOOTH, DECAY, FAR, HOLD, STEPS = 1.5, 4.0, 0.1, 4.0, 6
#: Elements whose block is held by what is around them.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption summary option center".split())
FIT_PAGES, FIT_BLOCKS = 1000, 20_000


def side_name(name: str) -> tuple[float, bool]:
    """How much of a name speaks of a side part, and whether it speaks of readers' comments."""
    words = [w for w in (x.lower() for part in re.split(r"[\s_-]+", name) for x in ([part] if part.lower() in SIDE_NAMES else NAME.findall(part)))]
    if not words or words[0] in STATES:
        return 0.0, False
    telling = [w for w in words if w not in PLAIN_NAMES or w in SIDE_NAMES and len(words) == 1]
    side = [w for w in telling if w in SIDE_NAMES]
    return (len(side) / len(telling) if telling else 0.0), bool(set(side) & READERS)


class Node:
    """An element of the page. told: the nearest landmark tag; tagged and spoken: how surely its own tag and names are of a side; raw: its names with those of what holds it; tag_side and name_side: what is left of these where they wrap the text; sentences: characters of them; pull: from -1, apart from the main part, to 1, inside."""

    __slots__ = ("tag", "up", "depth", "never", "link", "heading", "content", "named", "tagged", "spoken", "tag_side", "name_side", "length", "sentences", "n", "told", "apart", "pull", "holder", "raw")

    def __init__(self, tag: str, up: Node | None, attributes: str):
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        self.never = tag in NEVER or bool(up and up.never)
        self.link = tag == "a" or bool(up and up.link)
        self.content = tag in CONTENT_TAGS or bool(up and up.content)
        self.named = bool(up and up.named)
        self.heading = tag in HEADINGS or bool(up and up.heading and tag not in BLOCK_TAGS)
        self.told = tag if tag in CONTENT_TAGS | SIDE_TAGS else up.told if up else ""
        self.apart = tag in SIDE_TAGS - WRAPS or bool(up and up.apart)
        self.holder = self if tag in BLOCK_TAGS and tag not in LINES or not up else up.holder
        self.tagged = 1.0 if tag in SIDE_TAGS or tag == "header" and not self.content else 0.0
        self.spoken = self.tag_side = self.name_side = self.pull = 0.0
        self.length = self.sentences = self.n = 0
        self.raw = up.raw if up else 0.0
        if not attributes:
            return
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" and tag not in ("html", "body") or HIDDEN.search(found.get("style", "")):
            self.never = True
        if found.get("role", "").lower() in SIDE_ROLES:
            self.tagged = 1.0
        if tag in ("html", "body", "main"):
            return
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        if not (tag == "header" and self.content):
            self.spoken = max((side_name(n)[0] for n in names), default=0.0)
        self.raw = max(self.raw, self.spoken)
        if not self.spoken and any(w.lower() in CONTENT_NAMES for n in names for w in NAME.findall(n)):
            self.named = True


class Block:
    __slots__ = ("parts", "at", "link", "text")

    def __init__(self, at: Node):
        self.parts: list[str] = []
        self.at, self.link, self.text = at, 0, ""


class Tree:
    """What is open while a page is read, and what was found."""

    def __init__(self):
        self.nodes = [Node("#page", None, "")]
        self.stack, self.opened = [self.nodes[0]], Counter()
        self.found: list[Block] = []
        self.fresh = True

    def text(self, s: str) -> None:
        top = self.stack[-1]
        if top.never or self.fresh and not s.strip():
            return
        if self.fresh:
            self.found.append(Block(top))
            self.fresh = False
        self.found[-1].parts.append(s)
        if top.link:
            self.found[-1].link += len(s.strip())

    def cut(self, i: int) -> None:
        self.opened.subtract(x.tag for x in self.stack[i:])
        del self.stack[i:]

    def close(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                return self.cut(i)
            if tag not in BLOCK_TAGS and self.stack[i].tag in BLOCK_TAGS and tag != "a":
                return

    def open(self, tag: str, attributes: str) -> None:
        stack = self.stack
        if tag in CLOSES:
            if any(self.opened[t] for t in CLOSES[tag]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in LIST_ENDS and not (tag in ("tr", "td", "th", "tbody", "thead") and stack[i].tag != "table"):
                        break
                    if stack[i].tag in CLOSES[tag]:
                        self.cut(i)
                        if tag not in ("tr", "tbody") or not any(self.opened[t] for t in CLOSES[tag]):
                            break
        elif tag in SECTIONS and self.opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    self.cut(i)
                    break
                if stack[i].tag in SECTIONS or stack[i].tag in ("td", "th", "li"):
                    break
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK_TAGS and tag not in RAW:
            return
        node = Node(tag, stack[-1], attributes)
        self.nodes.append(node)
        stack.append(node)
        self.opened[tag] += 1


def read(html: str) -> Tree:
    """The page's blocks of text and its elements, in order. Each place of the page is passed a bounded number of times."""
    tree = Tree()
    start = pos = 0  # start: of text that was not taken yet
    n, quotes = len(html), True
    while (at := html.find("<", pos)) >= 0:
        if html.startswith(("<!", "<?"), at):
            mark, skip = ("-->", 4) if html.startswith("<!--", at) else ("]]>", 9) if html.startswith("<![CDATA[", at) else (">", 2)
            end = html.find(mark, at + skip)
            tree.text(unescape(html[start:at]))
            if mark == "]]>":
                tree.text(html[at + 9 : end if end >= 0 else n])
            start = pos = end + len(mark) if end >= 0 else n
            continue
        name = TAG_NAME.match(html, at)
        if not name:
            pos = at + 1
            continue
        whole = TAG_END.match(html, name.end()) if quotes else None
        quotes = whole is not None  # once a quote is never closed, tags end at the next bracket
        stop = whole.end() if whole else html.find(">", name.end()) + 1
        if not stop:
            break
        tree.text(unescape(html[start:at]))
        start = pos = stop
        tag = name[2].lower()
        if tag in BLOCK_TAGS:
            tree.fresh = True
        if name[1]:
            tree.close(tag)
            continue
        tree.open(tag, html[name.end() : stop - 1])
        if tag in RAW:
            end = RAW_END[tag].search(html, stop)
            start = pos = end.start() if end else n
    tree.text(unescape(html[start:]))
    for b in tree.found:
        b.text = WHITE.sub(" ", "".join(b.parts)).strip()
    tree.found = [b for b in tree.found if b.text]
    weigh(tree)
    return tree


def like_a_sentence(b: Block) -> bool:
    words = b.text.count(" ") + 1
    return 2 * b.link < len(b.text) and (words >= 2.5 * SENTENCE or words >= SENTENCE and b.text[-1] in ENDS)


def weigh(tree: Tree) -> None:
    """Lengths and sentences go up the tree; then how surely a side each element is goes down, and the part with most sentences is found."""
    sentences = [b for b in tree.found if not b.at.apart and like_a_sentence(b)]
    for b in tree.found:
        b.at.length += len(b.text)
    if any(b.at.raw < 1 and not b.at.apart for b in tree.found):  # else such a name holds all of the page
        sentences = [b for b in sentences if b.at.raw < 1]
    for b in sentences:
        b.at.sentences += len(b.text)
        b.at.n += 1
    for x in reversed(tree.nodes[1:]):
        x.up.length += x.length
        x.up.sentences += x.sentences
        x.up.n += x.n
    total, main = max(1, tree.nodes[0].sentences), tree.nodes[0]
    for x in tree.nodes:
        held = x.sentences / total
        fade = lambda sure, held=held: max(0.0, min(1.0, (0.98 - held) / 0.08 if sure else (0.9 - held) / 0.4))
        x.tag_side = max(x.tagged * fade(x.tag not in WRAPS), x.up.tag_side if x.up else 0.0)
        x.name_side = max(x.spoken * fade(x.spoken == 1.0), x.up.name_side if x.up else 0.0)
        if held >= MAIN and x.n > 1 and x.depth >= main.depth:
            main = x
    above: Node | None = main
    around = set()
    while above:
        around.add(id(above))
        above = above.up
    # Where no part is the main one, all is inside; a page without sentences is content as far as it is no links.
    inner = float(main.tag not in ("#page", "html", "body"))
    if not tree.nodes[0].sentences:
        inner = 1 - sum(b.link for b in tree.found) / max(1, tree.nodes[0].length)
    for x in tree.nodes:
        if x is main:
            x.pull = inner
        elif id(x) not in around:
            # What is apart from the main part is so with all that it holds.
            x.pull = x.up.pull if x.up.pull or id(x.up) == id(main) else -max(0.0, 1 - x.sentences / total / MANY)
        side = max(x.tag_side, x.name_side)
        if side:
            x.pull = min(x.pull, -side)


def described(b: Block) -> tuple[float, ...]:
    """What is fitted: the block's words, links and marks, and names."""
    words, marks = b.text.count(" ") + 1, sum(map(b.text.count, MARKS))
    return 1.0, log1p(words), min(1.0, b.link / len(b.text)), float(min(3, marks)), float(b.text[-1] in ENDS), float(b.at.heading), b.at.name_side


def landmark(b: Block) -> int | None:
    """What landmark tags alone say: 1 is content, 0 boilerplate, None nothing."""
    told = b.at.told
    if not told:
        return None
    side = max(b.at.tag_side, b.at.name_side) == 1.0
    return None if side == (told in CONTENT_TAGS) else int(told in CONTENT_TAGS)


def log_odds(found: list[Block], weights: tuple[float, ...]) -> list[float]:
    """Each block's log-odds of being content, from its words, names and tags."""
    out = []
    for b in found:
        x = described(b)
        words = sum(w * v for w, v in zip(weights[:6], x))
        place = weights[6] * x[6] + PLACE["side"] * b.at.tag_side
        if max(b.at.tag_side, b.at.name_side) < 1:
            place += PLACE["landmark"] if b.at.content else PLACE["name"] if b.at.named else 0.0
        out.append(max(-MOST, min(MOST, words)) * min(1.0, (b.text.count(" ") + 1) / FULL) + place)
    return out


def steps_between(a: Node, b: Node) -> int:
    """Steps from one element to another in the tree; STEPS + 1 if there are more."""
    n = 0
    while a is not b and n <= STEPS:
        n += 1
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
    return n


def source_side(n: int, edges: list[tuple[int, int, float, float]], s: int, t: int) -> list[bool]:
    """The nodes on the source's side of a minimum cut, by Dinic's maximum flow. edges: (u, v, capacity, capacity back)."""
    head: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for u, v, c, back in edges:
        head[u].append(len(to))
        to.append(v)
        cap.append(c)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)
    while True:
        level = [-1] * n
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level]
        turn, path, u = [0] * n, [], s
        while True:  # depth first over the levels, without recursion
            if u == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                cut = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[u] < len(head[u]):
                e = head[u][turn[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                turn[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                turn[u] += 1


def labels(found: list[Block], odds: list[float]) -> list[bool]:
    """Which blocks are content, by the minimum cut."""
    n = len(found)
    holds: dict[int, int] = {}
    pulls: Counter = Counter()
    edges: list[tuple[int, int, float, float]] = []
    for i, (b, x) in enumerate(zip(found, odds)):
        edges.append((n, i, x, 0.0) if x > 0 else (i, n + 1, -x, 0.0))
        holder = b.at.holder
        node = holds.setdefault(id(holder), n + 2 + len(holds))
        pulls[node] += HOLD * holder.pull
        edges.append((i, node, HOLD, HOLD))
        if i:
            before = found[i - 1].at
            steps = steps_between(before, b.at)
            weight = max(FAR, SMOOTH / DECAY ** max(0, steps - 2))
            if (before.tag_side, before.name_side, before.content) != (b.at.tag_side, b.at.name_side, b.at.content):
                weight = min(weight, FAR)
            edges.append((i - 1, i, weight, weight))
    edges += [(n, node, x, 0.0) if x > 0 else (node, n + 1, -x, 0.0) for node, x in pulls.items() if x]
    return source_side(n + 2 + len(holds), edges, n, n + 1)[:n]


def main_text(html: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    found = read(html or "").found
    return " ".join(b.text for b, content in zip(found, labels(found, log_odds(found, weights))) if content)


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton's method, both labels with the same weight, drawn to PRIOR by a unit normal distribution; so a few rows change little."""
    prior = np.array(PRIOR)
    if not len(y):
        return PRIOR
    share, w = np.where(y == 1, 0.5 * len(y) / max(1, np.sum(y == 1)), 0.5 * len(y) / max(1, np.sum(y == 0))), prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (share * (y - p)) - (w - prior))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(np.round(w, 6).tolist())


def sample(pages: DataFrame) -> DataFrame:
    """(x, y) of labelled blocks: of about FIT_PAGES different pages by hash, and of FIT_BLOCKS blocks at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(described(b), y) for b in read(html or "").found if (y := landmark(b)) is not None][:FIT_BLOCKS]
                if rows:
                    x, y = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(x), pa.int64()), pa.array(range(len(x)), pa.int32()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["key", "place", "x", "y"])

    key = F.xxhash64(F.col("html").cast("string"))
    some = pages.select(key.alias("key"), F.col("html").cast("string").alias("html")).where(F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(max(pages.count(), 1))) < FIT_PAGES).dropDuplicates(["key"])
    return some.mapInArrow(run, "key long, place int, x array<double>, y int").orderBy("key", "place").limit(FIT_BLOCKS).select("x", "y")


def fit(pages: DataFrame) -> tuple[float, ...]:
    """Weights of words, links and marks, from a bounded sample of the pages."""
    rows = sample(pages).collect()  # FIT_BLOCKS at most
    return fitted(np.array([r.x for r in rows]).reshape(-1, len(PRIOR)), np.array([r.y for r in rows]))


def extracted(pages: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each page. weights: those of an earlier fit(), so that later pages are treated alike."""
    lean_session(pages.sparkSession)
    own = fit(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h, own) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
