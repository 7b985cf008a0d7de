"""Main text by a tree-structured graphical model over the DOM (operator 9)."""

from __future__ import annotations

import functools
import html
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import sliced

# HTML's element classes, as far as they matter for blocks of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
ASIDE = frozenset("svg template noscript".split())  # a run of text goes on after them
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "math semantics annotation mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS_AT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SPACE = re.compile(r"[ \t\n\r\f\v ]+")

# Attributes as HTML has them: a quote opens a value only right after the equals sign that follows a name; elsewhere it's a letter.
_VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+|(?=>|\Z))"""
_ATTRS = rf"(?:[\s/]++|(?:=[^\s>/=]*+|[^\s>/=]++)(?:\s*+=\s*+{_VALUE})?+)*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})(?:>|\Z)", re.S)
# Start tags that end an open svg: such an element can't stand in one.
ENDS_SVG = CLOSES_P | frozenset("body br dd dt embed head hr img li meta b big code em i s small span strike strong sub sup tt u var".split())
ATTR = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""")
NAMES = re.compile(r"[a-z]+")


@dataclass
class Node:
    """An element that is not inline, or a run of text (``tag`` '#')."""

    tag: str
    parent: int
    names: tuple[str, ...] = ()
    mark: str = ""
    text: list[str] = field(default_factory=list)
    linked: int = 0


_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


def parse(page: str) -> list[Node]:
    """The page as a list of nodes, parents before children, in page order.

    Inline elements don't make nodes; a run of text ends where an element that isn't inline begins or ends. A missing end tag
    is supplied by the next element that can't stand inside; what is cut off at the end of the page ends there.
    """
    nodes, stack, at, run, links = [Node("root", -1)], [0], 0, -1, 0
    outer: dict[int, tuple[int, int]] = {}  # of an open aside: the run of text and the links that it stands in

    def add(text: str) -> None:
        nonlocal run
        if not text:
            return
        if run < 0:
            if not text.strip():
                return
            nodes.append(Node("#", stack[-1]))
            run = len(nodes) - 1
        text = html.unescape(text) if "&" in text else text
        nodes[run].text.append(text)
        if links:
            nodes[run].linked += len(text)

    def close(upto: int) -> None:
        nonlocal run, links
        run, links = outer.get(stack[upto], (-1, 0))
        for k in stack[upto:]:
            outer.pop(k, None)
        del stack[upto:]

    pos, n = 0, len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        add(page[pos : m.start()])
        pos = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in INLINE:
                links = max(0, links - (tag == "a"))
            elif tag == "br":
                add(" ")
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        close(k)
                        break
                else:
                    run = -1
            continue
        closed = m.group(3).rstrip().endswith("/")
        if outer and tag in ENDS_SVG:
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]].tag
                if t == "svg":
                    close(k)
                if t in ("svg", "foreignobject", "desc", "template"):
                    break
        if tag in INLINE:
            links += tag == "a" and not (closed and outer)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in RAW:
            if not (closed and outer):
                end = _RAW_END[tag].search(page, pos)
                # Without an end tag only code goes on to the end of the page.
                pos = end.end() if end else n if tag in ("script", "style") else pos
            continue
        before, run, links = (run, links), -1, 0
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]].tag
                if t == "p":
                    close(k)
                    break
                if t in CLOSES_P or t == "template":
                    break
        elif tag in SAME_ENDS:
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]].tag
                if t in SAME_ENDS[tag]:
                    close(k)
                    break
                if t in STOPS_AT[tag]:
                    break
        attrs = {a.lower(): b or c or d for a, b, c, d in ATTR.findall(m.group(3))} if m.group(3).strip() else {}
        names = tuple(NAMES.findall(f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".lower())) if attrs else ()
        nodes.append(Node(tag, stack[-1], names, attrs.get("y", "")))
        if not closed:
            stack.append(len(nodes) - 1)
            if tag in ASIDE:
                outer[stack[-1]] = before
        elif tag in ASIDE:
            run, links = before
    return nodes


def words_of(node: Node) -> list[str]:
    """What the model sees of a node by itself: tag and class words of an element; length, links and ending of a text."""
    if node.tag != "#":
        return [f"<{node.tag}>", *(f".{w}" for w in node.names)]
    text = "".join(node.text).strip()
    link = node.linked / max(1, len(text))
    return [f"len{min(8, len(text).bit_length())}", f"link{math.ceil(3 * min(1.0, link))}", "end" if text[-1:] in ".!?:;\"'»”)" else "open"]


KINDS = ("#", "p", "box")
SHOWN = 0.05  # of asides, which the labelled pages lack, whatever they stand in: they say nothing of it
#: Training: steps of gradient ascent, and the weight of the penalty on large weights.
STEPS, PENALTY = 120, 0.05


@dataclass(frozen=True)
class Model:
    """Log potentials: of a node's own words, and of a child's state given its parent's, by kind of child."""

    own: dict[str, float]
    edge: dict[str, tuple[tuple[float, float], tuple[float, float]]]

    def messages(self, nodes: list[Node], words: list[list[str]]) -> tuple[list, list, list]:
        """Sum-product, one pass from the leaves up and one from the root down: of each node its message to the parent (by the parent's
        state), what it gathers from below (by its own state), and its full log potential by state."""
        n, weight = len(nodes), self.own
        gather = [[0.0, sum([weight.get(w, 0.0) for w in ws])] for ws in words]
        up = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            (e00, e01), (e10, e11) = self.edge[_kind(nodes[i])]
            g0, g1 = gather[i]
            up[i] = m = (_add(e00 + g0, e01 + g1), _add(e10 + g0, e11 + g1))
            p = gather[nodes[i].parent]
            p[0] += m[0]
            p[1] += m[1]
        full = [gather[0]] + [[0.0, 0.0]] * (n - 1)
        for i in range(1, n):
            (e00, e01), (e10, e11) = self.edge[_kind(nodes[i])]
            f = full[nodes[i].parent]
            d0, d1 = f[0] - up[i][0], f[1] - up[i][1]
            full[i] = [gather[i][0] + _add(d0 + e00, d1 + e10), gather[i][1] + _add(d0 + e01, d1 + e11)]
        return up, gather, full

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Log odds that a node is main text."""
        return [b - a for a, b in self.messages(nodes, [words_of(x) for x in nodes])[2]]


def _kind(node: Node) -> str:
    return "#" if node.tag == "#" else "aside" if node.tag in ASIDE else "p" if node.tag in ("p", "li", "td", "dd", "h1", "h2", "h3", "h4") else "box"


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if a - b < 40 else a


def labelled(page: str) -> tuple[list[Node], list[int]]:
    """A labelled page's nodes and states (``y`` attributes, inherited; the page as a whole is not main text)."""
    nodes = parse(page)
    state = [0] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        state[i] = int(x.mark) if x.mark else state[x.parent]
    return nodes, state


def train(pages: tuple[str, ...], steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """All weights of the model, by gradient ascent on the likelihood of the labels: what the labels count of each feature less what
    the sum-product marginals expect of it, and a penalty that keeps rare features small."""
    data = []
    for page in pages:
        nodes, state = labelled(page)
        data.append((nodes, [words_of(x) for x in nodes], state))
    seen: dict[object, float] = defaultdict(float)
    for nodes, words, state in data:
        for i, ws in enumerate(words):
            for w in ws:
                seen[w] += state[i]
            if i:
                seen[_kind(nodes[i]), state[nodes[i].parent], state[i]] += 1
    edges = [(k, a, b) for k in KINDS for a in (0, 1) for b in (0, 1)]
    theta: dict[object, float] = dict.fromkeys([*seen, *edges], 0.0)
    pace, before = dict.fromkeys(theta, 0.1), dict.fromkeys(theta, 0.0)
    aside = ((math.log(1 - SHOWN), math.log(SHOWN)),) * 2

    def model() -> Model:
        edge = {k: tuple(tuple(theta[k, a, b] for b in (0, 1)) for a in (0, 1)) for k in KINDS}
        return Model({w: v for w, v in theta.items() if isinstance(w, str)}, edge | {"aside": aside})

    for _ in range(steps):
        m, expected = model(), defaultdict(float)
        for nodes, words, _ in data:
            up, gather, full = m.messages(nodes, words)
            for i, ws in enumerate(words):
                d = full[i][1] - full[i][0]
                p = 1 / (1 + math.exp(-max(-700.0, min(700.0, d))))
                for w in ws:
                    expected[w] += p
                if i and (kind := _kind(nodes[i])) != "aside":
                    f, z = full[nodes[i].parent], _add(*full[i])
                    for a in (0, 1):
                        for b in (0, 1):
                            expected[kind, a, b] += math.exp(f[a] - up[i][a] + m.edge[kind][a][b] + gather[i][b] - z)
        for w in theta:
            g = seen[w] - expected[w] - penalty * theta[w]
            # Each weight has a pace of its own, faster while the slope keeps its sign.
            pace[w] = min(1.0, pace[w] * 1.2) if g * before[w] > 0 else max(1e-4, pace[w] * 0.5) if g * before[w] < 0 else pace[w]
            theta[w] += math.copysign(pace[w], g) if g else 0.0
            before[w] = g
    return model()


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    """Trained once a session, where it is first asked for; ``extract`` sends it to the tasks."""
    from tessera.llm.labelled_pages import PAGES

    return train(PAGES)


def main_text(page: str, model: Model | None = None) -> str:
    """Blocks of main text in page order, joined by line ends; white space inside a block is one space."""
    if not page:
        return ""
    nodes = parse(page)
    odds = (model or default_model()).marginals(nodes)
    blocks = (SPACE.sub(" ", "".join(x.text)).strip() for x, o in zip(nodes, odds, strict=True) if x.tag == "#" and o > 0)
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``; null or empty html gives an empty text.

    Each page is read whole where it lies, without a shuffle; repeated rows give repeated results and an empty table an empty one.
    """

    model = model or default_model()

    def run(batches):
        for b in sliced(batches):
            texts = [main_text(h or "", model) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
