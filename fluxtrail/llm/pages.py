"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the document tree.

A block is a run of text between block-level tags, with the tags and class words of its ancestors. Features say what the
ancestors are, how long the block is, how much of it is link text and how it ends. The field has two labels, main and
other; weights are trained by gradient steps on labelled pages, made here from seeded templates of many layouts (with
semantic tags, with class names only, with neither), and pages are decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = "script|style|noscript|template|svg|iframe|object|select|textarea|title"
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn del em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br img wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block elements whose start ends an open paragraph.
PARAGRAPH_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of class and id that are features.
CUES = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner nav navbar menu breadcrumb breadcrumbs sidebar side widget related footer foot header head masthead "
    "cookie cookies consent notice alert popup modal newsletter subscribe signup login search form comment comments reply replies disqus share social tags meta pagination "
    "content article post entry body main story text".split()
)
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SKIPPED})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none", re.I)
WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tags: frozenset
    leaf: str
    linked: int


@dataclass
class Open:
    tag: str
    cues: frozenset = field(default_factory=frozenset)


def blocks(page: str) -> list[Block]:
    """The leaf blocks in page order, with character references decoded and white space runs as one space.

    Unclosed elements close as their parents do; end tags without a start are left out; whatever is cut off at the end
    of the page counts as text of its element.
    """
    stack: list[Open] = []
    out: list[Block] = []
    parts: list[str] = []
    held: Counter = Counter()  # tags and cues of the open elements, so that a block need not look through them
    outer: list[str] = []  # the open elements that are not inline
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(text, frozenset(held), outer[-1] if outer else "", linked))
        linked = 0

    def push(element: Open) -> None:
        stack.append(element)
        held.update([element.tag, *(f".{c}" for c in element.cues)])
        if element.tag not in INLINE:
            outer.append(element.tag)

    def cut(k: int) -> None:
        for element in stack[k:]:
            for name in (element.tag, *(f".{c}" for c in element.cues)):
                held[name] -= 1
                if not held[name]:
                    del held[name]
            if element.tag not in INLINE:
                outer.pop()
        del stack[k:]

    def close(tags) -> None:
        if not any(t in held for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                cut(k)
                return
            if stack[k].tag in ("table", "ul", "ol", "dl", "article", "section", "div", "body") and "p" not in tags:
                return

    at = 0
    for tag in TAG.finditer(page):
        piece = page[at : tag.start()]
        at = tag.end()
        if piece:
            parts.append(piece)
            if "a" in held:
                linked += len(piece.strip())
        name = (tag[3] or "").lower()
        if not name:
            if tag[1]:
                parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        elif name in ("br", "img"):
            parts.append(" ")
        if tag[2]:
            if name in held:
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == name))
            continue
        if name in PARAGRAPH_ENDS:
            close({"p"})
        elif name in CLOSES:
            close(CLOSES[name])
        if name not in VOID and not (tag[4] or "").endswith("/"):
            attributes = tag[4] or ""
            found = " ".join(" ".join(m) for m in NAMES.findall(attributes)).lower() if attributes else ""
            cues = frozenset(w for w in WORDS.findall(found) if w in CUES)
            push(Open(name, cues | {"hidden"} if attributes and HIDDEN.search(attributes) else cues))
    if at < len(page):
        rest = page[at:]
        parts.append(rest.partition("<")[0] if re.match(r"[^<]*<[a-z/!][^>]*\Z", rest, re.I) else rest)
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    rows = []
    for k, block in enumerate(found):
        size, words = len(block.text), block.text.count(" ") + 1
        links = min(4, int(4 * block.linked / size + 0.25))
        row = [f"in {t}" for t in block.tags]
        row += [
            "bias", f"leaf {block.leaf}", f"words {min(7, words.bit_length())}", f"links {links}",
            f"end {'.' if block.text[-1] in '.!?:;\"' else 'w'}", f"long {size > 120} {links > 1}",
        ]
        if "©" in block.text:
            row.append("copyright")
        if k == 0 or k == len(found) - 1:
            row.append("first" if k == 0 else "last")
        rows.append(row)
    return rows


def labelled_pages(n: int = 500, seed: int = 17) -> list[tuple[str, list[int]]]:
    """Pages of seeded layouts with the label of each block: 1 for the main text."""
    pick = np.random.default_rng(seed)
    syllables = "an the re on er in ti ou st ea le de qui ment tion sch ge ung os ci ar do".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(pick.choice(syllables, pick.integers(1, 4))) for _ in range(pick.integers(low, high)))

    def sentence(low: int = 3, high: int = 40) -> str:
        return words(low, high).capitalize() + str(pick.choice([".", ".", ".", "!", "?", "", "&amp;"]))

    def wrap(semantic: str, cues: list[str], body: str) -> str:
        style = pick.random()
        if style < 0.5:
            return f"<{semantic}>{body}</{semantic}>"
        if style < 0.85:
            return f'<div class="{pick.choice(cues)}">{body}</div>'
        return f"<div>{body}</div>"

    def menu() -> tuple[str, int]:
        k = int(pick.integers(2, 9))
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k)) + "</ul>", k

    def clutter(kind: str) -> tuple[str, int]:
        if kind == "nav":
            body, k = menu()
            return wrap("nav", ["menu", "nav", "navbar"], body), k
        if kind == "header":
            return wrap("header", ["header", "masthead"], f"<div>{words(1, 5)}</div><p>{words(2, 7)}</p>"), 2
        if kind == "aside":
            body, k = menu()
            return wrap("aside", ["sidebar", "widget", "related"], f"<h3>{words(1, 4)}</h3>{body}<p>{sentence()}</p>"), k + 2
        if kind == "footer":
            return wrap("footer", ["footer"], f"&copy; {words(1, 4)} &middot; {sentence(2, 15)}"), 1
        if kind == "form":
            return f'<form><label>{words(1, 3)}</label><input name="q"><p>{words(2, 8)}</p><button>{words(1, 2)}</button></form>', 3
        if kind == "comments":
            k = int(pick.integers(1, 5))
            body = "".join(f'<div class="comment"><p>{sentence(4, 50)}</p></div>' for _ in range(k))
            name = pick.choice(["comments", "replies", "disqus"])
            return f'<section id="{name}"><h2>{words(1, 3)}</h2>{body}</section>', k + 1
        cue = {"ad": ["ad", "ads", "advert", "sponsored", "promo", "banner"], "notice": ["cookie", "notice", "consent", "alert", "newsletter"]}[kind]
        return f'<div class="{pick.choice(cue)}">{sentence(3, 30)}</div>', 1

    pages = []
    for _ in range(n):
        inner, labels = f"<h1>{words(2, 10)}</h1>", [1]
        for _ in range(pick.integers(1, 14)):
            kind = pick.random()
            if kind < 0.75:
                inner += f"<p>{sentence(1, 120)}</p>" if pick.random() < 0.85 else f"<p><b>{sentence(1, 60)}<br>"
                labels.append(1)
            elif kind < 0.82:
                inner += f"<h2>{words(1, 6)}</h2>"
                labels.append(1)
            elif kind < 0.87:
                k = int(pick.integers(1, 5))
                inner += "<ul>" + "".join(f"<li>{sentence(3, 20)}</li>" for _ in range(k)) + "</ul>"
                labels += [1] * k
            elif kind < 0.9:
                inner += f"<blockquote>{sentence(5, 40)}</blockquote>"
                labels.append(1)
            else:
                part, k = clutter(str(pick.choice(["ad", "notice", "form", "aside"])))
                inner += part
                labels += [0] * k
        style = pick.random()
        if style < 0.45:
            main = f"<article>{inner}</article>"
        elif style < 0.6:
            main = f"<main>{inner}</main>"
        elif style < 0.85:
            main = f'<div class="{pick.choice(["content", "post", "entry", "article", "story", "main"])}">{inner}</div>'
        else:
            main = f"<div>{inner}</div>"
        before, after = [], []
        for kind in ("header", "nav", "notice", "ad"):
            if pick.random() < 0.5:
                before.append(clutter(kind))
        for kind in ("comments", "aside", "form", "ad", "footer"):
            if pick.random() < 0.5:
                after.append(clutter(kind))
        page = "<html><head><title>x</title></head><body>" + "".join(b for b, _ in before) + main + "".join(b for b, _ in after) + "</body></html>"
        pages.append((page, [0] * sum(k for _, k in before) + labels + [0] * sum(k for _, k in after)))
    return pages


def viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    """The best labels of a chain of score pairs."""
    (a, b), back = scores[0], []
    (m00, m01), (m10, m11) = move.tolist()
    for x, y in scores[1:].tolist():
        to_a = (a + m00, 0) if a + m00 >= b + m10 else (b + m10, 1)
        to_b = (a + m01, 0) if a + m01 >= b + m11 else (b + m11, 1)
        back.append((to_a[1], to_b[1]))
        a, b = to_a[0] + x, to_b[0] + y
    labels = [0 if a >= b else 1]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


@dataclass
class Field:
    """Weights of the chain: features x 2 and label moves 2 x 2."""

    names: dict[str, int]
    weights: np.ndarray
    move: np.ndarray

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        return np.array([self.weights[[self.names[f] for f in row if f in self.names]].sum(axis=0) for row in rows])

    def main_text(self, page: str | None) -> str:
        found = blocks(page or "")
        if not found:
            return ""
        labels = viterbi(self.scores(features(found)), self.move)
        return "\n\n".join(b.text for b, label in zip(found, labels, strict=True) if label)


def train(pages: list[tuple[str, list[int]]], steps: int = 150, rate: float = 0.1, penalty: float = 1e-4) -> Field:
    """Maximum conditional likelihood by Adam over all pages at once, forward and backward along the padded chains."""
    chains, labels = [], []
    for page, wanted in pages:
        rows = features(blocks(page))
        if len(rows) != len(wanted):
            raise ValueError(f"{len(rows)} blocks, {len(wanted)} labels")
        chains.append(rows)
        labels.append(wanted)
    names = {f: k for k, f in enumerate(sorted({f for rows in chains for row in rows for f in row}))}
    longest, n = max(map(len, chains)), len(chains)
    who, when, what = (np.array(x) for x in zip(*((i, t, names[f]) for i, rows in enumerate(chains) for t, row in enumerate(rows) for f in row), strict=True))
    live = np.array([[t < len(rows) for t in range(longest)] for rows in chains])
    truth = np.zeros((n, longest, 2))
    for i, wanted in enumerate(labels):
        truth[i, np.arange(len(wanted)), wanted] = 1
    pairs = np.einsum("ita,itb->ab", truth[:, :-1], truth[:, 1:])
    theta = np.zeros((len(names) + 2, 2))  # the last two rows are the moves
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    total = live.sum()
    for step in range(1, steps + 1):
        scores = np.zeros((n, longest, 2))
        np.add.at(scores, (who, when), theta[what])
        move = theta[-2:]
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, longest):
            ahead = np.logaddexp(forward[:, t - 1, 0, None] + move[0], forward[:, t - 1, 1, None] + move[1]) + scores[:, t]
            forward[:, t] = np.where(live[:, t, None], ahead, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = scores[:, t + 1] + backward[:, t + 1]
            behind = np.logaddexp(move[:, 0] + after[:, 0, None], move[:, 1] + after[:, 1, None])
            backward[:, t] = np.where(live[:, t + 1, None], behind, 0)
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])[:, None, None]
        mean = np.exp(forward + backward - whole) * live[..., None]
        joint = np.exp(forward[:, :-1, :, None] + move + (scores + backward)[:, 1:, None, :] - whole[..., None]) * live[:, 1:, None, None]
        slope = np.zeros_like(theta)
        np.add.at(slope, what, (truth - mean)[who, when])
        slope[-2:] = pairs - joint.sum(axis=(0, 1))
        slope = slope / total - penalty * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(names, theta[:-2], theta[-2:])


def extract(pages: DataFrame, chain: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html).

    A null or empty html, and a page without a main block, has the empty text; repeated rows give repeated rows; other
    columns are not read. ``chain`` is trained on the labelled pages where none is given.
    """
    small_batches(pages.sparkSession)
    values = vars(chain or train(labelled_pages()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = Field(**values)
        for batch in batches:
            texts = [chain.main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
