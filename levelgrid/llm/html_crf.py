"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A page is read into leaf blocks: runs of text without a block element between them. Each block has features of
its ancestor elements (names, words of class, id and role) and of its text (length, links, marks, neighbours).
Two labels, main text or not; weights are trained by gradient ascent on labelled pages, labels are decoded by
Viterbi, and the blocks labelled as main text are joined.

Labelled pages: a bounded sample of the given pages, labelled by the elements that name their own role
(article or main, and within them nothing that names itself otherwise), each also in a copy whose main element
and surroundings are renamed and extended, so that weights do not rest on one page layout.

Defined cases: a null or empty page has no text; a page without labelled main text gives an empty text; white
space is that of Unicode; unclosed and stray tags are tolerated; scripts, styles, comments, templates and raw text
(textarea, iframe, noembed, noframes) are no blocks; formulas, drawings, objects and noscript are read like other
elements; repeated pages are extracted one by one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelgrid.llm import text as T

# Pages that are learned from, and the longest of them.
SAMPLE_PAGES = 150
SAMPLE_CHARS = 40_000
EPOCHS = 12
RATE = 0.15
SEED = 3

# Elements of HTML by their role in the layout.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
# Content that is no markup: scripts, styles, templates, and the elements that HTML reads as raw text.
SILENT = {"script", "style", "template", "textarea", "iframe", "noembed", "noframes"}
# Elements shown apart from the text around them, and those in which a slash closes an element.
APART = {"noscript", "svg", "math", "object", "canvas", "audio", "video"}
FOREIGN = {"svg", "math"}
APART_FOREIGN = {"title", "desc", "text"}
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = {"p"}
CLOSED_BY_SELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}}

# Words of elements, classes and ids by which a page says what a part is.
MAIN = {"article", "main"}
OTHER = set(
    "nav header footer aside form menu sidebar ad ads advert advertisement banner promo sponsored cookie consent notice alert popup modal breadcrumb "
    "breadcrumbs share social related comments comment reply discussion newsletter subscribe widget toolbar button dialog head title".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


@dataclass
class Block:
    text: str
    path: list[tuple[str, tuple[str, ...]]]
    linked: int = 0


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order, with their open elements (name, words of class, id and role)."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, list(stack), linked))
            pieces.clear()
        linked = 0

    def close(name: str, stop: set[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                flush()
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            pieces.append(text)
            if any(name == "a" for name, _ in stack):
                linked += len(text)
        if not found:
            break
        at = found.end()
        if not found[1]:
            continue
        name = found[1].lower()
        foreign = any(n in FOREIGN for n, _ in stack)
        if name in APART or (foreign and name in APART_FOREIGN):
            pieces.append(" ")
        # A title within a drawing is not that of the page.
        block = name in BLOCKS and not (name == "title" and foreign)
        if found[0][1] == "/":
            if block:
                close(name)
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in BLOCKS:
                        break
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            continue
        if name in SILENT:
            if not found[2].endswith("/"):
                end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            pieces.append(" ")
            continue
        if name == "br":
            pieces.append(" ")
        if block:
            flush()
            for p in CLOSED_BY_BLOCK:
                close(p, {"table", "td", "th", "button", "object"})
            if name in CLOSED_BY_SELF:
                close(name, CLOSED_BY_SELF[name])
        if name in VOID or (found[2].endswith("/") and (foreign or name in FOREIGN)):
            continue
        words: tuple[str, ...] = ()
        if found[2]:
            words = tuple(w.lower() for a in _ATTRIBUTE.finditer(found[2]) for w in _NAMES.findall(a[2] or a[3] or a[4] or ""))
        stack.append((name, words))
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of every block."""
    out = []
    for i, b in enumerate(blocks):
        words = b.text.split()
        tags = [name for name, _ in b.path if name not in ("html", "body")]
        f = ["bias", f"leaf={tags[-1] if tags else ''}", f"parent={tags[-2] if len(tags) > 1 else ''}"]
        f += {f"in={t}" for t in tags} | {f"word={w}" for _, ws in b.path for w in ws}
        f += {f"named={'main' if w in MAIN else 'other'}" for name, ws in b.path for w in (name, *ws) if w in MAIN or w in OTHER}
        f.append(f"length={min(6, len(words).bit_length())}")
        f.append(f"links={int(4 * b.linked / max(1, len(b.text)))}")
        f.append(f"ends={b.text[-1] in '.!?:…”' }")
        if b.text[0] in "©®" or "©" in b.text:
            f.append("rights")
        f.append(f"first={i == 0}")
        f.append(f"last={i == len(blocks) - 1}")
        f.append(f"same={i > 0 and blocks[i - 1].path[:-1] == b.path[:-1]}")
        out.append(f)
    return out


def own_labels(blocks: list[Block]) -> np.ndarray:
    """Labels by what the elements call themselves."""
    out = np.zeros(len(blocks), np.int64)
    for i, b in enumerate(blocks):
        inside = False
        for name, words in b.path:
            if name in MAIN:
                inside = True
            elif name in OTHER or any(w in OTHER for w in words):
                inside = False
                break
        out[i] = inside
    return out


class Crf:
    """Weights of features by label, of label pairs, and of the first label."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.unary = np.zeros((len(names), 2))
        self.pairs = np.zeros((2, 2))
        self.begin = np.zeros(2)

    def ids(self, rows: list[list[str]]) -> list[np.ndarray]:
        return [np.array([self.names[f] for f in row if f in self.names], np.int64) for row in rows]

    def scores(self, ids: list[np.ndarray]) -> np.ndarray:
        return np.array([self.unary[x].sum(0) for x in ids])

    def marginals(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label of a block) and the summed P(labels of neighbours), by forward and backward sums."""
        n = len(score)
        emit = np.exp(score - score.max(1, keepdims=True))
        step = np.exp(self.pairs)
        ahead, back = np.zeros((n, 2)), np.ones((n, 2))
        ahead[0] = np.exp(self.begin) * emit[0]
        ahead[0] /= ahead[0].sum()
        for i in range(1, n):
            ahead[i] = (ahead[i - 1] @ step) * emit[i]
            ahead[i] /= ahead[i].sum()
        for i in range(n - 2, -1, -1):
            back[i] = step @ (emit[i + 1] * back[i + 1])
            back[i] /= back[i].sum()
        p = ahead * back
        p /= p.sum(1, keepdims=True)
        both = ahead[:-1, :, None] * step[None] * (emit * back)[1:, None, :]
        return p, (both / both.sum((1, 2), keepdims=True)).sum(0)

    def viterbi(self, score: np.ndarray) -> np.ndarray:
        """The best label sequence; equal scores go to label 0."""
        n = len(score)
        best, came = self.begin + score[0], np.zeros((n, 2), np.int64)
        for i in range(1, n):
            each = best[:, None] + self.pairs
            came[i] = each.argmax(0)
            best = each.max(0) + score[i]
        out = np.zeros(n, np.int64)
        out[-1] = int(best.argmax())
        for i in range(n - 1, 0, -1):
            out[i - 1] = came[i][out[i]]
        return out

    def extract(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        if not blocks or not self.names:
            return ""
        labels = self.viterbi(self.scores(self.ids(features(blocks))))
        return "\n".join(b.text for b, y in zip(blocks, labels) if y)


def train(pages: list[tuple[list[Block], np.ndarray]], epochs: int = EPOCHS) -> Crf:
    """Gradient ascent on the likelihood of labelled pages (blocks and their labels)."""
    pages = [(b, y) for b, y in pages if b]
    rows = [features(b) for b, _ in pages]
    counts: dict[str, int] = {}
    for page in rows:
        for f in {f for row in page for f in row}:
            counts[f] = counts.get(f, 0) + 1
    crf = Crf({f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n > 1))})
    ids = [crf.ids(page) for page in rows]
    rng, steps, done = np.random.default_rng(SEED), epochs * max(1, len(pages)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(pages)):
            y, rate = pages[k][1], RATE * (1 - done / steps) + 1e-3
            done += 1
            p, both = crf.marginals(crf.scores(ids[k]))
            miss = -p
            miss[np.arange(len(y)), y] += 1
            for x, m in zip(ids[k], miss):
                crf.unary[x] += rate * m
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            crf.pairs += rate * (seen - both) / max(1, len(y))
            crf.begin += rate * miss[0] / max(1, len(y))
            crf.unary *= 1 - 1e-4 * rate
    return crf


# Names that main and other parts of a page go by in the renamed copies.
_MAIN_NAMES = [("article", ""), ("main", ""), ("div", "article"), ("div", "content"), ("div", "post body"), ("section", "story"), ("div", "entry content"), ("div", "main text")]
_SIDE_NAMES = [
    ("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("div", "menu"), ("div", "sidebar"), ("div", "ad"), ("div", "advert"), ("section", "advertisement"),
    ("div", "banner"), ("div", "promo"), ("div", "sponsored"), ("div", "cookie consent"), ("div", "notice"), ("div", "cookie notice"), ("div", "newsletter"),
    ("div", "alert"), ("div", "popup"), ("div", "breadcrumbs"), ("div", "share social"), ("div", "related"), ("form", ""), ("form", "subscribe"), ("ul", "menu"),
]
_COMMENT_NAMES = [("section", "comments"), ("div", "comment"), ("ol", "comment list"), ("div", "discussion"), ("div", "comments section"), ("div", "reply")]


def renamed(blocks: list[Block], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A copy of a labelled page in another layout: other names for its parts, more parts around and within the main one."""
    name = lambda names: (lambda t: (t[0], tuple(t[1].split())))(names[rng.integers(len(names))])
    main, around = name(_MAIN_NAMES), [("html", ()), ("body", ())] + [("div", ("page", "wrapper")[: int(rng.integers(3))])] * int(rng.integers(2))
    texts = [b.text for b in blocks]
    out: list[tuple[Block, int]] = []

    def side(names, inside=()) -> None:
        part = name(names)
        for _ in range(int(rng.integers(1, 4))):
            leaf = {"nav": "li", "ul": "li", "ol": "li", "form": "label"}.get(part[0], ("p", "div", "span", "h3")[int(rng.integers(4))])
            words = texts[rng.integers(len(texts))].split()
            text = " ".join(words[: int(rng.integers(1, 40))])
            linked = len(text) if part[0] in ("nav", "ul") and rng.random() < 0.8 else 0
            out.append((Block(text, [*around, *inside, part, (leaf, ())], linked), 0))

    for _ in range(int(rng.integers(1, 4))):
        side(_SIDE_NAMES)
    kept = [b for b, y in zip(blocks, labels) if y]
    for i, b in enumerate(kept):
        leaf = b.path[-1] if b.path[-1][0] not in MAIN else ("p", ())
        if 0 < i and rng.random() < 0.15:
            leaf = (("h2", "h3", "li", "blockquote", "td", "pre", "figcaption", "dd")[int(rng.integers(8))], ())
        between = [[], [("section", ())], [("div", ())], [("ul", ())]][int(rng.integers(4))] if rng.random() < 0.3 else []
        out.append((Block(b.text, [*around, main, *between, leaf], b.linked), 1))
        if rng.random() < 0.12:
            side(_SIDE_NAMES, (main,))
    if rng.random() < 0.6:
        side(_COMMENT_NAMES, (main,) if rng.random() < 0.5 else ())
    for _ in range(int(rng.integers(1, 3))):
        side(_SIDE_NAMES)
    return [b for b, _ in out], np.array([y for _, y in out], np.int64)


def labelled(pages: list[str]) -> list[tuple[list[Block], np.ndarray]]:
    """Labelled pages, as they are and in two renamed copies."""
    rng, out = np.random.default_rng(SEED), []
    for page in pages:
        blocks = leaf_blocks(page)
        labels = own_labels(blocks)
        if labels.any():
            out.append((blocks, labels))
            out += [renamed(blocks, labels, rng) for _ in range(2)]
    return out


def sample(pages: DataFrame, rows: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[str]:
    """At most `rows` of the pages with an element that names main text, chosen by a hash of page_id."""
    usable = pages.filter((F.length("html") <= chars) & F.col("html").rlike(f"(?i)<({'|'.join(sorted(MAIN))})[\\s/>]"))
    marked = usable.select("html", F.struct(F.xxhash64("page_id").alias("id"), F.xxhash64("html").alias("html")).alias("at"))
    # The marks alone find the bound; then only the chosen pages are moved.
    last = marked.select("at").orderBy("at").limit(rows).agg(F.max("at")).first()[0]
    if last is None:
        return []
    chosen = marked.filter(F.col("at") <= F.struct(F.lit(last["id"]).alias("id"), F.lit(last["html"]).alias("html")))
    return sorted(r["html"] for r in chosen.orderBy("at").limit(rows).collect())


def learn(pages: DataFrame) -> Crf:
    """The model of a sample of the pages. Pages of which none can be labelled are an error, not empty texts."""
    found = labelled(sample(pages))
    if not found and not pages.filter(F.length(F.trim("html")) > 0).isEmpty():
        raise ValueError("no labelled page to learn from: no sampled page has main text in an article or main element")
    return train(found)


def extract(pages: DataFrame, crf: Crf) -> DataFrame:
    """page_id, url, text, n_chars of every page. The model's size is bounded by the labelled sample."""
    T.bound_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sent.value.extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
