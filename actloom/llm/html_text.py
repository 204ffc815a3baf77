"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read once, left to right; every stretch of text between block-level tags is a leaf block with the
chain of open tags above it. Features of a block are its ancestor tags and their class words, its text (length,
links, marks) and its place. A chain of two labels (main, other) with transition weights is trained by gradient
ascent on labelled pages and decoded by Viterbi. Text of scripts, styles, templates, heads and comments is
markup and makes no block.

Labelled pages are pages of the table, at most MAX_TRAIN, whose blocks are labelled by their place in the
page's own tags, and the same pages dressed anew: menus, headers, sidebars, notices, adverts, forms and reader
comments are put around and inside the article, so every kind of frame has labels whatever the site. A page that
has no article or main tag gives no labels by place; its densest run of blocks is dressed. Some bodies and frames
have tags that tell nothing, so that the text itself decides there.

Defined cases: null and empty html and pages without main blocks give an empty text; unclosed and stray tags are
tolerated; repeated rows give equal rows; an empty table gives no rows; other columns are ignored; texts are
never cut. A script, style, textarea or title without an end tag goes on to the end of the page, as in HTML; any
other silent tag without one ends at the next block tag or with its parent, a head at what can't stand in it.
"""

from __future__ import annotations

import html
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.llm.common import map_rows

#: Pages that are fitted on, drawn evenly by a hash of the id, and passes over them.
MAX_TRAIN, PASSES, BUCKETS = 300, 12, 1 << 12
SILENT = frozenset("script style noscript template head title svg iframe object select textarea".split())
RAW = frozenset("script style textarea title".split())
#: What can stand in a head.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: An opening p ends an open p; likewise for these.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
CLOSES |= {t: {"p"} for t in BLOCK if t not in CLOSES and t not in ("body", "html", "button", "label", "summary")}
#: Ends of the search for an open p.
WALLS = frozenset("ul ol dl table div section article aside main nav header footer form blockquote td th body html".split())
#: Attributes of a tag: a quote counts after an equals sign only, and an unclosed one counts as a letter.
ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
TAG = re.compile(rf"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9-]*+)({ATTRIBUTES})>", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
#: The next tag that tells whether a silent tag is closed.
NEXT = {t: re.compile(rf"</{t}\s*>|<{t}(?=[\s/>])" + (r"|<body(?=[\s/>])" if t == "head" else ""), re.I) for t in SILENT}
CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
OPEN_COMMENT = re.compile("<!--")
SPANS = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|textarea|title)(?=[\s/>]).*?(?:</\1\s*>|$)"
    rf"|<(/?)({'|'.join(sorted(SILENT - RAW))}|body)((?:[\s/]{ATTRIBUTES})?)>", re.S | re.I
)
BLANKS = re.compile(r"\s+")
#: Of a deeper path, so many outermost and innermost tags describe a block.
OUTERMOST, INNERMOST = 16, 48


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, str], ...]  # (tag, class words) from the outermost on
    linked: int  # characters inside links


def silent_ends(page: str) -> dict[int, int]:
    """Ends of the silent elements that are closed, by the ends of their opening tags."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {t: [] for t in SILENT - RAW}
    for m in SPANS.finditer(page, 0, page.rfind(">") + 1):
        tag = (m[3] or "").lower()
        if tag == "body":
            opened["head"].clear()
        elif tag and m[2]:
            if opened[tag]:
                out[opened[tag].pop()] = m.end()
        elif tag and not (tag == "svg" and m[4].rstrip().endswith("/")):
            opened[tag].append(m.end())
    return out


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()  # tags in the stack
    parts: list[str] = []
    linked = [0]
    ends: dict[int, int] | None = None
    silent, depth_of_silent = "", 0  # an open silent tag that is never closed

    def flush():
        if parts:
            text = BLANKS.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                deep = len(stack) > OUTERMOST + INNERMOST
                path = stack[:OUTERMOST] + stack[-INNERMOST:] if deep else stack
                out.append(Block(text, tuple(path), min(linked[0], len(text))))
            parts.clear()
            linked[0] = 0

    def shut(depth: int):
        opened.subtract(t for t, _ in stack[depth:])
        del stack[depth:]

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        # Behind the last > there is no tag, only a comment that is never closed.
        m = TAG.search(page, at) if at <= last else OPEN_COMMENT.search(page, at)
        end = m.start() if m else size
        if end > at:
            piece = page[at:end]
            if silent == "head" and piece.strip():
                silent = ""
            if not silent:
                parts.append(piece)
                if opened["a"]:
                    linked[0] += len(piece)
        if not m or at > last:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not opened["p"]:
                flush()
                continue
            if tag in BLOCK:
                flush()
            if opened[tag] > 0:
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                shut(depth)
                if depth < depth_of_silent:
                    silent, depth_of_silent = "", 0
            continue
        if silent and (tag not in HEAD if silent == "head" else tag in BLOCK and tag != "option"):
            shut(depth_of_silent)
            silent, depth_of_silent = "", 0
        if tag in RAW:
            closing = CLOSE[tag].search(page, at)
            at = closing.end() if closing else size
            continue
        if tag in SILENT:
            if tag == "svg" and m[3].rstrip().endswith("/"):
                continue
            closing = NEXT[tag].search(page, at)
            if closing and closing[0].startswith("</"):
                at = closing.end()
                continue
            if ends is None:
                ends = silent_ends(page)
            if at in ends:
                at = ends[at]
            elif not silent:
                silent, depth_of_silent = tag, len(stack)
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in BLOCK:
            flush()
            ended = CLOSES.get(tag, ())
            i = len(stack) - 1
            while i >= 0 and any(opened[t] > 0 for t in ended):
                if stack[i][0] in ended:
                    shut(i)
                    break
                if stack[i][0] in WALLS:
                    break
                i -= 1
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        names = ""
        if m[3]:
            names = " ".join(next(filter(None, g), "") for g in NAMES.findall(m[3])).lower()
        stack.append((tag, names))
        opened[tag] += 1
    flush()
    return out


def bucket(name: str) -> int:
    """Place of a feature in the weights; stable between processes."""
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % BUCKETS


class Featurizer:
    """Feature places of blocks; places of tag paths and of features are kept."""

    def __init__(self):
        self.paths: dict = {}
        self.names: dict[str, int] = {}

    def place(self, name: str) -> int:
        got = self.names.get(name)
        if got is None:
            got = self.names[name] = bucket(name)
        return got

    def of_path(self, path: tuple) -> list[int]:
        got = self.paths.get(path)
        if got is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            names = {"in:" + t for t, _ in path}
            names |= {"word:" + w for _, n in path for w in PARTS.findall(n)}
            inner = [t for t, _ in path if t in BLOCK and t not in ("html", "body")]
            names.add("leaf:" + (inner[-1] if inner else "none"))
            names.add("outer:" + (inner[0] if inner else "none"))
            names.add("within:" + ">".join(inner[-2:]))
            got = self.paths[path] = sorted({self.place(n) for n in names})
        return got

    def of_page(self, blocks: list[Block]) -> list[list[int]]:
        out, place = [], self.place
        for i, b in enumerate(blocks):
            size = len(b.text)
            links = 2 if 2 * b.linked > size else 1 if b.linked else 0
            out.append(self.of_path(b.path) + [
                place(f"size:{min(size.bit_length(), 10)}"), place(f"links:{links}"),
                place(f"ends:{b.text[-1] in '.!?:;'}"), place(f"edge:{'first' if i == 0 else 'last' if i == len(blocks) - 1 else ''}"),
            ])
        return out


@dataclass
class Chain:
    """Weights of features for label 1 against 0, and of transitions between labels."""

    weights: np.ndarray
    moves: np.ndarray  # 2 x 2

    def emissions(self, pages: list[list[list[int]]]) -> list[np.ndarray]:
        return [np.array([self.weights[f].sum() for f in page]) for page in pages]

    def decode(self, page: list[list[int]]) -> list[int]:
        """The best labels of a page, by Viterbi over two labels."""
        if not page:
            return []
        w = self.weights
        flat = np.fromiter((x for f in page for x in f), np.int64)
        starts = np.cumsum([0, *map(len, page[:-1])])
        gains = np.add.reduceat(w[flat], starts).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        s0, s1, back = 0.0, gains[0], []
        for g in gains[1:]:
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((a < b, c < d))
            s0, s1 = (b if a < b else a), (d if c < d else c) + g
        label = int(s1 > s0)
        out = [label]
        for from0, from1 in reversed(back):
            label = int(from1 if label else from0)
            out.append(label)
        return out[::-1]


def train(pages: list[list[list[int]]], labels: list[list[int]], passes: int = PASSES, rate: float = 0.3, decay: float = 1e-4) -> Chain:
    """Conditional log-likelihood by stochastic gradient ascent (adaptive rates), forward-backward per page."""
    chain = Chain(np.zeros(BUCKETS), np.zeros((2, 2)))
    seen_w, seen_m = np.full(BUCKETS, 1e-6), np.full((2, 2), 1e-6)
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(passes):
        for n in order.permutation(len(pages)):
            page, y = pages[n], np.array(labels[n])
            if not page:
                continue
            gains = np.array([chain.weights[f].sum() for f in page])
            scores = np.stack([np.zeros(len(page)), gains], 1)
            fwd, bwd = np.zeros_like(scores), np.zeros_like(scores)
            fwd[0] = scores[0]
            for i in range(1, len(page)):
                fwd[i] = scores[i] + np.logaddexp(fwd[i - 1, 0] + chain.moves[0], fwd[i - 1, 1] + chain.moves[1])
            for i in range(len(page) - 2, -1, -1):
                nxt = scores[i + 1] + bwd[i + 1]
                bwd[i] = np.logaddexp(chain.moves[:, 0] + nxt[0], chain.moves[:, 1] + nxt[1])
            total = np.logaddexp(*fwd[-1])
            p = np.exp(fwd[:, 1] + bwd[:, 1] - total)
            grad_m = np.zeros((2, 2))
            if len(page) > 1:
                both = fwd[:-1, :, None] + chain.moves[None] + (scores + bwd)[1:, None, :] - total
                np.add.at(grad_m, (y[:-1], y[1:]), 1)
                grad_m -= np.exp(both).sum(0)
            grad_w = np.zeros(BUCKETS)
            for f, d in zip(page, y - p):
                grad_w[f] += d
            touched = np.flatnonzero(grad_w)
            g = grad_w[touched] - decay * chain.weights[touched]
            seen_w[touched] += g**2
            chain.weights[touched] += rate * g / np.sqrt(seen_w[touched])
            grad_m -= decay * chain.moves
            seen_m += grad_m**2
            chain.moves += rate * grad_m / np.sqrt(seen_m)
    return chain


# Labelled pages ------------------------------------------------------------------------------------------

FRAME_TAGS = frozenset("nav footer header aside form menu button dialog".split())
FRAME_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar side widget ad ads advert "
    "advertisement promo sponsor sponsored cookie cookies consent notice alert popup modal newsletter subscribe share social "
    "related recommended comment comments reply replies discussion form search login copyright legal pager pagination tags "
    "complementary contentinfo".split()
)
BODY_TAGS = frozenset("article main".split())


def label_by_place(block: Block) -> int:
    """1 inside an article or main part and under no frame below it; a header inside an article heads it."""
    inside = False
    for tag, names in block.path:
        words = set(PARTS.findall(names))
        if tag in BODY_TAGS and not words & FRAME_WORDS:
            inside = True
        elif (tag in FRAME_TAGS and not (inside and tag == "header")) or words & FRAME_WORDS:
            return 0
    return int(inside)


def in_frame(block: Block) -> bool:
    return any(t in FRAME_TAGS or set(PARTS.findall(n)) & FRAME_WORDS for t, n in block.path)


def densest_run(blocks: list[Block]) -> list[str]:
    """Texts of the run of blocks that has most words beyond what a frame's block has; for pages that mark no main
    part. A heading in front belongs to it."""
    best = here = start = 0
    span = (0, 0)
    for i, b in enumerate(blocks):
        worth = -40 if in_frame(b) or 2 * b.linked > len(b.text) else min(len(b.text.split()), 80) - 12
        if here <= 0:
            here, start = 0, i
        here += worth
        if here > best:
            best, span = here, (start, i + 1)
    low, high = span
    if low and high and blocks[low - 1].path and blocks[low - 1].path[-1][0] in ("h1", "h2") and not in_frame(blocks[low - 1]):
        low -= 1
    return [b.text for b in blocks[low:high]]


def dress(main: list[str], frame: list[str], rng: random.Random) -> tuple[str, set[int]]:
    """A page around the blocks of an article, and the numbers of its main blocks."""
    esc, parts, number, good = html.escape, [], 0, set()

    def words() -> str:
        text = rng.choice(frame) if frame else "menu"
        w = text.split()
        at = rng.randrange(len(w)) if w else 0
        return " ".join(w[at : at + rng.randint(1, 14)]) or "more"

    def put(open_tag: str, text: str, is_main: bool = False):
        nonlocal number
        tag = open_tag.split(" ")[0]
        parts.append(f"<{open_tag}>{esc(text)}</{tag}>")
        if is_main:
            good.add(number)
        number += 1

    def group(open_tag: str, inner: str, count: int):
        tag = open_tag.split(" ")[0]
        parts.append(f"<{open_tag}>")
        for _ in range(count):
            put(inner, words())
        parts.append(f"</{tag}>")

    def frame_piece():
        kind = rng.randrange(14)
        if kind > 11:  # a menu or a note that only its short texts give away
            group(strange(), rng.choice(["li", "p", "a", "span", "div"]), rng.randint(1, 4))
        elif kind == 0:
            group("nav", "li", rng.randint(2, 7))
        elif kind == 1:
            group(rng.choice(["header", 'div class="header"', 'div id="masthead"', 'div class="site-header"']), "p", rng.randint(1, 2))
        elif kind == 2:
            group(rng.choice(["aside", 'div class="sidebar"', 'aside class="widget"', 'div id="sidebar"']), rng.choice(["p", "li"]), rng.randint(1, 5))
        elif kind == 3:
            put(rng.choice(['div class="ad"', 'div class="advert"', 'div class="sponsored"', 'aside class="promo"', 'div id="ads"']), words())
        elif kind == 4:
            group(rng.choice(["form", 'form class="search"', 'form id="newsletter"', 'div class="login"']), rng.choice(["label", "button", "p"]), rng.randint(1, 3))
        elif kind == 5:
            put(rng.choice(['div class="cookie-notice"', 'div class="notice"', 'div id="cookie-banner"', 'div class="alert"', 'div role="dialog"']), words())
        elif kind == 6:
            put(rng.choice(['div class="share"', 'p class="copyright"', 'div class="breadcrumb"', 'div class="social"', 'ul class="menu"']), words())
        elif kind == 7:
            group(rng.choice(['div class="related"', 'section class="related"', 'ul class="tags"']), "li", rng.randint(1, 4))
        elif kind == 8:
            parts.append(f"<script>var a = '<p>{esc(words())}</p>';</script><style>p{{margin:0}}</style><!-- <p>{esc(words())}</p> -->")
        else:
            comments()

    def comments():
        outer = rng.choice(['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="comments"', 'section id="discussion"'])
        tag = outer.split(" ")[0]
        parts.append(f"<{outer}>")
        if rng.random() < 0.5:
            put("h3", words())
        for _ in range(rng.randint(1, 5)):
            inner = rng.choice(['div class="comment"', 'article class="comment"', "p", 'li class="comment"', 'div class="reply"'])
            parts.append(f"<{inner}>")
            for _ in range(rng.randint(1, 2)):
                text = rng.choice(main) if main and rng.random() < 0.5 else words()
                put("p", text)
            parts.append(f"</{inner.split(' ')[0]}>")
        parts.append(f"</{tag}>")

    def strange() -> str:
        """A tag that tells nothing: no class, or one that isn't known."""
        name = "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
        return rng.choice(["div", "section", "td", f'div class="{name}"', f'div id="{name}"', f'section class="{name}"'])

    for _ in range(rng.randint(1, 4)):
        frame_piece()
    body = strange() if rng.random() < 0.4 else rng.choice(["article", "main", 'div class="content"', 'div class="post"', 'div id="content"', 'article class="post"', "main><article", 'div class="article-body"', 'section class="entry-content"'])
    parts.append(f"<{body}>")
    for i, text in enumerate(main):
        put("h1" if i == 0 and rng.random() < 0.6 else rng.choice(["p"] * 8 + ["h2", "blockquote", "li", "pre"]), text, True)
        if rng.random() < 0.06:
            frame_piece()
    parts.append("".join(f"</{x.split(' ')[0]}>" for x in reversed(body.split("><"))))
    for _ in range(rng.randint(1, 4)):
        frame_piece()
    if rng.random() < 0.8:
        group(rng.choice(["footer", 'div class="footer"', 'div id="footer"']), "p", rng.randint(1, 3))
    return "<html><head><title>t</title></head><body>" + "".join(parts) + "</body></html>", good


def labelled(pages: list[str], seed: int = 11) -> tuple[list[list[Block]], list[list[int]]]:
    """The pages that mark their main part, with their blocks' labels, and each page dressed anew twice. Of a page
    without an article or main tag the place tells nothing: only its densest text is dressed."""
    rng, blocks, labels = random.Random(seed), [], []
    for page in pages:
        found = leaf_blocks(page)
        if any(tag in BODY_TAGS for b in found for tag, _ in b.path):
            places = [label_by_place(b) for b in found]
            blocks.append(found)
            labels.append(places)
            main = [b.text for b, y in zip(found, places) if y]
            frame = [b.text for b, y in zip(found, places) if not y]
        else:
            main = densest_run(found)
            frame = [b.text for b in found if b.text not in main]
        for _ in range(2):
            if main:
                made, good = dress(main[: rng.randint(1, 12)], frame or main, rng)
                again = leaf_blocks(made)
                blocks.append(again)
                labels.append([int(i in good) for i in range(len(again))])
    return blocks, labels


def fit(df: DataFrame, key: str = "page_id", page: str = "html", at_most: int = MAX_TRAIN) -> Chain:
    """A chain trained in one task on at most so many pages of the table, one for each drawn id; only its weights
    reach the driver."""
    ids = df.select(F.col(key).alias("k")).filter("k IS NOT NULL").distinct().orderBy(F.xxhash64("k"), "k").limit(at_most)
    rows = df.select(F.col(key).alias("k"), F.col(page).cast("string").alias("page")).join(F.broadcast(ids), "k")
    one = rows.groupBy("k").agg(F.min("page").alias("page")).repartition(1).sortWithinPartitions("k")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = [p for batch in batches for p in batch.column(batch.schema.get_field_index("page")).to_pylist() if p]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(of_pages(pages))], pa.binary())], names=["chain"])

    found = one.mapInArrow(learn, "chain binary").collect()
    return pickle.loads(found[0].chain) if found else of_pages([])


def of_pages(pages: list[str]) -> Chain:
    blocks, labels = labelled(pages)
    shape = Featurizer()
    return train([shape.of_page(b) for b in blocks], labels)


def main_text(page: str | None, chain: Chain, shape: Featurizer) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, y in zip(blocks, chain.decode(shape.of_page(blocks))) if y)


def extract(df: DataFrame, chain: Chain, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def make():
        shape = Featurizer()

        def work(cols: dict) -> dict:
            texts = [main_text(p, chain, shape) for p in cols["page"]]
            return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": list(map(len, texts))}

        return work

    rows = df.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("page"))
    return map_rows(rows, "page_id long, url string, text string, n_chars long", make)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))
