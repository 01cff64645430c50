"""HTML extraction: a linear-chain conditional random field over the leaf
blocks of a page.

A page becomes a sequence of blocks: runs of text between tags that start or
end a block. Each has features of its ancestor tags, of the names (class, id,
role) on them, and of its text (length, links, sentence marks). The chain's
states are article and rest; weights of features and of neighbouring states
are fitted to labelled pages by gradient steps on the conditional likelihood,
and the best sequence is decoded by Viterbi.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import col
from .html_pages import labelled

TRAINING_PAGES = 500
SEED = 11

# Element names of HTML by their role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template title".split())
#: Elements that a head can hold; any other, or text, ends a head that is open.
IN_HEAD = frozenset("html head base basefont bgsound link meta noscript script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split()
)
#: Elements that end where another of them starts, inside the nearest of the second.
SAME = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr", "th": "tr", "option": "select"}

NAME = re.compile(r"[A-Za-z]+")
#: A tag that the end of the page cuts off: it is no text.
CUT_OFF = re.compile(r"<[A-Za-z/!?][^>]*\Z")


class Blocks(HTMLParser):
    """``found``: (text, characters in links, path) of each block, where the
    path holds (tag, names) of the ancestors, outermost first."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, tuple]] = []
        self.path: list[tuple[str, tuple[str, ...]]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.unseen = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            kept = tuple(p for p in self.path if p[0] not in INLINE)
            self.found.append((text, self.linked, kept))
        self.parts, self.linked = [], 0

    def pop_to(self, k: int) -> None:
        self.unseen -= sum(t in UNSEEN for t, _ in self.path[k:])
        del self.path[k:]

    def end_head(self) -> None:
        """Ends a head whose end tag is left out, with all that is open in it."""
        for k, (t, _) in enumerate(self.path):
            if t == "template":
                return
            if t == "head":
                if all(x != "template" for x, _ in self.path[k:]):
                    self.flush()
                    self.pop_to(k)
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self.end_head()
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            tags = [t for t, _ in self.path]
            if tag in CLOSES_P and "p" in tags:
                self.pop_to(len(tags) - 1 - tags[::-1].index("p"))
            elif tag in SAME:
                for k in range(len(tags) - 1, -1, -1):
                    if tags[k] == tag or (tag in ("td", "th") and tags[k] in ("td", "th")):
                        self.pop_to(k)
                        break
                    if tags[k] in SAME[tag].split():
                        break
        if tag in VOID:
            return
        names = tuple(
            x.lower() for k, v in attrs if k in ("class", "id", "role") and v for x in NAME.findall(v[:200])
        ) if tag not in INLINE else ()
        self.path.append((tag, names))
        self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        for k in range(len(self.path) - 1, -1, -1):
            if self.path[k][0] == tag:
                self.pop_to(k)
                return
            if tag in INLINE and self.path[k][0] not in INLINE:
                return  # an inline end does not end blocks

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        if self.path and self.path[-1][0] == "head" and data.strip():
            self.end_head()
        self.parts.append(data)
        if any(t == "a" for t, _ in self.path[-4:]):
            self.linked += len(data.strip())


def whole(html: str) -> str:
    """The page without a comment or tag that its end cuts off."""
    at = html.rfind("<!--")
    if at >= 0 and html.find("-->", at) < 0 and html.rfind("<script", 0, at) <= html.rfind("</script", 0, at):
        html = html[:at]
    return CUT_OFF.sub("", html)


def blocks(html: str | None) -> list[tuple[str, int, tuple]]:
    p = Blocks()
    p.feed(whole(html or ""))
    p.close()
    p.flush()
    return p.found


SENTENCE = tuple(".!?:;…。！？»”\"')")


def features(found: list[tuple[str, int, tuple]]) -> list[list[str]]:
    """Names of the features of each block of a page."""
    out = []
    for k, (text, linked, path) in enumerate(found):
        n = text.count(" ") + 1
        tags = [t for t, _ in path]
        f = ["bias", f"words:{min(n.bit_length(), 7)}", f"links:{min(4, 5 * linked // max(len(text), 1))}"]
        f.append("stop" if text.endswith(SENTENCE) else "open")
        f.extend(f"in:{t}" for t in set(tags))
        if tags:
            f.append(f"tag:{tags[-1]}")
            f.append(f"tag:{tags[-1]}/{min(n.bit_length(), 5)}")
        names = [x for _, own in path for x in own]
        f.extend(f"name:{x}" for x in set(names))
        last = next((own for _, own in reversed(path) if own), ())
        f.extend(f"last:{x}" for x in set(last))
        box = next((t for t in reversed(tags) if t not in ("p", "li", "ul", "ol", "td", "tr", "tbody", "table", "blockquote", "pre", "div", "h1", "h2", "h3", "h4")), "none")
        f.append(f"box:{box}")
        if k == 0:
            f.append("first")
        if "©" in text or "\xa9" in text:
            f.append("copyright")
        out.append(f)
    return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """Weights: ``emit`` (features x 2), ``move`` (2 x 2) and ``start`` (2)."""

    def __init__(self, number: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.number, self.emit, self.move, self.start = number, emit, move, start

    def decode(self, found: list[list[str]]) -> list[int]:
        """The best sequence of states (1: article), by Viterbi."""
        if not found:
            return []
        get, emit, move = self.number.get, self.emit, self.move
        back, best = [], None
        for f in found:
            own = emit[[k for k in map(get, f) if k is not None]].sum(axis=0)
            if best is None:
                best = self.start + own
            else:
                step = best[:, None] + move
                back.append(step.argmax(axis=0))
                best = step.max(axis=0) + own
        state = [int(best.argmax())]
        for b in reversed(back):
            state.append(int(b[state[-1]]))
        return state[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 120, rate: float = 0.3, l2: float = 1e-3) -> Crf:
    """Fits the field to pages given as (features of the blocks, states)."""
    pages = [p for p in pages if p[0]]
    names = sorted({x for f, _ in pages for b in f for x in b})
    number = {x: k for k, x in enumerate(names)}
    long, n = max(len(y) for _, y in pages), len(pages)
    at, item = [], []
    y = np.zeros((n, long), dtype=int)
    there = np.zeros((n, long), dtype=bool)
    for p, (f, own) in enumerate(pages):
        y[p, : len(own)], there[p, : len(own)] = own, True
        for k, b in enumerate(f):
            for x in b:
                at.append(p * long + k)
                item.append(number[x])
    at, item = np.array(at), np.array(item)
    gold = np.zeros((n, long, 2))
    gold[np.arange(n)[:, None], np.arange(long)[None, :], y] = there
    pair = there[:, 1:] & there[:, :-1]
    gold_move = np.zeros((2, 2))
    np.add.at(gold_move, (y[:, :-1][pair], y[:, 1:][pair]), 1.0)
    emit, move, start = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    seen = [np.full_like(w, 1e-8) for w in (emit, move, start)]
    for _ in range(steps):
        score = np.stack([np.bincount(at, emit[item, s], minlength=n * long) for s in (0, 1)], axis=-1).reshape(n, long, 2)
        forward, backward = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        forward[:, 0] = start + score[:, 0]
        for k in range(1, long):
            new = _log_sum(forward[:, k - 1, :, None] + move, 1) + score[:, k]
            forward[:, k] = np.where(there[:, k, None], new, forward[:, k - 1])
        for k in range(long - 2, -1, -1):
            new = _log_sum(move + (score[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            backward[:, k] = np.where(there[:, k + 1, None], new, 0.0)
        total = _log_sum(forward[:, -1], 1)
        p1 = np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
        p2 = np.exp(forward[:, :-1, :, None] + move + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        p2 *= pair[:, :, None, None]
        diff = (gold - p1).reshape(-1, 2)
        g_emit = np.stack([np.bincount(item, diff[at, s], minlength=len(names)) for s in (0, 1)], axis=-1) / n - l2 * emit
        g_move = (gold_move - p2.sum(axis=(0, 1))) / n - l2 * move
        g_start = (gold[:, 0] - p1[:, 0]).sum(axis=0) / n - l2 * start
        for w, g, s in ((emit, g_emit, 0), (move, g_move, 1), (start, g_start, 2)):
            seen[s] += g * g
            w += rate * g / np.sqrt(seen[s])
    return Crf(number, emit, move, start)


def labelled_blocks(pages: list[tuple[str, set[str]]]) -> list[tuple[list[list[str]], list[int]]]:
    """Training input from (html, texts of the article's blocks)."""
    out = []
    for html, gold in pages:
        found = blocks(html)
        out.append((features(found), [int(text in gold) for text, _, _ in found]))
    return out


def default_model(pages: int = TRAINING_PAGES, seed: int = SEED) -> Crf:
    """The field fitted to a fixed number of drawn, labelled pages."""
    return train(labelled_blocks(labelled(pages, seed)))


def main_text(html: str | None, model: Crf) -> str:
    found = blocks(html)
    states = model.decode(features(found))
    return "\n".join(text for (text, _, _), s in zip(found, states) if s)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            model: Crf | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (blocks of the
    article, one line each), n_chars (its code points).

    Null and empty html and pages without an article give an empty text.
    Character references are decoded, white space inside a block is one
    space; the whole html is read and nothing is cut. Repeated rows give
    repeated rows; null ids and urls stay null; other columns are not read;
    an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in common.slices(batches, 64):
            texts = [main_text(h, m) for h in b.column(2).to_pylist()]
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    own = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
