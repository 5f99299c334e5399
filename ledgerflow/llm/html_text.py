"""Operator 10: main text of web pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks (runs of text between block-level tags, in page order). Each block is a vector: hashed
parts of its tag path (tags, classes, ids), hashed words, length, link share, place in the page. A bidirectional LSTM in
numpy reads the whole sequence and labels every block as main text or not, so a block's context on both sides counts.

The model is trained on the driver, on pages that ``training_pages`` writes by rule (a bounded number, labelled by
construction), the same each time. Extraction is one pass without a shuffle; tasks receive only the weights.

Text in head, scripts, styles, comments and form controls never becomes a block. Character references are decoded, white
space inside a block becomes one space, blocks are joined by one line break.

Defined results. Null and empty html, and pages without main text: empty text. Broken markup (unclosed or stray tags, cut off
pages) is read as far as it goes: a control or head without its end tag ends at the next block tag, an unclosed script, style or
comment at the page's end. Very long pages are labelled in segments of ``SEGMENT`` blocks that pass the network's state on, so
memory follows the text alone. Repeated rows are extracted alike. Empty table: empty result. Input columns named like a result
column, in any case of letters, are replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerflow.llm import textkit

#: Fixed values of HTML: elements that begin a block, without end tag, whose content is not text, and that an opening block ends.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CODE_TAGS = frozenset("script style".split())
RAW_TAGS = frozenset("script style textarea title iframe".split())
SILENT_TAGS = frozenset("noscript template select button option svg object head".split())
ENDED_BY_SAME = frozenset("li dt dd tr td th p option".split())

#: A tag ends at the first > outside a quoted value; quotes count only after an equals sign, and only if they are closed.
TAG = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)>|<[!?/][^>]*>", re.S)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW_TAGS}
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS_OF = re.compile(r"[a-z]+")

PATH_DIM, WORD_DIM, EXTRA, HIDDEN = 192, 64, 6, 20
PAGES_AT_ONCE, SEGMENT, TRAINING_PAGES, EPOCHS = 256, 4096, 240, 14
#: Elements of a block's path, from the innermost, that are features.
DEPTH = 64
#: Ends of a comment right after it began, and further on.
COMMENT_END, COMMENT_END_INSIDE = re.compile("-?>"), re.compile("--!?>")


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def events(page: str) -> list[tuple[str, str, bool, str]]:
    """Text before each tag, the tag's name, whether it ends an element, its attributes; the last has no name."""
    out, at, last = [], 0, page.rfind(">") + 1
    open_ended: set[str] = set()  # raw elements of which no end tag follows
    text: list[str] = []
    while m := TAG.search(page, at, last):
        text.append(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if m[0] == "<!--":
            end = COMMENT_END.match(page, at) or COMMENT_END_INSIDE.search(page, at)
            at = end.end() if end else len(page)
        if not name:
            continue
        out.append(("".join(text), name, bool(m[1]), m[3]))
        text = []
        if name in RAW_TAGS and not m[1] and name not in open_ended:
            end = RAW_END[name].search(page, at)
            if end:
                at = end.end()
                out.append(("", name, True, ""))
            elif name in CODE_TAGS:
                at = len(page)
            else:
                open_ended.add(name)
    tail = page[at:]
    cut = tail.rfind("<")
    out.append(("".join(text) + (tail[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!]", tail[cut:]) else tail), "", False, ""))
    return out


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    anchors = linked = 0
    found = events(page or "")
    # Silent elements whose end tag is there, each end matched with the last open one; the others end at a block tag.
    waiting: dict[str, list[int]] = {}
    ended: dict[int, int] = {}
    for k, (_, name, end, _) in enumerate(found):
        if name in SILENT_TAGS or name in RAW_TAGS:
            own = waiting.setdefault(name, [])
            if not end:
                own.append(k)
            elif own:
                ended[own.pop()] = k
    quiet_to, quiet = -1, False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, tuple(n for _, names in stack[-DEPTH:] for n in names), linked))
        parts.clear()
        linked = 0

    def close(k: int) -> None:
        for name, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    for k, (raw, name, end, attributes) in enumerate(found):
        if raw and k > quiet_to and not quiet:
            text = entities.unescape(raw)
            parts.append(text)
            linked += len(text) if anchors else 0
        if k <= quiet_to:
            continue
        if name in SILENT_TAGS or name in RAW_TAGS:
            if name == "head":
                flush()
            if not end:
                quiet, quiet_to = k not in ended, ended.get(k, k)
        elif name == "a":
            anchors = 0 if end else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK_TAGS:
            quiet = False
            flush()
            if end:
                if opened[name]:
                    close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif name not in VOID_TAGS:
                if stack and (stack[-1][0] == "p" or (name in ENDED_BY_SAME and stack[-1][0] == name)):
                    close(len(stack) - 1)
                tokens = [name] + [f"{name}.{w}" for g in NAMES.findall(attributes) for w in WORDS_OF.findall("".join(g).lower())]
                stack.append((name, tuple(tokens + [t[t.index(".") :] for t in tokens[1:]])))
                opened[name] += 1
    flush()
    return out


@lru_cache(maxsize=20_000)
def _path_slots(path: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(sorted({crc32(p.encode()) % PATH_DIM for p in (*path, *(f"^{p}" for p in path[-1:]))}))


def vectors(page: list[Block], start: int = 0, end: int | None = None) -> np.ndarray:
    """A row per block, from number ``start`` to ``end``; every word of a block counts."""
    own = page[start:end]
    x = np.zeros((len(own), PATH_DIM + WORD_DIM + EXTRA), np.float32)
    w = textkit.scan(pa.array([b.text for b in own], pa.string()), "space")
    slot = (textkit.hash_words(w) % np.uint64(WORD_DIM)).astype(np.int64)
    at = np.repeat(np.arange(len(own)), w.counts)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(at * WORD_DIM + slot, minlength=len(own) * WORD_DIM).reshape(-1, WORD_DIM) / np.maximum(w.counts, 1)[:, None]
    for i, b in enumerate(own):
        x[i, list(_path_slots(b.path))] = 1
        n, k = len(b.text), start + i
        x[i, -EXTRA:] = (min(np.log1p(n), 8) / 8, min(b.linked / n, 1), k / len(page), (len(page) - 1 - k) / len(page), b.text[-1] in ".!?", 1)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Labeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, seed: int = 7, inputs: int = PATH_DIM + WORD_DIM + EXTRA, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"{d}x"] = rng.normal(0, 0.08, (inputs, 4 * hidden))
            self.p[f"{d}h"] = rng.normal(0, 0.15, (hidden, 4 * hidden))
            self.p[f"{d}c"] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])
        self.p["o"] = rng.normal(0, 0.1, (2 * hidden, 1))
        self.p["oc"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
        n, t, k = len(x), x.shape[1], self.hidden
        fed = x @ self.p[f"{d}x"] + self.p[f"{d}c"]
        h, c = state or (np.zeros((n, k)), np.zeros((n, k)))
        out = np.zeros((n, t, k))
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = fed[:, s] + h @ self.p[f"{d}h"]
            gate, g = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            f, i, o = gate[:, :k], gate[:, k : 2 * k], gate[:, 2 * k :]
            m = mask[:, s, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((s, h, c, f, i, o, g, tc, m))
            c, h = np.where(m, c_new, c), np.where(m, o * tc, h)
            out[:, s] = h
        return out, (h, c)

    def logits_of_page(self, page: list[Block]) -> np.ndarray:
        """As ``logits`` of one page, in segments: each direction passes its state on and leaves one number per block."""
        total = np.full(len(page), self.p["oc"][0], np.float64)
        for d, weight in (("f", self.p["o"][: self.hidden, 0]), ("b", self.p["o"][self.hidden :, 0])):
            starts, state = list(range(0, len(page), SEGMENT)), None
            for lo in starts if d == "f" else reversed(starts):
                x = vectors(page, lo, lo + SEGMENT)[None]
                out, state = self._run(x, np.ones(x.shape[:2], bool), d, state=state)
                total[lo : lo + SEGMENT] += out[0] @ weight
        return total

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, None if keep is None else keep.setdefault(d, []))[0] for d in "fb"], axis=2)
        if keep is not None:
            keep["both"] = both
        return (both @ self.p["o"])[..., 0] + self.p["oc"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        dz = (_sigmoid(self.logits(x, mask, keep)) - y) * mask / mask.sum()
        grad = {"o": np.einsum("ntk,nt->k", keep["both"], dz)[:, None], "oc": np.array([dz.sum()])}
        d_both = dz[..., None] * self.p["o"][:, 0]
        k = self.hidden
        for d, own in (("f", d_both[..., :k]), ("b", d_both[..., k:])):
            gx, gh = np.zeros((len(x), x.shape[1], 4 * k)), np.zeros_like(self.p[f"{d}h"])
            dh, dc = np.zeros((len(x), k)), np.zeros((len(x), k))
            for s, h, c, f, i, o, g, tc, m in reversed(keep[d]):
                dh = dh + own[:, s]
                da = dh * m
                dcn = dc * m + da * o * (1 - tc * tc)
                z = np.concatenate([dcn * c * f * (1 - f), dcn * g * i * (1 - i), da * tc * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
                gx[:, s] = z
                gh += h.T @ z
                dh, dc = np.where(m, z @ self.p[f"{d}h"].T, dh), np.where(m, dcn * f, dc)
            grad |= {f"{d}x": np.einsum("nti,ntj->ij", x, gx, optimize=True), f"{d}h": gh, f"{d}c": gx.sum((0, 1))}
        return grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max((len(p) for p in pages), default=0)
    x, mask = np.zeros((len(pages), t, PATH_DIM + WORD_DIM + EXTRA), np.float32), np.zeros((len(pages), t), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


#: What surrounds main text on training pages, as (opening tags, inner tag, words).
AROUND = [
    ("<nav><ul>", "li", "home about contact news products services login search menu"), ("<div class='menu'><ul>", "li", "start shop blog help sitemap"), ("<header><div>", "p", "welcome site name tagline logo"), ("<div id='header'>", "div", "site brand tagline"),
    ("<footer>", "p", "copyright all rights reserved terms privacy"), ("<div class='footer'>", "p", "copyright imprint contact privacy"), ("<footer>", "", "&copy; 2024 example &middot; terms"), ("<aside>", "p", "related popular archive tags"), ("<div class='sidebar widget'><ul>", "li", "recent posts categories archive"),
    ("<div class='ad'>", "", "buy now offer sale"), ("<div class='ads banner'>", "p", "sponsored limited offer discount"), ("<div class='sponsored promo'>", "p", "deal shop save"), ("<div class='cookie consent notice'>", "p", "we use cookies accept settings"), ("<div role='alert' class='notice popup'>", "p", "subscribe newsletter sign up"),
    ("<form>", "p", "name email message send"), ("<div class='comments' id='comments'>", "p", "reply says great post thanks"), ("<section class='comment'>", "p", "posted ago reply like"), ("<div class='share social'><ul>", "li", "share tweet pin follow"), ("<div class='breadcrumb'>", "p", "home section page"), ("<div class='related'><ul>", "li", "read more next previous"),
]
#: What holds main text.
HOLDERS = ["<article>", "<main>", "<div class='content'>", "<main><article>", "<div id='main'><div class='post-body'>", "<section class='entry'>", "<div>", "<article class='story text'>", "<td>"]


def training_pages(n: int = TRAINING_PAGES, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages by rule: holders and surroundings in random order and number, words of random syllables."""
    rng = random.Random(seed)
    syllables = "ba de ki lo mu ra se ti no pe an er in on ou th re".split()
    made = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    prose = lambda k: " ".join(made() for _ in range(k)).capitalize() + "."
    pages = []
    for _ in range(n):
        marks: list[tuple[str, int]] = []
        holder = rng.choice(HOLDERS)
        body = [("<h1>", prose(rng.randint(3, 9)))] if rng.random() < 0.8 else []
        for _ in range(rng.choice([0, 1, 2, 4, 8, 14])):
            tag = rng.choice(["<p>"] * 7 + ["<blockquote>", "<li>", "<h2>", "<pre>", "<div>"])
            body.append((tag, prose(rng.choice([1, 2, 5, 20, 60])) if tag != "<h2>" else prose(4)[:-1]))
        around = lambda: rng.sample(AROUND, rng.choice([0, 1, 2, 2, 3]))

        def surround(kinds: list, marks: list = marks) -> str:
            text = ""
            for opening, tag, words in kinds:
                close = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))
                inner = ""
                for _ in range(rng.choice([1, 1, 2, 5]) if tag else 1):
                    # Words of the page's own kind too: what a block says must not decide alone.
                    said = " ".join(rng.sample(words.split(), min(3, len(words.split())))) if rng.random() < 0.5 else prose(rng.randint(1, 12))
                    said = f"<a href='/x'>{said}</a>" if tag == "li" or rng.random() < 0.3 else said
                    inner += f"<{tag}>{said}</{tag}>" if tag else said
                    marks.append((said, 0))
                text += opening + inner + close
            return text

        before = surround(around())
        marks_body = [(t, 1) for _, t in body]
        marks += marks_body
        inside = "".join(f"{t}{'<b>' if rng.random() < 0.2 else ''}{x}{'' if t == '<p>' and rng.random() < 0.3 else '</' + t[1:]}" for t, x in body)
        after = surround(around())
        close = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", holder)))
        if holder == "<td>":
            holder, close = "<table><tr><td>", "</td></tr></table>"
        found = blocks(f"<html><head><title>x</title></head><body>{before}{holder}{inside}{close}{after}</body></html>")
        if len(found) == len(marks) and found:
            pages.append((found, [y for _, y in marks]))
    return pages


@lru_cache(maxsize=1)
def trained(epochs: int = EPOCHS, rate: float = 0.01) -> Labeller:
    """The labeller, fitted with Adam on mini-batches of pages of like length; the same weights each time."""
    data = sorted(((vectors(b), np.array(y, np.float32)) for b, y in training_pages()), key=lambda d: len(d[1]))
    batches = []
    for k in range(0, len(data), 24):
        x, mask = padded([v for v, _ in data[k : k + 24]])
        y = np.zeros(mask.shape, np.float32)
        for i, (_, t) in enumerate(data[k : k + 24]):
            y[i, : len(t)] = t
        batches.append((x, mask, y))
    model, rng, step = Labeller(), random.Random(3), 0
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    for _ in range(epochs):
        for x, mask, y in rng.sample(batches, len(batches)):
            step += 1
            for k, g in model.gradients(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """Main text of each page; pages of like length are labelled together."""
    cut = [blocks(p) for p in pages]
    order = sorted(range(len(cut)), key=lambda i: len(cut[i]))
    out = [""] * len(cut)
    at = 0
    while at < len(order):
        if not cut[order[at]]:
            at += 1
            continue
        if len(cut[order[at]]) > SEGMENT:
            page = cut[order[at]]
            out[order[at]] = "\n".join(b.text for b, z in zip(page, model.logits_of_page(page), strict=True) if z > 0)
            at += 1
            continue
        to, longest = at + 1, len(cut[order[at]])
        while to < len(order) and to - at < PAGES_AT_ONCE and (to + 1 - at) * len(cut[order[to]]) <= 6000 and len(cut[order[to]]) <= 2 * longest:
            to += 1
        own = order[at:to]
        x, mask = padded([vectors(cut[i]) for i in own])
        keep = model.logits(x, mask) > 0
        for row, i in enumerate(own):
            out[i] = "\n".join(b.text for b, k in zip(cut[i], keep[row], strict=False) if k)
        at = to
    return out


def extract(df: DataFrame, html: str = "html", model: Labeller | None = None) -> DataFrame:
    """``df`` with its html replaced by ``text`` and ``n_chars``, its code points."""
    model = model or trained()
    rest = [c for c in df.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    schema = StructType([*df.select(*rest).schema.fields, StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in textkit.in_slices(batches, html, 1 << 20):
            yield from t.select(rest).append_column("text", pa.array(main_texts(t.column(html).to_pylist(), model), pa.string())).to_batches()

    return df.select(*rest, html).mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
