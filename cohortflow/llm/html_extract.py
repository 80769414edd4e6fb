"""Main text of HTML pages by a recurrent block labeller.

A page is the sequence of its leaf blocks. Each block becomes a vector: hashed
words of its tag path, hashed words of its text, and sizes. A bidirectional LSTM
in numpy reads the whole sequence both ways and gives each block the probability
of being main text; the extracted text is the blocks of PROBABLE or more.

The labeller is trained here, on FIT_PAGES pages at most (those of least hash; a
bounded sample for fitting, all else covers every page). Their blocks are
labelled by explicit page markup (article or main, and not inside menus, forms,
comments and the like), and each page is also rebuilt with other containers:
main text and page furniture in varied wrappers and places, whose labels are
known. So the labels do not hang on one template's tags. Pages are read whole. If no
sampled page has explicit markup, long texts outside links stand for main text;
without any block in the sample the parameters stay those of the start. A block
of probability PROBABLE exactly is main text.

Null or empty pages and pages without visible text give the empty text. Repeated
rows are extracted each. Without any page the result is empty. Extra columns are
not read.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import slices
from cohortflow.llm.html_blocks import Block, blocks

FIT_PAGES = 240
#: Blocks of a training batch, padded; a longer page is a batch of its own, whole.
BATCH_BLOCKS = 2400
STEPS, BATCH, HIDDEN = 500, 24, 20
PATH_DIMS, WORD_DIMS, SIZES = 160, 24, 8
DIMS = PATH_DIMS + WORD_DIMS + SIZES
PROBABLE = 0.5

#: Names under which pages keep text that is not the article.
FURNITURE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottom copyright colophon aside sidebar sidebars "
    "widget widgets rail related recommended recommendations trending popular promo promotion promoted ad ads advert adverts "
    "advertisement advertising sponsor sponsored banner cookie cookies consent gdpr notice notices alert notification newsletter "
    "subscribe subscription signup login signin register form search comment comments reply replies respondents discussion disqus "
    "share sharing social follow pagination pager tags toolbar modal popup overlay paywall skip complementary contentinfo legal "
    "disclaimer announcement feedback".split())
MAIN = frozenset("article main content post entry story body text".split())


def explicit_label(block: Block) -> bool:
    """Whether the markup itself says that a block is main text."""
    inside = False
    for x in block.path:
        word = x.lstrip(".")
        if word in ("article", "main"):
            inside = True
        elif word in FURNITURE and not (word == "header" and inside and x == "header"):
            return False
    return inside


@lru_cache(1 << 16)
def _hash(word: str) -> int:
    return zlib.crc32(word.encode())


@lru_cache(1 << 12)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIMS, np.float32)
    for x in path:
        h = _hash("path " + x)
        v[h % PATH_DIMS] += 1 if h >> 16 & 1 else -1
        h = _hash("second " + x)
        v[h % PATH_DIMS] += 1 if h >> 16 & 1 else -1
    last = next((x for x in reversed(path) if not x.startswith(".")), "")
    h = _hash("last " + last)
    v[h % PATH_DIMS] += 1 if h >> 16 & 1 else -1
    return np.clip(v, -2, 2)


def block_vectors(page: list[Block]) -> np.ndarray:
    """One row of DIMS numbers for each block."""
    x = np.zeros((len(page), DIMS), np.float32)
    for k, (row, b) in enumerate(zip(x, page)):
        row[:PATH_DIMS] = _path_vector(b.path)
        words = b.text.lower().split()
        for w in words:
            h = zlib.crc32(w.encode())
            row[PATH_DIMS + h % WORD_DIMS] += 1 if h >> 16 & 1 else -1
        row[PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.clip(row[PATH_DIMS : PATH_DIMS + WORD_DIMS] / len(words) ** 0.5, -2, 2)
        n = len(b.text)
        row[-SIZES:] = (np.log1p(n) / 5, np.log1p(len(words)) / 4, b.linked / n, sum(b.text.count(c) for c in ".,;!?") / n * 10,
                        k / len(page), 1 / (1 + k), 1 / (len(page) - k), b.text[-1] in ".!?")
    return x


# --- the network ---------------------------------------------------------------


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def start(seed: int = 0) -> dict[str, np.ndarray]:
    rng, p = np.random.default_rng(seed), {}
    for way in "fb":
        p["w" + way] = rng.normal(0, (DIMS + HIDDEN) ** -0.5, (DIMS + HIDDEN, 4 * HIDDEN))
        p["c" + way] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # gates: in, forget, out, cell
    p["out"], p["bias"] = rng.normal(0, 0.1, 2 * HIDDEN), np.zeros(1)
    return p


def _read(p, way: str, x: np.ndarray, mask: np.ndarray, trail: list | None = None) -> np.ndarray:
    """Hidden states of one direction: x (time, pages, DIMS), mask (time, pages)."""
    times, pages, _ = x.shape
    w, c0 = p["w" + way], p["c" + way]
    fed = x.reshape(-1, DIMS) @ w[:DIMS]
    fed = fed.reshape(times, pages, 4 * HIDDEN) + c0
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    out = np.zeros((times, pages, HIDDEN))
    for t in range(times) if way == "f" else range(times - 1, -1, -1):
        z = fed[t] + h @ w[DIMS:]
        g, a = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
        m = mask[t][:, None]
        before = (h, c)
        c = m * (f * c + i * a) + (1 - m) * c
        h = m * (o * np.tanh(c)) + (1 - m) * h
        out[t] = h
        if trail is not None:
            trail.append((t, i, f, o, a, c, before, m))
    return out


def forward(p, x, mask):
    return np.concatenate([_read(p, "f", x, mask), _read(p, "b", x, mask)], 2) @ p["out"] + p["bias"]


def gradients(p, x, mask, y):
    """Loss and gradients of the mean logistic loss over real blocks (back-propagation through time)."""
    trails = {"f": [], "b": []}
    hidden = np.concatenate([_read(p, way, x, mask, trails[way]) for way in "fb"], 2)
    z = hidden @ p["out"] + p["bias"]
    n = mask.sum()
    loss = ((np.logaddexp(0, z) - y * z) * mask).sum() / n
    dz = (_sigmoid(z) - y) * mask / n
    grad = {"out": np.tensordot(dz, hidden, ((0, 1), (0, 1))), "bias": np.array([dz.sum()])}
    for k, way in enumerate("fb"):
        w = p["w" + way]
        dw, db = np.zeros_like(w), np.zeros(4 * HIDDEN)
        dh_next, dc_next = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
        from_out = dz[:, :, None] * p["out"][k * HIDDEN : (k + 1) * HIDDEN]
        for t, i, f, o, a, c, (h0, c0), m in reversed(trails[way]):
            dh = from_out[t] + dh_next
            tc = np.tanh(c)
            dc = dc_next + m * dh * o * (1 - tc * tc)
            d = m * np.concatenate([dc * a * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], 1)
            dw[:DIMS] += x[t].T @ d
            dw[DIMS:] += h0.T @ d
            db += d.sum(0)
            dh_next = d @ w[DIMS:].T + (1 - m) * dh
            dc_next = m * dc * f + (1 - m) * dc_next
        grad["w" + way], grad["c" + way] = dw, db
    return loss, grad


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    times = max(map(len, pages))
    x, mask = np.zeros((times, len(pages), DIMS)), np.zeros((times, len(pages)))
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1
    return x, mask


def fit(pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters after ``steps`` Adam steps on batches of (vectors, labels)."""
    p, rng = start(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    by_size = sorted(range(len(pages)), key=lambda k: len(pages[k][0]))
    for step in range(1, steps + 1):
        at = rng.integers(0, max(1, len(pages) - BATCH + 1))
        batch = [pages[k] for k in by_size[at : at + BATCH]]  # whole pages of like length
        while len(batch) > 1 and len(batch) * len(batch[-1][0]) > BATCH_BLOCKS:
            batch = batch[-(len(batch) // 2) :]
        x, mask = _padded([v for v, _ in batch])
        y = np.zeros(mask.shape)
        for k, (_, labels) in enumerate(batch):
            y[: len(labels), k] = labels
        _, grad = gradients(p, x, mask, y)
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return p


# --- training pages -------------------------------------------------------------

#: Wrappers of main text and of page furniture, as tag paths, and short furniture texts.
_ARTICLE = ["article", "main", "main article", "div .content", "div .main .content article", "div .post section", "div .entry .content",
            "section .story .body", "div .article .body", "div .page div .text", "article div .post .content", "div div article section"]
_AROUND = ["nav ul li", "header nav ul li", "header", "header div .logo", "div .menu ul li", "div .navbar ul li", "div .breadcrumb", "ol .breadcrumbs li",
           "div .ad", "div .ads", "aside", "aside .sidebar", "aside ul li", "div .sidebar div .widget", "div .advert", "div .banner .ad", "div .promo",
           "div .cookie .notice", "div .notice", "div .alert", "div .sponsored", "section .related ul li", "form", "form .search", "form .newsletter",
           "form label", "div .subscribe form", "div .login form", "div .share", "div .social ul li", "div .pagination", "div .popup",
           "section .comments", "section .comments div .comment", "div .comments ul li", "ol .comment .list li", "div .reply", "div .comment .body",
           "footer", "footer ul li", "footer div .copyright", "div .footer", "div .legal", "div .tags ul li", "div .trending ul li", "div .consent"]
_LEAVES = ["", "p", "p", "p", "div", "h2", "h3", "blockquote", "ul li", "section p"]
_SHORT = ["Home", "About us", "Contact", "Log in", "Sign up", "Subscribe to our newsletter", "Search", "Read more", "Related articles", "Share this",
          "We use cookies to improve your experience. Accept", "Privacy policy", "Terms of use", "All rights reserved.", "Advertisement", "Sponsored",
          "Leave a reply", "Posted by admin", "3 comments", "Next page", "Menu", "Skip to content", "Your email address", "Follow us"]


def _built(rng, main: list[str], around: list[str]) -> list[tuple[Block, int]]:
    """A page with the main texts in one container and furniture before, inside and behind it."""
    def furniture(depth: tuple[str, ...], most: int) -> list[tuple[Block, int]]:
        out = []
        for _ in range(rng.integers(0, most + 1)):
            path = (*depth, *_AROUND[rng.integers(len(_AROUND))].split())
            path += tuple(_LEAVES[rng.integers(len(_LEAVES))].split()) if rng.random() < 0.5 else ()
            for _ in range(rng.integers(1, 6)):
                use = rng.random()
                text = _SHORT[rng.integers(len(_SHORT))] if use < 0.35 or not around else around[rng.integers(len(around))]
                if use > 0.8 and main:  # a reader's comment or a teaser reads like main text
                    text = main[rng.integers(len(main))]
                out.append((Block(text, path, len(text) if rng.random() < 0.4 else 0), 0))
        return out

    root = ("html", "body") if rng.random() < 0.7 else ("html", "body", "div", ".wrapper")
    inside = (*root, *_ARTICLE[rng.integers(len(_ARTICLE))].split())
    out = furniture(root, 4)
    for k, text in enumerate(main):
        leaf = ("h1",) if k == 0 and rng.random() < 0.6 else tuple(_LEAVES[rng.integers(len(_LEAVES))].split()) if rng.random() < 0.3 else ("p",)
        if k and rng.random() < 0.06:
            out += furniture(inside, 1)
        out.append((Block(text, inside + leaf, 0), 1))
    return out + (furniture(inside, 1) if rng.random() < 0.4 else []) + furniture(root, 4)


def long_text(block: Block) -> bool:
    """Where no sampled page marks its main text: sentences outside links."""
    return len(block.text) >= 80 and 2 * block.linked < len(block.text)


def training_pages(sample: list[str], seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vectors, labels) of the sampled pages and of each rebuilt in two other ways."""
    rng, out = np.random.default_rng(seed), []
    parsed = [blocks(p) for p in sample]
    label = explicit_label if any(explicit_label(b) for page in parsed for b in page) else long_text
    others = [b.text for page in parsed for b in page if not label(b)]
    for page in parsed:
        if not page:
            continue
        labels = np.array([label(b) for b in page], float)
        if labels.any():
            out.append((block_vectors(page), labels))
        main = [b.text for b, y in zip(page, labels) if y] if labels.any() else []
        for _ in range(2 if main else 0):
            around = [others[k] for k in rng.integers(0, len(others), 20)] if others else []
            built = _built(rng, main[: int(rng.integers(1, len(main) + 1))], around)
            out.append((block_vectors([b for b, _ in built]), np.array([y for _, y in built], float)))
    return out


def train(pages: DataFrame, seed: int = 0) -> dict[str, np.ndarray]:
    rows = pages.where(F.col("html").isNotNull()).select(F.xxhash64("html").alias("h"), F.col("html").cast("string").alias("html"))
    least = [r.h for r in rows.select("h").distinct().orderBy("h").limit(FIT_PAGES).collect()]
    sample = rows.where(F.col("h").isin(least)).dropDuplicates(["h"]).orderBy("h").collect()  # a page for each hash
    made = training_pages([r.html for r in sample], seed)
    return fit(made, STEPS, seed) if made else start(seed)


def label_pages(parameters, parsed: list[list[Block]]) -> list[np.ndarray]:
    """Probability of main text for the blocks of each page; pages of like length are read together."""
    out = [np.zeros(0)] * len(parsed)
    order = sorted((k for k in range(len(parsed)) if parsed[k]), key=lambda k: len(parsed[k]))
    at = 0
    while at < len(order):
        group = order[at : at + 32]
        while len(group) > 1 and len(group) * len(parsed[group[-1]]) > 20_000:
            group = group[: len(group) // 2]
        at += len(group)
        x, mask = _padded([block_vectors(parsed[k]) for k in group])
        p = _sigmoid(forward(parameters, x, mask))
        for j, k in enumerate(group):
            out[k] = p[: len(parsed[k]), j]
    return out


def main_text(pages: DataFrame, parameters=None) -> DataFrame:
    """page_id, url, text, n_blocks, n_main of every page."""
    parameters = parameters or train(pages)
    schema = "page_id long, url string, text string, n_blocks int, n_main int"

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                parsed = [blocks(p) for p in part.column(2).to_pylist()]
                chosen = [[b.text for b, q in zip(page, p) if q >= PROBABLE] for page, p in zip(parsed, label_pages(parameters, parsed))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(["\n".join(c) for c in chosen], pa.string()),
                     pa.array([len(b) for b in parsed], pa.int32()), pa.array([len(c) for c in chosen], pa.int32())],
                    ["page_id", "url", "text", "n_blocks", "n_main"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)
