"""HTML extraction: a bidirectional LSTM in numpy labels the leaf blocks of a page as main text or not.

A block is read as its tag path (hashed tags and words of class, id and role), its hashed words and a few
sizes; the network sees the page's whole sequence from both ends. It is trained here on at most
``SAMPLE`` pages (chosen by a hash of the id; a documented bound): their own blocks, with what stands in
an ``article`` or ``main`` element as main text, and pages put together from these blocks in other
layouts, with and without such elements, so that names other than these count too. Every page is then
labelled whole, in Arrow batches.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, flat
from .features import Texts, U
from .html_blocks import HEADINGS, Block, blocks

#: Training pages, their largest size in bytes, made-up layouts for each, epochs; blocks of a page that training looks at.
SAMPLE, SAMPLE_BYTES, LAYOUTS, EPOCHS, SPAN = 80, 200_000, 3, 5, 60
PATH, WORD, SIZES, HIDDEN = 96, 16, 6, 16
WIDTH = PATH + WORD + SIZES
MAIN_FROM = 0.5

_paths: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    got = _paths.get(path)
    if got is None:
        if len(_paths) > 50_000:
            _paths.clear()
        got = _paths[path] = np.zeros(PATH, np.float32)
        marks = {f"t {e.split('.')[0]}" for e in path} | {f"w {w}" for e in path for w in e.split(".")[1:]}
        if path:
            marks.add(f"last {path[-1].split('.')[0]}")
        for mark in marks:
            h = zlib.crc32(mark.encode())
            got[h % PATH] += 1 if h >> 31 else -1
    return got


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """One matrix for each page, one row for each block."""
    every = [b for p in pages for b in p]
    if not every:
        return [np.zeros((0, WIDTH), np.float32) for _ in pages]
    t = Texts([b.text.lower().encode() for b in every])
    n = t.last_word - t.first_word
    own = np.repeat(np.arange(len(every)), n)
    words = np.bincount(own * WORD + (t.words() >> U(60)).astype(np.int64) % WORD, minlength=len(every) * WORD).reshape(-1, WORD).astype(np.float32)
    words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1)
    size = np.array([len(b.text) for b in every], np.float32)
    ends = np.array([b.text[-1] in ".!?…" for b in every], np.float32)
    head = np.array([bool(b.path) and b.path[-1].split(".")[0] in HEADINGS for b in every], np.float32)
    place = np.concatenate([np.linspace(0, 1, len(p), dtype=np.float32) for p in pages])
    sizes = np.column_stack([np.log1p(size) / 6, np.log1p(n) / 5, np.array([b.linked for b in every]) / np.maximum(size, 1), ends, head, place]).astype(np.float32)
    x = np.concatenate([np.stack([path_vector(b.path) for b in every]), words, sizes], 1)
    return np.split(x, np.cumsum([len(p) for p in pages])[:-1])


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * HIDDEN))
        w[f"h{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        w[f"b{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # in, forget, cell, out
    w["v"], w["u"], w["c"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(WIDTH), np.zeros(1)
    return {k: a.astype(np.float32) for k, a in w.items()}


def sig(z):
    return 1 / (1 + np.exp(-z))


def run(x: np.ndarray, live: np.ndarray, w: dict, d: str) -> tuple[np.ndarray, list]:
    """States of one direction over (steps, pages, width); a page that has ended keeps its state."""
    steps, n, _ = x.shape
    gates = x @ w[f"x{d}"] + w[f"b{d}"]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.zeros((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = gates[t] + h @ w[f"h{d}"]
        s = sig(z)
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 3 * HIDDEN:]
        g = np.tanh(z[:, 2 * HIDDEN:3 * HIDDEN])
        new = f * c + i * g
        th = np.tanh(new)
        m = live[t][:, None]
        kept.append((h, c, i, f, g, o, th, m))
        h, c = np.where(m, o * th, h), np.where(m, new, c)
        out[t] = h
    return out, kept


def back(x: np.ndarray, kept: list, w: dict, d: str, dout: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of one direction, given those of its states."""
    steps, n, _ = x.shape
    dz = np.zeros((steps, n, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    gh = np.zeros_like(w[f"h{d}"])
    for t in range(steps - 1, -1, -1):
        h, c, i, f, g, o, th, m = kept[t]
        dh = dh + dout[t]
        a, cc = dh * m, dc * m + dh * m * o * (1 - th * th)
        dz[t] = np.concatenate([cc * g * i * (1 - i), cc * c * f * (1 - f), cc * i * (1 - g * g), a * th * o * (1 - o)], 1)
        gh += h.T @ dz[t]
        dh, dc = dh * ~m + dz[t] @ w[f"h{d}"].T, dc * ~m + cc * f
    return {f"x{d}": np.tensordot(x, dz, ([0, 1], [0, 1])), f"h{d}": gh, f"b{d}": dz.sum((0, 1))}


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, pages, width) with what is live, and for each page its order of steps turned around."""
    length = np.array([len(r) for r in rows])
    x = np.zeros((length.max(), len(rows), WIDTH), np.float32)
    for k, r in enumerate(rows):
        x[:len(r), k] = r
    step = np.arange(length.max())[:, None]
    return x, step < length, np.where(step < length, length - 1 - step, step)


def logits(rows: list[np.ndarray], w: dict) -> tuple[np.ndarray, tuple]:
    x, live, turn = padded(rows)
    page = np.arange(len(rows))
    fwd, kf = run(x, live, w, "f")
    xb = x[turn, page]
    bwd, kb = run(xb, live, w, "b")
    both = np.concatenate([fwd, bwd[turn, page]], 2)
    return both @ w["v"] + x @ w["u"] + w["c"], (x, xb, live, turn, both, kf, kb)


def train(pages: list[tuple[list[Block], list[int]]], seed: int = 5, epochs: int = EPOCHS, batch: int = 24, rate: float = 0.01) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = new_weights(rng)
    cut = []
    for p, y in pages:  # long pages as windows, since a step costs the same wherever it stands
        for at in range(0, len(p), SPAN):
            cut.append((p[at:at + SPAN], y[at:at + SPAN]))
    rows, labels = vectors([p for p, _ in cut]), [np.array(y, np.float32) for _, y in cut]
    m, v, k = {n: np.zeros_like(a) for n, a in w.items()}, {n: np.zeros_like(a) for n, a in w.items()}, 0
    for _ in range(epochs):
        order = sorted(rng.permutation(len(rows)), key=lambda j: len(rows[j]) // 8)
        starts = rng.permutation(np.arange(0, len(order), batch))
        for at in starts:
            own = order[at:at + batch]
            z, (x, xb, live, turn, both, kf, kb) = logits([rows[j] for j in own], w)
            y = np.zeros_like(z)
            for c, j in enumerate(own):
                y[:len(labels[j]), c] = labels[j]
            dz = np.where(live, sig(z) - y, 0).astype(np.float32) / live.sum()
            dboth = dz[:, :, None] * w["v"]
            page = np.arange(len(own))
            g = {"v": np.tensordot(dz, both, ([0, 1], [0, 1])), "u": np.tensordot(dz, x, ([0, 1], [0, 1])), "c": dz.sum(keepdims=True).ravel()}
            g |= back(x, kf, w, "f", dboth[:, :, :HIDDEN])
            g |= back(xb, kb, w, "b", dboth[:, :, HIDDEN:][turn, page])
            k += 1
            for n in w:
                m[n], v[n] = 0.9 * m[n] + 0.1 * g[n], 0.99 * v[n] + 0.01 * g[n]**2
                w[n] = (w[n] - rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return w


def probabilities(pages: list[list[Block]], w: dict) -> list[np.ndarray]:
    """Of each page's blocks; pages of like length share their steps."""
    rows = vectors(pages)
    out = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(rows[k])), key=lambda k: len(rows[k]))
    while order:
        own = [k for k in order[:64] if len(rows[k]) <= 16 + 1.5 * len(rows[order[0]])]
        z, _ = logits([rows[k] for k in own], w)
        for c, k in enumerate(own):
            out[k] = sig(z[:len(rows[k]), c])
        order = order[len(own):]
    return out


#: Texts for made-up layouts, beside those of the sampled pages.
MENU = "Home News About Contact Archive Products Services Login Help Blog Accueil Kontakt Inicio Noticias Aktuelles Suche".split()
NOTICES = ["We use cookies to improve this site. By going on you accept them.", "Accept all", "This page has moved.", "You are reading an archived page.", "Subscribe now for full access.", "Wir verwenden Cookies.", "Nous utilisons des cookies."]
ADVERTS = ["Advertisement", "Sponsored", "Buy one, get one free today!", "Anzeige", "Publicité", "50% off all orders this week."]
FORMS = ["Your email address", "Search", "Send", "Name", "Message", "Sign up for our letter", "I accept the terms."]
FOOT = ["© 2024 All rights reserved.", "Terms of use", "Privacy", "Imprint", "Impressum", "Mentions légales", "Contact us"]
ASIDE = ["Related articles", "Most read", "Popular", "Tags", "Follow us", "Share this", "Latest posts"]


def layout(rng: random.Random, prose: list[str], headings: list[str], other: list[str]) -> tuple[list[Block], list[int]]:
    """A page of the given texts in a random layout, as blocks with labels."""
    out: list[Block] = []
    label: list[int] = []
    body = ("html", "body") + (("div." + rng.choice(["page", "wrapper", "container", "site", "layout"]),) if rng.random() < 0.5 else ())

    def add(path, text, y, linked=0.0):
        out.append(Block(text, tuple(path), int(len(text) * linked)))
        label.append(y)

    def some(*names):
        return rng.choice(names)

    def menu(at):
        top = [*at, some("nav", "nav.main", "div.menu", "div.nav", "div.navigation", "ul.menu", "nav.navbar", "div.breadcrumb", "header")]
        for _ in range(rng.randint(3, 8)):
            add([*top, "ul", "li"] if rng.random() < 0.8 else top, rng.choice(MENU + other), 0, 1.0)

    def header(at):
        for _ in range(rng.randint(1, 3)):
            add([*at, some("header", "header.site", "div.header", "div.top.bar", "div.masthead"), some("h1", "p", "div.logo")], rng.choice(other + headings), 0)

    def notice(at):
        add([*at, some("div.notice", "div.cookie", "div.cookie.banner", "section.alert", "div.banner", "div.message", "aside.notice"), some("p", "span", "div")], rng.choice(NOTICES + other), 0)

    def advert(at):
        add([*at, some("div.ad", "div.ads", "div.advert", "aside.sponsored", "div.promo", "div.banner.ad", "div.advertisement")] + ([] if rng.random() < 0.5 else ["p"]), rng.choice(ADVERTS + other + prose[:2]), 0)

    def form(at):
        for _ in range(rng.randint(1, 4)):
            add([*at, some("form", "form.search", "form.newsletter", "div.subscribe"), some("label", "button", "p", "div")], rng.choice(FORMS + other), 0)

    def aside(at):
        top = [*at, some("aside", "div.sidebar", "aside.sidebar", "div.side", "div.related", "section.related", "div.widget", "div.share")]
        add([*top, "h3"], rng.choice(ASIDE + other), 0)
        for _ in range(rng.randint(1, 6)):
            add([*top, "ul", "li"] if rng.random() < 0.6 else [*top, "p"], rng.choice(other + headings + prose[:2]), 0, float(rng.random() < 0.6))

    def comments(at):
        top = [*at, some("div.comments", "section.comments", "div.responses", "ol.comment.list", "section.discussion", "div.comments.area")]
        add([*top, "h3"], some("Comments", "Responses", "Leave a reply", "Kommentare"), 0)
        for _ in range(rng.randint(1, 5)):
            add([*top, some("div.comment", "li.comment", "article.comment"), "p"], rng.choice(prose + other), 0)

    def footer(at):
        for _ in range(rng.randint(1, 4)):
            add([*at, some("footer", "footer.site", "div.footer", "div.bottom", "div.copyright")] + ([] if rng.random() < 0.5 else [some("p", "div", "ul")]), rng.choice(FOOT + other), 0)

    for _ in range(rng.randint(1, 4)):
        rng.choice([menu, header, notice, advert, aside, form])(body)
    main = list(body) + [some("article", "article", "article.post", "main", "main", "div.content", "div.article", "div.post", "div.entry", "div.story", "section.main", "div.main", "div")]
    if rng.random() < 0.3:
        main.append(some("div.body", "div.text", "section", "div", "div.entry.content"))
    add([*main, "header", "h1"] if rng.random() < 0.2 else [*main, some("h1", "h1", "h2")], rng.choice(headings), 1)
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        if kind < 0.72:
            add([*main, "p"] if rng.random() < 0.9 else main, rng.choice(prose), 1)
        elif kind < 0.8:
            add([*main, some("h2", "h3")], rng.choice(headings), 1)
        elif kind < 0.86:
            add([*main, some("ul", "ol"), "li"], rng.choice(prose), 1)
        elif kind < 0.92:
            add([*main, some("blockquote", "pre", "figure", "table"), some("p", "figcaption", "td")], rng.choice(prose), 1)
        else:
            rng.choice([advert, aside, form, notice])(main)
    if rng.random() < 0.15:
        comments(main)
    for f in rng.sample([aside, comments, advert, form, menu, footer], rng.randint(0, 4)):
        f(body)
    footer(body)
    return out, label


def examples(sources: list[str], layouts: int = LAYOUTS, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """The sampled pages as they are, and layouts made from their texts."""
    rng, found = random.Random(seed), []
    for source in sources:
        p = blocks(source)
        y = [int(any(e.split(".")[0] in ("article", "main") for e in b.path)) for b in p]
        if any(y):
            found.append((p, y))
    made = [*found]
    for p, y in found or [([Block(" ".join([w] * 9) + ".", ("p",), 0) for w in MENU], [1] * len(MENU))]:
        own = [b for b, k in zip(p, y, strict=True) if k]
        heads = [b.text for b in own if b.path[-1].split(".")[0] in HEADINGS] or [own[0].text[:80]]
        prose = [b.text for b in own if b.path[-1].split(".")[0] not in HEADINGS] or heads
        other = [b.text for b, k in zip(p, y, strict=True) if not k] or MENU
        made += [layout(rng, prose, heads, other) for _ in range(layouts if found else 60)]
    return made


def fitted(pages: DataFrame, page_id: str = "page_id", text: str = "html", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    some = (pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{text}`").alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES)
            .orderBy(F.xxhash64("id"), "id", "t").limit(sample).select("t"))
    return train(examples([r.t for r in some.toLocalIterator()]))


def extract(pages: DataFrame, w: dict, keep: list[str], text: str = "html", main_from: float = MAIN_FROM) -> DataFrame:
    """``row`` (struct of ``keep``) and ``text``: the main blocks, joined by line ends. Null or empty html has none."""
    shared = pages.sparkSession.sparkContext.broadcast(w)  # about 25,000 numbers

    def make():
        def fn(texts):
            parsed = [blocks((b or b"").decode()) for b in texts]
            return [["\n".join(b.text for b, q in zip(p, own, strict=True) if q >= main_from) for p, own in zip(parsed, probabilities(parsed, shared.value), strict=True)]]

        return fn

    return annotate(pages, keep, text, make, "text string", rows=256)


def op2_html_extraction(pages: DataFrame) -> DataFrame:
    out = flat(extract(pages, fitted(pages), ["page_id", "url"]), ["page_id", "url"], ["text"])
    return out.withColumn("n_chars", F.length("text").cast("long"))
