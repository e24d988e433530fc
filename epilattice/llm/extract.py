"""HTML extraction by a recurrent block labeller.

A page is the sequence of its leaf blocks. Each block is a vector of hashed features of its tag path and hashed words;
a bidirectional LSTM in numpy reads the sequence and says of every block, given all others, whether it is main text.

The tables hold no labels, so the network learns from pages whose main text is known: a bounded sample of the input's
own pages with an <article> or <main>, and pages composed from their sentences in many other layouts: with and without
telling labels, in tables, with adverts and comments between paragraphs.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .html_blocks import LINKED, blocks
from .textops import steps, words

#: Training looks at this many different pages of the input at most, of those that are no longer than this.
SAMPLE_PAGES, SAMPLE_CHARS = 200, 1 << 15
COMPOSED = 2500
PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 768, 24, 8, 32
STEPS, BATCH, RATE, SEED = 1000, 32, 0.02, 5

#: Fixed values of the training layouts: labels that sites give to what is, and what is not, the main text.
MAIN_LABELS = ["content", "post", "entry", "story", "article", "main", "body", "text", "page", "article-body", "post-content", "entry-content", "story-body"]
NEUTRAL_LABELS = ["col", "row", "inner", "wrap", "left", "center", "grid", "cell", "box", "block", "section", "panel", "container", "holder", "unit", "frame", "col-8", "span", "area", "part"]
ASIDE_LABELS = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "topnav", "toc"],
    "header": ["header", "masthead", "banner", "site-header", "topbar", "logo"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "legal"],
    "aside": ["sidebar", "aside", "related", "widget", "rail", "trending", "popular", "recommended", "share", "social", "newsletter", "subscribe", "promo"],
    "ad": ["ad", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "banner-ad"],
    "notice": ["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "disclaimer"],
    "comments": ["comments", "comment", "comment-list", "discussion", "responses", "replies", "disqus", "reader-comments"],
    "form": ["search", "login", "form", "signup", "contact-form"],
}


def _hash(token: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode())
    return (h >> 1) % dim, 1.0 if h & 1 else -1.0


_paths: dict[tuple, np.ndarray] = {}


def path_vector(path: tuple) -> np.ndarray:
    """Hashed tags and labels of a block's path: each once wherever it is, and the innermost ones again."""
    v = _paths.get(path)
    if v is None:
        if len(_paths) > 5_000:
            _paths.clear()
        tokens = {x for element in path for x in (f"in:{element[0]}", *element[1:])} - {"in:html", "in:body"}
        tokens |= {f"leaf:{element[0]}" for element in path[-1:]} | {f"near:{x}" for element in path[-2:] for x in element[1:]}
        v = np.zeros(PATH_DIM, np.float32)
        for t in tokens:
            at, sign = _hash(t, PATH_DIM)
            v[at] += sign
        _paths[path] = v
    return v


def features(found: list[tuple[tuple, str]]) -> np.ndarray:
    """One row for each block: path, hashed words (as shares), shape of the text."""
    out = np.zeros((len(found), PATH_DIM + WORD_DIM + SHAPE_DIM), np.float32)
    if not found:
        return out
    out[:, :PATH_DIM] = [path_vector(p) for p, _ in found]
    texts = [t for _, t in found]
    n = np.zeros(len(found))
    for row, data, offs in steps(pa.array(texts, pa.large_string())):
        _, _, h, first = words(data, offs, lower=True)
        owner = row + np.repeat(np.arange(len(offs) - 1), np.diff(first))
        np.add.at(out, (owner, PATH_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64)), np.float32(1))
        n[row : row + len(offs) - 1] = np.diff(first)
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] /= np.sqrt(np.maximum(n, 1))[:, None]
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] *= 0.3
    tail = [
        (p[-1:] == (LINKED,), t[-1:] in ".!?:;…”\"'", any(e[0] in ("p", "pre", "blockquote") for e in p[-2:]), any(e[0][0] == "h" and e[0][1:].isdigit() for e in p[-2:]), any(e[0] == "li" for e in p[-2:]))
        for p, t in found
    ]
    out[:, -SHAPE_DIM:] = np.column_stack([np.log1p(n) / 4, n < 4, n > 12, np.array(tail, np.float32)])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output at every block. Both directions run side by side, the second one on
    the pages reversed; padding keeps a state at zero."""

    def __init__(self, dim: int, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "x": (r.normal(size=(2, dim, 4 * HIDDEN)) / np.sqrt(dim)).astype(np.float32), "h": (r.normal(size=(2, HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32),
            "c": np.zeros((2, 1, 4 * HIDDEN), np.float32), "o": (r.normal(size=2 * HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32), "ob": np.zeros(1, np.float32),
        }
        self.p["c"][:, :, HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def logits(self, x: np.ndarray, mask: np.ndarray):
        """For x (blocks, pages, features): outputs, states, and what the way back needs."""
        t, b, dim = x.shape
        flat = x.reshape(t * b, dim)
        z = np.stack([(flat @ self.p["x"][0]).reshape(t, b, -1), (flat @ self.p["x"][1]).reshape(t, b, -1)[::-1]]) + self.p["c"][:, None]
        m2, H = np.stack([mask, mask[::-1]])[..., None], HIDDEN
        h, c = np.zeros((2, b, H), np.float32), np.zeros((2, b, H), np.float32)
        hs, kept = np.zeros((2, t, b, H), np.float32), []
        for s in range(t):
            a = z[:, s] + h @ self.p["h"]
            gates = _sigmoid(a[..., : 3 * H])
            i, f, o, g = gates[..., :H], gates[..., H : 2 * H], gates[..., 2 * H :], np.tanh(a[..., 3 * H :])
            before_h, before_c = h, c
            c = (f * c + i * g) * m2[:, s]
            tc = np.tanh(c)
            h = o * tc * m2[:, s]
            hs[:, s] = h
            kept.append((i, f, o, g, tc, before_h, before_c))
        both = np.concatenate([hs[0], hs[1][::-1]], axis=2)
        return both @ self.p["o"] + self.p["ob"], both, kept

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean cross-entropy over all blocks, back through time."""
        logits, both, kept = self.logits(x, mask)
        err = ((_sigmoid(logits) - y) * mask / max(mask.sum(), 1)).astype(np.float32)
        t, b, dim = x.shape
        H, o_half = HIDDEN, self.p["o"].reshape(2, 1, 1, HIDDEN)
        dh_all = np.stack([err, err[::-1]])[..., None] * o_half
        m2 = np.stack([mask, mask[::-1]])[..., None]
        dz, dw = np.zeros((2, t, b, 4 * H), np.float32), np.zeros_like(self.p["h"])
        dh, dc = np.zeros((2, b, H), np.float32), np.zeros((2, b, H), np.float32)
        back = self.p["h"].transpose(0, 2, 1)
        for s in range(t - 1, -1, -1):
            i, f, o, g, tc, before_h, before_c = kept[s]
            dh = (dh + dh_all[:, s]) * m2[:, s]
            dc = (dc + dh * o * (1 - tc * tc)) * m2[:, s]
            a = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            dz[:, s] = a
            dw += before_h.transpose(0, 2, 1) @ a
            dh, dc = a @ back, dc * f
        flat = x.reshape(t * b, dim).T
        dx = np.stack([flat @ dz[0].reshape(t * b, -1), flat @ dz[1][::-1].reshape(t * b, -1)])
        return {"o": np.einsum("tb,tbh->h", err, both), "ob": err.sum().reshape(1), "h": dw, "c": dz.sum(axis=(1, 2))[:, None], "x": dx}

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = SEED) -> Labeller:
        r = np.random.default_rng(seed)
        pages = sorted(pages, key=lambda p: len(p[0]))  # a batch is of pages of like length
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            start = r.integers(0, max(1, len(pages) - BATCH + 1))
            x, mask, y = padded(pages[start : start + BATCH])
            rate = RATE * (1 - step / (steps + 1))
            for k, g in self.gradients(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def main(self, pages: list[np.ndarray], rows: int = 1 << 13) -> list[np.ndarray]:
        """For each page which blocks are main text. Pages of like length go together, up to `rows` cells at once."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if len(pages[i])]
        while order:
            count = 1
            while count < len(order) and (count + 1) * len(pages[order[-1]]) <= rows:
                count += 1
            part, order = order[-count:], order[:-count]
            x, mask, _ = padded([(pages[i], np.zeros(len(pages[i]))) for i in part])
            logits = self.logits(x, mask)[0]
            for k, i in enumerate(part):
                out[i] = logits[: len(pages[i]), k] > 0
        return out


def padded(pages):
    t = max(len(x) for x, _ in pages)
    x = np.zeros((t, len(pages), pages[0][0].shape[1]), np.float32)
    mask, y = np.zeros((t, len(pages)), np.float32), np.zeros((t, len(pages)), np.float32)
    for k, (f, label) in enumerate(pages):
        x[: len(f), k], mask[: len(f), k], y[: len(f), k] = f, 1, label
    return x, mask, y


def known_main(found: list[tuple[tuple, str]]) -> list[bool] | None:
    """Labels of a page that marks its main text by <article> or <main>; None for any other page."""
    aside = {"nav", "aside", "footer", "form"} | {x for k in ASIDE_LABELS for name in ASIDE_LABELS[k] for x in (f"class:{name}", f"id:{name}")}
    out = [any(e[0] in ("article", "main") for e in p) and not any(aside & set(e) for e in p) for p, _ in found]
    return out if any(out) else None


def composed_page(r: random.Random, sentences: list[str]) -> tuple[str, list[str]]:
    """A page in a random layout, and the texts of its main blocks."""
    main: list[str] = []
    say = lambda low, high: " ".join(r.choice(sentences) for _ in range(r.randint(low, high)))
    few = lambda: " ".join(r.choice(sentences).split()[: r.randint(1, 5)])
    name = lambda kind: r.choice(ASIDE_LABELS[kind])

    def labelled(tag: str, label: str, inner: str) -> str:
        k = r.random()
        if k < 0.2:
            label = f"{r.choice(NEUTRAL_LABELS)} {label}"
        elif k < 0.45:  # a word of the site's own beside the telling one
            own = "".join(r.choice("abcdeghilmnoprstu") for _ in range(r.randint(2, 6)))
            label = r.choice([f"{label}-{own}", f"{own}-{label}", f"{own} {label}"])
        return f'<{tag} {r.choice(["class", "class", "id"])}="{label}">{inner}</{tag}>'

    def keep(tag: str, text: str) -> str:
        main.append(text)
        k = r.random()
        words = text.split()
        at = r.randrange(len(words)) if words else 0
        inner = f"<b>{text}</b>" if k < 0.06 else " ".join([*words[:at], f'<a href="/y">{words[at]}</a>', *words[at + 1 :]]) if k < 0.25 and len(words) > 3 else text
        return f"<{tag}>{inner}</{tag}>"

    def piece(k: float) -> str:
        if k < 0.66:
            return keep("p", say(1, 6))
        if k < 0.74:
            return keep("p", few())
        if k < 0.8:
            return keep(r.choice(["h2", "h3"]), few())
        if k < 0.86:
            return r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(keep("li", r.choice([few() + " " + few(), say(1, 2)])) for _ in range(r.randint(2, 4))))
        if k < 0.9:
            return f"<blockquote>{keep('p', say(1, 2))}</blockquote>"
        if k < 0.92:
            return keep("pre", say(1, 2))
        if k < 0.94:
            return f"<figure><img src=x>{keep('figcaption', say(1, 1))}</figure>"
        if k < 0.96:
            return "<table>" + "".join("<tr>" + "".join(keep("td", few()) for _ in range(2)) + "</tr>" for _ in range(r.randint(2, 3))) + "</table>"
        return keep("div", say(1, 4))

    def body() -> str:
        out = [keep(r.choice(["h1", "h1", "h2"]), few() + " " + few())] if r.random() < 0.8 else []
        odd_ones = r.random() < 0.6
        for _ in range(r.choice([1, 2, 2, 3, 4, 6, 9, 14])):
            out.append(piece(r.random()))
            if odd_ones and r.random() < 0.2:
                out.append(odd(r.choice(["ad", "ad", "aside", "comments", "form", "nav"])))
        if r.random() < 0.3:
            out.append(keep("p", few()))
        return "".join(out)

    def odd(kind: str) -> str:
        links = "".join(f'<li><a href="/x">{few()}</a></li>' for _ in range(r.randint(2, 8)))
        bare = r.choice([" ", " | ", " &middot; ", "<br>"]).join(f'<a href="/x">{few()}</a>' for _ in range(r.randint(2, 6)))
        prose = "".join(f"<p>{say(1, 2)}</p>" for _ in range(r.randint(1, 3)))
        if kind == "nav":
            inner = f"<ul>{links}</ul>" if r.random() < 0.6 else bare
            return f"<nav>{inner}</nav>" if r.random() < 0.5 else labelled("div", name(kind), inner)
        if kind == "header":
            inner = r.choice([f"<p>{few()}</p>", f'<a href="/">{few()}</a>', f"<h1>{few()}</h1>", few()]) + (f"<ul>{links}</ul>" if r.random() < 0.4 else "")
            return f"<header>{inner}</header>" if r.random() < 0.5 else labelled("div", name(kind), inner)
        if kind == "footer":
            inner = r.choice([f"&copy; {few()} {say(1, 1)}", f"<p>{say(1, 1)}</p><ul>{links}</ul>", f"<p>&copy; 2020 {few()}</p><p>{bare}</p>"])
            return f"<footer>{inner}</footer>" if r.random() < 0.5 else labelled("div", name(kind), inner)
        if kind == "aside":
            inner = r.choice([f"<h3>{few()}</h3><ul>{links}</ul>", prose, f"<h4>{few()}</h4>{prose}", f"<h3>{few()}</h3>{bare}"])
            return f"<aside>{inner}</aside>" if r.random() < 0.4 else labelled(r.choice(["div", "aside", "section"]), name(kind), inner)
        if kind == "form":
            inner = f"<label>{few()}</label><input><button>{few()}</button>" + (f"<p>{say(1, 1)}</p>" if r.random() < 0.4 else "")
            return f"<form>{inner}</form>" if r.random() < 0.6 else labelled("div", name(kind), f"<form>{inner}</form>")
        if kind == "comments":
            one = lambda: labelled("div", "comment", f"<p>{few()}</p><p>{say(1, 4)}</p>") if r.random() < 0.6 else f"<li><p>{say(1, 3)}</p></li>"
            inner = (f"<h3>{few()}</h3>" if r.random() < 0.7 else "") + r.choice(["".join(one() for _ in range(r.randint(1, 5))), prose])
            return labelled(r.choice(["div", "section", "ol"]), name(kind), inner)
        return labelled(r.choice(["div", "section", "aside"]), name(kind), say(1, 1) if r.random() < 0.6 else prose)

    top = [odd(k) for k in ("notice", "header", "nav", "ad", "form", "aside") if r.random() < 0.45]
    end = [odd(k) for k in ("comments", "aside", "ad", "form", "footer", "notice") if r.random() < 0.5]
    r.shuffle(top)
    kind = r.random()
    if kind < 0.25:
        text = f"<article>{body()}</article>"
    elif kind < 0.38:
        text = f"<main>{body()}</main>"
    elif kind < 0.46:
        text = f"<main><article>{body()}</article>{odd('comments') if r.random() < 0.4 else ''}</main>"
    elif kind < 0.64:
        text = labelled(r.choice(["div", "section"]), r.choice(MAIN_LABELS), body())
    elif kind < 0.82:
        text = labelled("div", r.choice(NEUTRAL_LABELS), body())
        if r.random() < 0.5:
            text = labelled("div", r.choice(NEUTRAL_LABELS), text)
    elif kind < 0.85:
        text = f"<div>{body()}</div>"
    elif kind < 0.89:
        text = body()
    else:  # a table lays out the page: what surrounds the text stands in cells beside or above it
        links = lambda: r.choice(["<br>", " "]).join(f'<a href="/x">{few()}</a>' for _ in range(r.randint(1, 7)))
        row = [f"<td>{body()}</td>"]
        if r.random() < 0.7:
            row.insert(0, f"<td>{links()}</td>")
        if r.random() < 0.4:
            row.append(f"<td>{odd(r.choice(['aside', 'ad', 'nav']))}</td>")
        above = f"<tr><td>{links()}</td></tr>" if r.random() < 0.5 else ""
        below = f"<tr><td>&copy; {few()} {links()}</td></tr>" if r.random() < 0.4 else ""
        text = f"<table>{above}<tr>{''.join(row)}</tr>{below}</table>"
    page = "".join(top) + text + "".join(end)
    page = labelled("div", r.choice(["wrapper", "container", "page", "site", "layout"]), page) if r.random() < 0.4 else page
    return f"<html><head><title>{few()}</title></head><body>{page}</body></html>", main


def training_pages(sample: list[str], composed: int = COMPOSED, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of the sampled pages with known main text and of the composed ones."""
    r = random.Random(seed)
    out, sentences = [], []
    for html in sample:
        found = blocks(html)
        label = known_main(found)
        sentences += [s for _, t in found for s in t.split(". ") if s]
        if label:
            out.append((features(found), np.array(label, np.float32)))
    sentences = sentences or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Sed do eiusmod tempor.", "Ut enim."]
    sentences = [s.replace("&", "&amp;").replace("<", "&lt;") for s in sentences]
    for _ in range(composed):
        html, main = composed_page(r, sentences)
        found = blocks(html)
        left = [" ".join(m.replace("&lt;", "<").replace("&amp;", "&").split()) for m in main]
        label, k = [], 0
        for _, t in found:
            hit = k < len(left) and t == left[k]
            k += hit
            label.append(hit)
        out.append((features(found), np.array(label, np.float32)))
    return out


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """A labeller fitted on composed pages and on at most sample_pages different pages of the input, those with the
    smallest hashes of all that have SAMPLE_CHARS characters at most; so it does not depend on the rows' order."""
    rows = pages.where(F.length("html") <= SAMPLE_CHARS).select("html", F.xxhash64("html").alias("_o"))
    first = rows.select("_o").distinct().orderBy("_o").limit(sample_pages)
    chosen = rows.join(F.broadcast(first), "_o").groupBy("_o").agg(F.min("html").alias("html"))
    data = training_pages([r.html for r in sorted(chosen.collect(), key=lambda r: r._o)])  # bounded by sample_pages x SAMPLE_CHARS
    return Labeller(data[0][0].shape[1]).fit(data)


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """pages(html, ...) with text (the main blocks in page order, one line each; empty if there are none) and n_chars.

    Null or empty html gives an empty text. Columns of these two names are replaced, all others and all rows stay.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = StructType([f for f in pages.schema.fields if f.name not in ("text", "n_chars")]).add("text", StringType()).add("n_chars", LongType())

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = [blocks(h) for h in part.column("html").to_pylist()]
                flat = features([b for page in found for b in page])
                at = np.concatenate([[0], np.cumsum([len(page) for page in found])])
                marks = shared.value.main([flat[at[i] : at[i + 1]] for i in range(len(found))])
                texts = ["\n".join(t for (_, t), keep in zip(page, mark, strict=True) if keep) for page, mark in zip(found, marks, strict=True)]
                rest = [c for c in part.schema.names if c not in ("text", "n_chars")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"]
                )

    return pages.mapInArrow(run, schema)
