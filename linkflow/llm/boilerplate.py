"""Main content of web pages by a recurrent block labeller (problem 1).

A page is a sequence of leaves: its lines with visible text. Each leaf gets a vector of
its tag path, of its hashed words and of a few measures (length, links, digits, sentence
end, place). A bidirectional LSTM, written in numpy, reads the sequence both ways and
labels each leaf article or not with the whole document as context. Its weights
(``boilerplate.npz``) are trained by ``fit`` on pages with labelled leaves. Pages that
are keyword or link lists (``spam``) have no article.

Null and empty bodies and pages without visible text give no line. Pages of any length
are read whole; pages of like length share a batch.
"""

from __future__ import annotations

import io
import pkgutil
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from linkflow.llm import spam
from linkflow.llm.pages import Cache, Line, charset_of, codec_of, decode, html_pages, look, parse

WORD_BUCKETS, PATH_BUCKETS, WORD_DIM, PATH_DIM, MEASURES, HIDDEN = 4096, 512, 20, 12, 9, 24
#: Leaves of a batch of pages, padding included: bounds a worker's memory at about 100 MB.
BATCH_LEAVES = 60_000

WORD = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"<a\b[^>]*>(.*?)</a>", re.S)
_ENDS = tuple(".!?…")
_CLOSERS = "”“»\"')] "


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_BUCKETS


def _path_bucket(path: str) -> int:
    return zlib.crc32(path.encode()) % PATH_BUCKETS


class Leaves:
    """Features of leaves, kept per distinct raw line and tag path."""

    def __init__(self):
        self.words = Cache(_bucket, 200_000)
        self.paths = Cache(_path_bucket, 20_000)
        self.known: dict[str, tuple[list[int], list[float]]] = {}

    def of(self, x: Line) -> tuple[list[int], list[float]]:
        """Word buckets and measures of a leaf that do not depend on its page."""
        got = self.known.get(x.raw)
        if got is None:
            text = x.text
            n = len(text)
            linked = sum(len(a) for a in _LINK.findall(x.raw)) if "<a" in x.raw else 0
            words = WORD.findall(text.lower())
            ends = text.rstrip(_CLOSERS).endswith(_ENDS)
            got = (
                [self.words[w] for w in words] or [0],
                [
                    np.log1p(n) / 6,
                    min(1.0, linked / n),
                    sum(map(str.isdigit, text)) / n,
                    1.0 if ends else 0.0,
                    text.count(",") / n * 10,
                    1.0 if "|" in text or "·" in text or "»" in text[-2:] else 0.0,
                    np.log1p(len(words)) / 4,
                ],
            )
            if len(self.known) > 40_000:
                self.known.clear()
            self.known[x.raw] = got
        return got

    def page(self, lines: list[Line]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Word buckets, path buckets ``(n, 2)`` and measures ``(n, MEASURES)`` of a page's leaves."""
        words, paths, measures = [], [], []
        last = max(1, len(lines) - 1)
        title_seen = 0.0
        for i, x in enumerate(lines):
            w, m = self.of(x)
            if x.own.startswith(("h1", "h2")):
                title_seen = 1.0
            words.append(w)
            own = x.own or "-"
            paths.append((self.paths[x.path[-24:] + ">" + own], self.paths[own]))
            measures.append([*m, i / last, title_seen])
        return words, np.array(paths, np.int64), np.array(measures, np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


SIZE_IN = WORD_DIM + PATH_DIM + MEASURES


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    """Random weights."""
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    w = {"words": normal(WORD_BUCKETS, WORD_DIM, scale=0.3), "paths": normal(PATH_BUCKETS, PATH_DIM, scale=0.3)}
    for d in ("f", "b"):
        w["x" + d] = normal(SIZE_IN, 4 * HIDDEN, scale=SIZE_IN**-0.5)
        w["h" + d] = normal(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5)
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        w["c" + d] = bias
    w["out"] = normal(2 * HIDDEN, scale=0.2)
    w["bias"] = np.zeros(1, np.float32)
    return w


def embed(w: dict, words: list[list[int]], paths: np.ndarray, measures: np.ndarray) -> np.ndarray:
    """Input vectors of leaves: mean of word vectors, sum of path vectors, measures."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((b for x in words for b in x), np.int64, int(counts.sum()))
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    mean = np.add.reduceat(w["words"][flat], starts, axis=0) / counts[:, None].astype(np.float32)
    return np.concatenate([mean, w["paths"][paths[:, 0]] + w["paths"][paths[:, 1]], measures], axis=1, dtype=np.float32)


def run_lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, bias: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states ``(T, B, H)`` of inputs ``(T, B, D)``; where ``mask`` is 0 the state stays. ``keep`` gets what training needs."""
    steps, batch, _ = x.shape
    h = np.zeros((batch, HIDDEN), np.float32)
    c = np.zeros((batch, HIDDEN), np.float32)
    out = np.empty((steps, batch, HIDDEN), np.float32)
    z = (x.reshape(-1, x.shape[2]) @ wx + bias).reshape(steps, batch, -1)
    for t in range(steps):
        a = z[t] + h @ wh
        g = sigmoid(a[:, : 3 * HIDDEN])
        u = np.tanh(a[:, 3 * HIDDEN :])
        new = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * u
        tc = np.tanh(new)
        m = mask[t][:, None]
        if keep is not None:
            keep.append((h, c, g, u, tc, m))
        c = m * new + (1 - m) * c
        h = m * (g[:, 2 * HIDDEN :] * tc) + (1 - m) * h
        out[t] = h
    return out


def scores(w: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Log odds ``(T, B)`` that a leaf is article."""
    f = run_lstm(x, w["xf"], w["hf"], w["cf"], mask)
    b = run_lstm(x[::-1], w["xb"], w["hb"], w["cb"], mask[::-1])[::-1]
    return f @ w["out"][:HIDDEN] + b @ w["out"][HIDDEN:] + w["bias"]


def batches(sizes: list[int], leaves: int = BATCH_LEAVES) -> Iterator[list[int]]:
    """Page numbers in batches of like size; a page beyond the bound is a batch of its own."""
    now: list[int] = []
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if now and sizes[k] * (len(now) + 1) > leaves:
            yield now
            now = []
        now.append(k)
    if now:
        yield now


def label_pages(w: dict, pages: list[tuple]) -> list[np.ndarray]:
    """Log odds per leaf for pages given as ``Leaves.page`` gives them."""
    out: list = [None] * len(pages)
    for group in batches([len(p[2]) for p in pages]):
        top = max(len(pages[k][2]) for k in group)
        x = np.zeros((top, len(group), SIZE_IN), np.float32)
        mask = np.zeros((top, len(group)), np.float32)
        flat = embed(w, [ws for k in group for ws in pages[k][0]], np.concatenate([pages[k][1] for k in group]), np.concatenate([pages[k][2] for k in group]))
        at = 0
        for j, k in enumerate(group):
            n = len(pages[k][2])
            x[:n, j] = flat[at : at + n]
            mask[:n, j] = 1
            at += n
        s = scores(w, x, mask)
        for j, k in enumerate(group):
            out[k] = s[: len(pages[k][2]), j]
    return out


def fit(pages: list[tuple], labels: list[np.ndarray], epochs: int = 12, rate: float = 4e-3, group: int = 48, seed: int = 1) -> dict[str, np.ndarray]:
    """Train on pages with leaves labelled 0 or 1 (logistic loss, Adam, back-propagation through time)."""
    rng = np.random.default_rng(seed)
    w = initial(seed)
    m1 = {k: np.zeros_like(v) for k, v in w.items()}
    m2 = {k: np.zeros_like(v) for k, v in w.items()}
    order = np.argsort([len(p[2]) + rng.random() * 6 for p in pages])
    chunks = [order[i : i + group] for i in range(0, len(order), group)]
    step = 0
    for epoch in range(epochs):
        rng.shuffle(chunks)
        total = 0.0
        for chunk in chunks:
            top = max(len(pages[k][2]) for k in chunk)
            words = [ws for k in chunk for ws in pages[k][0]]
            paths = np.concatenate([pages[k][1] for k in chunk])
            flat = embed(w, words, paths, np.concatenate([pages[k][2] for k in chunk]))
            x = np.zeros((top, len(chunk), SIZE_IN), np.float32)
            mask = np.zeros((top, len(chunk)), np.float32)
            y = np.zeros((top, len(chunk)), np.float32)
            spot = []
            at = 0
            for j, k in enumerate(chunk):
                n = len(pages[k][2])
                x[:n, j], mask[:n, j], y[:n, j] = flat[at : at + n], 1, labels[k]
                spot.append((at, at + n))
                at += n
            drop = (rng.random(x.shape[1:]) > 0.05).astype(np.float32)
            keep_f: list = []
            keep_b: list = []
            hf = run_lstm(x * drop, w["xf"], w["hf"], w["cf"], mask, keep_f)
            hb = run_lstm((x * drop)[::-1], w["xb"], w["hb"], w["cb"], mask[::-1], keep_b)[::-1]
            p = sigmoid(hf @ w["out"][:HIDDEN] + hb @ w["out"][HIDDEN:] + w["bias"])
            total += float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum())
            d = (p - y) * mask / mask.sum()
            g = {"out": np.concatenate([np.tensordot(d, hf, ([0, 1], [0, 1])), np.tensordot(d, hb, ([0, 1], [0, 1]))]), "bias": np.array([d.sum()], np.float32)}
            dx = np.zeros_like(x)
            for side, keep, inputs, dout in (("f", keep_f, x * drop, d[..., None] * w["out"][:HIDDEN]), ("b", keep_b, (x * drop)[::-1], (d[..., None] * w["out"][HIDDEN:])[::-1])):
                dh = np.zeros((len(chunk), HIDDEN), np.float32)
                dc = np.zeros_like(dh)
                dz = np.zeros((top, len(chunk), 4 * HIDDEN), np.float32)
                gh = np.zeros_like(w["h" + side])
                for t in range(top - 1, -1, -1):
                    h0, c0, gates, u, tc, mk = keep[t]
                    dh = dh + dout[t]
                    i_, f_, o_ = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                    dhn = dh * mk
                    dcn = dc * mk + dhn * o_ * (1 - tc * tc)
                    da = np.concatenate([dcn * u * i_ * (1 - i_), dcn * c0 * f_ * (1 - f_), dhn * tc * o_ * (1 - o_), dcn * i_ * (1 - u * u)], axis=1)
                    dz[t] = da
                    gh += h0.T @ da
                    dh = dh * (1 - mk) + da @ w["h" + side].T
                    dc = dc * (1 - mk) + dcn * f_
                flat_z = dz.reshape(-1, 4 * HIDDEN)
                g["x" + side] = inputs.reshape(-1, SIZE_IN).T @ flat_z
                g["h" + side] = gh
                g["c" + side] = flat_z.sum(0)
                back = (flat_z @ w["x" + side].T).reshape(x.shape) * drop
                dx += back if side == "f" else (flat_z @ w["x" + side].T).reshape(x.shape)[::-1] * drop
            dflat = np.concatenate([dx[: b - a, j] for j, (a, b) in enumerate(spot)])
            g["words"] = np.zeros_like(w["words"])
            counts = np.fromiter(map(len, words), np.int64, len(words))
            np.add.at(g["words"], np.fromiter((b for ws in words for b in ws), np.int64, int(counts.sum())), np.repeat(dflat[:, :WORD_DIM] / counts[:, None], counts, axis=0))
            g["paths"] = np.zeros_like(w["paths"])
            for col in (0, 1):
                np.add.at(g["paths"], paths[:, col], dflat[:, WORD_DIM : WORD_DIM + PATH_DIM])
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = min(1.0, 1.0 / (norm + 1e-8))
            lr = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                v = v.reshape(w[k].shape) * scale
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                w[k] -= (lr * m1[k] / (np.sqrt(m2[k]) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch}: loss {total / sum(len(p[2]) for p in pages):.5f}", flush=True)
    return w


def load() -> dict[str, np.ndarray]:
    """The trained weights."""
    with np.load(io.BytesIO(pkgutil.get_data("linkflow.llm", "boilerplate.npz"))) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def article_lines(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """``fetch_id, line_no`` of the article's lines of pages (``fetch_id, charset, content_body``); one narrow stage."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights or load()
        see, leaves = Cache(look), Leaves()
        for f in frames:
            ids, parsed, read = [], [], []
            for fetch_id, charset, body in zip(f["fetch_id"], f["charset"], f["content_body"], strict=True):
                lines, parent, name = parse(decode(body, codec_of(charset) if charset else charset_of(body, None)), see)
                if lines and not spam.is_spam(lines, parent, name):
                    ids.append(fetch_id)
                    parsed.append([x.n for x in lines])
                    read.append(leaves.page(lines))
            rows, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for fetch_id, ns, s in zip(ids, parsed, label_pages(w, read), strict=True):
                got = np.array(ns, np.int32)[s > 0]
                numbers.append(got)
                rows.append(np.full(len(got), fetch_id, np.int64))
            yield pd.DataFrame({"fetch_id": np.concatenate(rows), "line_no": np.concatenate(numbers)})

    return pages.select("fetch_id", "charset", "content_body").mapInPandas(run, "fetch_id long, line_no int")


def articles(crawl_uris: DataFrame) -> DataFrame:
    """``fetch_id, line_no`` of the article's lines of all HTML pages."""
    return article_lines(html_pages(crawl_uris))


def article_texts(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """``fetch_id, n_lines, text``: the article's visible text per page; pages without article have an empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights or load()
        see, leaves = Cache(look), Leaves()
        for f in frames:
            ids, texts, read = [], [], []
            for fetch_id, charset, body in zip(f["fetch_id"], f["charset"], f["content_body"], strict=True):
                lines, parent, name = parse(decode(body, codec_of(charset) if charset else charset_of(body, None)), see)
                ids.append(fetch_id)
                texts.append([x.text for x in lines] if not spam.is_spam(lines, parent, name) else [])
                read.append(leaves.page(lines) if texts[-1] else ([], np.zeros((0, 2), np.int64), np.zeros((0, MEASURES), np.float32)))
            full = [k for k, t in enumerate(texts) if t]
            got: dict[int, list[str]] = {}
            for k, s in zip(full, label_pages(w, [read[k] for k in full]), strict=True):
                got[k] = [t for t, ok in zip(texts[k], s > 0, strict=True) if ok]
            yield pd.DataFrame([(i, len(got.get(k, ())), "\n".join(got.get(k, ()))) for k, i in enumerate(ids)], columns=["fetch_id", "n_lines", "text"])

    return pages.select("fetch_id", "charset", "content_body").mapInPandas(run, "fetch_id long, n_lines long, text string")
