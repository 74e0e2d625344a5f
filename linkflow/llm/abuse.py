"""Abusive, hateful and sexual content by a string-kernel support vector machine (problem 10).

Kernel: gap-weighted subsequences of four characters within a window of ``SPAN``,
weighted by ``DECAY`` per character spanned, divided by the root of the length. It
tolerates inserted and changed characters; a normalisation before it folds case, accents,
look-alike letters and digits, stretched letters, invisible characters and letters set
apart.

Nyström: the kernel with ``landmarks`` (labelled sentences) maps a sentence to
``K(s, L) K(L, L)^-1/2``, and a linear support vector machine (squared hinge loss) is
trained on that. As the kernel's features can be listed (four characters of an alphabet
of 32), map and machine collapse into one weight per feature, a table of 32**4: a text is
scored by looking up its subsequences, without meeting the landmarks one by one. The
result is the same.

A document's score is that of its worst sentence. Null and empty texts have no sentence
and score ``-1``. Texts are scored whole, whatever their length; copies get equal scores.
"""

from __future__ import annotations

import itertools
import json
import pkgutil
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.session import spread

ORDER, SPAN, DECAY = 4, 6, 0.7
ALPHABET = 32
SPACE, STOP, DIGIT, STAR, OTHER = 0, 27, 28, 29, 30
#: Characters of text scored at a time: bounds a worker's memory.
CHUNK = 1_000_000
#: Lengths below this count as this, so that short exclamations don't score by chance.
LEAST = 12
#: Symbols of the windows of long sentences, and what a window's score must exceed.
WINDOW, MARGIN = 60, 0.2

# Letters of other scripts and signs that stand for Latin ones.
LOOKALIKE = {"а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ł": "l", "ø": "o", "đ": "d", "ı": "i", "ß": "s", "æ": "a", "œ": "o", "$": "s", "@": "a", "€": "e", "£": "l", "!": "!"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
INVISIBLE = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, *range(0x300, 0x370))

_TOP = 0x3000
#: Stands for code points beyond the table.
_RARE = 0x25A1


def _table() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point, 255 for those that are dropped; class of a digit that stands for a letter."""
    t = np.full(_TOP, OTHER, np.uint8)
    for k in range(_TOP):
        c = chr(k)
        base = unicodedata.normalize("NFKD", c.casefold())[:1].casefold() if not c.isspace() else " "
        base = LOOKALIKE.get(c.lower(), LOOKALIKE.get(base, base))
        if "a" <= base <= "z":
            t[k] = ord(base) - 96
        elif c.isspace():
            t[k] = SPACE
        elif c.isdigit():
            t[k] = DIGIT
        elif c in "*#_":
            t[k] = STAR
        elif unicodedata.category(c)[0] in "PS":
            t[k] = STOP
        if unicodedata.category(c) in ("Cf", "Mn"):
            t[k] = 255
    for k in INVISIBLE:
        t[k] = 255
    t[2] = SPACE
    leet = np.full(_TOP, DIGIT, np.uint8)
    for d, c in DIGITS.items():
        leet[ord(d)] = ord(c) - 96
    return t, leet


CLASSES, LEET = _table()
_ENDS = np.zeros(_TOP, bool)
_ENDS[[ord(c) for c in ".!?…"]] = True


def _near(k: int) -> int:
    """Code point within the table that stands for one beyond it."""
    if k == 0xFEFF or k > 0x10FFFF or 0xD800 <= k < 0xE000:
        return 0x200B
    base = ord(unicodedata.normalize("NFKC", chr(k))[0])
    return base if base < _TOP else _RARE


#: Ends a document where several are scored together.
END_OF_TEXT = "\x02"


def symbols(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a text after normalisation, and the number of the sentence and of the document that each belongs to.

    Sentences end at line ends and at sentence marks before white space.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    far = code >= _TOP
    if far.any():  # wide and mathematical letters, rare signs: one by one, so that a text counts the same alone and among others
        kinds, at = np.unique(code[far], return_inverse=True)
        code = code.copy()
        code[far] = np.array([_near(int(k)) for k in kinds], np.uint32)[at]
    document = np.concatenate(([0], np.cumsum(code == 2)[:-1]))
    raw = CLASSES[code]
    seen = raw != 255
    code, raw, document = code[seen], raw[seen], document[seen]
    if not len(raw):
        return raw, document, document
    blank = np.append(raw[1:] == SPACE, True)
    end = (code == 10) | (code == 2) | (_ENDS[code] & blank)
    sentence = np.concatenate(([0], np.cumsum(end)[:-1]))
    letter = (raw >= 1) & (raw <= 26)
    digit = raw == DIGIT
    # a single digit beside a letter stands for a letter
    near_letter = np.append(letter[1:], False)
    near_letter[1:] |= letter[:-1]
    near_digit = np.append(digit[1:], False)
    near_digit[1:] |= digit[:-1]
    as_letter = digit & near_letter & ~near_digit
    raw = np.where(as_letter, LEET[code], raw)
    letter |= as_letter & (raw <= 26)
    # letters set apart by one mark each: the marks between them go
    single = letter.copy()
    single[1:] &= ~letter[:-1]
    single[:-1] &= ~letter[1:]
    between = ~letter & ~digit & ~end
    between[0] = between[-1] = False
    between[1:-1] &= single[:-2] & single[2:]
    raw, sentence, document = raw[~between], sentence[~between], document[~between]
    # the same class again (stretched letters, runs of blanks) counts once
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != raw[:-1]) | (sentence[1:] != sentence[:-1])
    raw, sentence, document = raw[keep], sentence[keep], document[keep]
    # nor do blanks at the edges of a sentence
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = sentence[1:] != sentence[:-1]
    keep = (raw != SPACE) | ~(edge[:-1] | edge[1:])
    return raw[keep], sentence[keep], document[keep]


PATTERNS = [(0, *p) for p in itertools.combinations(range(1, SPAN), ORDER - 1)]
_WEIGHT = [DECAY ** (p[-1] + 1 - ORDER) for p in PATTERNS]


def subsequences(s: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Per gap pattern the feature number at each place (to the place where the pattern still fits) and the weight."""
    x = s.astype(np.int32)
    for p, w in zip(PATTERNS, _WEIGHT, strict=True):
        n = len(x) - p[-1]
        if n > 0:
            f = x[:n]
            for o in p[1:]:
                f = f * ALPHABET + x[o : o + n]
            yield f, w


def features(sentence: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers, values and length of a sentence taken as one."""
    s, _, _ = symbols(sentence.replace("\n", " "))
    s = np.concatenate(([SPACE], s, [SPACE])).astype(np.uint8)
    parts = [(f, np.full(len(f), w, np.float32)) for f, w in subsequences(s)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 1.0
    f, w = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    numbers, at = np.unique(f, return_inverse=True)
    return numbers, np.bincount(at, w).astype(np.float32), float(max(LEAST, len(s)))


def gram(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """Kernel matrix of sentences given as ``features``."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = np.concatenate([f for f, _, _ in left]) if left else np.zeros(0, np.int64)
    values = np.concatenate([v for _, v, _ in left]) if left else np.zeros(0, np.float32)
    starts = np.concatenate(([0], np.cumsum([len(f) for f, _, _ in left])[:-1])).astype(np.int64)
    sizes = np.array([n for _, _, n in left], np.float32)
    dense = np.zeros(ALPHABET**ORDER, np.float32)
    for j, (f, v, n) in enumerate(right):
        dense[f] = v
        out[:, j] = np.add.reduceat(values * dense[flat], starts) / np.sqrt(sizes * n)
        dense[f] = 0
    return out


def fit(sentences: list[str], labels: np.ndarray, landmarks: list[str], weight: np.ndarray | None = None, cost: float = 30.0, steps: int = 60) -> dict:
    """Train on labelled sentences (1 or -1): model as ``landmarks, beta, bias``.

    The squared hinge loss with an L2 penalty is minimised by Newton steps on the Nyström
    features. Rows are weighted by ``weight`` if given.
    """
    marks = [features(x) for x in landmarks]
    own = gram(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    good = values > values.max() * 1e-7
    half = vectors[:, good] / np.sqrt(values[good])
    x = gram([features(s) for s in sentences], marks).astype(np.float64) @ half
    x = np.hstack([x, np.ones((len(x), 1))])
    c = cost * (np.ones(len(x)) if weight is None else weight)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        margin = 1 - labels * (x @ w)
        on = margin > 0
        xo = x[on]
        grad = ridge @ w - 2 * xo.T @ (c[on] * labels[on] * margin[on])
        move = np.linalg.solve(ridge + 2 * (xo.T * c[on]) @ xo, grad)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return {"landmarks": landmarks, "beta": (half @ w[:-1]).tolist(), "bias": float(w[-1])}


class Scorer:
    """A trained model collapsed to one weight per subsequence."""

    def __init__(self, model: dict):
        self.bias = model["bias"]
        table = np.zeros(ALPHABET**ORDER, np.float64)
        for text, b in zip(model["landmarks"], model["beta"], strict=True):
            f, v, n = features(text)
            table[f] += b * v / np.sqrt(n)
        self.table = table.astype(np.float32)

    def sentences(self, text: str, windows: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Score of each sentence of a text (positive: abusive) and the number of its document, in order.

        ``windows``: a long sentence also counts by its windows from every start to the one
        that ends with it, as a lost mark may join an insult to harmless text.
        """
        s, number, document = symbols(text)
        if not len(s):
            return np.zeros(0, np.float32), np.zeros(0, np.int64)
        begin = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        sizes = np.diff(np.append(begin, len(s))) + 2  # a blank before and after each
        owner = np.repeat(np.arange(len(begin), dtype=np.int32), sizes)
        x = np.zeros(len(owner), np.int32)
        x[np.arange(len(s)) + 2 * np.repeat(np.arange(len(begin)), sizes - 2) + 1] = s
        total = np.zeros(len(x), np.float32)
        across = {r: owner[: len(x) - r] != owner[r:] for r in {p[-1] for p in PATTERNS} if len(x) > r}
        for p, w in zip(PATTERNS, _WEIGHT, strict=True):
            r = p[-1]
            if r not in across:
                continue
            f = x[: len(x) - r]
            for o in p[1:]:
                f = f * ALPHABET + x[o : o + len(x) - r]
            part = self.table[f]
            part *= np.float32(w)
            part[across[r]] = 0
            total[: len(x) - r] += part
        score = np.add.reduceat(total.astype(np.float64), np.cumsum(sizes) - sizes) / np.sqrt(np.maximum(sizes, LEAST)) + self.bias
        long = np.flatnonzero(sizes >= WINDOW)
        if windows and len(long):
            sums = np.concatenate(([0.0], np.cumsum(total, dtype=np.float64)))
            part = sums[WINDOW:] - sums[:-WINDOW]
            part[owner[: len(part)] != owner[WINDOW - 1 :]] = -np.inf
            best = np.maximum.reduceat(part, (np.cumsum(sizes) - sizes)[long])
            score[long] = np.maximum(score[long], best / np.sqrt(WINDOW) + self.bias - MARGIN)
        return score.astype(np.float32), document[begin]

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Score of the worst sentence of each text (-1 without sentences) and number of abusive sentences; scored in chunks."""
        worst, bad = np.full(len(texts), -1.0), np.zeros(len(texts), np.int64)
        group: list[int] = []
        size = 0
        for k, t in enumerate([*texts, None]):
            if t:
                group.append(k)
                size += len(t)
            if group and (size > CHUNK or k == len(texts)):
                joined = "".join([texts[g].replace(END_OF_TEXT, " ") + END_OF_TEXT for g in group])
                s, d = self.sentences(joined, windows=True)
                got = np.full(len(group), -np.inf)
                np.maximum.at(got, d, s)
                np.add.at(bad, np.array(group)[d[s > 0]], 1)
                worst[group] = np.where(np.isfinite(got), got, -1.0)
                group, size = [], 0
        return worst, bad


def load() -> Scorer:
    """The trained model."""
    return Scorer(json.loads(pkgutil.get_data("linkflow.llm", "abuse.json")))


SCORES = "doc_id long, source string, score double, n_bad long"


def score_documents(documents: DataFrame, model: dict | None = None) -> DataFrame:
    """``doc_id, source, score, n_bad``: score of the worst sentence, number of sentences above 0; one narrow stage."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model) if model else load()
        for f in frames:
            score, bad = scorer.documents(f["text"].tolist())
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "score": score, "n_bad": bad})

    return spread(documents.select("doc_id", "source", "text"), "doc_id").mapInPandas(run, SCORES)


def abusive_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the documents with at least one sentence above 0."""
    return score_documents(documents).where(F.col("n_bad") > 0).select("doc_id")


def rates(documents: DataFrame) -> DataFrame:
    """``source, n_docs, n_bad, rate`` per source; null is a source of its own."""
    bad = F.sum(F.when(F.col("n_bad") > 0, 1).otherwise(0))
    return score_documents(documents).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), bad.alias("n_bad"), (bad / F.count(F.lit(1))).alias("rate"))
