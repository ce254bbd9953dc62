"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic regressions over features of the text; each later link also gets
the log odds that the chain gave to the earlier categories. It is trained on odds that links gave to documents they were
not trained on, so it learns how far to trust them. A category within another one has its link trained inside that one
and its probability is the product, so no part is likelier than the whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import give_back, slices

_TO_SPACE = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))
_PREFIXES = (4, 5, 6)
_CACHE = 500_000
_SYMBOLS, _UPPER, _DIGITS = (np.isin(np.arange(256), list(s)) for s in (b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"))
#: Shares of a text's bytes (echo: of its words) from which on it has the feature.
_SHARES = {"symbols": (0.01, 0.05), "bangs": (0.01, 0.05), "upper": (0.1, 0.3), "digits": (0.05, 0.2), "echo": (0.02, 0.2)}


#: Shares of a text's words from which on a word, or a beginning of words, is present in a higher degree.
_DEGREES = (0.0, 0.005, 0.02)


def _hash(name: bytes) -> int:
    """61 bits, of which the features of each degree are made by adding two more."""
    return xxhash.xxh64_intdigest(name) >> 3


_LAYOUT = {(k, edge): 4 * _hash(b"\x00" + f"{k}>={edge}".encode()) for k, edges in _SHARES.items() for edge in edges}


def _names(word: bytes) -> Iterator[bytes]:
    """Features of a word: itself, and the beginnings by which its family is told."""
    yield word + b" "
    for n in _PREFIXES:
        if len(word) > n:
            yield word[:n]


def _layout(text: bytes, words: list[bytes]) -> Iterator[int]:
    """Features of how a text is set."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(len(text), 1)
    share = {"symbols": counts[_SYMBOLS].sum() / size, "bangs": counts[33] / size, "upper": counts[_UPPER].sum() / size, "digits": counts[_DIGITS].sum() / size}
    share["echo"] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1)
    return (h for (k, edge), h in _LAYOUT.items() if share[k] >= edge)


def _words(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(_TO_SPACE).split()


def _degrees(counts: dict[int, int], n: int) -> Iterator[int]:
    """Features of words that occur so often among ``n``: one for each degree that they reach."""
    return (4 * h + k for h, c in counts.items() for k, edge in enumerate(_DEGREES) if c >= edge * n)


def features(text: bytes) -> np.ndarray:
    """Sorted distinct 63-bit numbers of all features of a text."""
    words, counts = _words(text), {}
    for w, c in Counter(words).items():
        for f in _names(w):
            h = _hash(f)
            counts[h] = counts.get(h, 0) + c
    return np.array(sorted({*_degrees(counts, len(words)), *_layout(text, words)}), np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the bias last, of an L2-penalised logistic regression in which both classes weigh the same, by Newton's
    method. Without rows of either class only the bias is set, to near certainty of the class that is there, or without any
    row against the category."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    if not (y == 1).any() or not (y == 0).any():
        w[-1] = 20.0 if len(y) and y[0] == 1 else -20.0
        return w
    weight = np.where(y == 1, 0.5 * len(y) / (y == 1).sum(), 0.5 * len(y) / (y == 0).sum())
    penalty = np.full(x.shape[1], decay)
    penalty[-1] = 1e-6
    value = lambda w: float((weight * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + (penalty * w * w).sum() / 2)
    now = value(w)
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step, scale = np.linalg.solve(h, g), 1.0
        while (new := value(w - scale * step)) > now + 1e-9 and scale > 1e-6:
            scale /= 2
        w, done, now = w - scale * step, abs(now - new) < 1e-9, new
        if done:
            break
    return w


@dataclass
class ToxicityChain:
    """Categories in chain order, the columns of features by hash, and each link's weights (features, earlier odds, bias),
    the categories that it lies within, and its threshold."""

    categories: list[str]
    columns: dict[int, int]
    weights: list[np.ndarray]
    within: list[tuple[int, ...]]
    thresholds: list[float]
    _seen: dict[bytes, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def columns_of(self, text: bytes) -> list[int]:
        """Columns of the features that a text has."""
        seen, counts, words, columns = self._seen, {}, _words(text), self.columns
        if len(seen) > _CACHE:
            seen.clear()
        for w, c in Counter(words).items():
            has = seen.get(w)
            if has is None:
                has = seen[w] = tuple(h for f in _names(w) if any(4 * (h := _hash(f)) + k in columns for k in range(len(_DEGREES))))
            for h in has:
                counts[h] = counts.get(h, 0) + c
        return [columns[h] for h in (*_degrees(counts, len(words)), *_layout(text, words)) if h in columns]

    def predict(self, texts: Sequence[bytes]) -> np.ndarray:
        """Probability of each category, one column each, for each text; all texts link by link."""
        found = [self.columns_of(t) for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        column = np.fromiter((c for f in found for c in f), np.int64, len(row))
        n = len(self.columns)
        out, odds = np.zeros((len(texts), len(self.categories))), np.zeros((len(texts), len(self.categories)))
        for k, w in enumerate(self.weights):
            z = np.bincount(row, weights=w[column], minlength=len(texts)) + odds[:, :k] @ w[n : n + k] + w[-1]
            out[:, k] = _inside(_sigmoid(z), out, self.within[k])
            odds[:, k] = _odds(out[:, k])
        return out


def _odds(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-6, 1 - 1e-6)) - np.log1p(-np.clip(p, 1e-6, 1 - 1e-6))


def _inside(p: np.ndarray, earlier: np.ndarray, within: tuple[int, ...]) -> np.ndarray:
    """The probability of a category from that of its link: times the first one it lies within, no more than any of them."""
    if not within:
        return p
    return np.minimum(p * earlier[:, within[0]], earlier[:, list(within)].min(axis=1))


def _telling(ids: np.ndarray, y: np.ndarray, n_features: int, doc: np.ndarray, error: float = 0.05) -> np.ndarray:
    """Features whose share of documents of a class can't be chance, at this error over all features together.

    By Chernoff's bound: n documents of which a share of q has the class, where all have a share of p, come about with a
    probability of exp(-n KL(q, p)) at most.
    """
    if not len(ids):
        return np.zeros(0, np.int64)
    n = np.bincount(ids, minlength=n_features)
    q = np.bincount(ids, weights=y[doc], minlength=n_features) / np.maximum(n, 1)
    p = min(max(float(y.mean()), 1e-9), 1 - 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(q > 0, q * np.log(q / p), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - p)), 0)
    return np.flatnonzero(n * kl > math.log(2 * max(int((n > 0).sum()), 1) / error))


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability at which out-of-fold decisions have the best F1, halfway to the next lower one; 0.5 without cases."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = 0
    best = int(f1.argmax())
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def train_chain(found: list[np.ndarray], labels: dict[str, np.ndarray], fold: np.ndarray, within: dict[str, tuple[str, ...]] | None = None) -> ToxicityChain:
    """A chain over ``labels`` (category to 0/1, in chain order) from each text's features; ``fold`` says which fold it is in.

    The features of a link are those that tell its category's documents from the others, in the training part alone.
    """
    names, within = list(labels), within or {}
    parents = [tuple(names.index(p) for p in within.get(c, ())) for c in names]
    doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
    every, ids = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_inverse=True)
    ys = [np.asarray(y, np.int64) for y in labels.values()]

    def matrix(columns: np.ndarray) -> np.ndarray:
        place = np.full(len(every), -1)
        place[columns] = np.arange(len(columns))
        x, use = np.zeros((len(found), len(columns))), place[ids] >= 0
        x[doc[use], place[ids][use]] = 1
        return x

    def link(k: int, rows: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and weights of one link, trained on ``rows``, of a part of the whole only on those of the whole."""
        for p in parents[k][:1]:
            rows = rows & (ys[p] == 1)
        use = rows[doc]
        columns = _telling(ids[use], ys[k] if rows.all() else np.where(rows, ys[k], 0), len(every), doc[use]) if rows.any() else np.zeros(0, np.int64)
        x = np.concatenate([matrix(columns), odds[:, :k]], axis=1)
        return columns, fit_logistic(x[rows], ys[k][rows])

    def apply(columns: np.ndarray, w: np.ndarray, odds: np.ndarray, k: int) -> np.ndarray:
        return _sigmoid(np.concatenate([matrix(columns), odds[:, :k]], axis=1) @ w[:-1] + w[-1])

    p, odds = np.zeros((len(found), len(names))), np.zeros((len(found), len(names)))
    final = []
    for k in range(len(names)):
        for f in np.unique(fold):
            out = fold == f
            p[out, k] = _inside(apply(*link(k, ~out, odds), odds, k), p, parents[k])[out]
        final.append(link(k, np.ones(len(found), bool), odds))
        odds[:, k] = _odds(p[:, k])
    used = np.unique(np.concatenate([c for c, _ in final] + [np.zeros(0, np.int64)]))
    weights = []
    for columns, w in final:
        wide = np.zeros(len(used))
        wide[np.searchsorted(used, columns)] = w[: len(columns)]
        weights.append(np.concatenate([wide, w[len(columns) :]]))
    return ToxicityChain(names, {int(every[c]): k for k, c in enumerate(used)}, weights, parents, [_threshold(p[:, k], ys[k]) for k in range(len(names))])


def train_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], within: dict[str, tuple[str, ...]] | None = None, most_docs: int = 4000, folds: int = 5) -> ToxicityChain:
    """A chain from labelled documents: ``categories`` are boolean columns over ``labels`` (doc_id and more), in chain order.

    At most about ``most_docs`` labelled documents are used, whole, drawn by a hash of doc_id that also deals the folds;
    their ids are broadcast and their features' hashes come to the driver. A null category counts as false; null ids and
    texts teach nothing. Without any labelled document every probability is near 0 and nothing is toxic.
    """
    grain = 1 << 30
    n = labels.count()
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < min(grain, grain * most_docs // max(n, 1)))
    marks = [f"_c{k}" for k in range(len(categories))]
    picked = picked.select("doc_id", *[F.coalesce(c, F.lit(False)).cast("int").alias(m) for c, m in zip(categories.values(), marks, strict=True)])
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    rows = rows.select("text", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int").alias("_fold"), *marks)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for at, texts in slices(batch["text"]):
                own = [batch[c].slice(at, len(texts)) for c in ("_fold", *marks)]
                yield pa.record_batch([pa.array([features(t).tobytes() for t in texts], pa.binary()), *own], ["_found", "_fold", *marks])

    told = rows.mapInArrow(extract, "_found binary, _fold int" + "".join(f", {m} int" for m in marks)).toPandas().sort_values(["_fold", *marks, "_found"])
    found = [np.frombuffer(f, np.int64) for f in told["_found"]]
    return train_chain(found, {c: told[m].to_numpy() for c, m in zip(categories, marks, strict=True)}, told["_fold"].to_numpy(), within)


def score_toxicity(docs: DataFrame, chain: ToxicityChain, verdict: str = "toxic") -> DataFrame:
    """doc_id, a probability ``p_<category>`` for each category and ``toxic``, for every row of ``docs`` (doc_id, text).

    ``toxic``: the probability of category ``verdict``, which rests on all links before it, reaches its threshold. Whole
    texts are judged one by one; null and wordless texts have no feature and get what the biases say. Null or repeated
    doc_id and repeated rows stay as they are; other columns are ignored. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # the telling features of a bounded sample
    names, at_last = [f"p_{c}" for c in chain.categories], chain.categories.index(verdict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            give_back()
            for at, texts in slices(batch["text"]):
                p = model.predict(texts)
                toxic = p[:, at_last] >= model.thresholds[at_last]
                yield pa.record_batch([batch["doc_id"].slice(at, len(texts)), *[pa.array(c) for c in p.T.copy()], pa.array(toxic)], ["doc_id", *names, "toxic"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + "".join(f"{n} double, " for n in names) + "toxic boolean")
