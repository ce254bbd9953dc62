"""Quality rules: base statistics of words and lines, and a linear-chain conditional random field over lines.

Each line of a text is content or boilerplate. Only documents are labelled, so the lines' labels are latent: a model of
single lines, told nothing but the quality of their documents, gives the first ones; then fields are fitted to labelled
lines and label them anew. Runs of poor documents' lines, put into good documents, show the fields how boilerplate begins
and ends. Viterbi decoding labels the lines of a text; the share of bytes in content lines decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import SPACE, Block, Spans, give_back, slices

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), list(s)) for s in (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"))
_STOP = np.isin(np.arange(256), list(b".!?:;"))
_BANG = np.isin(np.arange(256), list(b"!?"))

#: Edges of the bins that line measures fall in; the bins of all measures are the field's features.
_BINS = {
    "symbols": np.array([0.002, 0.02, 0.06, 0.12]),
    "upper": np.array([0.08, 0.2, 0.5]),
    "bangs": np.array([0.01, 0.05, 0.15]),
    "digits": np.array([0.05, 0.2]),
    "words": np.array([1, 2, 4, 8, 16, 64]),
    "echo": np.array([0.05, 0.2, 0.5]),
    "length": np.array([3.0, 6.0, 10.0, 20.0]),
}
#: Lines beyond which a sequence is decoded by itself, and cut in training.
_LONG = 512
FEATURES = sum(len(b) + 1 for b in _BINS.values()) + 2


class LineBlock(Block):
    """A block with its words, lines and the field's features of each line that has a word."""

    def __init__(self, texts: list[bytes]):
        super().__init__(texts)
        self.words()
        n = len(self.start)
        own = self.word = self.word_values()
        repeats = np.zeros(n, bool)
        repeats[1:] = (own[1:] == own[:-1]) & (self.word_doc[1:] == self.word_doc[:-1])

        # a line ends at a line feed or with its text
        ends = np.union1d(np.flatnonzero(self.buffer == 10), self.last)
        starts = np.concatenate([[0], ends[:-1] + 1])
        w0, w1 = np.searchsorted(self.start, starts), np.searchsorted(self.start, ends)
        full = w1 > w0
        self.line_start, self.line_end, w0, w1 = starts[full], ends[full], w0[full], w1[full]
        self.line_doc = self.word_doc[w0] if len(w0) else np.zeros(0, np.int64)
        self.line_first = np.searchsorted(self.line_doc, np.arange(len(texts) + 1))

        def share(table: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(table[self.buffer], dtype=np.int64)])
            return (c[self.line_end] - c[self.line_start]) / size

        size = np.maximum(self.line_end - self.line_start, 1)
        n_words = w1 - w0
        echoes = np.concatenate([[0], np.cumsum(repeats)])
        measures = {
            "symbols": share(_SYMBOL), "upper": share(_UPPER), "bangs": share(_BANG), "digits": share(_DIGIT), "words": n_words,
            "echo": (echoes[w1] - echoes[w0]) / np.maximum(n_words, 1), "length": size / np.maximum(n_words, 1),
        }
        columns, base = [], 0
        for name, edges in _BINS.items():
            columns.append(base + np.searchsorted(edges, measures[name], side="right"))
            base += len(edges) + 1
        stop = _STOP[self.buffer[self.end[w1 - 1] - 1]] if len(w0) else np.zeros(0, bool)
        columns.append(base + stop)
        self.features = np.stack(columns, axis=1) if len(w0) else np.zeros((0, len(columns)), np.int64)

    def base(self) -> dict[str, np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
        chars = np.concatenate([[0], np.cumsum(~SPACE[self.buffer] & ((self.buffer & 0xC0) != 0x80), dtype=np.int64)])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[self.buffer], dtype=np.int64)])
        dup = np.zeros(len(self.texts), np.int64)
        for d, text in enumerate(self.texts):
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            dup[d] = len(lines) - len(set(lines))
        return {
            "n_words": self.n_words, "word_chars": chars[self.last] - chars[self.first], "n_symbols": symbols[self.last] - symbols[self.first],
            "n_dup_lines": dup, "n_repeat_words": self._repeats(8),
        }

    def _repeats(self, width: int) -> np.ndarray:
        """Words in windows of ``width`` words that a text has twice or more."""
        n = len(self.start)
        at = np.arange(max(n - width + 1, 0))
        at = at[self.word_doc[at] == self.word_doc[at + width - 1]] if len(at) else at
        found = np.zeros(len(self.texts), np.int64)
        if not len(at):
            return found
        key, doc = Spans(self.word).fixed(width)[at], self.word_doc[at]
        order = np.lexsort((key, doc))
        key, doc, at = key[order], doc[order], at[order]
        same = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
        # 64 bits find the windows of a text that may be equal, all their words' numbers confirm it
        near = np.flatnonzero(same)
        same[near] = (self.word[at[near, None] + np.arange(width)] == self.word[at[near + 1, None] + np.arange(width)]).all(axis=1)
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, at[twice], 1)
        np.add.at(marks, at[twice] + width, -1)
        covered = np.cumsum(marks)[:-1] > 0
        np.add.at(found, self.word_doc[covered], 1)
        return found


def _steps(first: np.ndarray, lengths: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Step t and the sequences that have one, for sequences of rows first[d] to first[d + 1] or of given lengths."""
    lengths = np.diff(first) if lengths is None else lengths
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    for t in range(int(lengths[0]) if len(lengths) else 0):
        yield t, order[: np.searchsorted(-lengths, -t, side="left")]


class LineField:
    """Weights of the field: ``emit`` (features x 2 labels) and ``move`` (2 x 2). Label 1 is content."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(axis=1)

    def viterbi(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels of each sequence; of equal paths the one with content.

        Short sequences go one step at a time all together, long ones each by themselves, so that one very long text
        among short ones costs no more than its lines.
        """
        unary = self.scores(features)
        labels = np.zeros(len(features), np.int8)
        lengths = np.diff(first)
        for d in np.flatnonzero(lengths > _LONG):
            labels[first[d] : first[d + 1]] = self._one(unary[first[d] : first[d + 1]])
        n = len(first) - 1
        best = np.zeros((n, 2))
        back = np.zeros((len(features), 2), np.int8)
        steps = list(_steps(first, np.where(lengths > _LONG, 0, lengths)))
        for t, seq in steps:
            row = first[seq] + t
            if t:
                paths = best[seq][:, :, None] + self.move[None]
                back[row] = (paths[:, 1] >= paths[:, 0]).astype(np.int8)
                best[seq] = paths.max(axis=1) + unary[row]
            else:
                best[seq] = unary[row]
        state = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for t, seq in reversed(steps):
            row = first[seq] + t
            ends = row == first[seq + 1] - 1
            state[seq] = np.where(ends, state[seq], np.take_along_axis(back[np.minimum(row + 1, len(features) - 1)], state[seq][:, None], 1)[:, 0])
            labels[row] = state[seq]
        return labels

    def _one(self, unary: np.ndarray) -> np.ndarray:
        """The best labels of one sequence."""
        (stay0, to1), (to0, stay1) = self.move.tolist()
        (b0, b1), *rest = unary.tolist()
        back = []
        for u0, u1 in rest:
            from1 = b1 + to0 >= b0 + stay0, b1 + stay1 >= b0 + to1
            back.append(from1)
            b0, b1 = (b1 + to0 if from1[0] else b0 + stay0) + u0, (b1 + stay1 if from1[1] else b0 + to1) + u1
        state = int(b1 >= b0)
        out = [state]
        for from1 in reversed(back):
            state = int(from1[state])
            out.append(state)
        return np.array(out[::-1], np.int8)

    def gradient(self, features: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of the labels and its gradient, by the forward-backward recursion."""
        unary = self.scores(features)
        alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
        steps = list(_steps(first))
        for t, seq in steps:
            row = first[seq] + t
            alpha[row] = unary[row] + (np.logaddexp.reduce(alpha[row - 1][:, :, None] + self.move[None], axis=1) if t else 0)
        for t, seq in reversed(steps):
            row = first[seq] + t
            more = row < first[seq + 1] - 1
            nxt = row[more] + 1
            beta[row[more]] = np.logaddexp.reduce(self.move[None] + (unary[nxt] + beta[nxt])[:, None, :], axis=2)
        filled = np.flatnonzero(np.diff(first) > 0)
        total = np.zeros(len(first) - 1)
        total[filled] = np.logaddexp.reduce(alpha[first[filled + 1] - 1], axis=1)
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        p = np.exp(alpha + beta - total[of][:, None])
        target = np.eye(2)[labels]
        g_emit = np.zeros_like(self.emit)
        for c in range(features.shape[1]):
            np.add.at(g_emit, features[:, c], target - p)
        a = np.flatnonzero(of[1:] == of[:-1])
        both = np.exp(alpha[a][:, :, None] + self.move[None] + (unary[a + 1] + beta[a + 1])[:, None, :] - total[of[a]][:, None, None])
        g_move = np.zeros((2, 2))
        np.add.at(g_move, (labels[a], labels[a + 1]), 1.0)
        g_move -= both.sum(axis=0)
        fit = unary[np.arange(len(unary)), labels].sum() + self.move[labels[a], labels[a + 1]].sum() - total.sum()
        return float(fit), g_emit, g_move

    @classmethod
    def fit(cls, features: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.15, decay: float = 1.0, moves: bool = True) -> LineField:
        """Maximum likelihood with an L2 penalty, by Adam over all sequences; the same input gives the same weights.

        Without ``moves`` lines are taken one by one.
        """
        field = cls(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
        params = [field.emit, field.move]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for k in range(1, rounds + 1):
            _, *grads = field.gradient(features, first, labels)
            if not moves:
                grads[1][:] = 0
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = (g - decay * p) / max(len(first) - 1, 1)
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p += rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
        return field


def _stretches(lines: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lines, where sequences of at most _LONG of them begin, and their labels."""
    sizes = [min(_LONG, len(x) - k) for x in lines for k in range(0, len(x), _LONG)]
    return np.concatenate(lines), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.concatenate(labels)


def _line_labels(field: LineField, lines: list[np.ndarray], good: np.ndarray) -> list[np.ndarray]:
    """Labels of lines by the field and by their document's quality: content has the better half of a good document's
    lines at least, and of a poor one's not more than that."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    x = np.concatenate(lines)
    every, u = field.viterbi(x, first), field.scores(x)
    margin, out = u[:, 1] - u[:, 0], []
    for d, g in enumerate(good):
        own, lead = every[first[d] : first[d + 1]].astype(np.int64), margin[first[d] : first[d + 1]]
        better = np.argsort(np.argsort(-lead, kind="stable"), kind="stable") < len(own) / 2
        if 2 * own.sum() < len(own) if g else 2 * own.sum() > len(own):
            own = np.where(better, own if not g else 1, 0 if not g else own)
        out.append(own)
    return out


def _spliced(lines: list[np.ndarray], labels: list[np.ndarray], good: np.ndarray, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Good documents, each with a run of boilerplate lines of some poor one put in at a random place."""
    rng = np.random.default_rng(seed)
    poor = [x[y == 0] for x, y, g in zip(lines, labels, good, strict=True) if not g and (y == 0).any()]
    out_x, out_y = [], []
    for x, y in [(x, y) for x, y, g in zip(lines, labels, good, strict=True) if g] if poor else []:
        run = poor[rng.integers(len(poor))]
        k = int(rng.integers(1, min(len(run), 8) + 1))
        low, at = int(rng.integers(0, len(run) - k + 1)), int(rng.integers(0, len(x) + 1))
        out_x.append(np.concatenate([x[:at], run[low : low + k], x[at:]]))
        out_y.append(np.concatenate([y[:at], np.zeros(k, np.int64), y[at:]]))
    return out_x, out_y


def fit_field(lines: list[np.ndarray], good: np.ndarray, rounds: int = 2, seed: int = 11) -> LineField:
    """The field from the features of each document's lines and whether the document is good."""
    lines, good = [x for x in lines if len(x)], np.array([g for x, g in zip(lines, good, strict=True) if len(x)], bool)
    if good.all() or not good.any():
        return LineField(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    labels = [np.full(len(x), int(g)) for x, g in zip(lines, good, strict=True)]
    field = LineField.fit(*_stretches(lines, labels), moves=False)
    for k in range(rounds):
        labels = _line_labels(field, lines, good)
        more, theirs = _spliced(lines, labels, good, seed + k)
        field = LineField.fit(*_stretches(lines + more, labels + theirs))
    return field


def train_field(docs: DataFrame, labels: DataFrame, most_docs: int = 2000) -> LineField:
    """The field, from at most about ``most_docs`` labelled documents, half of them of each quality.

    The sample is drawn by a hash of doc_id, so reruns agree; its ids, bounded by ``most_docs``, are broadcast. Executors
    send their lines' features, one byte each, and no text. Documents that fail the base rules teach nothing, as the
    field has no say in them. Without a document of either quality that is left, or with empty tables, every line is taken
    for content; null ids, texts and qualities teach nothing.
    """
    marked = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    grain = 1 << 30
    keep = F.lit(False)
    for q, n in counts.items():
        keep = F.when(F.col("quality") == q, F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < min(grain, grain * (most_docs // 2) // max(n, 1))).otherwise(keep)
    sample = docs.select("doc_id", "text").where(F.octet_length("text") > 0).join(F.broadcast(marked.where(keep)), "doc_id").select("doc_id", "quality", "text")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch["text"]):
                block = LineBlock(texts)
                failed = base_failed(block.base())
                parts = [b"" if failed[d] else block.features[block.line_first[d] : block.line_first[d + 1]].astype(np.uint8).tobytes() for d in range(len(texts))]
                yield pa.record_batch([batch["doc_id"].slice(at, len(texts)), batch["quality"].slice(at, len(texts)), pa.array(parts, pa.binary())], ["doc_id", "quality", "lines"])

    id_type = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(lines, f"doc_id {id_type}, quality int, lines binary").toPandas().sort_values(["doc_id", "quality", "lines"])
    return fit_field([np.frombuffer(x, np.uint8).reshape(-1, len(_BINS) + 1).astype(np.int64) for x in rows["lines"]], rows["quality"].to_numpy() == 1)


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])


def _verdicts(texts: list[bytes], field: LineField, least_share: float) -> dict[str, np.ndarray]:
    block = LineBlock(texts)
    out = block.base()
    lines = field.viterbi(block.features, block.line_first)
    size = block.line_end - block.line_start
    total, content = np.zeros(len(texts)), np.zeros(len(texts))
    np.add.at(total, block.line_doc, size)
    np.add.at(content, block.line_doc, size * lines)
    out["content_share"] = np.where(total > 0, content / np.maximum(total, 1), 0.0)
    out["base_failed"] = base_failed(out)
    out["kept"] = ~out["base_failed"] & (out["content_share"] >= least_share)
    return out


_OUT = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "content_share": pa.float64(), "base_failed": pa.bool_(), "kept": pa.bool_(),
}


def score_quality(docs: DataFrame, field: LineField, least_share: float = 0.5) -> DataFrame:
    """doc_id, base statistics, content_share, base_failed and kept of every row of ``docs`` (doc_id, text).

    ``kept`` is false if base_failed, else whether at least ``least_share`` of the bytes in lines with a word lie in
    content lines. Null text: as empty, so no words and base_failed. Rows are judged one by one: null or repeated doc_id
    and repeated rows stay as they are; other columns are ignored. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for at, texts in slices(batch["text"]):
                out = _verdicts(texts, field, least_share)
                yield pa.record_batch([batch["doc_id"].slice(at, len(texts)), *[pa.array(out[k], t) for k, t in _OUT.items()]], ["doc_id", *_OUT])

    rows = docs.select("doc_id", "text")
    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kinds}")


def keep_good(docs: DataFrame, field: LineField, least_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`score_quality` keeps, with all their columns; cases as there."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for at, texts in slices(batch["text"]):
                yield batch.slice(at, len(texts)).filter(pa.array(_verdicts(texts, field, least_share)["kept"]))

    return docs.mapInArrow(run, schema)
