"""Document quality from a linear-chain conditional random field over lines.

Every line gets measures of its own (length, capitals, digits, symbols, punctuation, repeated and distinct words, word
length, repetition inside the document). The field's state scores add a weight per measure's bin for the line, for the line
before and for the line behind; a 2 x 2 table scores the step from label to label. Forward-backward marginals P(good),
weighted by line length, aggregate into the document's quality, which one logistic step calibrates.

Labels exist per document only, so training starts with them on every line and then lets the field relabel the lines of
bad documents. Training reads a bounded sample: at most `sample` labelled documents of the training fold in the order of
a hash of doc_id, and of these as many as hold `sample_lines` lines; everything else covers all rows.

Defined results: null and blank texts have no line and score the training sample's share of good documents (0.5 without
labels); several labels of one document count as their maximum; null labels and null doc_ids teach nothing; a field without
two classes to learn from scores every document with that share; lines end at "\\n"; very long texts are read whole, line by line;
rows that repeat a doc_id score each by its own text; extra columns, whatever their names, are ignored by `score` and kept by
`keep_good`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean

MEASURES = 9
COMMON_MARKS = ".,;:!?'\"()-–—«»¿¡„“”‘’…"


def _classes() -> np.ndarray:
    """Character class of code points below 0x3000: 0 lower or other letter, 1 capital, 2 digit, 3 space, 4 mark, 5 symbol."""
    out = np.zeros(0x3000, np.uint8)
    for i in range(len(out)):
        c = chr(i)
        out[i] = 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in COMMON_MARKS else 0 if c.isalpha() or c.isalnum() else 5
    return out


_CLASSES = _classes()


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines per text, characters per line, measures per line) of all lines that aren't blank."""
    lines: list[str] = []
    n_lines, repeats, distinct, again, words = [], [], [], [], []
    for text in texts:
        seen: set[str] = set()
        had = len(lines)
        for line in (text or "").split("\n"):
            w = line.split()
            if not w:
                continue
            lines.append(line)
            n = len(w)
            words.append(n)
            repeats.append(sum(map(eq, w, w[1:])) / n)
            distinct.append(len(set(w)) / n)
            again.append(line in seen)
            seen.add(line)
        n_lines.append(len(lines) - had)
    if not lines:
        return np.array(n_lines, np.int64), np.zeros(0), np.zeros((0, MEASURES), np.float32)
    points = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _CLASSES[np.minimum(points, len(_CLASSES) - 1)]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    counts = []
    for k in (1, 2, 4, 5):
        total = np.concatenate(([0], np.cumsum(kinds == k, dtype=np.int32)))
        counts.append(total[ends] - total[starts])
    total = np.concatenate(([0], np.cumsum(kinds == 0, dtype=np.int32)))
    upper, digit, mark, symbol = counts
    letters = upper + total[ends] - total[starts]
    w = np.array(words, float)
    out = np.column_stack([
        np.log1p(sizes), upper / np.maximum(letters, 1), digit / sizes, symbol / sizes, mark / w,
        repeats, distinct, np.log1p(letters / w), again,
    ]).astype(np.float32)
    return np.array(n_lines, np.int64), sizes.astype(float), out


def marginals(score: np.ndarray, step: np.ndarray, n_lines: np.ndarray, counts: bool = False):
    """P(good) of each line by forward-backward; with counts also the expected number of each step.

    score: log weight of good against bad per line; chains lie one behind another. Chains of all lengths advance
    together: at position t the still active ones are a prefix of the chains ordered by length.
    """
    order = np.argsort(-n_lines, kind="stable")
    n = n_lines[order]
    first = (np.cumsum(n_lines) - n_lines)[order]
    most = int(n[0]) if len(n) else 0
    active = len(n) - np.searchsorted(n[::-1], np.arange(1, most + 1), "left")
    local = np.ones((len(score), 2))
    local[:, 1] = np.exp(np.clip(score, -30, 30))
    move = np.exp(step)
    ahead, behind = np.empty_like(local), np.ones_like(local)
    for t in range(most):
        at = first[: active[t]] + t
        a = local[at] if t == 0 else local[at] * (ahead[at - 1] @ move)
        ahead[at] = a / a.sum(1, keepdims=True)
    for t in range(most - 2, -1, -1):
        at = first[: active[t + 1]] + t
        b = (local[at + 1] * behind[at + 1]) @ move.T
        behind[at] = b / b.sum(1, keepdims=True)
    both = ahead * behind
    good = both[:, 1] / both.sum(1)
    if not counts:
        return good
    inner = np.ones(len(score), bool)
    ends = np.cumsum(n_lines[n_lines > 0]) - 1
    inner[ends] = False
    at = np.flatnonzero(inner)
    pair = ahead[at][:, :, None] * move[None] * (local[at + 1] * behind[at + 1])[:, None, :]
    return good, (pair / pair.sum((1, 2), keepdims=True)).sum(0), at


@dataclass
class Field:
    """A trained field: bin edges and weights per measure (line itself, before, behind), step table, calibration."""

    edges: list[np.ndarray]
    weights: np.ndarray
    step: np.ndarray
    slope: float
    offset: float
    share: float

    def columns(self, values: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """The 3 x MEASURES weights that apply to each line; the last column is a chain's missing neighbour."""
        width = self.weights.shape[2] - 1
        own = np.column_stack([np.searchsorted(e, values[:, m], "right") for m, e in enumerate(self.edges)]) if len(values) else np.zeros((0, MEASURES), int)
        before, behind = np.full_like(own, width), np.full_like(own, width)
        before[1:], behind[:-1] = own[:-1], own[1:]
        n = n_lines[n_lines > 0]
        ends = np.cumsum(n)
        before[ends - n], behind[ends - 1] = width, width
        return np.stack([own, before, behind], 1)

    def line_scores(self, columns: np.ndarray) -> np.ndarray:
        a, b = np.ogrid[:3, :MEASURES]
        return self.weights[a, b, columns].sum((1, 2))

    def aggregate(self, good: np.ndarray, sizes: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals; not a number without lines."""
        doc = np.repeat(np.arange(len(n_lines)), n_lines)
        total = np.bincount(doc, sizes, len(n_lines))
        with np.errstate(invalid="ignore"):
            return np.bincount(doc, good * sizes, len(n_lines)) / total

    def quality(self, texts: list[str | None]) -> np.ndarray:
        n_lines, sizes, values = measure(texts)
        good = marginals(self.line_scores(self.columns(values, n_lines)), self.step, n_lines)
        mean = self.aggregate(good, sizes, n_lines)
        return np.where(np.isnan(mean), self.share, _squash(self.slope * np.nan_to_num(mean) + self.offset))

    def line_marginals(self, text: str | None) -> list[float]:
        n_lines, _, values = measure([text])
        return marginals(self.line_scores(self.columns(values, n_lines)), self.step, n_lines).tolist()


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(n_lines: np.ndarray, sizes: np.ndarray, values: np.ndarray, labels: np.ndarray, bins: int = 6, rounds: int = 3, steps: int = 60) -> Field:
    """Fits the field to documents with labels 0 and 1 by regularised likelihood (Adam), relabelling between rounds."""
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    share = float(labels.mean()) if len(labels) else 0.5
    of_line = labels[doc] if len(doc) else np.zeros(0)
    edges = []
    for m in range(MEASURES):
        cuts = [np.quantile(values[of_line == k, m], np.linspace(0, 1, bins + 1)[1:-1]) for k in (0, 1) if (of_line == k).any()]
        edges.append(np.unique(np.concatenate(cuts)) if cuts else np.zeros(0))
    field = Field(edges, np.zeros((3, MEASURES, 2 * bins)), np.zeros((2, 2)), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))), share)
    if len(np.unique(labels)) < 2 or not len(values):
        return field
    columns = field.columns(values, n_lines)
    flat = (np.arange(3)[None, :, None] * MEASURES + np.arange(MEASURES)[None, None, :]) * field.weights.shape[2] + columns
    y = of_line.astype(float)
    params = np.concatenate([field.weights.ravel(), field.step.ravel()])
    # The first round sees a line by itself: with labels that never change inside a document, neighbours would decide all.
    own = np.zeros_like(params)
    own[: field.weights[0].size] = 1.0
    for r in range(rounds):
        first, second = np.zeros_like(params), np.zeros_like(params)
        for i in range(1, steps + 1):
            good, expected, at = marginals(field.line_scores(columns), field.step, n_lines, True)
            found = np.zeros((2, 2))
            np.add.at(found, (y[at].astype(int), y[at + 1].astype(int)), 1)
            slope = np.bincount(flat.ravel(), np.repeat(y - good, 3 * MEASURES), field.weights.size)
            gradient = (np.concatenate([slope, (found - expected).ravel()]) / len(y) - 1e-4 * params) * (own if r == 0 else 1.0)
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            params = params + 0.15 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
            field.weights, field.step = params[:-4].reshape(field.weights.shape), params[-4:].reshape(2, 2)
        if r < rounds - 1:
            # Lines of bad documents that look good are good, but each bad document keeps its worst line.
            good = marginals(field.line_scores(columns), field.step, n_lines)
            y = np.where(of_line == 1, 1.0, good >= 0.5)
            worst = np.full(len(n_lines), np.inf)
            np.minimum.at(worst, doc, good)
            y[(of_line == 0) & (good <= worst[doc])] = 0.0
    good = marginals(field.line_scores(columns), field.step, n_lines)
    mean = field.aggregate(good, sizes, n_lines)
    _calibrate(field, mean[n_lines > 0], labels[n_lines > 0])
    return field


def _calibrate(field: Field, x: np.ndarray, y: np.ndarray) -> None:
    """Two-parameter logistic fit by Newton's method with a small penalty."""
    design, p = np.column_stack([x, np.ones_like(x)]), np.array([0.0, field.offset])
    for _ in range(30):
        q = _squash(design @ p)
        hessian = design.T @ (design * (q * (1 - q))[:, None]) + 1e-2 * np.eye(2)
        p = p + np.linalg.solve(hessian, design.T @ (y - q) - 1e-2 * p)
    field.slope, field.offset = float(p[0]), float(p[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_lines: int = 400_000) -> Field:
    """Learns from at most `sample` labelled documents, of `sample_lines` lines together, outside the held-out fold."""
    scratch = Scratch(docs.sparkSession, "quality")
    order = (F.xxhash64("doc_id"), "doc_id")
    taught = (
        labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("quality").cast("double")).alias("quality"))
        .orderBy(*order).limit(sample)
    )

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for i in range(0, len(pdf), 64):
                part = pdf.iloc[i : i + 64]
                n, sizes, values = measure(part["text"].tolist())
                ends = np.cumsum(n)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "quality": part["quality"].to_numpy(),
                    "sizes": [sizes[e - k : e].tolist() for e, k in zip(ends, n, strict=True)],
                    "measures": [values[e - k : e].ravel().tolist() for e, k in zip(ends, n, strict=True)],
                })

    # At most `sample` rows of two numbers: their size is bounded.
    rows = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = scratch.keep(rows.mapInPandas(lambda batches: lean(run(batches)), f"doc_id {kind}, quality double, sizes array<double>, measures array<float>"))
    sizes, values, n_lines, good, had = [np.zeros(0)], [np.zeros(0, np.float32)], [], [], 0
    # Repeated doc_ids don't widen the sample either.
    for r in measured.orderBy(*order, F.xxhash64("measures")).limit(sample).toLocalIterator():
        had += len(r["sizes"])
        if had > sample_lines:
            break
        sizes.append(np.array(r["sizes"], float))
        values.append(np.array(r["measures"], np.float32))
        n_lines.append(len(r["sizes"]))
        good.append(r["quality"] > 0)
    scratch.drop(measured)
    return train(np.array(n_lines, np.int64), np.concatenate(sizes), np.concatenate(values).reshape(-1, MEASURES), np.array(good, float))


def score(docs: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for i in range(0, len(pdf), 128):
                part = pdf.iloc[i : i + 128]
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": field.quality(part["text"].tolist())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInPandas(lambda batches: lean(run(batches)), f"doc_id {kind}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """The rows that aren't rejected, with all their columns, in one pass."""
    name = "_quality"
    while name in docs.columns:
        name += "_"

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        for text in batches:
            parts = [field.quality(text.iloc[i : i + 128].tolist()) for i in range(0, len(text), 128)]
            yield pd.Series(np.concatenate([np.zeros(0), *parts]))

    @F.pandas_udf("double", F.PandasUDFType.SCALAR_ITER)
    def quality(batches):
        return lean(run(batches))

    return docs.withColumn(name, quality(F.col("text"))).where(F.col(name) >= threshold).select(*docs.columns)
