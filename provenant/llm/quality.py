"""Quality classifier: histogram gradient-boosted trees over document statistics.

The model is fitted on the driver from the statistics of at most ``SAMPLE`` labelled documents (those
whose ids hash lowest, so the choice is the same at every run) and flattened into one array per node
field; scoring walks all rows of an Arrow batch down each tree at once in numpy.  Labels, language,
source and id are never inputs of a score.

Defined cases: a null text counts as empty; an empty text has statistics of zero and is scored like
any other; a document with several labels counts once by their mean (0.5 and over: 1), null labels are ignored;
repeated rows give repeated scores; without labels of both kinds every score is the share of label
1 (0.5 without any); extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: At most so many labelled documents are fitted on.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, SHRINK = 60, 4, 64, 0.2, 3.0, 1.0

_NO = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "symbol": b"#*$%&<>^~@{}[]\\_=+",
    "bar": b"|",
    "mark": b"!?",
    "stop": b".,;:",
    "lower": bytes(range(97, 123)),
    "high": bytes(range(128, 256)),
}
FEATURES = [*_NO, "log_words", "word_bytes", "long_words", "distinct", "top_word", "same_next", "same_second", "line_words", "distinct_lines", "capital_words"]


def statistics(text: bytes) -> list[float]:
    """The statistics of a text, none of which depends on its language's words."""
    size = len(text)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    out = [(size - len(text.translate(None, c))) / size for c in _NO.values()]
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), np.int32, n)
    return [
        *out,
        float(np.log1p(n)),
        float(lengths.mean()),
        float((lengths > 24).mean()),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(map(eq, words, words[2:])) / n,
        n / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        sum(1 for w in words if w[:1].isupper()) / n,
    ]


@dataclass
class Trees:
    """All trees in flat arrays: node k of a tree goes to left[k] if the row's feature is at most its edge, else to left[k] + 1; a leaf goes to itself."""

    base: float
    root: np.ndarray
    feature: np.ndarray
    edge: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 of each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.root.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                left = self.left[at]
                at = np.where(left < 0, at, left + (x[rows, self.feature[at]] > self.edge[at]))
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees of the logistic loss; each level is grown from histograms of gradients over quantile bins."""
    share = float(y.mean()) if len(y) else 0.5
    base = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    root, feature, edge, left, value = [], [], [], [], []
    if len(np.unique(y)) == 2:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        offset = np.arange(x.shape[1]) * bins
        total = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            root.append(len(feature))
            feature.append(0), edge.append(0.0), left.append(-1), value.append(0.0)
            level = {len(feature) - 1: np.arange(len(y))}
            for d in range(depth + 1):
                deeper = {}
                for node, rows in level.items():
                    gs, hs = g[rows].sum(), h[rows].sum()
                    value[node] = rate * gs / (hs + SHRINK)
                    if d == depth or len(rows) < 2:
                        continue
                    flat = (binned[rows] + offset).ravel()
                    gh = [np.bincount(flat, np.repeat(v[rows], x.shape[1]), x.shape[1] * bins).reshape(-1, bins).cumsum(1)[:, :-1] for v in (g, h)]
                    gain = gh[0] ** 2 / (gh[1] + SHRINK) + (gs - gh[0]) ** 2 / (hs - gh[1] + SHRINK) - gs**2 / (hs + SHRINK)
                    gain[(gh[1] < LEAST_WEIGHT / 4) | (hs - gh[1] < LEAST_WEIGHT / 4)] = -1
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] <= 1e-6 or b >= len(edges[j]):
                        continue
                    goes = binned[rows, j] <= b
                    feature[node], edge[node], left[node] = int(j), float(edges[j][b]), len(feature)
                    for part in (rows[goes], rows[~goes]):
                        deeper[len(feature)] = part
                        feature.append(0), edge.append(0.0), left.append(-1), value.append(0.0)
                for node, rows in level.items():
                    if left[node] < 0:
                        total[rows] += value[node]
                level = deeper
    return Trees(base, np.array(root, np.int64), np.array(feature, np.int64), np.array(edge), np.array(left, np.int64), np.array(value), depth)


def described(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and x: the statistics of every row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([statistics(t.as_py() or b"") for t in texts], pa.list_(pa.float64()))], [*keep, "x"])
        tidy()

    return docs.select(*keep, text).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """A model of the labelled documents that are not held out, from at most ``sample`` of them."""
    marked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = marked.where(~held_out("labelled")).orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    rows = docs.select(id_col, text).join(F.broadcast(chosen), F.col(id_col) == F.col("labelled")).dropDuplicates(["labelled"])  # at most ``sample`` rows
    got = sorted(described(rows, text, ("labelled", "y")).collect(), key=lambda r: r["labelled"])  # sorted here: a sort in Spark would make the statistics twice
    return fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got], float))


def held_out(id_col: str):
    """Whether an id's checksum sets it aside from training (null: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, model: Trees, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns (the text may be one of them) and score (0 to 1) of every row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", score double"
    place = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py() or b"") for t in batch.column(place).cast(pa.binary())]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(model.score(x), pa.float64())], [*keep, "score"])
        tidy()

    return docs.select(*keep, *(() if text in keep else (text,))).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.7) -> DataFrame:
    """``id_col``, held_out, score and predicted (1 if the score reaches ``least``) of every row."""
    return scored(docs, train(docs, labels, id_col, text, label), text, (id_col,)).select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``least``, with their own columns."""
    own = docs.columns
    inner = docs.select(*(F.col(c).alias(f"own {i}") for i, c in enumerate(own)))
    names = tuple(f"own {i}" for i in range(len(own)))
    kept = scored(inner, train(docs, labels, id_col, text), f"own {own.index(text)}", names).where(F.col("score") >= least)
    return kept.select(*(F.col(f"`own {i}`").alias(c) for i, c in enumerate(own)))
