"""Quality scores from a sparse ensemble of rules.

Statistics of each text go through small boosted trees; every path of a tree, from its root to any
node, is a conjunction of thresholds and so a rule. Logistic weights of the rules are fitted under
an L1 penalty, which leaves few of them, and the rules left are compiled into Spark column
expressions over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the rules are fitted on, at most (by the ids' hashes).
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 30, 3, 32, 0.3, 10
PENALTY, STEPS = 0.002, 400
#: Shares of bytes, by the bytes counted.
BYTES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "newline": b"\n",
    "stop": b".,;:?",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#$%&*@^~<>{}[]\\/=+_`",
    "quote": b"'\"()-",
    "high": bytes(range(128, 256)),
}
STATISTICS = ("log_bytes", *BYTES, "word_bytes", "line_words", "distinct_words", "distinct_lines", "stopped_words")

_CLASSES = np.array([[b in own for own in BYTES.values()] for b in range(256)], np.float64)


def statistics_of(text: bytes) -> list[float]:
    """The statistics of one text; those of an empty one are zero."""
    if not text:
        return [0.0] * len(STATISTICS)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES / len(text)
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    more = sum(map(len, words)) / n, len(words) / len(lines), len(set(words)) / n, len(set(lines)) / len(lines), sum(w[-1] in b".,;:!?" for w in words) / n
    return [float(np.log1p(len(text))), *map(float, shares), *map(float, more)]


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (renamed k0, k1, ...) and the statistics of each whole text (null: empty)."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("binary").alias("text"))
    kept = rows.drop("text").schema
    ids = kept.names
    names = [*ids, *STATISTICS]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                found = np.array([statistics_of(x.as_py() or b"") for x in batch.column("text")]).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), *map(pa.array, found.T.copy())], names)

    return rows.mapInArrow(measure, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), *(f"{s} double" for s in STATISTICS)]))


#: A condition is (statistic, threshold, above); a rule is a set of them.
Rule = frozenset[tuple[int, float, bool]]


@dataclass(frozen=True)
class RuleEnsemble:
    """Logistic weights of rules over the statistics."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The score as a column expression over the statistics."""

        def holds(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, (F.col(STATISTICS[s]) > t if above else F.col(STATISTICS[s]) <= t for s, t, above in sorted(rule)))

        total = reduce(add, (F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules), F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _edges(x: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))


def _paths(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees, each once."""
    edges = [_edges(x[:, s]) for s in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, s], side="left") for s, e in enumerate(edges)], 1)
    margin, found = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes = [(np.arange(len(y)), frozenset())]
        for depth in range(DEPTH + 1):
            split = []
            for rows, rule in nodes:
                best = _best_split(binned[rows], slope[rows], bend[rows], edges) if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS else None
                if best is None:
                    margin[rows] += RATE * slope[rows].sum() / (bend[rows].sum() + 1)
                    continue
                s, k = best
                below = binned[rows, s] <= k
                for part, above in ((rows[below], False), (rows[~below], True)):
                    child = rule | {(s, float(edges[s][k]), above)}
                    found[child] = None
                    split.append((part, child))
            nodes = split
    return list(found)


def _best_split(binned: np.ndarray, slope: np.ndarray, bend: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int] | None:
    best, least = None, 1e-3
    g, h, n = slope.sum(), bend.sum(), len(slope)
    for s, own in enumerate(edges):
        if not len(own):
            continue
        gl, hl, nl = (np.cumsum(np.bincount(binned[:, s], w, len(own) + 1))[:-1] for w in (slope, bend, None))
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(nl < LEAST_ROWS) | (n - nl < LEAST_ROWS)] = 0
        k = int(np.argmax(gain))
        if gain[k] > least:
            best, least = (s, k), gain[k]
    return best


def _lasso(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty, by accelerated proximal steps; the intercept goes free."""
    n, m = z.shape
    step = 4 * n / (np.linalg.norm(np.column_stack([np.ones(n), z]), 2) ** 2)
    w = v = np.zeros(m + 1)
    w[0] = v[0] = np.log(y.mean() / (1 - y.mean()))
    t = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(v[0] + z @ v[1:])))
        grad = np.concatenate([[np.mean(p - y)], z.T @ (p - y) / n])
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * PENALTY, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (last - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Rules and weights from statistics and labels; with one class or no rows, a constant."""
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1), ())
    paths = _paths(x, y)
    z = np.stack([np.all([(x[:, s] > t) == above for s, t, above in rule], 0) for rule in paths], 1).astype(np.float64) if paths else np.zeros((len(y), 0))
    spread = np.maximum(z.std(0), 1e-9)
    intercept, weights = _lasso(z / spread, y)
    return RuleEnsemble(intercept, tuple((rule, float(w)) for rule, w in zip(paths, weights / spread, strict=True) if abs(w) > 1e-6))


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> RuleEnsemble:
    """Fit on the labelled rows for whose ids ``train`` (over the id column) holds.

    About ``rows`` of them are used, those with the smallest hashes; an id labelled twice counts
    once, with its larger label.
    """
    labelled = labels.where(train & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("y"))
    n = labelled.count()
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < int(min(1.0, rows / max(1, n)) * (1 << 30))
    sample = labelled.where(draw).select(F.col(id_col).alias("id"), "y")
    # The sample's size is bounded by ``rows``.
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    found = statistics(own, ["y"]).toPandas()
    return fit_rules(found[list(STATISTICS)].to_numpy(np.float64), found["k0"].to_numpy(np.float64))


def score(docs: DataFrame, rules: RuleEnsemble, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: the id, ``score`` (0 to 1, higher: better) and ``predicted`` (1 from ``threshold`` on).

    A null text scores as an empty one. Repeated rows give a row each; other columns are not
    returned, so their names can't clash.
    """
    found = statistics(docs, [id_col], text_col).select(F.col("k0").alias(id_col), rules.score().alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
