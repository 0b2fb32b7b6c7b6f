"""Toxicity by cumulative-link ordinal regression.

``P(grade > k) = sigmoid(w . x - theta_k)`` for ordered thresholds theta that
share the weights w; the expected severity is the sum of these probabilities.
x holds, for each hashed word and word stem of the text, ``1 + log`` of its
count; stems tell inflected forms that no sample holds all of. Only words
that are commoner in graded texts are fitted, under a lasso, so the many words of
a long text don't add up by chance.

Grades come from the labels' column ``grade`` (0 is clean) where there is one.
Where a label only says toxic or not, toxic texts get the grades 1 to ``GRADES - 1``
by how often words occur that are far more common in toxic texts (quantiles over
the toxic rows of the fit), so that severity is ordered though the label is binary.

The fit is on the driver, on at most ``FIT_ROWS`` labelled rows, those of the
smallest hash of doc_id with both classes kept in the sample in their shares; what
comes there are their features, at most ``SLOTS`` a row however long the text.
Every document is scored whole, in one pass without a shuffle. The threshold on
the expected severity is set on a held-out part of the sample. Without labelled
rows of both classes nothing is rejected.

Null text is empty and has no words; labels that are null or without a document
are left out; a doc_id with several labels takes the largest label and grade; repeated rows score
alike; an empty table gives an empty result; other columns pass through
``filter_toxic`` untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, saved

SLOTS, GRADES, FIT_ROWS = 1 << 18, 4, 6_000
STEPS, RATE, RIDGE, LASSO = 300, 0.5, 1e-5, 1e-3
FALSE_ALARM = 3  # misses that a false alarm counts for when the cut is set
KNOWN = 100_000  # words that a worker remembers
STEMS = (4, 5, 6)  # characters at a word's start that are features of their own
_STRIP = b".,;:!?\"'()[]{}<>|*_-#$%&@~^+=/\\`"


@lru_cache(KNOWN // 4)
def _slots(word: bytes) -> tuple[int, ...]:
    """The slot of a word and those of its stems."""
    text = word.strip(_STRIP).decode(errors="replace")
    parts = [text, *(f"{text[:n]}\0" for n in STEMS if len(text) > n)]
    return tuple(xxhash.xxh32_intdigest(x) % SLOTS for x in parts)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words and stems, and their values."""
    words = text.encode().lower().split()
    slots, n = np.unique(np.fromiter(chain.from_iterable(map(_slots, words)), np.int32), return_counts=True)
    return slots, (1 + np.log(n)).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # one for each slot
    thresholds: np.ndarray  # ascending
    cut: float = np.inf  # expected severity from which a text is rejected

    def severity(self, total: np.ndarray) -> np.ndarray:
        """Expected grade for sums of weights."""
        return (1 / (1 + np.exp(-np.clip(np.asarray(total)[..., None] - self.thresholds, -40, 40)))).sum(axis=-1)

    def total(self, text: str) -> float:
        """The weighted sum of a text's features, by way of the few words that have a weight."""
        known, words = self.__dict__.setdefault("_known", {}), text.encode().lower().split()
        if len(known) > KNOWN:
            known.clear()
        for w in set(words).difference(known):
            known[w] = tuple(x for x in _slots.__wrapped__(w) if self.weights[x])
        n = Counter(chain.from_iterable(map(known.__getitem__, words)))
        return float(sum(self.weights[x] * (1 + np.log(k)) for x, k in sorted(n.items())))

    def forget(self) -> None:
        """Drop the words that totals have met."""
        self.__dict__.pop("_known", None)


class _Rows:
    """Sparse rows for the fit."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(s) for s, _ in rows])
        self.slot = np.concatenate([s for s, _ in rows]) if rows else np.zeros(0, np.int32)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)

    def only(self, slots: np.ndarray) -> None:
        """Leave out all other slots."""
        keep = slots[self.slot]
        self.row, self.slot, self.value = self.row[keep], self.slot[keep], self.value[keep].astype(np.float64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.slot] * self.value, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.slot, g[self.row] * self.value, SLOTS)


def telling_slots(rows: _Rows, toxic: np.ndarray, odds: float) -> np.ndarray:
    """Words so much commoner (log ratio of shares) in toxic texts, in at least one in fifty of them."""
    has = [np.bincount(rows.slot[toxic[rows.row] == k], minlength=SLOTS) for k in (False, True)]
    share = [(h + 0.5) / (np.sum(toxic == k) + 1) for k, h in zip((False, True), has)]
    return (np.log(share[1] / share[0]) > odds) & (has[1] >= max(3, 0.02 * toxic.sum()))


def severity_grades(rows: _Rows, toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows; for toxic ones 1 to GRADES - 1 by the number of words that tell toxic texts from clean ones."""
    telling = telling_slots(rows, toxic == 1, 3.0)
    count = np.bincount(rows.row, telling[rows.slot] * np.exp(rows.value.astype(np.float64) - 1), rows.n)
    edges = np.quantile(count[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(toxic == 1, 1 + np.searchsorted(edges, count, side="right"), 0)


def likelihood(rows: _Rows, y: np.ndarray, w: np.ndarray, first: float, gaps: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Mean log likelihood of the grades y, and its gradient in the weights, the first threshold and the logs of the gaps between thresholds."""
    theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    s = rows.dot(w)[:, None] - theta
    above = 1 / (1 + np.exp(-np.clip(s, -40, 40)))  # P(y > k)
    edge = np.zeros((rows.n, 1))
    wide = np.concatenate([edge + 1, above, edge], axis=1)
    p = np.maximum(wide[np.arange(rows.n), y] - wide[np.arange(rows.n), y + 1], 1e-9)
    slope = np.concatenate([edge, above * (1 - above), edge], axis=1)
    up, down = slope[np.arange(rows.n), y] / p, slope[np.arange(rows.n), y + 1] / p  # of log p in s below and above the grade
    g_theta = np.array([(down[y == j].sum() - up[y == j + 1].sum()) / rows.n for j in range(len(theta))])
    g_gaps = np.array([g_theta[j + 1 :].sum() * np.exp(gaps[j]) for j in range(len(gaps))])
    return float(np.log(p).mean()), rows.back(up - down) / rows.n, float(g_theta.sum()), g_gaps


def fit(every: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, grades: np.ndarray | None = None) -> Model:
    """Maximum penalised likelihood of rows of features by adaptive gradient steps; the cut is set on every fifth row, which isn't fitted."""
    rest = np.arange(len(every)) % 5 == 0
    rows, held = _Rows([f for f, r in zip(every, rest) if not r]), _Rows([f for f, r in zip(every, rest) if r])
    y = severity_grades(rows, toxic[~rest]) if grades is None else grades[~rest]
    # the prior thresholds are the logits of the shares
    share = np.clip((y[:, None] > np.arange(y.max())).mean(axis=0), 1e-4, 1 - 1e-4)
    first, gaps = np.log((1 - share[0]) / share[0]), np.log(np.maximum(np.diff(np.log((1 - share) / share)), 0.1))
    seen = telling_slots(rows, y > 0, 1.0)
    for part in (rows, held):
        part.only(seen)
    w = np.zeros(SLOTS)
    sums = {"w": np.full(SLOTS, 1e-8), "f": 1e-8, "g": np.full(len(gaps), 1e-8)}
    for _ in range(STEPS):
        _, gw, g_first, g_gaps = likelihood(rows, y, w, first, gaps)
        gw -= RIDGE * w
        for name, g in (("w", gw), ("f", g_first), ("g", g_gaps)):
            sums[name] = sums[name] + g * g
        step = RATE / np.sqrt(sums["w"])
        w += step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * LASSO, 0)  # most words get no weight at all
        first += RATE * g_first / np.sqrt(sums["f"])
        gaps = np.clip(gaps + RATE * g_gaps / np.sqrt(sums["g"]), -4, 4)
    model = Model(w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))
    score, bad = model.severity(held.dot(w)), toxic[rest] == 1
    if bad.any() and (~bad).any():
        edges = np.unique(np.concatenate([score, [0.0]]))
        middle = (edges[1:] + edges[:-1]) / 2
        order = np.sort(score[bad]), np.sort(score[~bad])
        wrong = np.searchsorted(order[0], middle) + FALSE_ALARM * (len(order[1]) - np.searchsorted(order[1], middle))
        best = np.flatnonzero(wrong == wrong.min())
        model.cut = float(middle[best[len(best) // 2]]) if len(middle) else 0.5
    else:
        model.cut = 0.5
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, values = zip(*map(features, batch["text"].to_pylist())) if batch.num_rows else ((), ())
        cols = [pa.array([x.astype(t).tobytes() for x in c], pa.binary()) for c, t in ((slots, np.int32), (values, np.float32))]
        yield pa.RecordBatch.from_arrays([batch["h"], batch["grade"], *cols], names=["h", "grade", "slots", "values"])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """A model fitted on at most so many labelled rows (doc_id, toxic or grade), or None where a class is missing."""
    graded = "grade" in labels.columns
    name = "grade" if graded else "toxic"
    label = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).groupBy("doc_id").agg(F.max(name).cast("int").alias("grade"))
    chosen = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = saved(chosen, "toxicity-sample")  # bounded, so it may be sent to all
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = sample.select(F.xxhash64("doc_id", "text").alias("h"), "grade", "text").mapInArrow(lean(_featured), "h long, grade int, slots binary, values binary").orderBy("h").limit(rows).toArrow()
    grade = np.maximum(got["grade"].to_numpy(), 0).astype(np.int64) if got.num_rows else np.zeros(0, np.int64)
    toxic = (grade > 0).astype(np.int64)
    fitted = toxic[np.arange(len(toxic)) % 5 > 0]
    if len(toxic) < 10 or not 0 < fitted.sum() < len(fitted):
        return None
    every = [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for s, v in zip(got["slots"].to_pylist(), got["values"].to_pylist())]
    return fit(every, toxic, grade if graded else None)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs' rows as row, with severity (expected grade), grade (the likeliest) and toxic."""
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).schema["row"]
    schema = T.StructType([row, *T._parse_datatype_string("severity double, grade int, toxic boolean")])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            if model is None:
                severity, grade, toxic = np.zeros(len(texts)), np.zeros(len(texts), np.int32), np.zeros(len(texts), bool)
            else:
                total = np.array([model.total(t or "") for t in texts])
                severity = model.severity(total)
                over = 1 / (1 + np.exp(-np.clip(total[:, None] - model.thresholds, -40, 40)))
                share = -np.diff(np.concatenate([np.ones((len(texts), 1)), over, np.zeros((len(texts), 1))], axis=1), axis=1)
                grade, toxic = share.argmax(axis=1).astype(np.int32), severity >= model.cut
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(severity), pa.array(grade), pa.array(toxic)], names=["row", "severity", "grade", "toxic"])
        if model is not None:
            model.forget()

    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].alias("text")).mapInArrow(lean(run), schema)


def filter_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the model rejects, all columns as they are."""
    return score(docs, train(docs, labels)).where("not toxic").select("row.*")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("row.doc_id", F.round("severity", 6).alias("severity"), "grade", "toxic")


SQL: dict[str, str] = {}
