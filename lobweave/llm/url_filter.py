"""URL filter: rules first, then a ratio of character language models.

Two smoothed variable-order Markov models, of accepted and of rejected URLs,
score a URL by the difference of their log-likelihoods for each character. An
n-gram's probability is interpolated with that of its shorter context,
``p_k(c | h) = (count(hc) + strength * p_{k-1}(c | h')) / (count(h) + strength)``,
so each character uses the longest context that has been seen. Every n-gram up
to ``ORDER`` and every context has its own counter under a 64-bit key, in a
working table of all keys that grows with the distinct n-grams of the URLs. URLs
are scored in chunks: each chunk asks for its distinct keys, which are joined to
the table, and what is found meets the chunk's URLs again.

Training URLs are all that a rule decides (or that the caller labels). Those of
one fold in five are held out of the counts and set the threshold: their scores
are gathered as one histogram for each class, and the threshold is the bin edge
with the best mean of both classes' hit rates. Without URLs of both classes
every URL is allowed.

The longest rule wins that fits host and path. A null URL or one without ``://``
has an empty host and path, fits no rule and is scored as it stands (an empty
one has score 0); repeated rows are judged alike; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowered, mixed, part_id, saved

ORDER, STRENGTH = 6, 1.0
SLOTS = 1 << 20  # of the view by slot alone, for tables of few keys
CHUNK, HELD = 1 << 20, 1 << 21  # characters of a chunk of URLs; keys that a task counts before it passes them on
FOLDS, BINS, REACH = 5, 4096, 8.0  # histogram of scores over [-REACH, REACH]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise(F.lit(""))
    return lowered(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


class Grams:
    """Keys of a batch's n-grams: for each order, the n-gram ending at each character and its context.

    With ``known``, ascending keys, n-grams and contexts are numbered by their
    place there (``len(known)`` where they are not in it); without, by slot.
    """

    def __init__(self, urls: list[str], known: np.ndarray | None = None):
        data = [("\x02" + (u or "")).encode("utf-32-le", "surrogatepass") for u in urls]
        self.lengths = np.array([len(d) // 4 - 1 for d in data], np.int64)
        chars = np.frombuffer(b"".join(data), np.uint32).astype(np.uint64)
        starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        first = np.repeat(starts, self.lengths)
        self.at = np.arange(len(first)) + np.repeat(np.arange(len(starts)) + 1, self.lengths)  # characters but the mark at the start
        self.url = np.repeat(np.arange(len(starts)), self.lengths)
        self.known = known
        self.keys: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # n-gram, context, whether the text reaches so far back
        context = np.zeros(len(self.at), np.uint64)
        for order in range(1, ORDER + 1):
            gram = mixed(context ^ mixed(chars[self.at] + np.uint64(order << 32)))
            has = self.at - (order - 1) >= first
            self.keys.append((gram, mixed(context ^ np.uint64(order)), has))
            back = np.maximum(self.at - order, 0)
            context = mixed(context + mixed(chars[back] ^ np.uint64(order * 0x51ED2701)))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of n-grams and contexts, ascending, and their numbers."""
        every = [key[has] for gram, context, has in self.keys for key in (gram, context)]
        return np.unique(np.concatenate(every), return_counts=True)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots and their numbers: n-grams in [0, SLOTS), contexts behind them."""
        every = [self._numbered(key, k)[has] for gram, context, has in self.keys for k, key in enumerate((gram, context))]
        return np.unique(np.concatenate(every), return_counts=True)

    def _numbered(self, keys: np.ndarray, context: int) -> np.ndarray:
        if self.known is None:
            return (keys % np.uint64(SLOTS)).astype(np.int64) + SLOTS * context
        at = np.searchsorted(self.known, keys)
        same = at < len(self.known)
        same[same] = self.known[at[same]] == keys[same]
        return np.where(same, at, len(self.known))

    def log_likelihood(self, *tables: np.ndarray) -> np.ndarray:
        """For each URL under each table, one row a table; a single table's row alone."""
        p = [np.full(len(self.at), 1 / 256) for _ in tables]
        for gram, context, has in self.keys:
            gram, context = self._numbered(gram, 0), self._numbered(context, 1)
            for k, table in enumerate(tables):
                seen = (table[gram] + STRENGTH * p[k]) / (table[context] + STRENGTH)
                p[k] = np.where(has, seen, p[k])
        out = np.array([np.bincount(self.url, np.log(np.maximum(x, 1e-12)), len(self.lengths)) for x in p])
        return out if len(tables) > 1 else out[0]


def _scores(urls: list[str], known: pa.Table) -> np.ndarray:
    """Log-likelihood difference for each character by the rows key, accepted, rejected; 0 for empty URLs."""
    keys = known["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    accepted, rejected = (np.append(known[c].to_numpy()[order], 0).astype(np.float64) for c in ("accepted", "rejected"))
    out = []
    for at in range(0, len(urls), 2000):
        grams = Grams(urls[at : at + 2000], keys[order])
        a, r = grams.log_likelihood(accepted, rejected)
        out.append((a - r) / np.maximum(grams.lengths, 1))
    return np.concatenate(out) if out else np.zeros(0)


@dataclass
class Model:
    counts: DataFrame  # key, accepted, rejected: a row for each n-gram and context
    threshold: float = 0.0

    def scores(self, urls: list[str]) -> np.ndarray:
        """Of a few URLs at the driver; ``scored`` for tables."""
        keys = Grams(urls).distinct()[0].view(np.int64)
        asked = self.counts.sparkSession.createDataFrame(pa.table({"key": keys}))
        return _scores(urls, asked.join(self.counts, "key").toArrow())

    def scored(self, chunks: DataFrame) -> DataFrame:
        """The rows of ``chunked`` URLs with their score."""
        schema = "chunk long, key long"
        found = chunks.select("chunk", "url").mapInArrow(_asked, schema).join(self.counts, "key")
        names = [c for c in chunks.columns if c != "chunk"]

        def score(rows: pa.Table, known: pa.Table) -> pa.Table:
            return rows.select(names).append_column("score", pa.array(_scores(rows["url"].to_pylist(), known), pa.float64()))

        return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, ", ".join(f"{c} {t}" for c, t in chunks.dtypes if c != "chunk") + ", score double")


def chunked(rows: DataFrame) -> DataFrame:
    """A working table of rows (with url, not null) with chunk: rows of one partition, of about CHUNK characters."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for batch in batches:
            ends = so_far + np.cumsum([len(u) + 1 for u in batch["url"].to_pylist()], dtype=np.int64)
            so_far = int(ends[-1]) if len(ends) else so_far
            yield pa.RecordBatch.from_arrays([pa.array((part_id() << 32) + ends // CHUNK), *batch.columns], names=["chunk", *batch.schema.names])

    return saved(rows.mapInArrow(cut, "chunk long, " + ", ".join(f"{c} {t}" for c, t in rows.dtypes)), "urls")


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of one chunk each, in order, with its number."""
    for batch in batches:
        chunk = batch["chunk"].to_numpy()
        edges = np.flatnonzero(np.diff(chunk)) + 1
        for a, b in zip([0, *edges], [*edges, len(chunk)]):
            for at in range(a, b, rows):
                yield int(chunk[at]), batch.slice(at, min(rows, b - at))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each chunk."""

    def batch(chunk: int, keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk, np.int64)), pa.array(keys.view(np.int64))], names=["chunk", "key"])

    last, keys = None, np.zeros(0, np.uint64)
    for chunk, piece in _pieces(batches):
        if chunk != last and len(keys):
            yield batch(last, keys)
            keys = keys[:0]
        last = chunk
        keys = np.union1d(keys, Grams(piece["url"].to_pylist()).distinct()[0])
    if len(keys):
        yield batch(last, keys)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of each key."""
    keys, n = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n[1]), pa.array(n[0])], names=["key", "accepted", "rejected"])

    for _, piece in _pieces(batches):
        urls, accepted = piece["url"].to_pylist(), piece["accepted"].to_pylist()
        for k in (0, 1):
            new, times = Grams([u for u, a in zip(urls, accepted) if a == bool(k)]).distinct()
            both = np.union1d(keys, new)
            total = np.zeros((2, len(both)), np.int64)
            total[:, np.searchsorted(both, keys)] = n
            total[k, np.searchsorted(both, new)] += times
            keys, n = both, total
        if len(keys) > HELD:
            yield batch()
            keys, n = keys[:0], n[:, :0]
    if len(keys):
        yield batch()


def train(labelled: DataFrame) -> Model | None:
    """A model from rows url, accepted (boolean): counts of all but the held-out fold, threshold from that fold."""
    rows = chunked(labelled.where("accepted is not null").select(F.coalesce("url", F.lit("")).alias("url"), "accepted"))
    held = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    partial = rows.where(~held).mapInArrow(_counted, "key long, accepted long, rejected long")
    model = Model(saved(partial.groupBy("key").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "url-grams"))
    if not all(model.counts.agg(F.sum("accepted"), F.sum("rejected")).first()):
        return None
    at = F.least(F.greatest(F.floor((F.col("score") + REACH) * (BINS / (2 * REACH))), F.lit(0)), F.lit(BINS - 1))
    sums = model.scored(rows.where(held)).groupBy(F.col("accepted").cast("int").alias("k"), at.cast("int").alias("slot")).count().toArrow()
    bins = np.zeros((2, BINS + 1))
    bins[sums["k"].to_numpy(), sums["slot"].to_numpy() + 1] = sums["count"].to_numpy()
    if bins.sum(axis=1).all():
        below = np.cumsum(bins, axis=1) / bins.sum(axis=1, keepdims=True)
        hits = below[0] - below[1]  # rejected under the edge, accepted over it
        best = np.flatnonzero(hits == hits.max())
        model.threshold = float(best[len(best) // 2] * (2 * REACH / BINS) - REACH)
    return model


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, model: Model | None = None) -> DataFrame:
    """page_id, host, path, rule, score, verdict for each row of pages; without a model, one is trained on what the rules decide."""
    host, path = split_url(F.col("url"))

    def ruled(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"host": host, "path": path}).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    model = model or train(ruled(rows).select("url", (F.col("ruled.verdict") == "allow").alias("accepted")))
    scored = model.scored(chunked(rows)) if model else rows.withColumn("score", F.lit(0.0))
    verdict = F.coalesce("ruled.verdict", F.when(F.col("score") >= (model.threshold if model else 0.0), "allow").otherwise("block"))
    return ruled(scored).select("page_id", "host", "path", "ruled.rule", verdict.alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


SQL: dict[str, str] = {}
