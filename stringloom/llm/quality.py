"""Quality classifier (3): importance resampling with hashed n-gram generative models.

Two generative models over hashed n-grams (words and word pairs; a word's first 4 and 5 letters,
its shape with trailing punctuation and pairs of shapes, for words that are rare; immediate
repetition) are counted: one of target text (labelled rows of quality 1 that are not toxic), one
of raw text (all documents). A feature's log ratio compares its target count with the raw count at
the target's scale, ALPHA added to each, so that rare features say nothing. A document has
  - log_weight, the mean log ratio of its features. Gumbel top-k over it gives the resampled set:
    the keys are LENGTH * log_weight / temperature + Gumbel noise. LENGTH is the number of features
    that every document is taken to have, so that length doesn't decide; a temperature near 0
    takes the best k, a high one a random k;
  - tail, the mean of the log ratios below -FAR alone: text that the target model hardly ever
    makes. It is accepted if tail is at or over a threshold, fitted on held-out labelled rows.

A stage that filters takes `accepted`: resampling leaves out some documents of any quality, and
such a stage has to keep all clean ones.

The labelled sample is bounded (LABELLED rows, those of the smallest hashed ids); the raw counts
cover every document. Models have BUCKETS entries whatever the corpus.

Cases: a null or empty text has no features: weight and tail 0, accepted. Without labelled rows of
both kinds everything is accepted. Rows that repeat are judged each, with noise of their own id;
null ids draw noise from the text. Equal keys are sampled or left together, so that ties at the
k-th key can make the sample larger than k. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BUCKETS, ALPHA, FAR, LABELLED = 1 << 19, 1.0, 1.5, 20_000
#: Features that resampling takes every document to have.
LENGTH = 100
#: Share of the labelled sample that fits the threshold rather than the target model.
HELD_OUT = 3
#: What losing a good document weighs against keeping a bad one.
LOSS = 3.0
SHAPES, PAIR = 64, np.uint64(0x9E3779B97F4A7C15)
#: Features that are gathered before they are counted.
HELD = 1 << 20
#: Parts of a range that kth_largest counts at a time.
CUTS = 4096
TOKEN = re.compile(r"^[^\w]*(\w*)")
TRAIL = re.compile(r"[^\w\s]{2,}$")


class Features(dict):
    """Token -> number of a row of `rows` (buckets of the token's own features) and of `codes` (its word's hash); bounded."""

    LIMIT = 1 << 19

    def __init__(self) -> None:
        super().__init__()
        self.rows, self.shapes, self.codes = np.zeros((1 << 12, 4), np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint64)

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n == len(self.rows):
            self.rows, self.shapes, self.codes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.shapes, self.codes))
        word = TOKEN.match(token)[1]
        trail = TRAIL.search(token)
        kind = 0 if not word else 1 if word[0].isdigit() else 2 if word.isupper() and len(word) > 1 else 3
        shape = kind * 16 + (1 + xxhash.xxh3_64_intdigest(trail[0][:3]) % 15 if trail else 0)
        low = word.lower()
        self.codes[n] = code = xxhash.xxh3_64_intdigest(low)
        at = lambda x: bucket_of(xxhash.xxh3_64_intdigest(x))
        self.rows[n] = (bucket_of(code), at("4" + low[:4]), at("5" + low[:5]), at("s" + str(shape)))
        self.shapes[n] = shape
        self[token] = n
        return n

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.empty(0, np.int64)
        if len(self) > self.LIMIT:
            self.clear()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        shapes, codes = self.shapes[ids], self.codes[ids]
        pairs = shapes[:-1] * SHAPES + shapes[1:]
        following = bucket_of((codes[:-1] * PAIR + codes[1:]) >> np.uint64(11)).astype(np.int64)
        return np.concatenate([self.rows[ids].ravel(), pairs, following, np.full(int((ids[1:] == ids[:-1]).sum()), SHAPES * SHAPES)])


def bucket_of(code):
    """The bucket of a 64-bit hash, behind those of the shape pairs and of repetition."""
    return code % (BUCKETS - SHAPES * SHAPES - 2) + (SHAPES * SHAPES + 2)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task one row for each bucket met: (bucket, raw, target)."""
    features, raw, target = Features(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    held: list[tuple[np.ndarray, bool]] = []

    def count() -> None:
        for total, parts in ((raw, [f for f, _ in held]), (target, [f for f, good in held if good])):
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        held.clear()

    size = 0
    for batch in batches:
        for text, good in zip(batch.column(0), batch.column(1), strict=True):
            held.append((features.of(text.as_py()), good.as_py()))
            size += len(held[-1][0])
            if size > HELD:
                count()
                size = 0
    count()
    met = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(raw[met], pa.int64()), pa.array(target[met], pa.int64())], ["bucket", "raw", "target"])


def _score(ratios: np.ndarray, features: Features, text: str | None) -> tuple[int, float, float]:
    r = ratios[features.of(text)]
    if not len(r):
        return 0, 0.0, 0.0
    return len(r), float(r.sum() / len(r)), float(r[r < -FAR].sum() / len(r))


def _scores(ratios):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, table = Features(), ratios.value
        for batch in batches:
            rows = [_score(table, features, x.as_py()) for x in batch.column(batch.num_columns - 1)]
            n, weight, tail = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(weight, pa.float64()), pa.array(tail, pa.float64())], [*batch.schema.names[:-1], "n_features", "log_weight", "tail"])

    return run


class ImportanceModel:
    def __init__(self, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> None:
        spark = docs.sparkSession
        sample = labels.where("doc_id is not null and quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(labelled)
        good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
        sample = sample.groupBy(F.col("doc_id").alias("__id")).agg(F.min(good).alias("good")).withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "__id"), F.lit(HELD_OUT)) == 0)
        sample = F.broadcast(written(sample, "labelled"))  # at most `labelled` rows
        marked = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("__id")).join(sample, "__id", "left")
        counted = marked.select("text", F.coalesce(F.col("good") & ~F.col("held"), F.lit(False)).alias("target")).mapInArrow(_count, "bucket long, raw long, target long")
        raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        summed = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # BUCKETS rows at most
        at = summed["bucket"].to_numpy()
        raw[at], target[at] = summed["raw"].to_numpy(), summed["target"].to_numpy()
        scale = target.sum() / raw.sum() if raw.sum() else 0.0
        self.ratios = np.log((target + ALPHA) / (raw * scale + ALPHA)) if scale else np.zeros(BUCKETS)
        self.shared = spark.sparkContext.broadcast(self.ratios)
        held = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(sample.where("held"), "__id").select("good", "text")
        rows = held.mapInArrow(_scores(self.shared), "good boolean, n_features long, log_weight double, tail double").select("good", "tail").collect()  # labelled rows
        self.threshold = best_threshold([r["tail"] for r in rows], [r["good"] for r in rows])

    def score(self, docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The columns `keep` with n_features, log_weight, tail and accepted."""
        rows = docs.select(*keep, F.col(text_col).alias("__text"))  # keep must not hold names of the result
        schema = rows.select(*keep).schema.add("n_features", "long").add("log_weight", "double").add("tail", "double")
        return rows.mapInArrow(_scores(self.shared), schema).withColumn("accepted", F.col("tail") >= self.threshold)

    def accepted(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of docs that are accepted, their columns as they are."""
        ratios, threshold, at = self.shared, self.threshold, docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features, table = Features(), ratios.value
            for batch in batches:
                yield batch.filter(pa.array([_score(table, features, x.as_py())[2] >= threshold for x in batch.column(at)], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)


def best_threshold(tails: list[float], good: list[bool]) -> float:
    """Midway between the two values between which accepting errs least, counted per class.

    Losing a share of the good counts LOSS times as much as keeping that share of the bad.
    """
    n_good, n_bad = sum(good), len(good) - sum(good)
    if not n_good or not n_bad:
        return float("-inf")
    pairs = sorted(zip(tails, good, strict=True))
    lost, caught, best, cut = 0, 0, 0.0, float("-inf")
    for i, (tail, ok) in enumerate(pairs):
        lost, caught = lost + ok, caught + (not ok)
        if i + 1 < len(pairs) and pairs[i + 1][0] > tail and (gain := caught / n_bad - LOSS * lost / n_good) > best:
            best, cut = gain, (tail + pairs[i + 1][0]) / 2
    return cut


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest of a double column: the range is cut into CUTS parts again and again.

    Only counts per part reach the driver; the loop ends when the range holds one value.
    """
    low, high = values.agg(F.min(column), F.max(column)).first()
    if k <= 0 or low is None:
        return None
    above = 0
    while low < high:
        width = (high - low) / CUTS
        part = F.least(F.greatest(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(CUTS - 1)) if width else F.lit(0)
        inside = values.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        parts = sorted(inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), key=lambda r: -r["high"])
        for r in parts:
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return high


def resample(scored: DataFrame, share: float, *, id_col: str = "doc_id", temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """scored with gumbel_key and sampled: the ceil(share * rows) largest keys (ties are all in)."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), id_col, "n_features", "log_weight"), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))
    keyed = written(scored.withColumn("gumbel_key", F.col("log_weight") * LENGTH / temperature - F.log(-F.log(unit))), "gumbel")
    k = int(np.ceil(share * keyed.count()))
    cut = kth_largest(keyed, "gumbel_key", k)
    return keyed.withColumn("sampled", F.lit(False) if cut is None else F.col("gumbel_key") >= F.lit(cut))
