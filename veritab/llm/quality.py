"""Quality classifier by importance resampling over hashed n-grams, with Gumbel top-k.

Two generative models over hashed words and word pairs are counted: raw text (all
documents) and target text (a bounded sample of documents labelled good and not
toxic). The log importance ratio of a feature is log((target + a) / (expected + a)),
where expected is its raw count on the target's scale. Where the two counts differ by no more than ``evidence``
standard deviations of the expected one, both models back off to the common frequency and the ratio
is nothing: else the chance differences of the many rare words would add up in long texts. A
document's log weight is the sum of the ratios of all its words and pairs. Documents are then sampled without
replacement by Gumbel top-k: key = log weight / temperature + Gumbel
noise, hashed from the id, and the k largest keys are selected.

k is the number of documents whose weight reaches a cut. It is fitted on labelled documents held out
from the target, as the one for which (bad below it) - clean_weight * (good below it), as shares, is largest.

Only the labels used for fitting are sampled (``labelled`` rows with the least hash of their
id). Raw counts, weights and the k-th key cover all documents. Ratios
are whole millionths, so a weight does not depend on how rows are batched.

Defined results: null and empty texts have no tokens and weight 0. Without target documents all
weights are 0, and without good or bad held-out labels nothing is rejected. Equal keys at the
k-th place are all selected; repeated rows are repeated, with one key for one id and text. Null
ids and contradictory labels of an id don't count as labels. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import byte_tokens, mix, slices, staged, text_bytes, tidied

#: Features of each kind (words, word pairs): the models hold twice as many counts, whatever the input.
FEATURES = 1 << 19
#: Text bytes worked on at once, and features that are held before they are counted.
PIECE, HELD = 1 << 19, 1 << 20
#: 0 white space, 1 letters, digits and what is beyond ASCII, 2 all else.
KINDS = np.full(256, 2, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 0
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
MICRO = 1_000_000


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word feature, pair feature with the next word, whether there is a next word, row) of each token."""
    h, row = byte_tokens(data, offsets, KINDS)
    words = (h % np.uint64(FEATURES)).astype(np.int64)
    pairs = np.zeros(len(h), np.int64)
    follows = np.zeros(len(h), bool)
    if len(h):
        pairs[:-1] = (mix(h[:-1] * np.uint64(31) + h[1:]) % np.uint64(FEATURES)).astype(np.int64) + FEATURES
        follows[:-1] = row[1:] == row[:-1]
    return words, pairs, follows, row


def count_features(docs: DataFrame, text_col: str, flag_col: str) -> np.ndarray:
    """[2, 2 * FEATURES]: counts over all documents, and over those whose flag is true."""

    def run(batches):
        total = np.zeros((2, 2 * FEATURES), np.int64)
        held: tuple[list, list] = ([], [])

        def count(k: int, least: int) -> None:
            if sum(map(len, held[k])) >= least:
                total[k] += np.bincount(np.concatenate(held[k]), minlength=2 * FEATURES)
                held[k].clear()

        for b in batches:
            data, offsets = text_bytes(b.column(0))
            flags = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets, PIECE):
                words, pairs, follows, row = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = flags[i:j][row]
                for k, keep in ((0, slice(None)), (1, own)):
                    held[k].extend(x.astype(np.int32) for x in (words[keep], pairs[keep][follows[keep]]))
                    count(k, HELD)
        for k in (0, 1):
            count(k, 1)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], ["feature", "raw", "target"])

    parts = docs.select(text_col, flag_col).mapInArrow(tidied(run), "feature int, raw long, target long")
    # At most 2 * FEATURES rows, a fixed bound.
    rows = parts.groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    out = np.zeros((2, 2 * FEATURES), np.int64)
    at = rows.column(0).to_numpy()
    out[0][at], out[1][at] = rows.column(1).to_numpy(), rows.column(2).to_numpy()
    return out


def log_ratios(counts: np.ndarray, smoothing: float, evidence: float) -> np.ndarray:
    """The log ratio of each feature in millionths; the models of words and pairs have totals of their own."""
    out = np.zeros(2 * FEATURES, np.int64)
    for part in (slice(0, FEATURES), slice(FEATURES, 2 * FEATURES)):
        raw, target = counts[0][part], counts[1][part]
        if target.sum():
            expected = raw * (target.sum() / raw.sum())
            ratio = np.round(np.log((target + smoothing) / (expected + smoothing)) * MICRO)
            out[part] = np.where(np.abs(target - expected) > evidence * np.sqrt(expected + 1), ratio, 0)
    return out


def log_weights(data: np.ndarray, offsets: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The sum of the ratios of each text's words and pairs, in millionths."""
    words, pairs, follows, row = features(data, offsets)
    out = np.zeros(len(offsets) - 1, np.int64)
    np.add.at(out, row, ratios[words] + np.where(follows, ratios[pairs], 0))
    return out


def weigh(docs: DataFrame, ratios, text_col: str = "text", out_col: str = "log_weight") -> DataFrame:
    """docs with its log weight (a double); a column of that name is replaced. ratios: a broadcast of log_ratios."""
    docs = docs.drop(out_col)
    where = docs.columns.index(text_col)
    names = [*docs.columns, out_col]

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(where))
            weights = [log_weights(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ratios.value) for i, j in slices(offsets, PIECE)]
            out = np.concatenate(weights) / MICRO if weights else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names)

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields, StructField(out_col, DoubleType())]))


def best_cut(weights: np.ndarray, good: np.ndarray, clean_weight: float) -> float:
    """The cut that rejects the bad and keeps the good; -inf where either is missing."""
    if not good.any() or good.all():
        return -math.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    gain = np.append(0, np.cumsum(~g) / (~g).sum() - clean_weight * np.cumsum(g) / g.sum())
    gain[1:-1][w[1:] == w[:-1]] = -math.inf
    best = int(np.argmax(gain))
    return -math.inf if best == 0 else math.inf if best == len(w) else float((w[best - 1] + w[best]) / 2)


def gumbel_key(log_weight: F.Column, temperature: float, *seed: str) -> F.Column:
    """Whole millionths of log weight / temperature plus Gumbel noise hashed from the seed columns."""
    unit = (F.pmod(F.xxhash64(*seed, F.lit("gumbel")), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    return F.round((log_weight / temperature - F.log(-F.log(unit))) * MICRO).cast("long")


def kth_largest(df: DataFrame, key: str, k: int) -> int | None:
    """The exact k-th largest value of a long column; None if there are fewer rows.

    Four passes count rows by 16 bits each, so at most 65,536 counts come to the driver.
    """
    offset = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    high, known = 0, 0
    for shift in (48, 32, 16, 0):
        digits = F.shiftrightunsigned(offset, shift)
        part = df.where(F.col(key).isNotNull())
        if known:
            part = part.where(F.shiftrightunsigned(digits, 16) == high)
        rows = part.groupBy(digits.bitwiseAND(F.lit(0xFFFF)).alias("digit")).count().collect()
        for digit, count in sorted(((r["digit"], r["count"]) for r in rows), reverse=True):
            if k <= count:
                high, known = high << 16 | digit, known + 1
                break
            k -= count
        else:
            return None
    return high - (1 << 63)


class Classifier:
    """The fitted models, cut and k-th key."""

    def __init__(self, ratios, cut: float, temperature: float, threshold: int | None, id_col: str, text_col: str):
        self.ratios, self.cut, self.temperature, self.threshold = ratios, cut, temperature, threshold
        self.id_col, self.text_col = id_col, text_col

    def judged(self, weighed: DataFrame) -> DataFrame:
        """weighed with its Gumbel key (a double) and whether it is selected."""
        key = gumbel_key(F.col("log_weight"), self.temperature, self.id_col)
        chosen = F.lit(True) if self.threshold is None else key >= self.threshold
        return weighed.withColumn("gumbel_key", key / MICRO).withColumn("selected", chosen)

    def keep(self, docs: DataFrame) -> DataFrame:
        """The selected rows of docs, with its own columns; weights are computed again, no text is shuffled."""
        clash = [c for c in ("log_weight", "gumbel_key", "selected") if c in docs.columns]
        if clash:
            renamed = docs.withColumnsRenamed({c: f"__{c}" for c in clash})
            return self.keep(renamed).withColumnsRenamed({f"__{c}": c for c in clash})
        done = self.judged(weigh(docs, self.ratios, self.text_col))
        return done.where("selected").select(*docs.columns)


def resample(docs: DataFrame, labels: DataFrame, labelled: int = 20_000, smoothing: float = 1.0, evidence: float = 5.0, clean_weight: float = 5.0, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Classifier]:
    """((id, log_weight, gumbel_key, selected) of each row of docs, the fitted classifier)."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(id_col).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("__good"), F.max((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("__most"))
    known = known.where("__good = __most").select(id_col, "__good", (F.pmod(F.xxhash64(id_col, F.lit("fold")), F.lit(4)) == 0).alias("__held"))
    known = staged(known.orderBy(F.xxhash64(id_col), id_col).limit(labelled), "labels")
    marked = docs.select(id_col, text_col).join(F.broadcast(known), id_col, "left").withColumn("__target", F.coalesce(F.col("__good") & ~F.col("__held"), F.lit(False)))
    ratios = spark.sparkContext.broadcast(log_ratios(count_features(marked, text_col, "__target"), smoothing, evidence))
    weighed = staged(weigh(docs.select(id_col, text_col), ratios, text_col).drop(text_col), "weights")
    held = weighed.join(F.broadcast(known.where("__held")), id_col).groupBy(id_col).agg(F.min("log_weight").alias("w"), F.first("__good").alias("good")).toArrow()
    cut = best_cut(held.column("w").to_numpy(), held.column("good").to_numpy().astype(bool), clean_weight)
    k = weighed.where(F.col("log_weight") >= cut).count() if cut > -math.inf else None
    threshold = None
    if k is not None:
        keys = weighed.select(gumbel_key(F.col("log_weight"), temperature, id_col).alias("key"))
        threshold = kth_largest(staged(keys, "keys"), "key", k) if k else (1 << 63) - 1
    classifier = Classifier(ratios, cut, temperature, threshold, id_col, text_col)
    return classifier.judged(weighed), classifier
