"""Quality scores by Bradley-Terry ranking of labelled pairs."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .tables import stored

#: Rows of the commoner label that make pairs in one cell, and of the other label there at least.
ROWS_PER_CELL, PARTNERS = 512, 32

_UPPER = tb.byte_class(bytes(range(65, 91)))
_LETTER = tb.byte_class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT = tb.byte_class(b"0123456789")
_MARK = tb.byte_class(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?!"))
_STOP = tb.byte_class(b".!?")
_LINE = tb.byte_class(b"\n")

FEATURES = [
    "log_words", "word_length", "word_length_sd", "letters", "upper", "digits", "marks", "stops", "lines", "no_letter_words",
    "mark_ends", "shouted_words", "distinct", "long_distinct", "repeats", "sqrt_marks", "sqrt_upper", "sqrt_repeats",
    "sqrt_no_letter_words", "sqrt_shouted_words", "sqrt_mark_ends", "few_distinct", "has_text",
]


def text_features(block: tb.Block) -> np.ndarray:
    """One row of FEATURES for each text: shares of kinds of bytes and words, and how often words repeat."""
    n = len(block)
    size = np.maximum(1, np.diff(block.bounds)).astype(float)

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[block.data], dtype=np.int64)])
        return np.diff(total[block.bounds]) / size

    w = tb.words(block)
    count = np.diff(w.first)
    some = np.maximum(1, count).astype(float)
    each = lambda values: np.bincount(w.text, weights=values, minlength=n) / some
    length = (w.end - w.start).astype(float)
    mean = each(length)
    in_word = lambda kind: (lambda t: t[w.end] - t[w.start])(np.concatenate([[0], np.cumsum(kind[block.data], dtype=np.int64)]))
    letters, upper = in_word(_LETTER), in_word(_UPPER)
    last = block.data[w.end - 1] if len(w.end) else np.empty(0, np.uint8)
    doubled = (last == block.data[np.maximum(w.start, w.end - 2)]) & (length > 1) & ~_LETTER[last] & ~_DIGIT[last]
    key = tb.mix(tb.span_hashes(tb.prefix_hashes(block.data), w.start, w.end))
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (w.text[1:] == w.text[:-1])
    order = np.lexsort((key, w.text))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (w.text[order][1:] != w.text[order][:-1])
    distinct = np.bincount(w.text[order], weights=new, minlength=n) / some
    marks, capitals, repeats = share(_MARK), share(_UPPER), each(again)
    no_letter, shouted, ends = each(letters == 0), each((upper == letters) & (upper > 1)), each(doubled)
    log_words = np.log1p(count)
    cols = [
        log_words, mean, np.sqrt(np.maximum(0, each(length**2) - mean**2)), share(_LETTER), capitals, share(_DIGIT), marks,
        share(_STOP), share(_LINE), no_letter, ends, shouted, distinct, distinct * log_words, repeats, np.sqrt(marks),
        np.sqrt(capitals), np.sqrt(repeats), np.sqrt(no_letter), np.sqrt(shouted), np.sqrt(ends),
        np.maximum(0, 0.4 - distinct), (count > 0).astype(float),
    ]
    return np.stack(cols, axis=1)


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of the whole text; null and empty texts have zeros."""

    def work(batches):
        for b in batches:
            rows = [text_features(x) for x in tb.blocks(b.column("text"))]
            flat = np.concatenate(rows) if rows else np.empty((0, len(FEATURES)))
            values = pa.ListArray.from_arrays(
                pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat.ravel())
            )
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), values], ["doc_id", "features"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(work, "doc_id long, features array<double>")


@dataclass(frozen=True)
class Ranker:
    """score = sigmoid(weights . features - threshold + logit(cut)): ``cut`` or more if and only if above the threshold."""

    weights: list[float]
    threshold: float
    cut: float

    def latent(self, features: Column) -> Column:
        terms = F.array(*[F.lit(w) for w in self.weights])
        return F.aggregate(F.zip_with(features, terms, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)

    def score(self, features: Column) -> Column:
        shift = float(np.log(self.cut / (1 - self.cut))) - self.threshold
        bounded = F.least(F.greatest(self.latent(features) + F.lit(shift), F.lit(-500.0)), F.lit(500.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-bounded))


def fit(x: np.ndarray, label: np.ndarray, cut: float = 0.3, pairs: int = 60_000, penalty: float = 1.0, seed: int = 5) -> Ranker:
    """Bradley-Terry by Newton's method on the logistic loss of feature differences (label 1 minus label 0).

    The threshold is the quantile of the training scores at the share of label
    0. Without both labels nothing can be ranked: every score is 0.5.
    """
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker([0.0] * x.shape[1], float(np.log(cut / (1 - cut))), cut)
    scale = x.std(axis=0)
    scale[scale < 1e-9] = np.inf  # a feature that never changes has no say
    random = np.random.default_rng(seed)
    z = x / scale
    diff = z[random.choice(good, pairs)] - z[random.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))  # chance that the pair is the wrong way round
        slope = penalty * w - diff.T @ p
        bend = (diff * (p * (1 - p))[:, None]).T @ diff + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    latent = np.sort(z @ w)
    below = len(bad) * len(latent) // len(label)
    return Ranker((w / scale).tolist(), float((latent[max(0, below - 1)] + latent[min(below, len(latent) - 1)]) / 2), cut)


def held_out(modulus: int, kept: int) -> Column:
    """Whether the CRC-32 of the id's text leaves ``kept``; a null id has the empty text."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % F.lit(modulus)) == F.lit(kept)


def train(features: DataFrame, labels: DataFrame, cut: float = 0.3, max_labelled: int = 20_000, pairs: int = 60_000, penalty: float = 1.0) -> Ranker:
    """Fit on every labelled id of (doc_id, features), with one row each however often it occurs.

    Held-out ids, and ids with both labels or a null one, teach nothing.
    Newton's method starts from fit() of about ``max_labelled`` rows on the
    driver; its steps sum over the pairs of all rows (pair_cells()), and the
    threshold is the exact quantile of all rows' scores. The loss is convex, so
    the start decides how many steps are taken, not where they end. It counts
    as that of ``pairs`` pairs against ``penalty``, however many there are.
    """
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("low"), F.max("quality").alias("label")
    )
    known = known.filter("low = label and label in (0, 1)").filter(~held_out(5, 0)).select("doc_id", "label")
    rows = features.join(known, "doc_id").groupBy("doc_id", "label").agg(F.min_by("features", F.xxhash64("features")).alias("features"))
    rows = stored(rows, "quality-labelled")
    spreads = [F.stddev_pop(F.col("features")[i]) for i in range(len(FEATURES))]
    bad, good, *scale = rows.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1), *spreads).first()
    share = min(1.0, max_labelled / max(1, bad + good))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / F.lit(1e6)
    sample = rows.filter(place < share).select("features", "label").toPandas()
    x = np.array(sample["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, sample["label"]))  # the fit doesn't depend on the order of arrival
    start = fit(x[order], sample["label"].to_numpy(dtype=int)[order], cut)
    if not bad or not good:
        return start
    scale = np.array(scale)
    scale[scale < 1e-9] = np.inf  # a feature that never changes has no say
    w = np.where(np.isfinite(scale), np.array(start.weights) * np.where(np.isfinite(scale), scale, 0), 0.0)
    cells = pair_cells(rows, good, bad)
    for _ in range(25):
        n, slope, bend = pair_sums(cells, w, scale)
        slope, bend = penalty * w - slope * (pairs / n), bend * (pairs / n) + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    ranker = Ranker((w / scale).tolist(), 0.0, cut)
    return replace(ranker, threshold=middle(rows.select(ranker.latent(F.col("features")).alias("value")), bad))


def pair_cells(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """(good, bad): the features of both labels' rows (doc_id, label, features) by cell, every row in one at least.

    Each good row of a cell makes a pair with each bad one. The commoner label
    is dealt into cells of about ROWS_PER_CELL; a row of the other lies in as
    many cells as give each about PARTNERS of them. So pairs grow with the rows.
    """
    common, n, other = (1, good, bad) if good >= bad else (0, bad, good)
    cells = -(-n // ROWS_PER_CELL)
    copies = min(cells, -(-PARTNERS * cells // other))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(cells))
    several = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: F.pmod(place + i * (cells // copies), F.lit(cells)))
    each = rows.select("label", "features", F.explode(F.when(F.col("label") == common, F.array(place)).otherwise(several)).alias("cell"))
    of = lambda label: F.sort_array(F.collect_list(F.when(F.col("label") == label, F.col("features"))))
    return stored(each.groupBy("cell").agg(of(1).alias("good"), of(0).alias("bad")).select("good", "bad"), "quality-pairs")


def pair_sums(cells: DataFrame, w: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """How many pairs there are, and the sums over them of the logistic loss's slope (downwards) and bend at ``w``; a task gives one row."""
    k = len(w)

    def work(batches):
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            for good, bad in zip(batch.column("good"), batch.column("bad"), strict=True):
                g, b = (np.asarray(x.values.flatten()).reshape(-1, k) / scale for x in (good, bad))
                p = 1 / (1 + np.exp(np.clip((g @ w)[:, None] - (b @ w)[None], -500, 500)))  # chance that a pair is the wrong way round
                bend = p * (1 - p)
                across = g.T @ bend @ b
                bends = (g.T * bend.sum(1)) @ g + (b.T * bend.sum(0)) @ b - across - across.T
                total += np.concatenate([[p.size], g.T @ p.sum(1) - b.T @ p.sum(0), bends.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    sums = np.array(cells.mapInArrow(work, "sums array<double>").toPandas()["sums"].tolist()).sum(axis=0)
    return sums[0], sums[1 : 1 + k], sums[1 + k :].reshape(k, k)


def middle(values: DataFrame, below: int, bins: int = 4096) -> float:
    """The middle between the ``below``-th smallest ``value`` and the next one, exactly, by counts of ever smaller ranges."""
    low, high, n = values.agg(F.min("value"), F.max("value"), F.count(F.lit(1))).first()
    seen = 0
    while low < high:
        at = F.least(F.floor((F.col("value") - low) / (high - low) * bins), F.lit(bins - 1)).alias("bin")
        inside = values.filter(F.col("value").between(low, high)).groupBy(at)
        for _, count, low, high in sorted(inside.agg(F.count(F.lit(1)), F.min("value"), F.max("value")).collect()):  # noqa: B007
            if seen + count >= below:
                break
            seen += count
    upto, after = values.agg(F.count_if(F.col("value") <= low), F.min(F.when(F.col("value") > low, F.col("value")))).first()
    return low if upto > below or after is None else (low + after) / 2


def score_documents(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_labelled: int = 20_000) -> DataFrame:
    """The quality contract: every document's score and prediction.

    Features of all documents are computed once and written; the ranker is
    fitted on all labelled ones. Repeated rows are scored each; no
    documents, no rows.
    """
    features = stored(with_features(docs), "quality-features")
    ranker = train(features, labels, cut, max_labelled)
    scored = features.select("doc_id", held_out(5, 0).alias("held_out"), ranker.score(F.col("features")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The documents that the ranker doesn't reject, with all their columns; texts are read again instead of shuffled."""
    ranker = train(stored(with_features(docs), "quality-features"), labels, cut)
    weights, threshold = np.array(ranker.weights), ranker.threshold

    def work(batches):
        for b in batches:
            rows = [text_features(x) @ weights >= threshold for x in tb.blocks(b.column("text"))]
            yield b.filter(pa.array(np.concatenate(rows))) if rows else b

    return docs.mapInArrow(work, docs.schema)
