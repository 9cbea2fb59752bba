"""Language identification: sparse multinomial logistic regression on hashed TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out

BITS = 15
ORDERS = (1, 2, 3)
PER = 100.0  # term frequencies are per so many n-grams
BLOCK_CHARS = 1 << 19
ONE = 1 << 24  # weights are summed in whole parts of so many


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _chunks(texts: list[str | None]):
    """Runs of whole texts of about BLOCK_CHARS characters: (first, texts)."""
    at, size, part = 0, 0, []
    for i, t in enumerate(texts):
        if part and size + len(t or "") > BLOCK_CHARS:
            yield at, part
            at, size, part = i, 0, []
        part.append(t or "")
        size += len(t or "")
    if part:
        yield at, part


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-grams of each order over the joined texts, the bounds of the texts there, and who has letters.

    Lower case; every character that is no letter counts as a space, and so do
    letters in a run with digits (keys, numbers), which are no language. Each
    text has as many spaces before it as the longest n-gram reaches beyond its
    first character, and the same behind it. An n-gram that begins at position p
    has its hash there; those at the end of a text reach only into the spaces
    before the next one, so a text's n-grams don't depend on what else is joined.
    """
    pad = " " * (max(ORDERS) - 1)
    parts = [(pad + t.lower() + pad).encode("utf-32-le", "surrogatepass") for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])
    code = np.frombuffer(b"".join(parts), np.uint32)
    letter = _letters()[code]
    count = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
    has = np.diff(count[bounds]) > 0
    digit = (code >= 48) & (code <= 57)
    inside = letter | digit
    run = np.cumsum(inside & ~np.concatenate([[False], inside[:-1]]))
    mixed_run = np.zeros(int(run[-1]) + 1 if len(run) else 1, bool)
    mixed_run[run[digit]] = True
    c = np.where(letter & ~mixed_run[run], code, np.uint32(32)).astype(np.uint64)
    out, key = [], np.zeros(len(c), np.uint64)
    for n in range(max(ORDERS)):
        key = key * np.uint64(0x100000001B3) + np.concatenate([c[n:], np.full(n, 32, np.uint64)]) + np.uint64(1)
        if n + 1 in ORDERS:
            mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    return out, bounds, has


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of ``docs`` each hashed n-gram occurs, and how many have a letter; counted over all of them.

    A task sends its non-zero counts, at most 2**BITS rows whatever its size.
    """

    def count(batches):
        total, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for _, texts in _chunks(b.column("text").to_pylist()):
                orders, bounds, has = grams(texts)
                for i in np.flatnonzero(has):
                    seen = np.zeros(1 << BITS, bool)
                    for g in orders:
                        seen[g[bounds[i] : bounds[i + 1]]] = True
                    total += seen
                    n += 1
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(keys, -1)), pa.array(np.append(total[keys], n))], ["gram", "n"]
        )

    rows = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = rows.toPandas()  # at most 2**BITS + 1 rows
    df = np.zeros(1 << BITS)
    counted = found[found["gram"] >= 0]
    df[counted["gram"].to_numpy()] = counted["n"]
    return df, int(found.loc[found["gram"] < 0, "n"].sum())


def tf_idf(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(lang, indexes, values) of each text with a letter."""

    def work(batches):
        for b in batches:
            langs, out = b.column("lang").to_pylist(), []
            for first, texts in _chunks(b.column("text").to_pylist()):
                orders, bounds, has = grams(texts)
                for i in np.flatnonzero(has):
                    every = np.concatenate([g[bounds[i] : bounds[i + 1]] for g in orders])
                    keys, n = np.unique(every, return_counts=True)
                    out.append((langs[first + i], keys.tolist(), (n * (PER / len(every)) * idf[keys]).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.list_(pa.int32()), pa.list_(pa.float32())))],
                ["lang", "keys", "tfidf"],
            )

    return docs.select("lang", "text").mapInArrow(work, "lang string, keys array<int>, tfidf array<float>")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # n-grams by languages
    bias: np.ndarray
    temperature: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(
    rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, alpha: float = 0.5, beta: float = 0.1,
    l1: float = 0.002, l2: float = 0.02, epochs: int = 4, seed: int = 3,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal on softmax loss with elastic net; only the coordinates of a row are touched by it.

    The last coordinate is the bias. Returns sparse weights and the bias.
    """
    z = np.zeros(((1 << BITS) + 1, classes))
    n = np.zeros_like(z)

    def leader(at):
        zs, root = z[at], np.sqrt(n[at])
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + root) / alpha + l2))

    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            label, keys, values = rows[i]
            at, x = np.append(keys, 1 << BITS), np.append(values, 1.0)
            w = leader(at)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = leader(np.arange(len(z)))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that makes the labels likeliest, by golden-section search on its logarithm."""
    if not len(logits):
        return 1.0
    loss = lambda t: -np.log(np.maximum(1e-12, _softmax(logits / np.exp(t))[np.arange(len(labels)), labels])).mean()
    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, max_rows: int = 4000, seed: int = 11) -> Model | None:
    """Fit on rows (text, lang, doc_id) with a language.

    Document frequencies are of all rows. The regression sees about
    ``max_rows`` different rows, an equal share for each language, chosen by
    hashes of their ids and texts; one in five of them only sets the temperature.
    Languages are taken to be few: of each, a count and 2**15 weights are on the driver.
    """
    known = docs.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    df, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    spark = docs.sparkSession
    share = max(1, max_rows // len(counts))
    cuts = spark.createDataFrame([(k, min(1.0, share / v)) for k, v in counts.items()], "lang string, part double")
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6)
    sample = known.join(F.broadcast(cuts), "lang").filter(place < F.col("part")).dropDuplicates(["doc_id", "text", "lang"])  # cuts has a row a language
    found = tf_idf(sample.select("lang", "text"), idf).toPandas()
    languages = sorted(counts)
    rank = {k: i for i, k in enumerate(languages)}
    rows = [
        (rank[a], np.asarray(b, np.int64), np.asarray(c, float))
        for a, b, c in zip(found["lang"], found["keys"], found["tfidf"], strict=True)
    ]
    rows.sort(key=lambda r: (r[0], len(r[1]), float(r[2].sum())))
    tuned, rest = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    if not rest:
        tuned, rest = [], rows
    weights, bias = follow_the_leader(rest, len(languages))
    logits = np.array([c @ weights[b] + bias for _, b, c in tuned]).reshape(len(tuned), len(languages))
    return Model(languages, idf, weights, bias, calibrate(logits, np.array([r[0] for r in tuned], dtype=int)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its calibrated chance; ``und`` with 0 for texts without letters."""
    languages = np.array(model.languages if model else ["und"], dtype=object)
    k = len(languages)
    # Whole numbers, so that a sum doesn't depend on its order or on what else is in the batch.
    per_gram = np.rint(model.idf[:, None] * model.weights * PER * ONE).astype(np.int64) if model else None

    def work(batches):
        for b in batches:
            names, scores = [], []
            for _, texts in _chunks(b.column("text").to_pylist()):
                orders, bounds, has = grams(texts)
                size = np.diff(bounds) * len(orders)
                if model is None:
                    chance, has = np.ones((len(texts), 1)), np.zeros(len(texts), bool)
                else:
                    logits = np.empty((len(texts), k))
                    for j in range(k):
                        column = np.ascontiguousarray(per_gram[:, j])
                        total = sum(np.add.reduceat(column[g], bounds[:-1]) for g in orders)
                        logits[:, j] = total / ONE / size + model.bias[j]
                    chance = _softmax(logits / model.temperature)
                best = chance.argmax(axis=1)
                names += np.where(has, languages[best], "und").tolist()
                scores += np.where(has, chance[np.arange(len(best)), best], 0.0).tolist()
            made = [b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double")


def identify_documents(docs: DataFrame, max_rows: int = 4000) -> DataFrame:
    """The language contract: learn from documents that aren't held out, predict all.

    Without any language to learn from, every text is ``und``. Repeated rows
    are predicted each; no documents, no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = train(rows.filter(~held_out(4, 2)), max_rows)
    found = predict(rows, model)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
