"""Vectors for texts: any embedder over checked batches, and one that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions import text as T
from ..functions.batches import by_words

BATCH = 64
SIZE = 64

Embedder = Callable[[list[str]], list[tuple[int, list[float]]]]


def ordered(answers: list[tuple[int, list[float]]], asked: int) -> list[list[float]]:
    """The vectors of a batch in the order of its texts; an answer that isn't one vector a text, all of one size, is refused."""
    if sorted(i for i, _ in answers) != list(range(asked)):
        raise ValueError(f"{len(answers)} vectors for {asked} texts, or not one each")
    if len({len(v) for _, v in answers}) > 1:
        raise ValueError("vectors of different sizes")
    return [v for _, v in sorted(answers, key=lambda a: a[0])]


def embedded(rows: DataFrame, embed: Embedder, text: str = "text", name: str = "embedding", batch: int = BATCH) -> DataFrame:
    """Add ``name``: the vectors that ``embed`` gives for batches of ``batch`` texts, as (index, vector) in any order; null texts are empty."""

    def work(batches):
        for b in batches:
            texts = [x or "" for x in b.column(text).to_pylist()]
            parts = [texts[at : at + batch] for at in range(0, len(texts), batch)]
            vectors = [v for part in parts for v in ordered(embed(part), len(part))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*b.schema.names, name])

    return rows.mapInArrow(work, StructType([*rows.schema, StructField(name, ArrayType(FloatType()))]))


def signs(grams: list[bytes]) -> np.ndarray:
    """SIZE numbers for each gram, each 1 or -1: the bits of its MD5, the first first."""
    digests = b"".join([hashlib.md5(g, usedforsecurity=False).digest()[: SIZE // 8] for g in grams])
    return np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, SIZE).astype(np.int16) * 2 - 1


def hashed_ngrams(rows: DataFrame, text: str = "text", name: str = "embedding") -> DataFrame:
    """Add ``name``: the sum of signs() over a text's words and pairs of words; near texts share most of them.

    A random projection of the counts, so the cosine of two texts' vectors
    estimates that of their counts. A text without words has a vector of zeros.
    """
    words = f"{name}#words"
    keyed = rows.withColumn(words, T.tokens(F.col(text)))

    def work(batches):
        for b in (part for whole in batches for part in by_words(whole, words)):
            flat, ends = b.column(words).flatten(), np.cumsum(b.column(words).value_lengths().to_numpy(zero_copy_only=False))
            vectors = np.zeros((b.num_rows, SIZE), np.int64)
            _add(vectors, flat, ends, 0)
            if len(flat) > 1:
                _add(vectors, pc.binary_join_element_wise(flat[:-1], flat[1:], " "), ends, 1)
            made = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel(), pa.float32()), SIZE).cast(pa.list_(pa.float32()))
            kept = [n for n in b.schema.names if n != words]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), made], [*kept, name])

    return keyed.mapInArrow(work, StructType([*rows.schema, StructField(name, ArrayType(FloatType()))]))


def _add(vectors: np.ndarray, grams: pa.Array, ends: np.ndarray, less: int) -> None:
    """Add the signs of each row's grams; a row of n words has n - ``less`` of them, from its first word's place on."""
    coded = grams.dictionary_encode()
    known = signs(coded.dictionary.cast(pa.binary()).to_pylist())
    index = coded.indices.to_numpy(zero_copy_only=False)
    for i, (first, last) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), (ends - less).tolist(), strict=True)):
        for at in range(first, last, 1 << 14):  # sums of no more signs fit 16 bits
            vectors[i] += known.take(index[at : min(last, at + (1 << 14))], axis=0).sum(0, dtype=np.int16)


def embedding_sql(name: str, rows: str, key: str, text: str) -> str:
    """DuckDB steps that make ``name`` (key, e): the vectors of hashed_ngrams() for ``rows``."""
    pairs = "list_concat(w, list_transform(w[2:], lambda x, i: w[i] || ' ' || x))"
    return f"""{name}_w AS (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '{T.TOKEN}') AS w FROM {rows}),
  {name}_h AS (SELECT {key}, list_transform({pairs}, lambda g: ('0x' || md5(g)[:16])::UBIGINT) AS h FROM {name}_w),
  {name} AS MATERIALIZED (SELECT {key}, list_transform(range({SIZE}), lambda j: (2 * len(list_filter(h, lambda x: (x >> ({SIZE - 1} - j)::UBIGINT) & 1 = 1)) - len(h))::DOUBLE) AS e FROM {name}_h)"""
