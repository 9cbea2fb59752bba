"""Product quantisation in integers, with exact nearest entries by slicing and intersecting bitmasks."""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .tables import lookup, stored

#: Rows compared at a time; bounds a task's memory at rows x entries x components.
ROWS = 1024
SCALE = 1024


class Slices:
    """The entries of one part's codebook, found by their coordinates.

    For each component the entries' coordinates are sorted, and each prefix of
    that order has a mask with a bit for each of its entries, in words of 64
    bits. The entries in a range are the mask at its end without that at its
    begin; the masks of all components ANDed are the entries in a box.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self._sorted = np.take_along_axis(entries, order, 0)
        bits = np.zeros((n, -(-n // 64)), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self._masks = np.zeros((width, n + 1, bits.shape[1]), np.uint64)
        for d in range(width):
            np.bitwise_or.accumulate(bits[order[:, d]], axis=0, out=self._masks[d, 1:])
        self.radius = self._spacing()

    def _spacing(self) -> int:
        """The middle one of the entries' distances to their nearest other entry: where a search begins."""
        nearest = []
        for i in range(len(self.entries)):
            apart = ((self.entries - self.entries[i]) ** 2).sum(1)
            apart[i] = apart.max(initial=0)
            nearest.append(isqrt(int(apart.min(initial=0))))
        return sorted(nearest)[len(nearest) // 2]

    def inside(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of all entries that no component of the row's point is farther from than its radius, in order."""
        found = np.full((len(points), self._masks.shape[2]), ~np.uint64(0))
        found[:] &= self._masks[0, -1] if len(self._masks) else _all(len(self.entries))
        for d, masks in enumerate(self._masks):
            low = np.searchsorted(self._sorted[:, d], points[:, d] - radius, "left")
            high = np.searchsorted(self._sorted[:, d], points[:, d] + radius, "right")
            found &= masks[high] ^ masks[low]
        return np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little"))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each point's nearest entry; of equally near ones the first.

        An entry outside a box of radius r is at least r + 1 away. So the best
        one inside is the nearest if it is nearer than that; else its distance
        is the radius to look in again, or twice the radius if there was none.
        """
        code, best = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        open_rows = np.arange(len(points))
        radius = np.full(len(points), self.radius, np.int64)
        while len(open_rows):
            own = points[open_rows]
            row, entry = self.inside(own, radius)
            apart = ((own[row] - self.entries[entry]) ** 2).sum(1)
            has, first = np.unique(row, return_index=True)
            least = np.minimum.reduceat(apart, first) if len(has) else apart
            is_least = apart == np.repeat(least, np.diff(np.r_[first, len(row)]))
            _, at = np.unique(row[is_least], return_index=True)
            sure = least < (radius[has] + 1) ** 2
            done = open_rows[has[sure]]
            code[done], best[done] = entry[is_least][at][sure], least[sure]
            again = np.ones(len(open_rows), bool)
            again[has[sure]] = False
            radius = radius * 2 + 1
            radius[has] = [isqrt(x) for x in least.tolist()]
            open_rows, radius = open_rows[again], radius[again]
        return code, best


def _all(n: int) -> np.ndarray:
    """A mask with the bits of ``n`` entries."""
    return np.array([(1 << min(64, n - at)) - 1 for at in range(0, n, 64)], np.uint64)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of floor(1024 x); all of ``width`` components, small enough for squared distances in 64 bits."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    lengths = np.diff(np.asarray(column.offsets))
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} components are expected, not of {set(lengths.tolist()) - {width}}")
    scaled = np.floor(values * SCALE)
    most = isqrt(2**62 // max(1, width)) // 2
    if len(scaled) and np.abs(scaled).max() > most:
        raise ValueError(f"components above {most / SCALE:g} have squared distances beyond 64 bits")
    return scaled.astype(np.int64).reshape(len(column), width)


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: F.abs(x) < float("inf")), F.lit(False))


def _update(codebooks: list[np.ndarray], sums: DataFrame, parts: int, width: int) -> list[np.ndarray]:
    """Each entry moved to the floor of its parts' mean; unused ones stay. ``sums`` has a row a used entry."""
    moved = [c.copy() for c in codebooks]
    totals = [F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        moved[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return moved


def train(vectors: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """Codebooks of ``vectors`` (vec_id, embedding): an array of entries x components for each part.

    A round is one pass: each task adds up its parts by entry, so parts x
    entries rows leave it, and as many reach the driver.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    if not first:
        return []
    total = len(first[0][0])
    if total % parts:
        raise ValueError(f"{total} components can't be cut into {parts} equal parts")
    start = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), total)
    width = total // parts
    codebooks = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    kind = "part int, entry int, n long" + "".join(f", s{i} long" for i in range(width))

    for _ in range(rounds):

        def add_up(batches, codebooks=codebooks):
            slices = [Slices(c) for c in codebooks]
            sums = [np.zeros((len(c), width + 1), np.int64) for c in codebooks]
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    found = integers(batch.column("embedding").slice(at, ROWS), total)
                    for p in range(parts):
                        own = found[:, p * width : (p + 1) * width]
                        np.add.at(sums[p], slices[p].nearest(own)[0], np.column_stack([np.ones(len(own), np.int64), own]))
            for p, table in enumerate(sums):
                used = np.flatnonzero(table[:, 0])
                columns = [np.full(len(used), p, np.int32), used.astype(np.int32), *table[used].T]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "n", *(f"s{i}" for i in range(width))])

        codebooks = _update(codebooks, vectors.select("embedding").mapInArrow(add_up, kind), parts, width)
    return codebooks


def checksum(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """``vectors`` without the embedding, with ``code`` (two hexadecimal digits a part) and ``error`` (squared distance)."""
    total = sum(c.shape[1] for c in codebooks)

    def assign(batches):
        slices = [Slices(c) for c in codebooks]
        for batch in batches:
            codes, errors = [], []
            for at in range(0, batch.num_rows, ROWS):
                found = integers(batch.column("embedding").slice(at, ROWS), total)
                near = [s.nearest(own) for s, own in zip(slices, np.split(found, len(slices), axis=1), strict=True)]
                codes += [bytes(row).hex() for row in np.column_stack([c for c, _ in near]).astype(np.uint8)]
                errors.append(sum(e for _, e in near))
            rest = [batch.column(c) for c in batch.schema.names if c != "embedding"]
            error = np.concatenate(errors) if errors else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*rest, pa.array(codes, pa.string()), pa.array(error)], [f.name for f in schema])

    kept = [f for f in vectors.schema if f.name != "embedding"]
    schema = StructType([*kept, StructField("code", StringType()), StructField("error", LongType())])
    return vectors.mapInArrow(assign, schema)


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the rows of ``vectors`` (vec_id, embedding, label) with finite vectors.

    A component is floor(1024 x). Codebooks start as the parts of the rows with
    the smallest ids (at most 256; of equal ids by the vector, null ids last)
    and move ``rounds`` times to the floor of their parts' means. Rows whose
    vector is null, or holds null, NaN or an infinity, are left out; repeated
    rows count and stay each for itself; with fewer rows than entries the
    codebooks are smaller; no rows give no rows. Vectors of different lengths,
    of a length that can't be cut into ``parts``, or too large for 64 bits
    (with 64 components above 2**17) raise ValueError. Other columns are ignored.

    Vectors are read once a round and are never shuffled; errors by label are
    looked up without gathering a label's rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so 1 to 256 entries")
    kept = vectors.filter(finite("embedding")).select("vec_id", "embedding", "label")
    codebooks = train(kept.select("vec_id", "embedding"), parts, entries, rounds)
    coded = stored(encode(kept, codebooks) if codebooks else _none(kept), "codes")
    label = F.to_json(F.struct("label"))  # {} for null, and no other value has it
    by_label = coded.groupBy(label.alias("key")).agg(F.sum("error").alias("label_error"), F.count("*").alias("weight"))
    found = lookup(coded.withColumn("key", label), by_label, "key", "weight")
    return found.select("vec_id", "code", "error", "label_error", F.lit(checksum(codebooks)).alias("codebooks_sha256"))


def _none(kept: DataFrame) -> DataFrame:
    return kept.drop("embedding").withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")})


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same in SQL: each round compares every part with every entry."""
    assigned = """a{k} AS MATERIALIZED (SELECT r, p, m % 256 AS e, m // 256 AS dist FROM (SELECT s.r, s.p, min((s.xx - 2 * list_dot_product(s.x, c.x) + c.xx)::BIGINT * 256 + c.e) AS m FROM s JOIN c{k} AS c ON s.p = c.p GROUP BY s.r, s.p))"""
    moved = """u{k} AS (SELECT p, e, i, sum(x)::BIGINT AS t, count(*) AS n FROM (SELECT a.p, a.e, unnest(s.x)::BIGINT AS x, unnest(range(len(s.x))) AS i FROM a{k} AS a JOIN s ON a.r = s.r AND a.p = s.p) GROUP BY p, e, i),
  v{k} AS (SELECT p, e, list(((t - ((t % n) + n) % n) // n)::DOUBLE ORDER BY i) AS x FROM u{k} GROUP BY p, e),
  c{j} AS MATERIALIZED (SELECT p, e, x, list_dot_product(x, x) AS xx FROM (SELECT c.p, c.e, coalesce(v.x, c.x) AS x FROM c{k} AS c LEFT JOIN v{k} AS v ON c.p = v.p AND c.e = v.e))"""
    steps = ",\n  ".join(x for k in range(rounds) for x in (assigned.format(k=k), moved.format(k=k, j=k + 1)))
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v, len(embedding) // {parts} AS w
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS MATERIALIZED (SELECT *, list_dot_product(x, x) AS xx FROM (SELECT r, p, v[p * w + 1 : (p + 1) * w] AS x FROM (SELECT *, unnest(range({parts})) AS p FROM k))),
  c0 AS MATERIALIZED (SELECT p, r AS e, x, xx FROM s WHERE r < {entries}),
  {steps},
  {assigned.format(k=rounds)},
  sums AS (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda y: y::BIGINT), 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
  o AS (SELECT r, string_agg(lower(printf('%02x', e::INT)), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a{rounds} GROUP BY r)
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), sums"""


ORACLE = _oracle()
