"""Periodic runs of words: match lengths along the diagonals (lags) of a text, followed only where a run can be."""

from __future__ import annotations

import hashlib
import zlib
from itertools import count
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .textbytes import blocks, prefix_hashes, span_hashes

#: A run holds at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def periodic_runs(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in ``words`` (numbers; equal words are equal numbers), by start and period.

    Diagonal q holds the words that equal the word q earlier. Its match length
    grows by one with each such word and ends at the first other one; a run of
    period q is a stretch of at least 3 q matches (5 for q = 1). To begin a
    diagonal at every earlier occurrence of every word would cost the square of
    a word's frequency. So diagonal q becomes active only where, at a multiple
    of q, the word's earlier occurrences lie q, 2 q and 3 q back and the words
    between agree too (a hash of both stretches): every run has such a place.
    There it is followed word by word to both ends of the match, comparing
    words. Diagonals are taken from short to long lags, so a place inside a
    known run of a shorter period is skipped: there the longer period would be
    a multiple of the shorter one. That looks at n / q places of lag q, n ln n
    in all, and follows a word in few of them, also in a text of one word over
    and over.

    ``longest``: longest lag looked for, by default a quarter of the words.
    """
    n = len(words)
    hashes = prefix_hashes(words)
    reach = np.zeros(n + 1, np.int64)  # how far the longest known run goes that holds the place
    runs = []
    for q in range(1, (n // LEAST_PERIODS if longest is None else longest) + 1):
        places = words[::q]
        same = places[1:] == places[:-1]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) if len(same) > 2 else ()
        if not len(at):
            continue
        at = at[span_hashes(hashes, at * q, (at + 2) * q) == span_hashes(hashes, (at + 1) * q, (at + 3) * q)]
        if not len(at):
            continue
        breaks = np.flatnonzero(np.diff(at) > 1) + 1
        first, last = at[np.r_[0, breaks]], at[np.r_[breaks - 1, len(at) - 1]]
        new = reach[first * q] < (last + 3) * q + 1
        for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True):
            low, high = max(a * q, q), min((b + 4) * q + 1, n)
            other = np.flatnonzero(words[low:high] != words[low - q : high - q]) + low
            ends = np.r_[other, high]
            begins = np.r_[low, other + 1]
            lengths = ends - begins + q
            for begin, length in zip(begins[lengths >= max(LEAST_WORDS, LEAST_PERIODS * q)].tolist(), lengths[lengths >= max(LEAST_WORDS, LEAST_PERIODS * q)].tolist(), strict=True):
                start, end = begin - q, begin - q + length
                if reach[start] < end:
                    runs.append((start, length, q))
                    np.maximum(reach[start:end], end, out=reach[start:end])
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repeated(words: list[bytes], h: int) -> list[bytes]:
    """The words of a document whose id has the checksum ``h``: every tenth gets periodic from word ``a`` on."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * -(-(n - a) // p))[: n - a]


def _numbers(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers of the words of all texts, one text behind the other; words of different texts differ."""
    total, at, out = sum(map(len, texts)), 0, []
    for words in texts:
        known: dict[bytes, int] = {}
        out.append(np.fromiter(map(known.setdefault, words, count(at)), np.int64, len(words)))
        at += len(words)
    return np.concatenate(out) if total else np.empty(0, np.int64)


def _described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = (None,) * 4
    kept = words
    if runs:
        start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = start, length, period, 1000 * length // period
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


_LONGS = ["n_runs", "start", "length", "period", "exponent_milli"]
_STRINGS = ["runs_sha256", "collapsed_sha256"]


def document_runs(docs: DataFrame, change=repeated) -> DataFrame:
    """A row a document: its number of runs, the run of most periods, checksums of all runs and of the text without repeats.

    Words are runs of bytes other than ASCII white space. ``change`` is given a
    document's words and its id's CRC-32 and returns those to work on (None:
    the words themselves). A null or empty text has no words and no runs; a
    null id has no checksum, so its words stay as they are; repeated rows are
    worked on each for itself; other columns are ignored; no rows give no rows.
    Nothing is shuffled; memory follows the longest text (about 150 bytes a
    word), as texts are worked on in blocks.
    """

    def work(batches):
        for batch in batches:
            ids, text, rows = batch.column("doc_id"), batch.column("text"), []
            for block in blocks(text):
                raw, at = block.data.tobytes(), block.bounds.tolist()
                split = [raw[at[i] : at[i + 1]].split() for i in range(len(block))]
                if change is not None:
                    names = ids.slice(block.first, len(block)).to_pylist()
                    split = [words if i is None else change(words, zlib.crc32(str(i).encode())) for i, words in zip(names, split, strict=True)]
                bounds = np.cumsum([0, *map(len, split)])
                own: list[list] = [[] for _ in split]
                longest = max(map(len, split)) // LEAST_PERIODS
                for start, length, period in periodic_runs(_numbers(split), longest):
                    k = int(np.searchsorted(bounds, start, "right")) - 1
                    own[k].append((start - int(bounds[k]), length, period))
                rows += map(_described, split, own)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns, kinds)], ["doc_id", *_LONGS, *_STRINGS])

    read = docs.select("doc_id", "text")
    schema = StructType([read.schema["doc_id"], *(StructField(c, LongType()) for c in _LONGS), *(StructField(c, StringType()) for c in _STRINGS)])
    return read.mapInArrow(work, schema)


#: Every pair of equal words at most a quarter of the text apart; stretches of them on a diagonal; the smallest period of each place.
ORACLE = r"""WITH t AS MATERIALIZED (SELECT list_transform(range(16), lambda i: list_reduce(range(4), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, i)) AS t),
  d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(hex(encode(doc_id::VARCHAR)), '') AS x FROM documents),
  c AS (SELECT d.*, len(w) AS n, xor(list_reduce(list_transform(range(len(x)), lambda i: instr('0123456789ABCDEF', x[(i // 2) * 2 + 2 - (i % 2)]) - 1), lambda s, v: xor(s >> 4, t[(xor(s, v) & 15) + 1]), 4294967295), 4294967295) AS h FROM d, t),
  e AS (SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN (h // 10) % n ELSE n END AS a FROM c),
  f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
  word AS MATERIALIZED (SELECT r, n, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM f)),
  pair AS (SELECT x.r, x.i, x.i - y.i AS q FROM word x JOIN word y ON x.r = y.r AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
  isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pair),
  run AS MATERIALIZED (SELECT r, start, length, min(q) AS q FROM (SELECT r, q, min(i) - q AS start, count(*) + q AS length FROM isle GROUP BY r, q, g) WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
  gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM run),
  kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (r, i) GROUP BY r),
  listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM run GROUP BY r),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length / q DESC, start, q) AS k FROM run) WHERE k = 1)
  SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
  FROM d LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""
