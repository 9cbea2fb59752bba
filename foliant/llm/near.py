"""Near-duplicate join: shingle sets with Jaccard similarity of three quarters or more, by adaptive multi-match prefixes.

If two sets of n and m shingles are that similar, they share ceil(3n/4) of the
one's and ceil(3m/4) of the other's shingles. So in any order of all shingles
the first n - ceil(3n/4) + L of the one and as many of the other have L in
common, for every L up to the required overlap. Here the order is by rarity,
and each document picks its own L: a longer prefix is dearer to look up but
lets only pairs with L matches through to verification. Matches are counted on
the prefixes alone; only sets that have a partner with enough of them, and of a
size that allows a link, are brought together and verified.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .tables import components, lookup, shuffle_partitions, stacked, stored, unused

SHINGLE = 5
MOST_MATCHES = 64  # verification costs 2**-63 of a list by then, so more never pay
FREQUENT_ROWS = 1 << 18  # so many shingles have their frequency known exactly in the order
LEAST_FREQUENT = 8
_SPARE_BITS = 5
GROUP = 1024  # sets of a block; two blocks meet in a task
GROUP_SHINGLES = 4_000_000  # and so many shingles
COLUMNS = 2048
_FACTORS = tb.mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_FILTER_BITS = 1 << 24


def shingle_sets(block: tb.Block, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles; fewer words than ``size`` are one shingle."""
    low = tb.Block(block.first, tb.LOWER[block.data], block.bounds)
    w = tb.words(low)
    h = tb.mix(tb.span_hashes(tb.prefix_hashes(low.data), w.start, w.end))
    n = len(h)
    if n >= size:
        made = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            made += h[j : n - size + 1 + j] * _FACTORS[j]
        made = tb.mix(made)
    out = []
    for i in range(len(block)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= size:
            out.append(np.unique(made[a : b - size + 1]))
        elif b > a:
            short = (h[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(tb.mix(short + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _node(signature: bytes, renamed: dict[bytes, int]) -> int:
    """The number that stands for a set: 63 bits of its signature, or its own where two sets would have the same."""
    return renamed.get(signature) or int.from_bytes(signature[:8], "little") >> 1


def sized_sets(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, node (from the signature of the set) and the signature."""

    def work(batches):
        for b in batches:
            sizes, nodes, names = [], [], []
            for block in tb.blocks(b.column("text")):
                for s in shingle_sets(block):
                    names.append(_signature(s))
                    sizes.append(len(s))
                    nodes.append(_node(names[-1], {}))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(names, pa.binary())],
                ["doc_id", "h", "n_shingles", "node", "signature"],
            )

    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return hashed.mapInArrow(work, "doc_id long, h long, n_shingles long, node long, signature binary")


def distinct_nodes(sized: DataFrame) -> tuple[DataFrame, dict[bytes, int]]:
    """``sized`` with a node of its own for each different set, and the nodes of those sets that were renamed.

    Two sets have 63 bits of their signatures in common once in 2**64 pairs: of
    a billion sets, in one corpus of twenty. All but one are named by the other
    half of their signatures, until no two have the same.
    """
    spark, renamed = sized.sparkSession, {}
    while True:
        names = sized.filter("n_shingles > 0").groupBy("node").agg(F.min("signature").alias("low"), F.max("signature").alias("high"))
        clashes = stored(names.filter("low <> high").select("node", "low"), "clashes")
        if clashes.isEmpty():
            return sized, renamed
        late = sized.filter("n_shingles > 0").join(F.broadcast(clashes), "node").filter("signature <> low").select("signature").distinct()
        for row in late.toLocalIterator():  # none or a few
            signature = bytes(row["signature"])
            before = renamed.get(signature, int.from_bytes(signature[8:], "little"))
            renamed[signature] = (before * 0x9E3779B97F4A7C15 + 1) % (1 << 63) or 1
        own = spark.createDataFrame([(bytearray(k), v) for k, v in renamed.items()], "signature binary, own long")
        found = sized.drop("own").join(F.broadcast(own), "signature", "left").withColumn("node", F.coalesce("own", "node"))
        sized = found.select("doc_id", "h", "n_shingles", "node", "signature")


# ---- how often shingles occur ----


@dataclass(frozen=True)
class Frequencies:
    """What is known of how many documents have a shingle, in bounded space.

    ``shared`` has a bit for each of a power of two of hash values: if it isn't
    set, no other document has the shingle. ``keys`` and ``df`` are the most
    frequent shingles, FREQUENT_ROWS at most.
    """

    key_bits: int
    shared: np.ndarray
    keys: np.ndarray
    df: np.ndarray
    renamed: dict[bytes, int]  # see distinct_nodes()

    def others(self, s: np.ndarray) -> np.ndarray:
        """Estimated number of other documents with each shingle; 0 is certain."""
        key = s >> np.uint64(64 - self.key_bits)
        bit = (key >> np.uint64(self.key_bits - (len(self.shared) * 8 - 1).bit_length())).astype(np.int64)
        out = (self.shared[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(float)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where(self.keys[at] == key, self.df[at] - 1.0, out)
        return out


def count_shingles(docs: DataFrame, shingles: int, renamed: dict[bytes, int]) -> Frequencies:
    """Count all shingles of all documents, by 32 bits of their hash or up to 40 if there are very many.

    A task sends its sorted keys in compressed runs, one for each range of
    keys; the number of ranges follows the number of shingles, so a range's
    counts stay small. Back come a bit a key (2**20 to 2**30 bits in all, one
    for each shingle up to there) and the most frequent keys.
    """
    filter_bits = min(30, max(20, (shingles - 1).bit_length()))
    key_bits = max(32, filter_bits + _SPARE_BITS)
    spare = key_bits - filter_bits
    range_bits = max(4, key_bits - 32, min(16, (shingles >> 20).bit_length()))
    ranges, shift = 1 << range_bits, key_bits - range_bits

    def flush(parts):
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(shift))
        rows = []
        for r in range(ranges):
            a, b = cuts[r], cuts[r + 1]
            if a < b:
                gaps = np.diff(keys[a:b] - (np.uint64(r) << np.uint64(shift)), prepend=np.uint64(0)).astype("<u4")
                planes = gaps.view(np.uint8).reshape(-1, 4).T.tobytes()
                few = np.minimum(counts[a:b], 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                rows.append((r, int(b - a), zlib.compress(planes + few, 1)))
        types = (pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], ["range", "n", "keys"])

    def count(batches):
        parts, n = [], 0
        for b in batches:
            for block in tb.blocks(b.column("text")):
                for s in shingle_sets(block):
                    parts.append(s >> np.uint64(64 - key_bits))
                    n += len(s)
                if n > 3_000_000:
                    yield flush(parts)
                    parts, n = [], 0
        if n:
            yield flush(parts)

    def total(part: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for n, packed in zip(part["n"], part["keys"], strict=True):
            raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, n)
            keys.append(np.cumsum(np.ascontiguousarray(raw[:4].T).view("<u4").ravel(), dtype=np.uint64))
            counts.append(np.ascontiguousarray(raw[4:].T).view("<u4").ravel())
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        bits = np.zeros(1 << max(0, shift - spare), np.uint8)
        bits[(every[df > 1] >> np.uint64(spare)).astype(np.int64)] = 1
        often = df >= LEAST_FREQUENT
        whole = every.astype(np.int64) | int(part["range"].iloc[0]) << shift
        first = pd.DataFrame({"key": [-1], "df": [int(part["range"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})
        return pd.concat([first, pd.DataFrame({"key": whole[often], "df": df[often], "bits": None})])

    packed = docs.select("text").mapInArrow(count, "range int, n long, keys binary")
    found = stored(packed.groupBy("range").applyInPandas(total, "key long, df long, bits binary"), "frequencies")
    shared = np.zeros(max(ranges, 1 << filter_bits - 3), np.uint8)
    size = len(shared) // ranges
    for row in found.filter("key < 0").toLocalIterator():  # 2**27 bytes at most, all ranges together
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        shared[row["df"] * size : row["df"] * size + len(part)] = part
    rows, least = 0, (1 << 16) + 1
    counted = found.filter("key >= 0")
    for step in counted.groupBy(F.least("df", F.lit(1 << 16)).alias("df")).count().orderBy(F.desc("df")).collect():
        rows += step["count"]  # down to which frequency are there no more rows than FREQUENT_ROWS?
        if rows > FREQUENT_ROWS:
            break
        least = step["df"]
    top = counted.filter(F.col("df") >= least).select("key", "df").limit(FREQUENT_ROWS).toPandas().sort_values("key")
    return Frequencies(key_bits, shared, top["key"].to_numpy(np.uint64), top["df"].to_numpy(np.int64), renamed)


# ---- prefixes ----


def needed(n: int) -> int:
    """Of n shingles, how many a similar set has: ceil(3n / 4)."""
    return (3 * n + 3) // 4


def adaptive_prefix(s: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingles of the prefix in order, the level from which each counts, matches required).

    ``others`` estimates how many other sets have each shingle. The cost of L
    matches is the length of the lists looked up plus that of verifying the
    candidates, which fall by half or more with each further match required.
    Shingles that certainly no other set has are in the prefix, but are left
    out of what is returned.
    """
    n = len(s)
    first = n - needed(n) + 1
    most = min(MOST_MATCHES, needed(n), n - first + 1)
    order = np.argsort(others, kind="stable")[: first + most - 1]  # the hashes ascend already
    s, others = s[order], others[order]
    lists = np.cumsum(others)[first - 1 :]
    matches = np.arange(1, most + 1)
    cost = lists + n * lists / (matches * 2.0 ** (matches - 1))
    chosen = int(np.argmin(cost)) + 1
    levels = np.ones(first + chosen - 1, np.int64)
    levels[first:] = np.arange(2, chosen + 1)
    known = others[: len(levels)] > 0
    return s[: len(levels)][known], levels[known], chosen


def prefix_postings(docs: DataFrame, frequencies: Frequencies) -> DataFrame:
    """token, node and what() of each prefix shingle that another document may have."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)  # bounded, see there

    def work(batches):
        known, seen = shared.value, set()
        for b in batches:
            if len(seen) > 1 << 18:
                seen = set()
            for block in tb.blocks(b.column("text")):
                tokens, nodes, about = [], [], []
                sets = shingle_sets(block)
                others = known.others(np.concatenate(sets)) if sets else np.empty(0)
                at = 0
                for s in sets:
                    own, at = others[at : at + len(s)], at + len(s)
                    node = _node(_signature(s), known.renamed) if own.any() else None
                    if node is None or node in seen:  # copies here have the same postings
                        continue
                    seen.add(node)
                    prefix, levels, need = adaptive_prefix(s, own)
                    tokens.append(prefix)
                    nodes.append(np.full(len(prefix), node, np.int64))
                    about.append(what(len(s), need, levels))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [_signed(np.concatenate(tokens)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(about))],
                        ["token", "node", "what"],
                    )

    return docs.filter("doc_id is not null").select("text").mapInArrow(work, "token long, node long, what long")


def what(size, need, level):
    """Size of a set, matches that it requires and the level from which a shingle counts, in one number."""
    return np.int64(size) << 16 | np.int64(need) << 8 | np.asarray(level, np.int64)


POSTING = "token long, node long, what long, leader long"


def shared_postings(postings: DataFrame, partitions: int) -> DataFrame:
    """(token, node, what, leader) of the shingles that two different sets of like size have in their prefixes.

    A list is in order of size, and ends where the next set is too large for a
    link with the last: only neighbours in such a list can be similar. The
    leader is the list's first node. Lists are read in order and never held: a
    list of any length needs the memory of one batch.
    """

    def work(batches):
        held = None  # the last row (token, node, what), its list's leader, and whether a row of the same list went before
        for b in batches:
            rows = [b.column(k).to_numpy() for k in range(3)]
            if held is not None:
                rows = [np.concatenate([[x], y]) for x, y in zip(held[0], rows, strict=True)]
            token, node, about = rows
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, about = token[new], node[new], about[new]
            if not len(token):
                continue
            size = about >> 16
            more = np.zeros(len(token), bool)
            more[1:] = (token[1:] == token[:-1]) & (4 * size[:-1] >= 3 * size[1:])
            lead = np.maximum.accumulate(np.where(more, 0, np.arange(len(token))))
            leader = node[lead]
            if held is not None:
                leader, more[0] = np.where(lead == 0, held[1], leader), held[2]
            keep = more.copy()
            keep[:-1] |= more[1:]
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, node, about, leader)], _POSTING)
            held = ((token[-1], node[-1], about[-1]), leader[-1], bool(more[-1]))
        if held is not None and held[2]:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (*held[0], held[1])], _POSTING)

    size = F.shiftright("what", 16)
    ordered = postings.repartition(partitions, "token").sortWithinPartitions("token", size, "node")
    return ordered.mapInArrow(work, POSTING)


_POSTING = [x.split()[0] for x in POSTING.split(", ")]


# ---- verification ----


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2**24 hashed ids (2 MB whatever their number): an id that isn't in it is none of ``ids``."""
    at = F.pmod(F.xxhash64("id"), F.lit(_FILTER_BITS))
    rows = (
        ids.select(at.alias("v")).groupBy(F.expr("v div 32768").alias("part"))
        .agg(F.bitmap_construct_agg(F.expr("v % 32768")).alias("bits")).collect()
    )
    out = np.zeros(_FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


SETS = "id long, node long, size long, shingles binary"


def wanted_sets(docs: DataFrame, wanted: DataFrame, frequencies: Frequencies) -> DataFrame:
    """node, size and shingles of the documents ``wanted`` (node, id), a row a node.

    ``shingles`` has those that another document may have. A small bitmap keeps
    most other texts from being read further; the join decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast((_id_filter(wanted), frequencies))

    def work(batches):
        bits, known = shared.value
        for b in batches:
            v = b.column("v").to_numpy()
            chosen = b.take(pa.array(np.flatnonzero(bits[v >> 3] >> (v & 7).astype(np.uint8) & 1)))
            out = []
            for block in tb.blocks(chosen.column("text")):
                for s in shingle_sets(block):
                    out.append((_node(_signature(s), known.renamed), len(s), s[known.others(s) > 0].tobytes()))
            types = (pa.int64(), pa.int64(), pa.binary())
            rows = [pa.array([x[k] for x in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([chosen.column("doc_id"), *rows], [x.split()[0] for x in SETS.split(", ")])

    hashed = docs.filter("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER_BITS)).alias("v"))
    return hashed.mapInArrow(work, SETS).join(wanted, ["node", "id"], "left_semi").drop("id")  # repeated rows give repeated sets


def _overlaps(owner: np.ndarray, token: np.ndarray, members: int) -> np.ndarray:
    """How many of its tokens each member shares with each other one: products of 0/1 matrices, some columns at a time."""
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)  # the rest is nobody else's here
    owner, column = owner[several], column[several]
    out = np.zeros((members, members), np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate([[0], np.diff(column) > 0]))
    for at in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((members, min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def _alike(sizes: np.ndarray) -> np.ndarray:
    """Which pairs are of sizes that a link allows; no set is its own partner."""
    out = 4 * np.minimum(sizes[:, None], sizes[None]) >= 3 * np.maximum(sizes[:, None], sizes[None])
    np.fill_diagonal(out, False)
    return out


def with_partner(about: list[np.ndarray], tokens: list[np.ndarray]) -> np.ndarray:
    """Members of a group that share as many prefix shingles with another one as both require."""
    k = len(tokens)
    owner = np.repeat(np.arange(k), [len(t) for t in tokens])
    token, every = np.concatenate(tokens), np.concatenate(about)
    level = every & 255
    sizes, need = np.array([a[0] >> 16 for a in about]), np.array([a[0] >> 8 & 255 for a in about])
    both = np.minimum(need[:, None], need[None])
    candidate = np.zeros((k, k), bool)
    for n in np.unique(both):
        inside = (level <= n) & (need[owner] >= n)
        candidate |= (both == n) & (_overlaps(owner[inside], token[inside], k) >= n)
    return np.flatnonzero((candidate & _alike(sizes)).any(axis=1))


def similar(sizes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """For each member of a group, the first member that links lead to, by the exact overlap of all pairs."""
    k = len(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    common = _overlaps(owner, np.concatenate(sets), k)
    linked = _alike(sizes) & (7 * common >= 3 * (sizes[:, None] + sizes[None]))  # 100 * common >= 75 * union
    label = np.arange(k)
    for i in range(k):
        if label[i] != i:
            continue
        front = np.array([i])
        while len(front):  # all that can be reached from i
            reached = np.flatnonzero(linked[front].any(axis=0))
            front = reached[label[reached] == reached]
            front = front[front != i]
            label[front] = i
    return label


def _in_groups(rows: DataFrame, schema: str, partitions: int, settle) -> DataFrame:
    """``settle`` of the rows (without repeated nodes) of each (leader, x, y) with more than one; rows are read in order."""
    n = len(rows.columns)

    def work(batches):
        key, group = None, []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(n)), strict=True):
                if row[:3] != key:
                    if len(group) > 1:
                        yield settle(key, group)
                    key, group = row[:3], []
                if not group or group[-1][0] != row[3]:
                    group.append(row[3:])
        if len(group) > 1:
            yield settle(key, group)

    ordered = rows.repartition(partitions, "leader", "x", "y").sortWithinPartitions("leader", "x", "y", "node")
    return ordered.mapInArrow(work, schema)


CANDIDATE = "leader long, x int, y int, node long"


def candidates(postings: DataFrame, partitions: int) -> DataFrame:
    """(leader, x, y, node) of the sets to verify: they share enough of their prefixes with another one of block x or y of the leader.

    Lists with one leader have much the same nodes, so they are counted
    together: a set's prefix goes once to each of its leaders, not to each
    partner. Two sets with a prefix shingle in common meet at its leader. The
    sets of a leader with very many are dealt into blocks, and every two blocks
    meet.
    """
    members = postings.groupBy("node").agg(F.collect_list(F.struct("token", "what")).alias("tokens"), F.collect_set("leader").alias("leaders"))
    members = members.select("node", "tokens", F.explode("leaders").alias("leader"))
    sized = postings.select("leader", "node", F.shiftright("what", 16).alias("size")).distinct()
    groups = sized.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    dealt = lookup(members, groups, "leader", "n")
    blocks = F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("total") / GROUP_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    dealt = dealt.select("leader", "node", "tokens", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = dealt.select("leader", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "tokens.token", "tokens.what")

    def settle(key, group: list[tuple]) -> pa.RecordBatch:
        chosen = with_partner([np.array(g[2], np.int64) for g in group], [np.array(g[1], np.int64) for g in group])
        made = [np.full(len(chosen), k) for k in key] + [np.array([g[0] for g in group], np.int64)[chosen]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], _CANDIDATE)

    return _in_groups(rows, CANDIDATE, partitions, settle)


_CANDIDATE = [x.split()[0] for x in CANDIDATE.split(", ")]


def similar_pairs(docs: DataFrame, postings: DataFrame, nodes: DataFrame, frequencies: Frequencies, partitions: int) -> DataFrame:
    """(a, b): links that connect all sets that similar pairs connect, by exact overlaps of the candidates."""
    found = stored(candidates(postings, partitions), "candidates")
    wanted = found.select("node").distinct().join(nodes.select("node", F.col("rep").alias("id")), "node")
    rows = found.join(wanted_sets(docs, wanted, frequencies), "node").select("leader", "x", "y", "node", "size", "shingles")

    def settle(_key, group: list[tuple]) -> pa.RecordBatch:
        node = np.array([g[0] for g in group], np.int64)
        label = similar(np.array([g[1] for g in group], np.int64), [np.frombuffer(g[2], np.uint64) for g in group])
        far = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node[label[far]]), pa.array(node[far])], ["a", "b"])

    return _in_groups(rows, "a long, b long", partitions, settle)


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, that with its smallest doc_id (and of those the smallest hash), with all its columns.

    Of equal repeated rows one stays; rows without doc_id or without words all stay. Only texts
    whose ids a bitmap (2 MB) doesn't clear of being dropped are shuffled.
    """
    id_, h, later, copies, check = unused(docs, "id", "h", "later", "copies", "check")
    found = similarity_classes(docs).filter("doc_id is not null and n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias(id_), F.col("h").alias(h)).agg(F.max("later").alias(later), F.count(F.lit(1)).alias(copies))
    touched = stored(found.filter(F.col(later) | (F.col(copies) > 1)), "dropped")
    bits = docs.sparkSession.sparkContext.broadcast(_id_filter(touched.select(F.col(id_).alias("id"))))

    @F.pandas_udf("boolean")
    def maybe(v: pd.Series) -> pd.Series:
        at = v.to_numpy()
        return pd.Series((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    rows = docs.withColumn(id_, F.col("doc_id").cast("long"))
    rows = rows.withColumn(check, F.col(id_).isNotNull() & maybe(F.pmod(F.xxhash64(id_), F.lit(_FILTER_BITS))))
    clear = rows.filter(~F.col(check)).select(*docs.columns)
    checked = rows.filter(check).withColumn(h, F.xxhash64("text")).join(touched, [id_, h], "left")
    once = checked.filter(F.col(later).isNull()).select(*docs.columns)
    several = checked.filter(~F.col(later)).dropDuplicates([id_, h]).select(*docs.columns)
    return stacked(clear, once, several)


def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id, and ``later``: whether another row comes first in the component.

    component_id is the smallest doc_id that links of similar documents lead to, the document's own included.

    Equal sets are one node from the start, told apart by 128-bit signatures.
    All pairs that share enough of their prefixes are verified, where their
    sets meet; only links that connect what is found leave the task.

    A document without words (null, empty, white space) is in its own
    component. A row without doc_id takes part in nothing and has a null
    component. Repeated rows share a component. No documents, no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = shuffle_partitions(spark)
    sized, renamed = distinct_nodes(stored(sized_sets(rows), "sets"))
    real = sized.filter("n_shingles > 0 and doc_id is not null")
    nodes = real.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n"))
    nodes = stored(nodes, "nodes").select("node", "first", F.col("first.doc_id").alias("rep"), "copies", "n")
    frequencies = count_shingles(rows, nodes.agg(F.sum("n")).first()[0] or 1, renamed)
    postings = stored(shared_postings(prefix_postings(rows, frequencies), parts), "postings")
    links = stored(similar_pairs(rows, postings, nodes, frequencies, parts), "links")
    comps = components(links)
    named = comps.join(nodes, "node").groupBy("comp").agg(F.min("first").alias("least"))
    of_node = comps.join(named, "comp").select("node", "least")
    classes = nodes.join(of_node, "node", "left").select("node", F.coalesce("least", "first").alias("least"), "copies")
    found = lookup(sized.select("doc_id", "h", "n_shingles", "node"), classes, "node", "copies")
    empty, known = F.col("n_shingles") == 0, F.col("doc_id").isNotNull()
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    later = F.struct("doc_id", "h") != F.col("least")
    return found.select(
        "doc_id", "h", "n_shingles", F.when(known, component).alias("component_id"), (known & ~empty & F.coalesce(later, F.lit(False))).alias("later")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The near-duplicate contract: doc_id, n_shingles, component_id."""
    return similarity_classes(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
linked AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, linked.y FROM reach JOIN linked ON linked.x = reach.r)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY w.doc_id, n
"""
