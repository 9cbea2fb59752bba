"""Packing token sequences: first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import json
import re
import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stacked, stored

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, group_at double"
PACKED_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, padded_to long"
)
#: tiktoken's regular expressions keep a state for each character of a run of white space and fail near a million.
LONG_RUN = 500_000
_LONG_SPACE = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's letter of each byte: printable ones are themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE vocabulary file of the ``tokenizers`` library.

    The file's vocabulary is run by ``tiktoken``, which is three times as fast
    here. Each worker first compares it with ``tokenizers`` on ``probes`` and
    uses ``tokenizers`` itself if any id differs, and for any text with the name
    of an added token (such as ``<|endoftext|>``, which has an id of its own),
    with a long run of white space, or on which ``tiktoken`` fails.
    """

    def __init__(self, vocabulary: str, probes: tuple[str, ...] = ()):
        self._vocabulary = vocabulary
        self._fast = self._build()
        if self._fast and any(self._fast.encode_ordinary(x) != self._slow().encode(x, add_special_tokens=False).ids for x in probes):
            self._fast = None

    @cache  # noqa: B019  one encoder lives as long as its worker
    def _slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._vocabulary)

    def _build(self):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(self._vocabulary, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self._names = [token["content"] for token in file["added_tokens"]]
        letters = byte_alphabet()
        ranks = {}
        for word, rank in model["vocab"].items():
            if all(c in letters for c in word):
                ranks[bytes(letters[c] for c in word)] = rank
        ranks = {k: v for k, v in ranks.items() if len(k) == 1 or v < len(model["merges"]) + 256}
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        plain = not any(name in text for name in self._names)
        if self._fast and plain and not (len(text) >= LONG_RUN and _LONG_SPACE.search(text)):
            try:
                return self._fast.encode_ordinary(text)
            except BaseException as e:  # a panic in Rust is no Exception, and its class can't be imported
                if type(e).__name__ != "PanicException":
                    raise
        return self._slow().encode(text, add_special_tokens=False).ids


PROBES = (
    "It's a test,  of 1234 numbers\n\n and words\tthey'll keep: naïve çà ñandú 東京 \U0001f600 !!! ",
    "   leading and trailing   ",
    "AbCdEf_ghi-jkl %%% && |",
)


@cache
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary, PROBES)


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; a path is kept as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 1, length: int = 2048, seed: int = 17
) -> DataFrame:
    """Documents as pieces of at most ``length`` ids, each a row; a document's ids end with ``end_id``.

    Only lengths and checksums leave the task. ``group_at`` in [0, 1) is a
    seeded random place, the same for no two pieces of note, from which the
    groups are made. A null text has the one id ``end_id``.
    """

    def cut(batches):
        encode = encoder(vocabulary_path(vocabulary)).ids
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.array([*(encode(text) if text else ()), end_id], dtype="<u4")
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length]
                    out.append((doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield made.astype({"start": "int64", "length": "int64", "ids_crc32": "int64", "doc_tokens": "int64"})

    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"
    cut_up = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(cut, schema)
    return cut_up.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("group_at", F.rand(seed))


class Bins:
    """Bins in order of opening, with a tournament tree of their free room: the winner of a node is its roomiest bin.

    ``place`` walks from the root to the leftmost bin with room enough.
    """

    def __init__(self, most: int, capacity: int):
        self._leaves = 1 << max(0, most - 1).bit_length()
        self._room = [capacity] * (2 * self._leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, free room before) of the first bin that ``size`` fits in."""
        room, node = self._room, 1
        while node < self._leaves:
            node *= 2
            if room[node] < size:
                node += 1
        before = room[node]
        room[node] -= size
        at = node >> 1
        while at:
            left, right = room[2 * at], room[2 * at + 1]
            room[at] = left if left > right else right
            at >>= 1
        return node - self._leaves, before


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size; sizes that decrease are placed first, ties in the order given."""
    bins = Bins(len(sizes), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if not 0 < sizes[i] <= capacity:
            raise ValueError(f"size {sizes[i]} with bins of {capacity}")
        where, before = bins.place(sizes[i])
        out[i] = (where, capacity - before)
    return out


def pack(found: DataFrame, length: int = 2048, group_size: int = 4096) -> DataFrame:
    """Place pieces in sequences of at most ``length`` ids.

    A full piece is a sequence by itself. The others are dealt at random into
    groups of about ``group_size``, so a group's size doesn't depend on what
    is common in the corpus, and each group is packed by itself.
    """
    found = stored(found, "pieces")  # the random places must not change from here on
    full = found.filter(F.col("length") == length).select(
        *_KEPT, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("sequence_tokens"), F.col("length").alias("padded_to"),
    )
    rest = found.filter(F.col("length") < length)
    groups = max(1, -(-rest.count() // group_size))

    def place(key, part):
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        spots = np.array(first_fit_decreasing(part["length"].tolist(), length), dtype="int64").reshape(-1, 2)
        used = np.bincount(spots[:, 0], weights=part["length"].to_numpy()).astype("int64")
        whole = used[spots[:, 0]]
        out = part[_KEPT].copy()
        out["sequence_id"] = ((int(key[0]) << 24) + spots[:, 0]) * 2
        out["offset"] = spots[:, 1]
        out["sequence_tokens"] = whole
        out["padded_to"] = np.where(whole & (whole - 1) == 0, whole, length)
        return out

    dealt = rest.withColumn("grp", F.floor(F.col("group_at") * groups).cast("long"))
    packed = dealt.groupBy("grp").applyInPandas(place, PACKED_SCHEMA)
    return stacked(full, packed)


_KEPT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = 2048) -> DataFrame:
    """The packing contract: one row a piece, with its sequence and the offset there.

    ``padded_to`` is ``length``, or the sequence's own size where that is a
    power of two. Repeated rows are packed each for itself; a null doc_id
    stays null; no documents, no rows.
    """
    return pack(pieces(docs, vocabulary, length=length), length)
