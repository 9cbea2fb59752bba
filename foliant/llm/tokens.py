"""Token counts of whole texts: batches balanced by bytes, long texts split where no token can cross, lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .packing import vocabulary_path
from .textbytes import blocks

#: sentencepiece's sign for a space.
MARK = "▁"
#: A batch handed to the encoder holds about so many characters.
BATCH_CHARS = 1 << 18
#: Counts of segments are kept from batch to batch until they hold so many characters.
KEPT_CHARS = 1 << 24


class WholeCounter:
    """Counts by a vocabulary file of the ``tokenizers`` library, of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self._model.no_truncation()
        self._model.no_padding()

    def encode(self, batch: list[str]) -> list[int]:
        return [len(e.ids) for e in self._model.encode_batch_fast(batch, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        return [n for batch in balanced(texts) for n in self.encode(batch)]


class SegmentCounter(WholeCounter):
    """Counts by a model file of ``sentencepiece``, of texts split at safe boundaries.

    A space is a safe boundary if a character that no piece holds before a space
    stands before it, and something after it: no merge crosses it, and the
    space that it takes is the one which the encoder puts before the rest. So a
    text has as many tokens as its segments together, and equal segments, most
    of them words, are encoded once. Where the model changes characters or has
    symbols of the user, texts are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._known: dict[str, int] = {}
        self._chars = 0
        unsafe = unsafe_before_space(self._model)
        self._boundary = None if unsafe is None else re.compile(rf"(?<=[^ {re.escape(''.join(sorted(unsafe)))}]) (?=.)", re.DOTALL)
        self._plain = unsafe == {MARK}

    def encode(self, batch: list[str]) -> list[int]:
        return list(map(len, self._model.encode(batch, num_threads=1)))

    def segments(self, text: str) -> list[str]:
        if self._boundary is None:
            return [text]
        if self._plain and "  " not in text and MARK not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        return self._boundary.split(text)

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.segments(text) for text in texts]
        known = self._known
        new = list(set().union(*cut) - known.keys())
        for batch in balanced(new):
            known.update(zip(batch, self.encode(batch), strict=True))
        out = [sum(map(known.__getitem__, segments)) for segments in cut]
        self._chars += sum(map(len, new))
        if self._chars > KEPT_CHARS:
            known.clear()
            self._chars = 0
        return out


def unsafe_before_space(model) -> set[str] | None:
    """Characters that some piece holds right before a space; None if splitting isn't safe for this model at all."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    rules = proto.normalizer_spec
    changes = rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces
    bpe = proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
    own = any(p.type == sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED for p in proto.pieces)
    if changes or not bpe or own or proto.trainer_spec.treat_whitespace_as_suffix:
        return None
    return {MARK, *(p.piece[i - 1] for p in proto.pieces for i in range(1, len(p.piece)) if p.piece[i] == MARK)}


def balanced(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Batches of about ``limit`` characters; a longer text is a batch by itself."""
    held, batch = 0, []
    for text in texts:
        if batch and held + len(text) > limit:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += len(text)
    if batch:
        yield batch


@cache
def counter(path: str) -> WholeCounter:
    return SegmentCounter(path) if path.endswith(".model") else WholeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``vocabulary`` is a file of /opt/tokenizers or a path. A null or empty text
    has 0 bytes and tokens; repeated rows, equal ids and null ids are counted
    each for itself; other columns are ignored; no rows give no rows. Nothing
    is shuffled, and only numbers leave the task. Memory follows the longest
    text, not the number of rows.
    """

    def count(batches):
        counts = counter(vocabulary_path(vocabulary)).counts
        for batch in batches:
            text, numbers = batch.column("text"), []
            for block in blocks(text):
                part = text.slice(block.first, len(block)).to_pylist()
                numbers += counts([x or "" for x in part])
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    read = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    schema = StructType([read.schema["doc_id"], read.schema["n_bytes"], StructField("n_tokens", LongType())])
    return read.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
