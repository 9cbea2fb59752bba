import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from foliant.llm import decontaminate, near, packing, pii, quality, sharding
from foliant.llm import queries as corpus_queries

from .conftest import EDGES, documents


def brute_shards(rows, n=8):
    sized = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, _ in rows))
    total, at, out, counts = sum(s for *_, s in sized), 0, [], defaultdict(int)
    for known, i, crc, size in sized:
        shard = min(n - 1, (2 * at + size) * n // (2 * total))
        out.append((i if known else None, size, crc, "bytes", shard, counts[shard], None))
        counts[shard] += 1
        at += size
    return sorted(out, key=repr)


def test_shards(spark, no_docs):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 500), None) for i in rng.sample(range(10_000), 300)] + [e for e in EDGES if e[0] != 4] + [(20_000, "y", None)] * 5
    found = sharding.shard_documents(documents(spark, rows)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_shards(rows)
    totals = defaultdict(int)
    for r in found:
        totals[r.shard] += r.size
    assert max(totals.values()) - min(totals.values()) <= 2 * 501
    assert sharding.shard_documents(no_docs).collect() == []


def test_first_fit_decreasing_against_a_plain_loop():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
        free, plain = [], [None] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            where = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
            if where == len(free):
                free.append(100)
            plain[i] = (where, 100 - free[where])
            free[where] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, 100) == plain
    with pytest.raises(ValueError):
        packing.first_fit_decreasing([101], 100)


def check_packing(rows, texts):
    encode = packing.encoder(packing.vocabulary_path("byte_bpe_50k.json")).ids
    sequences = defaultdict(list)
    for r in rows:
        ids = np.array([*encode(texts[r.doc_id] or ""), 1], "<u4")[r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == own[0].sequence_tokens <= 2048
    return sequences


def test_packing(spark, edge_docs, no_docs):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "béta", "gam ma", "12", "..."]) for _ in range(rng.choice([0, 10, 300, 3000]))), None) for i in range(200)]
    docs = documents(spark, rows)
    found = packing.pack_documents(docs).collect()
    sequences = check_packing(found, {i: t for i, t, _ in rows})
    per_doc = defaultdict(int)
    for r in found:
        per_doc[r.doc_id] += r.length
    assert all(per_doc[r.doc_id] == r.doc_tokens for r in found) and len(per_doc) == 200
    used = sum(r.length for r in found)
    assert used >= 0.97 * 2048 * len(sequences)
    edges = packing.pack_documents(edge_docs).collect()
    assert sum(r.start == 0 for r in edges) == edge_docs.count()
    check_packing(edges, {i: t for i, t, _ in EDGES})
    assert packing.pack_documents(no_docs).collect() == []


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    fast = packing.encoder(path)
    assert fast._fast is not None
    rng = random.Random(9)
    parts = [*"abc ABC 'sté\n\t0129 .,!  \U0001f600東ǅß\x00\x85\u2028\u200d", "'ll", "<|endoftext|>", "<|", "|>", "endoftext", " the", "\r\n"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
        assert fast.ids(text) == own.encode(text, add_special_tokens=False).ids


def test_packed_ids_are_those_of_the_library(spark):
    """Names of added tokens have their own ids; the expected ones don't come from this module."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "hello <|endoftext|> world", None), (2, "<|endoftext|>" * 3000, None), (3, "no special name: <|endoftext |>", None), (4, None, None)]
    ids = {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, _ in rows}
    assert ids[1].tolist() == [31373, 220, 50256, 995, 1]
    found = packing.pack_documents(documents(spark, rows)).collect()
    for r in found:
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()))
    assert sum(r.length for r in found) == sum(map(len, ids.values()))


def test_long_runs_of_white_space_have_ids(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    fast = packing.Encoder(path, packing.PROBES)
    assert fast._fast is not None
    texts = [" " * 1_500_000, "\n" * 1_500_000, "a b" + " \n\t\u00a0" * 400_000 + "c d"]
    expected = [own.encode(text, add_special_tokens=False).ids for text in texts]
    assert [fast.ids(text) for text in texts] == expected
    monkeypatch.setattr(packing, "LONG_RUN", 10**9)  # not seen beforehand: tiktoken fails, and tokenizers takes over
    assert [fast.ids(text) for text in texts] == expected
    assert fast.ids("and short ones after that") == own.encode("and short ones after that", add_special_tokens=False).ids


def test_packing_documents_of_white_space(spark):
    rows = [(1, " " * 1_500_000, None), (2, "\n" * 1_500_000, None), (3, "short", None)]
    encode = packing.encoder(packing.vocabulary_path("byte_bpe_50k.json")).ids
    ids = {i: np.array([*encode(t), 1], "<u4") for i, t, _ in rows}
    pieces = defaultdict(list)
    for r in packing.pack_documents(documents(spark, rows)).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(own.tobytes()) == r.ids_crc32
        pieces[r.doc_id].append(own)
    assert {i: sum(map(len, own)) for i, own in pieces.items()} == {i: len(own) for i, own in ids.items()}


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(10)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    item = text(20)
    rows = [(i, text(rng.randint(20, 60)), "en", "s", 1) for i in range(150)]
    rows += [(200 + i, text(40).upper().replace(" ", "!! "), "en", "s", 1) for i in range(60)]
    rows += [(300, rows[0][1], "en", "s", 1), (301, rows[1][1] + " one more", "en", "s", 1), (302, item, "en", "s", 1)]
    rows += [(303, text(30) + " a.b@c.de " + text(5), "en", "s", 1), (304, None, None, None, None), (305, "", None, None, None)]
    place = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in rows if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    docs = spark.read.parquet(f"{place}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, place).cache()
        seen.append((name, {r.doc_id for r in docs.collect()}))
        assert name == "packing" or docs.columns == columns
        if name == "PII":
            assert "<EMAIL>" in next(r.text for r in docs.collect() if r.doc_id == 303)
    good, first, clean, redacted, packed = (ids for _, ids in seen)
    labels = spark.read.parquet(f"{place}/labels.parquet")
    scored = quality.score_documents(spark.read.parquet(f"{place}/documents.parquet"), labels).collect()
    assert good == {r.doc_id for r in scored if r.predicted} and not good & set(range(200, 260))
    assert first == good - {300, 301} and clean == first - {302} and clean == redacted == packed
    assert {r.doc_id for r in corpus_pipeline.run(spark, place).collect()} == packed


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in corpus_queries.queries()} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names and set(corpus_queries.queries()) <= set(names)
    assert [near, decontaminate, pii, packing]


def test_scratch_tables_can_be_dropped(spark):
    import os

    from foliant.llm import tables

    kept = tables.stored(spark.range(3), "numbers")
    place = tables.shared_dir(spark).removeprefix("file://") + "/foliant"
    assert kept.count() == 3 and os.listdir(place)
    tables.drop_scratch(spark)
    assert not os.path.exists(place)


def test_lookup_and_components(spark):
    from foliant.llm import tables

    left = spark.createDataFrame([(7, i) for i in range(500)] + [(i, i) for i in range(20)], "k long, v long")
    right = spark.createDataFrame([(7, "hot", 501), (3, "x", 1), (99, "y", 0)], "k long, name string, n long")
    found = {(r.k, r.v): r.name for r in tables.lookup(left, right, "k", "n").collect()}
    assert len(found) == 519 and found[7, 3] == "hot" and found[3, 3] == "x" and found[4, 4] is None
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200), (102, 100)]
    rows = tables.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.comp for r in rows} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
