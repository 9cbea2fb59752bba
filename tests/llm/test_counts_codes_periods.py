import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import codes, packing, periods, tokens

from .conftest import EDGES, LONG, documents


def piece_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=packing.vocabulary_path("piece_bpe_32k.model"))


def odd_texts(rng, n=400):
    parts = [" ", "  ", "   ", "▁", "\n", "\t", " ", "a", "the", "The quick", "é", "東京", "\U0001f600", "1234", "<s>", "</s>", "<unk>", "\x00", "...", "ing", "x" * 40, "ﬁ", "é"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_token_counts_are_those_of_whole_texts(spark):
    rng = random.Random(1)
    texts = odd_texts(rng) + ["", " ", "  ", " a", "a ", "a  ", "a b", "a  b", "▁ a", "a ▁b", "a▁ b", "\n \n", "word " * 30_000, "w" * 20_000, " " * 3000]
    model = piece_model()
    found = tokens.count_tokens(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(model.encode(t)) for i, t in enumerate(texts)}
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 4096) for r in found)
    assert {r.doc_id for r in found if r.over_limit} == {i for i, t in enumerate(texts) if len(model.encode(t)) > 4096} != set()


def test_segments_are_small_and_forgotten_counts_come_back(monkeypatch):
    count = tokens.SegmentCounter(packing.vocabulary_path("piece_bpe_32k.model"))
    assert count.segments("one two  three four ") == ["one", "two", " three", "four "]
    assert max(map(len, count.segments(LONG))) < 10
    monkeypatch.setattr(tokens, "KEPT_CHARS", 10)
    texts = odd_texts(random.Random(2), 50)
    for _ in range(2):
        assert count.counts(texts) == [len(piece_model().encode(t)) for t in texts]
    assert count.counts([]) == []


def test_batches_are_balanced():
    texts = ["x" * n for n in (3, 4, 50, 1, 1, 1, 9, 2)]
    made = list(tokens.balanced(texts, 10))
    assert [t for b in made for t in b] == texts
    assert all(sum(map(len, b)) <= 10 or len(b) == 1 for b in made)


def test_token_counts_of_edge_rows(spark, edge_docs, no_docs):
    model = piece_model()
    found = tokens.count_tokens(edge_docs).collect()
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, _ in EDGES]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert tokens.count_tokens(no_docs).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_of_json_vocabularies(spark, name):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.vocabulary_path(name))
    texts = odd_texts(random.Random(3), 60) + [LONG]
    found = tokens.count_tokens(documents(spark, [(i, t, None) for i, t in enumerate(texts)]), name).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(model.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """As the contract puts it, with Python's integers."""
    from math import floor, isfinite

    kept = [(i, [floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[i][p] for i in range(min(entries, len(kept)))] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[near(c[p], books[p])[1]].append(c[p])
            new.append([[sum(x) // len(own[e]) for x in zip(*own[e], strict=True)] if e in own else y for e, y in enumerate(books[p])])
        books = new
    out, totals = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut, strict=True):
        best = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        totals[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return sorted(((i, c, e, totals[label], digest) for i, c, e, label in out), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, key string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "k") for r in rows], VECTORS)


def some_vectors(rng, n, width=8):
    centres = rng.normal(size=(5, width))
    return [(int(i), [float(np.float32(x)) for x in centres[rng.integers(5)] + rng.normal(size=width) / 8], int(rng.integers(4)) or None) for i in rng.permutation(n)]


@pytest.mark.parametrize("n", [1, 3, 300, 700])
def test_codes_against_brute_force(spark, n):
    rows = some_vectors(np.random.default_rng(n), n)
    assert sorted(map(tuple, codes.compress(vectors(spark, rows)).collect()), key=repr) == brute_codes(rows)


def test_codes_of_edge_rows(spark):
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    good = some_vectors(rng, 40)
    same = [(i, [0.5] * 8, 3) for i in range(100, 400)]  # equal entries: ties
    bad = [(900, None, 1), (901, [None] + [0.0] * 7, 1), (902, [nan] + [0.0] * 7, 1), (903, [inf] + [0.0] * 7, 1), (904, [-inf] + [0.0] * 7, None)]
    odd = [(None, [1.0] * 8, None), (7, good[0][1], None), (7, good[1][1], 2), (7, good[1][1], 2), (8, [1000.0, -1000.0] * 4, 0)]
    rows = good + same + bad + odd
    assert sorted(map(tuple, codes.compress(vectors(spark, rows)).collect()), key=repr) == brute_codes(rows)
    assert codes.compress(vectors(spark, bad)).collect() == []
    assert codes.compress(vectors(spark, [])).collect() == []
    with pytest.raises(ValueError):
        codes.compress(vectors(spark, rows), entries=257)
    with pytest.raises(Exception, match="components"):
        codes.compress(vectors(spark, [(1, [1.0] * 8, 0), (2, [1.0] * 12, 0)]))
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(vectors(spark, [(1, [1.0] * 9, 0)]))


def test_slices_find_the_box_and_the_nearest():
    rng = np.random.default_rng(6)
    for n, width in ((1, 1), (64, 3), (65, 16), (256, 16), (200, 2)):
        book = rng.integers(-20, 20, (n, width))
        book[n // 2 :] = book[: n - n // 2]  # every entry twice
        found = codes.Slices(book)
        points = rng.integers(-200, 200, (50, width))
        radius = rng.integers(0, 150, 50)
        row, entry = found.inside(points, radius)
        inside = (np.abs(points[:, None] - book[None]) <= radius[:, None, None]).all(2)
        assert list(zip(row.tolist(), entry.tolist(), strict=True)) == [tuple(x) for x in np.argwhere(inside).tolist()]
        apart = ((points[:, None] - book[None]) ** 2).sum(2)
        code, best = found.nearest(points)
        assert (code == apart.argmin(1)).all() and (best == apart.min(1)).all()


def brute_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        begin = q
        for i in range(q, n + 1):
            if i == n or words[i] != words[i - q]:
                if i - begin + q >= max(6, 4 * q) and i > begin:
                    out.setdefault((begin - q, i - begin + q), q)
                begin = i + 1
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def odd_words(rng, n):
    kind = rng.randint(0, 4)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a" if rng.random() < 0.95 else "b" for _ in range(n)]
    if kind == 2:
        out = []
        while len(out) < n:
            piece = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
            out += piece * rng.randint(1, 6) + [rng.choice("abc")] * rng.randint(0, 2)
        return out[:n]
    if kind == 3:
        a, b = ["a"], ["a", "b"]  # a Fibonacci word, some of it twice
        while len(b) < n:
            a, b = b, b + a
        return (b * 3)[:n]
    return [rng.choice("abcdefgh") for _ in range(n)]


def test_periodic_runs_against_brute_force():
    rng = random.Random(7)
    for _ in range(1500):
        words = odd_words(rng, rng.randint(0, 90))
        assert periods.periodic_runs(np.array([ord(w) for w in words], np.int64)) == brute_runs(words), words
    for n in (500, 1200):
        for _ in range(4):
            words = odd_words(rng, n)
            assert periods.periodic_runs(np.array([ord(w) for w in words], np.int64)) == brute_runs(words)


def test_a_text_of_one_word_is_not_quadratic():
    n = 1_000_000
    assert periods.periodic_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    block = np.r_[np.zeros(1000, np.int64), 1]
    runs = periods.periodic_runs(np.tile(block, 200))
    assert (0, 1001 * 200, 1001) in runs and len(runs) == 201


def brute_document(doc_id, text):
    from fractions import Fraction

    words = [w for w in (text or "").encode().split()]
    if doc_id is not None and words:
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = (None,) * 4
    if runs:
        s, length, q = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = (s, length, q, 1000 * length // q)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_document_runs(spark, edge_docs, no_docs):
    rng = random.Random(8)
    texts = [" ".join(odd_words(rng, rng.randint(0, 120))) for _ in range(300)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(-5, "a \x0b\x0cb\r\na\tb a b a b a b", None), (None, "x " * 9, None)]
    found = periods.document_runs(documents(spark, rows)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((brute_document(i, t) for i, t, _ in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(300))
    short = [e for e in EDGES if e[0] != 4]
    found = periods.document_runs(edge_docs.filter("doc_id is null or doc_id <> 4")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((brute_document(i, t) for i, t, _ in short), key=repr)
    long = periods.document_runs(edge_docs.filter("doc_id = 4")).first()
    assert zlib.crc32(b"4") % 10 and (long.n_runs, long.start, long.length, long.period) == (1, 0, 40_000, 1)
    assert long.collapsed_sha256 == hashlib.sha256(b"word end").hexdigest()
    assert periods.document_runs(no_docs).collect() == []


def test_columns_keep_their_types(spark):
    docs = spark.createDataFrame([("a", "x y z"), (None, None)], "doc_id string, text string")
    assert dict(tokens.count_tokens(docs).dtypes)["doc_id"] == dict(periods.document_runs(docs).dtypes)["doc_id"] == "string"
    assert periods.document_runs(docs).filter(F.col("n_runs") == 0).count() == 2
