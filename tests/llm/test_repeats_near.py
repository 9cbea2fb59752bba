import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from foliant.llm import near, repeats

from .conftest import documents


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        kept = bytes(c for c, x in zip(raw, gone, strict=True) if not x)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé d") for _ in range(rng.randint(50, 400))) for _ in range(12)]
    for i in range(n):
        text = "".join(rng.choice(base)[rng.randint(0, 30) : rng.randint(60, 400)] for _ in range(rng.randint(0, 6)))
        yield i, text + "a" * rng.choice([0, 0, 99, 100, 300]) + "ab" * rng.choice([0, 0, 150])


@pytest.mark.parametrize("most,batch", [(50_000, 4096), (3, 5), (1, 1)])
def test_repeats_by_every_path(spark, monkeypatch, most, batch):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    monkeypatch.setattr(repeats, "BATCH", batch)
    rows = [*passages(5, 80), (1001, None), (1002, ""), (1003, "x" * 99), (1004, "x" * 100), (1005, "y" * 101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect())) == brute_repeats(rows)


def test_repeats_of_long_texts_across_pieces(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_300_000))
    rows = [(1, long), (2, "zz" + long[1_048_400:1_048_700] + "qq"), (3, long[2_097_000:2_097_400])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).collect()}
    assert found == {1: (0, 0), 2: (300, 1), 3: (400, 1)}


def test_repeats_edges(edge_docs, no_docs):
    rows = repeats.remove_repeats(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert repeats.remove_repeats(no_docs).collect() == []


def test_repeats_of_rows_without_ids_and_of_repeated_ids(spark):
    """Rows of one id are ordered by the hash of the text; equal rows are one document."""
    rng = random.Random(7)
    base = ["".join(rng.choice("abcd ") for _ in range(150)) for _ in range(30)]
    made = ["".join(rng.choice(base)[: rng.randint(90, 150)] for _ in range(rng.randint(1, 3))) for _ in range(2000)]
    rows = [(None if k < 1600 else k % 7, t) for k, t in enumerate(made)]
    rows += rng.choices(rows, k=150) + [(3, None), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text or "": r.h for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) h").collect()}
    ordered = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    found = dict(zip(ordered, brute_repeats(ordered), strict=True))
    expected = [found[i, t or ""] for i, t in rows]
    by = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect()), key=by) == sorted(expected, key=by)


def test_common_prefixes_come_from_the_order():
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    parts = [p + q for p in parts[:5] for q in parts]
    first = np.array([0, 1, 2, 50, 400, len(parts)])
    end = np.cumsum([len(p) for p in parts])
    begin = np.concatenate([[0], end[:-1]])
    s = repeats.Suffixes(np.frombuffer(b"".join(parts), np.uint8), begin, begin, end)
    expected = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        for p in parts[a:b]:
            expected.append(next((k for k in range(min(len(p), len(parts[a]))) if p[k] != parts[a][k]), min(len(p), len(parts[a]))))
    assert repeats.shared_prefixes(s, first).tolist() == expected


def test_a_false_claim_removes_nothing(monkeypatch):
    cell = b"c" * 1100
    row = lambda text, at: (1, 2, 0, 1, 9, 9, 40, at, text)
    rows = [row(b"c" * 300, 5), row(b"c" * 150 + b"d" + b"c" * 149, 5), row(b"d" * 200, 7)]
    found = repeats._sorted_copies([cell], [0, 0, 0], rows).to_pydict()
    assert sorted(zip(found["low"], found["high"], strict=True)) == [(40, 90), (40, 240)]


def test_suffix_sort_is_a_sort():
    rng = random.Random(3)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(400)).encode(), np.uint8)
    start = np.arange(0, 390)
    s = repeats.Suffixes(data, np.zeros(390, np.int64), start, np.full(390, 400))
    order = s.sort(np.array([0, 390]))
    raw = data.tobytes()
    assert [raw[k:] for k in order] == sorted(raw[k:400] for k in start)
    back = s.sort(np.array([0, 390]), left=True)
    assert [raw[:k][::-1] for k in back] == sorted(raw[:k][::-1] for k in start)


def test_hash_collisions_are_found_on_the_bytes(monkeypatch):
    monkeypatch.setattr(repeats.Suffixes, "_equal", lambda self, a, b, n: np.ones(len(a), bool))
    a, b = b"x" * 40 + b"q" * 140, b"y" * 40 + b"q" * 139 + b"r"
    s = repeats.Suffixes(np.frombuffer(a + b, np.uint8), np.array([0, 180]), np.array([60, 240]), np.array([180, 360]))
    left, right = repeats._verified(s, np.array([0]), np.array([1]), np.array([60]), np.array([120]))
    assert (left[0], right[0]) == (20, 119)


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b in range(a):
            common = len(s & sets[b][1])
            if common and 100 * common >= 75 * (len(s) + len(sets[b][1]) - common):
                up[root(a)] = root(b)
    least = defaultdict(lambda: 1 << 62)
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least[root(k)], i)
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets))


def families(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(40))
    i = 0
    for _ in range(8):
        words = [word() for _ in range(rng.randint(1, 150))]
        for _ in range(rng.randint(1, 14)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            yield i, " ".join(own) + (" " + passage if rng.random() < 0.3 else "")
            i += 1


@pytest.mark.parametrize("group", [1024, 3])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(near, "GROUP", group)
    rows = [*families(1), (501, None), (502, ""), (503, " \n"), (504, "x y"), (505, "X  Y"), (506, "w " * 20_000)]
    docs = documents(spark, [(i, t, None) for i, t in rows])
    assert sorted(map(tuple, near.near_duplicates(docs).collect())) == brute_components(rows)


def test_sets_whose_numbers_clash(spark, monkeypatch):
    """With numbers of three bits nearly all sets clash and are renamed."""
    monkeypatch.setattr(near, "_node", lambda signature, renamed: renamed.get(signature) or signature[0] & 7)
    rows = [*families(3)]
    docs = documents(spark, [(i, t, None) for i, t in rows])
    assert sorted(map(tuple, near.near_duplicates(docs).collect())) == brute_components(rows)


def test_lists_end_where_sizes_allow_no_link(spark):
    rows = [(7, n, int(near.what(size, 1, 1))) for n, size in ((1, 40), (2, 50), (3, 60), (4, 90), (5, 200), (6, 266), (7, 266))]
    rows += [(8, 1, int(near.what(40, 1, 1))), (8, 4, int(near.what(90, 1, 1)))]
    found = near.shared_postings(spark.createDataFrame(rows, "token long, node long, what long"), 2).collect()
    assert sorted((r.token, r.node, r.leader) for r in found) == [(7, 1, 1), (7, 2, 1), (7, 3, 1), (7, 5, 5), (7, 6, 5), (7, 7, 5)]


def test_names_of_columns_do_not_clash(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, [(1, "a b c d e f g", None), (2, "a b c d e f g", None), (2, "a b c d e f g", None), (3, "else", None)])
    for name in ("later", "rows", "component_id", "n_shingles", "id", "v", "leader", "first", "copies", "comp", "least"):
        docs = docs.withColumn(name, F.lit(5))
    left = near.keep_first(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_keep_first(spark, edge_docs, no_docs):
    rows = [*families(2)]
    docs = documents(spark, [(i, t, None) for i, t in rows])
    kept = sorted(r.doc_id for r in near.keep_first(docs).collect())
    assert kept == sorted({c for _, _, c in brute_components(rows)})
    left = near.keep_first(edge_docs)
    assert left.columns == edge_docs.columns
    found = sorted((r.doc_id or 0) for r in left.collect())
    assert found == [0, 1, 2, 3, 4, 5, 8, 9, 10]
    assert near.near_duplicates(no_docs).collect() == [] and near.keep_first(no_docs).collect() == []


def test_prefix_lemma():
    rng = random.Random(4)
    for _ in range(300):
        universe = np.array(sorted(rng.sample(range(10**6), 60)), np.uint64) << np.uint64(30)
        a = np.sort(rng.sample(universe.tolist(), rng.randint(1, 40))).astype(np.uint64)
        b = np.unique(np.array([x if rng.random() < 0.9 else rng.randrange(2**60) for x in a.tolist()], np.uint64))
        weight = {x: rng.randint(1, 50) for x in np.concatenate([a, b]).tolist()}
        (p, pl, m), (q, ql, n) = (near.adaptive_prefix(s, np.array([float(weight[x]) for x in s.tolist()])) for s in (a, b))
        common = len(set(a.tolist()) & set(b.tolist()))
        if 4 * common >= 3 * (len(a) + len(b) - common):
            need = min(m, n)
            assert len(set(p[pl <= need].tolist()) & set(q[ql <= need].tolist())) >= need
