import hashlib
import math
import random
import re
import time

import numpy as np
import pytest

from foliant.llm import decontaminate, language, pii, quality

from .conftest import documents

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


BITS = [
    "a@b.c", "_d@e.f.g", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "+1 (555) 555-1234", "4539 1488 0343 6467", "4539148803436467", "é",
    "\U0001f600", ".", "@", "+", " ", "x", "000255.0.0.1", "1-1 1", "foo.bar%baz@x-y.co.uk", "\n", "+12345678901234567", "-", "0", "9",
]


def test_base_spans_against_python(spark, no_docs):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))), None) for i in range(600)]
    rows += [(9001, None, None), (9002, "", None), (9003, "a" * 20_000 + "@" + "b" * 20_000 + ".c", None), (None, "a@b.c", None)]
    rows += [(9004, "1 " * 30_000, None), (9005, "same@mail.org", None), (9005, "same@mail.org", None)]
    rows += [(9100 + i, "".join(rng.choice(BITS) for _ in range(n)), None) for i, n in enumerate((500, 1500, 4000))]  # more than a block of matches
    texts = {i: t for i, t, _ in rows}
    found = pii.find_personal_data(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        expected = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest(), texts[r.doc_id]
        assert set(filter(None, expected.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [expected.count(k + ":") for k in BASE]
    assert pii.find_personal_data(no_docs).collect() == []


def test_method_adds_spans_and_redacts(spark):
    rows = [(i, f"please call me: (415) 555-{1000 + i} or write to jo{i} (at) mail (dot) org today", None) for i in range(40)]
    rows += [(100 + i, f"order 123 456 {1000 + i} and part no. 212-345-{2000 + i}/7", None) for i in range(40)]
    rows += [(999, "mail a.b@c.de, +1 415 555 1234. fin", None)]
    docs = documents(spark, rows)
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    good = sum("phone" in spans[i] for i in range(40))
    assert good == 40 and not any(spans[100 + i] for i in range(40))
    clean = {r.doc_id: r for r in pii.redact_documents(docs).collect()}
    assert clean[999].text == "mail <EMAIL>, <PHONE>. fin" and clean[999].n_chars == len(clean[999].text)
    assert clean[101].text == dict((i, t) for i, t, _ in rows)[101]


FORMS = [
    ("cards 4539148803436467 4539148803436467 both", ["card:6:22", "card:23:39"]),  # together no base match passes
    ("card 4539.1488.0343.6467 here", ["card:5:24"]),
    ("the server address 10[.]20[.]30[.]44 again", ["ip:19:36"]),
    ("write to jo.x @ mail.example.org today", ["email:9:32"]),
    ("mail jo at mail dot example dot org now", ["email:5:35"]),
    ("telefon 030/1234567 abends", ["phone:8:19"]),
    ("appel 01 23 45 67 89 demain", ["phone:6:20"]),
    ("card 4539.1488.0343.6468 here", []),  # fails the checksum
    ("invoice no. 10.20.30.444 paid", []),
    ("release 1 . 2 . 3 . 4", []),
    ("look at the dot and go", []),
]


def test_added_spans_of_every_kind(spark):
    rows = [(1000 * k + i, t, None) for k, (t, _) in enumerate(FORMS) for i in range(20)]
    rows += [(90_000 + i, f"mail m{i}@mail.org, call +1 415 555 {1000 + i}, host 10.2.3.{i}, card 4539 1488 0343 6467.", None) for i in range(60)]
    found = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.find_personal_data(documents(spark, rows)).collect()}
    got = [sorted(found[1000 * k]) for k in range(len(FORMS))]
    assert got == [sorted(e) for _, e in FORMS]


def test_many_spans_in_one_text(spark):
    """Redaction is in order, block by block, and linear in the spans."""
    rng = random.Random(12)
    text = "".join(rng.choice(BITS) for _ in range(3000)) + "tail"
    many = " ".join(f"m{i}@mail.org" for i in range(40_000))
    docs = documents(spark, [(1, text, None), (2, many, None), (3, None, None), (4, "", None), (None, "none", None), (None, "none", None)])
    began = time.time()
    out = {r.doc_id: r.text for r in pii.redact_documents(docs).collect()}
    assert time.time() - began < 60
    spans = next(r for r in pii.find_spans(docs).collect() if r.doc_id == 1).spans
    assert len(spans) > 200
    at, expected = 0, []
    for s in spans:
        if s["start"] >= at:
            expected += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    assert out[1] == "".join(expected) + text[at:]
    assert out[2] == " ".join(["<EMAIL>"] * 40_000) and out[3] is None and out[4] == "" and out[None] == "none"
    assert pii.redact_documents(documents(spark, [])).collect() == []


def test_label_model_learns_who_is_right():
    rng = random.Random(7)
    counts = {}
    for _ in range(5000):
        truth = rng.random() < 0.4
        votes = tuple((1 if (truth if rng.random() < p else not truth) else -1) if rng.random() < 0.8 else 0 for p in (0.95, 0.9, 0.85, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    posterior, prior, right = pii.label_model(sorted(counts.items()))
    assert abs(prior - 0.4) < 0.05 and right[0][0] > right[3][0] and right[0][0] > 0.9
    assert posterior[(1, 1, 1, 1)] > 0.95 and posterior[(-1, -1, -1, -1)] < 0.05


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items, window=13):
    own, hit, found = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        n = min(len(w), window)
        wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(own) - n + 1):
            if n and tuple(own[i : i + n]) in wanted:
                hit |= set(range(i, i + n))
                found.add("" if item_id is None else str(item_id))
    ids = ",".join(sorted(found))
    bad = len(hit) > 0 and 20 * len(hit) >= len(own)
    return len(own), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bad


def benchmark_and_docs():
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["al", "be", "ga", "de", "ep", "ze"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 5, 12, 13, 14, 30]))) for i in range(14)]
    items += [(90, "ab, ab-ab ab. " * 9), (91, None), (92, ""), (None, "Zz Yy Xx"), (93, items[8][1]), (93, "one two three four five")]
    rows = []
    for i in range(60):
        part = words(rng.choice(items)[1])
        cut = rng.randint(0, len(part))
        rows.append((i, f"{text(rng.randint(0, 40))}. {' '.join(part[:cut])} {' '.join(part)} {text(rng.randint(0, 40))}", None))
    return items, [*rows, (100, None, None), (101, "", None), (102, "Ab ab " * 300, None), (None, "zz,YY;xx", None), (103, "Q", None), (103, "Q", None)]


@pytest.mark.parametrize("limit", [200_000, 40])
def test_decontamination_against_every_window(spark, no_docs, limit):
    items, rows = benchmark_and_docs()
    texts = {i: t for i, t, _ in rows}
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    found = decontaminate.contamination(docs, bench, broadcast_rows=limit).drop("h").collect()
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r)[1:] == brute_hits(texts[r.doc_id], items)[:4], texts[r.doc_id]
    kept = decontaminate.drop_contaminated(docs, bench).collect()
    assert sorted((r.doc_id or -1) for r in kept) == sorted((i or -1) if i is not None else -1 for i, t, _ in rows if not brute_hits(t, items)[4])
    assert decontaminate.decontaminate_documents(no_docs, bench).collect() == []
    assert {r.n_hit for r in decontaminate.decontaminate_documents(docs, bench.limit(0)).collect()} == {0}


def labelled(n):
    rng = random.Random(3)
    for i in range(n):
        good = rng.random() < 0.7
        own = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        if not good:
            own = rng.choice([[w.upper() + "!!" for w in own], [w + " |" for w in own], own[:1] * len(own), [w + "%%%" for w in own]])
        yield i, " ".join(own) + ".", int(good)


def test_quality_on_held_out_rows(spark, edge_docs, no_docs):
    rows = [*labelled(600)]
    docs = documents(spark, [(i, t, None) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    truth = {i: q for i, _, q in rows}
    found = quality.score_documents(docs, labels).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in found if r.predicted}
    assert len(quality.score_documents(edge_docs, labels).collect()) == edge_docs.count()
    assert quality.score_documents(no_docs, labels.limit(0)).collect() == []


def test_every_labelled_row_teaches_quality(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROWS_PER_CELL", 40)
    rows = labelled(300)
    features = quality.with_features(documents(spark, [(i, t, None) for i, t, _ in rows])).cache()
    labels = spark.createDataFrame([(i, q if i % 7 else 1) for i, _, q in rows], "doc_id long, quality int")
    whole, part = quality.train(features, labels), quality.train(features, labels, max_labelled=40)
    assert np.allclose(whole.weights, part.weights, rtol=1e-4, atol=1e-6) and math.isclose(whole.threshold, part.threshold, rel_tol=1e-4, abs_tol=1e-6)


def test_quality_by_all_pairs(spark):
    rng = np.random.default_rng(2)
    x, label = rng.normal(size=(90, len(quality.FEATURES))), (rng.random(90) < 0.7).astype(int)
    ids = [i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 5][:90]
    features = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x, strict=True)], "doc_id long, features array<double>")
    found = quality.train(features, spark.createDataFrame(list(zip(ids, label.tolist(), strict=True)), "doc_id long, quality int"))
    z = x / x.std(axis=0)
    diff = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, x.shape[1])
    w, per = np.zeros(x.shape[1]), 60_000 / len(diff)
    for _ in range(30):
        p = 1 / (1 + np.exp(diff @ w))
        w -= np.linalg.solve(per * (diff.T * (p * (1 - p))) @ diff + np.eye(len(w)), w - per * diff.T @ p)
    latent, bad = np.sort(z @ w), int((label == 0).sum())
    assert np.allclose(found.weights, w / x.std(axis=0), atol=1e-6) and math.isclose(found.threshold, (latent[bad - 1] + latent[bad]) / 2, abs_tol=1e-6)
    values = spark.createDataFrame([(v,) for v in [3.0, 1.0, 1.0, 2.0, 9.0]], "value double")
    assert [quality.middle(values, k, 2) for k in (1, 2, 3, 4, 5)] == [1.0, 1.5, 2.5, 6.0, 9.0]


def test_one_label_ranks_nothing():
    ranker = quality.fit(np.ones((4, len(quality.FEATURES))), np.ones(4, int))
    assert set(ranker.weights) == {0.0} and math.isclose(ranker.threshold, math.log(0.3 / 0.7))


def test_language_on_held_out_rows(spark, edge_docs, no_docs):
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "tion", "and"], "de": ["sch", "ung", "keit", "ü"], "fr": ["eau", "ç", "ment", "que"]}
    rows = []
    for i in range(400):
        lang = rng.choice([*parts])
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang))
    found = language.identify_documents(documents(spark, rows)).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in found if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    edges = {r.doc_id: r for r in language.identify_documents(edge_docs).collect()}
    assert all(edges[i].lang_pred == "und" and edges[i].score == 0 for i in (1, 2, 3, 9))
    assert language.identify_documents(no_docs).collect() == []


def plain_prediction(text, model):
    """predict() for one text, n-gram by n-gram."""
    low = (text or "").lower()
    if not any(c.isalpha() for c in low):
        return "und", 0.0
    low = "  " + low + "  "
    runs = [m.span() for m in re.finditer(r"(?:[0-9]|[^\W\d_])+", low)]
    spoilt = {k for a, b in runs if re.search("[0-9]", low[a:b]) for k in range(a, b)}
    codes = [ord(c) if c.isalpha() and k not in spoilt else 32 for k, c in enumerate(low)] + [32, 32]
    totals, mask = [0] * len(model.languages), (1 << 64) - 1
    for p in range(len(low)):
        key = 0
        for n in range(3):
            key = (key * 0x100000001B3 + codes[p + n] + 1) & mask
            gram = (((key ^ key >> 29) * 0x9E3779B97F4A7C15) & mask) >> (64 - language.BITS)
            for j in range(len(totals)):
                totals[j] += round(float(model.idf[gram] * model.weights[gram, j] * language.PER * language.ONE))
    logits = [t / language.ONE / (3 * len(low)) + b for t, b in zip(totals, model.bias, strict=True)]
    e = [math.exp((x - max(logits)) / model.temperature) for x in logits]
    best = e.index(max(e))
    return model.languages[best], e[best] / sum(e)


def test_predictions_depend_on_their_own_text_alone(spark):
    rng = np.random.default_rng(3)
    weights = np.where(rng.random((1 << language.BITS, 3)) < 0.5, rng.normal(size=(1 << language.BITS, 3)), 0.0)
    model = language.Model(["de", "en", "fr"], 1 + rng.random(1 << language.BITS), weights, np.array([0.1, -0.1, 0.0]), 0.7)
    letters = [*"abc  d\t1é.ß中", "ok", "x9"]
    texts = ["ok", "", None, "a", "zz top", "12", "ab" * 9000] + ["".join(rng.choice(letters) for _ in range(rng.integers(0, 60))) for _ in range(150)]
    expected = {k: plain_prediction(t, model) for k, t in enumerate(texts)}
    rows = list(enumerate(texts))
    seen = []
    for part, order in ((1, rows), (1, rows[::-1]), (7, rows)):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(part)
        seen.append({r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()})
    assert seen[0] == seen[1] == seen[2]
    for k, (name, score) in expected.items():
        assert seen[0][k][0] == name and math.isclose(seen[0][k][1], score, rel_tol=1e-9), texts[k]
    assert all(np.array_equal(a[:4], b[:4]) for a, b in zip(language.grams(["ok", "x"])[0], language.grams(["ok", "y"])[0], strict=True))


def test_temperature_and_sparsity():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(2000, 3))
    labels = np.array([rng.choice(3, p=language._softmax(x / 2.0)) for x in logits])
    assert abs(language.calibrate(logits, labels) - 2.0) < 0.35
    rows = [(i % 2, np.array([i % 2, 5]), np.array([1.0, 1.0])) for i in range(200)]
    weights, _ = language.follow_the_leader(rows, 2)
    assert weights[0, 0] > 0 > weights[0, 1] and np.count_nonzero(weights.any(axis=1)) <= 3
