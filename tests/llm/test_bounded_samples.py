"""However often a row is repeated, what reaches the driver for training stays bounded."""

import numpy as np

from foliant.llm import language, quality

from .conftest import documents


def test_a_labelled_id_teaches_once(spark, monkeypatch):
    seen = []
    real = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, label, cut: seen.append(len(x)) or real(x, label, cut))
    ids = [i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 5]
    rows = [(i, f"some words of text number {i} " * (i % 7 + 1), None) for i in ids] + [(ids[0], f"another text {k}", None) for k in range(500)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    quality.score_documents(documents(spark, rows), labels).collect()
    quality.score_documents(documents(spark, rows), labels, max_labelled=40).collect()
    assert seen[0] == len(ids) and seen[1] < 80


def test_a_repeated_row_teaches_once(spark, monkeypatch):
    seen = []
    real = language.follow_the_leader
    monkeypatch.setattr(language, "follow_the_leader", lambda rows, k: seen.append(len(rows)) or real(rows, k))
    rows = [(i, f"the words of english text {i}" if i % 2 else f"les mots du texte {i}", "en" if i % 2 else "fr") for i in range(100)]
    model = language.train(documents(spark, rows + rows[:1] * 3000))
    assert seen[0] <= 100 and model.languages == ["en", "fr"] and np.isfinite(model.weights).all()
