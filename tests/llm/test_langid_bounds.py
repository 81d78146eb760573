"""What the language classifier holds is bounded over all languages, and no text is
dealt by its language."""
import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from cartwise.llm import langid


def language(k, r):
    """Words of a language: its own syllables of letters, some beyond ASCII."""
    own = random.Random(k)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèçñøåλδяжш"
    syllables = ["".join(own.choice(letters) for _ in range(own.randint(2, 3))) for _ in range(60)]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
                    for _ in range(700))[:langid.STRETCH].encode()


def test_a_hundred_languages(spark):
    """Arrays of the fit: far below the driver's memory; each language is told."""
    r = random.Random(1)
    n = 100
    per = langid.ROWS // n
    pieces = [[language(k, r) for _ in range(3)] for k in range(n) for _ in range(per // 6)]
    langs = [f"l{k:03d}" for k in range(n) for _ in range(per // 6)]
    tracemalloc.start()
    model = langid.train(pieces, langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600e6
    assert len(model.landmarks) <= langid.LANDMARKS
    assert model.landmarks.nbytes + model.weights.nbytes + model.index.nbytes < 250e6
    texts = [language(k, r) for k in range(n)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    best, _ = model.scores(data, ends)
    assert np.mean([model.langs[b] == f"l{k:03d}" for k, b in enumerate(best)]) >= 0.98


def test_landmarks_of_many_languages():
    for n in (1, 4, 8, 100, 400, 401, 3000):
        y = np.repeat(np.arange(n), 60)
        marks = langid.landmark_places(y, n)
        assert len(marks) == len(set(marks)) <= langid.LANDMARKS
        assert len(set(y[marks])) == min(n, langid.LANDMARKS)
    assert len(langid.landmark_places(np.repeat(np.arange(4), 1500), 4)) == 4 * 48


def test_a_hot_language_is_not_dealt_by_language(spark, monkeypatch):
    """The only exchange of texts' stretches comes after the draw."""
    seen = []
    real = langid.trained_on
    monkeypatch.setattr(langid, "trained_on", lambda c: seen.append(1) or real(c))
    df = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("lang"),
        F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"))
    pieces, langs = langid.training_rows(df, "text", "lang", "doc_id", 50)
    assert seen and langs.count("a") == langs.count("b") == 50
    assert all(len(p) == 1 for p in pieces)
