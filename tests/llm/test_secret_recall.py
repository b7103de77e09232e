"""The secret network finds keys that no pattern proves, of every alphabet and length, and little else."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescope.llm import secret_scan


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of words, numbers, paths and addresses, one in twelve with a proven secret."""
    rng = random.Random(21)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexes = secret_scan.ALPHABETS["hex"]
    syllables = ["an", "re", "tion", "ou", "sch", "en", "mi", "ar", "ent", "le", "ció", "ver"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 9)))

    def plain():
        return rng.choice(
            [word(), word(), word().upper(), draw("0123456789", rng.randint(2, 18)), f"/{word()}/{word()}/{word()}.html", f"mail{rng.randint(1, 9)}.{word()}.com",
             f"{word()}_{word()}_{word()}", f"{word()}-{word()}-{word()}", f"{word()}={word()}", "=" * rng.randint(16, 40)]
        )

    texts = []
    for i in range(6000):
        words = [plain() for _ in range(25)]
        if i % 12 == 0:
            words.insert(rng.randrange(25), rng.choice([f'token = "{draw(hexes, 40)}"', f"AKIA{draw(secret_scan.ALPHABETS['BASE36'], 16)}", f"password={draw(hexes, 18)}"]))
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    return texts, secret_scan.fit_secret_model(frame)


def test_keys_of_every_alphabet_and_length(corpus):
    texts, model = corpus
    rng = random.Random(5)
    assert all(min(r) > 0.9 for r in model.recall.values())
    for name, chars in secret_scan.ALPHABETS.items():
        for length in (16, 20, 24, 31, 40, 80):
            planted, places = [], []
            for _ in range(100):
                words = rng.choice(texts).split(" ")
                key = "".join(rng.choice(chars) for _ in range(length))
                words.insert(rng.randrange(len(words)), key)
                planted.append(" ".join(words))
                places.append(planted[-1].index(key))
            spans = secret_scan.scan_texts(planted, model)
            found = np.mean([any(s.start < a + length and s.end > a for s in got) for got, a in zip(spans, places, strict=True)])
            assert found >= 0.9, (name, length, found)


def test_little_else_is_found(corpus):
    texts, model = corpus
    clean = [t for i, t in enumerate(texts) if i % 12]
    wrong = sum(any(s.kind == "net" for s in spans) for spans in secret_scan.scan_texts(clean, model))
    assert wrong <= 0.001 * len(clean) * 25 / 10  # spans among candidates: some ten of a text's 25 words


def test_given_documents_are_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = secret_scan.fit_secret_model(docs)
    assert model is not None
    spans = secret_scan.find_secrets(docs, model).select(F.explode("spans").alias("s")).filter("s.kind = 'net'").count()
    assert spans <= 10
