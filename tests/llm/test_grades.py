"""Grades of toxic rows don't follow features that are typical of clean rows."""

import random

import numpy as np

from tidemark.llm import toxicity


def test_clean_features_raise_no_grade():
    rng = random.Random(5)
    clean, vile, plain = [f"good{i}" for i in range(8)], [f"vile{i}" for i in range(6)], [f"w{i}" for i in range(400)]
    texts, toxic = [], []
    for i in range(300):
        texts.append([*rng.sample(clean, 6), *rng.sample(plain, 150)])
        toxic.append(False)
    for i in range(60):  # long and mild: many features of clean rows, two vile words
        texts.append([*rng.sample(clean, 2), *rng.sample(plain, 150), *rng.sample(vile, 2)])
        toxic.append(True)
    for i in range(60):  # short and vile
        texts.append([*rng.sample(plain, 4), *rng.sample(vile, 4)])
        toxic.append(True)
    of = [toxicity.words(" ".join(t)) for t in texts]
    # Only whole words as features, so that the words of a kind are told apart.
    rows = [np.array(sorted(toxicity.features(w)[0] for w in ws), np.int64) for ws in of]
    grades = toxicity.held_out_grades(rows, np.array(toxic), 4)
    assert not grades[:300].any()
    assert grades[300:360].max() <= grades[360:].min() and grades[300:360].mean() + 0.8 < grades[360:].mean()
