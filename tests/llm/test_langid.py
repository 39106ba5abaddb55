"""Language masks, counts and their correction against plain sets."""

import random

import numpy as np
import pytest

from loomgraph.llm import langid

MASK = (1 << 64) - 1


def plain_grams(text):
    """Runs of 3 and 4 characters of letters, with one space for whatever else, whose middle isn't a space."""
    folded = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    while "  " in folded:
        folded = folded.replace("  ", " ")
    return [folded[i : i + n] for n in (3, 4) for i in range(len(folded) - n + 1) if folded[i + n // 2] != " "]


def plain_key(gram):
    key = 0
    for c in gram:
        key = ((key ^ ord(c)) * 0x9E3779B97F4A7C15) & MASK
        key ^= key >> 29
    return key


def cells(key, count, probes):
    return [(((key * (2 * p + 1)) & MASK) ^ (key >> (17 + 5 * p))) % count for p in range(probes)]


def texts(seed, count=40):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeé ü1,.  \nÀß") for _ in range(rng.randint(0, 60))) for _ in range(count)] + ["", " ", "a", "ab", "12", "x" * 300]


def test_grams_same_as_plain():
    some = texts(1)
    keys, owner, letters = langid.grams(some)
    for i, t in enumerate(some):
        assert sorted(keys[owner == i].tolist()) == sorted(map(plain_key, plain_grams(t)))
        assert letters[i] == sum(c.isalpha() for c in t.lower())


@pytest.mark.parametrize("count", [512, 4096])
def test_decisions_same_as_plain(count):
    """With few cells there are many false positives, which the correction has to take off."""
    by_language = {lang: np.unique(langid.grams(texts(seed, 3))[0]) for lang, seed in (("aa", 2), ("bb", 3), ("cc", 4))}
    model = langid.GramFilter.build(by_language, cells=count, probes=3)
    held = {lang: {c for k in keys.tolist() for c in cells(k, count, 3)} for lang, keys in by_language.items()}
    rates = {lang: (len(held[lang]) / count) ** 3 for lang in held}
    assert np.allclose(model.false_rate, [rates[lang] for lang in model.languages])
    for i, lang in enumerate(model.languages):
        assert ((model.masks(by_language[lang])[:, 0] >> np.uint64(i)) & np.uint64(1) == 1).all()  # nothing inserted is missed
    some = texts(5)
    langs, scores = model.decide([*some, None])
    for t, lang, score in zip([*some, None], langs, scores, strict=True):
        found = [plain_key(g) for g in plain_grams(t or "")]
        hits = {x: sum(all(c in held[x] for c in cells(k, count, 3)) for k in found) for x in held}
        true = {x: max(0.0, (hits[x] - len(found) * rates[x]) / (1 - rates[x])) for x in held}
        if not any(c.isalpha() for c in (t or "").lower()):
            assert (lang, score) == ("und", 0.0)
        else:
            best = max(sorted(true), key=lambda x: true[x])
            assert true[lang] == pytest.approx(true[best]) and score == pytest.approx(true[best] / max(sum(true.values()), 1e-9))
