"""Small documents that hold the awkward cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept string, class string, key string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "of", "the", "Éclair", "übung", "x1", "end."]) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


def documents(spark, seed=1):
    """Nulls, empty and white texts, repeats, near copies, a long text, and columns whose names clash."""
    rng = random.Random(seed)
    base = words(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [base, " ".join(near), base, None, "", " \n\t ", "one two three", "One two\tthree", words(rng, 300) + "\n" + words(rng, 40), words(rng, 6000), base.upper(), "x" * 5000, "😀 " * 30, base + " tail"]
    texts += [words(rng, rng.randint(1, 60)) for _ in range(20)]
    rows = [(100 - i, t, ["en", "fr", None][i % 3], "s", "w", "k", "c", "q") for i, t in enumerate(texts)]
    rows += [(None, base, "en", "s", "w", "k", "c", "q"), (None, "alone here with five words", "en", "s", "w", "k", "c", "q"), (7, words(rng, 30), "en", "s", "w", "k", "c", "q")]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
