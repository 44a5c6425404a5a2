import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=True):
    """documents from (doc_id, text, lang, source), with extra columns whose names clash with results."""
    out = spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], SCHEMA)
    if not extra:
        return out
    from pyspark.sql import functions as F
    for name in ("size", "target", "copies", "n_words", "kept", "removed", "train", "score", "shard", "label", "ids"):
        out = out.withColumn(name, F.lit(7))
    return out


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty, white, very long, repeated and nearly repeated texts."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n", ","]) for _ in range(n))

    base = [prose(rng.randint(60, 200)) for _ in range(12)]
    passage = prose(40)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    for k in range(12, 30):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k, " ".join(t), "en", "s1"))
    rows += [(30 + k, f"{prose(50)}\n{passage}\n{prose(30)}", "de", None) for k in range(5)]
    rows += [(40, None, "en", "s2"), (41, "", None, "s2"), (42, " \n\t ", "en", None), (43, "one two three", "en", "s2"),
             (44, "One TWO three", "en", "s2"), (45, prose(30000), "en", "s0"), (46, "x" * 70000, "en", "s0"),
             (47, "ab " * 500, "en", "s0"), (48, "ab " * 500, "en", "s0"), (49, passage * 3, None, "s4"),
             (50, "漢字 🙂 " * 30, "zh", "s4"), (3, base[3], "en", "s0"), (None, base[5], "en", "s1"), (None, None, None, None)]
    return rows
