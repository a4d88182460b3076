from __future__ import annotations

import random

import pytest

WORDS = ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "ñandú", "Äpfel", "the", "of", "and", "xylo"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, bucket int, keys binary, n_words string, row long"


def passage(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "en", "ing", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): ordinary texts, copies, near copies, shared passages and lines, and odd ones."""
    rng = random.Random(7)
    shared, line = passage(rng, 90), "A line that many documents hold."
    out = []
    for i in range(40):
        body = [passage(rng, rng.randint(5, 150)) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            body.insert(rng.randint(0, len(body)), shared)
        if i % 2 == 0:
            body.insert(rng.randint(0, len(body)), rng.choice(["", "  "]) + rng.choice([line, line.upper(), line + "\t"]))
        out.append((i, "\n".join(body)))
    base = passage(rng, 160).split()
    for i in range(40, 60):  # near copies, each with other words changed
        own = list(base)
        for _ in range(i % 7):
            own[rng.randrange(len(own))] = f"w{rng.randint(0, 999)}"
        out.append((i, " ".join(own)))
    out += [(60 + i, out[3][1]) for i in range(6)]
    period = "ab " * 400
    out += [(70, None), (71, ""), (72, " \n\t "), (73, "one two"), (74, "one two"), (75, period), (76, "z" * 1500), (77, " " * 900), (78, "\n\n\n"), (None, "no id here at all"), (None, "no id here at all")]
    out += [out[0], out[0], out[45], (79, "0" * 400 + "x"), (80, "y" + "0" * 400), (81, "0" * 399)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][k % 3], "src0", None if t is None else len(t), k, k, b"x", "n", k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
