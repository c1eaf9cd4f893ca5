"""Documents with every odd case, beside ordinary ones."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, band long, c0 int, place int"


def sentence(rng, n, words=None):
    return " ".join(rng.choice(words or ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(40)) for _ in range(n))


def odd_documents():
    """Rows with columns whose names clash with those that operators make."""
    rng = random.Random(3)
    base = sentence(rng, 120)
    near = base.replace(base.split()[60], "changed", 1)
    long = "\n".join(sentence(rng, 200) for _ in range(60))
    texts = [base, base, near, near + " tail", long, "", None, " \n\t ", "one two", "one two", "Über weiß 中文 \U0001f600 ▁mark", "a" * 60_000, "x\ty\x0bz\x0cw\rv", *(sentence(rng, 80) for _ in range(12))]
    rows = [(i, t, None if i == 3 else "en", None if i % 7 == 6 else f"src{i % 4}", len(t or ""), f"x{i}", i, None, i) for i, t in enumerate(texts)]
    rows.append((None, "no id at all " * 20, "en", "src0", 5, None, None, 1, None))
    rows.append(rows[0])
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
