from __future__ import annotations

import random

import pytest

# Names that operators use inside, as extra columns of the input.
CLASHING = ["row", "key", "hash", "kept", "text_sha256", "doc", "words", "size", "label", "start", "runs", "found", "a b", "row.text", "c.d"]

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, extra=True):
        """``rows``: (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(*r, None, None)[:4] for r in rows]
        names = CLASHING if extra else []
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(
            f", `{n}` string" for n in names
        )
        return spark.createDataFrame([(*r, None, *["x"] * len(names)) for r in full], schema)

    return make


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def edited(text, every, seed=0):
    words = text.split()
    for i in range(seed % every, len(words), every):
        words[i] = f"edit{seed}x{i}"
    return " ".join(words)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and white-space texts, repeated rows and ids, ties, a very long text."""
    base = prose(1, 200)
    return [
        (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "two words"), (None, base), (None, None),
        (10, base), (10, base), (11, base.upper()), (12, base.replace(" ", "  \n")), (12, prose(3, 40)),
        (13, edited(base, 150)), (14, edited(base, 4)), (15, "é ß 日本語 🙂 " * 30), (16, "🙂"),
        (17, prose(2, 30_000, 5000)), (18, "a" * 50_000), (19, "The " * 5_000), (4, "  " + base),
    ]
