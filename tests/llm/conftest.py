from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (id, text) pairs, with columns of clashing names."""

    def build(rows, schema="doc_id long, text string, id long, `class` string, n int, score string, version int"):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(*p, 7, "x", 1, "y", 2) for p in pairs], schema)

    return build


def prose(seed: int, n: int) -> list[str]:
    import random

    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]
