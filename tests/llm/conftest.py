import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo zu".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, size string, n int, score string, spans string, kept string, shard string, `a.b` int, items int, root int, licenses int"


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def rows_of(texts):
    return [(i, t, "xx" if (i or 0) % 2 else None, [None, "src", "b", "Ä"][(i or 0) % 4], None, "x", "y", 1, "z", None, "w", "v", 3, 4, 5, 6) for i, t in texts]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, tiny and long texts, near and exact copies, repeated rows, equal ids."""
    rng = random.Random(3)
    base = prose(rng, 300).split()
    near = [" ".join(w if rng.random() > 0.004 else "x" + w for w in base) for _ in range(6)]
    far = [" ".join(w if rng.random() > 0.05 else "y" + w for w in base) for _ in range(4)]
    passage = prose(rng, 90)
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "?!"), (7, "é"), (8, "one two three four five"), (None, "no id " + passage), (None, None)]
    texts += [(20 + i, t) for i, t in enumerate(near)] + [(30 + i, t) for i, t in enumerate(far)]
    texts += [(40, near[0]), (40, near[0]), (20, near[0]), (41, prose(rng, 40) + " " + passage + " " + prose(rng, 40)), (41, prose(rng, 50)), (42, passage.upper())]
    texts += [(50, prose(rng, 60000)), (51, "z" * 3000), (52, "ab" * 900 + "c"), (53, passage + passage)]
    texts += [(60 + i, prose(rng, rng.randint(1, 200))) for i in range(30)]
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(rows_of(odd_rows), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
