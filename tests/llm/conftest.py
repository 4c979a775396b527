"""Documents with every awkward case."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from corpusmill.llm.jaccard_join import gram_set
from corpusmill.llm.tokens import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names that the operators use.
EXTRA = "copy string, shard string, score string, n string, sig string, g string, keep string, rate string, k string, block string, turns string, layout string, fingerprint string, gone string, __leak string, __bad string, __extra string, __fp string, __layout string, __lp string, __n string, __block string, __text string, __mix_n string, h string, q string, t string, rep string"

_WORDS = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "amber", "violet", "meadow", "harbor", "lantern", "copper", "winter", "thistle"]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) + str(r.randrange(40)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))


@pytest.fixture(scope="session")
def prose_of():
    return prose


def low_hashed_words(start: str, n: int, seed: int) -> str:
    """``start`` and ``n`` more words of which each ends a trigram with a low hash."""
    r, out = random.Random(seed), start.split()
    for _ in range(n):
        some = [f"q{r.randrange(10**9)}" for _ in range(60)]
        out.append(min(some, key=lambda w: int(gram_set(next(iter(words(pa.array([" ".join([*out[-2:], w])]))))[2])[0])))
    return " ".join(out)


@pytest.fixture(scope="session")
def low_hashed():
    return low_hashed_words


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing columns."""
    long = prose(30_000, 1)
    rows = [
        (1, prose(60, 2), "en", "a", 5), (1, prose(60, 2), "en", "a", 5), (2, prose(60, 2), "en", "b", 5), (3, None, "en", "a", None), (4, "", "de", "a", 0), (None, prose(30, 3), None, None, None),
        (5, long, "en", "b", 1), (6, "x", None, "b", 1), (7, "   \n", "fr", None, 1), (8, prose(50, 4), "de", "c", 1), (9, "é" * 10, "fr", "c", 1), (10, "a b", "fr", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *[f"cast('z' as string) AS {c.split()[0]}" for c in EXTRA.split(", ")])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, None), (8, 0, 1), (8, 1, 0), (6, 0, 0), (6, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
