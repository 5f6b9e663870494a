import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # columns whose names clash with what operators use inside
        T.StructField("name", T.StringType()),
        T.StructField("h", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("component_id", T.LongType()),
    ]
)


def hard_texts():
    """Empty, blank, odd and very long texts, copies and near copies."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "delta.", "épsilon", "zeta", "ETA", "theta", "iota7", "kappa"]
    base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(300)]
    texts = [None, "", " ", "\n", "a", "a  b", "\ta b\r\nc", "x" * 70_000, "w " * 5_000, "日本語 の 文", "\U0001f600 ok", "a\n\nb c d"]
    texts += [" ".join(base), " ".join(base), " ".join(base[:150] + ["changed"] + base[151:]), " ".join(base[20:90]), " ".join(base * 2)]
    for i in range(40):
        n = rng.randrange(1, 120)
        texts.append(" ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n)))
    texts += [texts[-1], texts[-2] + "\nAll rights reserved.", " ".join(base[i % 300] for i in range(9_000))]
    return texts


@pytest.fixture(scope="session")
def hard(spark):
    """A frame of hard cases: also a null id and a repeated row."""
    texts = hard_texts()
    rows = [(i * 3 % 101, t, "en" if i % 3 else None, "s", len(t or ""), "n", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[12], (None, "null id here and there", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
