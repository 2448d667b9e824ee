import random

import pytest
from pyspark.sql import types as T

#: Documents with further columns whose names operators use inside.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("row", "key", "node", "term", "_id", "_hash", "shard", "component", "c0", "size", "n", "words", "digest", "spans")])


def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(90)
    long = text(30_000)
    texts = [
        (1, base), (2, base), (2, base), (3, base + " end"), (4, None), (5, ""), (6, " \n\t "), (None, base), (None, text(40)), (7, long), (8, long + " x"), (9, "one"), (10, "one"), (11, "a b"), (12, text(9)),
        (13, "Ünïcode ßtraße naïve €5 " + text(30)), (14, text(200).upper()), (15, "12345 ... !!!"), (16, "x" * 50_000), (17, (text(6) + "\n") * 30), (None, None), (18, "🙂 " * 50), (18, text(12)),
    ]
    extra = lambda i: tuple(None if i % 3 == 0 else f"v{i}" for _ in range(14))
    return [(d, t, [None, "en", "de", "fr"][i % 4], [None, "b", "a"][i % 3], None if t is None else len(t), *extra(i)) for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")
