import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside; they must not disturb
        T.StructField("kept", T.StringType()),
        T.StructField("group_size", T.StringType()),
        T.StructField("component_id", T.StringType()),
        T.StructField("slot", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (4, "One two"), (5, "one  two"), (5, "one  two"), (6, "ONE\ntwo"),
    (7, LONG), (8, LONG + " end"), (None, "null id text here with some words"), (9, "a\x00b \x1cc d e\u0085f"),
    (10, "don't  stop <|endoftext|> now<|endoftext|>"), (11, "x\n\n y \n z "), (12, "Été é 你好 \U0001f600 123,456"),
    (13, "<|startoftext|> a <|endoftext|>"), (14, "ends with blank "), (15, "İǅⅠ ΣΣ ß"), (16, "a|b\ta"),
    (17, " lead"), (18, "tail　"), (19, "it's we'll I'm 'tis"), (20, "12 345² ①x"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", "z", "s", "i", "k") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).cache()


@pytest.fixture(scope="session")
def documents(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet").cache()
