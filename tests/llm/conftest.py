import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


DOCS = "doc_id long, text string, lang string, source string, n_chars long, N_Words string, fp string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    same = "the quick brown fox jumps over the lazy dog and runs into the wide green forest again " * 3
    rows = [(1, same), (2, same), (2, same), (3, ""), (4, None), (None, "a b c"), (5, long), (6, "   \n\n\t "), (7, same + "x"), (8, "é" * 400), (9, "a\x00b " * 80), (10, "one")]
    return spark.createDataFrame([(i, t, "en" if i else None, None if i == 3 else "s", None, "clash", None) for i, t in rows], DOCS)


CLASHING = {"k": 77, "K": 88, "spans": "[1]", "Text": "Other", "DOC_ID": "x", "_gone": None, "vs": 3, "_c0": "c", "component_id": 5, "score": 0.5, "ids": "i"}


@pytest.fixture(scope="session")
def clashing_docs(spark, odd_docs):
    """odd_docs and columns whose names the operators use, or differ from theirs in case alone."""
    kinds = {int: "long", str: "string", float: "double", type(None): "string"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in odd_docs.schema] + [f"`{c}` {kinds[type(v)]}" for c, v in CLASHING.items()])
    return spark.createDataFrame([(*r, *CLASHING.values()) for r in odd_docs.collect()], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
