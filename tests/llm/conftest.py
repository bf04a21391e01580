import pytest

ODD_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, fp long, k int, "
              "row long, version long, n_lines long, slot long, extra string, label int, component_id long, gone string")


def odd_rows():
    """Nulls, empty and blank texts, a very long text, a very long word, ties and repeated rows."""
    prose = "the and attion to thanedble the anea eriner thanea of ing"
    texts = [(0, None), (1, ""), (2, "   \n\t "), (3, prose), (3, prose), (4, prose), (5, "x" * 5000), (6, (prose + "\n") * 600),
             (7, "Größe é 😀 naïve ß"), (8, "a b"), (9, "<|endoftext|> ÿ 123 456"), (None, prose + " more"), (None, None), (10, "### *** |||")]
    return [(i, t, "en" if t else None, None, None, 0.5, "x", 1, 2, 3, 4, 5, 6, "y", 1, 7, "z") for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(0, 1, 0), (1, 0, 0), (3, 1, 0), (3, 1, 0), (4, 0, 0), (4, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 0), (8, 1, 0), (9, 0, 0), (10, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents table, on the driver."""
    return {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


SF = "/root/testdata/sf0.001"
