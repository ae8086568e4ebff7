import pytest

EDGES = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \n\t ", None),
    (4, "one", "fr"),
    (5, "The red fox ran over the wide green hill and came home late in the cold blue night again.", "en"),
    (5, "The red fox ran over the wide green hill and came home late in the cold blue night again.", "en"),
    (6, "Yes. The red fox ran over the wide green hill and came home late in the cold blue night again.", "en"),
    (7, "na na na na na na na na na na na na na na", "xx"),
    (8, "Größe ÷ 漢字 naïve <|endoftext|> don't   x​y 🙂 €5", "de"),
    (None, "a text without an id, a text without an id, a text without an id", "en"),
    (9, "lorem ipsum dolor " * 4000, None),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names the operators use themselves."""
    rows = [(*r, "s", len(r[1] or ""), i, b"x", "label", 1.5) for i, r in enumerate(EDGES)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, node binary, label string, bucket double").repartition(3).cache()


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
