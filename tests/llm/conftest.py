import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, ids string, rank string"
LONG = "the quick brown fox jumps over a lazy dog and runs far away from here " * 2500

#: Nulls, empty, blank, long, repeated and odd texts, and columns whose names operators use.
ODD = [
    (1, "the cat sat on the mat and the dog ran to the house", "en", "a", 10, "x", "x", "x", "x"),
    (2, None, "en", "a", None, None, None, None, None),
    (3, "", "de", None, 0, "x", "x", "x", "x"),
    (4, " \t\n ", None, "a", 3, "x", "x", "x", "x"),
    (5, LONG, "en", "b", len(LONG), "x", "x", "x", "x"),
    (6, "the cat sat on the mat and the dog ran to the house", "en", "a", 10, "x", "x", "x", "x"),
    (6, "the cat sat on the mat and the dog ran to the house", "en", "a", 10, "x", "x", "x", "x"),
    (None, "der hund und die katze sind in dem haus und die maus auch", "de", "c", 9, "x", "x", "x", "x"),
    (8, "12345 --- !!!", "en", "c", 9, "x", "x", "x", "x"),
    (9, "日本語 🙂 ☃ é́ naïve \x00 end", "fr", "c", 9, "x", "x", "x", "x"),
    (10, "der hund und die katze sind in dem haus und die maus auch", "de", "c", 9, "x", "x", "x", "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3, "source")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
