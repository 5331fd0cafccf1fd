import pytest

LONG = "Word after word goes by and nothing ends it " * 3000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXTS = [
    "The cat and the dog sat on the mat in the house of the man with the hat.",
    None,
    "",
    "  \n\t ",
    "!!! ... ???",
    "Le chat et le chien sont dans la maison de la femme avec les enfants et le pain.",
    "The cat and the dog sat on the mat in the house of the man with the hat.",
    LONG,
    "Ünïcödé ßtraße 漢字 ខ្ញុំ 🙂   \x00 end",
    "one two three",
]


@pytest.fixture(scope="session")
def edge_rows():
    rows = [(i, t, "fr" if i == 5 else "en", "src", len(t or "")) for i, t in enumerate(TEXTS)]
    return [*rows, rows[0], (None, "A text without an id that stands alone here.", "en", None, None), (11, "Nothing is known about me.", None, None, 5)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """Nulls in any column, empty and long texts, repeated rows, and extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows, SCHEMA)
    clash = {c: F.lit(7) for c in ("score", "lang_pred", "n_words", "item_ids", "row", "kept", "same", "id", "key", "label", "_id", "file", "n_tokens", "spans")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
