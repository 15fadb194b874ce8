from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Nulls in every column, empty and white-space texts, repeated rows, ties and one very long text."""
    long = "straße l'été don't 漢字 x1y2 " * 20_000
    rows = [
        (1, "Hello the world of words and more", "en", "a", 5), (1, "Hello the world of words and more", "en", "a", 5), (2, None, "en", None, None), (3, "", None, "b", 0), (4, " \t\n ", "en", None, 3),
        (None, "le monde de la rue", "fr", "a", 1), (6, "12345 !!! 678", "de", "b", 2), (7, long, "de", "c", 9), (8, "a" * 30_000, "en", "c", 9), (9, "le monde est grand et beau", "fr", "a", 1),
        (10, "  double  spaces\r\n\tand    tails   ", "en", "d", 1), (11, " nbsp wide 　 x", None, "d", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df, *names):
    """Extra columns named like outputs and inner columns."""
    return df.withColumns({n: F.lit("extra") for n in names if n not in df.columns})
