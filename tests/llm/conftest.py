import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

PROSE = {"en": "the quick brown fox jumps over the lazy dog and then they were thinking about what the weather would be",
         "de": "der schnelle braune fuchs springt über den faulen hund und dann dachten sie nach wie das wetter wird",
         "fr": "le renard brun rapide saute par dessus le chien paresseux et ensuite ils pensaient au temps qu'il ferait"}


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, long texts."""
    long = " ".join(f"word{i % 977} and thing{i % 13}" for i in range(30_000))
    rows = [(1, PROSE["en"], "en", "b"), (2, PROSE["de"], "de", "a"), (3, PROSE["fr"], "fr", None),
            (4, None, "en", "a"), (5, "", None, "a"), (6, " \t\n ", "de", None), (7, "123 456 !!", "en", "b"),
            (8, PROSE["en"], "en", "b"), (8, PROSE["en"], "en", "b"), (9, long, "en", "c"), (10, long + " end", None, "c"),
            (None, "a text without an id that says little", "en", "a"), (None, None, None, None), (11, "é", "fr", "a"),
            (12, "😀 one two three 中文 four", "en", "é")]
    rows += [(100 + i, " ".join(reversed(PROSE[k].split())) + f" number {i}", k, "ab"[i % 2])
             for i, k in enumerate(list(PROSE) * 6)]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark):
    """Turns documents into ones with extra columns named like answers."""
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({c: F.lit(7) for c in ("size", "fp", "row", "score", "lang_pred", "n_words", "items", "part",
                                                     "kept", "window", "copies", "x", "n_tokens", "path", "at", "row_", "__at",
                                                     "__id", "__hash", "__row", "__marks", "a b")}
                              ).withColumn("extra", F.create_map(F.lit("k"), F.lit(1)))
    return add
