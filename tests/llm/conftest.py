import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, rep long, bands string, block long, trusted boolean, mix_copy int, weights string, features string, component string, u double, threshold double, labelled long, toxic string, size long, word string, prediction string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal texts, and extra columns with clashing names."""
    prose = "the quick brown fox jumps over the lazy dog and then it runs away from the old house near the river because it heard a noise "
    rows = [
        (1, prose * 3, "en", "a"), (1, prose * 3, "en", "a"), (2, prose * 3, "en", "a"), (3, "", "en", "b"), (4, None, None, None), (None, "no id here", "en", "a"),
        (5, " \n\t ", None, "b"), (6, "word " * 60000, "en", "a"), (7, "x" * 300000, None, None), (8, "one two three", "fr", "c"), (9, "naïve café ½ İ Σ <|endoftext|> 中文 \x00 end", None, "c"),
        (10, "line\nline\n\nline \n" + prose, "en", "b"), (11, "le chat est sur la table et le chien est dans la maison", "fr", "c"), (12, "le chat est sur la table et le chien est dans la maison", "fr", None),
    ]
    return spark.createDataFrame([(*r, None, *[None] * 17) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
