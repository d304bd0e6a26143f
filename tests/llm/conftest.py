import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, `row` string, score string,"
    " spans string, id string, mark string, fp string, component_id string, lang_pred string"
)


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text, lang), with extra columns named like the operators' own."""

    def make(rows):
        full = [
            (i, t, lang, "s", len(t) if t is not None else None, *["x"] * 8) for i, t, lang in rows
        ]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return make_docs(
        [
            (1, None, "en"),
            (2, "", None),
            (3, LONG, "en"),
            (4, "the cat sat\non the mat\nby the door", "en"),
            (4, "the cat sat\non the mat\nby the door", "en"),
            (5, "12 34 -- !!", None),
            (None, "the cat sat\non the mat\nby the door", "en"),
            (6, "le chat est sur la table et il dort", "fr"),
        ]
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
