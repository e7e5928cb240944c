import pytest

#: Texts that every operator must take: nulls, empty, blank, short, repeated, odd characters.
ODD = [None, "", "   \n\t ", "one", "two words", "<|endoftext|> Σ é İ 中文 \x1c ſ", "a " * 30, "-", "\n\n\n", "x" * 3000]


@pytest.fixture
def odd_docs(spark):
    """Odd texts with clashing extra columns, a null id and repeated rows."""
    rows = [(k, t, "en", 1.5, True) for k, t in enumerate(ODD)] + [(None, "no id at all here", "de", None, None), (3, "one", "en", 1.5, True), (3, "one", "en", 1.5, True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, kept boolean")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, score double, kept boolean")


@pytest.fixture
def sf(request):
    return "/root/testdata/sf0.001"
