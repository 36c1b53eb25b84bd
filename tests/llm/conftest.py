import pytest

pytest.importorskip("quantloom.llm")


@pytest.fixture()
def scratch(spark):
    from quantloom.llm.common import Scratch

    return Scratch(spark, "test")


#: Columns that clash with names the operators use inside.
EXTRA = ", lang string, h long, row string, node long, found string, lines string, language string, token_ids string, seg int"


@pytest.fixture()
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and clashing extra columns."""
    texts = [(1, "the cat sat on the mat\nand then it left"), (2, "the cat sat on the mat\nand then it left"), (2, "the cat sat on the mat\nand then it left"), (3, None), (4, ""), (5, "\n\n"), (6, "x"), (7, "word " * 30000), (8, "a" * 3000), (9, " .,;! "), (None, "no id here at all"), (10, "Ünï çödé — ▁ tëxt 😀")]
    rows = [(i, t, "en" if i != 6 else None, 1, "r", 1, "f", "l", "g", "t", 1) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string" + EXTRA)


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)
