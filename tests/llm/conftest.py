import pytest

DOC = "doc_id long, text string, lang string, drop string, n long, anchors string, source string"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with extra columns whose names the operators use inside."""
    from casegraph.llm.common import prepare

    prepare(spark)
    return lambda rows: spark.createDataFrame([(i, t, "en", "d", 7, "a", "s") for i, t in rows], DOC)
