import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents from (doc_id, text) with columns that clash with what operators call their own."""

    def make(rows, extra=()):
        names = [x for x in ("score", "bands", "key", "component", "length", "kept", "x", "id", "a", "b") if x not in extra]
        return spark.createDataFrame([(i, t, None, None, len(t) if t else None, *[k] * len(names)) for k, (i, t) in enumerate(rows)], DOCS + "".join(f", {n} int" for n in names))

    return make
