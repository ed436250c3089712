import pytest
from pyspark.sql import types as T

#: Columns of documents, and extra ones whose names the operators use inside.
NAMES = ("target", "node", "key", "th", "spans", "chunk", "code", "pid", "held_out", "size", "bin")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("text", "lang", "source")], T.StructField("n_chars", T.LongType()), *[T.StructField(n, T.StringType()) for n in NAMES]]
)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The same with a map and with names that hold a dot, a backtick and a blank."""

    def make(rows):
        kind = "doc_id long, text string, lang string, source string, n_chars long, m map<string,int>, `a.b` string, `c``d` string, `e f` struct<`g.h`:string>"
        return spark.createDataFrame([(i, t, "xx", "s", len(t or ""), {"k": i or 0}, "dot", "tick", ("in",)) for i, t in rows], kind)

    return make


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of documents from (doc_id, text) or (doc_id, text, lang) rows, with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "xx", "s", len(r[1] or ""), *["?"] * len(NAMES)) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


def components(ids, links):
    """Smallest id reachable from each id."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}
