"""Stages that keep whole rows keep maps and columns of any name."""

from terravane.llm import mixing, near_dup, quality, suffix_dedup

SAME = "a b c d e f g"
ROWS = [(1, SAME), (1, SAME), (2, SAME), (3, "x y z " * 90), (4, "x y z " * 90), (None, None), (None, ""), (5, "other words of a text")]


def kept(out, docs):
    assert out.schema == docs.schema
    rows = out.collect()
    assert all((r["a.b"], r["c`d"], r["e f"]["g.h"], r["m"]) == ("dot", "tick", "in", {"k": r["doc_id"] or 0}) for r in rows)
    return sorted(str(r["doc_id"]) for r in rows)


def test_near_dedup(odd_docs):
    docs = odd_docs(ROWS)
    assert kept(near_dup.keep_one(docs), docs) == ["1", "3", "5", "None", "None"]


def test_quality(spark, odd_docs):
    docs = odd_docs(ROWS)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (5, 1)], "doc_id long, quality int")
    good = quality.score(docs, labels).where("predicted = 1").collect()
    assert kept(quality.keep_good(docs, labels), docs) == sorted(str(r.doc_id) for r in good)


def test_suffix_dedup(odd_docs):
    docs = odd_docs(ROWS)
    assert len(kept(suffix_dedup.strip_repeats(docs), docs)) == len(ROWS)


def test_mixing(odd_docs):
    docs = odd_docs(ROWS)
    assert set(kept(mixing.repeat_rows(docs), docs)) <= {"1", "2", "3", "4", "5", "None"}
