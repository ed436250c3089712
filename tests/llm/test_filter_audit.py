"""The audit against plain Python, and the partition refinement on texts that differ late."""

import random
import re
from collections import Counter
from itertools import permutations

from terravane.llm import filter_audit
from terravane.llm.common import Scratch
from tests.oracle import connect

SF = "/root/testdata/sf0.001"


def brute(rows, labels):
    first, good, toxic = {}, set(), set()
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()
    docs = []
    for i, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if set("#$%&*|") & set(t) else set()
        fails |= {"E"} if i is not None and first[t] < i else set()
        docs.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        share = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                mine = [(x, g, t) for p, x, g, t in docs if p == part]
                before = set(order[: step - 1])
                here = [(g, t) for x, g, t in mine if f in x and not before & x]
                share[f] += len(here)
                out[part, order, step] = [
                    sum(not x & (before | {f}) for x, _, _ in mine), len(here), sum(f in x and bool(before & x) for x, _, _ in mine), sum(x == {f} for x, _, _ in mine),
                    sum(g for g, _ in here), sum(t for _, t in here),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got(frame):
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert frame.columns == columns
    rows = [tuple(r) for r in frame.collect()]
    assert len({r[:3] for r in rows}) == len(rows)
    return {r[:3]: r[3:] for r in rows}


def table(spark, rows):
    """Documents with extra columns named as the operator's own."""
    extra = ("part", "mask", "own", "n", "block0", "first_id", "a.b", "labelled")
    return spark.createDataFrame([(*r, *["?"] * len(extra)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in extra))


def test_equals_brute_force_on_odd_rows(spark):
    rng, rows = random.Random(5), []
    base = ["w%d " % rng.randrange(30) * rng.randrange(1, 60) for _ in range(6)]
    base += [" ".join(f"{rng.choice(['a', 'B', '#'])}{rng.randrange(300)}" for _ in range(rng.randrange(40, 90))) for _ in range(20)]
    base += ["", "☃  x", "X" * 30, "long " * 40_000]
    for i in range(160):
        rows.append((rng.choice([None, *range(80)]), rng.choice([None, *base]), rng.choice([None, "", "s", "S", "t u"])))
    rows += rows[:10]
    labels = [(rng.choice([None, *range(90)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    said = spark.createDataFrame([(*x, "?") for x in labels], "doc_id long, quality int, toxic int, good string")
    assert got(filter_audit.audit(table(spark, rows), said)) == brute(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(table(spark, []), none).count() == 0
    rows = [(1, "a", "s"), (2, "a", "s"), (2, "a", None)]
    assert got(filter_audit.audit(table(spark, rows), none)) == brute(rows, [])


def test_refinement_keeps_what_only_whole_texts_tell_apart(spark, monkeypatch):
    long = "".join(random.Random(1).choice("abc ") for _ in range(5000))
    rows = [(1, long, "s"), (2, long, "s"), (3, long[:-1] + "X", "s"), (4, "X" + long[1:], "s"), (5, long[:100] + "X" + long[101:], "s"), (6, long + "y", "s")]
    facts = filter_audit._rows(table(spark, rows))
    assert filter_audit.refined(facts, Scratch(spark)).count() == 1  # only copies share their length and all block hashes
    # with hashes that tell nothing, only the comparison of whole texts is left
    monkeypatch.setattr(filter_audit, "_block_hashes", lambda text: [(text.isNull()).cast("long").alias(f"block{i}") for i in range(3)])
    marked = filter_audit._marked(table(spark, rows), Scratch(spark)).where("mask >= 16").select("doc_id").collect()
    assert [r.doc_id for r in marked] == [2]


def test_shuffled_classes_give_the_same(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    con = connect(SF)
    want = {tuple(r[:3]): tuple(r[3:]) for r in con.execute(filter_audit.ORACLE).fetchall()}
    assert got(filter_audit.audit(docs, labels)) == want
    monkeypatch.setattr(filter_audit, "BROADCAST_CLASSES", -1)
    assert got(filter_audit.audit(docs, labels)) == want
