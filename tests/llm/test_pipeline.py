import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from terravane.llm import bpe, mixing, quality
from terravane.llm.common import table
from tests.llm.conftest import components
from tests.llm.test_mixing import brute_targets
from tests.llm.test_near_dup import shingles

DATA = "/root/testdata/sf0.001"
#: Columns whose names the stages use inside.
EXTRA = ("id", "th", "_id", "_th", "_spans", "_row", "_bin", "bin_source", "bin_no", "_bin_source", "_repeats", "_copy", "node", "component", "ids", "kind", "gram", "score", "predicted")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("text", "lang", "source")], T.StructField("n_chars", T.LongType()), *[T.StructField(n, T.StringType()) for n in EXTRA]])


def odd_rows():
    """Nulls in every column, empty and blank texts, repeated ids and rows, near copies, shared passages and a long text."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdeéo") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    passage, base = prose(80), prose(120)
    texts = [(i, prose(rng.randrange(3, 90))) for i in range(30)]
    texts += [(40 + i, base.replace(" ", f" new{i} ", 1)) for i in range(6)] + [(50, base), (50, base), (None, base)]
    texts += [(60 + i, prose(30) + passage + prose(30)) for i in range(4)]
    texts += [(70, None), (71, ""), (72, " \n\t"), (None, None), (None, prose(20)), (73, "same id"), (73, "other text"), (74, "$$$ ### @@@ !!!"), (75, prose(120_000))]
    texts += [(76, "ä" * 150), (77, "x" + "ä" * 150)]
    return [(i, t, None if k % 7 == 0 else "xx", (None, "a", "b", "Z")[k % 4], None if k % 5 == 0 else len(t or ""), *[f"{e}{k}" if k % 3 else None for e in EXTRA]) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return odd_rows(), spark.createDataFrame(odd_rows(), SCHEMA)


def stage(spark, name, docs, sf_dir=DATA):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    if name != "tokenize":
        assert out.columns == docs.columns
    return out


def as_rows(frame):
    return Counter(map(tuple, frame.collect()))


def test_quality_filter_keeps_rows_by_their_texts(spark, odd):
    rows, docs = odd
    got = as_rows(stage(spark, "quality_filter", docs))
    assert not got - Counter(rows)
    numbered = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "doc_id long, text string")
    labelled = table(spark, DATA, "documents").select("doc_id", "text").where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0")
    # ids of the odd rows that are also labelled ids count as learned from: give the model the same rows
    model = quality.score(docs.select("doc_id", "text"), table(spark, DATA, "labels")).collect()
    assert labelled.count() and numbered.count() == len(rows)
    want = Counter((r.doc_id, round(r.score, 6)) for r in model if r.predicted)
    assert sum(got.values()) == sum(want.values()) and Counter(r[0] for r in got.elements()) == Counter(i for i, _ in want.elements())


def test_near_dedup_keeps_one_row_of_each_group(spark, odd):
    rows, docs = odd
    got = as_rows(stage(spark, "near_dedup", docs))
    assert not got - Counter(rows)
    sets = [shingles(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    groups = defaultdict(list)
    for k, c in components(range(len(rows)), links).items():
        groups[c].append(rows[k])
    assert sum(got.values()) == len(groups) and max(map(len, groups.values())) >= 9
    for members in groups.values():
        kept = [r for r in got if r in members]
        least = min((r[0] is None, r[0]) for r in members if r[0] is not None or all(m[0] is None for m in members))
        assert (kept[0][0] is None, kept[0][0]) == least and (len(members) == 1 or len(kept) == 1)


def test_suffix_dedup_removes_repeated_bytes_only(spark, odd):
    rows, docs = odd
    got = as_rows(stage(spark, "suffix_dedup", docs))
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    want = Counter()
    for r, d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        text = None if r[1] is None else bytes(b for b, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore")
        want[(r[0], text, *r[2:4], None if text is None else len(text), *r[5:])] += 1
    assert got == want and sum(1 for r in got if r[1] == "") >= 3


def test_source_mix_repeats_rows_to_targets(spark, odd):
    rows, docs = odd
    got = as_rows(stage(spark, "source_mix", docs))
    assert set(got) <= set(rows)
    size = lambda t: len((t or "").split())  # noqa: E731  no other white space in these texts
    total, epochs = defaultdict(int), {}
    for r in rows:
        total[r[3]] += size(r[1])
    target = brute_targets(total)
    bins = defaultdict(int)
    place = lambda i: int(hashlib.md5(f"{'' if i is None else i}:7".encode()).hexdigest()[:8], 16) % mixing.BINS
    for r in rows:
        bins[r[3], place(r[0])] += size(r[1])
    times = Counter()
    for s in total:
        epochs[s] = int(target[s] // total[s])
        left = target[s] - epochs[s] * total[s]
        for b in sorted(b for x, b in bins if x == s):
            part = min(1, max(0, left / bins[s, b])) if bins[s, b] else 0
            left -= bins[s, b]
            times[s, b] = epochs[s] + (part >= 0.5)
    want = Counter()
    for r in rows:
        want[r] += times[r[3], place(r[0])]
    assert got == +want


def test_tokenize_gives_the_library_s_ids(spark, odd):
    rows, docs = odd
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f), special_tokens={})
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in stage(spark, "tokenize", docs).collect())
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want[r[0], tuple(ids), len(ids), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert got == want


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, odd, name):
    assert stage(spark, name, odd[1].limit(0)).count() == 0


def test_stages_in_order_each_on_its_predecessor(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    counts, columns = [docs.count()], docs.columns
    for i, (_, run) in enumerate(corpus_pipeline.STAGES):
        run(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[5] == counts[4]
    plain = lambda frame: sorted(frame.withColumn("ids", F.col("ids").cast("string")).collect())
    assert plain(docs) == plain(corpus_pipeline.run(spark, DATA))


def test_entry_points():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
