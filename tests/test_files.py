"""Readers and writers on files made by hand."""

import pytest
from pyspark.sql import functions as F

from terravane.sources import files as S


def test_scan_of_crawl_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    write = lambda name, *lines: (tmp_path / "raw" / name).write_text("\n".join(lines), encoding="utf-8")
    write("gz_sale_0.jsonl", '{"url": "https://gz.anjuke.com/prop/view/A1", "area": "80", "_source": "x"}', "", "{bad", '{"url": "https://gz.anjuke.com/prop/view/A1?from=list", "area": "81"}')
    write("gz_fangyuan_1.jsonl", '{"url": "https://gz.zu.anjuke.com/fangyuan/7", "area": "30"}')
    write("gz_rent_2.jsonl", '{"url": null, "area": "31"}', '{"url": "", "area": "32"}')
    write("gz_other_2.jsonl", '{"url": "u", "area": "1"}')
    write("xx_sale_0.jsonl", '{"url": "u", "area": "1"}')
    rows = S.scan_lines(spark, f"{tmp_path}/raw", "url string, area string", ["gz", "sz"])
    assert sorted((r.city, r.kind, r.area) for r in rows.collect()) == [("gz", "rent", "30"), ("gz", "rent", "31"), ("gz", "rent", "32"), ("gz", "sale", "80"), ("gz", "sale", "81")]
    first = S.first_of_each_url(rows)
    assert sorted(r.area for r in first.collect()) == ["30", "31", "80"]  # of one url, and of rows without any, the first in file order


def test_manifest(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("1")
    (tmp_path / "b.jsonl").write_text("22")
    found = S.list_files(spark, str(tmp_path))
    seen = S.mark_files(found.limit(0), found.where(F.col("path").endswith("a.jsonl")))
    assert [r.path.rsplit("/", 1)[1] for r in S.new_files(found, seen).collect()] == ["b.jsonl"]
    assert S.new_files(found, seen, backfill=True).count() == 2
    grown = seen.withColumn("length", F.col("length") + 1)
    assert S.new_files(found, grown).count() == 2 and S.mark_files(grown, found).count() == 2


def test_strict_load_fails_on_a_difference(spark):
    a = spark.range(5)
    assert S.strict_load(a, a, "x").first().loaded == 5
    with pytest.raises(Exception, match="4 rows loaded of 5"):
        S.strict_load(a, a.where("id > 0"), "x").collect()


def test_common_types():
    assert S.common_type("bigint", "double") == "double" and S.common_type(None, "double") == "double"
    assert S.common_type("bigint", "string") == "string" and S.common_type(None, None) == "string"
