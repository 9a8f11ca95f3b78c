"""The archive's own files: one gzip member a record, so damage costs one record; a torn tail costs what it holds."""

import re

from weftline.llm import warc


def records(rows):
    return {int(re.search(r"page:(\d+)>", r.record_id)[1]) for r in rows if r.kind == "record"}


def test_damage_costs_one_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 50) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    raw = bytearray(file.read_bytes())
    starts = [m.start() for m in re.finditer(re.escape(b"\x1f\x8b\x08"), bytes(raw))]
    assert len(starts) == 120  # a record and an empty member each
    (tmp_path / "z").mkdir()
    hurt = bytearray(raw)
    hurt[starts[40] + 14 : starts[40] + 24] = b"\xff" * 10
    (tmp_path / "z" / "part-0").write_bytes(hurt)
    rows = warc.read(spark, str(tmp_path / "z")).collect()
    assert len(records(rows)) == 59 and [(r.start, r.end) for r in rows if r.kind == "gap"] == [(starts[40], starts[41])]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0").write_bytes(raw[: starts[100] + 30])
    rows = warc.read(spark, str(tmp_path / "t")).collect()
    assert records(rows) == records(warc.read(spark, str(tmp_path / "w"), glob="part-*").limit(50).collect()) and any(r.kind == "gap" for r in rows)


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w"), glob="part-*").count() == 0
