"""Rows that share a page_id but not a payload."""

import hashlib

from weftline.llm import warc


def test_every_payload_is_kept_once(spark, tmp_path):
    x, y, z = "x" * 1500, "y" * 1500, "z" * 1500
    pages = spark.createDataFrame([(5, "u", x), (5, "u", y), (9, "u", x), (5, "u", z), (8, "u", z), (5, "u", "short"), (5, "u", None)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    rows = warc.read(spark, str(tmp_path / "w"), glob="part-*").where("kind = 'record'").select(warc.page_of("record_id").alias("id"), "record_type", warc.page_of("refers_to").alias("to"), "payload_digest", "payload").collect()
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    got = sorted((r.id, r.record_type, r.to or 0, r.payload_digest, r.payload) for r in rows)
    assert got == sorted([(5, "revisit", 9, sha(x), ""), (9, "response", 0, sha(x), x), (5, "response", 0, sha(y), y), (5, "revisit", 8, sha(z), ""), (8, "response", 0, sha(z), z), (5, "response", 0, sha("short"), "short"), (5, "response", 0, sha(""), "")])
