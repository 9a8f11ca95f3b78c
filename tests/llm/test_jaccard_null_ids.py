"""Rows without an id: linked by their texts, never joined all with all."""

from weftline.llm import jaccard_join


def test_null_ids_link_by_text(spark):
    base = [f"t{i}" for i in range(60)]
    near = [*base[:20], "changed", *base[21:]]
    rows = [(None, " ".join(base)), (None, " ".join(near)), (7, " ".join(near)), (None, " ".join(near)), (None, "alone a b c d e f g"), (9, "alone a b c d e f g"), (None, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.n_links) for r in jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(0, 7, 3), (0, 7, 3), (7, 7, 3), (0, 7, 3), (0, 9, 1), (9, 9, 1), (0, 0, 0)])


def test_null_id_classes_do_not_multiply(spark):
    texts = [" ".join(f"{i // 2}w{j}" if j != 30 or i % 2 else "x" for j in range(60)) for i in range(400)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    narrow = jaccard_join.narrowed(docs)
    wanted = narrow.selectExpr("doc_id", "text_hash", "text_hash as key", "56L as n", "1L as copies")
    assert narrow.join(wanted, jaccard_join.same_text(narrow, wanted)).count() == 400
    got = jaccard_join.joined(docs).collect()
    assert len(got) == 400 and {r.n_links for r in got} == {1}
