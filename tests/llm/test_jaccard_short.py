"""Short sets whose larger partner pushes a shared hash out of its front."""

from weftline.llm import jaccard_join


def test_least_hits_are_exact():
    for n in range(1, 400):
        need = jaccard_join._front(n) - n // jaccard_join.WHOLE - (n in jaccard_join.SHORT)
        assert need <= jaccard_join._least_hits(n), n


def test_short_pairs_link(spark):
    sizes = [(4, 5), (8, 10), (9, 11), (12, 15), (24, 30), (28, 35), (44, 55), (5, 6), (6, 7)]
    texts = []
    for n, m in sizes:
        for i in range(12):
            words = [f"s{n}x{i}y{j}" for j in range(m + jaccard_join.SHINGLE - 1)]
            texts += [" ".join(words[: n + jaccard_join.SHINGLE - 1]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.joined(docs).collect()}
    assert got == {i: (i - i % 2, 1) for i in range(len(texts))}
