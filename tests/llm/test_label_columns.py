"""Documents that bring columns of the names that a fit uses."""

from weftline.llm import decontaminate, fm_quality, llr_quality, toxicity


def test_fits_ignore_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} vile{i % 2} text", "l", 1, 2, 3) for i in range(60)], "doc_id long, text string, label string, _id int, _good int, _bad int")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 60
    assert fm_quality.score(docs, fm_quality.fit(docs, labels)).count() == 60
    assert llr_quality.judge(docs, llr_quality.ratios(docs, labels)).count() == 60
    assert decontaminate.without_leaks(docs, spark.createDataFrame([(1, "word0 vile0 text")], "item_id long, text string")).columns == docs.columns


def test_size_partitions_lose_nothing(spark):
    """Items of one to 300 words inside long documents, tiny ones too, against brute force."""
    words = [f"w{i}" for i in range(4000)]
    docs = [(i, " ".join(words[i * 300 : i * 300 + 500])) for i in range(11)] + [(50, "one two"), (51, "lone"), (52, None)]
    items = [(j, " ".join(words[at : at + n])) for j, (at, n) in enumerate([(0, 5), (100, 6), (700, 9), (900, 20), (1000, 40), (1500, 100), (2000, 300), (290, 60)])]
    items += [(90, "one two"), (91, "lone"), (92, "w5 zz w6 w7 w8"), (93, " ".join([*words[400:440], "zz", *words[441:480]]))]

    def grams(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    want = {(d, j) for d, t in docs for j, x in items if grams(x) and 5 * len(grams(t) & grams(x)) >= 4 * len(grams(x))}
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 12
