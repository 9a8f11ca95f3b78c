"""Each stage of the pipeline against brute force on what the stage before it kept."""

import collections

import numpy as np
import pytest

from tests.llm.test_operators import SCHEMA, WORD, corpus, frame
from weftline.llm import packing


def grams(text, n=5):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_stages_match_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "jaccard_join", "suffix_array", "decontamination", "packing"]
    toxic = [f"some vile1 vile2 vile3 words number{i}" for i in range(40)]
    clean = [f"some calm kind words number{i} here" for i in range(120)]
    texts = [*corpus(), *toxic, *clean]
    docs = frame(spark, texts)
    n = len(corpus())
    spark.createDataFrame([(i, 1, int(i < n + 40)) for i in range(n, n + 160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, " ".join(corpus()[7].split()[40:70])), (2, "not there at all in any text")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def rows(df):
        got = [tuple(r) for r in df.collect()]
        return {r[0]: r for r in got}, got

    kept = stages["toxicity"](spark, docs, str(tmp_path))
    now, got = rows(kept)
    assert kept.columns == docs.columns and set(now) == set(range(len(texts))) - set(range(n, n + 40)) and len(got) == len(now)
    # one of each group of near copies
    kept = spark.createDataFrame(stages["jaccard_join"](spark, spark.createDataFrame(got, SCHEMA), str(tmp_path)).collect(), SCHEMA)
    sets = {i: grams(r[1]) for i, r in now.items()}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    want = {i for i in sets if root[i] == i}
    now, got = rows(kept)
    assert set(now) == want and all(r[1] == texts[i] for i, r in now.items())
    # repeated bytes go
    kept = spark.createDataFrame(stages["suffix_array"](spark, kept, str(tmp_path)).collect(), SCHEMA)
    raw = {i: (r[1] or "").encode() for i, r in now.items()}
    count = collections.Counter(t[j : j + 200] for t in raw.values() for j in range(len(t) - 199))
    left = {}
    for i, t in raw.items():
        gone = np.zeros(len(t), dtype=bool)
        for j in range(len(t) - 199):
            if count[t[j : j + 200]] > 1:
                gone[j : j + 200] = True
        left[i] = bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")
    before, (now, got) = now, rows(kept)
    assert {i: r[1] or "" for i, r in now.items()} == left and any(left[i] != (before[i][1] or "") for i in left)
    assert all(r[1] is None for i, r in now.items() if before[i][1] is None)
    # documents that hold a benchmark item go
    kept = spark.createDataFrame(stages["decontamination"](spark, kept, str(tmp_path)).collect(), SCHEMA)
    bad = {i for i, t in left.items() for _, x in items if 5 * len(grams(t) & grams(x)) >= 4 * len(grams(x))}
    now, got = rows(kept)
    assert set(now) == set(left) - bad and bad
    # every token of every document, once
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(packing.default_tokenizer())
    pieces = stages["packing"](spark, kept, str(tmp_path)).collect()
    have = collections.Counter()
    for r in pieces:
        have[r.doc_id] += r.length
    assert have == {i: len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for i, r in now.items()}
