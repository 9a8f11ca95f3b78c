"""Rows without an id between others that hold the same passage."""

import hashlib
import itertools

from weftline.llm import substring_dedup


def test_null_id_hides_no_source(spark):
    passage, other = [f"p{i}" for i in range(40)], [f"o{i}" for i in range(40)]
    texts = [(1, passage), (None, passage), (5, passage), (None, ["a", *passage[:25], "b"]), (7, ["c", *passage[5:30], "d", *other]), (9, ["e", *other[3:35]]), (None, other)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_spans(docs).collect())
    want = []
    for i, w in texts:
        gone = set()
        for j in range(len(w) - 12):
            gram = w[j : j + 13]
            if any(k and i and k < i and any(v[m : m + 13] == gram for m in range(len(v) - 12)) for k, v in texts):
                gone |= {*range(j, j + 13)}
        kept = " ".join(itertools.compress(w, (j not in gone for j in range(len(w)))))
        want.append((i or 0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want) and {x[0]: x[2] for x in got}[5] == 40
