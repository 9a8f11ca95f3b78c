"""The training-data operators against brute force on small fixtures, with nulls, empty texts, copies and clashing columns."""

import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from weftline.llm import decontaminate, fm_quality, jaccard_join, llr_quality, packing, substring_dedup, suffix_dedup, toxicity, url_rules, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(5)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    base = [text(n) for n in (3, 5, 12, 13, 80, 120, 200, 300)]
    texts = [*base, base[5], base[6] + " extra words", base[6].replace(" ", "\n", 5), "x y " + passage + " " + text(20), text(30) + "\n" + passage, passage, base[2], None, "", "  \n ", "A B C D E f", "a b c d e F", "line one two\n" * 9, "# a * b\n$ 5 % & | <x>\n# a * b\n\x0b\n\x0b"]
    near = base[7].split()
    near[10] = "changed"
    return [*texts, " ".join(near), base[5] + " " + base[5]]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "a", "k") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def test_substring_dedup(spark):
    texts = corpus()
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(frame(spark, texts)).collect()}
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, w in enumerate(words):
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone |= {*range(j, j + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i


@pytest.mark.parametrize("options", [{}, {"shard_runs": 5}])
def test_suffix_array_dedup(spark, options):
    texts = corpus()
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame(spark, texts), **options).collect()}
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(t[j : j + 200] for t in raw for j in range(len(t) - 199))
    for i, t in enumerate(raw):
        gone = bytearray(len(t))
        for j in range(len(t) - 199):
            if count[t[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(t)) if gone[j] and not (j and gone[j - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    ends = np.repeat([250, 600], [250, 350])
    order, _ = suffix_dedup.suffix_array(data, ends, 20)
    raw = data.tobytes()
    keys = [raw[i : i + 20] for i in order]
    assert keys == sorted(keys) and len(order) == (250 - 19) + (350 - 19)
    got = suffix_dedup.common_prefixes(data, ends, order)
    for n in range(1, len(order)):
        a, b = raw[order[n - 1] : ends[order[n - 1]]], raw[order[n] : ends[order[n]]]
        want = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert got[n] == want


@pytest.mark.parametrize("tile", [256, 3])
def test_jaccard_join(spark, tile, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    texts = corpus() + [" ".join([*"p q r s t u v w x y z a b c d e f g h i j k l m n o".split(), *[f"n{i}"] * (i % 3)]) for i in range(12)]
    got = {r.doc_id: r for r in jaccard_join.joined(frame(spark, texts)).collect()}
    lower = {i: i + 32 for i in range(65, 91)}
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [[j for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b)] for i, a in enumerate(sets)]
    for i in range(len(texts)):
        seen, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (len(sets[i]), min(seen), len(links[i])), i
    kept = jaccard_join.one_of_each(frame(spark, texts))
    assert kept.columns == frame(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].component_id == i)


def test_repeated_rows_and_null_ids(spark):
    docs = frame(spark, ["z " * 300, "z " * 300, None, "lone text"], [1, 1, None, None])
    assert substring_dedup.repeated_spans(docs).count() == 4
    assert sorted(r.n_removed for r in suffix_dedup.suffix_dedup(docs).collect()) == [0, 0, 600, 600]
    assert jaccard_join.joined(docs).count() == 4
    assert suffix_dedup.without_repeats(docs).columns == docs.columns
    assert packing.packed(docs).count() == 4


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.joined(none).count() == substring_dedup.repeated_spans(none).count() == suffix_dedup.suffix_dedup(none).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == fm_quality.score(none, fm_quality.fit(none, labels)).count() == 0
    assert llr_quality.judge(none, llr_quality.ratios(none, labels)).count() == decontaminate.flagged(none, items).count() == packing.packed(none).count() == 0


def test_base_rules(spark):
    texts = corpus()
    ratio = [0.0] * llr_quality.BUCKETS
    for r in llr_quality.judge(frame(spark, texts), ratio).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        at = collections.defaultdict(list)
        for j in range(len(w) - 4):
            at[tuple(w[j : j + 5])].append(j)
        repeated = {x for v in at.values() if len(v) > 1 for j in v for x in range(j, j + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (len(w), sum(map(len, w)), sum(x in '#*$%&|<>' for x in t), len(lines) - len(set(lines)), len(repeated), failed, not failed)


def test_decontamination(spark):
    texts = corpus()
    items = spark.createDataFrame([(1, " ".join(texts[6].split()[40:70]).upper()), (2, "none of these words is there at all"), (3, None), (4, texts[0]), (4, texts[0])], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.flagged(frame(spark, texts), items).collect()}
    assert {i for i, x in got.items() if 1 in x} == {6, 9, 10} and {i for i, x in got.items() if 4 in x} == {0} and not any(2 in x for x in got.values())
    assert decontaminate.without_leaks(frame(spark, texts), items).count() == len(texts) - 4


def test_packing(spark):
    texts = [*corpus(), "long words here " * 3000, "see <|endoftext|> there"]
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.packed(frame(spark, texts)).collect()
    used = collections.Counter()
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        used[at] += 1
    # all sequences are full, but for one of each input split
    assert set(packing.TIERS) >= {x for x in used if x & (x - 1) == 0 and x >= 256} and sum(n for x, n in used.items() if x not in packing.TIERS) <= 8


def test_url_rules(spark):
    urls = ["http://spam.shop.net/buy/now?x=1"] * 40 + [f"https://ok{i % 5}.net/read/{i}" for i in range(60)] + ["https://a.example.ORG/es/1", "http://example.org/en/12", "http://b.com/fr/x", "http://c.com/de/", "http://d.org/", "nothing", None]
    pages = spark.createDataFrame([(i, u, "e") for i, u in enumerate(urls)], "page_id long, url string, tokens string")
    labels = spark.createDataFrame([(i, 0 if i < 40 else 1) for i in range(100)] + [(200, None)], "doc_id long, quality int")
    got = {r.page_id: r for r in url_rules.judge(pages, url_rules.mine(pages, labels, min_support=0.05)).collect()}
    assert all(got[i].verdict == ("block" if i < 40 else "allow") and got[i].rule is None for i in range(100))
    assert [(got[100 + i].rule, got[100 + i].verdict) for i in range(7)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow"), (None, "allow"), (None, "allow")]
    assert (got[100].host, got[100].path, got[106].host, got[106].path) == ("a.example.org", "/es/1", "", "")


def test_warc_round_trip_and_salvage(spark, tmp_path):
    big = "é" * 700
    pages = spark.createDataFrame([(1, "http://a/\r\nx", big, 0), (2, None, big, 0), (3, "u", None, 0), (4, "u", "same", 0), (5, "u", "same", 0), (6, "u", "WARC/1.1\r\n\r\n\r\n", 0)], "page_id long, url string, html string, value int")
    warc.write(pages, str(tmp_path / "w"))
    back = {warc_id(r.record_id): r for r in warc.read(spark, str(tmp_path / "w"), glob="part-*").collect() if r.kind == "record"}
    assert {i: (r.record_type, r.payload_bytes) for i, r in back.items()} == {1: ("revisit", 1400), 2: ("response", 1400), 3: ("response", 0), 4: ("response", 4), 5: ("response", 4), 6: ("response", 14)}
    assert back[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and warc_id(back[1].refers_to) == 2 and back[6].payload == "WARC/1.1\r\n\r\n\r\n"
    plain = b"".join((r.value.encode() + warc.END) for r in warc.records(pages).collect())
    at = [m.start() for m in re.finditer(rb"WARC/1.1\r\nWARC-Type", plain)]
    torn = bytearray(plain)
    torn[at[1] + 4 : at[1] + 30] = b"#" * 26
    found = [x[0] for x in warc.parse(bytes(torn))]
    assert found.count("record") == 5 and found.count("gap") == 1
    members = [gzip.compress(plain[a:b]) for a, b in zip(at, [*at[1:], len(plain)], strict=True)]
    hurt = bytearray(members[2])
    hurt[12:20] = b"\xff" * 8
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "part-1.warc.gz").write_bytes(b"junk" + b"".join([*members[:2], bytes(hurt), *members[3:]]))
    rows = warc.read(spark, str(tmp_path / "z")).collect()
    assert sum(r.kind == "record" for r in rows) == 5 and sum(r.kind == "gap" for r in rows) == 2


def warc_id(name):
    return int(re.search(r"page:(-?\d+)>", name)[1])


def labelled(spark):
    rng = random.Random(3)
    good, bad = [f"calm{i}" for i in range(60)], ["vile1", "vile2", "vile3"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(good) for _ in range(30)]
        toxic, junk = i % 5 == 0, i % 4 == 0
        if toxic:
            w[3 : 3 + 1 + i % 6] = [rng.choice(bad) for _ in range(1 + i % 6)]
        rows.append((i, " ".join(f"{x}%%%" if junk else x for x in w)))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame([*rows, (None, None)], "doc_id long, text string"), spark.createDataFrame([*labels, (7777, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 401 and not got[None].rejected
    assert np.mean([got[i].rejected == (i % 5 == 0) for i in range(400)]) > 0.97
    mild, severe = np.mean([got[i].severity for i in range(0, 400, 30)]), np.mean([got[i].severity for i in range(5, 400, 30)])
    assert severe > mild
    assert toxicity.reject(docs, model).columns == docs.columns


def test_fm_quality(spark):
    docs, labels = labelled(spark)
    got = fm_quality.score(docs, fm_quality.fit(docs, labels)).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_fm_identity():
    rng = np.random.default_rng(0)
    model = fm_quality.Model(0.3, rng.normal(size=fm_quality.BUCKETS + fm_quality.STATISTICS), rng.normal(size=(fm_quality.BUCKETS + fm_quality.STATISTICS, 3)), np.zeros(fm_quality.STATISTICS), np.ones(fm_quality.STATISTICS))
    bucket, value, stats = np.array([3, 9]), np.array([0.5, 2.0]), rng.normal(size=(1, fm_quality.STATISTICS))
    at = np.concatenate([bucket, fm_quality.BUCKETS + np.arange(fm_quality.STATISTICS)])
    x = np.concatenate([value, np.clip(stats[0], -5, 5)])
    want = 0.3 + model.w[at] @ x + sum(model.v[at[i]] @ model.v[at[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert np.isclose(model.logits(np.zeros(2, int), bucket, value, stats)[0], want)


def test_quality_ratio_separates(spark):
    docs, labels = labelled(spark)
    got = llr_quality.judge(docs, llr_quality.ratios(docs, labels)).collect()
    scores = {r.doc_id: r.score for r in got}
    assert min(scores[i] for i in range(400) if i % 4) > max(scores[i] for i in range(0, 400, 4))


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = labelled(spark)
    rows = [(r.doc_id, r.text, None, None, None) for r in docs.where("doc_id is not null").collect()]
    extra = [(1000 + i, t, "en", "s", len(t or "")) for i, t in enumerate(corpus())]
    spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, corpus()[4])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not out & {i for i in range(0, 400, 5) if i % 6 > 1} and 1004 not in out and {1, 2, 3, 1007, 1015} <= out and 1008 not in out
