"""Rules against brute force, and URLs that would give exponentially many combinations."""

import itertools
import random

from weftline.llm import url_rules


def test_rules_match_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        host, path, key = rng.choice(["a.net", "b.net", "c.net"]), rng.choice(["x", "y", "z"]), rng.choice(["p", "q"])
        bad = (host == "a.net" and path == "x") or (key == "q" and host == "b.net" and rng.random() < 0.9)
        rows.append((i, f"http://{host}/{path}?{key}", int(not bad)))
    pages = spark.createDataFrame(rows, "page_id long, url string, quality int")
    labels = pages.selectExpr("page_id AS doc_id", "quality")
    got = {tuple(r.tokens): (r.pages, round(r.confidence, 9)) for r in url_rules.mine(pages, labels, min_support=0.01).collect()}
    sets = [(frozenset(r.tokens), r.page_id) for r in url_rules.with_tokens(url_rules.parts(pages)).collect()]
    known = {r[0]: r[2] for r in rows}
    # tokens on the same pages are one, named by the first
    where = {}
    for t in sorted({x for s, _ in sets for x in s}):
        where.setdefault(frozenset(i for s, i in sets if t in s), t)
    names = sorted(where.values())
    at = {t: p for p, t in where.items()}
    strong = {}
    for n in (1, 2, 3):
        for c in itertools.combinations(names, n):
            on = frozenset.intersection(*[at[t] for t in c])
            bad = sum(known[i] == 0 for i in on)
            if len(on) >= url_rules.MIN_PAGES and bad >= 0.01 * len(sets) and bad >= url_rules.MIN_CONFIDENCE * len(on):
                strong[c] = (len(on), bad / len(on))
    want = {c: (n, round(x, 9)) for c, (n, x) in strong.items() if not any(strong.get(p, (0, -1))[1] >= x for p in itertools.combinations(c, len(c) - 1) if p)}
    assert got == want and got
    out = {r.page_id: r.mined_rules for r in url_rules.judge(pages, url_rules.mine(pages, labels, min_support=0.01)).collect()}
    assert out == {i: sum(set(c) <= s for c in want) for s, i in sets}


def test_one_shape_of_url_gives_few_combinations(spark):
    urls = ["http://a.b.c.d.example.net/" + "/".join(f"p{j}" for j in range(40)) + f"/{'&'.join(['?k1=1', 'k2=2'])}"] * 60
    pages = spark.createDataFrame([(i, u, "e") for i, u in enumerate(urls)], "page_id long, url string, quality string")
    labels = spark.createDataFrame([(i, 0) for i in range(60)], "doc_id long, quality int")
    rules = url_rules.mine(pages, labels).collect()
    assert len(rules) == 1 and len(rules[0].tokens) == 1
    got = url_rules.judge(pages, url_rules.mine(pages, labels)).collect()
    assert len(got) == 60 and {r.verdict for r in got} == {"block"}


def test_empty_tables_and_shared_ids(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert url_rules.judge(pages, url_rules.mine(pages, labels)).count() == 0
    some = spark.createDataFrame([(None, "http://x.net/a"), (None, "http://x.net/a"), (None, None), (1, "http://y.net/")], "page_id long, url string")
    assert url_rules.judge(some, url_rules.mine(some, labels)).count() == 4
