"""Pages of many items bring all of their combinations to the rules."""

import itertools
import math
import random

from weftline.llm import url_rules


def brute(rows, least, pages):
    """Rules of (items, bad) rows, from all combinations."""
    counts = {}
    for items, bad in rows:
        for n in (1, 2, 3):
            for c in itertools.combinations(sorted(items), n):
                x = counts.setdefault(c, [0, 0])
                x[0] += 1
                x[1] += bad
    strong = {c: (n, b / n) for c, (n, b) in counts.items() if b >= least and n >= pages and b >= url_rules.MIN_CONFIDENCE * n}
    return {c: (n, round(x, 9)) for c, (n, x) in strong.items() if not any(strong.get(p, (0, -1))[1] >= x for p in itertools.combinations(c, len(c) - 1) if p)}


def mined(spark, urls, support):
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - bad) for i, (_, bad) in enumerate(urls)], "doc_id long, quality int")
    rules = url_rules.mine(pages, labels, min_support=support).collect()
    got = {tuple(r.tokens): (r.pages, round(r.confidence, 9)) for r in rules}
    again = spark.createDataFrame([(r.rule_id, r.tokens) for r in rules], "rule_id long, tokens array<string>")
    return got, {r.page_id: r.mined_rules for r in url_rules.judge(pages, again).collect()}


def drawn(rng, i):
    """A url of up to 16 steps, few of them on a third of the pages, whose steps tell the label only together."""
    steps = [f"s{j}" for j in range(16) if rng.random() < (0.75 if i % 3 else 0.2)]
    bad = int({"s3", "s7", "s12"} <= set(steps) or (i % 3 == 0 and "s5" in steps)) if rng.random() < 0.97 else 1
    return "http://h.x/" + "/".join(steps), bad


def test_rules_of_long_and_short_urls_match_brute_force(spark):
    rng = random.Random(5)
    urls = [drawn(rng, i) for i in range(300)]
    got, fired = mined(spark, urls, 0.05)
    steps = [([f"path={x}" for x in u.split("/")[3:] if x], bad) for u, bad in urls]
    assert 50 < sum(len(s) > 10 for s, _ in steps) < 250
    # the host's tokens stand on all pages and are one item
    want = brute([(["host=h.x", *s], bad) for s, bad in steps], math.ceil(0.05 * len(urls)), url_rules.MIN_PAGES)
    assert got == want and any(len(c) == 3 for c in got)
    assert fired == {i: sum(set(c) <= {"host=h.x", *s} for c in want) for i, (s, _) in enumerate(steps)}


def test_a_weakly_tied_pair_beside_many_strong_steps(spark):
    rng, urls = random.Random(6), []
    for i in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        bad = int(a != b)  # neither step alone tells anything
        more = [f"t{j}" for j in range(14) if rng.random() < (0.55 if bad else 0.45)]
        urls.append(("http://h.x/" + "/".join([*(["a"] if a else []), *(["b"] if b else ["c"]), *more]), bad))
    got, _ = mined(spark, urls, 0.02)
    assert got[("path=a", "path=c")][1] == 1.0
    steps = [(["host=h.x", *(f"path={x}" for x in u.split("/")[3:])], bad) for u, bad in urls]
    assert got == brute(steps, math.ceil(0.02 * len(urls)), url_rules.MIN_PAGES)
