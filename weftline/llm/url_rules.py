"""URL filtering by association rules.

FP-growth mines combinations of URL tokens (labels of the host with their parents, path parts, query
keys) together with the label of a page: low quality or not.  Tokens that stand on the same labelled pages
are one item (a host and its words, say), and items on fewer bad pages than a rule needs are left out, as no rule
can hold them.  A combination of at most MOST_TOKENS items becomes a rule if enough labelled pages hold it (support)
and enough of these are bad (confidence), and if no part of it is already a rule of the same strength.  Rules are
matched by an inverted index: each rule is listed under its tokens, a page's tokens look up the lists, and a rule
fires where all its tokens were found.  Fixed host-and-path rules come first; the longest that fits decides.

No item, combination or rule is dropped.  FP-growth follows combinations of any length, of which a page of n items
has 2^n, so it mines the pages of at most TREE_ITEMS items.  Pages of more items list their combinations of up to
MOST_TOKENS.  What is frequent among all pages is so, at the same share, among the one or the other; where there are
pages of more items, what either side finds is then counted on all pages.

Defined results: a null url or one without `://` has an empty host and path, fits no fixed rule, has no
tokens and is allowed; labels that are null or missing are not used; with too few labelled pages no rule
is mined and pages without a fixed rule are allowed; repeated rows give repeated results; an empty table
gives an empty result; further columns of the pages are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

MIN_SUPPORT = 0.002
MIN_PAGES = 20
MIN_CONFIDENCE = 0.6
#: Items of a combination besides the label.
MOST_TOKENS = 3
#: Items of the longest page that FP-growth mines; longer ones list their combinations.
TREE_ITEMS = 10
BAD = "label=bad"


def parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, query)."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.regexp_extract(rest, r"\?([^#]*)", 1).alias("query"))


def with_tokens(urls: DataFrame) -> DataFrame:
    """Adds `tokens`: distinct, sorted and never null."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, n), ".")))
    steps = F.transform(F.filter(F.split("path", "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+(\\.[a-z]+)?$")), lambda x: F.concat(F.lit("path="), x))
    words = F.transform(F.filter(F.split("host", r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("word="), x))
    keys = F.transform(F.filter(F.split("query", "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), x))
    tokens = F.sort_array(F.array_distinct(F.concat(domains, words, steps, keys)))
    return urls.withColumn("tokens", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(tokens))


def items_of(rows: DataFrame, least: int) -> DataFrame:
    """(row, bad, items) of rows (row, tokens, bad): tokens on `least` bad rows or more; those that stand on the same rows are one, named by the first of them."""
    tokens = rows.select("row", "bad", F.explode("tokens").alias("token"))
    by = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("n_bad"), F.bit_xor(F.xxhash64("row")).alias("where"))
    # at most a row's mean number of tokens / the support, for a table of any size
    one = by.where(F.col("n_bad") >= least).groupBy("n", "n_bad", "where").agg(F.min("token").alias("token")).select("token")
    return tokens.join(F.broadcast(one), "token").groupBy("row").agg(F.max("bad").alias("bad"), F.sort_array(F.collect_list("token")).alias("items"))


def combinations(items: DataFrame) -> DataFrame:
    """(tokens, pages, bad): each combination of up to MOST_TOKENS items, the rows (bad, items) that hold it and the bad ones of these."""
    none, i = F.array().cast("array<string>"), F.col("i")
    sets = items.select("bad", none.alias("tokens"), F.col("items").alias("rest"))
    for _ in range(MOST_TOKENS):
        # 0: the set stays as it is; else it takes the i-th of the rest and goes on behind that
        sets = sets.select("bad", "tokens", "rest", F.explode(F.sequence(F.lit(0), F.size("rest"))).alias("i"))
        sets = sets.select("bad", F.when(i > 0, F.array_append("tokens", F.get("rest", i - 1))).otherwise(F.col("tokens")).alias("tokens"), F.when(i > 0, F.slice("rest", i + 1, F.size("rest"))).otherwise(none).alias("rest"))
    return sets.where(F.size("tokens") > 0).groupBy("tokens").agg(F.count(F.lit(1)).alias("pages"), F.sum("bad").alias("bad"))


def grown(items: DataFrame, least: int, rows: int) -> DataFrame:
    """(tokens, pages, bad): the combinations on at least `least` bad rows (bad, items), of which there are `rows`, by FP-growth."""
    baskets = items.select(F.when(F.col("bad") == 1, F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0, least - 0.5) / max(1, rows)), numPartitions=int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
    frequent = model.freqItemsets
    with_label = frequent.where(F.array_contains("items", BAD) & (F.size("items") > 1) & (F.size("items") <= MOST_TOKENS + 1))
    bad = with_label.select(F.sort_array(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("bad"))
    every = frequent.where(~F.array_contains("items", BAD) & (F.size("items") <= MOST_TOKENS)).select(F.sort_array("items").alias("tokens"), F.col("freq").alias("pages"))
    return bad.join(every, "tokens").select("tokens", "pages", "bad")


def mine(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", quality_col: str = "quality", min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, tokens, pages, confidence) from labelled pages: quality 0 is bad."""
    known = labels.where(F.col(quality_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("page_id")).agg(F.min(quality_col).alias("quality"))
    rows = with_tokens(parts(pages, id_col, url_col)).join(known, "page_id").where(F.size("tokens") > 0)
    rows = rows.select(F.xxhash64("page_id", "tokens").alias("row"), "tokens", (F.col("quality") == 0).cast("int").alias("bad")).dropDuplicates(["row"])
    n = rows.count()
    least = math.ceil(min_support * n)
    items = items_of(rows, least)
    long = F.size("items") > TREE_ITEMS
    sizes = items.agg(F.count(F.lit(1)).alias("n"), F.count_if(long).alias("long")).first()
    short = items.where(~long)
    found = grown(short, math.ceil(min_support * (n - sizes.long)), sizes.n - sizes.long)
    if sizes.long:
        listed = combinations(items.where(long & (F.col("bad") == 1))).where(F.col("bad") >= math.ceil(min_support * sizes.long))
        asked = found.select("tokens").union(listed.select("tokens")).distinct()
        found = combinations(items).join(asked, "tokens", "left_semi")
    strong = found.where((F.col("bad") >= least) & (F.col("pages") >= min_pages) & (F.col("bad") >= min_confidence * F.col("pages")))
    strong = strong.withColumn("confidence", F.col("bad") / F.col("pages"))
    # a longer combination is kept only if it is surer than each part of it that lacks one token
    shorter = strong.withColumn("gone", F.explode("tokens")).select("tokens", F.array_remove("tokens", F.col("gone")).alias("part")).join(strong.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence")), "part")
    beaten = shorter.join(strong.select("tokens", "confidence"), "tokens").where("part_confidence >= confidence").select("tokens").distinct()
    return strong.join(beaten, "tokens", "left_anti").select(F.xxhash64("tokens").alias("rule_id"), "tokens", "pages", "confidence")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", fixed: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rules)."""
    urls = with_tokens(parts(pages, id_col, url_col))
    index = rules.select("rule_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    # the pages that a rule fires on, by page and tokens, so that a url that many pages share doesn't meet in one task
    found = urls.select("page_id", F.xxhash64("tokens").alias("set_id"), F.explode("tokens").alias("token")).join(index, "token")
    found = found.groupBy("page_id", "set_id", "rule_id", "n").agg(F.count(F.lit(1)).alias("hit"))
    # rows that share an id and a url bring each token as often
    fired = found.where("hit >= n").groupBy(F.col("page_id").alias("_page"), F.col("set_id").alias("_set")).agg(F.count(F.lit(1)).alias("mined_rules"))
    named = [(f"{host}{path}", verdict, ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)) for host, path, verdict in fixed]
    named.sort(key=lambda x: (-len(x[0]), x[0]))
    rule = F.coalesce(*[F.when(fits, F.lit(name)) for name, _, fits in named], F.lit(None).cast("string"))
    by_rule = F.coalesce(*[F.when(fits, F.lit(verdict)) for _, verdict, fits in named])
    keyed = urls.withColumn("set_id", F.xxhash64("tokens"))
    out = keyed.join(fired, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("set_id") == F.col("_set")), "left")
    mined = F.when(F.coalesce("mined_rules", F.lit(0)) > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, mined).alias("verdict"), F.coalesce("mined_rules", F.lit(0)).cast("long").alias("mined_rules"))


def op7_url_association_rules(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, mine(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))


#: What the fixed rules decide, in DuckDB SQL; the verdict of other pages is the method's.
FIXED_SQL = r"""WITH r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(h, p, verdict)),
u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
k AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS fixed_verdict FROM k JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, rule, fixed_verdict FROM k LEFT JOIN m USING (page_id)"""


def url_fixed_rules(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and the rule's verdict of every page; null where no fixed rule fits."""
    out = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame([], "rule_id long, tokens array<string>"))
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("fixed_verdict"))
