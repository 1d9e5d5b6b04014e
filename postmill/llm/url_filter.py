"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

Everything that touches rows is a SQL expression: features, rules, and the trees themselves, which
become nested CASE expressions. The trees are fitted on the driver from a bounded set of labelled URLs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (action, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Labelled URLs taken for the fit, at most: those of the smallest hashes. Host suffixes that have a rate of their own, at most: the
#: most frequent ones of the labelled URLs; all others have the prior.
MAX_LABELLED, MAX_SUFFIXES = 100_000, 64
TREES, DEPTH, RATE, BINS, L2 = 24, 3, 0.3, 32, 1.0

#: Host words of the labelled URLs.
UNWANTED = ["rx-discount", "prize-draws24", "late-night-cams", "mail-blast", "free-loans", "poker-bonus", "hot-dates", "buy-followers", "lucky-slots", "diet-pills24", "crypto-x100", "warez-zone"]
WANTED = ["library", "weather", "gardening", "university", "cityhall", "museum", "physics", "railways", "bakery", "folkmusic", "hospital", "newsroom"]


#: Shapes of URLs that both kinds have, and of each kind alone: deep paths, numbers and many parameters against plain pages.
SHAPES = [("https://www.{}.example.{}/en/{}", 1), ("http://{}.example.{}/de/{}.html", 2), ("https://blog.{}.example.{}/fr/{}?page=2&ref=x", 3), ("http://m.{}.example.{}/es/{}#top", 5), ("https://{}.example.{}/en/{}/?utm_source=feed", 7)]
OWN_SHAPES = {1: [("http://{}.example.{}/go/win/{}/claim/now?aff=77&sid=3&r=9", 11), ("http://x9.{}.example.{}/o/88/{}/7741/click?k=1&u=2", 13)], 0: [("https://{}.example.{}/about", 1), ("https://www.{}.example.{}/opening-hours/{}", 1)]}


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label) by rule: each host word under several suffixes in all shapes of its kind; 1 is unwanted."""
    rows = [(shape.format(word, suffix, (i * step * 37) % 1000), label) for label, group in ((1, UNWANTED), (0, WANTED)) for i, word in enumerate(group) for shape, step in [*SHAPES, *OWN_SHAPES[label]] for suffix in ("com", "net", "org")]
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in rows])).alias("x")).select("x.*")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _rate(hit: Column, whole: Column) -> Column:
    return F.when(whole > 0, hit / whole).otherwise(F.lit(0.0))


def features(df: DataFrame, rates: dict[str, float], prior: float) -> tuple[DataFrame, list[str]]:
    """df (url, host, path, ...) with the feature columns f_*. rates: how often a host suffix is unwanted."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    entropy = F.expr("aggregate(array_distinct(split(host, '')), 0D, (s, c) -> CASE WHEN c = '' THEN s ELSE s - (char_length(host) - char_length(replace(host, c, ''))) / char_length(host) * log2((char_length(host) - char_length(replace(host, c, ''))) / char_length(host)) END)")
    rate = F.lit(prior)
    for suffix, value in sorted(rates.items()):
        rate = F.when(suffix_of(host) == suffix, F.lit(value)).otherwise(rate)
    made = {
        "f_length": F.char_length(url).cast("double"),
        "f_host_length": F.char_length(host).cast("double"),
        "f_labels": count(host, r"\."),
        "f_depth": count(path, "/"),
        "f_host_marks": count(host, "[-_]"),
        "f_digit_ratio": _rate(count(url, "[0-9]"), F.char_length(url)),
        "f_host_digits": count(host, "[0-9]"),
        "f_entropy": F.coalesce(entropy, F.lit(0.0)),
        "f_params": count(url, r"[?&][^?&#=]+="),
        "f_suffix_rate": rate,
    }
    return df.withColumns(made), list(made)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Newton boosting of the logistic loss; a tree is (feature, threshold, left, right) or a leaf's value."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin = np.full(len(y), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]

    def grow(rows: np.ndarray, depth: int):
        g, h = grad[rows], hess[rows]
        total, best, found = g.sum() ** 2 / (h.sum() + L2), 1e-6, None
        for f in range(x.shape[1]) if depth else ():
            for cut in cuts[f]:
                left = x[rows, f] <= cut
                if 0 < left.sum() < len(rows):
                    a, b = g[left].sum(), h[left].sum()
                    gain = a**2 / (b + L2) + (g.sum() - a) ** 2 / (h.sum() - b + L2) - total
                    if gain > best:
                        best, found = gain, (f, float(cut), left)
        if not found:
            return float(-RATE * g.sum() / (h.sum() + L2))
        f, cut, left = found
        return (f, cut, grow(rows[left], depth - 1), grow(rows[~left], depth - 1))

    def value(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    trees = []
    for _ in range(TREES if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        trees.append(grow(np.arange(len(y)), DEPTH))
        margin += [value(trees[-1], row) for row in x]
    return base, trees


def _case(tree, names: list[str]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, cut, left, right = tree
    return F.when(F.col(names[f]) <= cut, _case(left, names)).otherwise(_case(right, names))


def filter_urls(urls: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (how likely unwanted).

    A null url, or one without "://", has an empty host and path; no rule fits it, and the trees judge
    its other features. Of rules of equal length the one listed first wins. Rows may repeat; other
    columns are ignored; empty tables give empty results. Without labelled URLs the score is 0.5 for
    all, and what no rule fits is allowed. labelled: (url, label 0 or 1), MAX_LABELLED rows at most."""
    shaped = lambda df: df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    known = shaped(labelled.where("label IS NOT NULL").orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED))
    rates = known.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.count("*").alias("n"), F.sum("label").alias("bad")).orderBy(F.desc("n"), "suffix").limit(MAX_SUFFIXES).collect()
    total = sum(r.n for r in rates)
    prior = (sum(r.bad for r in rates) + 1) / (total + 2)
    by_suffix = {r.suffix: (r.bad + 4 * prior) / (r.n + 4) for r in rates}
    fit, names = features(known, by_suffix, prior)
    rows = fit.select(*names, "label").collect()  # the bounded sample
    base, trees = _fit(np.array([r[:-1] for r in rows], float).reshape(-1, len(names)), np.array([r[-1] for r in rows], float))
    df, names = features(shaped(urls.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))), by_suffix, prior)
    margin = F.lit(base)
    for tree in trees:
        margin = margin + _case(tree, names)
    fits = lambda host, path: ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda value: F.coalesce(*[F.when(fits(r[1], r[2]), F.lit(value(r))) for r in ordered], F.lit(None).cast("string"))
    df = df.withColumns({"rule": pick(lambda r: r[1] + r[2]), "action": pick(lambda r: r[0]), "score": 1 / (1 + F.exp(-margin))})
    return df.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every url of pages; where no rule fits, the trees fitted on labelled_urls judge."""
    return filter_urls(table(spark, sf_dir, "pages"), labelled_urls(spark))
