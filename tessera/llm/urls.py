"""URL filtering by rules and by gradient-boosted trees on lexical features, in DataFrame functions only.

Trees are fitted on a bounded number of labelled URLs, whose features and labels come to the driver as rows;
there each boosting round splits on histograms of a few bins. The ensemble then is one expression of
comparisons, so all URLs are judged in one scan without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path) of the rules; the longest that fits wins.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/"))
#: Labelled URLs of each class that trees are fitted on, at most.
PER_CLASS = 4000
#: Parts of host names that mark a URL as unwanted in the labels.
UNWANTED = ("casino", "poker", "betting", "bets", "adult", "porn", "xxx", "viagra", "pills", "spam", "loans", "warez")
TREES, DEPTH, BINS, RATE, LAMBDA = 30, 3, 16, 0.3, 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_depth", "digit_ratio", "host_entropy", "parameters", "hyphens", "labels", "longest_label", "suffix_rate")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path: empty where the URL is null or has no '://'."""
    u = F.col(f"`{url}`")
    rest = F.when(u.contains("://"), F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_columns(rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The rule that fits columns host and path (else null), and its verdict; of equally long ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(enumerate(rules), key=lambda x: (len(x[1][1]), -x[0])):
        verdict_of, text = r
        host, slash, path = text.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits = fits & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, verdict_of).otherwise(verdict)
        del v
    return rule, verdict


def lexical(url: str, rates: dict[str, float], default: float) -> list[Column]:
    """The features in the order of FEATURES. rates: share of unwanted URLs by public suffix in the labels."""
    u, host = F.coalesce(F.col(f"`{url}`"), F.lit("")), F.col("host")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    n = F.length(host)
    share = lambda c: (n - F.length(F.replace(host, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(host, "")), F.lit(0.0), lambda s, c: s - F.when((c == "") | (n == 0), 0.0).otherwise(share(c) * F.log2(share(c))))
    suffix, rate = F.substring_index(host, ".", -1), F.lit(default)
    for s, r in sorted(rates.items()):
        rate = F.when(suffix == s, r).otherwise(rate)
    labels = F.split(host, r"\.")
    longest = F.aggregate(labels, F.lit(0), lambda m, x: F.greatest(m, F.length(x)))
    digits = F.length(u) - F.length(F.translate(u, "0123456789", ""))
    return [F.length(u).cast("double"), n.cast("double"), count(F.col("path"), "/").cast("double"), F.when(u == "", 0.0).otherwise(digits / F.length(u)), entropy, (count(u, "=") + count(u, "&")).cast("double"), count(host, "-").cast("double"), F.size(labels).cast("double"), longest.cast("double"), rate]


@dataclass
class Forest:
    """Trees as nested (feature, bound, left, right) or leaf values; values at most the bound go left."""

    trees: list
    start: float
    rates: dict[str, float]
    default: float

    def score(self, url: str = "url") -> Column:
        """Probability that a row (url, host, path) is unwanted."""
        x = [F.col(f"_f{i}") for i in range(len(FEATURES))]

        def of(node) -> Column:
            return F.lit(node) if isinstance(node, float) else F.when(x[node[0]] <= node[1], of(node[2])).otherwise(of(node[3]))

        total = F.lit(self.start)
        for t in self.trees:
            total = total + of(t)
        return 1 / (1 + F.exp(-total))


def boost(rows: list[list[float]], y: list[int], trees: int = TREES, depth: int = DEPTH) -> tuple[list, float]:
    """Trees and the starting log-odds, by second-order boosting of the logistic loss on binned features."""
    n = len(rows)
    mean = min(max(sum(y) / n, 1e-3), 1 - 1e-3) if n else 0.5
    start = math.log(mean / (1 - mean))
    if n == 0 or len(set(y)) < 2:
        return [], start
    width = len(rows[0])
    bounds = []
    for f in range(width):
        values = sorted({r[f] for r in rows})
        step = max(1, len(values) // BINS)
        bounds.append([(a + b) / 2 for a, b in zip(values[:-1:step], values[1::step], strict=False)])
    bins = [[sum(v > b for b in bs) for v, bs in zip(r, bounds, strict=True)] for r in rows]
    raw = [start] * n
    out = []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in raw]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]

        def grow(at: list[int], level: int):
            gs, hs = sum(g[i] for i in at), sum(h[i] for i in at)
            best = (1e-6, None, None)
            if level:
                for f in range(width):
                    hist = [[0.0, 0.0] for _ in range(len(bounds[f]) + 1)]
                    for i in at:
                        cell = hist[bins[i][f]]
                        cell[0] += g[i]
                        cell[1] += h[i]
                    a = b = 0.0
                    for k in range(len(bounds[f])):
                        a, b = a + hist[k][0], b + hist[k][1]
                        gain = a * a / (b + LAMBDA) + (gs - a) ** 2 / (hs - b + LAMBDA) - gs * gs / (hs + LAMBDA)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, k)
            if best[1] is None:
                value = -RATE * gs / (hs + LAMBDA)
                for i in at:
                    raw[i] += value
                return value
            _, f, k = best
            return (f, bounds[f][k], grow([i for i in at if bins[i][f] <= k], level - 1), grow([i for i in at if bins[i][f] > k], level - 1))

        out.append(grow(list(range(n)), depth))
    return out, start


def fit(labelled: DataFrame, per_class: int = PER_CLASS) -> Forest:
    """The forest of rows (url, label 0/1): of each class the first per_class distinct URLs in the order of a hash."""
    known = labelled.filter("url is not null and label in (0, 1)").groupBy("url").agg(F.max("label").alias("label"))
    picked = None
    for c in (0, 1):
        part = known.filter(F.col("label") == c).orderBy(F.xxhash64("url"), "url").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    rows = with_parts(picked)
    plain = rows.select("label", F.substring_index("host", ".", -1).alias("suffix"), *(c.alias(f"_f{i}") for i, c in enumerate(lexical("url", {}, 0.0)[:-1])))
    got = sorted(tuple(r) for r in plain.collect())
    y = [int(r[0]) for r in got]
    share = sum(y) / len(y) if y else 0.5
    by: dict[str, list[int]] = {}
    for r in got:
        by.setdefault(r[1], []).append(int(r[0]))
    # the most frequent suffixes, smoothed towards the mean
    top = sorted(by, key=lambda s: (-len(by[s]), s))[:100]
    rates = {s: (sum(by[s]) + 10 * share) / (len(by[s]) + 10) for s in top}
    trees, start = boost([[*map(float, r[2:]), rates.get(r[1], share)] for r in got], y)
    return Forest(trees, start, rates, share)


def labelled_by_hosts(pages: DataFrame, unwanted: tuple[str, ...] = UNWANTED) -> DataFrame:
    """(url, label) of pages: 1 where a word of the host is a listed one; URLs without a host have no label."""
    hosts = with_parts(pages.select("url")).filter("host <> ''")
    words = F.split(F.col("host"), r"[.-]")
    return hosts.select("url", F.when(F.arrays_overlap(words, F.array(*map(F.lit, unwanted))), 1).otherwise(0).alias("label"))


def url_verdicts(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages (page_id, url); labelled has url and label 0/1.

    Verdicts are the fitting rule's; without a rule, block where the score reaches the threshold. Null URLs
    and those without '://' have empty host and path. Without labels of both classes scores are the classes'
    share. Repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
    """
    forest = fit(labelled, per_class)
    rows = with_parts(pages.select("page_id", "url"))
    rule, verdict = rule_columns(rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), *(c.alias(f"_f{i}") for i, c in enumerate(lexical("url", forest.rates, forest.default))))
    rows = rows.withColumn("score", forest.score())
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
