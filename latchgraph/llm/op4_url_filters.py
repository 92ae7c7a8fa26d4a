"""URL filters: domain rules first, gradient-boosted trees on lexical features for the rest.

DataFrame functions only.  Rules give labelled URLs; the trees are fitted on a bounded, hash-ordered
sample of the distinct ones (``max_labelled``) with histogram aggregations - one ``groupBy(node, feature, bin)``
per level - and applied as one CASE expression per tree, so every URL is judged in a map-only pass.

Features: URL, host, path and query length, host labels, path depth, digit ratio, character entropy,
parameter count, hyphens in the host, and of the host's last label (suffix) its share of all rows and its
rate of blocked ones among all labelled rows.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and goes to the
trees; URLs of any length are judged whole; of rules of equal length that fit, the
first in code point order wins; repeated rows are judged alike; an empty table gives an empty result; without labelled URLs,
or with labels of one kind only, the prior decides (allow when there are none); extra columns pass through, except
that those called host, path, rule, verdict or block_probability are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sized
from ._tables import cut, table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_replace(_after_scheme(url), "^[^/?#]*", "")
    return F.coalesce(F.regexp_extract(rest, "^([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def best_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule (host, then path) that fits; null if none does."""
    if not rules:
        return F.lit(None).cast("string")
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    chain = F.when(_fits(ranked[0], host, path), F.lit(ranked[0].text))
    for r in ranked[1:]:
        chain = chain.when(_fits(r, host, path), F.lit(r.text))
    return chain


def _entropy(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda x: x != "")
    n = F.size(chars)
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)))
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c.cast("double")))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


FEATURES = ("length", "host_length", "path_length", "query_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_share", "suffix_rate")


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    n = F.length(url).cast("double")
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    count = lambda text, mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("double")
    return {
        "length": n,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "query_length": F.length(query).cast("double"),
        "labels": count(host, "."),
        "depth": count(path, "/"),
        "digit_ratio": F.when(n > 0, (n - F.length(F.translate(url, "0123456789", ""))) / n).otherwise(0.0),
        "entropy": _entropy(url),
        "parameters": count(query, "="),
        "hyphens": count(host, "-"),
    }


class Model(NamedTuple):
    prior: float
    edges: dict[str, list[float]]
    trees: list[dict[int, tuple]]  # node -> ("split", feature, threshold bin) or ("leaf", value)


def suffix_statistics(featured: DataFrame) -> DataFrame:
    """__suffix, share and rate of every suffix; ``featured`` has __suffix and __y (null: no label)."""
    counts = cut(featured.groupBy("__suffix").agg(F.count("*").alias("c"), F.count("__y").alias("n"), F.coalesce(F.sum("__y"), F.lit(0.0)).alias("p")))
    total = counts.agg(F.sum("c")).first()[0] or 1
    return counts.select("__suffix", (F.col("c") / total).alias("__f_suffix_share"), ((F.col("p") + 1) / (F.col("n") + 2)).alias("__f_suffix_rate"))


def _featured(frame: DataFrame, url: Column) -> DataFrame:
    frame = frame.withColumn("__host", host_of(url)).withColumn("__path", path_of(url))
    frame = frame.withColumns({f"__f_{k}": v for k, v in _lexical(url, F.col("__host"), F.col("__path")).items()})
    return frame.withColumn("__suffix", F.substring_index("__host", ".", -1))


def _bin(name: str, edges: Sequence[float]) -> Column:
    value = F.col(f"__f_{name}")
    return sum((F.when(value > e, 1).otherwise(0) for e in edges), F.lit(0))


def fit(labelled: DataFrame, trees: int = 8, depth: int = 3, bins: int = 16, rate: float = 0.4, ridge: float = 1.0, max_labelled: int = 20_000) -> Model:
    """``labelled`` has the __f_ columns, __order (a hash of the URL) and __y (1.0: block)."""
    columns = ["__order", *[f"__f_{f}" for f in FEATURES]]
    sample = cut(labelled.select("__y", *columns).distinct().orderBy(*columns).limit(max_labelled))
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("__y"), F.lit(0.0))).first()
    prior = math.log((positive + 0.5) / (n - positive + 0.5)) if n else -10.0
    if not n or positive in (0, n):
        return Model(prior if not n or positive == 0 else abs(prior), {}, [])
    grid = [i / bins for i in range(1, bins)]
    cuts = sample.agg(*[F.percentile_approx(f"__f_{f}", grid, 1000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted(set(cuts[f])) for f in FEATURES}
    cells = F.array(*[F.struct(F.lit(i).alias("f"), _bin(f, edges[f]).alias("b")) for i, f in enumerate(FEATURES)])
    sample = cut(sample.select("__y", cells.alias("cells")).coalesce(2))
    model: list[dict[int, tuple]] = []
    score = F.lit(prior)
    for _ in range(trees):
        tree: dict[int, tuple] = {}
        open_nodes = {1}
        probability = 1 / (1 + F.exp(-score))
        graded = sample.select("cells", (probability - F.col("__y")).alias("g"), (probability * (1 - probability)).alias("h"))
        for level in range(depth + 1):
            node = _route(tree, lambda i: F.get(F.col("cells"), F.lit(i))["b"])
            rows = graded.select(node.alias("node"), "g", "h", F.explode("cells").alias("c"))
            sums = rows.groupBy("node", F.col("c.f").alias("f"), F.col("c.b").alias("b")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            table_: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in sums:
                table_.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
            opened = set()
            for k in sorted(open_nodes):
                by_feature = table_.get(k)
                if not by_feature:
                    tree[k] = ("leaf", 0.0)
                    continue
                g = sum(x[0] for x in by_feature[0].values())
                h = sum(x[1] for x in by_feature[0].values())
                best = _best_split(by_feature, g, h, ridge) if level < depth else None
                if best:
                    tree[k] = ("split", *best)
                    opened |= {2 * k, 2 * k + 1}
                else:
                    tree[k] = ("leaf", -rate * g / (h + ridge))
            open_nodes = opened
            if not opened:
                break
        model.append(tree)
        score = score + _value(tree, lambda i: F.get(F.col("cells"), F.lit(i))["b"])
    return Model(prior, edges, model)


def _best_split(by_feature: dict, g: float, h: float, ridge: float) -> tuple[int, int] | None:
    best, gain = None, 1e-6
    for f in sorted(by_feature):
        left_g = left_h = 0.0
        bins = by_feature[f]
        for b in sorted(bins)[:-1]:
            left_g += bins[b][0]
            left_h += bins[b][1]
            now = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
            if now > gain + 1e-9:
                best, gain = (f, b), now
    return best


def _route(tree: dict[int, tuple], bin_of, k: int = 1) -> Column:
    """The number of the node that a row has reached."""
    if k not in tree or tree[k][0] == "leaf":
        return F.lit(k)
    _, f, b = tree[k]
    return F.when(bin_of(f) <= b, _route(tree, bin_of, 2 * k)).otherwise(_route(tree, bin_of, 2 * k + 1))


def _value(tree: dict[int, tuple], bin_of, k: int = 1) -> Column:
    if tree[k][0] == "leaf":
        return F.lit(float(tree[k][1]))
    _, f, b = tree[k]
    return F.when(bin_of(f) <= b, _value(tree, bin_of, 2 * k)).otherwise(_value(tree, bin_of, 2 * k + 1))


def probability(model: Model) -> Column:
    """The probability that a URL is to be blocked, from the __f_ columns of ``apply_features``."""
    score = F.lit(float(model.prior))
    for tree in model.trees:
        # bin <= b is value <= edges[b]; a split never uses the last bin
        def valued(k: int = 1, tree=tree) -> Column:
            if tree[k][0] == "leaf":
                return F.lit(float(tree[k][1]))
            _, f, b = tree[k]
            name = FEATURES[f]
            return F.when(F.col(f"__f_{name}") <= F.lit(float(model.edges[name][b])), valued(2 * k)).otherwise(valued(2 * k + 1))

        score = score + valued()
    return 1 / (1 + F.exp(-score))


def judge(pages: DataFrame, url_column: str = "url", rules: Sequence[Rule] = RULES, **options) -> DataFrame:
    """Adds host, path, rule, verdict and block_probability, in place of columns of these names."""
    url = F.col("__url")
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("__row"), F.col(f"`{url_column}`").alias("__url"))
    featured = _featured(packed, url).withColumn("__rule", best_rule(F.col("__host"), F.col("__path"), rules))
    verdicts = {r.text: r.verdict for r in rules}
    by_rule = F.try_element_at(F.create_map(*[F.lit(x) for kv in verdicts.items() for x in kv]), F.col("__rule")) if verdicts else F.lit(None).cast("string")
    featured = featured.withColumn("__by_rule", F.when(F.col("__rule").isNotNull(), by_rule))
    featured = featured.withColumn("__y", F.when(F.col("__by_rule").isNotNull(), F.when(F.col("__by_rule") == "block", 1.0).otherwise(0.0)))
    featured = featured.join(sized(suffix_statistics(featured), 200_000), "__suffix", "left")
    model = fit(featured.filter("__y is not null").withColumn("__order", F.xxhash64(url)), **options)
    scored = featured.withColumn("__p", probability(model))
    verdict = F.coalesce("__by_rule", F.when(F.col("__p") >= 0.5, "block").otherwise("allow"))
    made = ("host", "path", "rule", "verdict", "block_probability")
    kept = [F.col("__row")[c].alias(c) for c in pages.columns if c.lower() not in made]
    return scored.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"), F.col("__p").alias("block_probability"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).drop("url")
