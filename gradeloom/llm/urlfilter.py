"""URL filter: allow and block rules by host and path, and gradient-boosted trees on lexical features for what no rule judges.

The trees learn from labelled URLs, which may be those that rules judge. Features: lengths, depth, digit ratio, entropy, numbers of
parameters, and statistics of the host's suffixes among labelled URLs. All features are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, masked, saved, unmasked
from .fingerprint import let

#: Host suffixes of one to LEVELS labels have statistics.
LEVELS = 3
#: Most suffixes that a model keeps (it is broadcast), and the labelled URLs that one needs.
SUFFIXES, LEAST = 50_000, 5

LEXICAL = ["length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio", "longest_number", "hyphens", "entropy", "parameters", "fragment"]
FEATURES = LEXICAL + [f"{what}_{k}" for k in range(1, LEVELS + 1) for what in ("suffix_odds", "suffix_count")]


@dataclass
class UrlModel:
    suffixes: DataFrame | None  # suffix, odds, count
    trees: GBTClassificationModel | None
    base: float  # share of blocked URLs, used where there is nothing to learn from


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies behind the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; then up to `?`, `#` or the end. Null or no `://`: both empty."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as `host/path`, and its verdict; nulls where none does. Of equally long ones, that with the longer host, then the first.

    rules: (verdict, `host/path`). A rule fits its host and all hosts under it, if the URL's path starts with the rule's.
    """
    none = F.lit(None).cast("string")
    rule, verdict = none, none
    by_length = sorted(rules, key=lambda r: (len(r[1]), r[1].index("/")))  # the longest is asked first, so it is set last
    first = {name: says for says, name in reversed(rules)}
    for _, name in by_length:
        at = name.index("/")
        fits = ((host == name[:at]) | F.endswith(host, F.lit("." + name[:at]))) & F.startswith(path, F.lit(name[at:]))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(first[name])).otherwise(verdict)
    return rule, verdict


def _suffixes(host: Column) -> Column:
    """The host's last one, two, ... labels; as a whole where it has fewer."""
    return let(F.split(host, r"\."), lambda labels: F.array(*[F.array_join(F.slice(labels, F.greatest(F.size(labels) - k, F.lit(0)) + 1, LEVELS), ".") for k in range(1, LEVELS + 1)]))


def entropy(text: Column) -> Column:
    """Bits a character; 0 of an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return let(
        chars,
        lambda cs: F.aggregate(
            F.array_distinct(cs),
            F.lit(0.0),
            lambda total, c: total + let((F.size(cs) - F.size(F.array_remove(cs, c))) / F.size(cs), lambda p: -p * F.log2(p)),
        ),
    )


def lexical(url: Column) -> list[Column]:
    """The features of LEXICAL; a null URL is empty."""
    url = F.coalesce(url, F.lit(""))
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    digits = F.regexp_extract_all(url, F.lit(r"(\d+)"), 1)
    full = lambda parts: F.size(F.filter(parts, lambda p: p != ""))
    made = {
        "length": F.char_length(url),
        "host_length": F.char_length(host),
        "path_length": F.char_length(path),
        "query_length": F.char_length(query),
        "depth": full(F.split(path, "/")),
        "labels": full(F.split(host, r"\.")),
        "digit_ratio": F.char_length(F.array_join(digits, "")) / F.greatest(F.char_length(url), F.lit(1)),
        "longest_number": F.coalesce(F.array_max(F.transform(digits, F.char_length)), F.lit(0)),
        "hyphens": F.char_length(url) - F.char_length(F.translate(url, "-", "")),
        "entropy": entropy(url),
        "parameters": full(F.split(query, "&")),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
    }
    return [made[name].cast("double").alias(name) for name in LEXICAL]


def featurized(rows: DataFrame, suffixes: DataFrame, url_col: str) -> DataFrame:
    """`rows` with `features`. A suffix without statistics has those of the next shorter one, or none (zeros)."""
    host, _ = host_and_path(F.col(url_col))
    out = rows.withColumn("__suffixes", _suffixes(host))
    for k in range(LEVELS):
        named = F.broadcast(suffixes.select(F.col("suffix").alias(f"__s{k}"), F.struct("odds", "count").alias(f"__f{k}")))
        out = out.join(named, F.col("__suffixes")[k] == F.col(f"__s{k}"), "left").drop(f"__s{k}")
    known = [F.coalesce(*[F.col(f"__f{j}") for j in range(k, -1, -1)], F.struct(F.lit(0.0).alias("odds"), F.lit(0.0).alias("count"))) for k in range(LEVELS)]
    values = F.array(*lexical(F.col(url_col)), *[c[n] for c in known for n in ("odds", "count")])
    return out.select(*rows.columns, array_to_vector(values).alias("features"))


def learn_suffixes(rows: DataFrame, base: float, *, most: int = SUFFIXES, least: int = LEAST) -> DataFrame:
    """(suffix, odds, count) of hosts' suffixes in `rows` (url, label): smoothed log odds of a block against the base, and the log of the number of rows."""
    seen = rows.select(F.explode(F.array_distinct(_suffixes(host_and_path(F.col("url"))[0]))).alias("suffix"), "label").where("suffix <> ''")
    counts = seen.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).where(F.col("n") >= least)
    share = (F.col("blocked") + 2 * base) / (F.col("n") + 2)
    odds = F.log(share / (1 - share)) - F.log(F.lit(base / (1 - base)))
    return saved(counts.orderBy(F.desc("n"), "suffix").limit(most).select("suffix", odds.alias("odds"), F.log1p("n").alias("count")), "suffixes")


def fit(labelled: DataFrame, *, url_col: str = "url", label_col: str = "label", max_rows: int = 12_000, trees: int = 20, depth: int = 4, seed: int = 7) -> UrlModel:
    """Learn from labelled URLs: label 1 is block, 0 allow; other labels, nulls and null URLs are left out, a URL counts once, as blocked if it ever is.

    Half of the URLs (by hash) give the suffix statistics, all of them; `max_rows` bounds the sample of the other half that teaches the
    trees, so no URL's label is among the features that it teaches with. Fewer than two classes in a half: the base share alone.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(url_col).isNotNull()).groupBy(F.col(url_col).alias("url")).agg(F.max(label_col).cast("int").alias("label"))
    rows = saved(rows.withColumn("half", F.pmod(F.xxhash64("url", F.lit(29)), F.lit(2))), "labelled-urls")
    by = {(r["half"], r["label"]): r["count"] for r in rows.groupBy("half", "label").count().collect()}
    total = sum(by.values())
    base = sum(n for (_, label), n in by.items() if label == 1) / total if total else 0.0
    if len(by) < 4:
        return UrlModel(None, None, base)
    suffixes = learn_suffixes(rows.where("half = 0"), base)
    taught = bounded_sample(rows.where("half = 1"), "url", max_rows)
    made = saved(featurized(taught, suffixes, "url").select(vector_to_array("features").alias("f"), F.col("label").cast("double").alias("label")), "url-features")
    learn = made.select(array_to_vector("f").alias("features"), "label").coalesce(2).persist()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=seed).fit(learn)
    learn.unpersist()
    return UrlModel(suffixes, model, base)


def score(rows: DataFrame, model: UrlModel, *, url_col: str = "url", as_col: str = "score") -> DataFrame:
    """`rows` with the chance that the URL is to be blocked. Null URLs are empty ones; repeated rows are alike; other columns are carried whatever their names."""
    out, url = masked(rows, url_col)
    if model.trees is None:
        out = out.withColumn("__score", F.lit(float(model.base)))
    else:
        out = model.trees.transform(featurized(out, model.suffixes, url)).select(*out.columns, vector_to_array("probability")[1].alias("__score"))
    return unmasked(out.withColumnRenamed("__score", as_col), rows.columns, as_col)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], *, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """`pages` with columns host, path, rule, score and verdict: the rule's where one fits, else block for a score of `threshold` or more, else allow.

    The model learns from the URLs that rules judge. Null URLs and those without `://` have an empty host and path and fit no rule. Columns of
    these names give way to the new ones; repeated rows are alike; an empty table gives an empty result. Rules are a list of a few.
    """
    rows, url = masked(pages, url_col)
    host, path = host_and_path(F.col(url))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, says = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says)
    labelled = rows.where(F.col("rule").isNotNull()).select(F.col(url).alias("url"), (F.col("says") == "block").cast("int").alias("label"))
    rows = score(rows, fit(labelled), url_col=url)
    verdict = F.coalesce("says", F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return unmasked(rows.withColumn("verdict", verdict), pages.columns, "host", "path", "rule", "score", "verdict")
