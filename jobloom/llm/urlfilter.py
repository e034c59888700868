"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and the beginning of a path; it fits the host and its subdomains, and the
longest fitting rule decides. URLs that no rule fits are judged by Spark's gradient-boosted trees,
trained on labelled URLs: those that rules decide, at most `SAMPLE` of them, drawn by hash. The trees
see lengths, depth, digit ratio, character entropy, parameter counts, and how often labelled URLs
with the same host suffix or the same first path segment are blocked.

Defined results: a null URL or one without `://` has an empty host and path and no rule, and is
allowed or blocked by its (empty) features like any other; repeated rows are judged alike; where
labelled URLs have fewer than two kinds of label, the rest is allowed, or blocked if all of them are.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.session import cut_lineage

SAMPLE = 20_000
ROUNDS, DEPTH = 15, 4
SMOOTHING = 20.0
# The given rules: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    # Java's `.` stops at line ends, which may occur in broken URLs; (?s) reads over them.
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def apply_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds `rule` and `rule_verdict` of the longest fitting rule, null where none fits. Rules are a short given list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Later conditions win, so longer rules come later; equally long ones by name.
    for host, path, out in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(out)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.split(text, "")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
    return F.when(F.length(text) > 0, F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def with_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the lexical features of (url, host, path), and the keys of the suffix statistics."""
    url = F.coalesce("url", F.lit(""))
    length = F.greatest(F.length(url), F.lit(1))
    inputs = {
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length("host").cast("double"),
        "f_path_length": F.length("path").cast("double"),
        "f_depth": F.regexp_count(F.col("path"), F.lit("/[^/]")).cast("double"),
        "f_labels": F.regexp_count(F.col("host"), F.lit(r"\.")).cast("double"),
        "f_digits": F.regexp_count(url, F.lit("[0-9]")) / length,
        "f_host_digits": F.regexp_count(F.col("host"), F.lit("[0-9]")).cast("double"),
        "f_hyphens": F.regexp_count(F.col("host"), F.lit("-")).cast("double"),
        "f_entropy": entropy(url),
        "f_host_entropy": entropy(F.col("host")),
        "f_parameters": F.regexp_count(url, F.lit("[?&][^=&#]*=")).cast("double"),
        "f_fragment": url.contains("#").cast("double"),
        "f_secure": url.startswith("https:").cast("double"),
    }
    keys = {
        "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
        "segment": F.regexp_extract("path", r"^/([^/]*)", 1),
        "ending": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1),
    }
    return df.select("*", *[c.alias(k) for k, c in (inputs | keys).items()]), list(inputs)


STATISTICS = ("suffix", "segment", "ending")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of (page_id, url): host, path, rule and verdict."""
    host, path = host_and_path(F.col("url"))
    urls = apply_rules(pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host).withColumn("path", path), rules)
    described, inputs = with_features(urls)
    labelled = (
        described.filter(F.col("rule_verdict").isNotNull())
        .withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
        .orderBy(F.xxhash64("url"), "page_id")
        .limit(SAMPLE)
    )
    labelled = cut_lineage(labelled.select(*inputs, *STATISTICS, "label"))
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        other = F.lit("block" if n and blocked else "allow")
        return described.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", other).alias("verdict"))
    share = blocked / n

    def with_statistics(df: DataFrame) -> DataFrame:
        # The sample is bounded, and so are these tables.
        for key in STATISTICS:
            counts = labelled.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_b"))
            rate = ((F.col("_b") + SMOOTHING * share) / (F.col("_n") + SMOOTHING)).alias(f"f_{key}")
            seen = F.log1p(F.col("_n")).alias(f"f_{key}_seen")
            df = df.join(F.broadcast(counts.select(key, rate, seen)), key, "left").fillna({f"f_{key}": share, f"f_{key}_seen": 0.0})
        return df

    columns = [*inputs, *[f"f_{k}{s}" for k in STATISTICS for s in ("", "_seen")]]
    assembler = VectorAssembler(inputCols=columns, outputCol="inputs")
    training = cut_lineage(assembler.transform(with_statistics(labelled)).select("inputs", "label").coalesce(2))
    trees = GBTClassifier(featuresCol="inputs", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, seed=17).fit(training)
    judged = trees.transform(assembler.transform(with_statistics(described)))
    verdict = F.coalesce("rule_verdict", F.when(F.col("prediction") == 1.0, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
