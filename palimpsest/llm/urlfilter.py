"""Operator 10: URL filters, host and path rules before gradient-boosted trees on lexical features (no Python code on rows)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import materialize

#: Words of host names that mark a url as one to block, for weak labels only: advertising, tracking, gambling, adult,
#: pharmacy and prize sites. Fixed values.
BLOCK_WORDS = (
    "ad", "ads", "adserver", "adult", "adverts", "banner", "bet", "bets", "betting", "bingo", "cam", "cams", "casino", "cialis",
    "click", "clicks", "dating", "escort", "escorts", "gamble", "gambling", "jackpot", "loan", "loans", "lottery", "lotto", "pharma",
    "pharmacy", "pills", "poker", "popup", "porn", "prize", "prizes", "roulette", "sex", "slots", "spam", "sweepstakes", "track",
    "tracker", "tracking", "viagra", "win", "winner", "xxx",
)
#: Labelled urls that the trees are fitted on, at most about (a hash picks them), and the folds of hosts among them.
TRAIN_ROWS, FOLDS = 8_000, 5
#: Suffixes that are broadcast at most; beyond, their statistics are joined by shuffle.
MAX_BROADCAST_SUFFIXES = 100_000
#: Rules that are tested in one expression; longer lists are joined by host and path prefix.
MAX_RULES = 500
FEATURES = (
    "url_len", "host_len", "path_len", "depth", "labels", "hyphens", "digit_ratio", "entropy", "params",
    "suffix_log_n", "suffix_block_rate",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Rules are (verdict, host/path).

    Of equally long ones the later by code points wins, of a rule that is listed twice the last in the list.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def join_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``urls(host, path, ...)`` with ``__hit``, the same as ``match_rule`` for rule lists of any length.

    Each distinct (host, path) looks up its host and all domains above it, and of its path the prefixes that are as
    long as a path of these hosts' rules: equal keys throughout, so a host with many rules meets no rule in vain.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], r, i, v) for i, (v, r) in enumerate(rules)], "r_host string, r_path string, rule string, i int, verdict string")
    lengths = table.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = urls.select("host", "path").distinct().withColumn("r_host", F.explode(above)).join(lengths, "r_host")
    pairs = pairs.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path")))).withColumn("r_path", F.substring(F.col("path"), F.lit(1), F.col("n")))
    best = pairs.join(table, ["r_host", "r_path"]).groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule", "i", "verdict")).alias("__best"))
    hit = F.when(F.col("__best").isNotNull(), F.struct(F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("verdict")))
    return urls.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").withColumn("__hit", hit).drop("h", "p", "__best")


def _entropy(s: Column) -> Column:
    """Shannon entropy in bits of a string's characters; 0 if empty."""
    n = F.length(s)
    count = lambda ch: (n - F.length(F.replace(s, ch, F.lit("")))).cast("double")
    total = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda acc, ch: acc + F.when(
        F.length(ch) > 0, count(ch) * F.log2(count(ch))).otherwise(0.0))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def with_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path`` and the lexical features that need the row alone."""
    host, path = host_path(F.col(url))
    u, n = F.coalesce(F.col(url), F.lit("")), F.length(F.coalesce(F.col(url), F.lit("")))
    df = urls.withColumn("host", host).withColumn("path", path)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return df.withColumns({
        "url_len": n.cast("double"), "host_len": F.length("host").cast("double"), "path_len": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: F.length(x) > 0)).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "hyphens": (F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit("")))).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(n, F.lit(1)),
        "entropy": _entropy(F.col("host")),
        "params": F.when(F.length(query) > 0, F.size(F.split(query, "&"))).otherwise(0).cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    })


def word_label(host: Column, words: tuple[str, ...] = BLOCK_WORDS) -> Column:
    """A weak label where no judged urls are at hand: 1 if a word of the host, between dots and hyphens, is one of ``words``.

    It is noisy, and the trees never see the words: what they learn is how the urls of such hosts are built.
    """
    return F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, words))).cast("double")


def _rate(blocked: Column, n: Column) -> Column:
    return (F.coalesce(blocked, F.lit(0.0)) + 0.5) / (F.coalesce(n, F.lit(0)) + 1.0)


class Filter:
    """Boosted trees on lexical features, fitted on labelled urls; see ``judge``."""

    def __init__(self, labelled: DataFrame, urls: DataFrame, url: str, label: str, train_rows: int, rounds: int, depth: int, seed: int) -> None:
        n = labelled.count()
        picked = labelled.where(F.pmod(F.xxhash64(F.col(url), F.lit(seed)), F.lit(1_000_000)) < F.lit(int(1e6 * min(1.0, train_rows / max(n, 1))) + 1))
        picked = with_features(picked.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")))
        picked = materialize(picked.withColumn("fold", F.pmod(F.xxhash64("host", F.lit(seed)), F.lit(FOLDS))))
        known = picked.groupBy("suffix").agg(F.sum("label").alias("b"), F.count("label").alias("m"))
        all_hosts = urls.select(F.substring_index(host_path(F.col(url))[0], ".", -1).alias("suffix"))
        per = all_hosts.groupBy("suffix").agg(F.count("*").alias("n")).join(known, "suffix", "left")
        per = materialize(per.select(F.col("suffix").alias("suffix_key"), F.log2("n").alias("suffix_log_n"), "b", "m", _rate(F.col("b"), F.col("m")).alias("suffix_block_rate")))
        self.stats = F.broadcast(per) if per.count() <= MAX_BROADCAST_SUFFIXES else per
        self.pack = VectorAssembler(inputCols=list(FEATURES), outputCol="__features", handleInvalid="keep")
        # a fitted row's rate comes from the hosts of other folds, so that no label speaks for itself
        own = picked.groupBy(F.col("suffix").alias("s2"), F.col("fold").alias("f2")).agg(F.sum("label").alias("ob"), F.count("label").alias("om"))
        rows = self._joined(picked).join(F.broadcast(own), (F.col("suffix") == F.col("s2")) & (F.col("fold") == F.col("f2")), "left")
        rest = _rate(F.coalesce("b", F.lit(0.0)) - F.coalesce("ob", F.lit(0.0)), F.coalesce("m", F.lit(0)) - F.coalesce("om", F.lit(0)))
        train = materialize(self.pack.transform(rows.withColumn("suffix_block_rate", rest)).where("label is not null").select("label", "__features"))
        self.classes = [r[0] for r in train.select("label").distinct().limit(3).collect()]
        if len(self.classes) == 2:
            trees = GBTClassifier(labelCol="label", featuresCol="__features", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed)
            self.model = trees.fit(train.coalesce(2))

    def _joined(self, df: DataFrame) -> DataFrame:
        return df.join(self.stats, df["suffix"] == F.col("suffix_key"), "left").fillna({"suffix_log_n": 0.0, "suffix_block_rate": 0.5}).drop("suffix_key")

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with features) with ``block_score``."""
        if len(self.classes) != 2:
            return rows.withColumn("block_score", F.lit(float(self.classes[0]) if self.classes else 0.0))
        return self.model.transform(self.pack.transform(self._joined(rows))).withColumn("block_score", vector_to_array("probability")[1])


def judge(
    urls: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], url: str = "url", label: str = "label",
    train_rows: int = TRAIN_ROWS, rounds: int = 10, depth: int = 4, seed: int = 7,
) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``.

    The longest rule that fits decides, of equally long ones the last in order; else boosted trees on FEATURES, fitted on
    ``labelled`` (url, label 1 for block; null labels don't count) with about ``train_rows`` of its rows at most, picked
    by hash. Suffix counts are over all of ``urls``; the share of blocked urls of a suffix is over the fitted rows, for a
    fitted row over those of other folds of hosts. Null urls and urls without ``://`` have an empty host and path and are
    judged by the trees like others. Without both labels among the fitted rows the score is that one label, or 0 if there
    are none. Repeated rows are judged alike; an empty table gives no rows; extra columns stay unless they bear a
    result's name, which then replaces them. Very long urls are measured whole.
    """
    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    trees = Filter(labelled, urls, url, label, train_rows, rounds, depth, seed)
    # the table's own columns travel in one struct, so none can clash with a feature
    rows = with_features(urls.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), F.col(f"`{url}`").alias("url")))
    scored = trees.score(rows)
    if len(rules) <= MAX_RULES:
        scored = scored.withColumn("__hit", match_rule(F.col("host"), F.col("path"), rules))
    else:
        scored = join_rules(scored, rules)
    verdict = F.coalesce(F.col("__hit.verdict"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("__row.*", "host", "path", F.col("__hit.rule").alias("rule"), verdict.alias("verdict"), "block_score")
