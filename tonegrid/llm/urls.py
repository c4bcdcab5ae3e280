"""URL verdicts: host and path rules first, then boosted trees on lexical features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (rule, verdict): a rule is a host and a path prefix, as in ``example.org/es/``.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Distinct labelled URLs that the trees are fitted on: about so many, drawn by hash from all.
SAMPLE = 50_000
FEATURES = ("length", "host_length", "host_parts", "depth", "digits", "entropy", "params", "hyphens", "suffix_rate")


def parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL; both empty without ``://`` or for NULL."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """``host``, ``path`` and the longest fitting ``rule`` with its ``__label``, NULL where none fits.

    ``rules`` is a short list; it becomes one expression.
    """
    host, path = parts(F.col("url"))
    out = pages.withColumn("host", host).withColumn("path", path)
    rule, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = text.partition("/")
        fits = ((F.col("host") == own) | F.col("host").endswith("." + own)) & F.col("path").startswith("/" + rest)
        rule, label = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(label)
    return out.withColumn("rule", rule).withColumn("__label", label)


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(df: DataFrame) -> DataFrame:
    """``df`` (url, host, path) with the numeric features but for the suffix rate; all built-in expressions."""
    url = F.substring(F.coalesce("url", F.lit("")), 1, 1 << 30)
    n = F.length(url).cast("double")
    letters = F.split(url, "")
    share = lambda c: F.length(F.regexp_replace(url, c, "")) / F.greatest(n, F.lit(1.0))
    size = F.greatest(F.size(letters).cast("double"), F.lit(1.0))
    counts = F.transform(F.array_distinct(letters), lambda c: (F.size(letters) - F.size(F.array_remove(letters, c))) / size)
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    count = lambda text, c: (F.length(text) - F.length(F.replace(text, F.lit(c)))).cast("double")
    return df.select(
        "*",
        n.alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_parts"),
        count(F.col("path"), "/").alias("depth"),
        (1.0 - share("[0-9]")).alias("digits"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"),
        (count(url, "=")).alias("params"),
        count(F.col("host"), "-").alias("hyphens"),
        suffix(F.col("host")).alias("__suffix"),
    )


class UrlModel:
    """Trees and suffix rates fitted on labelled URLs (url, host, path, label "allow"/"block").

    ``rates`` has at most as many rows as the sample. With labels of one kind, or none, the verdict is that kind,
    or "allow".
    """

    def __init__(self, labelled: DataFrame, sample: int = SAMPLE, trees: int = 20, depth: int = 4):
        spark = labelled.sparkSession
        # distinct URLs are drawn, so that one that many rows repeat is one row of that weight
        total = labelled.agg(F.approx_count_distinct("url")).first()[0]
        part = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, total)))
        drawn = labelled.where(part).select("url", "host", "path", (F.col("label") == "block").cast("double").alias("y"))
        drawn = drawn.groupBy("url", "host", "path", "y").agg(F.count("*").cast("double").alias("__rows"))
        rows = lexical(drawn).coalesce(8)
        rates = [(r["__suffix"], r["s"], r["n"]) for r in rows.groupBy("__suffix").agg(F.sum(F.col("y") * F.col("__rows")).alias("s"), F.sum("__rows").alias("n")).collect()]
        blocked, n = sum(r[1] for r in rates), sum(r[2] for r in rates)
        self.prior = (blocked + 1) / (n + 2)
        self.rates = spark.createDataFrame([(s, (b + 2 * self.prior) / (m + 2)) for s, b, m in rates], "__suffix string, suffix_rate double")
        self.constant = "block" if n and blocked == n else "allow" if blocked == 0 else None
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="__features")
        if self.constant is None:
            fit = GBTClassifier(featuresCol="__features", labelCol="y", weightCol="__rows", predictionCol="__block", maxIter=trees, maxDepth=depth, seed=1)
            self.model = fit.fit(self._vectors(rows))

    def _vectors(self, rows: DataFrame) -> DataFrame:
        rated = rows.join(F.broadcast(self.rates), "__suffix", "left").fillna(self.prior, ["suffix_rate"])
        return self.assembler.transform(rated)

    def judge(self, urls: DataFrame) -> DataFrame:
        """``urls`` (url, host, path, …) with ``__method``: allow or block."""
        if self.constant is not None:
            return urls.withColumn("__method", F.lit(self.constant))
        inner = urls.select(F.struct("*").alias("__row"), "url", "host", "path")
        scored = self.model.transform(self._vectors(lexical(inner)))
        verdict = F.when(F.col("__block") > 0.5, "block").otherwise("allow")
        return scored.select("__row.*", verdict.alias("__method"))


def filter_urls(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """``pages`` with host, path, rule and verdict. URLs that a rule decides are the labelled ones the trees learn from.

    A NULL or malformed URL has empty parts and gets the trees' verdict; repeated rows get equal verdicts.
    """
    inner = pages.select(F.struct("*").alias("__page"), "url")
    ruled = with_rule(inner, rules)
    labelled = ruled.where("__label IS NOT NULL").select("url", "host", "path", F.col("__label").alias("label"))
    judged = UrlModel(labelled, sample).judge(ruled)
    return judged.select("__page", "host", "path", "rule", F.coalesce("__label", "__method").alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("__page.page_id", "host", "path", "rule", "verdict")
