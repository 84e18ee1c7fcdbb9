"""Operator 1: URL filters by gradient-boosted trees over lexical features.

Rules (host, path prefix) give labels to the URLs they fit; trees trained on a
bounded sample of labelled URLs judge the rest. Features are DataFrame
expressions, so training input and scoring run inside Spark.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is judged by the trees like any other; no labelled URLs (or an
empty table) means there is no model and everything unruled is allowed; repeated
rows are judged alike; extra columns are kept, but for those named as in OWN or
like a feature (f_...), which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.work import discard, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host suffix and a path prefix (without its leading slash)."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


#: The production rule list.
RULES = (
    Rule("com/en/", "block"),
    Rule("example.com/en/7", "allow"),
    Rule("net/de/", "allow"),
    Rule("example.net/de/8", "block"),
    Rule("org/es/", "block"),
)

#: Columns of this operator, which replace columns of the same name.
OWN = ("host", "path", "rule", "rule_verdict", "p_block", "verdict", "label", "suffix", "fold", "features", "rawPrediction", "probability", "prediction")


def url_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def judge_by_rules(parts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds rule and rule_verdict: those of the longest rule that fits, else null.

    A rule fits its host, all subdomains of that, and paths starting as it does.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.rule).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return parts.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _share(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]")) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits a character: from the lengths that remain without each character."""
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(characters)
    runs = F.array_sort(characters)
    # In sorted order, a run of k equal characters adds k log2 k.
    folded = F.aggregate(
        runs,
        F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total")),
        lambda s, c: F.struct(
            c.alias("last"),
            F.when(s["last"] == c, s["run"] + 1.0).otherwise(1.0).alias("run"),
            (s["total"] + F.when(s["last"] == c, 0.0).when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(0.0)).alias("total"),
        ),
        lambda s: s["total"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(0.0),
    )
    return F.when(n > 0, F.log2(n.cast("double")) - folded / n).otherwise(0.0)


def lexical_features(parts: DataFrame) -> DataFrame:
    """Adds f_* columns: length, depth, digit share, entropy, parameters, suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    labels = F.split(F.col("host"), r"\.")
    return parts.withColumns(
        {
            "suffix": F.element_at(labels, -1),
            "f_length": F.length(url).cast("double"),
            "f_host_length": F.length("host").cast("double"),
            "f_labels": F.size(labels).cast("double"),
            "f_depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "f_first_segment": F.length(F.regexp_extract("path", r"^/([^/]*)", 1)).cast("double"),
            "f_digits": _share(url, "0-9").cast("double"),
            "f_hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "f_entropy": _entropy(url),
            "f_host_entropy": _entropy(F.col("host")),
            "f_parameters": F.when(query != "", F.size(F.split(query, "&"))).otherwise(0).cast("double"),
            "f_fragment": F.when(url.contains("#"), 1.0).otherwise(0.0),
            "f_https": F.when(url.startswith("https://"), 1.0).otherwise(0.0),
        }
    )


def suffix_statistics(featured: DataFrame, folds: int) -> DataFrame:
    """Rows (suffix, fold, blocked, seen, urls): labelled URLs by host suffix and fold. A URL
    has one suffix and one fold, so the numbers of different URLs (about) add up."""
    return featured.groupBy("suffix", _fold(folds).alias("fold")).agg(F.sum("label").alias("blocked"), F.count("*").alias("seen"), F.approx_count_distinct(F.coalesce("url", F.lit(""))).alias("urls"))


def _fold(folds: int) -> Column:
    """All URLs of a host are in one fold."""
    return F.pmod(F.xxhash64("host"), F.lit(folds)).cast("int")


def _smoothed(blocked: Column, seen: Column, prior: float = 5.0) -> list[Column]:
    return [((blocked + prior / 2) / (seen + prior)).alias("f_suffix_blocked"), F.log1p(seen).alias("f_suffix_seen")]


@dataclass(frozen=True)
class UrlModel:
    classifier: object
    assembler: VectorAssembler
    suffixes: DataFrame

    def score(self, featured: DataFrame) -> DataFrame:
        """Adds p_block. The suffix table is a stored one, of one row a suffix (a
        TLD): its size is known, and Spark sends it to the pages if it is small."""
        joined = featured.join(self.suffixes, "suffix", "left").na.fill({"f_suffix_blocked": 0.5, "f_suffix_seen": 0.0})
        scored = self.classifier.transform(self.assembler.transform(joined))
        return scored.withColumn("p_block", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def train_url_model(labelled: DataFrame, max_rows: int = 20_000, trees: int = 12, depth: int = 4, folds: int = 5, seed: int = 7) -> UrlModel | None:
    """Fit the trees to `labelled` (url, host, path, label: 1.0 means block).

    The trees see at most `max_rows` different URLs, those of the least hashes: the
    bound on this sample does not depend on the input, nor on how often a URL is
    repeated: URLs are counted and drawn as different ones. Suffix statistics cover all labelled rows; a URL of the sample is given
    those of the other folds, so that no label is seen by its own feature. Without
    any labelled row there is no model (None).
    """
    featured = lexical_features(labelled)
    by_fold = stored(suffix_statistics(featured, folds), "url-folds")
    different = by_fold.agg(F.sum("urls")).first()[0]
    if not different:
        return None
    whole = Window.partitionBy("suffix")
    others = by_fold.select("suffix", "fold", *_smoothed(F.sum("blocked").over(whole) - F.col("blocked"), F.sum("seen").over(whole) - F.col("seen")))
    suffixes = stored(by_fold.groupBy("suffix").agg(F.sum("blocked").alias("b"), F.sum("seen").alias("s")).select("suffix", *_smoothed(F.col("b"), F.col("s"))), "url-suffixes")
    order = F.xxhash64(F.coalesce("url", F.lit("")), F.lit(seed))
    inputs = [c for c in featured.columns if c.startswith("f_")] + ["f_suffix_blocked", "f_suffix_seen"]

    def sample(below: float) -> DataFrame:
        rows = featured.where(order <= min(2**63 - 1, int((2 * below - 1) * 2**63)))
        once = rows.dropDuplicates(["url", "label"]).orderBy(order, "url", "label").limit(max_rows)
        return stored(once.withColumn("fold", _fold(folds)).join(others, ["suffix", "fold"]).select(*inputs, "label"), "url-sample", rows=max_rows)

    # Twice the share that is needed is sorted; if that happens to hold too few, more is.
    share = min(1.0, 2 * max_rows / different)
    data = sample(share)
    while share < 1 and data.count() < max_rows:
        discard(data)
        share = min(1.0, 4 * share)
        data = sample(share)
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    classifier = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=seed, cacheNodeIds=False).fit(assembler.transform(data).select("features", "label"))
    discard(by_fold, data)
    return UrlModel(classifier, assembler, suffixes)


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, block_above: float = 0.5) -> DataFrame:
    """Adds host, path, rule, p_block and verdict to `pages`.

    `labelled` has url and label (1 block, 0 allow); by default the labelled
    URLs are those of `pages` that a rule fits.
    """
    pages = pages.select(*(c for c in pages.columns if c not in OWN and not c.startswith("f_")))
    judged = judge_by_rules(url_parts(pages), rules)
    if labelled is None:
        labelled = judged.where("rule IS NOT NULL").withColumn("label", F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0))
    else:
        labelled = url_parts(labelled).withColumn("label", F.col("label").cast("double"))
    model = train_url_model(labelled.select("url", "host", "path", "label"))
    if model is None:
        scored = judged.withColumn("p_block", F.lit(0.0))
    else:
        scored = model.score(lexical_features(judged))
    verdict = F.coalesce("rule_verdict", F.when(F.col("p_block") >= block_above, "block").otherwise("allow"))
    return scored.select(*pages.columns, "host", "path", "rule", "p_block", verdict.alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "p_block")
