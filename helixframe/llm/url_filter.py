"""URL verdicts: explicit rules first, gradient-boosted trees on lexical features for the rest.

Everything runs in Spark's JVM: features are column expressions and the trees are Spark ML's.

The trees learn from labelled URLs, a table (url, label) with label 1 for pages to block. Where no such table is
at hand, ``taught_labels`` makes one from what the pages show, never from their URLs: a text model learns from labelled documents what low quality is
and judges each page's visible text. URLs whose hash falls in one of ``FOLDS`` folds are held out of all learning, and
``held_out_quality`` measures the trees on them.
The suffix table (block rates of the last one and two host labels, smoothed) counts all rows to learn from. The trees are fitted on at most
``TRAIN_ROWS`` distinct URLs, those with the smallest hash, so the fit stays bounded at any corpus size. A URL is blocked if its score
is over a half.

Features: lengths of URL, host and path, depth of the path, labels of the host, digit, upper-case and
punctuation ratios, entropy of the characters, parameters and their length, hyphens in the host, digits in the
host, length of the longest host label, whether there is a fragment, and the two suffix statistics.

Edge cases: a null URL, or one without "://", has an empty host and path and fits no rule; the model judges it by
its (empty) features. Labels of one class only, or none, give a constant verdict. Repeated rows keep their own verdict.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise

TRAIN_ROWS = 20_000
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
FOLDS = 5
#: Labelled documents that the text model is fitted on at most, and hashed words that it knows.
TEXT_ROWS, WORDS = 8_000, 1 << 14
#: Rule lists up to this length become one expression; longer ones are joined on host suffixes.
INLINE_RULES = 64
FEATURES = ["f_len", "f_host_len", "f_path_len", "f_depth", "f_labels", "f_digits", "f_upper", "f_punct", "f_entropy", "f_params", "f_query_len", "f_hyphens", "f_host_digits", "f_longest", "f_fragment", "f_suffix1", "f_suffix2"]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host behind the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path from there up to "?", "#" or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def with_parts(pages: DataFrame) -> DataFrame:
    """Add host and path of ``url``; null URLs have both empty."""
    host, path = host_and_path(F.col("_url"))
    return pages.withColumn("_url", F.coalesce(F.col("url").cast("string"), F.lit(""))).withColumns({"host": host, "path": path})


def with_rule(parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add ``rule`` (host and path of the longest rule that fits, else null) and ``rule_verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally long ones the first in alphabetical order counts, of equal ones
    "allow", however many rules there are.
    """
    if len(rules) <= INLINE_RULES:
        ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
        rule = verdict = F.lit(None).cast("string")
        for kind, host, path in reversed(ordered):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
        return parts.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = parts.sparkSession
    table = spark.createDataFrame([(h, p, k) for k, h, p in rules], "suffix string, rule_path string, kind string").groupBy("suffix").agg(
        F.collect_list(F.struct(F.length(F.concat("suffix", "rule_path")).alias("n"), F.concat("suffix", "rule_path").alias("rule"), "rule_path", "kind")).alias("rules")
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = parts.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(table, "suffix")
    hosts = hosts.groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules"))
    fit = F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"]))
    best = F.array_min(F.transform(fit, lambda r: F.struct((-r["n"]).alias("n"), r["rule"].alias("rule"), r["kind"].alias("kind"))))
    return parts.join(hosts, "host", "left").withColumn("best", best).withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.kind")}).drop("best", "rules")


def suffix(labels: Column, n: int) -> Column:
    """The last ``n`` of a host's labels."""
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), ".")


def with_features(parts: DataFrame) -> DataFrame:
    """Lexical features of ``_url``, ``host`` and ``path``, without the suffix statistics, and the two suffixes."""
    url, host = F.col("_url"), F.col("host")
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    count = lambda c, pattern: F.length(F.regexp_replace(c, pattern, "")).cast("double")  # noqa: E731  characters that are left
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    entropy = F.aggregate(
        F.transform(F.array_distinct(chars), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))).cast("double")),
        F.lit(0.0),
        lambda acc, k: acc - F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0),
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    return parts.withColumns({
        "f_len": F.length(url).cast("double"),
        "f_host_len": F.length(host).cast("double"),
        "f_path_len": F.length("path").cast("double"),
        "f_depth": count(F.col("path"), "[^/]"),
        "f_labels": F.size(labels).cast("double"),
        "f_digits": count(url, "[^0-9]") / n,
        "f_upper": count(url, "[^A-Z]") / n,
        "f_punct": count(url, "[A-Za-z0-9]") / n,
        "f_entropy": entropy,
        "f_params": F.when(query == "", 0.0).otherwise(count(query, "[^&]") + 1.0),
        "f_query_len": F.length(query).cast("double"),
        "f_hyphens": count(host, "[^-]"),
        "f_host_digits": count(host, "[^0-9]"),
        "f_longest": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
        "f_fragment": F.instr(url, "#").cast("boolean").cast("double"),
        "suffix1": suffix(labels, 1),
        "suffix2": suffix(labels, 2),
    })


def visible(html: Column) -> Column:
    """What a page shows: no tags, comments, scripts or styles."""
    return F.regexp_replace(html.cast("string"), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")


def _hashed_words(rows: DataFrame) -> DataFrame:
    """Add ``words_vector``: which hashed words column ``seen`` holds."""
    words = F.array_remove(F.split(lower_ascii(F.coalesce("seen", F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    return HashingTF(inputCol="_words", outputCol="words_vector", numFeatures=WORDS, binary=True).transform(rows.withColumn("_words", words)).drop("_words")


def chosen_texts(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """seen (the text) and _quality of the documents that ``known`` (_id, _quality) holds, ``most`` of them, those with the smallest hash.

    They are chosen by id and hash, so only the chosen ones' texts move. Equal rows that a key brings back together are cut once more.
    """
    texts = docs.select("doc_id", F.col("text").alias("seen")).where("seen IS NOT NULL").withColumn("_hash", F.xxhash64("seen"))
    keys = texts.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_key")).join(known, "_id").orderBy("_key", "_id").limit(most).distinct()
    met = texts.join(F.broadcast(materialise(keys)), (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_key")))
    return met.orderBy("_hash", "doc_id").limit(most).select("seen", "_quality")


def taught_labels(pages: DataFrame, docs: DataFrame, labels: DataFrame, train_rows: int = TEXT_ROWS) -> DataFrame:
    """(url, label) of pages by what they show: 1 if a text model, fitted on documents with a ``quality`` label, finds low quality likelier.

    The model is a logistic regression on hashed words, fitted on at most ``train_rows`` labelled documents, those with the smallest hash; all pages are
    scored. Without labels of both kinds, and for pages that show nothing, nothing is said.
    """
    known = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("double").alias("_quality"))
    rows = chosen_texts(docs, known, train_rows)
    rows = materialise(_hashed_words(rows.select("seen", (1 - F.col("_quality")).alias("label"))).drop("seen"))
    if "html" not in pages.columns or rows.select("label").distinct().count() < 2:
        return pages.sparkSession.createDataFrame([], "url string, label int")
    model = LogisticRegression(featuresCol="words_vector", labelCol="label", maxIter=30, regParam=0.01).fit(rows)
    shown = pages.where("url IS NOT NULL").select("url", visible(F.col("html")).alias("seen")).where(F.col("seen").rlike(r"\S"))
    scored = model.transform(_hashed_words(shown))
    return scored.select("url", (vector_to_array("probability")[1] > 0.5).cast("int").alias("label"))


def held_out(url: Column) -> Column:
    return F.crc32(url) % FOLDS == 0


class UrlModel:
    """Fitted trees with the suffix table; ``score`` adds ``blocked`` (boolean)."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame | None, prior: float):
        self.trees, self.suffixes, self.prior = trees, suffixes, prior

    def _complete(self, featured: DataFrame) -> DataFrame:
        out = featured
        for k in ("1", "2"):
            table = self.suffixes.where(F.col("kind") == k).select(F.col("suffix").alias(f"suffix{k}"), F.col("rate").alias(f"f_suffix{k}"))
            out = out.join(bounded(table), f"suffix{k}", "left").fillna({f"f_suffix{k}": self.prior})
        return out

    def scored(self, parts: DataFrame) -> DataFrame:
        """Add ``url_score``, from 0 to 1."""
        if self.trees is None:
            return parts.withColumn("url_score", F.lit(self.prior))
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(self._complete(with_features(parts)))
        scored = self.trees.transform(ready).withColumn("url_score", vector_to_array("probability")[1])
        return scored.drop(*FEATURES, "features", "rawPrediction", "probability", "prediction", "suffix1", "suffix2")

    def score(self, parts: DataFrame) -> DataFrame:
        if self.trees is None:
            return parts.withColumn("blocked", F.lit(self.prior >= 0.5))
        return self.scored(parts).withColumn("blocked", F.col("url_score") > 0.5).drop("url_score")


def held_out_quality(model: UrlModel, labelled: DataFrame) -> tuple[float, int, int]:
    """(area under the ROC curve, rows, rows of label 1) on the distinct labelled URLs that were held out."""
    rows = labelled.where("url IS NOT NULL AND label IN (0, 1)").where(held_out(F.col("url"))).groupBy("url").agg(F.max("label").cast("double").alias("label"))
    scored = materialise(model.scored(with_parts(rows)).select("label", "url_score"))
    n, ones = scored.agg(F.count("*"), F.sum("label")).first()
    return BinaryClassificationEvaluator(rawPredictionCol="url_score", labelCol="label").evaluate(scored), n, int(ones or 0)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = 12, depth: int = 4, smoothing: float = 20.0) -> UrlModel:
    """Suffix rates of all rows of (url, label) that are not held out, and trees trained on at most ``train_rows`` distinct ones."""
    rows = labelled.where("url IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("url"))).select("url", F.col("label").cast("double").alias("label"))
    sample = materialise(with_features(with_parts(rows.distinct().orderBy(F.xxhash64("url"), "url", "label").limit(train_rows))))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if sample.select("label").distinct().count() < 2:
        return UrlModel(None, None, float(bool(n) and 2 * ones >= n))
    prior = ones / n
    labels = F.split("host", r"\.")
    kinds = F.array(*[F.struct(F.lit(str(k)).alias("kind"), suffix(labels, k).alias("suffix")) for k in (1, 2)])
    both = with_parts(rows).select("label", F.explode(kinds).alias("s"))
    suffixes = materialise(both.groupBy("s.kind", "s.suffix").agg(((F.sum("label") + smoothing * prior) / (F.count("*") + smoothing)).alias("rate")))
    model = UrlModel(None, suffixes, prior)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(model._complete(sample)).select("features", "label")
    model.trees = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(ready)
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """One row per page: key, host, path, rule, verdict and ``model_blocked``, what the trees say that learned from ``labelled`` (url, label; none: they allow all)."""
    model = UrlModel(None, None, 0.0) if labelled is None else fit(materialise(labelled))
    parts = with_rule(with_parts(pages.select(key, "url")), rules)
    scored = model.score(parts)
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return scored.select(key, "host", "path", "rule", verdict.alias("verdict"), F.col("blocked").alias("model_blocked"))
