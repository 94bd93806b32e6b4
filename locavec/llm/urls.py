"""URL filter: host and path rules, else a logistic regression on hashed character n-grams. DataFrame functions only.

The regression is trained from a small labelled table of urls. Rules are listed in a fixed table; a rule fits its host and
all subdomains of it when the path starts with the rule's path, and the longest fitting rule decides.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Lengths of the character n-grams, and the size of the hashed feature space.
GRAMS, WIDTH = (3, 4, 5), 1 << 14
OUT = ("host", "path", "rule", "verdict", "score")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of the labelled urls: of unwanted hosts and paths, and of wanted ones.
UNWANTED = ("spam", "cheap-pills", "casino", "poker", "porn", "xxx", "adult-cams", "betting", "payday-loans", "replica-watches",
            "free-iphone", "warez", "torrent-crack", "click-farm", "spam-farm", "link-farm", "lottery-win", "viagra", "hot-deals-now", "seo-boost")
WANTED = ("news", "library", "museum", "university", "docs", "wiki", "garden", "weather", "recipes", "history",
          "science", "journal", "travel", "school", "music", "archive", "blog", "mail", "city", "health")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null urls and urls without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, verdict) of the longest fitting rule, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones are longer and win
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: every word in several kinds of url; unwanted urls are labelled 1."""
    def rows(pairs, name):  # literals, so that no task reads Python rows
        one = [F.struct(F.lit(a).alias(name), F.lit(y).alias("label")) for a, y in pairs]
        return spark.range(1).select(F.explode(F.array(*one)).alias("x")).select("x.*")

    words = rows([(w, 1.0) for w in UNWANTED] + [(w, 0.0) for w in WANTED], "w")
    forms = ["http://{}.example.org/en/12", "https://www.{}.example.net/de/345.html", "https://{}24.test/page/7", "http://blog.my-{}.example.com/fr/8/",
             "https://the{}.example.org/es/91?page=2", "http://m.{}s.example.net/en/640#top"]
    urls = F.array(*[F.concat(F.lit(f.split("{}")[0]), F.col("w"), F.lit(f.split("{}")[1])) for f in forms])
    plain = rows([(f"{s}://{a}{b}.example.{t}/{l}/{n}", 0.0) for s in ("http", "https") for a in ("", "www.", "blog.", "m.")
                  for b, n in (("thering", 12), ("theren", 340), ("thion", 77), ("anher", 951)) for t, l in (("org", "en"), ("net", "de"), ("com", "es"), ("org", "fr"))],
                 "url")
    return words.select(F.explode(urls).alias("url"), "label").union(plain)


def _grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and of path, marked by where they come from."""
    def of(text: Column, mark: str) -> list[Column]:
        t = F.concat(F.lit("^"), text, F.lit("$"))
        return [F.transform(F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - (n - 1))).otherwise(F.array().cast("array<int>")),
                            lambda i, n=n: F.concat(F.lit(mark), t.substr(i, F.lit(n)))) for n in GRAMS]

    return F.concat(*of(host, "h"), *of(path, "p"))


def _hashed(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=WIDTH, binary=True).transform(df)


def learn(table: DataFrame, url: str = "url", label: str = "label") -> LogisticRegressionModel:
    h, p = host_path(F.col(url))
    rows = _hashed(table.select(_grams(h, p).alias("grams"), F.col(label).cast("double").alias("label")).coalesce(1))
    return LogisticRegression(maxIter=30, regParam=0.002, standardization=False).fit(rows)


def judge(pages: DataFrame, url: str = "url", model: LogisticRegressionModel | None = None, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule (null without one), verdict and score (how likely the url is unwanted).

    Null urls and urls without ``://`` have an empty host and path, no rule, and the regression's verdict on both empty.
    Existing columns with these names are replaced.
    """
    model = model or learn(labelled_urls(pages.sparkSession))
    host, path = host_path(F.col(url))
    parts = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    scored = model.transform(_hashed(parts.withColumn("grams", _grams(F.col("host"), F.col("path")))))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    p = vector_to_array("probability")[1]
    rest = [F.col(f"row.`{c}`") for c in pages.columns if c not in OUT]
    return scored.select(*rest, "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(p >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), p.alias("score"))
