"""URL filtering by rules and, where none fits, by the ratio of two character language models.

Both models are variable-order Markov models: a character's probability after the three before it is interpolated, by
Witten-Bell weights, with that after two, after one, after none, and with the uniform one. They are counted on the URLs that
rules accept and reject. A URL's score is the difference of its log-likelihoods over its length; the threshold is the one
that splits held-out ruled URLs best. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import table, written

#: (verdict, host, path): a rule fits its host, all subdomains, and the paths that start with its own.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Characters that a character's probability depends on, itself included.
ORDER = 4
#: Characters that stand before the first one.
START = "\x02" * (ORDER - 1)
#: The uniform distribution is over so many characters.
ALPHABET = 256
#: Copies of each entry of the models, so that the places of a frequent one are joined by several tasks.
SALTS = 16
#: One in so many ruled URLs is kept for the calibration.
CALIBRATION = 4
#: The threshold is a multiple of this.
STEP = 0.01


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def places(urls: DataFrame) -> DataFrame:
    """(url, ...) -> the rows repeated for each character of the URL, with gram, the character after the three before it."""
    some = urls.filter(F.char_length("url") > 0)
    at = some.select("*", F.explode(F.sequence(F.lit(1), F.char_length("url"))).alias("at"))
    return at.withColumn("gram", F.substr(F.concat(F.lit(START), F.col("url")), F.col("at"), F.lit(ORDER))).drop("at")


def counts(training: DataFrame) -> DataFrame:
    """(url, accepted) -> (gram, a, r): how often each place occurs in accepted and in rejected URLs. Equal URLs are cut up once."""
    once = training.groupBy("url", "accepted").agg(F.count("*").alias("n"))
    of = {name: F.sum(F.when(kind, F.col("n")).otherwise(0)).alias(name) for name, kind in (("a", F.col("accepted")), ("r", ~F.col("accepted")))}
    return places(once).groupBy("gram").agg(*of.values())


def _levels(seen: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, a, r), and for each context (context, its counts, its distinct followers), in both models."""
    out = []
    for order in range(1, ORDER + 1):
        grams = seen.groupBy(F.right("gram", F.lit(order)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        contexts = grams.groupBy(F.substr(F.col("gram"), F.lit(1), F.lit(order - 1)).alias("context")).agg(
            F.sum("a").alias("n_a"), F.sum("r").alias("n_r"), F.count_if(F.col("a") > 0).alias("t_a"), F.count_if(F.col("r") > 0).alias("t_r")
        )
        out.append((grams, contexts))
    return out


def log_ratios(asked: DataFrame, seen: DataFrame) -> DataFrame:
    """(gram) -> (gram, log_ratio): the logarithm of the accepted over the rejected probability of each distinct place asked for."""
    wanted = asked
    for one in ("p_a", "p_r"):
        wanted = wanted.withColumn(one, F.lit(1.0 / ALPHABET))
    for order, (grams, contexts) in enumerate(_levels(seen), 1):
        named = wanted.withColumn("_gram", F.right("gram", F.lit(order))).withColumn("_context", F.substr(F.col("_gram"), F.lit(1), F.lit(order - 1)))
        named = named.join(grams.withColumnRenamed("gram", "_gram"), "_gram", "left").join(contexts.withColumnRenamed("context", "_context"), "_context", "left")
        for one in ("a", "r"):
            n, t, c = (F.coalesce(F.col(x), F.lit(0)) for x in (f"n_{one}", f"t_{one}", one))
            lower = F.col(f"p_{one}")
            named = named.withColumn(f"q_{one}", F.when(n + t > 0, (c + t * lower) / (n + t)).otherwise(lower))
        wanted = named.select("gram", F.col("q_a").alias("p_a"), F.col("q_r").alias("p_r"))
    return wanted.select("gram", (F.log("p_a") - F.log("p_r")).alias("log_ratio"))


def url_scores(urls: DataFrame, seen: DataFrame) -> DataFrame:
    """(url) -> (url, score), a row for each distinct one: the mean log ratio over its characters; URLs without any are missing."""
    spots = places(urls.select("url").distinct()).withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    model = log_ratios(spots.select("gram").distinct(), seen)
    salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spots.join(salted, ["gram", "salt"]).groupBy("url").agg(F.avg("log_ratio").alias("score"))


def scores(urls: DataFrame, seen: DataFrame) -> DataFrame:
    """(url, ...) -> the rows with their URL's score; those whose URL has no characters are missing."""
    return urls.join(url_scores(urls, seen), "url")


def threshold(scored: DataFrame) -> float:
    """(accepted, score) -> the multiple of STEP at which the shares of both kinds that it gets right add up to most.

    The scores come to the driver as counts in steps, at most a few thousand.
    """
    steps = scored.groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(
        F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r")
    )
    found = sorted((r["step"], r["a"], r["r"]) for r in steps.collect())
    n_a, n_r = sum(a for _, a, _ in found), sum(r for _, _, r in found)
    if not n_a or not n_r:
        return 0.0
    best, at, below_a, below_r = -1.0, 0.0, 0, 0
    for step, a, r in found:
        if (right := (n_a - below_a) / n_a + below_r / n_r) > best:
            best, at = right, step * STEP
        below_a, below_r = below_a + a, below_r + r
    return at


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, url) -> (page_id, host, path, rule, verdict, score), one row for each page.

    The rules' verdict where one fits, else allow if the score reaches the threshold. Null URLs and those without ``://``
    have an empty host and path, fit no rule and are scored as they are; a null or empty one scores 0. A page is scored by its
    URL alone, so that repeated and null ids change nothing. Of rules of the same length that fit, the one that is listed last
    counts. Where the rules accept none or reject none, the models are even and the threshold is 0.
    """
    read = pages.select("page_id", F.col("url").cast("string").alias("url"))
    ruled = read.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("_found", rule_of(F.col("host"), F.col("path"), rules))
    ruled = written(ruled, "urls")
    given = ruled.filter("_found is not null and url is not null").select("url", (F.col("_found.verdict") == "allow").alias("accepted"))
    kept = F.pmod(F.xxhash64("url"), F.lit(CALIBRATION)) == 0
    seen = written(counts(given.filter(~kept)), "url-grams")
    least = threshold(scores(given.filter(kept), seen))
    free = url_scores(ruled.filter("_found is null and url is not null"), seen)
    score = F.coalesce("score", F.lit(0.0))
    verdict = F.coalesce("_found.verdict", F.when(score >= least, "allow").otherwise("block"))
    out = ruled.join(free, "url", "left")
    return out.select("page_id", "host", "path", F.col("_found.rule").alias("rule"), verdict.alias("verdict"), "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
