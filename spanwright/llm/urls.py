"""URL filter, with DataFrame functions only: rules, and a ratio of two character language models.

Two variable-order Markov models are counted, one on accepted and one on rejected URLs. The chance
of a character after up to four others is that of the longest context that was seen, smoothed by the
next shorter one in proportion to how many different characters followed (Witten and Bell). A URL's
score is the mean log ratio of both chances over its characters. The threshold is calibrated on
URLs kept apart from counting: it parts their labels best.

All URLs are counted. The model keeps its MODEL_ROWS most frequent runs of characters, whatever the
input's size, so it can be broadcast and URLs are scored where they stand; a rarer run is scored by
the longest end of it that is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanwright.llm.common import fold, row_key
from spanwright.operators.skew import even_join
from spanwright.session import Tables, with_checkpoints

ORDER = 4
#: Chance of a character that was never seen.
FLOOR = 1 / 256
#: Rules of the query: verdict by host and beginning of the path.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Words of hosts, between dots and hyphens, that mark a URL as rejected where no labels are given.
SEEDS = "casino|slots?|bets?|betting|poker|jackpot|pills?|viagra|cialis|adult|porn|sex|xxx|spam|warez|crack|torrent|ads?|track|tracker|clicks?|loans?|cheap"
#: So many runs, each of ORDER + 1 characters, are broadcast; a larger model is joined by its runs. Scores are the same.
MODEL_ROWS = 400_000
#: Bins of scores for the threshold, a hundredth wide, to each side of 0.
BINS = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is the URL's or a parent of it, and whose path begins the URL's; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, path_start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + path_start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == name, verdict).otherwise(out)
    return out


def _grams(df: DataFrame) -> DataFrame:
    """``df`` with ``gram``: each character of the URL, and its end, after ORDER others."""
    padded = F.concat(F.lit("^" * ORDER), F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER), F.lit("\n"))
    chars = F.split(padded, "")
    # Shifted copies laid side by side: each is made once for a URL, so the work grows with its length
    shifted = lambda k: F.slice(chars, F.lit(k + 1), F.size(chars) - ORDER)
    grams = shifted(0)
    for k in range(1, ORDER + 1):
        grams = F.zip_with(grams, shifted(k), lambda run, c: F.concat(run, c))
    df = df.withColumn("grams", grams)
    return df.select("*", F.explode("grams").alias("gram")).drop("grams")


def model(labelled: DataFrame) -> DataFrame:
    """``gram, n, ratio``: occurrences and the log ratio of the two models for every run of ORDER + 1 characters.

    ``labelled`` has ``url`` and ``weight``: 1 for accepted URLs, -1 for rejected ones, 0 for those
    that are not counted but whose runs must be known.
    """
    counts = _grams(labelled).groupBy("gram").agg(F.count_if(F.col("weight") == 1).alias("a"), F.count_if(F.col("weight") == -1).alias("r"), F.count("*").alias("n")).checkpoint()
    chance = None
    for k in range(1, ORDER + 2):
        grams = counts.groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(*(F.sum(c).alias(c) for c in "arn"))
        grams = grams.withColumn("context", F.left("gram", F.lit(k - 1))).withColumn("shorter", F.right("gram", F.lit(k - 1)))
        after = grams.groupBy("context").agg(*(f(x).alias(n) for x in "ar" for f, n in ((F.sum, f"n_{x}"), (lambda c: F.count_if(F.col(c) > 0), f"t_{x}"))))
        grams = grams.join(after, "context")
        if chance is None:
            grams = grams.withColumns({"p_a": F.lit(FLOOR), "p_r": F.lit(FLOOR)})
        else:
            grams = grams.join(chance.select(F.col("gram").alias("shorter"), "p_a", "p_r"), "shorter")
        p = lambda x: F.when(F.col(f"n_{x}") > 0, (F.col(x) + F.col(f"t_{x}") * F.col(f"p_{x}")) / (F.col(f"n_{x}") + F.col(f"t_{x}"))).otherwise(F.col(f"p_{x}"))
        chance = grams.select("gram", "n", p("a").alias("p_a"), p("r").alias("p_r")).checkpoint()
    return chance.select("gram", "n", (F.log("p_a") - F.log("p_r")).alias("ratio"))


def scores(pages: DataFrame, ratios: DataFrame) -> DataFrame:
    """``page_id, url, score`` of each row of ``page_id, url``: the mean log ratio of its characters."""
    key = row_key(F.col("page_id"), F.col("url"))
    met = _grams(pages.select(key.alias("key"), "url")).drop("url")  # a row of a character carries no URL
    if ratios.count() <= MODEL_ROWS:
        met = met.join(F.broadcast(ratios.drop("n")), "gram")
    else:
        met = even_join(Tables(pages.sparkSession).keep(met), ratios.drop("n"), ["gram"], counts=ratios.select("gram", "n"))
    per = met.groupBy("key").agg(F.avg("ratio").alias("score"))
    return pages.withColumn("key", key).join(per, "key").drop("key")


def threshold(scored: DataFrame) -> float:
    """The score that parts accepted (``weight`` 1) from rejected (-1) rows best; 0 without both."""
    step = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.round(F.col("score") * 100).cast("int")))
    bins = scored.groupBy(step.alias("bin")).agg(F.count_if(F.col("weight") == 1).alias("a"), F.count_if(F.col("weight") == -1).alias("r"))
    below = W.orderBy("bin")  # bounded: a row for each bin
    all_a, all_r = F.sum("a").over(W.partitionBy()), F.sum("r").over(W.partitionBy())
    gain = F.try_divide(F.sum("r").over(below), all_r) - F.try_divide(F.sum("a").over(below), all_a)
    best = bins.select("bin", gain.alias("gain")).where(F.col("gain").isNotNull()).orderBy(F.desc("gain"), F.abs("bin"), "bin").limit(1).collect()
    return (best[0]["bin"] + 0.5) / 100 if best and best[0]["gain"] > 0 else 0.0


def judged(pages: DataFrame, rules: dict[str, str] = RULES, rejected: Column | None = None, id_col: str = "page_id", url_col: str = "url", folds: int = 5) -> DataFrame:
    """The verdict on every URL: the longest fitting rule's, else the models'.

    ``rejected`` says which URLs count as rejected, as a column over ``page_id`` and ``url``; null
    says nothing, and such a URL is not counted. By default these are URLs that a rule blocks and
    those of no rule whose host has a word of SEEDS; all others count as accepted. One fold of
    ``folds`` by crc32(id) is left for calibration. Returns one row per input row: ``page_id, host,
    path, rule, verdict, score``. Null URLs and those without ``://`` have an empty host and path
    and are scored as they stand. Repeated rows each give their row; other columns are not read,
    whatever their names; an empty table gives an empty result.
    """
    with_checkpoints(pages.sparkSession)
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    if rejected is None:
        decided = verdict_of(rule_for(host, path, rules), rules)
        rejected = F.coalesce((decided == "block") | (decided.isNull() & host.rlike(rf"(?:^|[.-])(?:{SEEDS})(?:[.-]|$)")), F.lit(False))
    label = F.when(rejected, -1).when(~rejected, 1).otherwise(0)
    apart = fold(F.col("page_id"), folds) == 0
    ratios = model(pages.select("url", F.when(apart, 0).otherwise(label).alias("weight")))
    scored = scores(pages, ratios).checkpoint()
    cut = threshold(scored.where(apart).withColumn("weight", label))
    out = scored.withColumn("host", host).withColumn("path", path)
    out = out.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    model_says = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), model_says).alias("verdict"), "score")
