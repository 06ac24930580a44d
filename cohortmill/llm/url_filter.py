"""URL filter: host and path rules, then a ratio of two character language models.

The models are variable-order Markov chains over the characters of the URLs that the rules
accept and reject. The probability of a character blends the counts after the longest known
context with those after ever shorter ones (Witten-Bell weights), so a context that a model has
never seen costs nothing and falls back to a shorter one. A URL's score is its log-likelihood
under the accepting model minus that under the rejecting one, divided by its length; the
threshold is calibrated on URLs that trained neither model.

Everything is DataFrame code: URLs are cut into four-character windows, window counts give all
shorter contexts by further sums, and a URL is scored by joining its windows with one table of
log ratios. Log ratios are whole micro-nats, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.common import partitions, stored
from cohortmill.session import broadcast_if_small

ORDER = 4
TASK_CHARS, MOST_CHARS = 250_000, 64_000_000  # characters a task, for few and for many URLs
START, END = "\u0002", "\u0003"
ALPHABET = 256.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(url)), r"\A[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct of its text and action, or null."""
    best = F.lit(None).cast("struct<rule:string,action:string>")
    for rule_host, rule_path, action in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"),
                                     F.lit(action).alias("action"))).otherwise(best)
    return best


def windows(url: Column) -> Column:
    """Each character of the URL, and its end, with the three characters before it. The characters
    are cut once and zipped with themselves, so a long URL costs no more than its length."""
    letters = F.concat(F.array(*[F.lit(START)] * (ORDER - 1)), F.filter(F.split(url, ""), lambda c: c != ""), F.array(F.lit(END)))
    shifted = [F.slice(letters, i + 1, F.size(letters) - ORDER + 1).alias(f"c{i}") for i in range(ORDER)]
    return F.transform(F.arrays_zip(*shifted), lambda w: F.concat(*[w[f"c{i}"] for i in range(ORDER)]))


def numbered(texts: DataFrame) -> DataFrame:
    """The texts with a number each, stored in parts of like length in characters: windows multiply
    them and carry the number alone."""
    chars = texts.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    parts = min(max(chars // TASK_CHARS, 1), max(partitions(texts.sparkSession), chars // MOST_CHARS))
    return stored(texts.repartition(int(parts)).withColumn("number", F.monotonically_increasing_id()), "urls")


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log of accepted over rejected probability, in micro-nats.

    ``counts`` has one row per window with its counts ``a`` and ``b`` in the two training sets.
    """
    grams = {ORDER: counts.select("gram", "a", "b")}
    for n in range(ORDER - 1, 0, -1):
        grams[n] = grams[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = grams[1].agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    known = grams[1].select("gram", ((F.col("a") + 1) / (a + ALPHABET)).alias("pa"),
                            ((F.col("b") + 1) / (b + ALPHABET)).alias("pb"))
    for n in range(2, ORDER + 1):
        context = grams[n].groupBy(F.substring("gram", 1, n - 1).alias("context")).agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"),
            F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"))

        def blend(count, total, kinds, shorter):
            return F.when(F.col(total) == 0, F.col(shorter)).otherwise(
                (F.col(count) + F.col(kinds) * F.col(shorter)) / (F.col(total) + F.col(kinds)))

        known = (grams[n].withColumn("context", F.substring("gram", 1, n - 1))
                 .withColumn("tail", F.substring("gram", 2, n - 1))
                 .join(context, "context")
                 .join(known.withColumnRenamed("gram", "tail"), "tail")
                 .select("gram", blend("a", "na", "ta", "pa").alias("pa"),
                         blend("b", "nb", "tb", "pb").alias("pb")))
    return known.select("gram", F.round(F.log(F.col("pa") / F.col("pb")) * 1e6).cast("long")
                        .alias("ratio"))


def calibrated(scores: DataFrame) -> int:
    """The lowest per-character score, in thousandths of a nat, that counts as accepted.

    ``scores`` has ``level`` (whole thousandths) and ``accepted``. Of all levels the one with the
    largest difference of accepted and rejected shares at or above it wins, ties to the lowest, and
    the threshold lies halfway between it and the next lower level that occurs. Zero when either kind is missing. Levels are few: the log ratios are bounded.
    """
    levels = scores.groupBy("level").agg(F.count_if("accepted").alias("a"),
                                         F.count_if(~F.col("accepted")).alias("b"))
    totals = levels.agg(F.sum("a"), F.sum("b")).first()
    if not totals[0] or not totals[1]:
        return 0
    above = "over (order by level desc)"
    return levels.select("level", F.expr(
        f"cast(sum(a) {above} as double) / {totals[0]} - cast(sum(b) {above} as double) / {totals[1]}"
    ).alias("gain"), F.expr(f"floor((level + coalesce(lead(level) {above}, level)) / 2.0)").alias("cut")
    ).orderBy(F.desc(F.round("gain", 9)), "level").first()["cut"]


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score (milli-nats a character), threshold and verdict.

    Columns of these names are replaced. A null URL counts as empty for the model. Equal URLs
    get equal results. Without accepted or without rejected URLs every score is compared with
    zero; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    ruled = pages.withColumn("host", host).withColumn("path", path)
    chosen = rule_of(F.col("host"), F.col("path"), rules)
    texts = (ruled.select(F.coalesce(F.col(url), F.lit("")).alias("text"),
                          chosen["action"].alias("action"))
             .groupBy("text", "action").agg(F.count("*").alias("n"))
             .withColumn("trains", F.substring(F.md5("text"), 1, 1).isin(*"0123456789ab")))
    texts = numbered(stored(texts, "urls"))
    grams = texts.select("number", "action", "trains", "n", F.explode(windows(F.col("text"))).alias("gram"))

    def trained(action):
        return F.sum(F.when(F.col("trains") & (F.col("action") == action), F.col("n")).otherwise(0))

    counts = stored(grams.groupBy("gram").agg(trained("allow").alias("a"), trained("block").alias("b")),
                    "grams")
    ratios = broadcast_if_small(log_ratios(counts))
    totals = grams.select("number", "gram").join(ratios, "gram").groupBy("number").agg(F.sum("ratio").alias("total"))
    scored = stored(texts.join(totals, "number").select("text", "action", "trains", F.floor(
        F.col("total") / (F.length("text") + 1) / 1000).cast("long").alias("score")), "scores")
    held = (scored.where(~F.col("trains") & F.col("action").isNotNull())
            .select(F.col("score").alias("level"), (F.col("action") == "allow").alias("accepted")))
    threshold = calibrated(held)
    judged = (ruled.withColumn("text__", F.coalesce(F.col(url), F.lit("")))
              .join(broadcast_if_small(scored.select(F.col("text").alias("text__"), F.col("score").alias("score__"))),
                    "text__", "left")
              .withColumn("rule__", chosen))
    verdict = F.coalesce(F.col("rule__.action"),
                         F.when(F.col("score__") >= threshold, "allow").otherwise("block"))
    return (judged.withColumns({"rule": F.col("rule__.rule"), "verdict": verdict,
                                "score": F.col("score__"), "threshold": F.lit(threshold).cast("long")})
            .drop("text__", "score__", "rule__"))
