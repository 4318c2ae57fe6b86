"""URL filter: rules first, then the ratio of two character language models; DataFrame functions only.

A rule is a host and a path; it fits that host and its subdomains if the url's path starts with the rule's.
The longest fitting rule judges. Urls that rules allow train the model of accepted urls, those that rules
block the model of rejected ones. Both are variable-order Markov models over 32 symbol classes: the order-3
estimate is smoothed with the order-2 estimate, and so on down to the uniform one (Witten-Bell weights). A
url that no rule fits gets the mean, over its characters, of the log-likelihood difference. It is accepted
from a threshold on, calibrated half way between the mean scores of the accepted and of the rejected urls that were held
back (by the md5 of the url: three in sixteen). If one kind has none held back, its learnt ones stand in.

The counts are pre-aggregated per task; there are at most 32**4 different contexts with a symbol, whatever the
input, so the table of differences has a size bound (16 MB) and is broadcast.

Defined results. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
from there up to ``?``, ``#`` or the end. Null urls and urls without ``://`` have both empty, and no rule fits
them. An empty url scores 0. If either model has no url to learn from, the models don't differ, every score
is 0 and the method allows. Repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.shared import written

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

SYMBOLS, ORDER = 32, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: str = "url") -> tuple[Column, Column]:
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged(rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits the columns host and path, else null."""
    fits = [
        F.when(
            ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length: int, rule: string, verdict: string>")


def _held(url: Column) -> Column:
    """Urls for calibration, which no model learns from."""
    return F.substring(F.md5(F.coalesce(url, F.lit("")).cast("binary")), 1, 1).isin("0", "1", "2")


def _codes(url: Column) -> Column:
    """array<int>: for each character its symbol and the three before it, as one number in base 32 (0: before the start)."""
    chars = F.filter(F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), ""), lambda c: c != "")
    symbol = lambda c: (
        F.when(c.between("a", "z") & (F.length(c) == 1), F.ascii(c) - 96)
        .when(c.between("0", "9"), 27)
        .when(c == ".", 28)
        .when(c == "/", 29)
        .when(c == "-", 30)
        .otherwise(31)
    )
    # The symbols are bound once by the outer transform; a lambda's body is evaluated anew for each element.
    symbols = F.array(F.concat(F.array(*[F.lit(0)] * ORDER), F.transform(chars, symbol)))
    code = lambda s, i: sum((F.get(s, i - k) * SYMBOLS**k for k in range(1, ORDER + 1)), F.get(s, i))
    codes = F.transform(symbols, lambda s: F.when(F.size(s) > ORDER, F.transform(F.sequence(F.lit(ORDER), F.size(s) - 1), lambda i: code(s, i))).otherwise(F.array().cast("array<int>")))
    return F.element_at(codes, 1)


def differences(codes: DataFrame) -> DataFrame:
    """codes (code, verdict or null) -> code, diff: log P(accepted) - log P(rejected) of every code that occurs."""
    top = codes.groupBy("code").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    top = written(top, "codes")
    below = None
    for order in range(ORDER + 1):
        size = SYMBOLS ** (order + 1)
        level = top.groupBy((F.col("code") % size).alias("code")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = W.partitionBy(F.floor(F.col("code") / SYMBOLS))
        for m in "ab":
            level = level.withColumn(f"n{m}", F.sum(m).over(context)).withColumn(f"d{m}", F.count_if(F.col(m) > 0).over(context) + 1)
        if below is None:
            level = level.withColumn("qa", F.lit(1.0 / SYMBOLS)).withColumn("qb", F.lit(1.0 / SYMBOLS))
        else:
            shorter = below.select(F.col("code").alias("short"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            level = level.withColumn("short", F.col("code") % (size // SYMBOLS)).join(shorter, "short")
        below = level.select("code", *(((F.col(m) + F.col(f"d{m}") * F.col(f"q{m}")) / (F.col(f"n{m}") + F.col(f"d{m}"))).alias(f"p{m}") for m in "ab"))
    return below.select("code", (F.log("pa") - F.log("pb")).alias("diff"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score (the mean difference, also where a rule judges)."""
    host, path = host_path(url_col)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("u"), host.alias("host"), path.alias("path"))
    rows = written(rows.withColumn("by", judged(rules)).withColumn("held", _held(F.col("u"))), "urls")
    learnt = F.when(~F.col("held"), F.col("by.verdict"))
    codes = rows.select("row", learnt.alias("verdict"), F.explode(_codes(F.col("u"))).alias("code"))
    known = rows.agg(F.count_if(learnt == "allow"), F.count_if(learnt == "block")).first()
    if not known[0] or not known[1]:
        return rows.select("id", "host", "path", "by.rule", F.coalesce("by.verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    diff = written(differences(codes.select("code", "verdict")), "differences")
    sums = codes.join(F.broadcast(diff), "code").groupBy("row").agg(F.avg("diff").alias("score"))
    scored = written(rows.drop("u").join(sums, "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "scores")
    mean = lambda verdict: F.coalesce(*(F.avg(F.when((F.col("by.verdict") == verdict) & (F.col("held") == held), F.col("score"))) for held in (True, False)))
    least = scored.agg((mean("allow") + mean("block")) / 2).first()[0]
    method = F.when(F.col("score") >= F.lit(least), "allow").otherwise("block")
    return scored.select("id", "host", "path", "by.rule", F.coalesce("by.verdict", method).alias("verdict"), "score")
