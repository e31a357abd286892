"""URL filter: rules first, character language models for the rest.

The longest rule that fits a URL decides it. All other URLs are judged by two
character models, one of the URLs that rules accept, one of those they reject:
Markov models of variable order (up to ``ORDER`` characters of context) with
Witten-Bell smoothing, in which a context trusts its own counts by how often it
was seen and hands the rest to the context one character shorter. A URL's score
is the difference of both log-likelihoods per character; the threshold is
calibrated on ruled URLs the models have not seen.

Everything is counted over all distinct URLs, so a URL in a third of the rows
counts once and its copies are combined before the shuffle. Windows of
``ORDER + 1`` characters are counted first; the counts of shorter contexts are
sums over them, and the probabilities are built level by level, one join of
distinct contexts each, so no common context gathers rows. The models stay
tables: they grow with the input and are never collected. Only the calibration
histogram comes to the driver, whose bins are bounded by the range of a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, prepare, staged

#: Characters of context, at most.
ORDER = 5
#: The shortest context hands over to equal shares of so many characters.
ALPHABET = 256
#: First hexadecimal digits of a URL's MD5 that keep a ruled URL for calibration (3 of 16).
CALIBRATE = "012"
#: Scores are whole millionths of a nat per character; a bin of the calibration has so many.
BIN = 1_000
START, END = "\u0002", "\u0003"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def parts(url: str) -> tuple[Column, Column, Column]:
    """Host, path and judged text (the URL with its host in lower case) of a URL column; never null."""
    rest = F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")
    there = F.coalesce(F.expr(f"locate('://', `{url}`) > 0"), F.lit(False))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, UPPER, LOWER)
    tail = rest.substr(F.length(raw) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    text = F.concat(F.expr(f"substring(`{url}`, 1, locate('://', `{url}`) + 2)"), host, tail)
    return (F.when(there, host).otherwise(""), F.when(there, path).otherwise(""),
            F.when(there, text).otherwise(F.coalesce(F.col(url), F.lit(""))))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits. A rule is (verdict, 'host/path')."""
    name = verdict = F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest comes last, so it is asked first
        h, p = _split(rule)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def windows(texts: DataFrame) -> DataFrame:
    """``(u, role, window)``: every character with the ORDER characters before it; an end mark closes each text."""
    chars = F.split(F.concat(F.lit(START * ORDER), "text", F.lit(END)), "")
    cut = F.transform(F.sequence(F.lit(1), F.size("chars") - ORDER), lambda i: F.array_join(F.slice("chars", i, ORDER + 1), ""))
    return texts.select("u", "role", chars.alias("chars")).select("u", "role", F.explode(cut).alias("window"))


def log_ratios(seen: DataFrame) -> DataFrame:
    """``(window, delta long)`` of every window of ``seen``: log of the accepted over the rejected model's probability.

    ``seen`` has (window, accepted, rejected): all windows to be scored with their training counts.
    """
    grams = seen.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(ORDER)), lambda j: F.struct(
        j.alias("level"), F.col("window").substr(F.lit(ORDER + 1) - j, j + 1).alias("gram")))).alias("g"), "accepted", "rejected") \
        .groupBy("g.level", "g.gram").agg(F.sum("accepted").alias("ca"), F.sum("rejected").alias("cr")) \
        .withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
    grams = staged(grams, "url-grams")
    totals = grams.groupBy("level", "context").agg(F.sum("ca").alias("na"), F.sum("cr").alias("nr"),
                                                   F.count_if(F.col("ca") > 0).alias("ta"), F.count_if(F.col("cr") > 0).alias("tr"))
    grams = staged(grams.join(totals, ["level", "context"]), "url-contexts")

    def smoothed(c: str, n: str, t: str, back: Column) -> Column:
        return F.when(F.col(n) > 0, (F.col(c) + F.col(t) * back) / (F.col(n) + F.col(t))).otherwise(back)

    p = None
    for level in range(ORDER + 1):
        at = grams.where(F.col("level") == level)
        if p is None:
            back_a = back_r = F.lit(1.0 / ALPHABET)
        else:
            at = at.withColumn("shorter", F.expr("substring(gram, 2)")).join(
                p.select(F.col("gram").alias("shorter"), F.col("pa").alias("ba"), F.col("pr").alias("br")), "shorter")
            back_a, back_r = F.col("ba"), F.col("br")
        p = at.select("gram", smoothed("ca", "na", "ta", back_a).alias("pa"), smoothed("cr", "nr", "tr", back_r).alias("pr"))
    delta = F.floor(1_000_000.0 * (F.ln("pa") - F.ln("pr")) + 0.5)
    return p.select(F.col("gram").alias("window"), delta.alias("delta"))


def threshold(scored: DataFrame) -> int:
    """The bin from which URLs are accepted: best balanced accuracy over ``(role, score)`` of the calibration URLs.

    Equally good bins: the one nearest to 0, then the lower. With one class alone: 0.
    """
    bins = scored.where("role in ('accepted-check', 'rejected-check')").groupBy(F.floor(F.col("score") / BIN).alias("bin")) \
        .agg(F.count_if(F.col("role") == "accepted-check").alias("a"), F.count_if(F.col("role") == "rejected-check").alias("r")) \
        .orderBy("bin").collect()
    all_a, all_r = sum(b["a"] for b in bins), sum(b["r"] for b in bins)
    if not all_a or not all_r:
        return 0
    best, over, under, past = None, all_a, 0, None
    for at, a, r in [*[(b["bin"], b["a"], b["r"]) for b in bins], (1 << 62, 0, 0)]:
        # every bin after the last one seen up to this one parts the URLs alike
        near = min(0, at) if past is None else max(past + 1, min(0, at))
        rank = (-(over * all_r + under * all_a), abs(near), near)
        best = min(best or rank, rank)
        over, under, past = over - a, under + r, at
    return best[2]


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """All rows of ``pages`` with ``host, path, rule, score, verdict`` (columns of these names are replaced).

    ``score`` is in millionths of a nat per character, null where a rule decides. A
    null URL counts as empty: no host, no path, judged as an empty text. Without a
    ruled URL of a class its model is uniform and the threshold 0. Repeated rows are
    judged alike; very long URLs are read whole; an empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    host, path, text = parts(url_col)
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "score", "verdict")]
    base = pages.select(F.struct(*own).alias("row"), host.alias("host"), path.alias("path"), text.alias("text"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("ruled", verdict)
    side = F.when(F.col("ruled") == "allow", "accepted").when(F.col("ruled") == "block", "rejected")
    check = F.substring(F.md5("text"), 1, 1).isin(*CALIBRATE)
    role = F.when(check, F.concat(side, F.lit("-check"))).otherwise(side)
    texts = base.groupBy("text").agg(F.first("ruled").alias("ruled")).select("text", role.alias("role"))
    texts = staged(texts.withColumn("u", F.monotonically_increasing_id()), "url-texts")
    cut = staged(windows(texts), "url-windows")
    seen = cut.groupBy("window").agg(F.count_if(F.col("role") == "accepted").alias("accepted"), F.count_if(F.col("role") == "rejected").alias("rejected"))
    ratios = broadcast_if_small(staged(log_ratios(seen), "url-model"), 64)
    asked = cut.where("role is null or role like '%-check'")
    sums = asked.join(ratios, "window").groupBy("u").agg(F.sum("delta").alias("sum"), F.count("*").alias("n"))
    scored = staged(texts.join(sums, "u").select("text", "role", F.floor(F.col("sum") / F.col("n")).alias("score")), "url-scores")
    least = threshold(scored) * BIN
    out = ["row.*", "host", "path", "rule", "score", "verdict"]
    by_rule = base.where("ruled is not null").withColumn("score", F.lit(None).cast("bigint")).withColumn("verdict", F.col("ruled"))
    by_model = base.where("ruled is null").join(scored.where("role is null").select("text", "score"), "text") \
        .withColumn("verdict", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return by_rule.select(*out).unionByName(by_model.select(*out))
