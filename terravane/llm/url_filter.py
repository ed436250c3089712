"""URL filter: host and path rules first, then a character language-model ratio; DataFrame operations only.

Two smoothed variable-order Markov models over characters, one of the urls
that the rules allow and one of those that they block, judge the rest. A
model's probability of a character is interpolated over context lengths 0 to
``ORDER`` by Witten-Bell weights: the more different characters have followed a
context, the more weight goes to the next shorter one, and an unseen context
passes everything down. The score of a url is the difference of its two log
probabilities over its length; the threshold is calibrated on a fifth of the
judged urls that the models have not seen, where the two classes' score
distributions (as normal ones) meet between their means.

Counts are kept for each distinct string of ``ORDER + 1`` characters, summed
before they are shuffled, and each distinct string is scored once. Digits count
as one character, and A-Z are lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import Scratch, ascii_lower, crc_mod

ORDER = 4
_PAD = "\u0002" * ORDER
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Size of the alphabet that an unseen character is drawn from.
ALPHABET = 256.0


@dataclass(frozen=True)
class Rule:
    """``action`` is allow or block, for a host with its subdomains and paths that start with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    """What stands between the first :// and the next slash, question mark or hash; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host, up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def best_rule(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits columns host and path; null if none does.

    Of rules of one length the one with the longer host wins, then the one that blocks.
    """
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.action == "block")):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, action = F.when(fits, F.lit(r.text)).otherwise(name), F.when(fits, F.lit(r.action)).otherwise(action)
    return name, action


def _grams(urls: DataFrame) -> DataFrame:
    """A row for each character of each url: the character with the ORDER before it."""
    text = F.concat(F.lit(_PAD), F.regexp_replace(ascii_lower(F.col("url")), r"[0-9]", "0"))
    spread = urls.withColumn("_t", text).where(F.length("_t") > ORDER)
    return spread.select("*", F.explode(F.sequence(F.lit(1), F.length("_t") - ORDER)).alias("_i")).select(
        *urls.columns, F.substring(F.col("_t"), F.col("_i"), F.lit(ORDER + 1)).alias("gram")
    )


def _scored(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, llr): the log ratio of its last character's two probabilities after the others."""
    out = wanted.select("gram", F.lit(1 / ALPHABET).alias("p_a"), F.lit(1 / ALPHABET).alias("p_b"))
    for k in range(ORDER + 1):
        seen = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("_s")).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
        after = seen.groupBy(F.substring("_s", 1, k).alias("_c")).agg(
            *[F.sum(f"n_{x}").alias(f"t_{x}") for x in "ab"], *[F.count(F.when(F.col(f"n_{x}") > 0, 1)).alias(f"d_{x}") for x in "ab"]
        )
        out = out.withColumn("_s", F.substring("gram", ORDER + 1 - k, k + 1)).withColumn("_c", F.substring("_s", 1, k))
        out = out.join(seen, "_s", "left").join(after, "_c", "left")
        p = {
            x: F.when(F.col(f"t_{x}") > 0, (F.coalesce(F.col(f"n_{x}"), F.lit(0)) + F.col(f"d_{x}") * F.col(f"p_{x}")) / (F.col(f"t_{x}") + F.col(f"d_{x}"))).otherwise(F.col(f"p_{x}"))
            for x in "ab"
        }
        out = out.select("gram", p["a"].alias("p_a"), p["b"].alias("p_b"))
    return out.select("gram", F.log(F.col("p_a") / F.col("p_b")).alias("llr"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and llr for each row of ``pages`` (page_id, url).

    A null url has an empty host and path and, like an empty one, a score of 0;
    repeated rows are each returned; a very long url is scored whole; if the rules judge no url of one class the
    threshold is 0; other columns are ignored; an empty table gives an empty
    result. The threshold falls on the allowed side: a score equal to it is
    allowed.
    """
    scratch = Scratch(pages.sparkSession)
    name, action = best_rule(rules)
    base = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    base = scratch.keep(base.select("page_id", "url", "host", "path", name.alias("rule"), action.alias("action")), "base")
    texts = base.where("url is not null").groupBy("url").agg(F.first("action").alias("action"), F.count("*").alias("times"))
    texts = texts.withColumn("fold", crc_mod(F.col("url"), 5))
    grams = _grams(texts)
    table = grams.groupBy("gram").agg(
        *[F.sum(F.when((F.col("action") == act) & (F.col("fold") != 0), F.col("times")).otherwise(0)).alias(x) for x, act in (("a", "allow"), ("b", "block"))]
    )
    table = scratch.keep(table, "grams")
    model = scratch.keep(_scored(table, table.where("a + b > 0")), "model")
    scores = _grams(texts.where("action is null or fold = 0")).join(model, "gram").groupBy("url").agg(F.avg("llr").alias("llr"))
    scores = scratch.keep(scores.select("url", F.round("llr", 9).alias("llr")), "scores")
    held = scores.join(texts.where("action is not null and fold = 0").select("url", "action"), "url")
    fit = held.agg(*[f(F.when(F.col("action") == act, F.col("llr"))).alias(x) for act in ("allow", "block") for x, f in ((f"m_{act}", F.avg), (f"s_{act}", F.stddev_pop))]).first()
    threshold = _threshold(*[fit[x] for x in ("m_allow", "s_allow", "m_block", "s_block")])
    fetched = base.join(scores.withColumnRenamed("url", "_u"), F.col("url") == F.col("_u"), "left")
    by_model = F.when(F.coalesce(F.col("llr"), F.lit(0.0)) >= F.lit(threshold), "allow").otherwise("block")
    return fetched.select("page_id", "host", "path", "rule", F.coalesce("action", by_model).alias("verdict"), F.when(F.col("action").isNull(), F.coalesce("llr", F.lit(0.0))).alias("llr"))


def _threshold(m_a: float | None, s_a: float | None, m_b: float | None, s_b: float | None) -> float:
    """Between the means, nearer to the narrower class; 0 without both classes."""
    if m_a is None or m_b is None:
        return 0.0
    spread = (s_a or 0.0) + (s_b or 0.0)
    return round((m_a * s_b + m_b * s_a) / spread if spread else (m_a + m_b) / 2, 9)
