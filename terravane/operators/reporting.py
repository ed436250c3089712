"""The regulatory class report and its reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import columns as C
from terravane.operators.risk import class_summary

TOTAL = "合计"
EPS_BALANCE, EPS_SHARE = 0.01, 0.0001


def checked(rows: DataFrame) -> DataFrame:
    """``rows``, failing when one has a class that the report does not know."""
    known = F.col("risk_class").isin(*C.CLASSES)
    return rows.withColumn("risk_class", F.when(F.coalesce(known, F.lit(False)), F.col("risk_class")).otherwise(F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce("risk_class", F.lit("null"))))))


def report(detail: DataFrame) -> DataFrame:
    """Five classes and a total, by loan count, balance and share."""
    five = class_summary(checked(detail))
    every = Window.partitionBy(F.lit(1))  # the five rows
    summed = five.withColumns({"_n": F.sum("loan_count").over(every), "_b": F.sum(F.col("balance").cast("decimal(18,2)")).over(every).cast("double")})
    own = F.struct("risk_class", "class_rank", "loan_count", "balance", "balance_pct", F.lit(0).alias("is_total"))
    total = F.struct(
        F.lit(TOTAL).alias("risk_class"), F.lit(9).alias("class_rank"), F.col("_n").alias("loan_count"), F.col("_b").alias("balance"), F.when(F.col("_b") != 0, 1.0).otherwise(0.0).alias("balance_pct"), F.lit(1).alias("is_total")
    )
    return summed.select(F.inline(F.when(F.col("class_rank") == 0, F.array(own, total)).otherwise(F.array(own))))


def rebuilt(stored: DataFrame, detail: DataFrame, day: str) -> DataFrame:
    """The stored report with the day's rows made anew from the detail; other days stay."""
    return stored.where(F.col("stat_date") != day).unionByName(detail.withColumn("stat_date", F.lit(day)), allowMissingColumns=True)


def _apart(x, y, eps: float):
    """Whether two figures differ by more than ``eps``; what their doubles cannot tell apart, a millionth at least, counts as none."""
    return F.abs(x - y) - eps > F.greatest(F.lit(5e-7), (F.abs(x) + F.abs(y)) * 2.0**-52)


def reconcile(template: DataFrame, internal: DataFrame, detail: DataFrame) -> DataFrame:
    """One row for each failed check between the report, the stored summary and the detail's own sums."""
    three = None
    for name, df in (("t", template.where("is_total = 0") if "is_total" in template.columns else template), ("i", internal), ("d", detail)):
        part = df.select("risk_class", *[F.col(c).alias(f"{name}_{c}") for c in ("loan_count", "balance", "balance_pct")])
        three = part if three is None else three.join(part, "risk_class", "full")

    def check(a: str, b: str, what: str, label: str):
        x, y = (F.coalesce(F.col(f"{s}_{what}"), F.lit(0.0)) for s in (a, b))
        eps = {"loan_count": 0.0, "balance": EPS_BALANCE, "balance_pct": EPS_SHARE}[what]
        return F.when(_apart(x, y, eps), F.concat(F.lit(label + ":"), F.col("risk_class"), F.lit(":" + what)))

    checks = [check("t", "i", w, "report_vs_summary") for w in ("loan_count", "balance")]
    checks += [check("t", "d", w, "report_vs_detail") for w in ("loan_count", "balance", "balance_pct")]
    checks += [check("d", "i", w, "detail_vs_summary") for w in ("loan_count", "balance")]
    by_class = three.select(F.explode(F.array_compact(F.array(*checks))).alias("mismatch"))
    sums = three.agg(*[C.money(F.col(f"{s}_balance")).alias(s) for s in "id"], F.sum("t_balance_pct").alias("p"))
    whole = F.array_compact(
        F.array(
            F.when(_apart(F.col("i"), F.col("d"), EPS_BALANCE), "detail_vs_summary:total:balance"),
            F.when((F.col("i") > 0) & _apart(F.col("p"), F.lit(1.0), EPS_SHARE), "report:shares:balance_pct"),
        )
    )
    return by_class.unionByName(sums.select(F.explode(whole).alias("mismatch")))
