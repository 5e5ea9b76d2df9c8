"""Findings that a handler's own checks answer are withheld, each with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import compact
from lodestone.lang.ir import Program

NEVER = ("unchecked-arithmetic", "pda-validation-gap")
BY_ACCESS_CONTROL = ("missing-signer", "missing-authority-binding")


def _has(text: Column, *needle: Column | str, bounded: bool = False) -> Column:
    """Whether a text has a needle that does not begin inside an identifier (nor end in one, if bounded)."""
    quoted = F.concat(*[F.lit(n) if isinstance(n, str) else n for n in needle])
    return F.rlike(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), quoted, F.lit(r"\E" + (r"(?![A-Za-z0-9_])" if bounded else ""))))


def _equals_key(text: Column, name: Column) -> Column:
    """Whether a chain that begins with the name is compared for equality with a key, on either side."""
    left = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), name, F.lit(r"\E\.[A-Za-z0-9_.]*==[A-Za-z0-9_.]*\.key\(\)"))
    right = F.concat(F.lit(r"\.key\(\)==(?:[A-Za-z0-9_.]*(?<![A-Za-z0-9_]))?\Q"), name, F.lit(r"\E\."))
    return F.rlike(text, left) | F.rlike(text, right)


def apply(p: Program, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed): a named check answers by its class's idiom; access control answers for authority."""
    checks = p.handlers.select("program", F.col("name").alias("handler"), F.posexplode("checks").alias("ix", "c")).select("program", "handler", "ix", "c.kind", "c.idents", compact(F.col("c.text")).alias("t"), F.col("c.line").alias("check_line"))
    guarded = checks.where("kind = 'AccessControl'").select("program", "handler").distinct().withColumn("guarded", F.lit(True))
    open_ = findings.where(~F.col("class").isin(*NEVER))
    pairs = open_.where("account is not null").select("program", "handler", "class", "id", "account").join(checks.where("kind <> 'AccessControl'"), ["program", "handler"]).where(F.array_contains("idents", F.col("account")))
    a, t = F.col("account"), F.col("t")
    key = _has(t, a, ".key()") | ((F.col("kind") == "RequireKeysEq") & _has(t, a, ".")) | _equals_key(t, a)
    owner = _has(t, "accounts.", a, ".owner") | _has(t, "accounts.", a, ".key", bounded=True) | key
    idiom = F.when(F.col("class") == "missing-signer", _has(t, a, ".is_signer")).when(F.col("class") == "missing-owner-check", owner).when(F.col("class") == "missing-authority-binding", key).otherwise(False)
    first = pairs.where(idiom).groupBy("program", "handler", "class", "id").agg(F.min(F.struct("ix", "kind", "check_line")).alias("by"))
    j = open_.join(first, ["program", "handler", "class", "id"], "left").join(guarded, ["program", "handler"], "left")
    named = F.concat(F.lit("a "), "by.kind", F.lit(" check on line "), F.col("by.check_line").cast("string"), F.lit(" refers to `"), "account", F.lit("`"))
    by_guard = F.when(F.col("class").isin(*BY_ACCESS_CONTROL) & F.col("guarded"), F.lit("the handler carries access control, which may validate the authority"))
    j = j.withColumn("reason", F.when(F.col("by").isNotNull(), named).otherwise(by_guard)).drop("by", "guarded")
    kept = j.where("reason is null").drop("reason").unionByName(findings.where(F.col("class").isin(*NEVER)))
    return kept, j.where("reason is not null")
