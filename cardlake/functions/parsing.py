"""Small scalars over answers and scores, as Column expressions. Prompts and answers are read in ``prompts``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def strip_code_fence(c: Column) -> Column:
    """Text without an opening ``` line and a closing fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[^\n]*\n", ""), r"\n?```\s*$", ""))


def confidence(v: Column) -> Column:
    """Confidence as a share: 0.8, "0.8" and "80%" agree; anything else is null."""
    t = F.try_variant_get(v, "$.confidence", "string")
    pct = F.regexp_extract(t, r"^\s*(\d+(?:\.\d+)?)\s*%\s*$", 1)
    return F.when(pct != "", pct.try_cast("double") / 100).otherwise(t.try_cast("double"))


def size_category(n: Column) -> Column:
    return F.when(n < 1000, "n<1K").when(n < 10_000, "1K<n<10K").when(n < 100_000, "10K<n<100K").when(n < 1_000_000, "100K<n<1M").otherwise("n>1M")


def log1mexp(a: Column) -> Column:
    """log(1 - e^a) for a < 0, stable on both ends."""
    return F.when(a > -0.6931471805599453, F.log(-F.expm1(a))).otherwise(F.log1p(-F.exp(a)))


def odds_ratio_loss(chosen: Column, rejected: Column, beta: float) -> Column:
    """Preference loss from two mean log-probabilities: -chosen + beta * softplus(-(log odds difference))."""
    cl = lambda x: F.least(x, F.lit(-1e-4))
    ratio = (cl(chosen) - log1mexp(cl(chosen))) - (cl(rejected) - log1mexp(cl(rejected)))
    return -chosen + F.lit(beta) * (F.log1p(F.exp(-F.abs(ratio))) + F.greatest(-ratio, F.lit(0.0)))


def without_section(text: Column, title: str) -> Column:
    """A prompt without one titled section (up to the next line that starts with capitals and a colon)."""
    return F.regexp_replace(text, rf"(?ms)^{title}[^\n]*\n.*?(?=^[A-Z][A-Z ]+[:(]|\z)", "")
