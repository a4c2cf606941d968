"""Sources mixed to target shares of tokens, along a time-varying curriculum.

Each source has a weight schedule over training time whose integral is its target share. A document copy takes the
position at which its source's cumulative demand reaches the copy's place in the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .tokens import token_counts

#: Hash buckets of a source's cumulative size; their totals are BUCKETS rows a source at most.
BUCKETS = 1024


def sized_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, tokens) of every document with at least one token and a source; sizes by the public tokenizer."""
    d = token_counts(documents.filter("source IS NOT NULL AND text IS NOT NULL AND text <> ''"), keep=("source",))
    return d.filter("tokens > 0")


def plan_of(totals: dict[str, int], targets: dict[str, tuple[float, int]], ramp: float = 0.5) -> dict[str, dict[str, float]]:
    """Per source with tokens and a positive share: total, share, demand (tokens), w0 and w1 (weights at the start and
    the end of training).

    The budget is the largest at which no source needs more than its allowed repeats. A target source without any
    token cannot be met; the other shares are scaled to fill its place. ``ramp`` (0..1) moves the mix at the start
    towards equal weights and the end away from them, as far as all weights stay positive; weights sum to 1 all along.
    """
    live = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and totals.get(s, 0) > 0}
    if not live:
        return {}
    whole = sum(share for share, _ in live.values())
    budget = min(totals[s] * cap * whole / share for s, (share, cap) in live.items())
    n = len(live)
    least = min(share / whole for share, _ in live.values())
    k = ramp * min(1.0, least / max(1e-12, 1 / n - least)) if n > 1 and least < 1 / n else 0.0
    out = {}
    for s, (share, cap) in live.items():
        p = share / whole
        w0 = p * (1 - k) + k / n
        out[s] = {"total": totals[s], "share": p, "cap": cap, "demand": budget * p, "w0": w0, "w1": 2 * p - w0, "budget": budget}
    return out


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 0, ramp: float = 0.5) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """(doc_id, source, copy, tokens, position) of every document use, and the plan. ``targets`` (source, targetShare,
    maxRepeats) is a small table given by hand; it and one total per target source go to the driver.

    Documents of a source come in hash order, pass after pass. A use whose middle lies within the source's demand is
    taken, so a source is off its target by less than one document. Sources that are null or not listed contribute
    nothing; repeated target rows count once (the last share wins); an empty table gives an empty mix.
    """
    want = {r["source"]: (float(r["targetShare"] or 0), int(r["maxRepeats"] or 0)) for r in targets.select("source", "targetShare", "maxRepeats").collect() if r["source"] is not None}
    d = documents.filter(F.col("source").isin(*want)) if want else documents.limit(0)
    h = F.xxhash64("doc_id", F.lit(seed))
    d = cut(sized_documents(d).select("doc_id", "source", "tokens", h.alias("h"), F.pmod(h, F.lit(BUCKETS)).alias("bucket")))
    sums = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("s"))
    totals = {r["source"]: r["t"] for r in sums.groupBy("source").agg(F.sum("s").alias("t")).collect()}
    plan = plan_of(totals, want, ramp)
    if not plan:
        return d.select("doc_id", "source", F.lit(0).alias("copy"), "tokens", F.lit(0.0).alias("position")).limit(0), plan
    fields = ["total", "share", "cap", "demand", "w0", "w1", "budget"]
    consts = F.create_map(*[x for s, p in plan.items() for x in (F.lit(s), F.struct(*[F.lit(float(p[f])).alias(f) for f in fields]))])
    before = sums.select("source", "bucket", (F.sum("s").over(W.partitionBy("source").orderBy("bucket")) - F.col("s")).alias("before"))
    inside = F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    d = d.filter(F.col("source").isin(*plan)).withColumn("inside", inside).join(before, ["source", "bucket"]).withColumn("p", consts[F.col("source")])
    mid = F.col("before") + F.col("inside") - F.col("tokens") / 2
    uses = F.least(F.floor((F.col("p.demand") - mid) / F.col("p.total")) + 1, F.col("p.cap")).cast("int")
    d = d.withColumn("mid", mid).withColumn("uses", uses).filter("uses > 0")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    u = F.least(F.lit(1.0), (F.col("copy") * F.col("p.total") + F.col("mid")) / F.col("p.demand"))
    slope = F.col("p.w1") - F.col("p.w0")
    t = F.when(F.abs(slope) < 1e-9, u).otherwise((F.sqrt(F.greatest(F.lit(0.0), F.col("p.w0") * F.col("p.w0") + 2 * slope * F.col("p.share") * u)) - F.col("p.w0")) / slope)
    return d.select("doc_id", "source", "copy", "tokens", (t * F.col("p.budget")).alias("position")), plan


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 0, ramp: float = 0.5) -> DataFrame:
    """The mix, range-sorted by position."""
    m, _ = mixed(documents, targets, seed, ramp)
    return m.repartitionByRange(F.col("position"), F.col("doc_id"), F.col("copy")).sortWithinPartitions("position", "doc_id", "copy")


def reached_shares(documents: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Per target source: targetShare, reachedShare of all tokens in the mix, tokens, documents, mostUses, maxRepeats."""
    m, _ = mixed(documents, targets, seed)
    per_doc = m.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"))
    per = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("mostUses"))
    t = targets.filter("source IS NOT NULL").select("source", "targetShare", "maxRepeats").dropDuplicates(["source"])
    out = t.join(per, "source", "left").fillna(0, ["tokens", "documents", "mostUses"])
    return out.select("source", "targetShare", (F.col("tokens") / F.greatest(F.lit(1), F.sum("tokens").over(W.partitionBy()))).alias("reachedShare"), "tokens", "documents", "mostUses", "maxRepeats")
