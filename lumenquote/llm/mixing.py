"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash, once for every time they may be used, and cut into blocks of equal
token size. The points i * golden ratio mod 1, mapped through the cumulative weights, say which source each slot of
the mixture takes from; the k-th slot of a source takes its k-th block. Running sums and ranks are made in two
levels (hash buckets or slot ranges, then the rows of one), so no task ever holds a whole source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenquote.llm.encode import DEFAULT_VOCABULARY, encode_documents
from lumenquote.session import written

GOLDEN = (math.sqrt(5) - 1) / 2
LEAST_CELLS = 4096
SLOT_RANGE = 65_536
STRIDE = 1 << 20


@dataclass(frozen=True)
class MixRule:
    block_tokens: int = 4096
    bucket_docs: int = 20_000  # documents of a source in one bucket, about
    seed: int = 17


def document_tokens(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, n_tokens of every document, written once. Repeated rows count once; null and empty texts have 0 tokens."""
    sized = encode_documents(docs, id_col, text_col, vocabulary, count_only=True, keep=(source_col,))
    sized = sized.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens"))
    return written(sized.dropDuplicates(["doc_id"]), "tokens")


def plan_shares(tokens: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """(plan, total aimed at). The total is the token count of all documents, those without a target included.

    plan has one row per wanted source, however many there are: source, target_share, max_repeats, available (tokens of
    its documents), docs, aim (tokens: target_share of the total, or all that the repeats allow) and passes. A source whose target
    lies beyond its documents times max_repeats gives all of these; a source without documents gives nothing; what is
    missing is not made up by others. Null sources, shares and repeats, shares and repeats of 0 or less are no targets; of
    a source named twice the shares add up and the least repeats hold.
    """
    wanted = targets.select(F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("s"), F.col("max_repeats").cast("int").alias("r"))
    wanted = wanted.filter("source IS NOT NULL AND s > 0 AND r > 0").groupBy("source").agg(F.sum("s").alias("target_share"), F.min("r").alias("max_repeats"))
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    own = tokens.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("docs"))
    plan = wanted.join(own, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("docs", F.coalesce("docs", F.lit(0)))
    aim = F.least(F.col("target_share") * float(total), (F.col("available") * F.col("max_repeats")).cast("double"))
    passes = F.when(F.col("available") > 0, F.least(F.col("max_repeats").cast("bigint"), F.ceil(F.col("aim") / F.col("available")))).otherwise(0)
    return written(plan.withColumn("aim", aim).withColumn("passes", passes.cast("int")), "plan"), total


def golden_point(i: Column) -> Column:
    """i * golden ratio mod 1, split so that large i keep their precision."""
    high = F.floor(i / STRIDE) * ((STRIDE * GOLDEN) % 1.0)
    x = (high - F.floor(high)) + (i % STRIDE) * GOLDEN
    return x - F.floor(x)


def schedule(plan: DataFrame, rule: MixRule = MixRule()) -> tuple[DataFrame, int]:
    """(slot, source, rank: the source's how-manieth slot), number of slots. Points run on until the rarest source has its slots too.

    Cumulative weights are made in one task over the rows of the plan, one per source. A point finds its source by a
    join on equal cells of the unit interval, of which there are several times as many as sources.
    """
    spark = plan.sparkSession
    need = plan.filter("aim > 0").select("source", F.ceil(F.col("aim") / rule.block_tokens).alias("need"))
    sums = need.agg(F.sum("need").alias("n"), F.min("need").alias("least"), F.count(F.lit(1)).alias("sources")).first()
    n = sums["n"] or 0
    if not n:
        return spark.createDataFrame([], "slot bigint, source string, rank bigint"), 0
    extra = min(n, math.ceil(3 * (1 + math.log(n)) * n / sums["least"]))
    cells = max(LEAST_CELLS, 4 * sums["sources"])
    upto = F.sum("need").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edges = need.withColumn("upto", upto).select("source", ((F.col("upto") - F.col("need")) / n).alias("lo"), F.when(F.col("upto") == n, 2.0).otherwise(F.col("upto") / n).alias("hi"))
    own = F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))
    edges = edges.select("source", "lo", "hi", F.explode(own).alias("cell"))
    slots = spark.range(n + extra).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("x")).withColumn("cell", F.floor(F.col("x") * cells))
    slots = slots.join(edges, "cell").filter("x >= lo AND x < hi").select("slot", "source", F.floor(F.col("slot") / SLOT_RANGE).alias("part"))
    counts = slots.groupBy("source", "part").agg(F.count(F.lit(1)).alias("k"))
    before = counts.select("source", "part", (F.sum("k").over(Window.partitionBy("source").orderBy("part")) - F.col("k")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1
    ranked = slots.withColumn("inner", inner).join(before, ["source", "part"])
    return ranked.select("slot", "source", (F.col("before") + F.col("inner")).alias("rank")), n + extra


def blocks(tokens: DataFrame, plan: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """source, doc_id, copy, n_tokens, rank (block of the source), ord (order in it): the uses of documents that fill each aim.

    The copies of a document stand in different passes over its source. A document is used if more than half of it lies within the aim.
    """
    live = plan.filter("passes > 0").select("source", "aim", "passes", F.greatest(F.lit(1), F.floor(F.col("docs") / rule.bucket_docs)).alias("buckets"))
    uses = tokens.filter("n_tokens > 0").select("doc_id", "source", "n_tokens").join(live, "source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    uses = uses.withColumn("h", F.xxhash64("doc_id", "copy", F.lit(rule.seed)))
    uses = uses.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.col("buckets"))).drop("passes", "buckets")
    sums = uses.groupBy("source", "copy", "bucket").agg(F.sum("n_tokens").alias("t"))
    over_buckets = Window.partitionBy("source").orderBy("copy", "bucket")
    before = sums.select("source", "copy", "bucket", (F.sum("t").over(over_buckets) - F.col("t")).alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("source", "copy", "bucket").orderBy("h", "doc_id")) - F.col("n_tokens")
    placed = uses.withColumn("inner", inner).join(before, ["source", "copy", "bucket"]).withColumn("at", F.col("before") + F.col("inner"))
    placed = placed.filter(F.col("at") + F.col("n_tokens") / 2 <= F.col("aim"))
    return placed.select("source", "doc_id", "copy", "n_tokens", F.floor(F.col("at") / rule.block_tokens).alias("rank"), F.col("at").alias("ord"))


def mix(tokens: DataFrame, targets: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """slot, ord, source, doc_id, copy, n_tokens: the mixture; in order of slot and ord it is well mixed at every length."""
    plan, _ = plan_shares(tokens, targets)
    slots, n = schedule(plan, rule)
    placed = blocks(tokens, plan, rule).join(slots, ["source", "rank"], "left")
    # Should the points ever run short for a source, its last blocks stand at the end; none is lost.
    return placed.select(F.coalesce("slot", F.col("rank") + n).alias("slot"), "ord", "source", "doc_id", "copy", "n_tokens")


def report_shares(tokens: DataFrame, targets: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """source, target_share, max_repeats, available_tokens, aim_tokens, mixed_tokens, actual_share (of the mixture), share_of_aim (of the total aimed at), most_uses."""
    plan, total = plan_shares(tokens, targets)
    used = blocks(tokens, plan, rule).groupBy("source").agg(F.sum("n_tokens").alias("_m"), (F.max("copy") + 1).alias("_u"))
    whole = used.agg(F.sum("_m")).scalar()
    out = plan.withColumn("available_tokens", F.col("available").cast("bigint")).withColumn("aim_tokens", F.floor("aim")).join(used, "source", "left")
    mixed = F.coalesce("_m", F.lit(0))
    return out.select(
        "source", "target_share", "max_repeats", "available_tokens", "aim_tokens", mixed.alias("mixed_tokens"),
        F.coalesce(mixed / whole, F.lit(0.0)).alias("actual_share"), (mixed / F.lit(float(max(total, 1)))).alias("share_of_aim"), F.coalesce("_u", F.lit(0)).alias("most_uses"),
    )
