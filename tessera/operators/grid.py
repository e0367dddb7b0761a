"""Many search configurations from one reading of the postings, and whether their differences hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Term saturation and length weight of the sparse path, the constant of the fusion and the weights of both paths."""

    name: str
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    dense: float = 1.0
    sparse: float = 1.0


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("config_id", "qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def search_grid(hits: DataFrame, dense: DataFrame, configs: list[Config], mean_length: float, k: int = 10, path_k: int = 20) -> DataFrame:
    """(config_id, qid, rank, id, score): what each configuration's fused search finds.

    hits: (qid, id, weight, tf, doc_length), a row for each term of a query in a document, weight being the term's own;
    dense: (qid, rank, id). Hits are summed for all configurations in one shuffle, a column for each, and only the
    sums are multiplied by their number. Ties on six digits fall by id. A path that finds nothing adds nothing.
    """
    if not configs or len({c.name for c in configs}) < len(configs):
        raise ValueError("configurations need names of their own")
    if any(c.k1 <= 0 or not 0 <= c.b <= 1 or c.rrf_k <= 0 or min(c.dense, c.sparse) < 0 for c in configs):
        raise ValueError("k1 and rrf_k must be positive, b between 0 and 1, weights at least 0")
    size = F.col("doc_length") / F.lit(mean_length or 1.0)
    gain = [F.round(F.sum(F.col("weight") * F.col("tf") * (c.k1 + 1) / (F.col("tf") + c.k1 * (1 - c.b + c.b * size))), 6).alias(f"s{i}") for i, c in enumerate(configs)]
    sums = hits.groupBy("qid", "id").agg(*gain)
    each = F.explode(F.array(*(F.struct(F.lit(c.name).alias("config_id"), F.col(f"s{i}").alias("score")) for i, c in enumerate(configs)))).alias("c")
    sparse = _best(sums.select("qid", "id", each).select("qid", "id", "c.config_id", "c.score"), path_k)

    def part(kind: str) -> Column:
        out = F.lit(None).cast("double")
        for c in configs:
            out = F.when(F.col("config_id") == c.name, F.lit(float(getattr(c, kind))) / (F.lit(c.rrf_k) + F.col("rank"))).otherwise(out)
        return out.alias("part")

    named = F.explode(F.array(*(F.lit(c.name) for c in configs))).alias("config_id")
    both = sparse.select("config_id", "qid", "id", part("sparse")).unionByName(
        dense.where(F.col("rank") <= path_k).select("qid", "id", "rank", named).select("config_id", "qid", "id", part("dense"))
    )
    fused = both.groupBy("config_id", "qid", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return _best(fused, k).select("config_id", "qid", "rank", "id", "score")


def reciprocal_ranks(found: DataFrame, truth: DataFrame, queries: DataFrame, configs: list[Config]) -> DataFrame:
    """(config_id, qid, value): one over the best rank of a right document; 0 for queries without one."""
    right = found.join(truth.select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy("config_id", "qid").agg((F.lit(1.0) / F.min("rank")).alias("value"))
    asked = queries.select("qid", F.explode(F.array(*(F.lit(c.name) for c in configs))).alias("config_id"))
    return asked.join(right, ["config_id", "qid"], "left").select("config_id", "qid", F.coalesce("value", F.lit(0.0)).alias("value"))


#: How a Poisson variable of mean 1 falls, as cut points of sixteen bits.
POISSON = (24109, 48219, 60273, 64292, 65296, 65497, 65531)


def paired_bootstrap(per_query: DataFrame, base: str, replicates: int = 200, seed: str = "0") -> DataFrame:
    """(config_id, value, change, low, high, n_queries): each mean, its difference from the base's and the 95 % interval of that.

    per_query: (config_id, qid, value). In each replicate a query counts as often as a hash of seed, replicate and qid
    says, alike for all configurations. Queries that lack one of the two values are left out of the difference. A
    replicate in which no query counts is left out.
    """
    if replicates < 1 or replicates > 10_000:
        raise ValueError("between 1 and 10,000 replicates")
    mine = per_query.where(F.col("config_id") == base).select("qid", F.col("value").alias("_base"))
    pairs = per_query.join(mine, "qid").select("config_id", "qid", "value", (F.col("value") - F.col("_base")).alias("d"))
    means = pairs.groupBy("config_id").agg(F.round(F.avg("value"), 6).alias("value"), F.round(F.avg("d"), 6).alias("change"), F.count("*").alias("n_queries"))
    drawn = pairs.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "r", "qid").cast("binary")), 1, 4), 16, 10).cast("int")
    weight = sum((u >= cut).cast("int") for cut in POISSON)
    runs = drawn.withColumn("w", weight).groupBy("config_id", "r").agg(F.round(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum("w")), 6).alias("d")).where("d is not null")
    lists = runs.groupBy("config_id").agg(F.sort_array(F.collect_list("d")).alias("l"))  # one value for each replicate
    at = lambda q: F.element_at("l", F.greatest(F.lit(1), F.ceil(F.size("l") * q).cast("int")))
    return means.join(lists.select("config_id", at(0.025).alias("low"), at(0.975).alias("high")), "config_id").select("config_id", "value", "change", "low", "high", "n_queries")
