"""A fitted factor model as DataFrames, with prediction, top-N, export and storage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.vectors import dot
from rankweave.operators import scoring, stats, topk
from rankweave.operators.prep import clip_to_scale


@dataclass(frozen=True)
class FactorModel:
    """``users(user_id, factors, bias)`` and ``items(item_id, factors, bias)``.

    ``explicit`` models estimate a rating: ``offset`` plus biases plus dot product, clipped to
    the rating scale; ids without factors fall back to the terms that are known, or to
    ``fallback`` when the model has no biases. Implicit models score the dot product (plus
    biases when ``biased``) and give 0.0 to unknown ids.
    """

    users: DataFrame
    items: DataFrame
    algorithm: str
    explicit: bool = False
    biased: bool = False
    offset: float = 0.0
    fallback: float = 0.0
    scale: tuple[float, float] = (1.0, 5.0)
    info: dict = field(default_factory=dict)

    def predict(self, pairs: DataFrame, name: str = "estimate") -> DataFrame:
        """Score given pairs; every input row comes back once, with its other columns."""
        if not self.explicit:
            return scoring.score_pairs(pairs, self.users, self.items, self.biased).withColumnRenamed("score", name)
        left = self.users.select("user_id", F.col("factors").alias("_p"), F.col("bias").alias("_bu"))
        right = self.items.select("item_id", F.col("factors").alias("_q"), F.col("bias").alias("_bi"))
        product = dot(F.col("_p"), F.col("_q"))
        if self.biased:
            known = F.lit(self.offset) + F.coalesce("_bu", F.lit(0.0)) + F.coalesce("_bi", F.lit(0.0))
            estimate = known + F.coalesce(product, F.lit(0.0))
        else:
            estimate = F.coalesce(product, F.lit(self.fallback))
        return (
            pairs.join(left, "user_id", "left").join(right, "item_id", "left")
            .withColumn(name, clip_to_scale(estimate, self.scale))
            .drop("_p", "_q", "_bu", "_bi")
        )

    def recommend(
        self,
        users: DataFrame,
        n: int = 10,
        seen: DataFrame | None = None,
        candidates: DataFrame | None = None,
    ) -> DataFrame:
        """``(user_id, item_id, score, rank)``; unknown users are absent, lists may be shorter."""
        wanted = self.users.join(users.select("user_id").distinct(), "user_id", "left_semi")
        items = self.items
        if self.explicit and self.biased:
            items = items.withColumn("bias", F.col("bias") + F.lit(self.offset))
        return topk.factor_topk(
            wanted, items, seen, n, candidates,
            use_bias=self.biased, clip=self.scale if self.explicit else None,
        )

    def explain(self, pairs: DataFrame, n_top: int = 5) -> DataFrame:
        return scoring.explain_scores(pairs, self.users, self.items, n_top)

    def biases(self) -> tuple[DataFrame, DataFrame] | tuple[None, None]:
        if not self.biased:
            return None, None
        return self.users.select("user_id", "bias"), self.items.select("item_id", "bias")

    def size(self) -> DataFrame:
        return stats.model_size(self.users, self.items)

    def save(self, path: str) -> None:
        spark = self.users.sparkSession
        self.users.write.mode("overwrite").parquet(f"{path}/users")
        self.items.write.mode("overwrite").parquet(f"{path}/items")
        settings = [(self.algorithm, self.explicit, self.biased, self.offset, self.fallback, *self.scale)]
        spark.createDataFrame(settings, _SETTINGS).coalesce(1).write.mode("overwrite").json(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FactorModel:
        row = spark.read.schema(_SETTINGS).json(f"{path}/settings").first()
        return FactorModel(
            spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items"),
            row.algorithm, row.explicit, row.biased, row.offset, row.fallback, (row.low, row.high),
        )


_SETTINGS = (
    "algorithm string, explicit boolean, biased boolean, offset double, fallback double, low double, high double"
)
