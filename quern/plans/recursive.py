"""Recursive UNION: a fixpoint loop with de-duplication over written tables.

Spark has recursive CTEs for UNION ALL only. Each round joins the rows of the round before, drops what has
been seen (null-safe on all columns), and is written to the shared folder, so the plan does not grow and a
lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.errors import QuernError
from quern.plans.lowering import MAX_LEVELS, SPARK, Relation, quote
from quern.sources.shared import new_folder


def fixpoint(spark: SparkSession):
    """A union_fixpoint for Lowering: (base SQL, columns, step) -> the finished relation."""

    def run(base: str, columns: list[tuple[str, str]], step) -> Relation:
        folder = new_folder(spark)
        names = [n for n, _ in columns]

        def written(df: DataFrame, level: int) -> bool:
            typed = df.toDF(*names).selectExpr(*(f"CAST({quote(n)} AS {SPARK[k]}) AS {quote(n)}" if k in SPARK and k != "NULL" else quote(n) for n, k in columns))
            typed.distinct().write.mode("overwrite").parquet(f"{folder}/level={level}")
            return spark.read.parquet(f"{folder}/level={level}").isEmpty()

        empty, level = written(spark.sql(base), 0), 0
        while not empty:
            if level >= MAX_LEVELS:
                raise QuernError(f"recursive query exceeded {MAX_LEVELS} iterations")
            new = spark.sql(step(Relation(f"parquet.`{folder}/level={level}`", columns))).toDF(*names)
            seen = spark.read.parquet(folder).select(*(quote(n) for n in names)).alias("seen")
            same = [new[n].eqNullSafe(seen[n]) for n in names]
            level += 1
            empty = written(new.join(seen, same, "left_anti"), level)
        picked = ", ".join(quote(n) for n in names)
        return Relation(f"(SELECT {picked} FROM parquet.`{folder}`)", columns)

    return run
