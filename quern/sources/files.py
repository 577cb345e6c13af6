"""Read-only tables: Parquet paths, addressed in place so that filters and columns reach the scan."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from quern.plans.lowering import Relation, from_spark, quote


class ParquetTables:
    """Tables <name>.parquet of a folder; JSON columns are declared, since Parquet stores them as text.

    A table's files are listed and its schema is read once, when it is first named; from then on it is a view of the
    session. refresh() forgets that, for a folder whose files have changed.
    """

    def __init__(self, spark: SparkSession, folder: str, json_columns: dict[str, set[str]] | None = None):
        self.spark, self.folder, self.json = spark, folder, json_columns or {}
        self.known: dict[str, Relation] = {}

    def __call__(self, name: str) -> Relation:
        key = name.lower()
        if key not in self.known:
            df = self.spark.read.parquet(f"{self.folder}/{key}.parquet")
            view = f"quern_{hashlib.md5(self.folder.encode()).hexdigest()[:12]}_{key}"
            df.createOrReplaceTempView(quote(view))
            json_columns = self.json.get(key, set())
            self.known[key] = Relation(quote(view), [(n, "JSON" if n in json_columns else from_spark(k)) for n, k in df.dtypes])
        return self.known[key]

    def refresh(self) -> None:
        self.known.clear()
