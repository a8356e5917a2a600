"""Tables whose rows belong to runs: create once, append, read and delete by run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.schema import struct_type
from tidewatch.sources.catalog import quoted, text_literal
from tidewatch.sources.rewrite import delete_rows


def new_run_id() -> str:
    """A fresh run id. It is made once by the caller and passed on, never inside a query."""
    return str(uuid.uuid4())


class RunTable:
    """A table keyed by ``run_id``.

    ``parquet`` tables are partitioned by run, so deleting a run drops one
    partition and never rewrites another run. With ``shared_files`` runs lie in
    common files instead, as many small runs would; a delete then writes only
    the files anew that hold the run. ``iceberg`` tables (where the connector is
    on the classpath) use row-level deletes under the same calls.
    """

    def __init__(self, spark: SparkSession, name: str, columns: list[dict], provider: str = "parquet", shared_files: bool = False):
        if provider not in ("parquet", "iceberg"):
            raise ValueError(f"no run tables on {provider!r}")
        if name != name.lower():
            raise ValueError(f"{name!r}: identifiers are lower case")
        self.spark, self.name, self.provider, self.shared_files = spark, name, provider, shared_files
        self.columns = [c for c in columns if c["name"] != "run_id"]

    def create_if_missing(self) -> RunTable:
        fields = struct_type(self.columns, "acid").fields
        ddl = ", ".join(
            f"{quoted(f.name)} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in fields
        )
        by = "" if self.shared_files else " PARTITIONED BY (run_id)"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(self.name)} ({ddl}, run_id string) USING {self.provider}{by}")
        return self

    def append(self, df: DataFrame, run_id: str) -> RunTable:
        names = [c["name"].lower() for c in self.columns]
        df.select(*names, F.lit(run_id).alias("run_id")).write.insertInto(self.name)
        return self

    def append_runs(self, df: DataFrame, run: Column) -> RunTable:
        """Append the rows of several runs at once; ``run`` names each row's run."""
        names = [c["name"].lower() for c in self.columns]
        df.select(*names, run.cast("string").alias("run_id")).write.insertInto(self.name)
        return self

    def rows(self, run_id: str | None = None) -> DataFrame:
        df = self.spark.table(self.name)
        return df if run_id is None else df.where(F.col("run_id") == run_id)

    def delete(self, run_id: str) -> None:
        """Delete one run; deleting an absent run is no error."""
        literal = text_literal(run_id)
        if self.provider == "iceberg":
            self.spark.sql(f"DELETE FROM {quoted(self.name)} WHERE run_id = {literal}")
        elif self.shared_files:
            schema = self.spark.table(self.name).schema
            delete_rows(self.spark, self.location(), F.col("run_id") == run_id, schema)
            self.spark.catalog.refreshTable(self.name)
        else:
            self.spark.sql(f"ALTER TABLE {quoted(self.name)} DROP IF EXISTS PARTITION (run_id = {literal})")

    def location(self) -> str:
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(self.name)}").where("col_name = 'Location'")
        return described.first()["data_type"]

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {quoted(self.name)}")
