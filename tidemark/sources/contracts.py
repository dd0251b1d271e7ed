"""Contract versions from a directory of schema files or from a contracts table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_DIR = str(Path(__file__).resolve().parents[1] / "schemas" / "user_event")


def schema_files(spark: SparkSession, directory: str) -> DataFrame:
    """``version, schema`` of the files ``v<number>.avsc``, ordered by the number."""
    texts = spark.read.text(directory, wholetext=True, pathGlobFilter="v*.avsc")
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^v([0-9]+)\.avsc$", 1)
    return (
        texts.select(number.alias("n"), F.col("value").alias("schema"))
        .where(F.col("n") != "")
        .select(F.col("n").cast("int").alias("version"), "schema")
        .orderBy("version")
    )


def packaged_schemas(directory: str = SCHEMA_DIR) -> dict[int, str]:
    """The contract files shipped with this package, by version number."""
    files = {int(p.stem[1:]): p.read_text() for p in Path(directory).glob("v*.avsc")}
    return dict(sorted(files.items()))


def contracts_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("subject string, version int, schema_id int, schema string").parquet(path)


def writer_schemas(contracts: DataFrame, subject: str) -> tuple[dict[int, str], str]:
    """All versions of one subject by schema id, and the newest as the reader schema.

    Decoding expressions are built from these on the driver: the texts of one subject, each id once.
    """
    rows = contracts.where(F.col("subject") == subject).select("version", "schema_id", "schema").collect()
    if not rows:
        raise ValueError(f"no contract registered for {subject!r}")
    newest = max(rows, key=lambda r: r.version)
    return {r.schema_id: r.schema for r in rows}, newest.schema
