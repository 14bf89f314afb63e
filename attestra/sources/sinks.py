"""Writers: fixed CSV shapes, twin JSON and CSV outputs, split manifests, appended checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed
from ..operators.rules import result_rows


def shaped(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields in order as text; missing and null ones are empty."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in fields])


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, one_file: bool = False) -> None:
    """CSV with a header; ``one_file`` is for reports that a person opens."""
    out = shaped(df, fields) if fields else df
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def write_results(verdicts: DataFrame, path: str) -> None:
    write_csv(result_rows(verdicts), path)


def write_splits(df: DataFrame, path: str, fields: list[str], split: str = "split") -> None:
    """JSON lines and CSV of all rows, in a folder for each split; white space of text cells collapsed."""
    clean = df.select(*[collapsed(F.col(c)).alias(c) if t == "string" and c != split else F.col(c) for c, t in df.select(*fields, split).dtypes])
    clean.write.mode("overwrite").partitionBy(split).json(f"{path}/jsonl")
    clean.write.mode("overwrite").partitionBy(split).csv(f"{path}/csv", header=True)


def write_ids(df: DataFrame, path: str, id_col: str, split: str = "split") -> None:
    df.select(F.col(id_col).cast("string").alias("value"), split).write.mode("overwrite").partitionBy(split).text(path)


def write_bundle(parts: dict[str, DataFrame], path: str) -> None:
    """Several tables of one evaluation beside each other as JSON."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Rows added to a table of what is done; readers skip it by an anti join."""
    df.write.mode("append").parquet(path)
