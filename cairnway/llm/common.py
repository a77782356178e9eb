"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters only; other alphabets keep their case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of the contracts: blank and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is used where the text is plain ASCII, as it is far cheaper."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def small_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Bound the Arrow batches sent to Python by rows and bytes, as texts may be long; a session's smaller bounds hold.

    Spark reads the bounds when a plan is run, so they stay with the session.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(str(spark.conf.get(key)).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def working_name(df: DataFrame, stem: str) -> str:
    """A column name that no input column has, in any case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def with_renamed_clashes(df: DataFrame, added: list[str]) -> DataFrame:
    """Input columns that clash with names the operator adds are dropped: the operator's value wins."""
    names = {a.lower() for a in added}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
