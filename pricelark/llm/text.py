"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.session import ensure_checkpoint_dir, shuffles_dropped
from pricelark.sources.tables import table

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def rows(docs: DataFrame) -> DataFrame:
    """Every row as struct `row`, with doc_id and text beside it: names in `row` cannot clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def whole(text: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The runs of non-space characters, as an array."""
    cut = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, f"[{SPACE}]+"))


def many(text: Column, symbols: str) -> Column:
    """How many characters of the text are in the character class `symbols`."""
    return F.length(F.regexp_replace(text, f"[^{symbols}]+", "")).cast("long")


def digest(*cols: Column) -> Column:
    """128 bits of the values, as 32 hex digits; equal digests are taken as equal values."""
    return F.md5(F.concat_ws("\x1f", *cols))


def saved(df: DataFrame) -> DataFrame:
    """The rows cut off from their lineage, in the shared folder of spark.checkpoint.dir."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a frame of its own: the setting is taken when it is made


def written(df: DataFrame, hashes: bool = False) -> DataFrame:
    """The same as a Parquet table in that folder: smaller, and read again only in the columns asked for.
    Of `hashes` no dictionaries are tried."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("parquet.enable.dictionary", str(not hashes).lower()).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with no later filter or expression merged into how they are computed.

    Catalyst pushes filters through projections and repeats the expressions below them; inside
    lambdas that would repeat a whole array per element.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def bounded(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """The rows, saved and counted: with a broadcast hint if they are few, plain if not."""
    df = saved(df)
    return F.broadcast(df) if df.count() <= rows else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows at most, since a row here is a whole text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
