"""Raw file sources: CSV inside ZIP, survey file, optional tables (SRC-2, SRC-6..9, SRC-12).

* CSV claim files: see ``samples``.
* ZIP: archives are not splittable, so each archive is one task
  (``binaryFile`` + ``mapInPandas``) that streams its first CSV member in
  batches; the rows are repartitioned afterwards for parallelism. Spark's
  binaryFile source caps one file at 2 GB.
* Survey: first-available column resolution at plan time; the literature
  table is the fallback, and the reason is recorded in ``source``.
"""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..operators import survey as SV

SAMPLE_PATTERN = r"Sample_(\d+)\.(?:csv|zip)"  # exact: sample 1 never matches sample 11


def sample_of_path(col=None):
    col = F.col("_metadata.file_path") if col is None else col
    return F.regexp_extract(col, SAMPLE_PATTERN, 1).cast("int")


def read_zip_csv(spark: SparkSession, path: str | list[str], wanted: list[str], batch_rows: int = 50_000,
                 partitions: int | None = None, bad: str | None = None) -> DataFrame:
    """SRC-2: first CSV member of each ZIP, wanted columns as text.

    With ``bad``, an archive that can't be read gives one row of nulls marked
    in that column, instead of failing the job, and ``source_file`` is kept.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in wanted]
                          + [T.StructField("source_file", T.StringType()), T.StructField("__failed", T.BooleanType())])

    def parse(batches):
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"]):
                try:
                    yield from members(path_, content)
                except (zipfile.BadZipFile, FileNotFoundError, UnicodeDecodeError, csv.Error):
                    if bad is None:
                        raise
                    yield pd.DataFrame([[None] * len(wanted) + [path_, True]], columns=schema.fieldNames())

    def members(path_, content):
        with zipfile.ZipFile(io.BytesIO(content)) as zf:
            name = next((n for n in zf.namelist() if n.lower().endswith(".csv")), None)
            if name is None:
                raise FileNotFoundError(f"no CSV inside {path_}")
            with zf.open(name) as fh:
                reader = csv.reader(io.TextIOWrapper(fh, encoding="utf-8", newline=""))
                header = next(reader, [])
                pos = {c: header.index(c) for c in wanted if c in header}
                buf: list[list] = []
                for rec in reader:
                    buf.append([rec[pos[c]] if c in pos and pos[c] < len(rec) else None for c in wanted] + [path_, False])
                    if len(buf) >= batch_rows:
                        yield pd.DataFrame(buf, columns=schema.fieldNames())
                        buf = []
                if buf:
                    yield pd.DataFrame(buf, columns=schema.fieldNames())

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(parse, schema)
    n = partitions or spark.sparkContext.defaultParallelism
    # the CSV reader maps empty fields to null; do the same here
    rows = rows.select(*[F.when(F.col(c) == "", None).otherwise(F.col(c)).alias(c) for c in wanted],
                       sample_of_path(F.col("source_file")).alias("sample_num"),
                       *([F.col("__failed").alias(bad), "source_file"] if bad else []))
    return rows.repartition(n)


def survey_rates_from_path(spark: SparkSession, path: str | None) -> DataFrame:
    """SRC-6..9: survey file rates, or the literature table with the reason."""
    if not path:
        return SV.literature_rates(spark, "meps_literature")
    try:
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
        df = SV.upper_columns(df)
        denial = [c for c in K.SURVEY_DENIAL_CANDIDATES if c in df.columns]
        if not denial:
            return SV.literature_rates(spark, "meps_literature_no_indicator")
        return SV.survey_rates(spark, df)
    except AnalysisException as e:  # a missing file falls back, as documented; any other failure is one
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return SV.literature_rates(spark, "meps_literature_error")


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-12: the table if it exists, else an empty frame of the same schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
