"""Multi-sample load of raw claim files by their own headers (SRC-1..5).

``root`` holds one data set per sample and kind (inpatient, outpatient,
beneficiary): a CSV file, a folder of CSV parts, or a ZIP. The load

1. finds the data set of every wanted sample, CSV before ZIP (``discover``);
2. reads the header line of every file in one distributed pass (``headers``):
   files of one data set may differ in their columns and their order;
3. scans the files of equal headers together, by name, and writes one
   all-text table per kind, partitioned by sample, in which malformed records
   are marked (``stage``): raw text is parsed once;
4. judges every sample on the counts of that table (``status_rows``): a sample
   without beneficiaries or without claims, with a file that lacks a key
   column, or with malformed records has failed and is left out whole;
5. cleans, joins and unites the samples that remain (``load``).

What reaches the driver is bounded by the file listing, which it holds anyway:
paths, headers, and one count per sample and kind.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import ingest
from ..session import ensure_checkpoint_dir
from . import files

KINDS = ("BENE", "IP", "OP")
#: Words of the file names of each kind, the exact one first.
NAMES = {"BENE": ("Beneficiary_Summary", "Beneficiary"), "IP": ("Inpatient", "Inpatient"), "OP": ("Outpatient", "Outpatient")}
WANTED = {"BENE": K.BENE_COLS, "IP": K.IP_COLS, "OP": K.OP_COLS}
#: Columns without which a file can't be loaded.
KEYS = {"BENE": ["DESYNPUF_ID"], "IP": ["DESYNPUF_ID", "CLM_ID"], "OP": ["DESYNPUF_ID", "CLM_ID"]}
BAD = "__bad"


def _patterns(kind: str) -> list[str]:
    """Names of a kind's data sets, best first; the number is always whole (sample 1 never matches sample 11)."""
    exact, word = NAMES[kind]
    return [rf"{stem}\.{form}" for stem in (rf"[^/]*{exact}[^/]*Sample_(\d+)", rf"[^/]*{word}(?:[^/]*[^/\d])?(\d+)", rf"[^/]*{word.lower()}(?:[^/]*?[^/\d])??(\d+)(?:[^/\d][^/]*)?")
            for form in ("csv", "zip")]


def place(path: Column, kind: str) -> Column:
    """Struct ``priority, dataset, sample_num`` of a file's path; null where it isn't of the kind. A data set may be a folder of files."""
    out = F.lit(None)
    for k, pattern in reversed(list(enumerate(_patterns(kind)))):
        whole = rf"^(.*/{pattern})(?:/[^/]*)?$"
        found = F.regexp_extract(path, whole, 1)
        out = F.when(found != "", F.struct(F.lit(k).alias("priority"), found.alias("dataset"), F.regexp_extract(path, whole, 2).try_cast("int").alias("sample_num"))).otherwise(out)
    return out


def discover(spark: SparkSession, root: str, samples: list[int] | None = None) -> DataFrame:
    """SRC-3: files of the best data set of every kind and sample: ``kind, sample_num, dataset, form, path, length``.

    Listed by Spark without reading any content. Without ``samples``, all that there are.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    found = reduce(DataFrame.unionByName, [listed.select(F.lit(k).alias("kind"), "path", "length", place(F.col("path"), k).alias("at")) for k in KINDS])
    found = found.filter("at IS NOT NULL AND at.sample_num IS NOT NULL").select("kind", "path", "length", "at.*")
    if samples is not None:
        found = found.filter(F.col("sample_num").isin(list(samples)))
    best = found.groupBy("kind", "sample_num").agg(F.min(F.struct("priority", "dataset")).alias("best")).select("kind", "sample_num", "best.dataset")
    form = F.when(F.lower("dataset").endswith(".zip"), "zip").otherwise("csv")
    return found.join(best, ["kind", "sample_num", "dataset"]).select("kind", "sample_num", "dataset", form.alias("form"), "path", "length")


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC-1: ``path, columns`` of CSV files, in one distributed pass over their lines.

    A file's header is its line that names the key column, in its first block;
    a file without one has no row here.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    first = lines.filter((F.col("start") == 0) & F.col("value").contains("DESYNPUF_ID")).groupBy("path").agg(F.min("value").alias("line"))
    names = F.split(F.regexp_replace("line", "^﻿", ""), ",")
    return first.select("path", F.transform(names, lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")).alias("columns"))


def schema_drift(found: DataFrame, heads: DataFrame) -> DataFrame:
    """SRC-4: ``kind, sample_num, path, missing_column`` for every wanted column that a CSV file doesn't have."""
    wanted = reduce(lambda out, k: F.when(F.col("kind") == k, F.array(*map(F.lit, WANTED[k]))).otherwise(out), KINDS, F.array().cast("array<string>"))
    rows = found.filter("form = 'csv'").join(heads, "path", "left")
    missing = F.array_except(wanted, F.coalesce("columns", F.array().cast("array<string>")))
    return rows.select("kind", "sample_num", "path", F.explode(missing).alias("missing_column"))


def _scan(spark: SparkSession, kind: str, columns: tuple[str, ...], paths: list[str]) -> DataFrame:
    """Files of one header, by name, as text; ``BAD`` marks records that don't have the header's number of fields."""
    schema = ", ".join(f"`{c}` STRING" for c in columns) + f", `{BAD}` STRING"
    # whole records are parsed, else a surplus field would not be seen
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
          .option("columnPruning", False).csv(paths))
    return df.select(*[c for c in WANTED[kind] if c in columns], F.col(BAD).isNotNull().alias(BAD), place(F.col("_metadata.file_path"), kind)["sample_num"].alias("sample_num"))


def _text(df: DataFrame, kind: str) -> DataFrame:
    return ingest.conform(df, [*WANTED[kind], BAD, "sample_num"], lambda c: "string")


@dataclass
class Staged:
    """Written tables by kind, the files they come from, and their headers."""
    tables: dict[str, DataFrame]
    found: list
    columns: dict[str, tuple[str, ...]]


def stage(spark: SparkSession, root: str, samples: list[int] | None = None) -> Staged:
    """Discover, read headers, scan by header and write one text table per kind under the shared folder."""
    found = discover(spark, root, samples).collect()  # bounded by the listing
    csv = [r.path for r in found if r.form == "csv"]
    columns = {r.path: tuple(r.columns) for r in headers(spark, csv).collect()} if csv else {}
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staging/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    tables = {}
    for kind in KINDS:
        by_header: dict[tuple[str, ...], list[str]] = {}
        for r in found:
            if r.kind == kind and r.form == "csv" and set(KEYS[kind]) <= set(columns.get(r.path, ())):
                by_header.setdefault(columns[r.path], []).append(r.path)
        frames = [_text(_scan(spark, kind, head, paths), kind) for head, paths in by_header.items()]
        archives = [r.path for r in found if r.kind == kind and r.form == "zip"]
        if archives:
            rows = files.read_zip_csv(spark, archives, WANTED[kind], bad=BAD).withColumn("sample_num", place(F.col("source_file"), kind)["sample_num"])
            frames.append(_text(rows, kind))
        if frames:
            reduce(DataFrame.unionByName, frames).write.partitionBy("sample_num").parquet(f"{folder}/{kind}")
            tables[kind] = spark.read.parquet(f"{folder}/{kind}")
    return Staged(tables, found, columns)


STATUS = "sample_num int, kind string, status string, n_rows long, n_bad long, reason string, sample_loaded boolean"


def status_rows(staged: Staged, samples: list[int] | None = None) -> list[tuple]:
    """SRC-5: one row per sample and kind: loaded, missing or failed, with counts and the reason; and whether the sample is loaded."""
    counts = {}
    for kind, table in staged.tables.items():
        for r in table.groupBy("sample_num").agg(F.count("*").alias("n"), F.count_if(BAD).alias("bad")).collect():  # a row per sample
            counts[kind, r.sample_num] = (r.n, r.bad)
    files_of: dict[tuple, list] = {}
    for r in staged.found:
        files_of.setdefault((r.kind, r.sample_num), []).append(r)
    out = []
    for n in sorted(set(samples if samples is not None else [r.sample_num for r in staged.found])):
        rows = []
        for kind in KINDS:
            of = files_of.get((kind, n), [])
            rows_n, bad = counts.get((kind, n), (0, 0))
            absent = sorted({c for r in of if r.form == "csv" for c in KEYS[kind] if c not in staged.columns.get(r.path, ())})
            if not of:
                rows.append((kind, "missing", 0, 0, "no file"))
            elif absent:
                rows.append((kind, "failed", rows_n, bad, "columns not found: " + ", ".join(absent)))
            elif bad:
                rows.append((kind, "failed", rows_n, bad, f"{bad} malformed records"))
            else:
                rows.append((kind, "loaded", rows_n, 0, ""))
        state = {kind: s for kind, s, *_ in rows}
        loaded = "failed" not in state.values() and state["BENE"] == "loaded" and "loaded" in (state["IP"], state["OP"])
        out += [(n, *r, loaded) for r in rows]
    return out


def sample_status(spark: SparkSession, staged: Staged, samples: list[int] | None = None) -> DataFrame:
    return spark.createDataFrame(status_rows(staged, samples), STATUS)


def load(spark: SparkSession, staged: Staged, samples: list[int] | None = None) -> DataFrame:
    """The ``claims_raw`` table of the samples that load; a kind that a sample lacks is skipped, none at all is an error."""
    status = status_rows(staged, samples)
    good = sorted({r[0] for r in status if r[-1]})
    if not good:
        raise RuntimeError("no sample loads: " + "; ".join(f"sample {r[0]} {r[1]}: {r[5] or r[2]}" for r in status))

    def kept(kind: str) -> DataFrame:
        return staged.tables[kind].filter(F.col("sample_num").isin(good)).drop(BAD)

    frames = [ingest.clean_claims(kept(kind), kind=kind) for kind in ("IP", "OP") if kind in staged.tables]
    return ingest.join_beneficiaries(ingest.union_claims(frames), ingest.clean_bene(kept("BENE"))).select(*ingest.CLAIMS_RAW_COLUMNS)
