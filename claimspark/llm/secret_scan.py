"""Secret candidates with corpus-wide ownership, in SQL functions only.

Candidates are found in every whole text by pattern. The candidates' hashes are
then counted over the corpus by distinct owners and repositories: a credential
that several owners hold, or that one owner holds in very many repositories, is
a copied example; one that a single owner holds in few and that looks random is
live. A private key is told by its body, not by the header that all keys share.
Counting goes from (hash, owner, repository) to
(hash, owner) to hash, each combined before it is shuffled, so that an example
copied into a third of all rows needs no large group anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_shared

#: Fixed values: (kind, pattern, group of the value, least length of the value).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),  # AKIA[A-Z0-9]+ of 16 characters or more: the run is taken whole either way
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # [0-9a-f]+ of 32 or more, likewise
)
#: A private key: its header, then all up to its end line or, where that is missing, its first lines. A lone header is taken too.
PRIVATE_KEY = (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:"
               r"(?:[\\nr\x20\x09-\x0D]*(?:Proc-Type|DEK-Info):[^\x0A\x0D\\]*){0,2}[A-Za-z0-9+/=\\\x20\x09-\x0D]*-----END [A-Z0-9 ]*PRIVATE KEY-----"
               r"|(?:[\\nr\x20\x09-\x0D]*[A-Za-z0-9+/=]{40,}){1,4})?")
#: What the layout of a value adds to it: white space, also as escaped line ends.
LAYOUT = r"[\x20\x09-\x0D]|\\[nr]"
#: Formats of well-known issuers: reported where the corpus shows a single owner.
VENDOR = ("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}"
          r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|" + PRIVATE_KEY, 0, 1)
KINDS = (*BASE, VENDOR)
#: Different characters that a live-looking value has at least.
LIVE_CHARACTERS = 8
#: Repositories of one owner that may hold a value before it counts as a copied example.
MAX_REPOSITORIES = 100


def spans(text: Column, number: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches, leftmost and not overlapping, as ``start, number, end, kind, value``.

    Splitting by the pattern gives the text between the matches; the lengths of
    both, added up, give the places in code points.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    kinds = "array<struct<start:long,number:int,end:long,kind:string,value:string>>"
    empty = F.array().cast(kinds)

    def step(got: Column, part: Column) -> Column:
        start = got["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        found = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(kind).alias("kind"),
                         F.regexp_replace(part["value"], F.lit(LAYOUT), F.lit("")).alias("value"))
        keep = part["hit"].isNotNull() & (F.length(part["value"]) >= least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(got["found"], F.array(found))).otherwise(got["found"]).cast(kinds).alias("found"))

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found"))
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(parts, start, step, lambda got: got["found"])).otherwise(empty)


def joined(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = 1, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and how many are live or copied.

    ``spans`` has every base span, and vendor spans that are live. Copied: more
    than ``max_owners`` owners hold the value, or an owner holds it in more than
    ``max_repositories`` repositories. Live: not copied, and it has
    ``LIVE_CHARACTERS`` different characters. Null text is empty; a
    null owner is an owner of its own; rows that share an id are documents of
    their own but one repository. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.concat(*(spans(text, n, *kind) for n, kind in enumerate(KINDS)))
    rows = docs.select(F.col("doc_id").cast("long"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), found.alias("found"))
    # written: the texts are scanned once, and the row numbers stay as they are
    rows = write_shared(rows.withColumn("row", F.monotonically_increasing_id()), "spans")

    each = rows.select("row", "owner", "repository", F.explode("found").alias("s")).withColumn("hash", F.sha2("s.value", 256))
    holders = (each.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
               .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("repositories").alias("of_one")))
    copied = (F.col("owners") > max_owners) | (F.col("of_one") > max_repositories)
    varied = F.size(F.array_distinct(F.regexp_extract_all(F.col("s.value"), F.lit("."), F.lit(0)))) >= LIVE_CHARACTERS
    judged = each.join(holders, "hash").withColumn("copied", copied).withColumn("live", ~F.col("copied") & varied)
    shown = F.when((F.col("s.number") < len(BASE)) | F.col("live"), F.struct("s.start", "s.number", "s.end", "s.kind"))
    per_row = judged.groupBy("row").agg(
        joined(F.collect_list(shown)).alias("spans"), F.count_if("live").alias("n_live"),
        F.count_if("copied").alias("n_copied"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["number"] < len(BASE))
    none = F.lit(0).cast("long")
    return rows.join(per_row, "row", "left").select(
        "doc_id", *(count(k[0]) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        *(F.coalesce(c, none).alias(c) for c in ("n_live", "n_copied", "most_owners", "most_repositories")))
