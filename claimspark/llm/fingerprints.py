"""Document fingerprints: a Merkle tree over each text, SQL functions only.

The leaves are pieces of the text, together the whole of it: each ends with
a sentence or a line, or after ``PIECE`` code points. Lines are the
paragraphs; a node of a paragraph hashes its leaves. A run of paragraphs up to
one whose digest starts with 0, 1, 2 or 3 is a section, so that an edit moves
the borders of the sections around it only. The root hashes the sections.

Equal roots mean equal texts. Where roots differ, the sections that the other
tree has too are left aside, and the leaves of the differing branches locate
the edit. The likeness of two fingerprints is the weight of the distinct
leaves that they share, in code points, twice, over the weight of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, write_shared
from .ordering import placed

#: Code points of a leaf, at most (its last one may be punctuation), under 64.
PIECE = 48
#: Fixed pattern of a leaf, as Java and DuckDB read it.
LEAF = rf"[^.!?\n]{{0,{PIECE - 1}}}[.!?\n]|[^.!?\n]{{1,{PIECE}}}"
#: Hex digits that a fingerprint keeps of a section's digest, and bits of a leaf's.
DIGITS, LEAF_BITS = 16, 25
#: Tasks that expand the copies of a row, at most.
SHARES = 256


def _split(joined: Column, mark: str) -> Column:
    return F.filter(F.split(joined, mark), lambda x: x != "")


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with a struct ``name``: ``root, sections, leaves`` of the column ``text``, which holds no nulls.

    The root has all hex digits of its digest; sections and leaves, of which
    likeness and differences are told, keep ``DIGITS`` and ``LEAF_BITS`` of
    theirs (hashed are all). A leaf is one number: 64 times its digest, and its
    code points.
    """
    # a column for each level, so that none is computed twice; '/' ends a paragraph and '|' a section
    pieces = F.regexp_extract_all(F.col(text), F.lit(LEAF), F.lit(0))
    df = df.withColumn("__leaves", F.transform(pieces, lambda p: F.concat(_hash(p), F.lit("."), F.length(p), F.when(p.endswith("\n"), F.lit("/")).otherwise(F.lit("-")))))
    df = df.withColumn("__paragraphs", F.transform(_split(F.array_join("__leaves", ""), "/"), _hash))
    line = F.array_join(F.transform("__paragraphs", lambda p: F.concat(p, F.when(p < "4", F.lit("|")).otherwise(F.lit("-")))), "")
    df = df.withColumn("__sections", F.transform(_split(line, r"\|"), _hash))
    digest = lambda x: F.shiftright(F.conv(F.left(x, F.lit(8)), 16, 10).cast("long"), 32 - LEAF_BITS)
    leaves = F.transform("__leaves", lambda x: (digest(x) * 64 + F.substring(x, F.lit(66), F.length(x) - 66).cast("long")).cast("int"))
    root = _hash(F.array_join("__sections", ""))
    return df.withColumn(name, F.struct(root.alias("root"), F.transform("__sections", lambda x: F.left(x, F.lit(DIGITS))).alias("sections"), leaves.alias("leaves"))).drop("__leaves", "__paragraphs", "__sections")


def fingerprint(tree: Column) -> Column:
    """The tree as text: root, sections, leaves."""
    return F.concat_ws(";", tree["root"], F.array_join(tree["sections"], ","), F.array_join(F.transform(tree["leaves"], lambda x: F.lower(F.hex(x))), ","))


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, leaf: n + leaf % 64)


def likeness(same: Column, a: Column, b: Column) -> Column:
    """0 to 1 for two trees' leaves: 1 for equal roots (``same``), 0 where no leaf is shared."""
    mine, theirs = F.array_distinct(a), F.array_distinct(b)
    both = _weight(mine) + _weight(theirs)
    shared = 2 * _weight(F.array_intersect(mine, theirs)) / both
    return F.when(same, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.round(shared, 9))


def _shared_ends(a: Column, b: Column, points: Column) -> tuple[Column, Column]:
    """Code points that two trees' leaves have in common at their beginning and, after it, at their end (of ``points`` at most)."""
    def run(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        same = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p == q)
        place = F.array_position(same, False)
        return F.when(n == 0, F.lit(0).cast("long")).otherwise(_weight(F.slice(x, F.lit(1), F.when(place > 0, place - 1).otherwise(n).cast("int"))))

    front = run(a, b)
    return front, F.least(run(F.reverse(a), F.reverse(b)), points - front)


def _key(docs: DataFrame) -> DataFrame:
    """Rows ``key, doc_id, text``: equal rows have equal keys, others don't."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), text), 256)).alias("key"), doc_id.alias("doc_id"), text.alias("text"))


def edits(docs: DataFrame) -> DataFrame:
    """A row per document and its edited text: its last quarter replaced by the beginning of the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, and what the differing branches say:
    ``n_sections, sections_changed`` (sections of the edited text that the
    document doesn't have) and ``edit_start, edit_end`` (the span of the
    document, in code points, between the leaves in common at both ends; equal
    texts: both its length).

    Null text counts as empty; an empty text has no sections and no leaves and
    is like another empty one only. The order is by ``doc_id``, no id first,
    rows of equal id by digest of the text. Equal rows stand next to each other,
    so all but the last are followed by their equal. After the last row comes
    the first; a lone row follows itself. No rows: none. Only ``doc_id`` and
    ``text`` are read.

    Equal rows are combined before the shuffle and expanded in the result, dealt
    over tasks. Texts are shuffled once, and the replacements once more.
    """
    prepare(docs.sparkSession)
    rows = _key(docs).filter("key IS NOT NULL")  # holds for all; said here, it makes the exchanges below one
    # order: small rows only
    small = rows.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first(F.length("text")).alias("n"))
    order = placed(write_shared(small, "fingerprint-keys"), [F.col("doc_id").asc_nulls_first(), F.col("key")], what="fingerprint-order")
    here = order.select(F.col("key").alias("of"), F.floor(F.col("n") / 4).cast("int").alias("wanted"), F.pmod(F.col("place") + 1, F.col("size")).alias("place"))
    links = here.join(order.select("key", "place"), "place").select("key", "of", "wanted")
    # whole texts, one of each distinct row: dealt by key once, as all uses below read the same columns of it
    texts = rows.groupBy("key").agg(F.first(F.struct("doc_id", "text")).alias("row"), F.count("*").alias("copies")).filter("copies > 0")
    own = with_tree(texts.select("key", "row.doc_id", "row.text", "copies"), "text", "tree")
    sent = own.join(links, "key").select(F.col("of").alias("key"), F.expr("left(text, wanted)").alias("more"), _sent())
    last = _compared(own.join(sent, "key"))
    # a row's copies are followed by itself, the last of them by the next row
    before = own.filter("copies > 1").withColumns({"more": F.expr("left(text, cast(floor(length(text) / 4) as int))"), "next": _sent()})
    # a row of many copies is expanded by many tasks
    shares = before.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("copies") - 1, F.lit(SHARES).cast("long")) - 1)))
    times = F.expr(f"(copies - 2 - share) div {SHARES} + 1")
    many = _compared(shares.repartition("key", "share").withColumn("times", times), "times")
    return last.unionByName(many.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("copy", "times"))


def _sent() -> Column:
    """What likeness needs of a row's tree."""
    return F.struct(F.unhex("tree.root").alias("root"), F.array_distinct("tree.leaves").alias("leaves")).alias("next")


def _compared(met: DataFrame, *keep: str) -> DataFrame:
    """The result for rows ``doc_id, text, tree, more, next``: the text's last quarter becomes ``more``."""
    n = F.length("text")
    rows = with_tree(met.withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.col("more"))), "edited", "new")
    front, back = _shared_ends(F.col("tree.leaves"), F.col("new.leaves"), n.cast("long"))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("tree.root") == F.col("new.root"), F.col("tree.leaves"), F.col("new.leaves")).alias("near_edited"),
        likeness(F.unhex("tree.root") == F.col("next.root"), F.col("tree.leaves"), F.col("next.leaves")).alias("near_next"),
        F.size("tree.sections").alias("n_sections"), F.size(F.array_except("new.sections", "tree.sections")).alias("sections_changed"),
        front.alias("edit_start"), (n - back).alias("edit_end"), *keep)
