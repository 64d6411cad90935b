"""One query per operator over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, fingerprints, jaccard_join, licenses, maxscore, merkle, mixing, packing, secret_scan, substring_dedup, token_files, toxicity
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Arrow token files, and read back."""
    return token_files.read_tokens(token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents by source weights takes of each."""
    return mixing.mix(table(spark, sf_dir, "documents"))


# The quotas are listed quotient by quotient and the words are counted block by
# block here, where the DataFrame code bounds the quotients and sums in the row.
OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs,
         row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((sid - 1) % 3 + 1)::INT] AS weight FROM s),
fill(step, capped, done) AS (
  SELECT 0, []::BIGINT[], false
  UNION ALL
  SELECT step + 1, next.capped, len(next.capped) = len(f.capped)
  FROM fill f, LATERAL (
    SELECT list(sid) AS capped FROM w, (
      SELECT (sum(source_size) - sum(CASE WHEN list_contains(f.capped, sid) THEN 3 * source_size ELSE 0 END))
             / nullif(sum(CASE WHEN list_contains(f.capped, sid) THEN 0 ELSE weight END), 0) AS level FROM w) l
    WHERE list_contains(f.capped, sid) OR 3 * source_size <= weight * coalesce(level, 0)) n(capped_list),
    LATERAL (SELECT coalesce(n.capped_list, []) AS capped) next
  WHERE NOT f.done),
last AS (SELECT capped FROM fill ORDER BY step DESC LIMIT 1),
lv AS (
  SELECT (SELECT capped FROM last) AS capped,
         (sum(source_size) - sum(CASE WHEN list_contains((SELECT capped FROM last), sid) THEN 3 * source_size ELSE 0 END))
         / nullif(sum(CASE WHEN list_contains((SELECT capped FROM last), sid) THEN 0 ELSE weight END), 0) AS level FROM w),
t AS (SELECT w.*, CASE WHEN list_contains(capped, sid) THEN 3.0 * source_size ELSE weight * level END::DOUBLE AS target FROM w, lv),
k AS (
  SELECT greatest(least(8, greatest(1, sum(source_size) // 1000000)),
                  least(1024, floor(coalesce(min(target) FILTER (target > 0), 1) / 64)))::BIGINT AS b,
         sum(source_size)::BIGINT AS total FROM t),
q AS (
  SELECT sid, row_number() OVER (ORDER BY target / (2 * n + 1) DESC, sid) AS place
  FROM t, k, range(0, (3 * source_size // b + 3)::BIGINT) r(n) WHERE target > 0),
sq AS (
  SELECT t.*, (SELECT count(*) FROM q, k WHERE q.sid = t.sid AND place <= (total + b // 2) // b) AS blocks, ceil(docs / 2000)::BIGINT AS shards FROM t),
r AS (
  SELECT d.doc_id, d.size, sq.* EXCLUDE (source), ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size), 1, 15))::BIGINT AS h
  FROM d JOIN sq ON d.source IS NOT DISTINCT FROM sq.source),
rs AS (SELECT *, h % shards AS shard FROM r),
c AS (SELECT sid, shard, sum(size)::BIGINT AS cell, any_value(blocks) AS blocks FROM rs GROUP BY sid, shard),
cq AS (
  SELECT sid, shard, row_number() OVER (PARTITION BY sid ORDER BY cell::DOUBLE / (2 * n + 1) DESC, shard) AS place, blocks
  FROM c, range(0, (blocks + 1)::BIGINT) r(n) WHERE cell > 0),
cells AS (
  SELECT c.sid, c.shard, c.cell, least(b * (SELECT count(*) FROM cq WHERE cq.sid = c.sid AND cq.shard = c.shard AND place <= cq.blocks), 3 * cell) AS words
  FROM c, k),
p AS (
  SELECT rs.*, cell, words, b, words // nullif(cell, 0) AS passes, words % nullif(cell, 0) AS rest, cell // b AS whole,
         coalesce(sum(size) OVER (PARTITION BY sid, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low
  FROM rs JOIN cells USING (sid, shard), k),
blk AS (
  SELECT p.*, n, CASE WHEN n < whole THEN (n * 2147483647 + sid * 7919 + shard * 104729 + 42) % greatest(whole, 1) ELSE whole END AS place
  FROM p, range(0, coalesce((SELECT max(cell // b) FROM p), 0)::BIGINT + 1) g(n) WHERE size > 0 AND n BETWEEN low // b AND (low + size - 1) // b),
cov AS (
  SELECT doc_id, size, sid, low, shard, sum(greatest(0, least(low + size, n * b + CASE WHEN place < rest // b THEN b WHEN place = rest // b THEN rest % b ELSE 0 END) - greatest(low, n * b)))::BIGINT AS covered
  FROM blk GROUP BY ALL)
SELECT p.doc_id, p.size, source_size, round(target, 6) AS target, CASE WHEN p.size = 0 THEN 0 ELSE passes * p.size + coalesce(covered, 0) END::BIGINT AS taken, blocks
FROM p LEFT JOIN cov ON p.doc_id IS NOT DISTINCT FROM cov.doc_id AND p.size = cov.size AND p.sid = cov.sid AND p.shard = cov.shard AND p.low = cov.low
"""


def op3_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for every vector whose id is divisible by 100."""
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY ints) AS copy, ints FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS ints FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
s AS (
  SELECT q.vec_id AS query_id, q.copy AS query_copy, c.vec_id, c.copy, list_inner_product(q.ints, c.ints)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND (q.vec_id IS DISTINCT FROM c.vec_id OR q.copy <> c.copy))
SELECT * EXCLUDE (copy) FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id, query_copy ORDER BY score DESC, vec_id NULLS LAST, copy))::INT AS rank,
         vec_id, copy, score, query_copy::INT AS query_copy FROM s)
WHERE rank <= 10
"""


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, with the corpus-wide ownership of their values."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def _span_sql(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT rid, {number} AS number, '{kind}' AS kind, regexp_replace(value, '{secret_scan.LAYOUT}', '', 'g') AS value, pos - length(hit) AS start, pos AS "end" FROM (
    SELECT rid, hit, value, (sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY rid ORDER BY i))::BIGINT AS pos FROM (
      SELECT rid, unnest(string_split_regex(t, '{quoted}')) AS gap, unnest(regexp_extract_all(t, '{quoted}')) AS hit,
             unnest(regexp_extract_all(t, '{quoted}', {group})) AS value, generate_subscripts(string_split_regex(t, '{quoted}'), 1) AS i
      FROM d WHERE regexp_matches(t, '{quoted}')))
  WHERE hit IS NOT NULL AND length(value) >= {least}"""


OP4_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_span_sql(n, *k) for n, k in enumerate(secret_scan.KINDS))}),
r AS (SELECT value, source, count(DISTINCT (source, doc_id)) AS held FROM f JOIN d USING (rid) GROUP BY value, source),
o AS (SELECT value, count(*) AS owners, sum(held)::BIGINT AS repositories, count(*) > 1 OR max(held) > {secret_scan.MAX_REPOSITORIES} AS copied FROM r GROUP BY value),
j AS (SELECT f.*, owners, repositories, copied, NOT copied AND len(list_distinct(regexp_extract_all(value, '.'))) >= {secret_scan.LIVE_CHARACTERS} AS live FROM f JOIN o USING (value)),
a AS (
  SELECT rid, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, number) FILTER (number < 3) AS base,
         string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, number) FILTER (number < 3 OR live) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied, max(owners) AS most_owners, max(repositories) AS most_repositories
  FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
       coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN a USING (rid)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose texts are equal but for white space."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER g = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)
"""

def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every text."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share nine tenths of their 3-word shingles."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that stand earlier."""
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=20)


OP9_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, i, array_to_string(w[i:i + 19], ' ') AS win FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i)),
f AS (SELECT rid, i, row_number() OVER (PARTITION BY win ORDER BY rid, i) > 1 AS again FROM s),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
c AS (
  SELECT x.rid, x.i, word, coalesce(x.i - max(CASE WHEN again THEN x.i END) OVER (PARTITION BY x.rid ORDER BY x.i) < 20, false) AS gone
  FROM x LEFT JOIN f ON x.rid = f.rid AND x.i = f.i),
k AS (
  SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""


_TEMPLATES = ", ".join(f"('{name}', {licenses.template_bigrams(text)!r})" for name, text in licenses.TEMPLATES)
OP7_SQL = rf"""
WITH t(license, own) AS (VALUES {_TEMPLATES}),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.UPPER.lower()}') AS low,
         trim(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.UPPER.lower()}'), '{licenses.END}', chr(10), 'g'), '[^a-z0-9
]+', ' ', 'g'), ' ') AS clean
  FROM documents),
u AS (SELECT rid, doc_id, clean, list_filter(string_split_regex(clean, ' ?
 ?'), lambda x: x <> '') AS units FROM d),
l AS (
  SELECT rid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(low, '\r\n', chr(10), 'g'), '[\r\x0B\x0C]', chr(10), 'g'),
         '[^a-z0-9.!?\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS lines FROM d),
p AS (SELECT rid, list_filter(list_transform(string_split_regex(lines, '\n{{2,}}'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS paragraphs FROM l),
q AS (SELECT rid, len(paragraphs) AS n, unnest(paragraphs) AS par FROM p),
v AS (
  SELECT rid, unnest(units) AS unit FROM u
  UNION ALL SELECT rid, unit FROM (
    SELECT rid, trim(regexp_replace(run, '[.!? \n]+', ' ', 'g'), ' ') AS unit FROM (
      SELECT rid, par AS run FROM q WHERE n > 1 AND regexp_matches(par, '{licenses.STOP}|\n')
      UNION ALL SELECT rid, run FROM (SELECT rid, unnest(string_split_regex(par, '{licenses.STOP}')) AS run FROM q WHERE regexp_matches(par, '{licenses.STOP}'))
      WHERE contains(run, chr(10))))
  WHERE unit <> ''
  UNION ALL SELECT rid, trim(regexp_replace(clean, '[ 
]+', ' ', 'g'), ' ') FROM u WHERE len(units) > 1),
w AS (SELECT rid, row_number() OVER () AS uid, string_split(unit, ' ') AS words FROM v),
g AS (SELECT rid, uid, list_distinct(list_transform(list_zip(words[:-2], words[2:]), lambda p: p[1] || ' ' || p[2])) AS grams FROM w WHERE len(words) > 1),
h AS (SELECT rid, uid, license, round(2.0 * len(list_intersect(grams, own)) / (len(grams) + len(own)), 6) AS dice FROM g, t WHERE list_has_any(grams, own)),
k AS (SELECT * FROM h WHERE dice >= {licenses.THRESHOLD}),
a AS (
  SELECT rid, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT uid) AS n_notices
  FROM k GROUP BY rid)
SELECT doc_id, license, coalesce(dice, 0) AS dice, coalesce(licenses, '') AS licenses, coalesce(n_notices, 0) AS n_notices FROM d LEFT JOIN a USING (rid)
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents, proofs tried on a seventh of them tampered with."""
    return merkle.manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


_FIELDS = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text"))
_TAMPERED = _FIELDS.replace("n_chars", "(TRY_CAST(n_chars AS HUGEINT) + 1)")
# The polynomial division of crc32, bit by bit; DuckDB has no function for it.
_CRC32 = """xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT), lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
  lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295)"""
# Level by level here: no labels, no queue. '^' is the tree of the subroots.
OP11_SQL = f"""
WITH RECURSIVE h AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_FIELDS}) AS leaf, s IS NOT NULL AND {_CRC32} % 7 = 0 AND TRY_CAST(n_chars AS HUGEINT) IS NOT NULL AS tampered, sha256({_TAMPERED}) AS changed
  FROM (SELECT *, doc_id::VARCHAR AS s FROM documents)),
l AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size, row_number() OVER () AS rid FROM h),
up(tree, level, place, digest, size) AS (
  SELECT tree, 0, place, leaf, size FROM l
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), any_value((size + 1) // 2) FROM up WHERE size > 1 GROUP BY tree, level, place // 2),
sub AS MATERIALIZED (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM up WHERE size = 1),
top(level, place, digest, size) AS (
  SELECT 0, place, digest, size FROM sub
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), any_value((size + 1) // 2) FROM top WHERE size > 1 GROUP BY level, place // 2),
nodes AS MATERIALIZED (SELECT * FROM up UNION ALL SELECT '^', level, place, digest, size FROM top),
walk(rid, home, tree, level, place, size, digest, proof) AS (
  SELECT rid, tree, tree, 0, place, size, CASE WHEN tampered THEN changed ELSE leaf END, '' FROM l
  UNION ALL
  SELECT rid, home, CASE WHEN w.size > 1 THEN w.tree ELSE '^' END, CASE WHEN w.size > 1 THEN w.level + 1 ELSE 0 END,
         CASE WHEN w.size > 1 THEN w.place // 2 ELSE sub.place END, CASE WHEN w.size > 1 THEN (w.size + 1) // 2 ELSE sub.size END,
         CASE WHEN w.size = 1 THEN w.digest WHEN s.digest IS NULL THEN sha256(w.digest) WHEN w.place % 2 = 0 THEN sha256(w.digest || s.digest) ELSE sha256(s.digest || w.digest) END,
         proof || coalesce(s.digest, '')
  FROM walk w JOIN sub ON sub.tree = home LEFT JOIN nodes s ON w.size > 1 AND s.tree = w.tree AND s.level = w.level AND s.place = xor(w.place, 1)
  WHERE w.size > 1 OR w.tree <> '^'),
root AS (SELECT digest AS root FROM top WHERE size = 1)
SELECT doc_id, leaf, sub.digest AS subroot, root, sha256(proof) AS proof_sha256, w.digest AS folded_root, w.digest = root AS verified
FROM l JOIN walk w USING (rid) JOIN sub ON sub.tree = l.tree, root WHERE w.tree = '^' AND w.size = 1
"""


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return fingerprints.edits(table(spark, sf_dir, "documents"))


def _leading(a: str, b: str) -> str:
    """Code points of the leaves that two lists have in common at their beginning."""
    same = f"list_transform(list_zip({a}[:least(len({a}), len({b}))], {b}[:least(len({a}), len({b}))]), lambda x: x[1] = x[2])"
    return _points(f"{a}[:coalesce(nullif(list_position({same}, false), 0) - 1, least(len({a}), len({b})))]")


def _points(leaves: str) -> str:
    return f"coalesce(list_sum(list_transform({leaves}, lambda x: x % 64)), 0)::BIGINT"


def _dice(a: str, b: str) -> str:
    both = f"({_points(f'list_distinct({a}.leaves)')} + {_points(f'list_distinct({b}.leaves)')})"
    return f"CASE WHEN {a}.root = {b}.root THEN 1.0::DOUBLE WHEN {both} = 0 THEN 0.0::DOUBLE ELSE round(2 * {_points(f'list_intersect({a}.leaves, {b}.leaves)')} / {both}::DOUBLE, 9) END"


# One tree for each distinct text here, joined by the text.
OP12_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, t, length(t)::BIGINT AS n, row_number() OVER w AS rid, coalesce(lead(t) OVER w, first_value(t) OVER w) AS follow
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, sha256(coalesce(doc_id::VARCHAR, '-') || ':' || t) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS MATERIALIZED (SELECT *, left(t, n - n // 4) || left(follow, n // 4) AS edited FROM d),
u AS (SELECT DISTINCT unnest([t, edited]) AS t FROM e),
p AS (SELECT t, list_transform(regexp_extract_all(t, '{fingerprints.LEAF}'), lambda x: sha256(x) || '.' || length(x) || CASE WHEN ends_with(x, chr(10)) THEN '/' ELSE '-' END) AS pieces FROM u),
g AS (SELECT *, list_transform(list_filter(string_split(array_to_string(pieces, ''), '/'), lambda x: x <> ''), lambda x: sha256(x)) AS paragraphs FROM p),
s AS (
  SELECT *, list_transform(list_filter(string_split(array_to_string(list_transform(paragraphs, lambda x: x || CASE WHEN x < '4' THEN '|' ELSE '-' END), ''), '|'), lambda x: x <> ''),
                           lambda x: sha256(x)) AS sections FROM g),
m AS MATERIALIZED (
  SELECT t, sha256(coalesce(array_to_string(sections, ''), '')) AS root, list_transform(sections, lambda x: x[:{fingerprints.DIGITS}]) AS sections,
         list_transform(pieces, lambda x: (('0x' || x[:8])::BIGINT >> {32 - fingerprints.LEAF_BITS}) * 64 + x[66:-2]::BIGINT) AS leaves FROM s),
j AS (
  SELECT e.*, a, b, c, {_leading('a.leaves', 'b.leaves')} AS front, {_leading('list_reverse(a.leaves)', 'list_reverse(b.leaves)')} AS back
  FROM e JOIN m a ON a.t = e.t JOIN m b ON b.t = e.edited JOIN m c ON c.t = e.follow)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256,
       a.root || ';' || coalesce(array_to_string(a.sections, ','), '') || ';' || coalesce(array_to_string(list_transform(a.leaves, lambda x: lower(to_hex(x))), ','), '') AS fingerprint,
       b.root || ';' || coalesce(array_to_string(b.sections, ','), '') || ';' || coalesce(array_to_string(list_transform(b.leaves, lambda x: lower(to_hex(x))), ','), '') AS edited_fingerprint,
       {_dice('a', 'b')} AS near_edited, {_dice('a', 'c')} AS near_next, len(a.sections)::INT AS n_sections,
       len(list_filter(list_distinct(b.sections), lambda x: NOT list_contains(a.sections, x)))::INT AS sections_changed,
       front AS edit_start, n - least(back, n - front) AS edit_end
FROM j
"""


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of 2 to 5 words that occur 100 times or more in all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, share=100, top=2000)


# Every phrase is counted here, cuts and phrases inside longer ones are joined by text.
OP13_SQL = rf"""
WITH p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.UPPER.lower()}') AS t FROM documents)),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, phrase, any_value(k)::INT AS k, count(*)::BIGINT AS a, string_split(phrase, ' ') AS words FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, words, f.k, a, unnest(range(1, f.k)) AS cut FROM f WHERE f.k > 1),
s AS (
  SELECT c.*, l.a AS l, r.a AS r, total.n, (1000 * c.a::HUGEINT * total.n // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[cut + 1:], ' ')
  JOIN total ON total.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, f.k), lambda m: list_transform(range(1, f.k - m + 2), lambda i: array_to_string(words[i:i + m - 1], ' '))))) AS phrase FROM f WHERE f.k > 2),
inside AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, cut
FROM b LEFT JOIN inside USING (lang, phrase) WHERE coalesce(100 * most < 100 * a, true)
QUALIFY rank <= 2000
"""


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_mix_sources, op3_top_k_search, op4_secret_scan, op5_toxicity, op6_exact_dedup, op7_license_scan, op8_jaccard_join, op9_substring_dedup, op10_token_files,
    op11_merkle_manifest, op12_document_fingerprints, op13_phrase_collocations)}
ORACLES: dict[str, str] = {
    "op2_mix_sources": OP2_SQL, "op3_top_k_search": OP3_SQL, "op4_secret_scan": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op7_license_scan": OP7_SQL,
    "op9_substring_dedup": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_document_fingerprints": OP12_SQL, "op13_phrase_collocations": OP13_SQL}
