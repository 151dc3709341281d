"""The ten operators' registered queries over the driver's tables, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .decontaminate import find_leaks
from .jaccard_join import jaccard_components
from .language_id import identify, learn
from .license_scan import scan_licenses
from .packing import pack
from .quality_ranking import score_quality
from .quality_rules import BASE_RULE, apply_rules
from .quote_linking import conversations, link_quotes
from .suffix_dedup import remove_repeats
from .textstats import with_statistics
from .token_rollup import RollupStore, bare_count, counted, deletes, inserts, piece_count, revisions, with_token_counts, word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, what remains without 50-byte strings that a smaller doc_id holds."""
    return remove_repeats(table(spark, sf_dir, "documents"), length=50).withColumnRenamed("id", "doc_id")


#: Whole texts as hexadecimal bytes; every 50-byte string with the least document that holds it.
SQL_OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM d, unnest(range(0, length(h) // 2 - 49)) AS u(p)),
m AS (SELECT s, min(doc_id) AS lo FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.doc_id, p FROM w JOIN m USING (s) WHERE lo < w.doc_id),
i AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM hit),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM i),
sp AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, n),
cut AS (SELECT doc_id, a AS till, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM sp UNION ALL SELECT d.doc_id, length(h) // 2, coalesce(max(b), 0) FROM d LEFT JOIN sp ON d.doc_id = sp.doc_id GROUP BY d.doc_id, h),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (till - since)), '' ORDER BY since) AS k FROM cut JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM sp GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents are inserted under two tokenizer versions; words-1 is revised to leave
    out words without a letter or digit; the revision is delivered twice; documents of fewer than 20 words go."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    text = F.col("text")
    # One pass over the texts; what the batches need afterwards is one short row for each document.
    base = C.cut(docs.select("source", "lang", word_count(text).alias("w"), bare_count(text).alias("bare"), piece_count(text).alias("p")), "counts")
    store = RollupStore(spark, C.new_path(spark, "rollup"))
    w, p = F.col("w"), F.col("p")
    store.apply("0-load", inserts(counted(base, {"words-1": w, "pieces-1": p})))
    changed = base.where("bare > 0").select("source", "lang", F.lit("words-1").alias("tokenizer_version"), w.alias("old_tokens"), (w - F.col("bare")).alias("new_tokens"))
    store.apply("1-revise", revisions(changed))
    store.apply("1-revise", revisions(changed))
    store.apply("2-withdraw", deletes(counted(base.where("w < 20"), {"words-1": w - F.col("bare"), "pieces-1": p})))
    C.discard(base)
    return store.totals()


def token_rollup_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by a public tokenizer as a version of its own: all documents inserted, those of fewer than 20 ids withdrawn."""
    version = "word_bpe_49k"
    base = C.cut(with_token_counts(table(spark, sf_dir, "documents").select("source", "lang", "text"), {version: tokenizer_path()}), "counts")
    store = RollupStore(spark, C.new_path(spark, "rollup"))
    store.apply("0-load", inserts(counted(base, {version: F.col(version)})))
    store.apply("1-withdraw", deletes(counted(base.where(F.col(version) < 20), {version: F.col(version)})))
    C.discard(base)
    return store.totals()


SQL_OP2 = r"""
WITH c AS (
  SELECT source, lang,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
    len(list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: NOT regexp_matches(x, '[\p{L}\p{N}]'))) AS bare,
    len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')) AS p
  FROM documents)
SELECT source, lang, 'words-1' AS tokenizer_version, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(w - bare) AS BIGINT) AS n_tokens FROM c WHERE w >= 20 GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-1', CAST(count(*) AS BIGINT), CAST(sum(p) AS BIGINT) FROM c WHERE w >= 20 GROUP BY source, lang
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, the base rule, and the verdict of the learned decision list, for every document."""
    out, _ = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn="crc32(cast(id as string)) % 5 != 0")
    return out.selectExpr("id doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and the base rule of the same pass, which SQL can repeat."""
    out = with_statistics(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.withColumnRenamed("id", "doc_id").withColumn("base_failed", F.expr(BASE_RULE))


SQL_BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
t AS (SELECT doc_id, s FROM g GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT g.doc_id, count(DISTINCT g.i + k) AS n FROM g JOIN t ON g.doc_id = t.doc_id AND g.s = t.s, unnest(range(0, 8)) AS v(k) GROUP BY g.doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c"""


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry scores of all documents, learned where crc32(doc_id as text) mod 5 is not 0."""
    out, _ = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample=None, learn="crc32(cast(id as string)) % 5 != 0")
    return out.selectExpr("id doc_id", "crc32(cast(id as string)) % 5 = 0 held_out", "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of 4096."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-parsing predictions of all documents, learned where crc32(doc_id as text) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    parser = learn(docs.where("crc32(cast(doc_id as string)) % 4 != 2"), "lang", "text")
    return identify(docs, parser).selectExpr("id doc_id", "crc32(cast(id as string)) % 4 = 2 held_out", "lang_pred", "score")


def op7_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without their quotes, with reply links and thread roots."""
    return link_quotes(table(spark, sf_dir, "conversations"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with quotes put in, as mail programs do: of the two messages before, under one and two marks."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    one = c.groupBy("conv_id", "turn").agg(F.min("text").alias("said")).where("said is not null")
    mark = lambda col, by: F.concat(F.lit(by), F.replace(col, F.lit("\n"), F.lit("\n" + by)), F.lit("\n"))
    near = one.select("conv_id", (F.col("turn") + 1).alias("turn"), mark(F.col("said"), "> ").alias("near"))
    far = one.select("conv_id", (F.col("turn") + 2).alias("turn"), mark(F.col("said"), "> > ").alias("far"))
    c = c.join(near, ["conv_id", "turn"], "left").join(far, ["conv_id", "turn"], "left")
    return c.select("conv_id", "turn", "role", F.concat(F.coalesce("far", F.lit("")), F.coalesce("near", F.lit("")), "text").alias("text"))


def quote_linking_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over conversations with quotes of two levels."""
    return link_quotes(quoted_conversations(spark, sf_dir))


def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply-ordered conversations without quotes, from those with quotes."""
    return conversations(link_quotes(quoted_conversations(spark, sf_dir)))


_QUOTES = r"""m AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role, string_split(text, chr(10)) AS ls FROM src),
l AS (
  SELECT r, conv_id, turn, i, ls[i] AS line, len(regexp_replace(regexp_extract(ls[i], '^(?:[ \t]*>)+[ \t]?'), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(ls[i], '^(?:[ \t]*>)+[ \t]?', '')), '[\x20\x09-\x0D]+', ' ', 'g')) AS s,
    regexp_replace(ls[i], '^(?:[ \t]*>)+[ \t]?', '') AS said
  FROM m, unnest(range(1, len(ls) + 1)) AS u(i)),
b AS (
  SELECT r, regexp_replace(coalesce(string_agg(said, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body,
    count(*) FILTER (WHERE level > 0 AND s != '') AS n_quoted FROM l GROUP BY r),
own AS (SELECT r, conv_id, turn, list(s ORDER BY i) AS ss FROM l WHERE level = 0 AND s != '' GROUP BY ALL),
ch AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY r ORDER BY i) THEN 1 ELSE 0 END AS new FROM l),
runs AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM ch),
pas AS (SELECT r, conv_id, turn, run, level, list(s ORDER BY i) AS ss, count(*) AS n FROM runs WHERE level > 0 AND s != '' GROUP BY r, conv_id, turn, run, level),
heads AS (SELECT DISTINCT conv_id, ss[1] AS head, ss FROM pas),
f AS (
  SELECT o.conv_id, heads.ss, min(o.turn) AS origin FROM (SELECT conv_id, turn, ss, k, ss[k] AS head FROM own, unnest(range(1, len(ss) + 1)) AS u(k)) o
  JOIN heads ON o.conv_id = heads.conv_id AND o.head = heads.head WHERE o.ss[k : k + len(heads.ss) - 1] = heads.ss GROUP BY ALL),
p AS (
  SELECT pas.conv_id, pas.turn, f.origin, sum(n) AS c, coalesce(sum(n) FILTER (WHERE level = 1), 0) AS near
  FROM pas JOIN f ON pas.conv_id = f.conv_id AND pas.ss = f.ss WHERE f.origin < pas.turn GROUP BY ALL),
k AS (SELECT conv_id, turn, sum(c) AS n_linked, (max({'near': near, 'origin': origin}) FILTER (WHERE near > 0)).origin AS reply_to FROM p GROUP BY ALL),
t AS (
  SELECT conv_id, turn, reply_to AS anc, 1 AS d FROM k WHERE reply_to IS NOT NULL
  UNION ALL SELECT t.conv_id, t.turn, k.reply_to, t.d + 1 FROM t JOIN k ON t.conv_id = k.conv_id AND t.anc = k.turn WHERE k.reply_to IS NOT NULL),
root AS (SELECT conv_id, turn, min(anc) AS thread_root, max(d) AS depth FROM t GROUP BY ALL),
z AS (
  SELECT m.conv_id, m.turn, m.role, coalesce(b.body, '') AS body, coalesce(b.n_quoted, 0) AS n_quoted, coalesce(k.n_linked, 0) AS n_linked, k.reply_to,
    coalesce(root.thread_root, m.turn) AS thread_root, coalesce(root.depth, 0) AS depth
  FROM m LEFT JOIN b ON m.r = b.r LEFT JOIN k ON m.conv_id = k.conv_id AND m.turn = k.turn LEFT JOIN root ON m.conv_id = root.conv_id AND m.turn = root.turn),
o AS (SELECT *, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN rank() OVER (PARTITION BY conv_id ORDER BY thread_root, turn) END AS reply_order,
  '[' || coalesce(role, '') || ' ' || coalesce(CAST(turn AS VARCHAR), '') || coalesce(' to ' || CAST(reply_to AS VARCHAR), '') || ']' || chr(10) || body AS formatted FROM z)"""
_LINKED = """SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, body, CAST(n_quoted AS BIGINT) AS n_quoted, CAST(n_linked AS BIGINT) AS n_linked, CAST(reply_to AS BIGINT) AS reply_to, CAST(thread_root AS BIGINT) AS thread_root, CAST(depth AS BIGINT) AS depth, CAST(reply_order AS BIGINT) AS reply_order, formatted FROM o"""
_QUOTED = """one AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY ALL HAVING min(text) IS NOT NULL),
src AS (SELECT c.conv_id, c.turn, c.role, coalesce('> > ' || replace(g.said, chr(10), chr(10) || '> > ') || chr(10), '') || coalesce('> ' || replace(h.said, chr(10), chr(10) || '> ') || chr(10), '') || c.text AS text
  FROM conversations c LEFT JOIN one h ON c.conv_id = h.conv_id AND c.turn = h.turn + 1 LEFT JOIN one g ON c.conv_id = g.conv_id AND c.turn = g.turn + 2)"""
SQL_OP7 = f"WITH RECURSIVE src AS (SELECT * FROM conversations), {_QUOTES} {_LINKED}"
SQL_QUOTED = f"WITH RECURSIVE {_QUOTED}, {_QUOTES} {_LINKED}"
SQL_TEXTS = f"""WITH RECURSIVE {_QUOTED}, {_QUOTES},
e AS (SELECT conv_id, (reply_order - 1) // 1024 AS block, reply_order, formatted, count(*) AS c FROM o WHERE reply_order IS NOT NULL GROUP BY ALL)
SELECT conv_id, CAST(block AS BIGINT) AS block, CAST(sum(c) AS BIGINT) AS n_messages, string_agg(formatted || CASE WHEN c > 1 THEN chr(10) || '(' || c || ' times)' ELSE '' END, chr(10) || chr(10) ORDER BY reply_order, formatted) AS conversation
FROM e GROUP BY conv_id, block"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) within a tenth of the item's length in edits."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates that documents cover to four fifths."""
    return scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have similarity 0.75 or more."""
    return jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL_OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id"""

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_rollup, op3_quality_rules, op4_quality_ranking, op5_packing, op6_language_id, op7_quote_linking, op8_decontamination, op9_license_scan, op10_jaccard_join, token_rollup_tokenizer, quality_base_counts, quote_linking_quoted, conversation_texts)}
ORACLE = {"op1_suffix_dedup": SQL_OP1, "op2_token_rollup": SQL_OP2, "quality_base_counts": SQL_BASE, "op10_jaccard_join": SQL_OP10, "op7_quote_linking": SQL_OP7, "quote_linking_quoted": SQL_QUOTED, "conversation_texts": SQL_TEXTS}
