"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import licenses as lic
from weft.llm import warc
from weft.llm.decontaminate import LOWER, UPPER, decontaminate
from weft.llm.language import identify, train
from weft.llm.mixing import mix_sources
from weft.llm.nearjoin import near_duplicates
from weft.llm.quality import LINE_LIMIT, MAX_REPEAT_PERCENT, MIN_WORDS, NGRAM_LIMITS, repetition
from weft.llm.suffixes import remove_repeated_bytes
from weft.llm.tokenstore import store_tokens
from weft.llm.windows import remove_repeated


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = rf"""
WITH folded_items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, w[s:s + least(len(w), 10) - 1] AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM folded_items WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT r, n, s, w[s:s + n - 1] AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT r, d.n, s, item FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.gram = i.gram),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lic.scan_licenses(table(spark, sf_dir, "documents"), lic.known_licenses(spark))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replaced(column: str, found: str, instead: str) -> str:
    return f"regexp_replace({column}, {_quoted(found)}, {_quoted(instead)}, 'g')"


def _canonical_sql(column: str) -> str:
    """DuckDB's patterns cannot look ahead.  What follows a match becomes a group that is put back; as that takes the
    line feed that the next line's match begins with, notices are removed twice.  What must not follow is told
    apart first, by a sign that is taken out again."""
    ahead = lambda pattern: pattern.replace("(?=", "(")
    barred = re.search(r"\(\?!([^)]*)\)", lic.HELD)
    before = lic.HELD[: barred.start()].replace("(^|\\n)", "((?:^|\\n)", 1) + ")(" + barred.group(1) + ")"
    held = ahead(lic.HELD.replace(barred.group(0), ""))
    out = _replaced(column, before, f"\\1{SIGN}\\2")
    out = f"translate(replace({_replaced(_replaced(out, held, BACK), held, BACK)}, '{SIGN}', ''), '{UPPER}', '{LOWER}')"
    out = _replaced(_replaced(out, ahead(lic.NOTICE), BACK), ahead(lic.NOTICE), BACK)
    out = _replaced(_replaced(_replaced(out, lic.RESERVED, "\\1"), ahead(lic.TITLE), "\\1 license\\2"), r"[\s\x0B]+", " ")
    for found, instead in lic.SPELLINGS:
        out = _replaced(out, found, instead)
    return f"trim({_replaced(out, lic.NOT_WORD, ' ')})"


BACK, SIGN = r"\1\2", "\x01\x02\x01"
OP8_SQL = f"""
WITH known AS (
  SELECT sha256(form) AS k, min(license) AS license
  FROM (SELECT license, {_canonical_sql("text")} AS form FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted((lic.KNOWN | lic.full_texts()).items()))}) AS t(license, text))
  WHERE form <> '' GROUP BY 1),
docs AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, digest, license FROM docs LEFT JOIN known ON digest = k
"""

def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repetition(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_and_assemble(table(spark, sf_dir, "pages"), payloads=False)
    field = lambda name: F.try_element_at("metadata.fields", F.lit(name)).cast("long")
    return got.select(field("page-id").alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.kind").alias("record_type"), field("refers-to-page").alias("refers_to"))


def held_out() -> Column:
    """Rows that language models must not see."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op4_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents"), texts=False)


OP4_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spans AS (
  SELECT r, doc_id, s, md5(array_to_string(w[s:s + 12], ' ')) AS gram
  FROM (SELECT *, unnest(range(1, len(w) - 11)) AS s FROM docs WHERE len(w) >= 13 AND doc_id IS NOT NULL)),
least_ids AS (SELECT gram, min(doc_id) AS least FROM spans GROUP BY gram),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 13)) AS p FROM spans JOIN least_ids USING (gram) WHERE least < doc_id),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r) LEFT JOIN counts USING (r)
"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeated_bytes(table(spark, sf_dir, "documents"), texts=False)
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()), sample_key=F.col("doc_id"))
    got = identify(docs, model)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


# Exact, by all pairs that share a shingle; the forest finds a pair with a chance of 0.999 at least.
OP6_SQL = rf"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda s: array_to_string(w[s:s + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM words),
sets AS (SELECT row_number() OVER () AS c, g, count(*) AS n_copies, min(doc_id) AS least FROM docs WHERE len(g) > 0 GROUP BY g),
grams AS (SELECT c, len(g) AS n, unnest(g) AS gram FROM sets),
links AS (SELECT a.c AS a, b.c AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
reach AS (SELECT c, c AS o FROM sets UNION SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.o),
heads AS (SELECT reach.c, min(least) AS class_id FROM reach JOIN sets ON sets.c = reach.o GROUP BY reach.c),
degrees AS (SELECT a AS c, count(*) AS n FROM links GROUP BY a)
SELECT docs.doc_id, CASE WHEN len(docs.g) = 0 THEN docs.doc_id ELSE class_id END AS class_id, CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(degrees.n, 0) AS BIGINT) AS n_links
FROM docs LEFT JOIN sets ON sets.g = docs.g LEFT JOIN heads ON heads.c = sets.c LEFT JOIN degrees ON degrees.c = sets.c
"""

OP7_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT r, s, md5(substr(h, 2 * s + 1, 400)) AS gram FROM (SELECT r, h, unnest(range(length(h) // 2 - 199)) AS s FROM docs WHERE length(h) >= 400)),
many AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY gram) AS n FROM strings) WHERE n > 1),
bytes AS (SELECT r, p, substr(h, 2 * p + 1, 2) AS b FROM (SELECT r, h, unnest(range(length(h) // 2)) AS p FROM docs)),
marks AS (SELECT r, p, b, coalesce(max(s) OVER (PARTITION BY r ORDER BY p) > p - 200, FALSE) AS gone FROM (SELECT bytes.r, p, b, s FROM bytes LEFT JOIN many ON many.r = bytes.r AND many.s = p)),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), FALSE) AS opens FROM marks),
counts AS (SELECT r, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY p) FILTER (NOT gone) AS kept FROM edges GROUP BY r)
SELECT doc_id, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN counts USING (r)
"""

OP2_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS leader FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN leader = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN leader <> page_id THEN leader END AS refers_to
FROM d
"""

_WORDS = r"[^\x20\x09-\x0D]+"


def _repeats(n: int) -> str:
    """A table: words and characters of words inside n-grams that a text holds twice or more."""
    grams = f"SELECT r, s, md5(array_to_string(w[s:s + {n - 1}], ' ')) AS gram FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS s FROM docs WHERE len(w) >= {n})"
    many = f"SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY r, gram) AS times FROM ({grams})) WHERE times > 1"
    return f"g{n} AS (SELECT r, count(*) AS k, sum(length(word)) AS c FROM (SELECT DISTINCT r, unnest(range(s, s + {n})) AS p FROM ({many})) JOIN words USING (r, p) GROUP BY r)"


def _op9_sql() -> str:
    over = " OR ".join(f"coalesce(g{n}.c, 0) > {limit}::DOUBLE * coalesce(sizes.c, 0)" for n, limit in NGRAM_LIMITS.items())
    sizes = (3, *NGRAM_LIMITS)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs),
sizes AS (SELECT r, sum(length(word)) AS c FROM words GROUP BY r),
parts AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs),
lines AS (SELECT r, line, count(*) - 1 AS later, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM parts GROUP BY r, line),
dups AS (SELECT r, sum(later) AS n, sum(later * chars) AS c FROM lines WHERE chars > 0 GROUP BY r),
{", ".join(map(_repeats, sizes))},
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(sizes.c, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(g3.k, 0) AS BIGINT) AS n_repeat_words,
    coalesce(dups.c, 0) > {LINE_LIMIT}::DOUBLE * coalesce(sizes.c, 0) OR {over} AS failed
  FROM docs LEFT JOIN sizes USING (r) LEFT JOIN dups USING (r) {" ".join(f"LEFT JOIN g{n} USING (r)" for n in sizes)}),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR failed) AS kept FROM base
"""


QUERIES = {
    "op2_warc_captures": op2_warc_captures,
    "op1_decontaminate": op1_decontaminate,
    "op3_mix_sources": op3_mix_sources,
    "op4_doubling_dedup": op4_doubling_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op5_language_id": op5_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_repetition_rules": op9_repetition_rules,
    "op10_token_store": op10_token_store,
}
ORACLE = {
    "op1_decontaminate": OP1_SQL,
    "op2_warc_captures": OP2_SQL,
    "op4_doubling_dedup": OP4_SQL,
    "op6_ngram_join": OP6_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op8_license_scan": OP8_SQL,
    "op9_repetition_rules": _op9_sql(),
}
