"""The corpus operators as queries over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import (
    chat_format,
    exact_dedup,
    fingerprints,
    lexical_search,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    phrases,
    quality,
    segmentations,
    token_counts,
    warc,
)
from evalspark.llm.common import saved, table
from evalspark.session import scratch_path

BLANK_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP1_SQL = f"""
WITH lines AS (
  SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS position
  FROM (SELECT row_number() OVER () AS row, doc_id,
               string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, {BLANK_CHARS}),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10
), marked AS (
  SELECT k.*, c.key IS NOT NULL AS goes FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT goes), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH body AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body
  FROM documents
), groups AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM body GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
  sha256(body) AS text_sha256
FROM body JOIN groups USING (body)
"""


def op2_sample_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every document, decoded again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sampled = segmentations.sample_encodings(docs, model, samples=2).drop("text")
    return segmentations.decode_ids(sampled, model).select(
        "doc_id",
        "sample",
        F.size("ids").cast("long").alias("n_tokens"),
        "log_prob",
        "log_inclusion",
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP3_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes
  FROM pages
), firsts AS (SELECT payload, min(page_id) AS first_id FROM payloads GROUP BY payload)
SELECT page_id, payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL
    THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM payloads JOIN firsts USING (payload)
"""


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.words_in(F.col("text")).alias("size")
    )
    sized = saved(docs, scratch_path(spark, "document-sizes"))
    return mixing.mix_sources(sized, size=F.col("size")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP4_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496.0::DOUBLE AS chance
  FROM documents
), weighed AS (SELECT *, pow(2.0::DOUBLE, length(bin(size)) * 0.25::DOUBLE) AS weight FROM docs),
sources AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM weighed GROUP BY source)
), leveled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), goals AS (
  SELECT source, source_size, least(most, coalesce(
    max(CASE WHEN level * w <= most THEN level END) OVER () * w, most)) AS target
  FROM leveled
), classes AS (
  SELECT source, weight, sum(size)::BIGINT AS words FROM weighed GROUP BY source, weight
), tried AS (
  SELECT c.*, g.target, g.source_size,
    (g.target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(weight * words) OVER (PARTITION BY c.source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rate
  FROM classes c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source
), rated AS (
  SELECT * REPLACE (coalesce(max(CASE WHEN rate * weight <= 2.0::DOUBLE * (1 + 1e-12::DOUBLE) THEN rate END) OVER (PARTITION BY source), 0.0::DOUBLE) AS rate)
  FROM tried
), rates AS (
  SELECT source, source_size, target, rate,
    target - sum(floor(least(2.0::DOUBLE, rate * weight)) * words) AS rest
  FROM rated GROUP BY source, source_size, target, rate
), expected AS (
  SELECT d.*, r.source_size, r.target, r.rest, least(2.0::DOUBLE, r.rate * d.weight) AS copies
  FROM weighed d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), placed AS (
  SELECT *, CASE WHEN copies > floor(copies) AND size > 0
    THEN chance / (1 - chance) / ((copies - floor(copies)) / (1 - (copies - floor(copies)))) END AS q
  FROM expected
), run AS (
  SELECT row, source, rest, q, sum(size) OVER (PARTITION BY source ORDER BY q) AS through
  FROM placed WHERE q IS NOT NULL
), cuts AS (
  SELECT source, arg_min(q, (abs(through - rest), q)) AS cut
  FROM run WHERE abs(through - rest) < rest GROUP BY source
)
SELECT doc_id, size, p.source_size, target,
  (floor(copies)::BIGINT + CASE WHEN q <= cut THEN 1 ELSE 0 END) * size AS taken
FROM placed p LEFT JOIN cuts c ON p.source IS NOT DISTINCT FROM c.source
"""


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))



def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_dedup.near_duplicates(docs, words=3, numerator=85, denominator=100).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s
  FROM words
), items AS (SELECT row, unnest(s) AS item FROM sets),
shared AS (
  SELECT a.row AS a, b.row AS b, count(*) AS n FROM items a JOIN items b USING (item)
  WHERE a.row < b.row GROUP BY a.row, b.row
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.row = a JOIN sets y ON y.row = b
  WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT row AS a, row AS b FROM sets
  UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), least AS (SELECT a AS row, min(doc_id) AS component_id FROM reach JOIN sets ON sets.row = b GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM sets JOIN least USING (row)
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    held_out = quality.is_held_out(F.col("doc_id"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every document, as read back from the packed files."""
    segments, folder = packing.pack_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return packing.read_segments(segments, folder).select(
        "doc_id",
        "n_tokens",
        "part",
        "parts",
        "length",
        "one_reset",
        F.sha2("ids", 256).alias("ids_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
    )


# the text that a conversation about the template itself would have
MARKS_TEXT = "\\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like marks."""
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(MARKS_TEXT).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.conversation_digests(chat_format.format_conversations(turns.unionByName(own)))


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), placed AS (
  SELECT *, row_number() OVER o AS place, lag(role) OVER o AS before
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)
), written AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\b'), '<turn ', '\o'), '<and/>', '\a'), '</turn>', '\c') AS body,
    CASE WHEN place > 1 AND before IS NOT DISTINCT FROM role THEN '<and/>'
      ELSE CASE WHEN place > 1 THEN '</turn>' ELSE '' END || '<turn ' || coalesce(replace(replace(replace(replace(replace(
        role, '\', '\b'), '<turn ', '\o'), '<and/>', '\a'), '</turn>', '\c'), '>', '\g'), '\z') || '>' END AS lead
  FROM placed
), learned AS (
  SELECT conv_id, string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY place) AS turns,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS learned,
    count(*) AS n_turns, sum(length(lead) + length(body))::BIGINT + length('</turn>') AS formatted_chars
  FROM written GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars,
  sha256(learned) AS loss_sha256, formatted_chars
FROM learned
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"), min_count=100, max_words=5, top=2000)


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, unnest([w[i : i + m - 1] for i in range(1, len(w) - m + 2)]) AS words
  FROM worded, range(1, 6) AS sizes(m) WHERE len(w) >= m
), often AS (SELECT lang, words, count(*)::HUGEINT AS f FROM grams GROUP BY lang, words HAVING count(*) >= 100),
inner_ AS (
  SELECT lang, unnest([words[: len(words) - 1], words[2 :]]) AS words, f FROM often WHERE len(words) > 2
), held AS (SELECT lang, words, max(f) AS longest FROM inner_ GROUP BY lang, words),
kept AS (
  SELECT o.lang, o.words, o.f AS a FROM often o LEFT JOIN held h ON o.lang = h.lang AND o.words = h.words
  WHERE len(o.words) > 1 AND (h.longest IS NULL OR 100 * h.longest < 100 * o.f)
), cuts AS (SELECT *, unnest(range(1, len(words))) AS k FROM kept),
scored AS (
  SELECT c.lang, c.words, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
    JOIN often x ON x.lang = c.lang AND x.words = c.words[: c.k]
    JOIN often y ON y.lang = c.lang AND y.words = c.words[c.k + 1 :]
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), ranked AS (
  SELECT *, array_to_string(words, ' ') AS phrase,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank FROM lowest
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    signatures = lexical_search.build_signatures(docs)
    return lexical_search.search(docs, signatures, table(spark, sf_dir, "benchmark"), top=10)


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), lengths AS (SELECT doc, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
counts AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) GROUP BY doc, term),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals
), items AS (
  SELECT item, item_id, unnest(list_distinct(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
), scores AS (
  SELECT item, item_id, l.doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * l.n * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN lengths l USING (doc), totals
  GROUP BY item, item_id, l.doc, l.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sample_segmentations": op2_sample_segmentations,
    "op3_warc": op3_warc,
    "op4_mix_sources": op4_mix_sources,
    "op5_pack_tokens": op5_pack_tokens,
    "op6_fingerprints": op6_fingerprints,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_quality": op10_quality,
    "op11_chat_format": op11_chat_format,
    "op12_phrases": op12_phrases,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op3_warc": OP3_SQL,
    "op4_mix_sources": OP4_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_near_duplicates": OP9_SQL,
    "op11_chat_format": OP11_SQL,
    "op12_phrases": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
