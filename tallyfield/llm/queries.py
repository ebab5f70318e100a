"""Queries of this package over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import audit, chat, decontam, jaccard, langid, lm, mixing, ring, rules, sitetree, tokens, trie, warc
from tallyfield.llm.text import fold
from tallyfield.session import checkpoint

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if given, the DuckDB text that must return the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Measurements and bits of the rules, as a view; the pipeline's SQL starts with it too.
RULES_SQL = r"""
_w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
_win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM _w WHERE len(ws) >= 8)),
_rep AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM _win) WHERE c > 1),
_cov AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM _rep)
  GROUP BY doc_id),
_lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)),
                             lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM _w),
_m AS (
  SELECT _w.doc_id, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '\P{L}+', '', 'g'))::BIGINT AS n_letters,
         len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(_cov.n, 0)::BIGINT AS n_repeat_words
  FROM _w JOIN _lines USING (doc_id) LEFT JOIN _cov USING (doc_id)),
_ledger AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * word_chars < 3 * n_words OR word_chars > 60 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 32 ELSE 0 END)::BIGINT AS failed_bits
  FROM _m)
"""


@query(
    "op4_quality_rules",
    f"""WITH {RULES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM _ledger""",
)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failed rules and verdict of every document."""
    led = rules.judged(table(spark, sf_dir, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "failed_bits", "base_failed", "kept",
    )


@query("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to a mix of sources weighted 5, 2, 1 in turn."""
    m = mixing.mixed(table(spark, sf_dir, "documents"), (5, 2, 1))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return m.select("doc_id", "size", "source_size", "target", taken, "copies")


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document; row counts of the 8 shards differ by one at most."""
    p = ring.placed(table(spark, sf_dir, "documents"), 8)
    law = F.lit("rows").alias("law")
    return p.select(
        "doc_id", "size", "text_crc32", law, "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op3_lm_scores")
def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base score of every document, learned from four fifths of them."""
    return lm.scored(table(spark, sf_dir, "documents"), fold("doc_id", 5))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 512 tokens."""
    import public_tokenizers

    n = tokens.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return n.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op1_jaccard_join")
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies and number of links of every document, at 0.8 on five words."""
    return jaccard.joined(table(spark, sf_dir, "documents"))


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with up to 5 % edits."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    return langid.identified(table(spark, sf_dir, "documents"), fold("doc_id", 3))


@query(
    "op8_chat_format",
    r"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(16 + 2 * length(role) - length(regexp_replace(role, '[\\<>]', '', 'g'))
      + 2 * length(text) - length(regexp_replace(text, '[\\<>]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of every conversation, read back from its rendered text and loss spans."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(
        F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), said
    )
    formatted = checkpoint(chat.rendered(chat.folded(chat.log_of(rows.union(more)))))
    return chat.digests(chat.read_back(formatted), formatted)


@query(
    "op10_warc",
    """WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN l USING (payload_digest)""",
)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, looked up in the index and read from the archives just written."""
    archive = warc.Archive(table(spark, sf_dir, "pages"))
    return archive.lookup(archive.captures)


# Conversations after their heads were replaced, as lists of turns; crc32 is worked out bit by bit:
# each byte goes in by an exclusive or (v >= 0), then eight shifts follow (v = -1).
REBUILT_SQL = """
_own AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                            ORDER BY turn NULLS FIRST, role, text) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
_h AS (
  SELECT c, ts, c - c % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
      lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda r, v: CASE WHEN v >= 0 THEN xor(r, v) ELSE xor(r >> 1, (r & 1) * 3988292384) END), 4294967295) % 4 AS h
  FROM _own),
_seq AS (
  SELECT _h.c, coalesce(b.ts[1:_h.h], []) || _h.ts[_h.h + 1:] AS s FROM _h LEFT JOIN _own b ON b.c = _h.base)
"""


@query(
    "op11_prefix_trie",
    f"""WITH {REBUILT_SQL},
_p AS (SELECT c, d, s[1:d] AS p, len(s) AS n FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM _seq)),
_n AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM _p GROUP BY d, p),
_t AS (
  SELECT a.d, a.p,
    count(*) FILTER (NOT EXISTS (FROM _n k WHERE k.d = u.d + 1 AND k.p[1:u.d] = u.p)) AS n_leaves,
    count(*) FILTER (u.d = a.d + 1) AS n_children,
    sum(CASE WHEN u.d = 0 THEN 0 ELSE (u.n_convs - 1) * len(regexp_extract_all(u.p[u.d].text, '[^\\x20\\x09-\\x0D]+')) END) AS saved
  FROM _n a JOIN _n u ON u.d >= a.d AND u.p[1:a.d] = a.p GROUP BY a.d, a.p)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, t.n_children, t.n_leaves,
  t.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM _n n JOIN _t t ON t.d = n.d AND t.p = n.p LEFT JOIN _n up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]""",
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared beginning of the conversations, with up to three turns taken from one in twenty."""
    turns = trie.numbered(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    n = F.crc32(conv.cast("string").cast("binary")) % 4
    return trie.trie(*trie.rebuilt(turns, conv - conv % 20, n, 3))


@query("op12_main_text")
def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page as text."""
    return sitetree.extracted(table(spark, sf_dir, "pages"))


@query(
    "op13_filter_audit",
    r"""WITH _w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws,
    doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy FROM documents),
_l AS (SELECT doc_id, max(quality = 1)::INT AS good, max(toxic = 1)::INT AS toxic FROM labels GROUP BY doc_id),
_m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(copy, false)::INT AS mask
  FROM _w LEFT JOIN _l USING (doc_id)),
_c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM _m GROUP BY ALL),
_f AS (SELECT chr(65 + i::INT) AS f, (1 << i)::INT AS b FROM range(5) r(i)),
_o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o, [a.b, b.b, c.b, d.b, e.b] AS bs
  FROM _f a JOIN _f b ON b.f <> a.f JOIN _f c ON c.f NOT IN (a.f, b.f)
  JOIN _f d ON d.f NOT IN (a.f, b.f, c.f) JOIN _f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
_s AS (SELECT o, k AS step, bs[k] AS bit, list_sum(bs[1:k]) - bs[k] AS before FROM (SELECT *, unnest(range(1, 6)) AS k FROM _o)),
_r AS (
  SELECT part, o, step, bit,
    coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM (SELECT *, before::INT AS before FROM _s) CROSS JOIN _c GROUP BY ALL)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM _r""",
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove per language in each of their 120 orders."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit.audited(audit.failure_masks(docs, labels, audit.text_filters()), "ABCDE")
