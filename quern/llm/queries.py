"""The queries opN_<name> and pipeline, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, licenses, line_dedup, media, packing, secrets, simhash, suffix_dedup, toxicity
from .shared import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "text")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    back = chat_format.read_back(chat_format.format_chats(rows.unionByName(own)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_file(), 2048)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = staged(media.encode_media(table(spark, sf_dir, "documents")), "media")
    return media.media_digests(media.audio_features(stored))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"), tau=2, words=3, seed=42)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), 0.3)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents"), 400, passage=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "first_word", "end_word", F.round("cosine", 4).alias("cosine"), F.round("ratio", 6).alias("ratio"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_chat_format, op3_best_fit_packing, op4_media_columns, op5_secret_scan, op6_license_scan,
           op7_simhash, op8_toxicity, op9_suffix_dedup, op10_decontaminate, pipeline)
    return {f.__name__: f for f in own}


_CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, replace(replace(text, '%', '%25'), '<', '%3C') AS body,
         replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E') AS name,
         role IS NOT DISTINCT FROM lag(role) OVER w AS joined,
         role IS NOT DISTINCT FROM lead(role) OVER w AS goes_on
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + CASE WHEN joined THEN 0 ELSE length(name) + 7 END + CASE WHEN goes_on THEN 7 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


#: Windows of 8 words from and up to every line, grouped by their whole content; a position is doc_id * 10^9 + line.
_LINES = """
WITH docs AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i - 1 AS line_no, CASE WHEN trim(ls[i], ' ') = '' THEN 0 ELSE length(ls[i]) - length(replace(ls[i], ' ', '')) + 1 END AS w FROM (SELECT *, unnest(generate_series(1, len(ls))) AS i FROM docs)),
ends AS (SELECT doc_id, line_no, CAST(coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM (SELECT * FROM lines UNION ALL SELECT doc_id, len(ls), 0 FROM docs)),
windows AS (SELECT doc_id, line_no AS a, min(line_no) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN 8 FOLLOWING AND UNBOUNDED FOLLOWING) AS e FROM ends
  UNION SELECT doc_id, max(line_no) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN UNBOUNDED PRECEDING AND 8 PRECEDING), line_no FROM ends),
bodies AS (SELECT doc_id, a, e, e - a AS n, array_to_string(ls[a + 1:e], chr(10)) AS body FROM windows JOIN docs USING (doc_id) WHERE a IS NOT NULL AND e IS NOT NULL),
firsts AS (SELECT doc_id, a, e, min(doc_id * 1000000000 + a) OVER (PARTITION BY n, body) AS first FROM bodies),
gone AS (SELECT doc_id, list(DISTINCT x) AS xs FROM (SELECT doc_id, unnest(generate_series(a + 1, e)) AS x FROM firsts WHERE doc_id * 1000000000 + a > first) GROUP BY doc_id),
kept AS (SELECT doc_id, docs.text AS own, ls, xs, CASE WHEN xs IS NULL THEN docs.text
  ELSE coalesce(array_to_string(list_transform(list_filter(generate_series(1, len(ls)), lambda i: NOT list_contains(xs, i)), lambda i: ls[i]), chr(10)), '') END AS text FROM docs LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(CASE WHEN own IS NULL THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines, CAST(coalesce(len(xs), 0) AS BIGINT) AS n_removed, sha256(text) AS kept_sha256, text FROM kept
"""


def _license_sql() -> str:
    """The license scan in SQL: the same canonical form over the known texts and every unit of the documents."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"

    def canonical(c: str) -> str:
        lines = licenses._COPYRIGHT.replace("(?md)", "(?m)")
        c = f"regexp_replace(lower(replace({c}, chr(13) || chr(10), chr(10))), {quoted(lines)}, '', 'g')"
        c = f"' ' || trim(regexp_replace({c}, {quoted(licenses._MARKS)}, ' ', 'g')) || ' '"
        for word, own in licenses.SPELLINGS:
            c = f"replace({c}, ' {word} ', ' {own} ')"
        return f"trim({c})"

    known = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in licenses.KNOWN)
    long = ", ".join(f"({quoted(k)}, '{d}', '{f}', {n})" for k, d, f, n in licenses.LONG)
    parts = lambda c: f"list_filter(list_transform(regexp_split_to_array({c}, '\\n[ \\t\\r]*\\n'), lambda x: {canonical('x')}), lambda x: x <> '')"
    return f"""
WITH short AS (SELECT license, {parts("body")} AS p FROM (VALUES {known}) t(license, body)),
known AS (SELECT digest, min(license) AS license, min(first) AS first, min(parts) AS parts FROM (
  SELECT license, sha256(array_to_string(p, ' ')) AS digest, sha256(p[1]) AS first, len(p) AS parts FROM short UNION ALL SELECT * FROM (VALUES {long}) t(license, digest, first, parts)) GROUP BY 1),
cut AS (SELECT doc_id, {parts("coalesce(text, '')")} AS p, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
starts AS (SELECT doc_id, p, i, sha256(p[i]) AS first FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM cut)),
units AS (SELECT doc_id, 'document' AS unit, 0 AS unit_no, sha256(array_to_string(p, ' ')) AS digest FROM cut
  UNION ALL SELECT doc_id, 'paragraph', i - 1, sha256(array_to_string(p[i:i + parts - 1], ' ')) FROM starts JOIN (SELECT DISTINCT first, parts FROM known) USING (first) WHERE i + parts - 1 <= len(p) AND parts < len(p)
  UNION ALL SELECT doc_id, 'line', i - 1, sha256({canonical("lines[i]")}) FROM (SELECT *, unnest(generate_series(1, len(lines))) AS i FROM cut WHERE len(lines) > 1))
SELECT doc_id, unit, CAST(unit_no AS BIGINT) AS unit_no, license, digest FROM units JOIN known USING (digest)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _LINES, "op2_chat_format": _CHAT, "op6_license_scan": _license_sql()}
