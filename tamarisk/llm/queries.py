"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm import (
    chat, decontamination, html, language, mixing, packing, periodic_runs, quality_classifier, quality_rules, sharding, simhash, substrings, whitening,
)
from tamarisk.llm.common import table


def _remainder(name: str, n: int):
    """Of the id as text; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, model)


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), one_value=False, wordless=True)


def op3_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave_shards(table(spark, sf_dir, "documents"), n_shards=40)


def op4_de_bruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _remainder("doc_id", 4) == 2
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _remainder("doc_id", 5) == 0
    trees = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality_classifier.score(docs, trees).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


#: A conversation whose texts hold the template's control strings.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op8_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role").withColumn("text", F.lit(HARD_TEXT))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(hard)
    turns = chat.formatted_turns(rows)
    return chat.read_back(chat.prefix_trees(turns), turns)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op11_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


def op12_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_copies=3).select("doc_id", "size", "source_size", "target", "taken")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_template_decontamination": op2_template_decontamination,
    "op3_interleaved_shards": op3_interleaved_shards,
    "op4_de_bruijn_substrings": op4_de_bruijn_substrings,
    "op5_language_spans": op5_language_spans,
    "op6_block_labeller": op6_block_labeller,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_chat_prefix_tree": op8_chat_prefix_tree,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_simhash_near_duplicates": op10_simhash_near_duplicates,
    "op11_incremental_whitening": op11_incremental_whitening,
    "op12_pareto_mixing": op12_pareto_mixing,
    "op13_periodic_runs": op13_periodic_runs,
}
#: CRC-32 has no function there: the table of its 256 remainders is computed, then the bytes of a text are folded in.
_SHARDS = """WITH remainders AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i) AS r) AS s),
coded AS (
  SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, coalesce('=' || source, 'null') AS stratum,
    xor(list_reduce(list_prepend(4294967295, [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM documents, remainders),
keyed AS (SELECT *, md5('interleave-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(text_crc32 AS VARCHAR)) AS key FROM coded),
ranked AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, text_crc32) - 1) + 1) / (2 * count(*) OVER (PARTITION BY stratum)) AS share FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY share, stratum, key, doc_id, text_crc32) - 1 AS place, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 40 // total AS INT) AS shard, CAST(place - (place * 40 // total * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source FROM placed"""

_SUBSTRINGS = r"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT r, words, unnest(range(1, len(words) - 33)) AS p FROM texts),
windows AS (SELECT r, p, md5(array_to_string(words[p : p + 34], ' ')) AS h FROM places),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM windows SEMI JOIN repeated USING (h)),
words AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (r)"""

_CHAT = r"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
escaped AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS safe_text,
  replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS safe_role FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '') FILTER (WHERE role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || safe_role || ': ' || safe_text || '</turn>') + 1) AS BIGINT) AS formatted_chars FROM escaped GROUP BY conv_id, lone"""

#: Both shares (of all words among sources, of a source's words among its documents) are met in the order in which caps are reached.
_MIXING = r"""WITH read AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('pareto-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key, coalesce('=' || source, 'null') AS stratum FROM documents),
sized AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class FROM read),
classes AS (SELECT stratum, source, class, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY ALL),
sources AS (SELECT stratum, source, CAST(sum(words) AS BIGINT) AS source_size FROM classes GROUP BY ALL),
numbered AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sources),
ratios AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST) AS k FROM numbered),
factors AS (SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS factor FROM ratios),
targets AS (SELECT stratum, source_size, CASE WHEN chosen IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), chosen * weight) END AS target
  FROM (SELECT *, arg_min(factor, k) FILTER (WHERE cap > factor * weight) OVER () AS chosen FROM factors)),
shares AS (SELECT c.stratum, class, words, source_size, target, CASE WHEN class > 0 THEN 3 * words ELSE 0 END AS most, class * words AS unit FROM classes AS c JOIN targets USING (stratum)),
steps AS (SELECT *, (target - CAST(coalesce(sum(most) OVER (PARTITION BY stratum ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / nullif(CAST(sum(unit) OVER (PARTITION BY stratum ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS factor FROM shares),
chosen AS (SELECT *, arg_min(factor, -class) FILTER (WHERE most > factor * unit) OVER (PARTITION BY stratum) AS f FROM steps),
expected AS (SELECT *, CASE WHEN class = 0 THEN 0.0::DOUBLE WHEN f IS NULL THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, f * class) END AS m FROM chosen),
plan AS (SELECT stratum, class, source_size, target, floor(m) AS whole, m - floor(m) AS chance,
  target - CAST(sum(CAST(floor(m) AS BIGINT) * words) OVER (PARTITION BY stratum) AS DOUBLE) AS extra FROM expected),
odds AS (SELECT s.doc_id, s.stratum, s.size, s.key, p.* EXCLUDE (stratum, class), (CAST('0x' || substr(key, 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM sized AS s JOIN plan AS p USING (stratum, class)),
ranks AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS q FROM odds),
placed AS (SELECT *, CASE WHEN chance > 0 THEN CAST(sum(size) OVER (PARTITION BY stratum, chance > 0 ORDER BY q / (1 + q), key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size END AS before FROM ranks)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN chance > 0 AND 2 * before + size <= 2 * extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed"""

ORACLE_SQL: dict[str, str] = {"op3_interleaved_shards": _SHARDS, "op4_de_bruijn_substrings": _SUBSTRINGS, "op8_chat_prefix_tree": _CHAT, "op12_pareto_mixing": _MIXING}
