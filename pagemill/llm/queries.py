"""The queries of this subpackage: each applies an operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontam, langid, licenses, lines, media, mixing, neardup, quality, repeats, sharding, whiten
from .storage import table


def fold(parts: int):
    """The remainder of a document's id, as text, by its checksum; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = F.array_sort(F.array_distinct(F.col("licenses.license")))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_notices"), F.array_join(named, ",").alias("licenses"), F.coalesce(F.array_max("licenses.coverage"), F.lit(0.0)).alias("coverage"), F.col("licenses").alias("notices"))


def op2_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", F.col("quality").alias("label"))
    out = quality.score_quality(docs, quality.fit(docs, labels))
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.documents.select("doc_id", "size", "source_size", "target", "taken", F.get("slots", 0).alias("first_slot"), F.get("slots", 1).alias("second_slot"))


def op4_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit_profiles(docs.where(fold(4) != 2))
    out = langid.identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_pack_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.pack_shards(table(spark, sf_dir, "documents"), n_shards=24, overhead=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.write_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = media.read_media(stored)
    points = F.filter("units", lambda u: u["random_access"])
    told = [
        ("programs", F.array_join("programs", ",")), ("streams", F.array_join("streams", ",")), ("packets", F.col("packets")), ("continuity_errors", F.col("continuity_errors")), ("errors", F.col("errors")),
        ("units", F.size("units")), ("pts", F.concat_ws("-", F.array_min("units.pts"), F.array_max("units.pts"))), ("points", F.array_join(F.transform(points, lambda u: u["pts"]), ",")),
    ]
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in told])
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op8_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op9_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = decontam.hit_words(F.col("spans"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def op10_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.conversation_nodes(rows.unionByName(extra)))
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_mask"))
    out = out.select("tree", "formatted", "loss_mask", turns.alias("turns"), loss.alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.document_filters(table(spark, sf_dir, "documents"))
    rows = audit.with_labels(rows, table(spark, sf_dir, "labels"), {"good": "quality", "toxic": "toxic"})
    out = audit.filter_audit(rows, F.col("part"), {f: F.col(f) for f in "ABCDE"}, {"good": F.col("good"), "toxic": F.col("toxic")})
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, d = whiten.usable(table(spark, sf_dir, "embeddings"))
    return whiten.whitened(vectors, d, whiten.fit(vectors, d))


def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", F.col("quality").alias("label"))
    out = lines.label_lines(docs, lines.fit(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words", F.size("boilerplate").cast("long").alias("n_boilerplate"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_patience_licenses, op2_ftrl_quality, op3_mix_sources, op4_radix_repeats, op5_rank_order_langid, op6_pack_shards, op7_transport_streams, op8_minhash_components, op9_fm_decontaminate, op10_format_chat, op11_filter_audit, op12_whiten_embeddings, op13_line_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op4_radix_repeats": OP4_SQL, "op8_minhash_components": OP8_SQL, "op9_fm_decontaminate": OP9_SQL, "op10_format_chat": OP10_SQL, "op11_filter_audit": OP11_SQL}


FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Every string of 400 bytes, as hexadecimal digits; runs of covered bytes by gaps between starts.
OP4_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS s FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
again AS (SELECT s FROM starts GROUP BY s HAVING count(*) > 1),
met AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -401) + 400 AS fresh FROM starts JOIN again USING (s)),
runs AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM met) GROUP BY r, run),
cut AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM runs),
kept AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

# Classes of equal sets, all pairs that share a shingle, and what each class reaches.
OP8_SQL = r"""
WITH RECURSIVE fold AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({folded}, '[^\x20\x09-\x0D]+') AS w FROM documents),
cut AS MATERIALIZED (SELECT r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s, len(w) AS words FROM fold),
class AS (SELECT min(r) AS c, s, len(s) AS n FROM (SELECT r, list_sort(s) AS s FROM cut WHERE len(s) > 0) GROUP BY s),
tokens AS (SELECT c, n, unnest(s) AS t FROM class),
pairs AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT c AS a, c AS b FROM class WHERE c IN (SELECT a FROM edges) UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
of AS (SELECT r, c FROM (SELECT r, list_sort(s) AS s FROM cut WHERE len(s) > 0) JOIN class USING (s)),
root AS (SELECT of.r, coalesce(min(reach.b), any_value(of.c)) AS root FROM of LEFT JOIN reach ON reach.a = of.c GROUP BY of.r),
comp AS (SELECT r, min(doc_id) OVER (PARTITION BY root) AS component_id FROM root JOIN fold USING (r))
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE component_id END AS component_id, doc_id IS NOT DISTINCT FROM CASE WHEN len(s) = 0 THEN doc_id ELSE component_id END AS kept FROM fold JOIN cut USING (r) LEFT JOIN comp USING (r)
""".replace("{folded}", FOLDED)

# Windows of the benchmark against those of the documents, by length.
OP9_SQL = r"""
WITH fold AS MATERIALIZED (SELECT doc_id, regexp_extract_all({folded}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({folded}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
spots AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM fold, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
met AS (SELECT r, i, spots.n, item_id FROM spots JOIN windows ON spots.win = windows.win AND spots.n = windows.n),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS at FROM met) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM fold LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
""".replace("{folded}", FOLDED)

# The digests need neither template nor mask; formatted_chars counts the marks and escapes.
OP10_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *,
    length(regexp_replace(role, '[<\[](\||/?s>|/?INST\]|/?SYS>|<SYS>)', '\0_', 'g')) + length(role) - length(replace(role, '\', ''))
    + length(regexp_replace(text, '[<\[](\||/?s>|/?INST\]|/?SYS>|<SYS>)', '\0_', 'g')) + length(text) - length(replace(text, '\', '')) AS n
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + 24)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

# Documents by their set of failed filters, then every order of the five filters over those sets.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
k AS (SELECT unnest(range(5)) AS f),
o AS MATERIALIZED (SELECT a.f AS f1, b.f AS f2, c.f AS f3, d.f AS f4, e.f AS f5 FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT list_reduce(list_transform([f1, f2, f3, f4, f5], lambda x: substr('ABCDE', x + 1, 1)), lambda x, y: x || y) AS filter_order, i::INT AS step, [f1, f2, f3, f4, f5][i] AS f,
  list_sum(list_transform(([f1, f2, f3, f4, f5])[1:i - 1], lambda x: 1 << x::INT))::BIGINT AS before FROM o, (SELECT unnest(range(1, 6)) AS i)),
r AS (SELECT part, filter_order, step, f, sum(n) FILTER (fails & (coalesce(before, 0) | (1 << f)) = 0) AS kept, sum(n) FILTER (fails & coalesce(before, 0) = 0 AND fails >> f & 1 = 1) AS removed,
  sum(n) FILTER (fails & coalesce(before, 0) <> 0 AND fails >> f & 1 = 1) AS redundant, sum(n) FILTER (fails = 1 << f) AS unique_fails,
  sum(good) FILTER (fails & coalesce(before, 0) = 0 AND fails >> f & 1 = 1) AS good_lost, sum(toxic) FILTER (fails & coalesce(before, 0) = 0 AND fails >> f & 1 = 1) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r
"""
