"""Checked queries over lookups between segments and side tables."""

from pyspark.sql import functions as F

from timedframe import fixtures as fx
from timedframe.fixtures import oracle
from timedframe.operators import lookups as lk
from timedframe.registry.core import query
from timedframe.registry.segments import gate_sql
from timedframe.semantics import r4

VOICES = ["voice_a", "voice_b", "voice_c"]


@query(
    "jn2_apply_windows",
    oracle("conv_segments conv_windows", """SELECT s.media_id, s.seg_id, round(coalesce(w.start, s.start), 4) AS start, round(coalesce(w."end", s."end"), 4) AS "end"
FROM conv_segments s LEFT JOIN conv_windows w ON s.media_id = w.media_id AND s.seg_id = w.seg_id"""),
)
def _(spark, sf):
    out = lk.apply_windows(fx.conv_segments(spark, sf), fx.conv_windows(spark, sf))
    return out.select("media_id", "seg_id", r4("start").alias("start"), r4("end").alias("end"))


@query(
    "jn2_repeated_windows",
    oracle("conv_segments conv_windows", """, w AS (SELECT media_id, seg_id, start + media_id % 2 AS start, "end" + media_id % 2 AS "end" FROM conv_windows)
SELECT s.media_id, s.seg_id, round(coalesce(w.start, s.start), 4) AS start, round(coalesce(w."end", s."end"), 4) AS "end"
FROM conv_segments s LEFT JOIN w ON s.media_id = w.media_id AND s.seg_id = w.seg_id"""),
)
def _(spark, sf):
    w = fx.conv_windows(spark, sf).select("media_id", "seg_id", "start", "end")
    moved = w.filter("media_id % 2 = 1").select("media_id", "seg_id", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"), F.lit(2).alias("edit"))
    out = lk.apply_windows(fx.conv_segments(spark, sf), moved.unionByName(w.withColumn("edit", F.lit(1))), "edit")
    return out.select("media_id", "seg_id", r4("start").alias("start"), r4("end").alias("end"))


@query(
    "jn3_choose_windows",
    oracle("conv_segments conv_windows", """, w AS (SELECT * FROM conv_windows WHERE media_id % 3 = 0)
SELECT media_id, seg_id, round(start, 4) AS start, round("end", 4) AS "end", 'window' AS origin FROM w
UNION ALL SELECT media_id, seg_id, round(start, 4), round("end", 4), 'segment' FROM conv_segments WHERE media_id NOT IN (SELECT media_id FROM w)"""),
)
def _(spark, sf):
    w = fx.conv_windows(spark, sf).filter(F.col("media_id") % 3 == 0)
    out = lk.choose_windows(fx.conv_segments(spark, sf), w)
    return out.select("media_id", "seg_id", r4("start").alias("start"), r4("end").alias("end"), "origin")


def terms(spark, sf):
    return fx.table(spark, sf, "benchmark").select(
        F.explode(F.array(F.col("text"), F.substring("text", 1, 12))).alias("source"), F.col("item_id").cast("string").alias("target")
    )


@query(
    "jn4_match_glossary",
    oracle("doc_lines", """, media AS (SELECT media_id, string_agg(text, '' ORDER BY seg_id) AS t FROM doc_lines GROUP BY media_id),
g AS (SELECT unnest([text, substr(text, 1, 12)]) AS source, item_id::VARCHAR AS target FROM benchmark)
SELECT DISTINCT media_id, source, target FROM media, g WHERE contains(t, source)"""),
)
def _(spark, sf):
    return lk.match_glossary(fx.doc_lines(spark, sf), terms(spark, sf))


@query(
    "jn5_match_pairs",
    oracle("doc_lines", """, media AS (SELECT media_id, string_agg(text, '' ORDER BY seg_id) AS t FROM doc_lines GROUP BY media_id),
g AS (SELECT DISTINCT lower(substr(text, 1, 3)) || '-' || substr(text, 8, 4) AS pair, substr(text, 1, 3) AS note FROM benchmark)
SELECT DISTINCT media_id, pair, note FROM media, g WHERE len(string_split(pair, '-')) = 2
  AND contains(t, string_split(pair, '-')[1]) AND contains(t, string_split(pair, '-')[2])"""),
)
def _(spark, sf):
    pairs = (
        fx.table(spark, sf, "benchmark")
        .select(
            F.concat(F.lower(F.substring("text", 1, 3)), F.lit("-"), F.substring("text", 8, 4)).alias("pair"),
            F.substring("text", 1, 3).alias("note"),
        )
        .distinct()
    )
    return lk.match_pairs(fx.doc_lines(spark, sf), pairs)


@query(
    "jn6_unknown_names",
    oracle("doc_lines", """, words AS (SELECT media_id, unnest(string_split(text, ' ')) AS name, unnest(range(0, len(string_split(text, ' ')))) AS i, seg_id FROM doc_lines),
numbered AS (SELECT media_id, seg_id * 100000 + i AS pos, name FROM words WHERE name <> ''),
capped AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pos) AS rn FROM numbered)
SELECT media_id, pos, name FROM capped WHERE rn <= 30 AND name NOT IN (SELECT string_split(text, ' ')[1] FROM benchmark)"""),
)
def _(spark, sf):
    names = fx.doc_lines(spark, sf).select("media_id", "seg_id", F.posexplode(F.split("text", " ")).alias("i", "name"))
    names = names.select("media_id", (F.col("seg_id") * 100000 + F.col("i")).alias("pos"), "name")
    known = fx.table(spark, sf, "benchmark").select(F.get(F.split("text", " "), F.lit(0)).alias("source"))
    return lk.unknown_names(names, known)


REVISED_SQL = f""", j AS (SELECT s.media_id, s.seg_id, s.text, r.text AS new, CASE WHEN r.text IS NOT NULL AND r.text <> s.text THEN {gate_sql('r.text')} END AS poor
  FROM conv_segments s LEFT JOIN conv_revisions r ON s.media_id = r.media_id AND s.seg_id = r.seg_id),
reviewed AS (SELECT media_id, seg_id, CASE WHEN poor = false THEN new ELSE text END AS text, CASE poor WHEN true THEN 'rejected' WHEN false THEN 'accepted' END AS review FROM j)"""


@query("jn7_apply_revisions", oracle("conv_segments conv_revisions", REVISED_SQL + " SELECT media_id, seg_id, text, review FROM reviewed"))
def _(spark, sf):
    return lk.apply_revisions(fx.conv_segments(spark, sf), fx.conv_revisions(spark, sf)).select("media_id", "seg_id", "text", "review")


@query("jn7_repeated_revisions", oracle("conv_segments conv_revisions", REVISED_SQL + " SELECT media_id, seg_id, text, review FROM reviewed"))
def _(spark, sf):
    rev = fx.conv_revisions(spark, sf).select("media_id", "seg_id", "text")
    early = rev.select("media_id", "seg_id", F.concat(F.lit("draft "), "text").alias("text"), F.lit(1).alias("edit"))
    both = rev.withColumn("edit", F.lit(2)).unionByName(early)
    return lk.apply_revisions(fx.conv_segments(spark, sf), both, order="edit").select("media_id", "seg_id", "text", "review")


@query(
    "jn7_revision_audit",
    oracle("conv_segments conv_revisions", REVISED_SQL + " SELECT media_id, count(*) FILTER (review = 'accepted') AS accepted, count(*) FILTER (review = 'rejected') AS rejected FROM reviewed GROUP BY media_id"),
)
def _(spark, sf):
    return lk.revision_audit(lk.apply_revisions(fx.conv_segments(spark, sf), fx.conv_revisions(spark, sf)))


@query(
    "jn8_apply_speaker_tags",
    """SELECT conv_id AS media_id, turn AS seg_id, CASE WHEN turn % 2 = 1 THEN role || '_' || (turn % 3) ELSE 'narrator' END AS speaker FROM conversations""",
)
def _(spark, sf):
    conv = fx.table(spark, sf, "conversations")
    seg = conv.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seg_id"), "text")
    tag = F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" "), F.col("role"), F.lit("_"), (F.col("turn") % 3).cast("string"))).otherwise("  ")
    tags = conv.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seg_id"), tag.alias("speaker"))
    return lk.apply_speaker_tags(seg, tags).select("media_id", "seg_id", "speaker")


@query(
    "jn8_repeated_tags",
    """SELECT conv_id AS media_id, turn AS seg_id, CASE WHEN turn % 3 = 0 THEN 'narrator' ELSE role || '_' || (turn % 3) END AS speaker FROM conversations""",
)
def _(spark, sf):
    conv = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seg_id"), "text", "role")
    edits = conv.filter("seg_id % 3 > 0").select("media_id", "seg_id", "role", F.explode(F.sequence(F.lit(0), F.col("seg_id") % 3)).alias("edit"))
    tags = edits.select("media_id", "seg_id", "edit", F.concat_ws("_", "role", F.col("edit").cast("string")).alias("speaker"))
    return lk.apply_speaker_tags(conv.drop("role"), tags, "edit").select("media_id", "seg_id", "speaker")


@query(
    "jn9_assign_voices",
    oracle("conv_segments", """, sp AS (SELECT media_id, speaker, min(seg_id) AS f FROM conv_segments WHERE speaker <> 'narrator' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY f, speaker) AS rn FROM sp)
SELECT media_id, speaker, ['voice_a', 'voice_c'][((rn - 1) % 2 + 1)::INT] AS voice FROM r
UNION ALL SELECT DISTINCT media_id, 'narrator', 'voice_b' FROM conv_segments"""),
)
def _(spark, sf):
    return lk.assign_voices(fx.conv_segments(spark, sf), VOICES, "voice_b")


@query(
    "jn20_resolve_voice",
    """WITH v AS (SELECT n_nationkey AS voice_idx, n_name AS label, 'v' || n_nationkey AS id FROM nation),
r AS (SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NATION_' || c_nationkey WHEN 2 THEN 'v' || c_nationkey ELSE 'none' || c_nationkey END AS voice FROM customer),
h AS (SELECT string_agg(label, ', ' ORDER BY voice_idx) AS have, arg_min(id, voice_idx) AS first_id FROM v)
SELECT request_id, CASE WHEN voice IS NULL THEN first_id ELSE coalesce(a.id, b.id) END AS voice_id,
  CASE WHEN voice IS NOT NULL AND a.id IS NULL AND b.id IS NULL THEN 'unknown voice; available: ' || have END AS error
FROM r LEFT JOIN v a ON voice = a.label LEFT JOIN v b ON voice = b.id, h""",
)
def _(spark, sf):
    v = fx.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("voice_idx"), F.col("n_name").alias("label"), F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("id")
    )
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
    want = F.when(k == 1, F.concat(F.lit("NATION_"), n)).when(k == 2, F.concat(F.lit("v"), n)).when(k == 3, F.concat(F.lit("none"), n))
    req = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), want.alias("voice"))
    return lk.resolve_voice(req, v).select("request_id", "voice_id", "error")
