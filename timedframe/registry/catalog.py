"""Checked queries over catalog entries."""

from pyspark.sql import functions as F

from timedframe import fixtures as fx
from timedframe.fixtures import oracle
from timedframe.operators import catalog as ct
from timedframe.registry.core import query

TODAY = "1998-06-30"


def entries(spark, sf):
    return fx.ord_entries(spark, sf)


def ids(df):
    return df.select("playlist_id", "id")


def where(cond, extra=""):
    return oracle("ord_entries", f"{extra} SELECT playlist_id, id FROM ord_entries WHERE {cond}")


@query(
    "fl1_match_filter",
    where("view_count > 100000 AND starts_with(title, '1') AND NOT contains(status, 'P') AND (duration IS NULL OR duration < 300) AND regexp_matches(title, 'U.G')"),
)
def _(spark, sf):
    return ids(ct.match_filter(entries(spark, sf), "view_count > 100000 & title ^= 1 & status !*= P & duration <? 300 & title ~= 'U.G'"))


@query("fl1_presence", where("age_limit IS NOT NULL AND duration IS NULL"))
def _(spark, sf):
    return ids(ct.match_filter(entries(spark, sf), "age_limit & !duration & !no_such_field"))


@query("fl2_coercion", where("view_count > 204800 AND duration >= 120 AND view_count < 400000"))
def _(spark, sf):
    return ids(ct.match_filter(entries(spark, sf), "view_count>200k & duration>=2:00 & view_count<400KB"))


FIRST_BREAK = """, f AS (SELECT playlist_id AS p, min(playlist_index) AS stop FROM ord_entries WHERE {bad} GROUP BY 1)
SELECT playlist_id, id FROM ord_entries LEFT JOIN f ON p = playlist_id WHERE (stop IS NULL OR playlist_index < stop) AND {good}"""


@query("fl3_match_any", oracle("ord_entries", FIRST_BREAK.format(bad="NOT (view_count > 20000 OR status = 'O')", good="(title = '5-LOW' OR view_count > 300000)")))
def _(spark, sf):
    out = ct.match_any(entries(spark, sf), ["title=5-LOW", "view_count>300000"], ["view_count>20000", "status=O"], ["playlist_id"], ["playlist_index"])
    return ids(out)


@query(
    "fl4_screen_entries",
    oracle("ord_entries", """SELECT id, CASE WHEN status = 'F' THEN 'archived' WHEN NOT regexp_matches(title, '(?i)(urgent|low|high)') THEN 'title not matched' WHEN regexp_matches(title, '(?i)2-h') THEN 'title rejected'
  WHEN upload_date NOT BETWEEN DATE '1996-01-01' AND DATE '1998-06-30' THEN 'date out of range' WHEN view_count < 50000 THEN 'too few views' WHEN view_count > 400000 THEN 'too many views'
  WHEN age_limit > 12 THEN 'age restricted' WHEN NOT (coalesce(duration > 100, false)) THEN 'filter not passed' END AS reject_reason FROM ord_entries"""),
)
def _(spark, sf):
    rules = ct.Rules(
        archive=fx.ord_archive(spark, sf), extractor="orders", match_title="(urgent|low|high)", reject_title="2-h", date_after="19960101", date_before="today",
        today=TODAY, min_views=50000, max_views=400000, age_limit=12, filters=["duration>100"],
    )
    return ct.screen_entries(entries(spark, sf), rules).select("id", "reject_reason")


@query("fl5_take_until", oracle("ord_entries", FIRST_BREAK.format(bad="status = 'F'", good="true")))
def _(spark, sf):
    return ids(ct.take_until(entries(spark, sf), ["playlist_id"], ["playlist_index"], F.col("status") == "F"))


@query(
    "fl6_skip_after_failures",
    oracle("ord_entries", """, f AS (SELECT *, coalesce(sum((status = 'P')::INT) OVER (PARTITION BY playlist_id ORDER BY playlist_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM ord_entries)
SELECT playlist_id, id FROM f WHERE n < 2"""),
)
def _(spark, sf):
    return ids(ct.skip_after_failures(entries(spark, sf), ["playlist_id"], ["playlist_index"], F.col("status") == "P", 2))


@query("fl8_in_date_range", where("upload_date BETWEEN DATE '1998-02-28' AND DATE '1998-06-16'"))
def _(spark, sf):
    return ids(ct.in_date_range(entries(spark, sf), "upload_date", "19980330-1month", "today-2weeks", TODAY))


@query("fl9_age_allowed", where("age_limit IS NULL OR age_limit <= 10"))
def _(spark, sf):
    return ids(ct.age_allowed(entries(spark, sf), 10))


@query("fl20_size_between", oracle("part_formats", "SELECT part_id FROM part_formats WHERE filesize IS NULL OR filesize BETWEEN 950000 AND 1500000"))
def _(spark, sf):
    return ct.size_between(fx.part_formats(spark, sf), 950000, 1500000).select("part_id")


@query(
    "jn1_not_archived",
    oracle("ord_entries ord_archive", """SELECT playlist_id, id FROM ord_entries WHERE 'orders ' || id NOT IN (SELECT archive_id FROM ord_archive)
  AND NOT (id % 5 = 0 AND ('orders ' || (id + 1) IN (SELECT archive_id FROM ord_archive) OR 'orders ' || (id + 2) IN (SELECT archive_id FROM ord_archive)))"""),
)
def _(spark, sf):
    k = F.col("id")
    e = entries(spark, sf).withColumn("old_ids", F.when(k % 5 == 0, F.array((k + 1).cast("string"), (k + 2).cast("string"))))
    return ids(ct.not_archived(e, fx.ord_archive(spark, sf), "Orders"))


@query(
    "jn17_add_playlist_fields",
    oracle("ord_entries", """SELECT id, c_name AS playlist_title, c_mktsegment AS playlist_uploader, count(*) OVER (PARTITION BY playlist_id) AS n_entries, max(playlist_index) OVER (PARTITION BY playlist_id) AS last_playlist_index
FROM ord_entries JOIN customer ON playlist_id = c_custkey"""),
)
def _(spark, sf):
    p = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("playlist_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("uploader"))
    return ct.add_playlist_fields(entries(spark, sf), p).select("id", "playlist_title", "playlist_uploader", "n_entries", "last_playlist_index")


@query(
    "wn23_autonumber",
    oracle("ord_entries", """SELECT id, n + 6 AS autonumber, lpad((n + 6)::VARCHAR, 4, '0') AS autonumber_text, lpad(playlist_index::VARCHAR, length(last::VARCHAR)::INT, '0') AS index_text FROM (
SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY playlist_index) AS n, max(playlist_index) OVER (PARTITION BY playlist_id) AS last FROM ord_entries)"""),
)
def _(spark, sf):
    return ct.autonumber(entries(spark, sf), ["playlist_id"], ["playlist_index"], 7, 4).select("id", "autonumber", "autonumber_text", "index_text")


@query(
    "sr6_playlist_items",
    oracle("ord_entries", """, n AS (SELECT *, playlist_index - 1 AS i, max(playlist_index) OVER (PARTITION BY playlist_id) AS n FROM ord_entries),
s AS (SELECT *, CASE WHEN i = 1 THEN 0 WHEN i >= 3 AND i < 9 AND (i - 3) % 2 = 0 THEN 1 WHEN i = n - 1 THEN 2 WHEN i <= n - 1 AND i > 5 THEN 3 END AS part FROM n)
SELECT playlist_id, id, row_number() OVER (PARTITION BY playlist_id ORDER BY part, CASE WHEN part = 3 THEN -i ELSE i END) AS position FROM s WHERE part IS NOT NULL"""),
)
def _(spark, sf):
    return ct.playlist_items(entries(spark, sf), "2,4:9:2,-1,:7:-1").select("playlist_id", "id", "position")


@query("sr7_reorder_reverse", oracle("ord_entries", "SELECT playlist_id, id, row_number() OVER (PARTITION BY playlist_id ORDER BY playlist_index DESC) AS position FROM ord_entries"))
def _(spark, sf):
    return ct.reorder(entries(spark, sf), "reverse").select("playlist_id", "id", "position")


@query("sr7_reorder_random")
def _(spark, sf):
    return ct.reorder(entries(spark, sf), "random", 7).select("playlist_id", "id", "position")


@query("sr13_max_items", where("playlist_index <= 3"))
def _(spark, sf):
    return ids(ct.max_items(entries(spark, sf), 3))


@query("se1_ordered_distinct", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def _(spark, sf):
    return ct.ordered_distinct(fx.table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query(
    "se3_resolve_options",
    """WITH u AS (SELECT DISTINCT p_type AS value FROM part) SELECT value, CASE WHEN regexp_matches(value, '^(?i:s.*)$') THEN 2 ELSE 0 END AS rule FROM u WHERE NOT regexp_matches(value, '^(?i:e.*)$') AND NOT (regexp_matches(value, '^(?i:s.*)$') AND false)""",
)
def _(spark, sf):
    u = fx.table(spark, sf, "part").select(F.col("p_type").alias("value")).distinct()
    return ct.resolve_options(["all", "-s.*", "s.*", "-small"], u, {"small": ["e.*"]}).select("value", "rule")


@query(
    "se4_merge_records",
    """WITH a AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN o_orderstatus END AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price FROM orders WHERE o_orderkey % 4 <> 3),
b AS (SELECT o_orderkey AS id, o_orderpriority AS title, 1.5::DOUBLE AS price, o_custkey AS cust FROM orders WHERE o_orderkey % 5 <> 4)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.title = '' THEN coalesce(b.title, a.title) ELSE coalesce(a.title, b.title) END AS title, coalesce(a.price, b.price) AS price, cust FROM a FULL JOIN b ON a.id = b.id""",
)
def _(spark, sf):
    o, k = fx.table(spark, sf, "orders"), F.col("o_orderkey")
    a = o.filter(k % 4 != 3).select(k.alias("id"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("o_orderstatus")).alias("title"), F.when(k % 2 == 0, F.col("o_totalprice")).alias("price"))
    b = o.filter(k % 5 != 4).select(k.alias("id"), F.col("o_orderpriority").alias("title"), F.lit(1.5).alias("price"), F.col("o_custkey").alias("cust"))
    return ct.merge_records(a, b, ["id"])


@query("wn24_unique_names")
def _(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, F.concat("p_name", F.lit("-"), (k % 5 + 2).cast("string"))).otherwise(F.col("p_name"))
    df = fx.table(spark, sf, "part").select(F.col("p_brand").alias("parent"), name.alias("name"), k.alias("ord"))
    return ct.unique_names(df)


@query(
    "sr9_rank_thumbnails",
    oracle("part_formats", """SELECT part_id, row_number() OVER (PARTITION BY media_id ORDER BY CASE WHEN part_id % 4 = 0 THEN (part_id % 3) ELSE -1 END, coalesce(width, -1), coalesce(height, -1), CASE WHEN part_id % 2 = 0 THEN format_id ELSE '' END, url, format_idx) AS rank FROM part_formats"""),
)
def _(spark, sf):
    k = F.col("part_id")
    t = fx.part_formats(spark, sf).select(
        "media_id", "part_id", F.when(k % 4 == 0, (k % 3).cast("int")).alias("preference"), "width", "height", F.when(k % 2 == 0, F.col("format_id")).alias("id"), "url", F.col("format_idx").alias("thumb_idx")
    )
    return ct.rank_thumbnails(t).select("part_id", "rank")


LANGS = ["en", "en-GB", "fr", "de"]
SUBS_SQL = """, subs AS (SELECT playlist_id AS media_id, ['en', 'en-GB', 'fr', 'de'][(id % 4 + 1)::INT] AS lang, playlist_index AS idx, ['vtt', 'srt', 'json3'][(id % 3 + 1)::INT] AS ext,
  'https://s.example/' || (id % 9) AS url, id % 5 < 2 AS automatic FROM ord_entries),
have AS (SELECT * FROM (SELECT *, bool_and(automatic) OVER (PARTITION BY media_id, lang) AS auto FROM subs) WHERE automatic = auto),
langs AS (SELECT media_id, lang, min(idx) AS idx, bool_and(automatic) AS automatic FROM have GROUP BY ALL)"""


def subtitles(spark, sf):
    k = F.col("id")
    pick = lambda vs, n: F.element_at(F.array(*[F.lit(v) for v in vs]), (k % n + 1).cast("int"))
    return entries(spark, sf).select(
        F.col("playlist_id").alias("media_id"),
        pick(LANGS, 4).alias("lang"),
        F.col("playlist_index").alias("idx"),
        pick(["vtt", "srt", "json3"], 3).alias("ext"),
        F.concat(F.lit("https://s.example/"), (k % 9).cast("string")).alias("url"),
        F.lit(None).cast("string").alias("data"),
        (k % 5 < 2).alias("automatic"),
    )


@query(
    "sr10_select_subtitles_default",
    oracle("ord_entries", SUBS_SQL + """ SELECT media_id, lang, automatic FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY CASE WHEN NOT automatic AND lang = 'en' THEN 0
  WHEN NOT automatic AND starts_with(lang, 'en') THEN 1 WHEN lang = 'en' THEN 2 WHEN starts_with(lang, 'en') THEN 3 WHEN NOT automatic THEN 4 ELSE 5 END, idx, lang) AS rn FROM langs) WHERE rn = 1"""),
)
def _(spark, sf):
    return ct.select_subtitles(subtitles(spark, sf))


@query("sr10_select_subtitles_rules", oracle("ord_entries", SUBS_SQL + " SELECT media_id, lang, automatic FROM langs WHERE lang IN ('en', 'fr')"))
def _(spark, sf):
    return ct.select_subtitles(subtitles(spark, sf), ["en.*", "fr", "-en-.*"])


@query(
    "sr11_pick_sub_format",
    oracle("ord_entries", SUBS_SQL + """ SELECT media_id, lang, idx, ext FROM (SELECT *, row_number() OVER (PARTITION BY media_id, lang ORDER BY CASE ext WHEN 'srt' THEN 0 WHEN 'vtt' THEN 1 ELSE 2 END, idx DESC) AS rn FROM have) WHERE rn = 1"""),
)
def _(spark, sf):
    return ct.pick_sub_format(ct.available_subtitles(subtitles(spark, sf)), "srt/vtt").select("media_id", "lang", "idx", "ext")


@query(
    "jn18_merge_subtitles",
    oracle("ord_entries", SUBS_SQL + """, a AS (SELECT * FROM subs WHERE idx % 2 = 0), b AS (SELECT media_id, lang, url, min(idx) AS idx FROM subs WHERE idx % 2 = 1 GROUP BY ALL)
SELECT media_id, lang, url, idx, 1 AS origin FROM a UNION ALL SELECT media_id, lang, url, idx, 2 FROM b WHERE (media_id, lang, url) NOT IN (SELECT (media_id, lang, url) FROM a)"""),
)
def _(spark, sf):
    s = subtitles(spark, sf)
    return ct.merge_subtitles(s.filter(F.col("idx") % 2 == 0), s.filter(F.col("idx") % 2 == 1)).select("media_id", "lang", "url", "idx", "origin")


def tracks(spark, sf):
    k = F.col("p_partkey")
    return fx.table(spark, sf, "part").select(F.when(k % 10 != 0, F.col("p_brand")).alias("project"), F.concat(F.lit("t"), k.cast("string"), F.lit(".mp3")).alias("track"))


@query(
    "ag11_project_counts",
    """WITH t AS (SELECT coalesce(CASE WHEN p_partkey % 10 <> 0 THEN p_brand END, '_ungrouped') AS project, count(*) AS n FROM part GROUP BY 1),
p AS (SELECT DISTINCT p_brand AS project FROM part UNION SELECT 'empty_' || n_name FROM nation) SELECT coalesce(p.project, t.project) AS project, coalesce(n, 0) AS tracks FROM p FULL JOIN t ON p.project = t.project""",
)
def _(spark, sf):
    empty = fx.table(spark, sf, "nation").select(F.concat(F.lit("empty_"), "n_name").alias("project"))
    projects = fx.table(spark, sf, "part").select(F.col("p_brand").alias("project")).distinct().unionByName(empty)
    return ct.project_counts(projects, tracks(spark, sf))


@query("jn15_valid_default", "SELECT p_partkey AS pointer_id FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 2 = 0")
def _(spark, sf):
    k = F.col("p_partkey")
    track = F.concat(F.lit("t"), k.cast("string"), F.when(k % 2 == 0, ".mp3").otherwise(".wav"))
    pointers = fx.table(spark, sf, "part").select(k.alias("pointer_id"), F.col("p_brand").alias("project"), track.alias("track"))
    return ct.valid_default(pointers, tracks(spark, sf)).select("pointer_id")


RULES = [("casino", r"https?://(?:\w+\.)*casino"), ("mobile", r"https?://m\."), ("secure", "https://"), ("generic", ".*")]


@query(
    "jn13_classify_urls",
    r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://(?:\w+\.)*casino') THEN 'casino' WHEN regexp_matches(url, '^https?://m\.') THEN 'mobile' WHEN starts_with(url, 'https://') THEN 'secure' ELSE 'generic' END AS extractor FROM pages",
)
def _(spark, sf):
    return ct.classify_urls(fx.table(spark, sf, "pages"), RULES).select("page_id", "extractor")


@query(
    "jn14_match_domain_rule",
    r"""WITH d AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS domain FROM pages),
r AS (SELECT n_nationkey AS ord, CASE n_nationkey WHEN 0 THEN 'casino-win.example.com' WHEN 1 THEN 'example.net' WHEN 2 THEN 'example.com' ELSE 'none' || n_nationkey END AS rule, n_nationkey + 5 AS max_requests FROM nation)
SELECT page_id, domain, arg_min(rule, ord) AS rule_domain, arg_min(max_requests, ord) AS max_requests FROM d LEFT JOIN r ON domain = rule OR ends_with(domain, '.' || rule) GROUP BY ALL""",
)
def _(spark, sf):
    n = F.col("n_nationkey")
    name = F.when(n == 0, "casino-win.example.com").when(n == 1, "example.net").when(n == 2, "example.com").otherwise(F.concat(F.lit("none"), n.cast("string")))
    rules = fx.table(spark, sf, "nation").select(n.alias("ord"), name.alias("domain"), (n + 5).alias("max_requests"))
    return ct.match_domain_rule(fx.table(spark, sf, "pages"), rules).select("page_id", "domain", "rule_domain", "max_requests")
