"""Checked queries over web pages."""

from pyspark.sql import functions as F

from timedframe import fixtures as fx
from timedframe.fixtures import sql_strip
from timedframe.functions import pages as pg
from timedframe.registry.core import query


def pages(spark, sf):
    return fx.text_table(spark, sf, "pages", "page_id")


def clean_sql(c):
    s = f"regexp_replace({c}, '{fx.WS}+', ' ', 'g')"
    s = f"regexp_replace({s}, ' ?< ?br ?/? ?> ?', chr(10), 'g')"
    s = f"regexp_replace({s}, '< ?/ ?p ?> ?< ?p[^>]*>', chr(10), 'g')"
    s = f"regexp_replace({s}, '<.*?>', '', 'g')"
    for e, t in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        s = f"replace({s}, '{e}', '{t}')"
    return sql_strip(s)


@query("sc22_clean_html", f"SELECT page_id, {clean_sql('html')} AS text FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", pg.clean_html(F.col("html")).alias("text"))


HEAD = "'<meta property=\"og:title\" content=\"T ' || page_id || ' &amp; more\"><meta content=''D' || page_id || ''' name=description><meta name=\"isFamilyFriendly\" content=\"' || CASE WHEN page_id % 2 = 0 THEN 'false' ELSE 'True' END || '\">'"


def tagged(spark, sf):
    """Pages with further head tags written from their own columns."""
    n = F.col("page_id").cast("string")
    head = F.concat(
        F.lit('<meta property="og:title" content="T '), n, F.lit(" &amp; more\"><meta content='D"), n, F.lit("' name=description>"),
        F.lit('<meta name="isFamilyFriendly" content="'), F.when(F.col("page_id") % 2 == 0, "false").otherwise("True"), F.lit('">'),
    )
    return pages(spark, sf).withColumn("html", F.replace("html", F.lit("</head>"), F.concat(head, F.lit("</head>"))))


@query(
    "sc23_page_metadata",
    f"""SELECT page_id, {sql_strip("replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&copy;', '©'), '&amp;', '&')")} AS title, 'T ' || page_id || ' & more' AS og_title, 'D' || page_id AS description, CASE WHEN page_id % 2 = 0 THEN 18 ELSE 0 END AS age_limit FROM pages""",
)
def _(spark, sf):
    return pg.page_metadata(tagged(spark, sf)).select("page_id", "title", "og_title", "description", "age_limit")


@query(
    "sc24_json_ld",
    """SELECT page_id, 0 AS item, 'VideoObject' AS type, 'V' || page_id AS title, 60.0::DOUBLE + page_id AS duration, page_id * 3 AS view_count FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 0, 'NewsArticle', url, NULL, NULL FROM pages WHERE page_id % 2 = 1 UNION ALL SELECT page_id, 1, 'VideoObject', 'G', 3661.0, NULL FROM pages WHERE page_id % 2 = 1""",
)
def _(spark, sf):
    n = F.col("page_id").cast("string")
    video = F.concat(
        F.lit('{"@context":"x","@type":"VideoObject","name":"V'), n, F.lit('","duration":"PT'), (F.col("page_id") + 60).cast("string"),
        F.lit('S","interactionStatistic":[{"interactionType":"http://schema.org/WatchAction","userInteractionCount":'), (F.col("page_id") * 3).cast("string"), F.lit("}]}"),
    )
    graph = F.concat(F.lit('{"@graph":[{"@type":"NewsArticle","headline":"'), F.col("url"), F.lit('"},{"@type":"VideoObject","name":"G","duration":"PT1H1M1S"}]}'))
    block = F.concat(F.lit('<script type="application/ld+json">\n'), F.when(F.col("page_id") % 2 == 0, video).otherwise(graph), F.lit("</script></head>"))
    p = pages(spark, sf).withColumn("html", F.replace("html", F.lit("</head>"), block))
    return pg.json_ld(p, "page_id").select("page_id", "item", "type", "title", "duration", "view_count")


@query("sc25_embedded_json", "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN '{\"id\":' || page_id || ',\"u\":\"' || url || '\"}' END AS state FROM pages")
def _(spark, sf):
    n = F.col("page_id").cast("string")
    body = F.concat(F.lit('{"id":'), n, F.lit(',"u":"'), F.col("url"), F.when(F.col("page_id") % 3 == 0, F.lit('"')).otherwise(F.lit('"}')))
    p = pages(spark, sf).withColumn("html", F.concat("html", F.lit("<script>window.__STATE__ = "), body, F.lit(";</script>")))
    return p.select("page_id", pg.embedded_json(F.col("html"), r"window\.__STATE__\s*=").alias("state"))


@query(
    "sc25_embedded_values",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '{"id":' || page_id || ',"t":"a } ] \\" {","u":[{"v":"' || url || '"}]}' WHEN 1 THEN '[' || page_id || ',{"v":"\\\\"}]' WHEN 2 THEN '{"id":' || page_id || '}' END AS state,
CASE page_id % 4 WHEN 0 THEN page_id WHEN 2 THEN page_id END AS id, CASE page_id % 4 WHEN 0 THEN url END AS v FROM pages""",
)
def _(spark, sf):
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 4
    body = (
        F.when(kind == 0, F.concat(F.lit('{"id":'), n, F.lit(',"t":"a } ] \\" {","u":[{"v":"'), F.col("url"), F.lit('"}]}')))
        .when(kind == 1, F.concat(F.lit("["), n, F.lit(',{"v":"\\\\"}]')))
        .when(kind == 2, F.concat(F.lit('{"id":'), n, F.lit("}")))
        .otherwise(F.concat(F.lit('{"id":{"a":'), n, F.lit("}")))
    )
    code = F.when(kind == 2, "").otherwise(';(function(){var a={"b":[1]};if(a){run("}")}}());')
    p = pages(spark, sf).withColumn("html", F.concat("html", F.lit("<script>var x={};window.__DATA__="), body, code, F.lit('</script><script>{"id":0}</script>')))
    start = r"window\.__DATA__\s*="
    rows = p.select("page_id", pg.embedded_json(F.col("html"), start).alias("state"), pg.embedded_variant(F.col("html"), start).alias("_v"))
    return rows.select("page_id", "state", F.try_variant_get("_v", "$.id", "bigint").alias("id"), F.try_variant_get("_v", "$.u[0].v", "string").alias("v"))


@query("sc26_hidden_inputs", "SELECT page_id, 'csrf=t' || page_id || ';go=Go' AS fields FROM pages")
def _(spark, sf):
    n = F.col("page_id").cast("string")
    form = F.concat(F.lit("<!-- <input type=hidden name=old value=1> --><input type=\"hidden\" name='csrf' value=\"x\"><input name=csrf value=\"t"), n, F.lit('" type=hidden><input type=submit id=go value=Go><input type=text name=q value=1>'))
    p = pages(spark, sf).select("page_id", pg.hidden_inputs(F.concat("html", form)).alias("m"))
    entries = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return p.select("page_id", F.array_join(entries, ";").alias("fields"))


@query(
    "sc27_extract_articles",
    f"""WITH b AS (SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'ftp://x/y' WHEN 1 THEN 'http:///p' ELSE url END AS u, {clean_sql("regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<!--.*?-->', '', 'g')")} AS t FROM pages),
e AS (SELECT *, CASE WHEN NOT regexp_matches(u, '^https?:') THEN 'bad_scheme' WHEN NOT regexp_matches(u, '^https?://[^/?#]+') THEN 'bad_host' WHEN length(t) < 20 THEN 'no_text' END AS error FROM b)
SELECT page_id, error, CASE WHEN error IS NULL THEN substr(t, 1, 5000) END AS text, CASE WHEN error IS NULL THEN least(length(t), 5000) ELSE 0 END::INT AS char_count, error IS NULL AND length(t) > 5000 AS truncated FROM e""",
)
def _(spark, sf):
    u = F.when(F.col("page_id") % 10 == 0, "ftp://x/y").when(F.col("page_id") % 10 == 1, "http:///p").otherwise(F.col("url"))
    out = pg.extract_articles(pages(spark, sf).withColumn("url", u), max_chars=5000)
    return out.select("page_id", "error", "text", "char_count", "truncated")
