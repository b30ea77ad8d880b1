"""Web-page extraction as Spark columns: text, metadata, embedded data and form fields."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedframe.functions.scalars import group, parse_duration, parse_iso8601
from timedframe.semantics import strip

MIN_ARTICLE_CHARS = 20
MAX_ARTICLE_CHARS = 5000


def _decode(entity: Column) -> Column:
    """Text of one ``&name;`` or numeric entity; unknown ones stay as written."""
    body = F.substring(entity, 2, F.length(entity) - 2)
    names = F.create_map(*[F.lit(x) for name, cp in name2codepoint.items() for x in (name, chr(cp))], F.lit("apos"), F.lit("'"))
    code = F.coalesce(
        F.conv(group(body, r"^#[xX]([0-9a-fA-F]{1,6})$", 1), 16, 10).try_cast("bigint"), group(body, r"^#([0-9]{1,7})$", 1).try_cast("bigint")
    )
    code = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), code)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(names, body), char, entity)


def unescape(text: Column) -> Column:
    """Entities decoded in one sense: an ampersand that was itself escaped opens no new entity."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("(&[^&;]+;)"), 1))
    is_amp = lambda e: e.isin("&amp;", "&#38;", "&#x26;")
    last = F.concat(F.filter(found, lambda e: ~is_amp(e)), F.filter(found, is_amp))
    return F.aggregate(last, text, lambda acc, e: F.replace(acc, e, _decode(e)))


def clean_html(html: Column) -> Column:
    s = F.regexp_replace(html, r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"(?U)\s?<\s?br\s?/?\s?>\s?", "\n")
    s = F.regexp_replace(s, r"(?U)<\s?/\s?p\s?>\s?<\s?p[^>]*>", "\n")
    return strip(unescape(F.regexp_replace(s, "<.*?>", "")))


def _tags(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)(<{tag}\b[^>]*>)"), 1)


def _attr(tag: Column, name: str) -> Column:
    """Value of an attribute in double, single or no quotes."""
    p = rf"""(?is)(?<![\w-])(?:{name})\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(tag.rlike(p), F.concat(F.regexp_extract(tag, p, 1), F.regexp_extract(tag, p, 2), F.regexp_extract(tag, p, 3)))


def meta_tags(html: Column) -> Column:
    """All meta tags as (k, v): lower-case name, property, itemprop or http-equiv, and decoded content."""
    found = F.transform(_tags(html, "meta"), lambda t: F.struct(F.lower(_attr(t, "name|property|itemprop|http-equiv")).alias("k"), unescape(_attr(t, "content")).alias("v")))
    return F.filter(found, lambda m: m["k"].isNotNull() & m["v"].isNotNull())


def meta_content(tags: Column, *names: str) -> Column:
    """Content of the first tag of the first name that occurs."""
    return F.coalesce(*[F.get(F.filter(tags, lambda m: m["k"] == n.lower()), F.lit(0))["v"] for n in names])


def og_property(tags: Column, name: str) -> Column:
    return meta_content(tags, f"og:{name}", f"og-{name}")


def page_title(html: Column) -> Column:
    return strip(unescape(group(html, r"(?is)<title\b[^>]*>([^<]*)</title>", 1)))


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    h, m = F.col(html), F.col("_meta")
    rows = pages.withColumn("_meta", meta_tags(h))
    rta = meta_content(m, "rating") == "RTA-5042-1996-1400-1577-RTA"
    friendly = F.lower(meta_content(m, "isFamilyFriendly"))
    return rows.withColumns(
        {
            "title": page_title(h),
            "og_title": og_property(m, "title"),
            "og_description": og_property(m, "description"),
            "og_image": og_property(m, "image"),
            "description": meta_content(m, "description", "dc.description", "dcterms.description"),
            "twitter_player": meta_content(m, "twitter:player"),
            "age_limit": F.when(rta | friendly.isin("false", "0"), 18).when(friendly.isin("true", "1"), 0),
        }
    ).drop("_meta")


JSON_LD = """array<struct<`@type`:string,`@graph`:array<struct<`@type`:string,name:string,headline:string,description:string,duration:string,uploadDate:string,datePublished:string,contentUrl:string,embedUrl:string,interactionStatistic:array<struct<interactionType:string,userInteractionCount:string>>,hasPart:array<struct<name:string,startOffset:double,endOffset:double>>>>,
name:string,headline:string,description:string,duration:string,uploadDate:string,datePublished:string,contentUrl:string,embedUrl:string,interactionStatistic:array<struct<interactionType:string,userInteractionCount:string>>,hasPart:array<struct<name:string,startOffset:double,endOffset:double>>>>"""
LD_FIELDS = ["@type", "name", "headline", "description", "duration", "uploadDate", "datePublished", "contentUrl", "embedUrl", "interactionStatistic", "hasPart"]


def json_ld(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Typed rows of every JSON-LD item: the block itself or the members of its ``@graph``."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""), 1)
    rows = pages.select(key, F.posexplode(blocks).alias("block", "_json"))
    rows = rows.select(key, "block", F.explode(F.from_json(strip("_json"), JSON_LD)).alias("_o"))
    pick = lambda o: F.struct(*[o[f].alias(f) for f in LD_FIELDS])
    graph = F.col("_o")["@graph"]
    items = F.when(F.size(graph) > 0, F.transform(graph, pick)).otherwise(F.array(pick(F.col("_o"))))
    rows = rows.select(key, "block", F.posexplode(items).alias("item", "i"))
    kind = F.col("i")["@type"]
    is_video, is_article = kind == "VideoObject", kind.isin("Article", "NewsArticle")
    views = F.filter("i.interactionStatistic", lambda s: s["interactionType"].rlike("(?i)(?:watch|view)action$"))
    return rows.select(
        key, "block", "item", kind.alias("type"),
        F.when(is_article, F.col("i.headline")).otherwise(F.col("i.name")).alias("title"),
        unescape(F.col("i.description")).alias("description"),
        F.when(is_video, parse_duration(F.col("i.duration"))).alias("duration"),
        parse_iso8601(F.coalesce("i.uploadDate", "i.datePublished")).alias("timestamp"),
        F.coalesce("i.contentUrl", "i.embedUrl").alias("url"),
        F.get(views, F.lit(0))["userInteractionCount"].try_cast("bigint").alias("view_count"),
        F.col("i.hasPart").alias("chapters"),
    )


def closed_json(text: Column) -> Column:
    """The object or array that ``text`` begins with, up to its closing bracket; NULL if it begins with none or that stays open.

    One fold over brackets, quotes and escapes; brackets inside string literals don't count.
    """
    marks = F.regexp_extract_all(text, F.lit(r"""(?s)(\\.|["{}\[\]]|[^\\"{}\[\]]+)"""), 1)

    def step(state: Column, mark: Column) -> Column:
        quoted, depth, at = state["quoted"], state["depth"], state["at"]
        outside = ~quoted & (state["end"] == 0)
        depth = depth + F.when(outside & mark.isin("{", "["), 1).when(outside & mark.isin("}", "]"), -1).otherwise(0)
        at = at + F.length(mark)
        end = F.when(state["end"] > 0, state["end"]).when(outside & (depth == 0), at).otherwise(0)
        return F.struct((quoted != (mark == '"')).alias("quoted"), depth.alias("depth"), at.alias("at"), end.alias("end"))

    start = F.struct(F.lit(False).alias("quoted"), F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    end = F.aggregate(marks, start, step, lambda s: s["end"])
    return F.when(text.rlike(r"^[{\[]") & (end > 0), F.substr(text, F.lit(1), end))


def embedded_json(html: Column, start: str) -> Column:
    """JSON text after the first match of a start pattern, up to where the object or array closes, whatever script code follows; NULL unless it parses."""
    text = closed_json(group(html, rf"(?s){start}\s*([{{\[].*?)</script", 1))
    return F.when(F.try_parse_json(text).isNotNull(), text)


def embedded_variant(html: Column, start: str) -> Column:
    """The value of ``embedded_json`` as a VARIANT."""
    return F.try_parse_json(closed_json(group(html, rf"(?s){start}\s*([{{\[].*?)</script", 1)))


def hidden_inputs(html: Column) -> Column:
    """Name to value of hidden and submit inputs outside comments; the last of a name wins."""
    tags = _tags(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), "input")
    hidden = F.filter(tags, lambda t: _attr(t, "type").isin("hidden", "submit"))
    pairs = F.transform(hidden, lambda t: F.struct(F.coalesce(_attr(t, "name"), _attr(t, "id")).alias("k"), _attr(t, "value").alias("v")))
    pairs = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    names = F.transform(pairs, lambda p: p["k"])
    final = F.filter(pairs, lambda p, i: F.array_position(F.slice(names, i + 2, F.size(names)), p["k"]) == 0)
    return F.map_from_entries(final)


def extract_articles(pages: DataFrame, url: str = "url", html: str = "html", max_chars: int = MAX_ARTICLE_CHARS) -> DataFrame:
    """Article text with an error for bad addresses and thin pages, cut at ``max_chars`` with a flag."""
    body = F.coalesce(group(F.col(html), r"(?is)<article\b[^>]*>(.*?)</article>", 1), group(F.col(html), r"(?is)<body\b[^>]*>(.*)</body>", 1), F.col(html))
    body = F.regexp_replace(body, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    rows = pages.withColumn("_text", clean_html(body))
    error = (
        F.when(~F.coalesce(F.col(url).rlike("^https?:"), F.lit(False)), "bad_scheme")
        .when(~F.col(url).rlike("^https?://[^/?#]+"), "bad_host")
        .when(F.coalesce(F.length("_text"), F.lit(0)) < MIN_ARTICLE_CHARS, "no_text")
    )
    rows = rows.withColumn("error", error)
    good = F.col("error").isNull()
    return rows.withColumns(
        {
            "title": F.when(good, page_title(F.col(html))),
            "text": F.when(good, F.substring("_text", 1, max_chars)),
            "char_count": F.when(good, F.least(F.length("_text"), F.lit(max_chars))).otherwise(0),
            "truncated": F.coalesce(good & (F.length("_text") > max_chars), F.lit(False)),
        }
    ).drop("_text")
