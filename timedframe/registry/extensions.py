"""Checked queries over the places where a user's own code joins in."""

from pyspark.sql import functions as F

from timedframe import fixtures as fx
from timedframe.operators import extensions as ex
from timedframe.registry.core import query


@query(
    "ux1_user_filters",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'order ' || o_orderkey || ' is too dear' WHEN o_orderstatus = 'F' THEN 'already done' END AS reject_reason FROM orders""",
)
def _(spark, sf):
    dear = lambda d: F.when(d["o_totalprice"] > 150000, F.concat(F.lit("order "), d["o_orderkey"].cast("string"), F.lit(" is too dear")))
    done = lambda d: F.when(d["o_orderstatus"] == "F", "already done")
    return ex.user_filters(fx.table(spark, sf, "orders"), [dear, done]).select("o_orderkey", "reject_reason")


@query(
    "ux2_hooks",
    "SELECT o_custkey, count(*) AS n, max(o_orderkey) || '!' AS tag FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey",
)
def _(spark, sf):
    hooks = {
        "after_video": [lambda d: d.withColumn("tag", F.concat(F.col("last").cast("string"), F.lit("!")))],
        "pre_process": [lambda d: d.filter("o_orderstatus <> 'F'"), lambda d: d.select("o_custkey", "o_orderkey")],
        "post_process": [lambda d: d.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))],
        "playlist": [lambda d: d.filter(F.lit(False))],
    }
    return ex.apply_hooks(fx.table(spark, sf, "orders"), hooks, until="after_video").select("o_custkey", "n", "tag")


def refusing(batch):
    """A deterministic engine that refuses a whole call for one bad row in it."""
    if (batch["doc_id"] % 97 == 0).any():
        raise ValueError("refused")
    return batch.assign(n=batch["text"].str.len(), said=batch["text"].str.slice(0, 20).str.replace(" ", "_"))


@query(
    "ux3_provider",
    """SELECT doc_id, CASE WHEN doc_id % 97 <> 0 THEN length(text) END AS n, CASE WHEN doc_id % 97 <> 0 THEN replace(substr(text, 1, 20), ' ', '_') END AS said, CASE WHEN doc_id % 97 = 0 THEN 'ValueError: refused' END AS error FROM documents""",
)
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return ex.apply_provider(docs, refusing, "doc_id long, n long, said string, error string", rows=64, tries=2, errors="error")


@query(
    "ux4_actions",
    "SELECT p_partkey, upper(p_name) || ' by ' || p_brand AS title FROM part",
)
def _(spark, sf):
    ex.register_action("upper", lambda d, c: d.withColumn(c, F.upper(c)))
    ex.register_action("credit", lambda d, c, who: d.withColumn(c, F.concat_ws(" by ", c, who)))
    parts = fx.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), "p_brand")
    return ex.apply_actions(parts, [("upper", "title"), ("credit", "title", "p_brand")]).select("p_partkey", "title")
