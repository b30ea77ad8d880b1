"""The queries over ``documents`` and the pipeline, with DuckDB oracles where SQL can say the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedframe.llm import bpe, jaccard, language, lexical, merkle, packing, pii, quality, rules, syncmers, token_counts, toxicity, tree_bpe
from timedframe.llm.common import documents, held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Whole pairwise overlaps and a recursive closure; for small tables.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id
  WHERE 100 * both_have >= 80 * (x.n_shingles + y.n_shingles - both_have)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n_shingles, min(r.b) AS component_id FROM n JOIN r ON n.doc_id = r.a GROUP BY ALL
"""

ORACLES["op6_jaccard_join"] = JACCARD_SQL


def merkle_sql(levels: int = 9) -> str:
    """The manifest by one pair of steps per level; ``levels`` bounds groups and the number of groups to 8 ** levels."""
    leaf = "".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-') || " for c in ("doc_id", "source", "lang", "n_chars"))

    def hashed(text: str) -> str:
        return f"sha256({leaf}coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-'))"

    # The checksum of the decimal id, bit by bit.
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: ord(c)::UBIGINT)), "
        "lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))"
    )
    steps = [
        f"""d AS (SELECT doc_id, coalesce('=' || lang, '') AS k, {hashed("text")} AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN {hashed("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {hashed("text")} END AS shown
  FROM documents)""",
        """w0 AS (SELECT *, leaf AS node, shown AS folded, '' AS proof, CAST(row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS pos,
  count(*) OVER (PARTITION BY k) AS total FROM d)""",
    ]

    def climb(first: str, name: str, carry: str) -> str:
        """Runs of eight become their hash while a key has several nodes; each row keeps its node, proof and folded hash."""
        at = first
        for i in range(levels):
            steps.append(f"{name}n{i} AS (SELECT DISTINCT k, pos, node, total FROM {at} WHERE total > 1)")
            steps.append(f"{name}r{i} AS (SELECT k, pos // 8 AS up, list(node ORDER BY pos) AS run FROM {name}n{i} GROUP BY ALL)")
            steps.append(
                f"""{name}{i + 1} AS (SELECT {carry}, w.k, coalesce(w.pos // 8, 0) AS pos, (w.total + 7) // 8 AS total,
  CASE WHEN run IS NULL THEN w.node ELSE sha256(array_to_string(run, '')) END AS node,
  CASE WHEN run IS NULL THEN w.folded ELSE sha256(array_to_string(run[:pos % 8], '') || w.folded || array_to_string(run[pos % 8 + 2:], '')) END AS folded,
  CASE WHEN run IS NULL THEN w.proof ELSE w.proof || array_to_string(run[:pos % 8], '') || array_to_string(run[pos % 8 + 2:], '') END AS proof
  FROM {at} w LEFT JOIN {name}r{i} r ON w.k = r.k AND w.pos // 8 = r.up AND w.total > 1)"""
            )
            at = f"{name}{i + 1}"
        return at

    top = climb("w0", "w", "doc_id, leaf")
    steps.append(
        f"""g0 AS (SELECT doc_id, leaf, node AS subroot, node, folded, proof, '' AS k, dense_rank() OVER (ORDER BY k) - 1 AS pos,
  (SELECT count(DISTINCT k) FROM {top}) AS total FROM {top})"""
    )
    end = climb("g0", "g", "doc_id, leaf, subroot")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"\nSELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM {end}"
    )


ORACLES["op11_merkle"] = merkle_sql()

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op12_lexical"] = f"""
WITH d AS (SELECT doc_id, {TERMS} AS ts FROM documents),
s AS (SELECT count(*) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM d WHERE len(ts) > 0),
tf AS (SELECT doc_id, len(ts) AS n, t, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
i AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({TERMS}) AS t FROM benchmark) GROUP BY ALL),
w AS (SELECT item_id, t, q, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM i JOIN df USING (t), s),
x AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM w JOIN tf USING (t), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 10
"""


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id", 3, 1))
    return _scored(docs, toxicity.train(docs, labels), toxicity.THRESHOLD)


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id", 3, 1))
    return _scored(docs, quality.train(docs, labels), quality.THRESHOLD)


def _scored(docs: DataFrame, model, threshold: float) -> DataFrame:
    scored = toxicity.score_texts(docs, model, threshold=threshold)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language.train(docs.filter(~held_out("doc_id", 5, 0)))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.detect(docs, pii.train(docs)).drop("text")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", bpe.digests()(F.col("text")).alias("d")).select("doc_id", "d.*")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir), keep=["doc_id"])


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_edited(documents(spark, sf_dir))


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    shown = [c if c != "text" else merkle.tampered() for c in merkle.COLUMNS]
    return merkle.manifest(docs, shown=shown).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op13_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tree_bpe.digests()(F.col("text")).alias("d")).select("doc_id", "d.*")
