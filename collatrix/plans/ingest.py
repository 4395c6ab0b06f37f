"""Ingest queries: duplicates, quality control, alignment, digests, text and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.functions.scalar import clamp, clean_text, failed_reasons, finite, first_match, fold, formula_guard
from collatrix.operators.ingest import best_per_group, canonical, duplicate_groups
from collatrix.plans.registry import query
from collatrix.sources.tables import table


@query("canonical_documents", "SELECT doc_id AS key, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents")
def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's canonical one, the least id with the same bytes."""
    return canonical(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query(
    "dedup_exact_documents",
    """SELECT sha256(text) AS digest, min(doc_id) AS representative, count(*) AS members FROM documents GROUP BY text""",
)
def dedup_exact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct text."""
    return duplicate_groups(table(spark, sf_dir, "documents"), F.col("text"), "doc_id").select("digest", "representative", "members")


@query(
    "dedup_group_report",
    """SELECT sha256(text) AS digest, count(*) AS members, string_agg(doc_id::VARCHAR, ';' ORDER BY doc_id) AS keys
    FROM documents GROUP BY text HAVING count(*) > 1""",
)
def dedup_group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of more than one document, with their ids in order."""
    groups = duplicate_groups(table(spark, sf_dir, "documents"), F.col("text"), "doc_id").where("members > 1")
    return groups.select("digest", "members", F.array_join(F.col("keys").cast("array<string>"), ";").alias("keys"))


QC_RULES_SQL = """list_filter([
    CASE WHEN n_chars < 400 THEN 'too_short' END, CASE WHEN n_chars > 6000 THEN 'too_long' END,
    CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' END,
    CASE WHEN text LIKE '%$$$%' THEN 'symbols' END, CASE WHEN text LIKE '%http%' THEN 'link' END], lambda x: x IS NOT NULL)"""


def qc(docs: DataFrame) -> DataFrame:
    """Documents with all rules they fail, and whether they fail none."""
    reasons = failed_reasons(
        [
            ("too_short", F.col("n_chars") < 400),
            ("too_long", F.col("n_chars") > 6000),
            ("language", ~F.col("lang").isin("en", "de", "fr")),
            ("symbols", F.col("text").contains("$$$")),
            ("link", F.col("text").contains("http")),
        ]
    )
    return docs.select("doc_id", "source", reasons.alias("reasons")).withColumn("eligible", F.col("reasons") == "")


@query(
    "qc_filter_reasons",
    f"""SELECT doc_id, source, array_to_string(r, ';') AS reasons, len(r) = 0 AS eligible
    FROM (SELECT doc_id, source, {QC_RULES_SQL} AS r FROM documents)""",
)
def qc_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the quality-control rules it fails."""
    return qc(table(spark, sf_dir, "documents"))


@query(
    "qc_reason_counts",
    f"""SELECT reason, count(*) AS n FROM (SELECT unnest({QC_RULES_SQL}) AS reason FROM documents) GROUP BY reason""",
)
def qc_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule fails; a document counts for every one."""
    failed = qc(table(spark, sf_dir, "documents")).where(~F.col("eligible"))
    return failed.select(F.explode(F.split("reasons", ";")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "qc_yield_by_source",
    f"""WITH q AS (SELECT source, len({QC_RULES_SQL}) = 0 AS ok FROM documents),
    s AS (SELECT source, count(*) FILTER (WHERE ok) AS eligible, count(*) AS total FROM q GROUP BY source)
    SELECT eligible, count(*) AS sources, max(total) AS largest FROM s GROUP BY eligible""",
)
def qc_yield_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources have how many eligible documents: a histogram of counts."""
    per_source = qc(table(spark, sf_dir, "documents")).groupBy("source").agg(F.count_if("eligible").alias("eligible"), F.count("*").alias("total"))
    return per_source.groupBy("eligible").agg(F.count("*").alias("sources"), F.max("total").alias("largest"))


@query(
    "manifest_alignment_check",
    """SELECT 'unlabelled' AS kind, count(*) AS n FROM documents ANTI JOIN labels USING (doc_id)
    UNION ALL SELECT 'unknown', count(*) FROM labels ANTI JOIN documents USING (doc_id)
    UNION ALL SELECT 'aligned', count(*) FROM labels SEMI JOIN documents USING (doc_id)""",
)
def manifest_alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the keys of two tables are the same set, by two anti joins."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    parts = {"unlabelled": docs.join(labels, "doc_id", "left_anti"), "unknown": labels.join(docs, "doc_id", "left_anti"), "aligned": labels.join(docs, "doc_id", "left_semi")}
    counted = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in parts.items()]
    return counted[0].unionAll(counted[1]).unionAll(counted[2])


@query(
    "document_digests",
    """SELECT doc_id, substr(sha256(text), 1, 12) AS short_id, sha1(text) AS sha1,
    (('0x' || substr(sha256(text), 1, 8))::BIGINT % 5)::BIGINT AS fold FROM documents""",
)
def document_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, short ids and hash folds of texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    return docs.select("doc_id", F.substring("digest", 1, 12).alias("short_id"), F.sha1("text").alias("sha1"), fold(F.col("digest")).alias("fold"))


@query(
    "point_lookup_by_hash",
    """WITH d AS (SELECT doc_id, source, n_chars, sha256(text) AS digest FROM documents)
    SELECT doc_id, source, n_chars FROM d WHERE digest = (SELECT digest FROM d WHERE doc_id = 7) ORDER BY n_chars DESC, doc_id""",
)
def point_lookup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents whose digest is that of document 7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("digest"))
    wanted = docs.where("doc_id = 7").select("digest")
    return docs.join(wanted, "digest", "left_semi").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id")


@query(
    "first_row_per_source",
    """SELECT source, doc_id, lang FROM documents
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1""",
)
def first_row_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest document of each source; ties by id."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars")
    return best_per_group(docs, ["source"], [F.desc("n_chars"), "doc_id"]).drop("n_chars")


CONTEXTS = (("/en/", "english"), ("/(fr|es)/", "romance"), ("^https", "secure"), ("blog", "blog"))


@query(
    "context_from_url",
    """SELECT page_id, CASE WHEN lower(url) LIKE '%/en/%' THEN 'english'
    WHEN regexp_matches(lower(url), '/(fr|es)/') THEN 'romance' WHEN lower(url) LIKE 'https%' THEN 'secure'
    WHEN lower(url) LIKE '%blog%' THEN 'blog' ELSE 'other' END AS context FROM pages""",
)
def context_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of the first pattern that a url matches."""
    return table(spark, sf_dir, "pages").select("page_id", first_match(F.col("url"), CONTEXTS, "other").alias("context"))


@query(
    "text_expressions",
    """SELECT conv_id, turn, coalesce(nullif(trim(text), ''), 'empty') AS cleaned, greatest(1, least(5, turn)) AS clamped,
    replace(upper(role), 'S', '_') AS role_mark, length(text) AS n_chars, substr(text, 1, 12) AS head FROM conversations""",
)
def text_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback text, clamping, replacing and slicing."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id",
        "turn",
        clean_text(F.col("text"), "empty").alias("cleaned"),
        clamp(F.col("turn"), 1, 5).alias("clamped"),
        F.replace(F.upper("role"), F.lit("S"), F.lit("_")).alias("role_mark"),
        F.length("text").cast("long").alias("n_chars"),
        F.substring("text", 1, 12).alias("head"),
    )


@query(
    "finite_scores",
    """SELECT s_suppkey, CASE WHEN try_cast(x AS DOUBLE) IS NULL OR isnan(try_cast(x AS DOUBLE)) OR isinf(try_cast(x AS DOUBLE)) THEN -1.0::DOUBLE
    ELSE try_cast(x AS DOUBLE) END AS score
    FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'n/a' ELSE s_acctbal::VARCHAR END AS x FROM supplier)""",
)
def finite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from text; what is missing, NaN or infinite becomes -1."""
    raw = F.when(F.col("s_suppkey") % 4 == 0, "nan").when(F.col("s_suppkey") % 4 == 1, "n/a").otherwise(F.col("s_acctbal").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", finite(raw).alias("score"))


@query(
    "json_semi_filter",
    """SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
    SEMI JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND value > 90) w USING (user_id)""",
)
def json_semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties of the events of wanted users, by a semi join."""
    events = table(spark, sf_dir, "events")
    first_type = events.agg(F.min("event_type").alias("event_type"))
    wanted = events.where("value > 90").join(F.broadcast(first_type), "event_type", "left_semi").select("user_id").distinct()
    chosen = events.join(wanted, "user_id", "left_semi")
    return chosen.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "csv_formula_guard",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(ltrim(x), '^[=+\\-@]') THEN '''' || x ELSE x END AS guarded
    FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '=' || text WHEN 1 THEN '  -' || text ELSE text END AS x FROM conversations)""",
)
def csv_formula_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text for spreadsheets: what would be a formula is quoted."""
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("="), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("  -"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", formula_guard(raw).alias("guarded"))
