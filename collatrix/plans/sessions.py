"""Session and dossier queries: a user's events are a session, an event's k names the item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.operators.dossier import build
from collatrix.operators.sessions import accepted, last_outcomes, latest_revision
from collatrix.plans.registry import query
from collatrix.sources.tables import table


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, session, item, outcome): clicks record, views are uncertain, the rest exclude."""
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "click", "recorded").when(F.col("event_type") == "view", "uncertain").otherwise("excluded")
    return e.select("event_id", F.col("user_id").alias("session"), (F.get_json_object("props", "$.k").cast("long") % 20).alias("item"), outcome.alias("outcome"), "ts", "value")


REVIEWS_SQL = """reviews AS (SELECT event_id, user_id AS session, CAST(json_extract(props, '$.k') AS BIGINT) % 20 AS item,
    CASE event_type WHEN 'click' THEN 'recorded' WHEN 'view' THEN 'uncertain' ELSE 'excluded' END AS outcome, ts, value FROM events)"""


@query("latest_revision", f"WITH {REVIEWS_SQL} SELECT session, event_id, item, outcome FROM reviews QUALIFY row_number() OVER (PARTITION BY session ORDER BY event_id DESC) = 1")
def latest_revision_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each session."""
    return latest_revision(reviews(spark, sf_dir).select("session", "event_id", "item", "outcome"), "session", "event_id")


@query(
    "revision_chain",
    f"""WITH {REVIEWS_SQL} SELECT event_id, session, row_number() OVER w AS revision, lag(event_id) OVER w AS parent FROM reviews WINDOW w AS (PARTITION BY session, item ORDER BY event_id)""",
)
def revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review as a revision of its item, with the one before it."""
    w = W.partitionBy("session", "item").orderBy("event_id")
    return reviews(spark, sf_dir).select("event_id", "session", F.row_number().over(w).alias("revision"), F.lag("event_id").over(w).alias("parent"))


@query(
    "session_fold",
    f"""WITH {REVIEWS_SQL}, last AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY session, item ORDER BY event_id DESC) = 1)
    SELECT session, count(*) AS items, count(*) FILTER (WHERE outcome = 'recorded') AS recorded, count(*) FILTER (WHERE outcome = 'uncertain') AS uncertain,
    count(*) FILTER (WHERE outcome = 'excluded') AS excluded, string_agg(item::VARCHAR, ';' ORDER BY event_id) AS review_order FROM last GROUP BY session""",
)
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each session: the last outcome of each item, counted, and items in review order."""
    last = last_outcomes(reviews(spark, sf_dir), "session", "item", "event_id")
    order = F.array_sort(F.collect_list(F.struct("event_id", "item")))
    counts = [F.count_if(F.col("outcome") == x).alias(x) for x in ("recorded", "uncertain", "excluded")]
    grouped = last.groupBy("session").agg(F.count("*").alias("items"), *counts, order.alias("o"))
    return grouped.select("session", "items", "recorded", "uncertain", "excluded", F.array_join(F.transform("o", lambda s: s["item"].cast("string")), ";").alias("review_order"))


@query(
    "export_counts",
    f"""WITH {REVIEWS_SQL}, last AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY session, item ORDER BY event_id DESC) = 1),
    plan AS (SELECT session, item FROM (SELECT DISTINCT session FROM reviews), (SELECT unnest(range(30)) AS item)),
    state AS (SELECT session, coalesce(outcome, 'pending') AS outcome FROM plan LEFT JOIN last USING (session, item))
    SELECT outcome, count(*) AS n, count(DISTINCT session) AS sessions FROM state GROUP BY outcome""",
)
def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of thirty planned items in every session; those without a review are pending."""
    r = reviews(spark, sf_dir)
    last = last_outcomes(r, "session", "item", "event_id").select("session", "item", "outcome")
    plan = r.select("session").distinct().select("session", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("item"))
    state = plan.join(last, ["session", "item"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("pending")))
    return state.groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"))


@query(
    "version_conflicts",
    f"""WITH RECURSIVE {REVIEWS_SQL}, e AS (SELECT event_id, session, 1 + event_id % 3 AS version, row_number() OVER (PARTITION BY session ORDER BY event_id) AS n FROM reviews),
    f AS (SELECT event_id, session, n, version = 1 AS is_accepted, 1 + (version = 1)::INT AS current FROM e WHERE n = 1
        UNION ALL SELECT e.event_id, e.session, e.n, e.version = f.current, f.current + (e.version = f.current)::INT FROM f JOIN e ON e.session = f.session AND e.n = f.n + 1)
    SELECT session, count(*) AS updates, count(*) FILTER (WHERE is_accepted) AS accepted, count(*) FILTER (WHERE NOT is_accepted) AS refused FROM f GROUP BY session""",
)
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that named a stale version, per session."""
    e = reviews(spark, sf_dir).select("event_id", "session", (1 + F.col("event_id") % 3).alias("version"))
    marked = accepted(e, "session", "version", "event_id")
    return marked.groupBy("session").agg(F.count("*").alias("updates"), F.count_if("is_accepted").alias("accepted"), F.count_if(~F.col("is_accepted")).alias("refused"))


@query(
    "conversation_documents",
    """SELECT conv_id, count(*) AS turns, string_agg(role || ':' || length(text), '|' ORDER BY turn, role, text) AS outline, max(turn) AS last_turn FROM conversations GROUP BY conv_id""",
)
def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in order, as one row."""
    c = table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    line = lambda s: F.concat(s["role"], F.lit(":"), F.length(s["text"]).cast("string"))
    grouped = c.groupBy("conv_id").agg(F.count("*").alias("turns"), ordered.alias("o"), F.max("turn").alias("last_turn"))
    return grouped.select("conv_id", "turns", F.array_join(F.transform("o", line), "|").alias("outline"), "last_turn")


PHOTOS_SQL = """photos AS (SELECT doc_id AS pos, sha256(text) AS sha, doc_id % 17 <> 0 AS readable, doc_id % 13 = 0 AS ambiguous FROM documents),
    uniq AS (SELECT arg_min(pos, pos) AS photo, arg_min(readable, pos) AS readable, arg_min(ambiguous, pos) AS ambiguous, list(pos) AS copies FROM photos GROUP BY sha),
    src AS (SELECT photo, unnest(copies) AS pos FROM uniq WHERE readable),
    sup AS (SELECT pos, 'f' || (pos % 3) AS family, coalesce(pos % 101, 0) / 100.0::DOUBLE AS strength FROM photos WHERE pos % 2 = 0),
    ent AS (SELECT photo, family, strength FROM sup JOIN src USING (pos) QUALIFY row_number() OVER (PARTITION BY photo, family ORDER BY strength DESC, pos) = 1)"""


def dossier(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("sha256"))
    pid = F.col("pos").cast("string").alias("photo_id")
    photos = docs.select("pos", pid, "sha256", (F.col("pos") % 17 != 0).alias("readable"), (F.col("pos") % 13 == 0).alias("ambiguous"))
    supports = docs.where("pos % 2 = 0").select("pos", pid, F.concat(F.lit("f"), F.col("pos") % 3).alias("family"), F.concat(F.lit("r"), "pos").alias("region"), ((F.col("pos") % 101) / F.lit(100.0)).alias("strength"))
    ownership = docs.where("pos % 5 = 0").select("pos", pid, F.concat(F.lit("r"), "pos").alias("region"), F.lit("supported").alias("owner_status"))
    return build(photos, supports, ownership)


@query("dossier_entries", f"WITH {PHOTOS_SQL} SELECT photo::VARCHAR AS photo, family, round(strength, 6) AS strength FROM ent")
def dossier_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest evidence of each family for each distinct, readable photo."""
    return dossier(spark, sf_dir)[0].select("photo", "family", F.round("strength", 6).alias("strength"))


@query(
    "dossier_requests",
    f"""WITH {PHOTOS_SQL}, req AS (SELECT photo, 'unreadable' AS reason FROM uniq WHERE NOT readable UNION ALL SELECT photo, 'unsupported' FROM uniq WHERE readable AND photo NOT IN (SELECT photo FROM ent)
        UNION ALL SELECT photo, 'ambiguous' FROM uniq WHERE readable AND ambiguous)
    SELECT reason, count(*) AS n FROM req GROUP BY reason""",
)
def dossier_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked for, counted by reason."""
    return dossier(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("n"))
