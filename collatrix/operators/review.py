"""Review sessions: plan a batch, record outcomes, move on; all state is an append-only event table.

A session's state is the fold of its events, and its version is their number. Every
change names the version it was made on and is refused if that is stale. One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.operators.contracts import ContractError
from collatrix.operators.coverage import greedy_plan

OUTCOMES = ("recorded", "uncertain", "excluded")
NOTE_MOST = 4000
EVENTS = "session string, version int, ts timestamp, kind string, item string, outcome string, note string, budget int"


@dataclass
class State:
    """What the events of a session add up to."""

    session: str
    version: int = 0
    batch: int = 0
    budget: int = 25
    plan: list[str] = field(default_factory=list)
    reviews: dict[str, tuple[str, str]] = field(default_factory=dict)

    def named(self, *outcomes: str) -> list[str]:
        return [i for i, (o, _) in self.reviews.items() if o in outcomes]

    def pending(self) -> list[str]:
        return [i for i in self.plan if i not in self.reviews]


class ReviewSessions:
    """Sessions over an incidence (item, grp) of string items."""

    def __init__(self, spark: SparkSession, path: str, incidence: DataFrame, repeats: int = 2):
        self.spark, self.path, self.incidence, self.repeats = spark, path, incidence, repeats

    def _append(self, rows: list[tuple]) -> None:
        stamped = self.spark.createDataFrame([(s, v, None, k, i, o, n, b) for s, v, k, i, o, n, b in rows], EVENTS)
        stamped.withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(self.path)

    def state(self, session: str) -> State:
        """The fold of a session's events; a session is as long as its reviews, which one person made."""
        rows = self.events().where(F.col("session") == session).orderBy("version", "kind", "note").collect()
        if not rows:
            raise KeyError(session)
        out = State(session)
        for r in rows:
            out.version = r["version"]
            if r["kind"] == "batch":
                out.batch += 1
                out.budget, out.plan = r["budget"], r["item"].split("\n") if r["item"] else []
            else:
                out.reviews.pop(r["item"], None)
                out.reviews[r["item"]] = (r["outcome"], r["note"])
        return out

    def _plan(self, budget: int, reviews: dict) -> list[str]:
        done = [i for i, (o, _) in reviews.items() if o != "excluded"]
        gone = [i for i, (o, _) in reviews.items() if o == "excluded"]
        frame = lambda xs: self.spark.createDataFrame([(x,) for x in xs], "item string")
        pool = self.incidence.join(F.broadcast(frame(gone)), "item", "left_anti") if gone else self.incidence
        return [i for _, i, _ in greedy_plan(pool, budget, repeats=self.repeats, reviewed=frame(done) if done else None)]

    def create(self, budget: int = 25) -> State:
        session = uuid.uuid4().hex[:12]
        self._append([(session, 1, "batch", "\n".join(self._plan(budget, {})), None, None, budget)])
        return self.state(session)

    def _current(self, session: str, version: int) -> State:
        now = self.state(session)
        if now.version != version:
            raise ContractError(f"session {session} is at version {now.version}, not {version}")
        return now

    def review(self, session: str, version: int, item: str, outcome: str, note: str = "") -> State:
        """Record an outcome for an item of the current batch; a later one takes an earlier one's place."""
        if outcome not in OUTCOMES or len(note) > NOTE_MOST:
            raise ValueError(f"an outcome is one of {OUTCOMES}, a note has {NOTE_MOST} characters at most")
        now = self._current(session, version)
        if item not in now.plan:
            raise ContractError(f"{item} is not in the current batch")
        self._append([(session, version + 1, "review", item, outcome, note, None)])
        return self.state(session)

    def next_batch(self, session: str, version: int) -> State:
        """Plan the next batch: what was reviewed counts as covered, what was excluded never comes back."""
        now = self._current(session, version)
        if now.pending():
            raise ContractError(f"{len(now.pending())} items of the batch are not reviewed")
        self._append([(session, version + 1, "batch", "\n".join(self._plan(now.budget, now.reviews)), None, None, now.budget)])
        return self.state(session)

    def covered(self, session: str) -> tuple[int, int]:
        """Groups seen, and seen repeatedly, in the reviewed items that were not excluded."""
        done = self.state(session).named("recorded", "uncertain")
        if not done:
            return 0, 0
        held = self.incidence.join(F.broadcast(self.spark.createDataFrame([(i,) for i in done], "item string")), "item", "left_semi")
        n = held.groupBy("grp").agg(F.count("*").alias("n"))
        r = n.agg(F.count("*").alias("seen"), F.count_if(F.col("n") >= self.repeats).alias("repeated")).first()
        return r["seen"], r["repeated"]

    def export(self, session: str) -> DataFrame:
        """(position, item, outcome, note, groups): reviewed items in review order, then those pending."""
        now = self.state(session)
        rows = [(i, o, n) for i, (o, n) in now.reviews.items()] + [(i, "pending", "") for i in now.pending()]
        listed = self.spark.createDataFrame([(p, *r) for p, r in enumerate(rows, 1)], "position int, item string, outcome string, note string")
        groups = self.incidence.join(F.broadcast(listed.select("item")), "item").groupBy("item").agg(F.array_sort(F.collect_set("grp")).alias("groups"))
        return listed.join(groups, "item", "left").select("position", "item", "outcome", "note", "groups").orderBy("position")


def policy_weight(cohesion, risk):
    """The weight of a group from two ratings of 0 to 4; others fail."""
    fine = cohesion.between(0, 4) & risk.between(0, 4)
    return F.when(fine, cohesion / 4.0 * (1 - risk / 4.0)).otherwise(F.raise_error(F.lit("a rating is 0 to 4")).cast("double"))
