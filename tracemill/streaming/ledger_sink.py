"""The ledger's tables as sinks of streams: a batch is recorded in all of them or in none, and once however often it is run.

A batch of a stream writes its rows into a folder of its own in each table, which a repetition replaces, and then its name
into the table of batches. Readers take only the folders of batches named there. So what is left of a batch that broke off
is not seen, and a batch that is run again finds the ledger as it was before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import ledger as L
from tracemill.plans import shared

DECISION = (
    "route_id string, ts double, session_id string, turn_index long, source string, instr_sha256 string, features_json string, layer string, rung string, cascade boolean, score double, reason string"
)
OUTCOME = "event_id string, route_id string, seq long, observed_at double, status string, escalated boolean, tripwire_name string, edit_failures long, error_results long, output_tokens long, cost_estimate double, user_retried boolean"
TABLES = {
    "decisions": DECISION,
    "embeddings": "route_id string, dim int, vec array<float>",
    "outcome_events": OUTCOME,
    "refused": "what string, id string, reason string",
}
VALUES = ["escalated", "tripwire_name", "edit_failures", "error_results", "output_tokens", "cost_estimate", "user_retried"]


class Ledger:
    """Tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, table: str, schema: str) -> DataFrame:
        """The table's folders, or no rows before there is one; batch is the folder's name."""
        path = f"{self.root}/{table}"
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.range(0).select(F.from_json(F.lit("{}"), f"{schema}, batch string").alias("r")).select("r.*")
        return self.spark.read.schema(f"{schema}, batch string").parquet(path)

    def batches(self) -> DataFrame:
        """batch and rows (map of a table's rows) of all that are recorded."""
        return self._read("batches", "rows map<string,long>")

    def table(self, name: str, but: str | None = None) -> DataFrame:
        """The rows of recorded batches, or of those but one."""
        done = self.batches().select("batch")
        done = done if but is None else done.where(F.col("batch") != but)
        return self._read(name, TABLES[name]).join(done, "batch", "left_semi").drop("batch")

    def outcomes(self) -> DataFrame:
        """The outcome of every decision: pending, or what the last accepted event says."""
        events = self.table("outcome_events")
        twice = events.groupBy("event_id").count().where("count > 1").limit(1).count()
        return L.fold(events, self.table("decisions").select("route_id"), VALUES, unique=not twice)

    def _record(self, batch: str, rows: dict[str, DataFrame]) -> None:
        counts = {}
        for name, df in rows.items():
            path = f"{self.root}/{name}/batch={batch}"
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
            counts[name] = self.spark.read.schema(df.schema).parquet(path).count()
        pairs = [F.lit(x) for k, v in counts.items() for x in (k, v)]
        self.spark.range(1).select(F.create_map(*pairs).cast("map<string,long>").alias("rows")).write.mode("overwrite").parquet(f"{self.root}/batches/batch={batch}")

    def record_decisions(self, new: DataFrame, batch: str) -> None:
        """Decisions (DECISION and embedding, an array of float or null), each with its pending event and its embedding.

        Of a route_id that is known, nothing is recorded again; of several in a batch the first by ts, then by content. A
        decision without the instruction's hash is private, and its embedding isn't kept. One with an embedding that has
        no numbers, or nulls or infinite ones among them, is refused whole.
        """
        names = [c.split()[0] for c in DECISION.split(", ")]
        odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))) | (F.size("embedding") == 0)
        shared_ = F.col("embedding").isNotNull() & F.col("instr_sha256").isNotNull()
        first = new.groupBy("route_id").agg(F.min(F.struct("ts", F.struct(*[c for c in names if c not in ("ts", "route_id")], "embedding"))).alias("f"))
        first = first.select("route_id", "f.ts", "f.col2.*")
        fresh = first.join(self.table("decisions", but=batch).select("route_id"), "route_id", "left_anti").withColumn("bad", F.coalesce(shared_ & odd, F.lit(False)))
        # all tables are of one pass over the batch
        fresh = shared.written(fresh, f"{self.root}/passes/{uuid.uuid4().hex}")
        kept = fresh.where("NOT bad")
        pending = kept.select(F.concat("route_id", F.lit(":pending")).alias("event_id"), "route_id", F.lit(-1).cast("long").alias("seq"), F.col("ts").alias("observed_at"), F.lit("pending").alias("status"))
        missing = [x.split() for x in OUTCOME.split(", ")[5:]]
        self._record(batch, {
            "decisions": kept.select(*names),
            "outcome_events": pending.select("*", *[F.lit(None).cast(t).alias(n) for n, t in missing]),
            "embeddings": kept.where(shared_).select("route_id", F.size("embedding").alias("dim"), F.col("embedding").alias("vec")),
            "refused": fresh.where("bad").select(F.lit("decision").alias("what"), F.col("route_id").alias("id"), F.lit("embedding").alias("reason")),
        })

    def attach_outcomes(self, new: DataFrame, batch: str) -> None:
        """Outcome events (OUTCOME): those that the lifecycle accepts after what is recorded, in order of seq.

        An event id that is recorded, or accepted earlier in the batch, is a repetition and changes nothing. Only the routes
        of the batch are looked up: the status that each has stands before its new events.
        """
        c, names = F.col, [x.split()[0] for x in OUTCOME.split(", ")]
        at = f"{self.root}/passes/{uuid.uuid4().hex}"
        old = self.table("outcome_events", but=batch)
        rank = F.create_map(*[F.lit(x) for pair in L.RANK.items() for x in pair])
        stand = old.groupBy("route_id").agg(F.max_by("status", rank[c("status")]).alias("_stand"))
        # ids only are dealt by id, and the events of those that are recorded or there twice
        ids = new.select("event_id", F.lit(1).alias("n"), F.lit(False).alias("known")).unionByName(old.select("event_id", F.lit(0).alias("n"), F.lit(True).alias("known")))
        ids = ids.where("event_id IS NOT NULL").groupBy("event_id").agg(F.sum("n").alias("n"), F.bool_or("known").alias("known")).where("n > 1 OR (n = 1 AND known)")
        marked = new.select(*names).join(shared.written(ids, f"{at}/ids"), "event_id", "left").where("NOT coalesce(known, false)")
        marked = marked.withColumn("many", c("event_id").isNull() | F.coalesce(c("n") > 1, F.lit(False))).drop("n", "known")
        judged = shared.written(L.fitting_after(marked.join(stand, "route_id", "left"), "_stand").drop("_stand"), f"{at}/events")
        alone, many = judged.where("NOT many").withColumn("accepted", c("fits")), L.once(judged.where("many"))
        refused = lambda df: df.select(F.lit("outcome").alias("what"), c("event_id").alias("id"), F.lit("lifecycle").alias("reason"))
        self._record(batch, {
            "outcome_events": alone.where("accepted").select(*names).unionByName(many.where("accepted").select(*names)),
            "refused": refused(alone.where("NOT accepted")).unionByName(refused(many.where("NOT accepted AND NOT twice")).distinct()),
        })


def run_once(stream: DataFrame, record: Callable[[DataFrame, str], None], name: str, checkpoint: str) -> None:
    """All that a stream has and has not had yet, batch by batch; a batch's name is the stream's and its number."""

    def each(batch: DataFrame, number: int) -> None:
        record(batch, f"{name}-{number}")

    writer: Any = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.start().awaitTermination()
