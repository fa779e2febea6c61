"""Rule graphs that grow by batches of events: only sessions with new events are looked at again."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.functions.weights import decay_rational, target_value
from sessionrec.operators.graph import RULES, Rule, session_pairs_banded, session_pairs_windowed, union_graphs, weighted
from sessionrec.operators.windows import prune_topk, recent_seeds
from sessionrec.schema import EVENTS

SUMS = "graph string, aid_x int, aid_y int, mass double, pairs long"
COUNTS = "aid int, item_freq long"


def pair_sums(events: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """graph, aid_x, aid_y, mass, pairs: sums of each rule before penalty and rule weight, and of how many event pairs."""
    rules, out = list(rules), []
    most = max((rule.max_events for rule in rules), default=0)
    ranked = recent_seeds(events, most) if most else events
    for rule in rules:
        pairs = session_pairs_windowed(ranked.where(F.col("seed_rank") <= rule.max_events), rule) if rule.max_events else session_pairs_banded(events, rule)
        value = target_value(F.col("type_y")) * decay_rational(F.col("dt").cast("double") / 1000, rule.decay_seconds)
        out.append(pairs.groupBy("aid_x", "aid_y").agg(F.sum(value).alias("mass"), F.count(F.lit(1)).alias("pairs")).withColumn("graph", F.lit(rule.name)))
    return union_graphs(out).select("graph", "aid_x", "aid_y", "mass", "pairs")


@dataclass(frozen=True)
class GraphState:
    """A graph's state below a folder: all events by batch, and by version the pair sums of the rules and the items' counts.

    A version is written before its number is: what fails on the way leaves the last one in place, and can be done again.
    """

    spark: SparkSession
    path: str
    rules: tuple[Rule, ...] = RULES

    def versions(self) -> list[int]:
        """Of all updates that ended, in order."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in files.listStatus(place)) if files.exists(place) else []

    def events(self) -> DataFrame:
        done = self.versions()
        return self.spark.read.schema(EVENTS).parquet(*[f"{self.path}/events/{v}" for v in done]) if done else self.spark.createDataFrame([], EVENTS)

    def _table(self, name: str, schema: str) -> DataFrame:
        done = self.versions()
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{done[-1]}") if done else self.spark.createDataFrame([], schema)

    def sums(self) -> DataFrame:
        return self._table("sums", SUMS)

    def frequency(self) -> DataFrame:
        return self._table("frequency", COUNTS)

    def update(self, batch: DataFrame) -> DataFrame:
        """Takes a batch of events in; gives one row: new_events, sessions, old_events (that were read again), changed_pairs, all_pairs.

        Sessions with new events are built with and without them; the signed difference of the two is added to the sums, and a pair
        without event pairs left goes. An event may push another one out of the newest of its session, so sums may fall too.
        Item counts are added up; penalties depend on them and are applied when edges are asked for. What is read again
        grows with the batch's sessions; the sums are written anew, and grow with the graph.
        """
        version = (self.versions() or [0])[-1] + 1
        old, sums, frequency = self.events(), self.sums(), self.frequency()
        batch.select(*[F.col(f.name).cast(f.dataType) for f in EVENTS]).write.mode("overwrite").parquet(f"{self.path}/events/{version}")
        new = self.spark.read.schema(EVENTS).parquet(f"{self.path}/events/{version}")
        touched = new.select("session").distinct()
        again = old.join(touched, "session", "left_semi")
        before, after = pair_sums(again, self.rules), pair_sums(again.unionByName(new), self.rules)
        signed = after.unionByName(before.select("graph", "aid_x", "aid_y", (-F.col("mass")).alias("mass"), (-F.col("pairs")).alias("pairs")))
        changed = f"{self.path}/changed/{version}"
        keys = ["graph", "aid_x", "aid_y"]
        signed.groupBy(*keys).agg(F.sum("mass").alias("mass"), F.sum("pairs").alias("pairs")).where("pairs <> 0 or abs(mass) > 1e-12").write.mode("overwrite").parquet(changed)
        difference = self.spark.read.schema(SUMS).parquet(changed)
        total = sums.unionByName(difference).groupBy(*keys).agg(F.sum("mass").alias("mass"), F.sum("pairs").alias("pairs")).where("pairs > 0")
        total.write.mode("overwrite").parquet(f"{self.path}/sums/{version}")
        frequency.unionByName(new.groupBy("aid").agg(F.count(F.lit(1)).alias("item_freq"))).groupBy("aid").agg(F.sum("item_freq").alias("item_freq")).write.mode("overwrite").parquet(f"{self.path}/frequency/{version}")
        report = new.agg(F.count(F.lit(1)).alias("new_events"), F.count_distinct("session").alias("sessions"))
        for one, name in ((again, "old_events"), (difference, "changed_pairs"), (self.spark.read.schema(SUMS).parquet(f"{self.path}/sums/{version}"), "all_pairs")):
            report = report.crossJoin(F.broadcast(one.agg(F.count(F.lit(1)).alias(name))))
        report.coalesce(1).write.mode("overwrite").json(f"{self.path}/report/{version}")
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{self.path}/done/{version}")
        return self.spark.read.schema(report.schema).json(f"{self.path}/report/{version}")

    def edges(self) -> DataFrame:
        """aid_x, aid_y, weight, graph: all edges of all rules."""
        frequency, sums = self.frequency(), self.sums()
        return union_graphs(weighted(sums.where(F.col("graph") == rule.name).drop("graph"), frequency, rule).select("aid_x", "aid_y", "weight", "graph") for rule in self.rules)

    def graph_topk(self) -> DataFrame:
        """The best edges of each item and rule, as rule_graph_topk() of all events gives them."""
        edges = self.edges()
        return union_graphs(prune_topk(edges.where(F.col("graph") == rule.name), ["graph", "aid_x"], "weight", rule.topk, ["aid_y"]) for rule in self.rules)
