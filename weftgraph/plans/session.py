"""A graph with a session's own changes over it: transient and removed edges, excluded nodes, root sets.

The base tables stay as they are; a session keeps a delta in a folder that driver and executors
share, and graph() is the base with the delta, which every operator reads like any other graph. A
session that is opened again on the same folder has the same delta.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.graph import Graph
from weftgraph.plans.shared import listed, located

#: The space of transient edges, unless they are given another one.
TRANSIENT = -1
_KEY = ["name1", "name2", "type_id"]


@dataclass(frozen=True)
class Session:
    base: Graph
    folder: str

    @property
    def _spark(self):
        return self.base.nodes.sparkSession

    def _has(self, part: str) -> bool:
        return bool(listed(self._spark, f"{self.folder}/{part}"))

    def _read(self, part: str, schema: str) -> DataFrame:
        """What was written under a name, a folder for each time; nothing if that never was."""
        folders = [f"{self.folder}/{part}/{n}" for n in listed(self._spark, f"{self.folder}/{part}") if "_SUCCESS" in listed(self._spark, f"{self.folder}/{part}/{n}")]
        return self._spark.read.schema(schema).parquet(*folders) if folders else self._spark.createDataFrame([], schema)

    def _next(self, part: str) -> str:
        return f"{self.folder}/{part}/{len(listed(self._spark, f'{self.folder}/{part}')):06d}"

    def transient(self, edges: DataFrame, key: str, authority: str | None = None, existing: Sequence[int] | None = None, space: int = TRANSIENT) -> int:
        """Adds edges (name1, name2, type_id) to the session under a key, and returns how many are new.

        A key that was used before is reused: nothing is written. Edges that the session has, or that
        the base has in one of the `existing` spaces (an empty list: in any), are not made again. With
        an authority their history has one entry for it.
        """
        path = f"{self.folder}/added/{key}"
        if "_SUCCESS" in listed(self._spark, path):
            return 0
        new = edges.select(F.col("name1").cast("long"), F.col("name2").cast("long"), F.col("type_id").cast("int")).distinct().join(self._added().where(F.col("space_id") == space), _KEY, "left_anti")
        if existing is not None:
            there = self.base.edges if not existing else self.base.edges.where(F.col("space_id").isin(list(existing)))
            new = new.join(there, _KEY, "left_anti")
        new.select(*_KEY, F.lit(space).alias("space_id"), F.lit(authority).cast("string").alias("authority"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(path)
        return self._spark.read.parquet(path).count()

    def _added(self) -> DataFrame:
        return self._read("added", "name1 long, name2 long, type_id int, space_id int, authority string, at timestamp")

    def remove(self, edges: DataFrame) -> None:
        """Edges (name1, name2, type_id) that the graph lacks from now on, transient ones of these keys included."""
        edges.select(F.col("name1").cast("long"), F.col("name2").cast("long"), F.col("type_id").cast("int")).distinct().write.parquet(self._next("removed"))

    def exclude(self, nodes: DataFrame) -> None:
        """Nodes (node_id) that the graph lacks from now on, with their edges; they are no roots any more."""
        nodes.select(F.col("node_id").cast("long")).distinct().write.parquet(self._next("excluded"))
        self.remove_roots(nodes)

    def _excluded(self) -> DataFrame:
        return self._read("excluded", "node_id long").distinct()

    def graph(self) -> Graph:
        """The base with the session's changes."""
        b, added = self.base, self._added()
        gone = self._read("removed", "name1 long, name2 long, type_id int").distinct()
        edges = b.edges.unionByName(added.select(*_KEY, F.lit(True).alias("live"), "space_id").distinct())
        history = b.history.unionByName(
            added.where("authority IS NOT NULL").select(*_KEY, "authority", F.lit(True).alias("live"), F.lit(1).cast(b.history.schema["size"].dataType).alias("size"), F.array(F.col("at").cast(b.history.schema["dates"].dataType.elementType)).alias("dates"))
        )
        parts = {"edges": edges, "history": history, "meta": b.meta}
        if self._has("removed"):
            parts = {k: df.join(gone, _KEY, "left_anti") for k, df in parts.items()}
        nodes = b.nodes
        if self._has("excluded"):
            out = self._excluded()
            nodes = nodes.join(out, "node_id", "left_anti")
            for c in ("name1", "name2"):
                parts = {k: df.join(out.select(F.col("node_id").alias(c)), c, "left_anti") for k, df in parts.items()}
        return replace(b, nodes=nodes, **parts)

    # --- roots: a stack of sets, the last one is the current one ----------------------------------

    def _stack(self) -> list[str]:
        """Folders of the root sets, from the oldest remembered to the current one."""
        names = listed(self._spark, f"{self.folder}/stack")
        return [] if not names else json.loads("".join(r.value for r in self._spark.read.text(f"{self.folder}/stack/{names[-1]}").collect()))

    def _set_stack(self, stack: list[str]) -> None:
        self._spark.createDataFrame([(json.dumps(stack),)], "value string").coalesce(1).write.text(self._next("stack"))

    def roots(self) -> DataFrame:
        """node_id of the current roots."""
        stack = self._stack()
        return self._spark.read.schema("node_id long").parquet(stack[-1]) if stack and stack[-1] else self._spark.createDataFrame([], "node_id long")

    def _set_roots(self, nodes: DataFrame) -> None:
        path = self._next("roots")
        nodes.select(F.col("node_id").cast("long")).distinct().write.parquet(path)
        self._set_stack([*self._stack()[:-1], path])

    def add_roots(self, nodes: DataFrame) -> None:
        """Adds the nodes (node_id) that the graph has and the session doesn't exclude."""
        known = nodes.select("node_id").join(self.graph().nodes, "node_id", "left_semi")
        self._set_roots(self.roots().union(known))

    def remove_roots(self, nodes: DataFrame) -> None:
        if self._stack():
            self._set_roots(self.roots().join(nodes.select("node_id"), "node_id", "left_anti"))

    def clear_roots(self) -> None:
        self._set_stack([*self._stack()[:-1], ""])

    def remember_roots(self) -> None:
        """Keeps the current roots for recall_roots(); they stay the current ones."""
        stack = self._stack() or [""]
        self._set_stack([*stack, stack[-1]])

    def recall_roots(self) -> None:
        """Back to the roots remembered last, or to none, without those that were excluded since."""
        stack = self._stack()[:-1] or [""]
        self._set_stack(stack)
        if stack[-1] and self._has("excluded"):
            self._set_roots(self.roots().join(self._excluded(), "node_id", "left_anti"))

    def close(self) -> None:
        """Removes the delta."""
        at, fs = located(self._spark, self.folder)
        fs.delete(at, True)
