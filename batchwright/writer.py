"""The front-end: one object for an entity of a model, over tables of a store."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.cancellation import Cancellation, Cancelled, not_attempted
from batchwright.model import Model
from batchwright.operators import flat, graph
from batchwright.options import GraphOptions, Options, UpsertOptions
from batchwright.plans.index import IDX, with_index
from batchwright.result import FAILED, Result
from batchwright.session import materialize
from batchwright.sources.store import Store

log = logging.getLogger("batchwright")


@dataclass
class BatchWriter:
    """Plans operators on the stored tables and commits their next state. Keys, one or several columns, come from the
    model; work is spread over the cluster, so there is no degree of parallelism to choose. A commit is refused if any
    table that the plan has read was changed meanwhile. A call that ``cancellation`` stops writes nothing: its result
    has every row as not attempted."""

    store: Store
    model: Model
    name: str
    cancellation: Cancellation | None = None

    def _indexed(self, batch: DataFrame) -> DataFrame:
        return batch if IDX in batch.columns else with_index(batch)

    def _run(self, batch: DataFrame, options: Options | None, names: Iterable[str], plan: Callable[[DataFrame, dict[str, DataFrame]], Result]) -> Result:
        """``plan`` on the indexed batch and the stored tables of ``names``; then the commit. The outcomes are written
        first, as the plan reads the old versions."""
        began, versions = time.monotonic(), self.store.versions()
        tables = {n: self.store.read(n, versions[n]) for n in names if n in versions}
        batch = self._indexed(batch)
        try:
            with self.cancellation.running() if self.cancellation else nullcontext():
                result = plan(batch, tables)
                result.outcomes = materialize(result.outcomes, "outcomes")
                changed = {n: df for n, df in result.state.items() if n not in versions or df is not tables.get(n)}
                result.retries = self.store.commit(changed, {n: versions.get(n) for n in {*tables, *changed}}, options.retry if options else None)
        except Cancelled:
            log.warning("%s: cancelled", self.name)
            rows = batch.select(F.col(IDX).alias("idx"), F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("operation"), F.lit("").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("message"), F.lit(False).alias("retried"), F.lit(False).alias("is_default_key"))
            result = not_attempted(Result(rows, {}, options or Options()))
            result.round_trips, result.retries = 0, 0
        else:
            result.round_trips = 1
            failed = result.outcomes.where(F.col("status") == FAILED).groupBy("reason").count().collect()
            for row in failed:
                log.warning("%s: %d rows failed: %s", self.name, row["count"], row["reason"])
            log.info("%s: committed %s", self.name, ", ".join(sorted(result.state)))
        result.duration = time.monotonic() - began
        return result

    def _target(self, tables: dict[str, DataFrame], batch: DataFrame) -> DataFrame:
        """The stored table; before its first commit no rows with the batch's columns."""
        return tables[self.name] if self.name in tables else batch.drop(IDX).where(F.lit(False))

    def _flat(self, operator, batch: DataFrame, options: Options | None, others: Iterable[str]) -> Result:
        others = {*others} - {self.name}
        return self._run(batch, options, {self.name, *others}, lambda rows, tables: operator(rows, self._target(tables, rows), self.model, self.name, {n: t for n, t in tables.items() if n in others}, options=options))

    def _related(self) -> set[str]:
        return {fk.entity for fk in self.model[self.name].foreign_keys}

    def insert(self, batch: DataFrame, options: Options | None = None) -> Result:
        return self._flat(flat.insert, batch, options, self._related())

    def update(self, batch: DataFrame, options: Options | None = None) -> Result:
        return self._flat(flat.update, batch, options, self._related())

    def upsert(self, batch: DataFrame, options: UpsertOptions | None = None) -> Result:
        return self._flat(flat.upsert, batch, options, self._related())

    def delete(self, batch: DataFrame, options: Options | None = None) -> Result:
        return self._flat(flat.delete, batch, options, {e.name for e, _ in graph.children_of(self.model, self.name)})

    def _graph(self, operator, frames: dict[str, DataFrame], options: GraphOptions | None) -> Result:
        def plan(batch: DataFrame, tables: dict[str, DataFrame]) -> Result:
            given = {**frames, self.name: batch}
            marks = (IDX, graph.OWNER)
            targets = tables | {n: f.drop(*marks).where(F.lit(False)) for n, f in given.items() if n not in tables}
            return operator(given, targets, self.model, self.name, options, targets)

        return self._run(frames[self.name], options, self.model.entities, plan)

    def insert_graph(self, frames: dict[str, DataFrame], options: GraphOptions | None = None) -> Result:
        return self._graph(graph.insert_graph, frames, options)

    def update_graph(self, frames: dict[str, DataFrame], options: GraphOptions | None = None) -> Result:
        return self._graph(graph.update_graph, frames, options)

    def upsert_graph(self, frames: dict[str, DataFrame], options: GraphOptions | None = None) -> Result:
        return self._graph(graph.upsert_graph, frames, options)

    def delete_graph(self, roots: DataFrame, options: GraphOptions | None = None) -> Result:
        return self._run(roots, options, self.model.entities, lambda rows, tables: graph.delete_graph(rows, tables, self.model, self.name, options))
