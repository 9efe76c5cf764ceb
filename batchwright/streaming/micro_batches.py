"""The operators over a stream: every micro-batch is a batch, committed as one version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from batchwright.model import Model
from batchwright.options import Options
from batchwright.plans.index import with_index
from batchwright.result import Result
from batchwright.sources.store import Store


def mutate_stream(stream: DataFrame, store: Store, model: Model, name: str, operator: Callable[..., Result], order: tuple[str, ...], options: Options | None = None, on_result: Callable[[Result, int], None] | None = None) -> DataStreamWriter:
    """A writer (call ``start`` on it) that applies ``operator`` (flat.insert and the like) to every micro-batch in
    the order of the columns ``order``. Inserts that are seen again after a failure are duplicates, so they do no harm."""

    def apply(batch: DataFrame, number: int) -> None:
        version = store.version(name)
        target = store.read(name, version) if version else batch.where(F.lit(False))
        result = operator(with_index(batch, *order), target, model, name, options=options)
        store.commit(result.state, {name: version}, options.retry if options else None)
        if on_result:
            on_result(result, number)

    return stream.writeStream.foreachBatch(apply)
