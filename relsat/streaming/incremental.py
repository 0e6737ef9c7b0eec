"""Facts from a stream: every micro-batch is inserted as a delta and the rules run on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from relsat.engine import Engine
from relsat.operators.staging import mark, sweep


def feed(engine: Engine, relation: str, stream: DataFrame, after: Callable[[Engine, int], None] | None = None, checkpoint: str | None = None, **trigger: object) -> StreamingQuery:
    """Insert the rows of ``stream`` into ``relation`` and saturate after each batch.

    Inserting is idempotent (tables are sets or lattices), so a batch that is replayed after a
    failure changes nothing; only rows that are new to the table fire rules again. Versions of
    tables that a batch has replaced are removed after it: what is queried between batches should
    be read before the next one.
    """
    began = mark()

    def batch(df: DataFrame, number: int) -> None:
        engine.insert_df(relation, df)
        engine.saturate()
        if after is not None:
            after(engine, number)
        sweep(began, *engine.store.rows.values())

    writer = stream.writeStream.foreachBatch(batch).outputMode("append")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()  # type: ignore[arg-type]
