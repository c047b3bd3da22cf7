"""Changes that arrive as a stream, applied to a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.sources.collection import Collection, latest, upserted
from stellate.sources.storage import VersionedTable


def sequences(collection: Collection) -> VersionedTable:
    """id, seq: the last change of each id that has been applied, deletions too."""
    return VersionedTable(collection.spark, f"{collection.path}/sequences")


def apply_changes(collection: Collection, batch: DataFrame) -> None:
    """Columns of documents and op (upsert or delete), seq: the change of highest seq of each id holds, in whatever batch it comes.

    Documents are saved first and sequence numbers after them; a batch that is run again after a failure between
    the two is applied a second time, with the same result.
    """
    last, table = latest(batch, ["id"], ["seq"]), sequences(collection)
    known = table.read()
    if known is not None:
        late = last.join(known.select("id", F.col("seq").alias("__seq")), "id").where("seq <= __seq").select("id")
        last = last.join(late, "id", "left_anti")
    collection.delete_batch(last.where(F.col("op") == "delete").select("id"))
    collection.upsert(last.where(F.col("op") != "delete").drop("op", "seq"))
    collection.save()
    own = last.select("id", F.col("seq").cast("long").alias("seq"))
    table.commit(own if known is None else upserted(known, own))


def stream_into(collection: Collection, changes: DataFrame, checkpoint: str, once: bool = False):
    """A running query; each micro-batch is one saved version. A batch that is run again changes nothing more."""

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            apply_changes(collection, batch)
        finally:
            batch.unpersist()

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
