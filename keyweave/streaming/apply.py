"""Keeping a table up to date from a stream of change batches, each applied exactly once.

The table stores the mergeable state of :mod:`keyweave.operators.changefeed`, deletes included, so
changes may arrive late and repeated over any number of batches. A batch rewrites only the records
it touches: their old rows go into a deletion vector, their merged rows into new files, and the
batch's number into the same commit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyweave.operators import changefeed
from keyweave.session import materialize
from keyweave.sources.versioned import VersionedTable
from keyweave.streaming.queues import poll


class AppliedTable:
    """Current records of a change feed under ``path``; ``columns`` gives the types as DDL.

    ``columns`` must name the scope columns, the key and the fields, e.g. ``server_id int, rec_key
    string, rec_value string``.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, *, scope: Sequence[str], key: str, seq: str, op: str, fields: Sequence[str] = ()) -> None:
        kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], columns).schema.fields}
        state = [f"s{i} {kinds[c]}" for i, c in enumerate(scope)] + [f"k {kinds[key]}", "w long", "r long", "d long"]
        state += [x for i, c in enumerate(fields) for x in (f"v{i} {kinds[c]}", f"u{i} long")] + ["c long"]
        self._names = {"scope": list(scope), "key": key, "fields": list(fields)}
        self._seq, self._op = seq, op
        self.store = VersionedTable(spark, path, ", ".join(state))

    def records(self) -> DataFrame:
        return changefeed.current_records(self.store.read(), seq=self._seq, **self._names)

    def apply(self, batch: DataFrame, number: int, stream: str = "feed") -> bool:
        """Apply a batch unless its number was applied already; False if so. Fails as a whole or not
        at all."""
        at = self.store.version()
        if int(self.store.properties(at).get(f"batch.{stream}", -1)) >= number:
            return False
        new = materialize(changefeed.reduce_changes(batch, seq=self._seq, op=self._op, **self._names), "batch")
        ids = [f"s{i}" for i in range(len(self._names["scope"]))] + ["k"]
        held, touched = self.store.read(at, positions=True), new.select(*[F.col(c).alias(f"t_{c}") for c in ids])
        same = F.lit(True)
        for c in ids:
            same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
        old = materialize(held.join(touched, same, "left_semi"), "touched")
        merged = changefeed.merge_states(old.select(*new.columns).unionByName(new))
        self.store.commit(added=merged, deleted=old, properties={f"batch.{stream}": str(number)}, expect=at)
        return True

    def poll(self, stream: DataFrame, checkpoint: str, name: str = "feed") -> StreamingQuery:
        """Apply what has arrived on a stream and stop; a batch repeated after a failure is recognised."""
        return poll(stream, lambda df, number: self.apply(df, number, name) and None, checkpoint)
