"""Which files to index again, kept up to date as versions arrive: a content hash per file in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "id string, state string, hash string"


class _Versions(StatefulProcessor):
    """The last known hash of one file; a row without a hash says that the file is gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("hash", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  named by Spark
        before = self.known.get()[0] if self.known.exists() else None
        last = None  # (seq, hash) of the latest version in this batch
        for part in rows:
            for seq, value in zip(part["seq"], part["hash"], strict=True):
                if last is None or (seq, value or "") >= (last[0], last[1] or ""):
                    last = (seq, value if isinstance(value, str) else None)
        after = last[1] if last else before
        if after is None and before is not None:
            self.known.clear()
            yield pd.DataFrame({"id": [key[0]], "state": ["removed"], "hash": [None]})
        elif after is not None and after != before:
            self.known.update((after,))
            yield pd.DataFrame({"id": [key[0]], "state": ["new" if before is None else "changed"], "hash": [after]})

    def close(self) -> None:
        pass


def changed_files(files: DataFrame) -> DataFrame:
    """(id, state, hash) of files that are new, changed or removed, from a stream of versions (id, seq, text; null: removed).

    Of several versions of a file in one batch the one of the greatest ``seq`` counts. The session needs the RocksDB state store; state is one hash per file.
    """
    versions = files.select(F.col("id").cast("string").alias("id"), F.col("seq").cast("bigint").alias("seq"), F.when(F.col("text").isNotNull(), F.sha2("text", 256)).alias("hash"))
    return versions.groupBy("id").transformWithStateInPandas(_Versions(), CHANGES, "Update", "None")
