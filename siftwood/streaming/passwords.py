"""Passwords and locked archives that arrive in any order."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from siftwood.functions.formats import opens
from siftwood.runtime import ship

OUTPUT = StructType([StructField(n, StringType()) for n in ("root_id", "node_id", "password", "source_node_id")])
_PENDING = StructType([StructField("content", BinaryType())])
_PASSWORD = StructType([StructField("source_node_id", StringType())])


class Broker(StatefulProcessor):
    """For each root: known passwords, and archives that none has opened.  A new password is tried on all that wait, a
    new archive with all that are known; what opens is told once, and waits no longer.  State expires after ttl_ms."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        name = StructType([StructField("name", StringType())])
        self.passwords = handle.getMapState("passwords", name, _PASSWORD, ttlDurationMs=self.ttl_ms)
        self.pending = handle.getMapState("pending", name, _PENDING, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for batch in rows:
            for r in batch.itertuples():
                if isinstance(r.password, str) and r.password:
                    if not self.passwords.containsKey((r.password,)):
                        self.passwords.updateValue((r.password,), (r.node_id,))
                        out += self._tried(key[0], [(n[0], c[0]) for n, c in self.pending.iterator()], [(r.password, r.node_id)])
                elif r.content is not None:
                    self.pending.updateValue((r.node_id,), (bytes(r.content),))
                    out += self._tried(key[0], [(r.node_id, bytes(r.content))], [(p[0], s[0]) for p, s in self.passwords.iterator()])
        yield pd.DataFrame(out, columns=OUTPUT.names)

    def _tried(self, root: str, archives: list, passwords: list) -> list[tuple]:
        out = []
        for node, raw in archives:
            for password, source in sorted(passwords):
                try:
                    fits = opens(zipfile.ZipFile(io.BytesIO(bytes(raw))), password)
                except zipfile.BadZipFile:
                    fits = False
                if fits:
                    self.pending.removeKey((node,))
                    out.append((root, node, password, source))
                    break
        return out

    def close(self) -> None:
        pass


def unlocked(events: DataFrame, ttl_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """(root_id, node_id, password, source_node_id) of a stream of (root_id, node_id, password or null, content or null).

    Without ttl_ms state never expires.  Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    ship(events.sparkSession)
    return events.groupBy("root_id").transformWithStateInPandas(Broker(ttl_ms), OUTPUT, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
