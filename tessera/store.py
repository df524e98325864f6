"""A thin facade: the tables of one tenant or of all, with the operators as methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import bitmap, kv, oplog, zset


@dataclass(frozen=True)
class Store:
    """Named objects over an op-log and the logs of sorted sets and bitmaps. Immutable: a write gives a new store."""

    log: DataFrame
    zsets: DataFrame | None = None
    bits: DataFrame | None = None

    def tenant(self, name: str) -> Store:
        return Store(self.log.where(F.col("tenant") == name), self.zsets, self.bits)

    def tenants(self) -> DataFrame:
        return self.log.select("tenant").distinct()

    def write(self, operations: DataFrame) -> Store:
        """PUT, MSET, DELETE and INCR are rows of the log."""
        return Store(self.log.unionByName(operations), self.zsets, self.bits)

    def clear(self) -> Store:
        return Store(self.log.limit(0), self.zsets, self.bits)

    def state(self) -> DataFrame:
        return kv.fold(self.log)

    def get(self, tenant: str, key: str, as_of_us: int) -> DataFrame:
        # the key's own operations are picked out before the fold
        mine = self.log.where((F.col("tenant") == tenant) & (F.col("key") == key))
        return kv.get(kv.fold(mine), tenant, key, as_of_us)

    def mget(self, keys: DataFrame, as_of_us: int) -> DataFrame:
        return kv.mget(kv.fold(self.log.join(keys, kv.KEY, "left_semi")), keys, as_of_us)

    def changes_since(self, offset_us: int, count: int = 100) -> DataFrame:
        return oplog.read_after(oplog.changes(self.log), offset_us, count)

    def zset(self) -> DataFrame:
        return zset.fold(self.zsets)

    def bitmap(self) -> DataFrame:
        return bitmap.fold(self.bits)
