"""Asynchronous facade: calls run on threads, writes one at a time."""

from __future__ import annotations

import asyncio
from typing import Any

from pyspark.sql import SparkSession

from .catalog import _READS, _WRITES, Database, Transaction


class AsyncTransaction:
    """An interactive transaction. It takes the write gate at its first write and holds it until commit or rollback."""

    def __init__(self, db: AsyncDatabase) -> None:
        self._db, self._tx, self._held = db, None, False

    async def _begun(self) -> Transaction:
        if self._tx is None:
            self._tx = await asyncio.to_thread(self._db.sync.begin_acid)
        return self._tx

    def __getattr__(self, name: str) -> Any:
        if name not in _READS | _WRITES:
            raise AttributeError(name)

        async def call(*args: Any, **options: Any) -> Any:
            if name in _WRITES and not self._held:
                await self._db.gate.acquire()
                self._held = True
                if self._tx is not None and self._tx._snapshot.version != await asyncio.to_thread(self._db.sync.store.latest):
                    self._tx = None  # nothing is staged yet: start from what was committed meanwhile
            tx = await self._begun()
            return await asyncio.to_thread(lambda: getattr(tx, name)(*args, **options))

        return call

    def _release(self) -> None:
        if self._held:
            self._held = False
            self._db.gate.release()

    async def commit(self) -> None:
        try:
            if self._tx is not None:
                await asyncio.to_thread(self._tx.commit)
        finally:
            self._release()

    async def rollback(self) -> None:
        if self._tx is not None:
            self._tx.rollback()
        self._release()

    async def __aenter__(self) -> AsyncTransaction:
        return self

    async def __aexit__(self, *_: object) -> None:
        await self.rollback()


class AsyncDatabase:
    def __init__(self, db: Database) -> None:
        self.sync, self.gate = db, asyncio.Lock()

    @classmethod
    async def open(cls, spark: SparkSession, path: str) -> AsyncDatabase:
        return cls(await asyncio.to_thread(Database, spark, path))

    def begin(self) -> AsyncTransaction:
        return AsyncTransaction(self)

    async def transaction(self, work: Any) -> Any:
        """work(tx) is awaited; its operations are committed together, or none on an error."""
        async with self.begin() as tx:
            out = await work(tx)
            await tx.commit()
            return out

    def __getattr__(self, name: str) -> Any:
        if name not in _READS | _WRITES and name not in ("set_acid", "is_acid", "set_durability", "durability", "set_max_row_size", "max_row_size"):
            raise AttributeError(name)

        async def call(*args: Any, **options: Any) -> Any:
            run = lambda: getattr(self.sync, name)(*args, **options)
            if name in _WRITES:
                async with self.gate:
                    return await asyncio.to_thread(run)
            return await asyncio.to_thread(run)

        return call
