"""Stores of reading positions, for exchange with other tools; Spark's own checkpoints drive the streams."""

from __future__ import annotations

import os
import tempfile
from typing import Protocol


class OffsetStore(Protocol):
    def load(self) -> str | None: ...

    def save(self, offset: str) -> None: ...


class MemoryOffsetStore:
    def __init__(self):
        self._offset: str | None = None

    def load(self) -> str | None:
        return self._offset

    def save(self, offset: str) -> None:
        self._offset = offset


class SharedOffsetStore:
    """Numbered small files in a folder that the cluster shares; the newest is the offset. Of two writers at once one fails."""

    def __init__(self, spark, path: str):
        from tidemark.store import Store, Versions

        self._versions = Versions(Store(spark, path), "offsets")

    def load(self) -> str | None:
        newest = self._versions.newest()
        return newest["offset"] if newest else None

    def save(self, offset: str) -> None:
        newest = self._versions.newest()
        number = newest["number"] + 1 if newest else 1
        self._versions.commit(number, {"number": number, "offset": offset})


class FileOffsetStore:
    """One small file on the driver's disk; it is replaced whole, so a reader sees the old or the new offset."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> str | None:
        try:
            with open(self.path, encoding="utf-8") as f:
                return f.read().strip() or None
        except FileNotFoundError:
            return None

    def save(self, offset: str) -> None:
        folder = os.path.dirname(os.path.abspath(self.path))
        os.makedirs(folder, exist_ok=True)
        handle, part = tempfile.mkstemp(dir=folder)
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(offset)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, self.path)
