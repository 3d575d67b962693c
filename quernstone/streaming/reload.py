"""Hot reload: a changed source or configuration becomes a new snapshot; a failure leaves the old one in place."""

from __future__ import annotations

import logging
import os
import threading

from .. import config
from ..engine import Engine, Snapshot, ingest
from ..errors import EngineError, FileError

log = logging.getLogger(__name__)


def modified(path: str) -> int:
    try:
        return os.stat(path).st_mtime_ns
    except OSError as e:
        raise FileError(f"{path}: {e}") from None


class Loader:
    """Loads a source again when its time of change differs from that of the last load."""

    def __init__(self, spark, settings: config.Settings):
        self.spark, self.settings, self.loaded = spark, settings, None

    def reload(self) -> Snapshot | None:
        """None if nothing has changed, or if the file changed while it was read: the next round tries again."""
        before = modified(self.settings.source.path)
        if before == self.loaded:
            return None
        snapshot = ingest(self.spark, self.settings)
        if modified(self.settings.source.path) != before:
            snapshot.retire()
            log.warning("source changed while it was read")
            return None
        self.loaded = before
        return snapshot


def first(loader: Loader) -> Snapshot:
    """The first load must give data; a table without rows is data."""
    snapshot = loader.reload()
    if snapshot is None:
        raise FileError("the source changed during the first load")
    return snapshot


class Watcher:
    """Looks at configuration and source once an interval, which is fixed at the start."""

    def __init__(self, engine: Engine, loader: Loader, config_path: str | None = None):
        self.engine, self.loader, self.config_path = engine, loader, config_path
        self.config_time = modified(config_path) if config_path else None
        self.interval, self.stopped = loader.settings.reload_interval_mins * 60, threading.Event()

    def tick(self) -> bool:
        """One look; whether a new snapshot is in place."""
        try:
            if self.config_path and (now := modified(self.config_path)) != self.config_time:
                loader = Loader(self.engine.spark, config.load(self.config_path))
                snapshot = loader.reload()
                if snapshot is None:
                    return False
                self.loader, self.config_time = loader, now
            else:
                snapshot = self.loader.reload()
                if snapshot is None:
                    return False
        except EngineError as e:
            log.error("reload failed, old data stay: %s", e)
            return False
        self.engine.replace(snapshot)
        return True

    def run(self) -> None:
        while self.interval and not self.stopped.wait(self.interval):
            self.tick()

    def start(self) -> threading.Thread:
        thread = threading.Thread(target=self.run, daemon=True)
        thread.start()
        return thread

    def stop(self) -> None:
        self.stopped.set()
