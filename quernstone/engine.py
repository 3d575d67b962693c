"""One loaded table, answered from a cached snapshot that can be replaced while queries run."""

from __future__ import annotations

import itertools
import threading
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from .config import Settings
from .errors import BoundError, EngineError, ExecutionError, IngestionError, QueryError, RequestError, StorageError
from .operators import aggregate, predicate, zones
from .operators.schema import TableSchema
from .plans import request, response
from .sources import select
from .streaming.counters import Counters


def resident_bytes() -> int:
    """Memory of this process, 0 where /proc doesn't tell."""
    try:
        with open("/proc/self/status") as f:
            return next(int(line.split()[1]) * 1024 for line in f if line.startswith("VmRSS"))
    except (OSError, StopIteration):
        return 0


def check_memory(limit: int) -> None:
    used = resident_bytes()
    if used > limit:
        raise StorageError(f"memory limit exceeded: {used} bytes in use > limit {limit} bytes")


@contextmanager
def _memory_watched(spark: SparkSession, limit: int, interval: float = 0.5):
    """Looks at the memory before a load, all the time that it takes and after it; a load beyond the limit is ended with a StorageError."""
    check_memory(limit)
    tag, over, ended = f"load-{uuid.uuid4().hex}", [], threading.Event()

    def watch():
        while not ended.wait(interval):
            try:
                check_memory(limit)
            except StorageError as e:
                over.append(e)
                spark.interruptTag(tag)
                return

    thread = threading.Thread(target=watch, daemon=True)
    spark.addTag(tag)
    thread.start()
    try:
        yield
    except (PySparkException, Py4JJavaError):
        if over:
            raise over[0] from None
        raise
    finally:
        ended.set()
        thread.join()
        spark.removeTag(tag)
    check_memory(limit)


class Snapshot:
    """A cached table. It is let go when it has been replaced and its last query has ended."""

    def __init__(self, df: DataFrame, settings: Settings):
        self.settings, self.schema = settings, settings.schema
        if settings.partition_column:
            df = zones.ordered(df, settings.schema, settings.partition_column)
        spark = df.sparkSession
        spark.conf.set("spark.sql.inMemoryColumnarStorage.batchSize", str(settings.chunk_size_rows))
        # Spark takes equal plans for equal data: without a mark of its own, a changed file would be answered from the old cache
        self.df = df.where(F.lit(uuid.uuid4().hex).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
        self.users, self.retired, self.lock = 0, False, threading.Lock()
        try:
            with _memory_watched(spark, settings.memory_limit):
                self.rows = self.df.count()
        except Exception:
            self.df.unpersist()
            raise

    @contextmanager
    def used(self):
        with self.lock:
            self.users += 1
        try:
            yield self
        finally:
            with self.lock:
                self.users -= 1
                over = self.retired and not self.users
            if over:
                self.df.unpersist()

    def retire(self) -> None:
        with self.lock:
            self.retired, idle = True, not self.users
        if idle:
            self.df.unpersist()


def ingest(spark: SparkSession, settings: Settings) -> Snapshot:
    """A new snapshot from the source; whatever a cell or file does wrong is an IngestionError."""
    try:
        return Snapshot(select.scan(spark, settings), settings)
    except EngineError:
        raise
    except (PySparkException, Py4JJavaError, OSError) as e:
        raise IngestionError(str(e).split("\n\nJVM stacktrace")[0][:2000]) from None


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings, snapshot: Snapshot | None = None, clock=None):
        self.spark, self.counters = spark, Counters(clock) if clock else Counters()
        self.snapshot, self.swap, self.ids = snapshot or ingest(spark, settings), threading.Lock(), itertools.count(1)

    def replace(self, snapshot: Snapshot) -> None:
        with self.swap:
            old, self.snapshot = self.snapshot, snapshot
        old.retire()

    def query(self, body: dict | bytes | str) -> dict:
        """The answer to a request body. RequestError before a query exists (not counted as one), BoundError and QueryError for a bad one."""
        try:
            query = request.parse(body)
            with self.swap:
                holder = self.snapshot.used()
                snapshot = holder.__enter__()
            try:
                out = self._answer(snapshot, query)
            finally:
                holder.__exit__(None, None, None)
        except RequestError:
            raise
        except Exception:
            self.counters.record(True)
            raise
        self.counters.record(False)
        return out

    def _answer(self, snapshot: Snapshot, query: predicate.Query) -> dict:
        check_memory(snapshot.settings.memory_limit)
        df, schema = predicate.matching(snapshot.df, query, snapshot.schema), snapshot.schema
        self.spark.sparkContext.setJobGroup(f"query-{next(self.ids)}", "filter and summarise")
        try:
            row = aggregate.summary(df, schema).first()
            values = aggregate.values(df, schema).collect() if snapshot.settings.string_value_counts and row["matched_rows"] else []
        except (PySparkException, Py4JJavaError) as e:
            raise ExecutionError(str(e)[:2000]) from None
        return response.shaped(row, values, schema)

    def status(self) -> dict:
        found = self.counters.snapshot()
        return {"uptime_secs": found["uptime_secs"], "rows_loaded": self.snapshot.rows, "queries": found["queries"], "errors": found["errors"]}


def http_status(error: Exception) -> int:
    if isinstance(error, RequestError):
        return error.status
    return 400 if isinstance(error, (BoundError, QueryError)) else 500


__all__ = ["Engine", "Snapshot", "TableSchema", "ingest", "http_status", "check_memory"]
