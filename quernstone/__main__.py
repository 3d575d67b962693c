"""python -m quernstone --config FILE: load the table, then serve it until SIGINT or SIGTERM."""

from __future__ import annotations

import argparse
import json
import logging
import os
import signal
import sys
import threading

from pyspark import SparkConf
from pyspark.sql import SparkSession

from . import config, http
from .engine import Engine
from .errors import EngineError
from .streaming.reload import Loader, Watcher, first


class _Json(logging.Formatter):
    def format(self, record):
        return json.dumps({"level": record.levelname, "target": record.name, "message": record.getMessage()})


def logs() -> None:
    """Level and format come from LOG_LEVEL and LOG_FORMAT=json."""
    handler = logging.StreamHandler()
    if os.environ.get("LOG_FORMAT") == "json":
        handler.setFormatter(_Json())
    logging.basicConfig(level=os.environ.get("LOG_LEVEL", "INFO").upper(), handlers=[handler])


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("quernstone")
    parser.add_argument("--config", required=True)
    path = parser.parse_args(args).config
    logs()
    try:
        settings = config.load(path)
        builder = SparkSession.builder.appName("quernstone").config("spark.scheduler.mode", "FAIR").config("spark.sql.session.timeZone", "UTC")
        if not SparkConf().contains("spark.master"):  # on one machine the threads are its cores; a cluster has its own
            builder = builder.master(f"local[{settings.worker_threads}]")
        spark = builder.getOrCreate()
        loader = Loader(spark, settings)
        engine = Engine(spark, settings, first(loader))
        watcher = Watcher(engine, loader, path)
        server = http.serve(engine, settings.bind)
    except (EngineError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: threading.Thread(target=server.shutdown, daemon=True).start())
    watcher.start()
    server.serve_forever()
    watcher.stop()
    server.server_close()
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
