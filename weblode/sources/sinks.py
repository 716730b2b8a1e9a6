"""JSON output of documents."""

from __future__ import annotations

import json
import logging
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def default_path(now: datetime | None = None) -> str:
    return f"outputs/documents_{(now or datetime.now()):%Y%m%d_%H%M%S}.json"


def write_json(docs: DataFrame, folder: str) -> None:
    """A line of JSON a document, in as many files as there are partitions."""
    docs.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def save_list(docs: DataFrame, path: str | None = None) -> str | None:
    """One indented JSON list, streamed row by row to the driver; for results meant to be read by people. None if there is no row or the write fails."""
    target = Path(path or default_path())
    try:
        rows = docs.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()
        first = next(rows, None)
        if first is None:
            return None
        target.parent.mkdir(parents=True, exist_ok=True)
        with target.open("w", encoding="utf-8") as f:
            f.write("[\n")
            while first is not None:
                f.write(json.dumps(json.loads(first["j"]), ensure_ascii=False, indent=2))
                first = next(rows, None)
                f.write(",\n" if first is not None else "\n")
            f.write("]\n")
        return str(target)
    except OSError as e:
        log.error("can't write %s: %s", target, e)
        return None
