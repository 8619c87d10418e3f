"""S-13, S-25, U-02, U-04, U-07, P-14: where something outside Spark answers for a row.

Parsers of source code or of pages and services that generate text are not part of this library. They enter as a
callable; without one an offline stub gives no rows, never invented ones.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Call = Callable[[dict], list[dict]]


class TransientError(RuntimeError):
    """A failure that may pass; ``wait`` seconds are asked for."""

    def __init__(self, message: str, wait: float = 0.0) -> None:
        super().__init__(message)
        self.wait = wait


def no_service(_: dict) -> list[dict]:
    """The offline stub."""
    return []


def answered(rows: DataFrame, call: Call, schema: str, tasks: int, key: str = "id", retries: int = 4, most_wait: float = 65.0) -> DataFrame:
    """(key, idx, status, error, answer columns): the answers of ``call`` to each row, in ``tasks`` tasks.

    ``call`` gets a row as a dict and gives a list of dicts. A transient failure is repeated; another one, or the last,
    makes a row with status ``failed`` and the reason, so that no row is lost. Calls are keyed by ``key``: a service
    that bills should drop repeats of a key, as a lost task is run again.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    blank = dict.fromkeys(names)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for row in pdf.to_dict("records"):
                for attempt in range(retries + 1):
                    try:
                        found = call(row)
                        out += [{key: row[key], "idx": i, "status": "ok", "error": None, **{n: a.get(n) for n in names}} for i, a in enumerate(found)] or [{key: row[key], "idx": -1, "status": "empty", "error": None, **blank}]
                        break
                    except TransientError as e:
                        if attempt < retries:
                            time.sleep(min(e.wait, most_wait))
                            continue
                        out.append({key: row[key], "idx": -1, "status": "failed", "error": str(e), **blank})
                    except Exception as e:  # noqa: BLE001  the row says what happened
                        out.append({key: row[key], "idx": -1, "status": "failed", "error": f"{type(e).__name__}: {e}", **blank})
                        break
            yield pd.DataFrame(out, columns=[key, "idx", "status", "error", *names]).astype({n: object for n in ("status", "error")})

    kind = rows.schema[key].dataType.simpleString()
    return rows.repartition(tasks, key).mapInPandas(run, f"{key} {kind}, idx int, status string, error string, {schema}")
