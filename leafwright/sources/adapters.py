"""Language-model and tagger calls as joins with recorded responses, or as injected clients.

A recorded table (request_id, response) replays a run exactly; a client is any
callable from a request to a response, tried a few times, whose failures become
error rows and never fail the job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from queue import Empty, Queue
from threading import Thread

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import SPARK


def replay(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """requests with response, status and error from the recorded responses; the last of several counts."""
    last = recorded.groupBy("request_id").agg(F.max_by("response", "recorded_at").alias("response"))
    found = requests.join(last, "request_id", "left")
    missing = F.col("response").isNull()
    return found.withColumn("status", F.when(missing, "error").otherwise("ok")).withColumn("error", F.when(missing, "no_recorded_response"))


def call(requests: DataFrame, make_client: Callable[[], Callable[[str], str]], attempts: int = 3, wait: float = 1.0, timeout: float = 60.0) -> DataFrame:
    """request_id, response, status, error from a client made once for each task: one row for each request, repeated ids among them.

    An attempt that takes longer than ``timeout`` seconds counts as failed; what
    a content filter refuses is not tried again. Rows leave in small groups.
    """

    def answer(client: Callable[[str], str], request: str) -> str:
        """A thread of its own for each attempt: one that hangs holds up no other, and ends with the worker."""
        done: Queue = Queue()

        def work() -> None:
            try:
                done.put((client(request), None))
            except Exception as e:  # noqa: BLE001  any failure of a foreign service is a row
                done.put((None, e))

        Thread(target=work, daemon=True).start()
        response, failure = done.get(timeout=timeout)
        if failure is not None:
            raise failure
        return response

    def ask(client: Callable[[str], str], request: str) -> tuple[str | None, str, str | None]:
        error = None
        for k in range(attempts):
            try:
                return answer(client, request), "ok", None
            except Empty:
                error = f"no answer within {timeout} seconds"
            except Exception as e:  # noqa: BLE001
                error = str(e)
                if "content_filter" in error.lower():
                    break
            if k + 1 < attempts:
                time.sleep(wait * 2**k)
        return None, "error", error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                # The requests of a group go out together.
                with ThreadPoolExecutor(max_workers=8) as group:
                    got = list(group.map(lambda request: ask(client, request), part.column("request").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("request_id"), *(pa.array(c, pa.string()) for c in zip(*got))], names=["request_id", "response", "status", "error"])

    return requests.select(F.col("request_id").cast("string").alias("request_id"), "request").mapInArrow(run, "request_id string, response string, status string, error string")


def parsed_json(df: DataFrame, column: str = "response") -> DataFrame:
    """json, parse_status: fences and a leading "json" stripped, then the text itself, else what stands between the outer braces.

    Status: ok (an object), not_object, error, or empty.
    """
    bare = SPARK.replace(SPARK.replace(f"trim({column})", "^```(json)?", ""), "```$", "")
    bare = f"trim({SPARK.replace(bare, '^(?i)([ \t\n\r]*)json', '')})"
    inner = SPARK.extract(f"coalesce({bare}, '')", r"(?s)(\{.*\})", 1)
    own = df.selectExpr("*", f"coalesce(try_parse_json({bare}), try_parse_json({inner})) AS json")
    is_object = F.expr("startswith(schema_of_variant(json), 'OBJECT')")
    return own.withColumn("parse_status", F.when(F.trim(F.coalesce(column, F.lit(""))) == "", "empty").when(F.col("json").isNull(), "error").when(~is_object, "not_object").otherwise("ok"))
