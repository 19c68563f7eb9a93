"""Delivery of packed bodies to an HTTP event collector."""

from __future__ import annotations

import gzip
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib import error, parse, request

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage
from tidemark.sources.blocks import is_there, make_folder, put_file

# the functions below run on executors, which need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Answers worth another attempt.
RETRY_STATUS = (429, 500, 502, 503, 504)

# (url, compressed body, headers) -> (status, seconds to wait or None)
Transport = Callable[[str, bytes, dict], tuple[int, "float | None"]]


def http_post(url: str, body: bytes, headers: dict) -> tuple[int, float | None]:
    try:
        with request.urlopen(request.Request(url, body, headers), timeout=60) as answer:
            return answer.status, None
    except error.HTTPError as answer:
        wait = answer.headers.get("Retry-After", "")
        return answer.code, float(wait) if wait.replace(".", "", 1).isdigit() else None
    except error.URLError:
        return 0, None


@dataclass(frozen=True)
class Delivered:
    events_sent: int
    requests_sent: int
    bodies_skipped: int = 0


def wait_seconds(attempt: int, asked: float | None) -> float:
    return min(asked, 120.0) if asked is not None else float(min(2**attempt, 60))


def with_batch_ids(bodies: DataFrame) -> DataFrame:
    """``bodies`` with ``batch``: the digest of the body, and which of several equal ones it is.

    The same bodies get the same ids in any run, in whatever order they come.
    """
    digest = F.sha2("body", 256)
    order = Window.partitionBy("_digest").orderBy(F.monotonically_increasing_id())
    known = bodies.withColumn("_digest", digest)
    return known.withColumn("batch", F.format_string("%s-%d", "_digest", F.row_number().over(order))).drop("_digest")


def deliver(
    bodies: DataFrame,
    url: str,
    token: str,
    params: dict[str, str] | None = None,
    max_retries: int = 5,
    parallelism: int | None = None,
    transport: Transport = http_post,
    pause: Callable[[float], None] = time.sleep,
    ledger: str | None = None,
) -> Delivered:
    """POST every body (column ``body``, ``events``), one request each.

    ``parallelism`` is the number of tasks that send; bodies are dealt out to them evenly, and what
    made the bodies keeps its own tasks. Without it order holds within a task. Bodies with ``file`` and
    ``place`` (see :func:`tidemark.operators.collector.pack_by_file`) are sent in order within a file.

    ``ledger`` is a folder that all tasks can open. Every body that was accepted leaves an empty file
    there under its batch id, and a body whose file is there is not sent: neither by a task that runs
    again nor by a later call after a failure. Only a task that is lost between the answer and its file
    sends a body twice; the id goes along as ``X-Request-ID``. Without a ledger a task that runs again sends its
    bodies again. A body that is refused after all attempts fails the task.
    """
    address = url + ("?" + parse.urlencode(params) if params else "")
    headers = {"Authorization": "Splunk " + token, "Content-Encoding": "gzip"}
    spark = bodies.sparkSession
    context = spark.sparkContext
    events, requests, skipped = context.accumulator(0), context.accumulator(0), context.accumulator(0)
    by_file = {"file", "place"} <= set(bodies.columns)
    columns = ["body", "events", *(["file", "place"] if by_file else [])]
    if ledger is not None:
        make_folder(ledger)
        # ids and bodies must be the same when a task runs again
        bodies = cut_lineage(with_batch_ids(bodies.select(*columns)))
        columns.append("batch")

    def send_all(rows) -> None:
        for row in rows:
            known = {} if ledger is None else {"X-Request-ID": row.batch}
            if known and is_there(f"{ledger}/{row.batch}"):
                skipped.add(1)
                continue
            packed, attempt = gzip.compress(row.body.encode()), 0
            while True:
                attempt += 1
                status, asked = transport(address, packed, headers | known)
                requests.add(1)
                if status == 200:
                    events.add(row.events)
                    break
                if attempt > max_retries or (status and status not in RETRY_STATUS):
                    raise OSError(f"collector refused {row.events} events: status {status}")
                pause(wait_seconds(attempt, asked))
            if known:
                put_file(f"{ledger}/{row.batch}")

    tasks = bodies
    if by_file:
        count = parallelism or int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = bodies.repartition(count, "file").sortWithinPartitions("file", "place")
    elif parallelism is not None:
        tasks = bodies.repartition(parallelism)
    tasks.select(*columns).foreachPartition(send_all)
    return Delivered(events.value, requests.value, skipped.value)
