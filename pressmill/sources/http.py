"""Fetching over HTTP: as a batch source for a few addresses, and as a plan over a table of requests.

``spark.dataSource.register(HttpSource)``, then ``spark.read.format("fetch").option("urls", json_list).load()``: each
address is a partition of its own, unless a delay is asked for. ``fetched`` takes the requests as rows, however many, and
spreads them over tasks by host. Errors are rows, not failures.

With a delay, requests to one host are that far apart at least, and hosts don't wait for each other: a window sum gives
every request the time at which it is due after those before it to its host, and a task, which has all requests of its hosts, sends
whatever is due next. A host that answers 429 or 503 and says Retry-After is left alone for that long and asked again; its other requests
wait with it. Without that header such an answer is an error like any other.
"""

from __future__ import annotations

import heapq
import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What the requests say they are and take.
AGENT = "pressmill/1.0 (feed reader)"
FEED_HEADERS = {"User-Agent": AGENT, "Accept": "application/rss+xml, application/atom+xml, application/xml;q=0.9, */*;q=0.5"}
ARTICLE_HEADERS = {"User-Agent": AGENT, "Accept": "text/html, application/xhtml+xml;q=0.9, */*;q=0.5", "Accept-Language": "en-IN, en;q=0.8"}
RESULT = "url string, content binary, http_status int, fetch_error string, content_type string"
#: Statuses that ask for patience.
BUSY = (429, 503)
#: Requests that a task holds while they wait for their hosts; more of them wait to be read.
HELD = 10_000


@dataclass
class Answer:
    url: str
    content: bytes | None = None
    status: int | None = None
    error: str | None = None
    content_type: str | None = None
    #: What a busy host asks for: seconds, or None where it doesn't say.
    retry_after: float | None = None

    def row(self) -> tuple:
        return self.url, self.content, self.status, self.error, self.content_type


def wait_asked(header: str | None, now: float) -> float | None:
    """Seconds that a Retry-After header asks for, given as such or as a date. now: seconds since 1970."""
    if header is None:
        return None
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - now)
    except (TypeError, ValueError):
        return None


def request(session, url: str, form: dict | None, timeout: float) -> Answer:
    """A GET, or a POST of a form. A status that is no success is an error, and has no content."""
    import requests

    try:
        got = session.get(url, timeout=timeout, allow_redirects=True) if form is None else session.post(url, data=form, timeout=timeout)
    except (requests.RequestException, ValueError) as e:
        return Answer(url, error=str(e))
    said = got.headers.get("Content-Type")
    if not got.ok:
        return Answer(url, None, got.status_code, f"HTTP {got.status_code} for url: {url}", said, wait_asked(got.headers.get("Retry-After"), time.time()))
    return Answer(url, got.content, got.status_code, None, said)


@dataclass(order=True)
class _Waiting:
    at: float
    order: int
    host: str = field(compare=False)
    what: tuple = field(compare=False)
    tries: int = field(compare=False, default=0)


def paced(
    wanted: Iterable[tuple[float, str, tuple]], ask: Callable[[tuple], Answer], delay: float, retries: int, longest_wait: float,
    clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
) -> Iterator[tuple[tuple, Answer]]:
    """Each request with its answer. wanted: seconds after which a request is due (in order), its host, and what ask takes."""
    began, free, waiting, rows, order = clock(), {}, [], iter(wanted), 0
    ahead = next(rows, None)
    while waiting or ahead is not None:
        while ahead is not None and len(waiting) < HELD and (not waiting or began + ahead[0] <= waiting[0].at):
            heapq.heappush(waiting, _Waiting(began + ahead[0], order, ahead[1], ahead[2]))
            ahead, order = next(rows, None), order + 1
        one = heapq.heappop(waiting)
        if free.get(one.host, one.at) > one.at:  # its host was asked later than planned, or wants to be left alone
            one.at = free[one.host]
            heapq.heappush(waiting, one)
            continue
        if (ahead_of_time := one.at - clock()) > 0:
            sleep(ahead_of_time)
        free[one.host] = clock() + delay
        answer = ask(one.what)
        if answer.status in BUSY and one.tries < retries and answer.retry_after is not None and answer.retry_after <= longest_wait:
            one.at = free[one.host] = max(free[one.host], clock() + answer.retry_after)
            one.tries += 1
            heapq.heappush(waiting, one)
        else:
            yield one.what, answer


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])
        self.timeout, self.delay = float(options.get("timeout", 15)), float(options.get("delay", 0))

    def partitions(self) -> list[InputPartition]:
        # A delay between requests is a limit for the whole run, so then one partition fetches all of them in turn.
        return [InputPartition(self.urls)] if self.delay > 0 else [InputPartition([u]) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import requests

        with requests.Session() as session:
            session.headers.update(FEED_HEADERS)
            for url in partition.value:
                if self.delay > 0:
                    time.sleep(self.delay)
                yield request(session, url, None, self.timeout).row()


def with_due(requests_: DataFrame, delay: float) -> DataFrame:
    """requests (url, key, form) with their host and the seconds after which each is due."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    before = Window.partitionBy("host").orderBy("url", "key").rowsBetween(Window.unboundedPreceding, -1)
    return requests_.withColumn("host", host).withColumn("due", F.coalesce(F.sum(F.lit(float(delay))).over(before), F.lit(0.0)))


def fetched(requests_: DataFrame, headers: dict[str, str] = ARTICLE_HEADERS, timeout: float = 20, tasks: int = 32, delay: float = 0, retries: int = 2, longest_wait: float = 60) -> DataFrame:
    """A row of RESULT, with the request's key, for each row of url, key and form (a map for a POST, or null).

    A missing column is null. delay: seconds between the requests to one host; retries: how often a busy host is asked
    again, unless it asks for more than longest_wait seconds.
    """
    types = {"url": "string", "key": "string", "form": "map<string,string>"}
    wanted = requests_.select(*(F.col(c).cast(t) if c in requests_.columns else F.lit(None).cast(t).alias(c) for c, t in types.items())).where("url is not null")
    # Without a delay nothing is due later, and a host's requests may go to all tasks.
    timed = with_due(wanted, delay).repartition(tasks, "host").sortWithinPartitions("due", "host") if delay > 0 else wanted.withColumns({"host": F.lit(""), "due": F.lit(0.0)}).repartition(tasks, "url", "key")
    schema = f"{RESULT}, key string"
    kinds = (pa.string(), pa.binary(), pa.int32(), pa.string(), pa.string(), pa.string())
    names = ["url", "content", "http_status", "fetch_error", "content_type", "key"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for due, host, url, key, form in zip(*(batch.column(c).to_pylist() for c in ("due", "host", *types)), strict=True):
                yield due, host or url, (url, key, None if form is None else dict(form))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import requests

        with requests.Session() as session:
            session.headers.update(headers)
            for (_, key, _), answer in paced(rows(batches), lambda x: request(session, x[0], x[2], timeout), delay, retries, longest_wait):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*answer.row(), key), kinds, strict=True)], names=names)

    return timed.mapInArrow(run, schema)
