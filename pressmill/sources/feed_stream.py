"""Feeds as a stream: ``spark.dataSource.register(FeedStream)``, then ``spark.readStream.format("feeds")`` with the option
urls, a JSON list.

An offset holds what every feed's answer says of its version (ETag and Last-Modified), so a micro-batch fetches the feeds whose version
has changed since the last one, and a restart from a checkpoint fetches nothing twice. Versions are asked for on the driver,
by HEAD or, where a host doesn't answer that, by a GET whose body isn't read; bodies are fetched by tasks, one for each host,
with the option delay between requests to it.

- A feed without either header is fetched in every micro-batch.
- A feed that doesn't answer when its version is asked for keeps the version that was last known. This is known from the
  micro-batches of the running query: one that is silent at the first poll after a restart is fetched again when it answers.
- A feed that is gone (a status from 400 to 499) by the time that its task asks for it gives a row without content. Any other
  failure fails the task, which Spark runs again: the offset has promised this version, and it must not be passed over.
- If a feed changes between the two requests, the newer content is given, and given again in the next micro-batch.
"""

from __future__ import annotations

import json
import time
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .http import FEED_HEADERS, Answer, paced, request, wait_asked

#: Hosts that the driver asks for versions at the same time.
POLLERS = 16
#: Statuses with which a host says that it doesn't answer HEAD.
NO_HEAD = (400, 403, 404, 405, 501)


def host_of(url: str) -> str:
    return urlsplit(url).netloc.rpartition("@")[2].lower() or url


def version(session, url: str, timeout: float) -> Answer:
    """An answer whose content is the feed's version, as JSON; only its headers are read."""
    import requests

    got = None
    for ask in (session.head, session.get):
        try:
            got = ask(url, timeout=timeout, allow_redirects=True, stream=True)
            got.close()
        except (requests.RequestException, ValueError) as e:
            return Answer(url, error=str(e))
        if got.status_code not in NO_HEAD:
            break
    if not got.ok:
        return Answer(url, None, got.status_code, f"HTTP {got.status_code}", None, wait_asked(got.headers.get("Retry-After"), time.time()))
    said = {k: got.headers[h] for k, h in (("etag", "ETag"), ("modified", "Last-Modified")) if got.headers.get(h)}
    return Answer(url, json.dumps(said or {"seen": str(time.time_ns())}).encode(), got.status_code)


class FeedStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return "url string, content binary, http_status int, fetch_error string, content_type string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStreamReader(self.options)


class FeedStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.urls = sorted(set(json.loads(options["urls"])))
        self.timeout, self.delay = float(options.get("timeout", 15)), float(options.get("delay", 0))
        self.retries, self.longest_wait = int(options.get("retries", 2)), float(options.get("longest_wait", 60))
        self.known: dict[str, dict] = {}

    def _each(self, urls: list[str], ask) -> Iterator[Answer]:
        """The answers of one host."""
        import requests

        with requests.Session() as session:
            session.headers.update(FEED_HEADERS)
            wanted = ((i * self.delay, host_of(u), (u,)) for i, u in enumerate(urls))
            for _, answer in paced(wanted, lambda x: ask(session, x[0]), self.delay, self.retries, self.longest_wait):
                yield answer

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        hosts = by_host(self.urls)
        with ThreadPoolExecutor(POLLERS) as pool:
            polled = pool.map(lambda urls: list(self._each(urls, lambda session, u: version(session, u, self.timeout))), hosts)
            found = {a.url: json.loads(a.content) for answers in polled for a in answers if a.content is not None}
        return dict(sorted((self.known | found).items()))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = self.known | start | end
        return [InputPartition(urls) for urls in by_host([u for u, v in end.items() if start.get(u) != v])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for answer in self._each(partition.value, lambda session, u: request(session, u, None, self.timeout)):
            if answer.content is None and not 400 <= (answer.status or 0) < 500 or answer.status in (408, 429):
                raise OSError(f"{answer.url}: {answer.error}")
            yield answer.row()

    def commit(self, end: dict) -> None:
        self.known = self.known | end


def by_host(urls: list[str]) -> list[list[str]]:
    hosts = defaultdict(list)
    for u in sorted(urls):
        hosts[host_of(u)].append(u)
    return list(hosts.values())
