"""Messages to a broker with the management interface of AMQP brokers over HTTP: ``spark.dataSource.register(Broker)``, then
``messages.write.format("broker").mode("append")`` or ``writeStream`` with the options address, queue, and vhost, user, password.

Rows have message (text) and may have article_key, which is the message's id. Each task publishes its rows to the default
exchange, persistent, and tells the driver how many went; nothing of the rows passes the driver. Delivery is at least
once: a task that fails is run again and sends its rows again under the same ids, and rows of other tasks aren't repeated. A message
that no queue takes fails its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from .feeds import Settings


@dataclass
class Sent(WriterCommitMessage):
    messages: int


class Connection:
    def __init__(self, options: dict):
        import requests

        if not options.get("address"):
            raise ValueError("The broker's address is not configured.")
        self.base, self.vhost = options["address"].rstrip("/") + "/api", quote(options.get("vhost", "/"), safe="")
        self.timeout, self.session = float(options.get("timeout", 15)), requests.Session()
        if options.get("user"):
            self.session.auth = (options["user"], options.get("password", ""))

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_) -> None:
        self.session.close()

    def _call(self, method: str, path: str, body: dict):
        got = self.session.request(method, self.base + path, json=body, timeout=self.timeout)
        got.raise_for_status()
        return got

    def declare(self, queue: str) -> None:
        """Make a durable queue; again does nothing."""
        self._call("PUT", f"/queues/{self.vhost}/{quote(queue, safe='')}", {"durable": True, "auto_delete": False, "arguments": {}})

    def publish(self, queue: str, message: str, ident: str | None) -> None:
        properties = {"delivery_mode": 2, "content_type": "application/json"} | ({"message_id": ident} if ident is not None else {})
        body = {"properties": properties, "routing_key": queue, "payload": message, "payload_encoding": "string"}
        if not self._call("POST", f"/exchanges/{self.vhost}/amq.default/publish", body).json().get("routed"):
            raise OSError(f"no queue {queue} takes messages")


class Broker(DataSource):
    @classmethod
    def name(cls) -> str:
        return "broker"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("A queue takes more messages, it isn't replaced: use the mode append.")
        return BrokerWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return BrokerStreamWriter(self.options)


class _Publishing:
    """What both writers do in a task."""

    def __init__(self, options: dict):
        self.options = dict(options)
        if not options.get("address") or not options.get("queue"):
            raise ValueError("The broker's address or queue is not configured.")

    def write(self, iterator: Iterator) -> Sent:
        n = 0
        with Connection(self.options) as to:
            for row in iterator:
                if row["message"] is not None:
                    to.publish(self.options["queue"], row["message"], row["article_key"] if "article_key" in row else None)
                    n += 1
        return Sent(n)


class BrokerWriter(_Publishing, DataSourceWriter):
    def commit(self, messages: list[Sent | None]) -> None:
        pass

    def abort(self, messages: list[Sent | None]) -> None:
        pass  # what has been sent stays sent


class BrokerStreamWriter(_Publishing, DataSourceStreamWriter):
    def commit(self, messages: list[Sent | None], batchId: int) -> None:
        pass

    def abort(self, messages: list[Sent | None], batchId: int) -> None:
        pass


@dataclass(frozen=True)
class BrokerSink:
    """A sink of the run, as plans.sinks.QueueSink is: the three queues at a broker. options: vhost, user, password, timeout."""

    spark: SparkSession
    address: str
    settings: Settings = Settings()
    options: tuple[tuple[str, str], ...] = ()
    #: Tasks that publish at the same time, at most.
    tasks: int = 16

    def __post_init__(self) -> None:
        if not self.address:
            raise ValueError("The broker's address is not configured.")

    @property
    def queues(self) -> tuple[str, str, str]:
        return self.settings.article_queue, self.settings.retry_queue, self.settings.dead_letter_queue

    def declare(self) -> None:
        with Connection({"address": self.address, **dict(self.options)}) as to:
            for queue in self.queues:
                to.declare(queue)

    def publish(self, messages: DataFrame, queue: str | None = None) -> None:
        self.spark.dataSource.register(Broker)
        rows = messages.select("article_key", "message").coalesce(self.tasks)
        rows.write.format("broker").mode("append").options(address=self.address, queue=queue or self.queues[0], **dict(self.options)).save()
