"""Paced requests: the order and times of a simulated clock, and a local server's log."""

import random
import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pressmill.plans.run import as_pages
from pressmill.sources import http
from pressmill.sources.http import Answer, paced, wait_asked


class Clock:
    def __init__(self):
        self.now = 100.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        assert seconds > 0
        self.now += seconds


def asked(wanted, answers, delay, retries=2, longest=60.0, takes=0.0):
    """When each request was sent, and the answers in order. answers: (what, try) -> Answer, or a status of 200."""
    clock, log, tries = Clock(), [], defaultdict(int)

    def ask(what):
        tries[what] += 1
        log.append((clock.now - 100, what))
        clock.now += takes
        return answers.get((what, tries[what]), Answer(what, b"x", 200))

    out = list(paced(wanted, ask, delay, retries, longest, clock, clock.sleep))
    return log, [(what, a.status) for what, a in out]


def test_hosts_take_turns():
    wanted = sorted((i * 1.0, host, f"{host}{i}") for host in "abc" for i in range(3))
    log, out = asked(wanted, {}, 1.0)
    assert [t for t, _ in log] == [0, 0, 0, 1, 1, 1, 2, 2, 2] and {x for _, x in log[:3]} == {"a0", "b0", "c0"} and len(out) == 9


def test_a_busy_host_holds_up_nobody_else():
    wanted = sorted((i * 1.0, host, f"{host}{i}") for host in "ab" for i in range(4))
    log, out = asked(wanted, {("a0", 1): Answer("a0", None, 429, "busy", None, 10.0)}, 1.0)
    of_a, of_b = ([(t, x) for t, x in log if x[0] == h] for h in "ab")
    assert of_b == [(0, "b0"), (1, "b1"), (2, "b2"), (3, "b3")] and of_a[0] == (0, "a0")
    assert sorted(x for _, x in of_a[1:]) == ["a0", "a1", "a2", "a3"] and [t for t, _ in of_a[1:]] == [10, 11, 12, 13]
    assert dict(out) == {x: 200 for _, _, x in wanted}


def test_retries_end():
    busy = {("a", i): Answer("a", None, 503, "busy", None, 2.0 * i) for i in range(1, 9)}
    log, out = asked([(0.0, "h", "a")], busy, 0.0, retries=3)
    assert [t for t, _ in log] == [0, 2, 6, 12] and out == [("a", 503)]
    log, out = asked([(0.0, "h", "a")], {("a", 1): Answer("a", None, 503, "busy")}, 0.0)
    assert len(log) == 1 and out == [("a", 503)]  # doesn't say how long
    log, out = asked([(0.0, "h", "a")], {("a", 1): Answer("a", None, 429, "busy", None, 3600.0)}, 0.0)
    assert len(log) == 1 and out == [("a", 429)]  # asks for more than is waited
    log, out = asked([(0.0, "h", "a")], {("a", 1): Answer("a", None, 500, "broken")}, 0.0)
    assert len(log) == 1 and out == [("a", 500)]


@pytest.mark.parametrize("held", [1, 3, 10_000])
def test_gaps_hold_whatever_happens(monkeypatch, held):
    monkeypatch.setattr(http, "HELD", held)
    rng = random.Random(held)
    for _ in range(60):
        hosts, delay = rng.randrange(1, 5), rng.choice([0.0, 0.5, 1.0])
        wanted = sorted((i * delay, f"h{h}", f"h{h}-{i}") for h in range(hosts) for i in range(rng.randrange(0, 8)))
        answers = {(x, 1): Answer(x, None, rng.choice([429, 503]), "busy", None, rng.choice([0.0, 4.0])) for _, _, x in wanted if rng.random() < 0.3}
        log, out = asked(wanted, answers, delay, takes=rng.choice([0.0, 0.2]))
        assert sorted(x for x, _ in out) == sorted(x for _, _, x in wanted) and all(s == 200 for _, s in out)
        last = {}
        for t, x in log:
            host = x.split("-")[0]
            assert host not in last or t - last[host] >= delay - 1e-9
            last[host] = t


def test_waits_that_are_asked_for():
    assert wait_asked("7", 0) == 7 and wait_asked(None, 0) is None and wait_asked("soon", 0) is None and wait_asked("-3", 0) == 0
    assert wait_asked("Thu, 01 Jan 1970 00:01:00 GMT", 20) == 40 and wait_asked("Thu, 01 Jan 1970 00:01:00 GMT", 99) == 0


class Site(BaseHTTPRequestHandler):
    log: list = []
    protocol_version = "HTTP/1.1"

    def log_message(self, *args):
        pass

    def do_GET(self):
        host, first = self.headers["Host"].split(":")[0], not any(p == self.path for _, _, p in self.log)
        self.log.append((host, time.monotonic(), self.path))
        body, status, kind = b"x", 200, "text/html"
        if self.path == "/busy" and first:
            status = 429
        elif self.path == "/cyrillic":
            body, kind = "<p>привет</p>".encode("cp1251"), "text/html; charset=windows-1251"
        elif self.path == "/own":
            body = "<meta charset='iso-8859-1'><p>café</p>".encode("latin-1")
        elif self.path == "/both":
            body, kind = "<meta charset=iso-8859-1><p>café</p>".encode(), 'text/html; charset="UTF-8"'
        elif self.path == "/unknown":
            body, kind = "<p>café</p>".encode(), "text/html; charset=x-nobody"
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        if status == 429:
            self.send_header("Retry-After", "1")
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture
def site():
    Site.log = []
    server = ThreadingHTTPServer(("", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_port
    server.shutdown()


def test_the_servers_log_shows_gaps_and_parallel_hosts(spark, site):
    urls = [f"http://{host}:{site}/{i}" for host in ("127.0.0.1", "localhost", "127.0.0.2") for i in range(5)] + [f"http://127.0.0.1:{site}/busy"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = http.fetched(frame, delay=0.3, tasks=4).collect()
    assert sorted(r["url"] for r in rows) == sorted(urls) and all(r["http_status"] == 200 for r in rows)
    times = defaultdict(list)
    for host, t, path in Site.log:
        times[host].append(t)
    assert {h: len(x) for h, x in times.items()} == {"127.0.0.1": 7, "localhost": 5, "127.0.0.2": 5}
    assert all(b - a >= 0.29 for x in times.values() for a, b in zip(sorted(x), sorted(x)[1:], strict=False))
    busy = [t for _, t, path in Site.log if path == "/busy"]
    assert busy[1] - busy[0] >= 0.99
    # Hosts don't wait for each other: all began before any ended.
    assert max(min(x) for x in times.values()) < min(max(x) for x in times.values())


def test_due_times_are_window_sums(spark):
    rows = [(f"http://{h}/{i}", None, None) for h in ("A.example", "a.example", "u:p@b.example:80") for i in range(3)] + [("no address", None, None)]
    timed = http.with_due(spark.createDataFrame(rows, "url string, key string, form map<string,string>"), 0.5)
    got = {r["host"]: sorted(r["dues"]) for r in timed.groupBy("host").agg(F.collect_list("due").alias("dues")).collect()}
    assert got == {"a.example": [0, 0.5, 1, 1.5, 2, 2.5], "b.example:80": [0, 0.5, 1], "": [0]}


def test_pages_are_read_in_the_encoding_that_the_answer_names(spark, site):
    paths = ("cyrillic", "own", "both", "unknown")
    got = as_pages(http.fetched(spark.createDataFrame([(f"http://127.0.0.1:{site}/{p}",) for p in paths], "url string"))).collect()
    html = {r["url"].rsplit("/", 1)[1]: r["html"] for r in got}
    assert "привет" in html["cyrillic"] and all("café" in html[p] for p in ("own", "both", "unknown"))
