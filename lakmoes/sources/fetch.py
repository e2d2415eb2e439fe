"""Fetching politely: when to try again, how fast to ask a host, and when a download is too large.

The functions take the opener as an argument, so that nothing here needs a network to be tested.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakmoes.operators.crawl import host

# States of a server that pass, and the seconds to wait before each further try.
PASSING = (429, 500, 502, 503, 504)
WAITS = (5, 15, 45, 120)
BUSY_WAITS = (300, 600, 900, 900)
LONGEST_WAIT = 900


class TooLarge(Exception):
    """The content is above the cap; trying again won't help."""


class GivenUp(Exception):
    """A state that doesn't pass, or one that lasted through all tries."""


def server_wait(header: str | None) -> int | None:
    """The seconds a server asks for, up to the longest wait; only plain numbers count."""
    h = (header or "").strip()
    return min(int(h), LONGEST_WAIT) if h.isdigit() else None


def wait_before(attempt: int, status: int | None, header: str | None = None) -> int:
    """Seconds before try number attempt + 1, counted from 0: the schedule's, or more if the server asks for more."""
    schedule = BUSY_WAITS if status == 429 else WAITS
    planned = schedule[min(attempt, len(schedule) - 1)]
    return max(server_wait(header) or 0, planned)


@dataclass
class Response:
    status: int
    headers: dict[str, str]
    body: Iterable[bytes]


@dataclass
class Throttle:
    """At least `spacing` seconds between two requests to one host."""

    spacing: float = 1.0
    now: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: dict[str, float] = field(default_factory=dict)

    def wait(self, host: str) -> None:
        left = self.spacing - (self.now() - self.last.get(host, -1e9))
        if left > 0:
            self.sleep(left)
        self.last[host] = self.now()


def http(options: dict[str, str]) -> Callable[..., Response]:
    """An opener over HTTP, for the options delay_seconds and timeout: spaced by host and tried again by the schedule. Redirects and states are urllib's."""
    from urllib.error import HTTPError
    from urllib.parse import urlsplit
    from urllib.request import Request, urlopen

    throttle, timeout = Throttle(float(options.get("delay_seconds", 1.0))), float(options.get("timeout", 30))

    def open_(url: str, data: str | None = None) -> Response:
        for attempt in range(5):
            throttle.wait(urlsplit(url).hostname or "")
            try:
                r = urlopen(Request(url, data.encode() if data is not None else None, {"Content-Type": "application/json"} if data is not None else {}), timeout=timeout)
                return Response(r.status, dict(r.headers), iter(lambda: r.read(1 << 16), b""))
            except HTTPError as e:
                if e.code not in PASSING or attempt == 4:
                    return Response(e.code, dict(e.headers), [])
                time.sleep(wait_before(attempt, e.code, e.headers.get("Retry-After")))
        raise GivenUp(url)

    return open_


def landed_name(url: str, data: str | None = None) -> str:
    """The name under which the answer to a request stands in a folder of landed answers."""
    return hashlib.sha256(f"{url}\n{data or ''}".encode()).hexdigest()


def landed(options: dict[str, str]) -> Callable[..., Response]:
    """An opener over landed answers: files in the option `folder`, named by `landed_name`; 404 for a request whose answer has not landed."""
    folder = options["folder"]

    def open_(url: str, data: str | None = None) -> Response:
        path = os.path.join(folder, landed_name(url, data))
        if not os.path.exists(path):
            return Response(404, {}, [])
        with open(path, "rb") as f:
            return Response(200, {}, [f.read()])

    return open_


def given(options: dict[str, str]) -> Callable[..., Response]:
    """An opener over the answers in the option `answers`, a JSON object by `landed_name`; 404 for other requests."""
    answers = json.loads(options["answers"])

    def open_(url: str, data: str | None = None) -> Response:
        text = answers.get(landed_name(url, data))
        return Response(404, {}, []) if text is None else Response(200, {}, [text.encode()])

    return open_


def asked(opener: Callable[..., Response], url: str, max_mb: int = 60, retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> Iterable[bytes]:
    """The blocks of a download, tried again by the schedule. The cap holds for the announced and for the counted size."""
    cap = max_mb * 1024 * 1024
    for attempt in range(retries + 1):
        r = opener(url)
        if r.status in PASSING and attempt < retries:
            sleep(wait_before(attempt, r.status, r.headers.get("Retry-After")))
            continue
        if r.status != 200:
            raise GivenUp(f"HTTP {r.status}")
        size, n = r.headers.get("Content-Length", ""), 0
        if size.isdigit() and int(size) > cap:
            raise TooLarge(url)
        for block in r.body:
            n += len(block)
            if n > cap:
                raise TooLarge(url)
            yield block
        return
    raise GivenUp("no try left")


def extension(url: str) -> str:
    """The extension of the path of an address in lower case, without the dot; bin if it has none."""
    return os.path.splitext(url.split("?")[0].split("#")[0])[1].lower().lstrip(".") or "bin"


def download(opener: Callable[..., Response], url: str, folder: str, max_mb: int = 60, retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str, int]:
    """(sha256, path, bytes) of a download, named by its content. A part file never gets the final name."""
    digest, n, part = hashlib.sha256(), 0, os.path.join(folder, f".part-{os.getpid()}-{hashlib.sha1(url.encode()).hexdigest()}")
    try:
        with open(part, "wb") as f:
            for block in asked(opener, url, max_mb, retries, sleep):
                n += len(block)
                digest.update(block)
                f.write(block)
        path = os.path.join(folder, f"{digest.hexdigest()}.{extension(url)}")
        os.replace(part, path)
        return digest.hexdigest(), path, n
    finally:
        if os.path.exists(part):
            os.remove(part)


def _contents(options: dict[str, str], max_mb: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, name = options["opener"].partition(":")
        opener = getattr(import_module(module), name)(options)
        for batch in batches:
            for url in batch.column("url").to_pylist():
                content, why = None, None
                try:
                    content = b"".join(asked(opener, url, max_mb))
                except Exception as e:  # one address never stops the others
                    why = f"{type(e).__name__}: {e}"[:200]
                sha = hashlib.sha256(content).hexdigest() if content is not None else None
                row = (url, extension(url), sha, content, why)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()))], names=["url", "ext", "sha256", "content", "fout"])

    return run


def contents(addresses: DataFrame, options: dict[str, str], max_mb: int = 60) -> DataFrame:
    """(url, ext, sha256, content, fout) of addresses (url), by the opener that options name ("module:factory"). All addresses of a host fall to one task, which keeps the pace for it."""
    by_host = addresses.where(F.col("url").isNotNull()).repartition(host(F.col("url")))
    return by_host.select("url").mapInArrow(_contents(options, max_mb), "url string, ext string, sha256 string, content binary, fout string")
