"""Landing of the gazette as a Spark data source: a partition for each day of a range.

    spark.dataSource.register(GazetteLanding)
    spark.read.format("gazette_landing").option("root", shared).option("index", "https://host/{day}").option("start", "2024-01-01").option("end", "2024-01-31").load()

A task asks for the index of its day, then for the documents that it lists, and keeps
every valid payload in a store that all tasks share: payloads under their digest, so that
a task that runs twice or a document that is served twice is one file, and a small note
for each address that says which digest it had and how to ask whether it changed.  What
fails is a row with its reason; nothing is kept of it, and the next run asks again.
"""

from __future__ import annotations

import datetime
import email.utils
import hashlib
import http.client
import json
import ssl
import time
import urllib.error
import urllib.request
import uuid
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "day date, doc_id string, section string, province string, url string, status string, from_store boolean, "
    "attempts int, waited double, n_bytes long, digest string, error string, content binary"
)
#: Answers that asking again may better.
PASSING = (429, 500, 502, 503, 504)


class Refused(Exception):
    """An address that can't be had; ``final`` if asking again can't help, ``absent`` if there is nothing there."""

    def __init__(self, why: str, final: bool = True, absent: bool = False, wait: float | None = None):
        super().__init__(why)
        self.final, self.absent, self.wait = final, absent, wait


class Rules(NamedTuple):
    """How to ask: tries at an address, seconds before the second try (each further one twice
    that, up to ``most``), longest wait that a server may ask for, seconds between requests
    of a task, and of a request."""

    tries: int = 5
    first: float = 2.0
    most: float = 60.0
    longest: float = 300.0
    pause: float = 1.0
    timeout: float = 30.0
    agent: str = "gazette-landing"

    def delay(self, failed: int) -> float:
        return min(self.most, self.first * 2 ** (failed - 1))


def asked_wait(value: str | None, now: datetime.datetime | None = None) -> float | None:
    """Seconds of a Retry-After field, which may be a number or a date; None if it is neither."""
    text = (value or "").strip()
    if text.isdecimal():
        return float(text)
    try:
        when = email.utils.parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None
    when = when if when.tzinfo else when.replace(tzinfo=datetime.timezone.utc)
    return max(0.0, (when - (now or datetime.datetime.now(datetime.timezone.utc))).total_seconds())


class Store:
    """Payloads by digest and notes by address below ``root``, which may be any address that
    pyarrow's file systems know.  A payload is checked against its digest when it is read."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)

    def _read(self, path: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{path}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def _write(self, path: str, data: bytes) -> None:
        """All of it or nothing: written aside and then moved."""
        folder, aside = f"{self.root}/{path}".rsplit("/", 1)[0], f"{self.root}/{path}.{uuid.uuid4().hex}"
        self.fs.create_dir(folder, recursive=True)
        with self.fs.open_output_stream(aside) as f:
            f.write(data)
        self.fs.move(aside, f"{self.root}/{path}")

    @staticmethod
    def _note(url: str) -> str:
        key = hashlib.sha256(url.encode()).hexdigest()
        return f"notes/{key[:2]}/{key}.json"

    @staticmethod
    def _payload(digest: str) -> str:
        return f"payloads/{digest[:2]}/{digest}"

    def note(self, url: str) -> dict | None:
        raw = self._read(self._note(url))
        try:
            note = json.loads(raw) if raw else None
        except ValueError:
            return None
        return note if isinstance(note, dict) and note.get("url") == url else None

    def get(self, url: str) -> tuple[dict, bytes] | None:
        """The note and payload of an address; None if there is none or it is damaged."""
        note = self.note(url)
        data = self._read(self._payload(note["digest"])) if note else None
        if data is None or hashlib.sha256(data).hexdigest() != note["digest"]:
            return None
        return note, data

    def put(self, url: str, data: bytes, tag: str | None = None, modified: str | None = None) -> dict:
        note = {"url": url, "digest": hashlib.sha256(data).hexdigest(), "n_bytes": len(data), "tag": tag, "modified": modified}
        self._write(self._payload(note["digest"]), data)
        self._write(self._note(url), json.dumps(note).encode())
        return note


def well_formed(data: bytes) -> None:
    """Raises ValueError unless the payload is an XML document."""
    try:
        ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise ValueError(f"not well formed: {e}") from e


class Landing:
    """One task's way to addresses: store, network, waits."""

    def __init__(self, store: Store, rules: Rules, offline: bool = False, revalidate: bool = False, sleep: Callable[[float], None] = time.sleep):
        self.store, self.rules, self.offline, self.revalidate, self.sleep = store, rules, offline, revalidate, sleep
        self.asked_at: float | None = None
        self.attempts, self.waited = 0, 0.0

    def _wait(self, seconds: float) -> None:
        if seconds > 0:
            self.waited += seconds
            self.sleep(seconds)

    def _once(self, url: str, note: dict | None) -> tuple[bytes | None, dict]:
        """One request: payload (None if it hasn't changed) and header fields."""
        headers = {"User-Agent": self.rules.agent}
        if note and note.get("tag"):
            headers["If-None-Match"] = note["tag"]
        if note and note.get("modified"):
            headers["If-Modified-Since"] = note["modified"]
        if self.asked_at is not None:
            self._wait(self.rules.pause - (time.monotonic() - self.asked_at))
        self.asked_at, self.attempts = time.monotonic(), self.attempts + 1
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=self.rules.timeout) as answer:
                return answer.read(), {k.lower(): v for k, v in answer.headers.items()}
        except urllib.error.HTTPError as e:
            if e.code == 304 and note:
                return None, {}
            raise Refused(f"status {e.code}", final=e.code not in PASSING, absent=e.code == 404, wait=asked_wait(e.headers.get("Retry-After"))) from e
        except (http.client.HTTPException, OSError) as e:
            cause = getattr(e, "reason", e)
            raise Refused(f"{type(cause).__name__}: {cause}", final=isinstance(cause, ssl.SSLCertVerificationError)) from e

    def fetch(self, url: str, check: Callable[[bytes], object]) -> tuple[bytes, dict, bool]:
        """Payload, note and whether it is that of the store.  ``check`` raises ValueError for
        a payload that isn't what was asked for; it is asked for again and never kept."""
        self.attempts, self.waited = 0, 0.0
        held = self.store.get(url)
        if held and (self.offline or not self.revalidate):
            return held[1], held[0], True
        if self.offline:
            raise Refused("not in the store")
        failed = 0
        while True:
            try:
                data, fields = self._once(url, held[0] if held else None)
                if data is None:
                    return held[1], held[0], True
                check(data)
                return data, self.store.put(url, data, fields.get("etag"), fields.get("last-modified")), False
            except ValueError as e:
                refused = Refused(f"refused: {e}", final=False)
            except Refused as e:
                refused = e
            failed += 1
            wait = max(self.rules.delay(failed), refused.wait or 0.0)
            if refused.final or failed >= self.rules.tries or (refused.wait or 0.0) > self.rules.longest:
                raise refused
            self._wait(wait)


def _many(value: object) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def listed(data: bytes, sections: tuple[str, ...]) -> list[dict]:
    """doc_id, section, province and url of the documents of an index; ValueError if it is none."""
    try:
        papers = _many(json.loads(data)["data"]["sumario"]["diario"])
        out = [
            {"doc_id": item["identificador"], "section": section["codigo"], "province": " ".join(item.get("titulo", "").split()), "url": item["url_xml"]}
            for paper in papers for section in _many(paper.get("seccion")) if section.get("codigo") in sections for item in _many(section.get("item"))
        ]
    except (KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"not an index: {type(e).__name__} {e}") from e
    return [x for x in out if not x["province"].upper().startswith(("INDICE", "ÍNDICE"))]


class Day(InputPartition):
    def __init__(self, day: datetime.date):
        super().__init__(day.isoformat())


class DayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}
        missing = {"root", "index", "start", "end"} - get.keys()
        if missing:
            raise ValueError(f"options missing: {', '.join(sorted(missing))}")
        flag = lambda name: get.get(name, "false").lower() == "true"
        self.root, self.index = get["root"], get["index"]
        self.start, self.end = (datetime.date.fromisoformat(get[k]) for k in ("start", "end"))
        self.offline, self.revalidate, self.with_content = flag("offline"), flag("revalidate"), flag("content")
        self.sections = tuple(get.get("sections", "A,B").split(","))
        self.rules = Rules(**{k: type(v)(get[k]) for k, v in Rules()._asdict().items() if k in get})

    def partitions(self) -> list[InputPartition]:
        return [Day(self.start + datetime.timedelta(days=i)) for i in range((self.end - self.start).days + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        day = datetime.date.fromisoformat(partition.value)
        way = Landing(Store(self.root), self.rules, self.offline, self.revalidate)

        def row(status: str, doc: dict | None = None, url: str | None = None, from_store: bool = False, note: dict | None = None, error: str | None = None, content: bytes | None = None) -> tuple:
            doc = doc or {}
            return (
                day, doc.get("doc_id"), doc.get("section"), doc.get("province"), url or doc.get("url"), status, from_store,
                way.attempts, way.waited, note and note["n_bytes"], note and note["digest"], error, content if self.with_content else None,
            )

        url = self.index.replace("{day}", day.strftime("%Y%m%d"))
        try:
            documents = listed(way.fetch(url, lambda data: listed(data, self.sections))[0], self.sections)
        except Refused as e:
            status = "not_cached" if self.offline else "no_gazette" if e.absent else "failed"
            yield row(status, url=url, error=f"index: {e}" if status == "failed" else None)
            return
        if not documents:
            yield row("no_gazette", url=url)
        for doc in documents:
            try:
                data, note, from_store = way.fetch(doc["url"], well_formed)
                yield row("published", doc, from_store=from_store, note=note, content=data)
            except Refused as e:
                status = "not_cached" if self.offline else "failed"
                yield row(status, doc, error=f"{doc['doc_id']}: {e}" if status == "failed" else None)


class GazetteLanding(DataSource):
    """Options: root, index (an address with {day}), start, end; offline (the store alone),
    revalidate (ask whether kept payloads changed), content (payloads in the rows),
    sections, and the fields of ``Rules``."""

    @classmethod
    def name(cls) -> str:
        return "gazette_landing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return DayReader(dict(self.options))


def land(spark: SparkSession, root: str, index: str, start: str, end: str, **options: object) -> DataFrame:
    """The rows of a run over a range.  Each action on it is a run of its own, which finds in
    the store what the one before has landed; write it or checkpoint it to keep its report."""
    spark.dataSource.register(GazetteLanding)
    reader = spark.read.format("gazette_landing").options(root=root, index=index, start=start, end=end)
    return reader.options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load()
