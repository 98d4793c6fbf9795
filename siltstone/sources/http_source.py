"""A Python data source that reads pages over HTTP: spark.read.format("siltstone_http").option("urls", …).load().

Options: urls, hosts, schemes, prefixes and robots as JSON, kind (page, sitemap or robots), agent, cap, attempts, rps, timeout.
One partition per host, so that the minimum interval between two requests of a host holds whatever the number of executors. Each address is fetched
with bounded retries, redirects are followed hop by hop and each hop is judged again, and a body is read up to a cap.
"""

from __future__ import annotations

import http.client
import json
import time
from collections import defaultdict
from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.functions.http import BASE_BACKOFF, MAX_ATTEMPTS, MAX_BODY, MAX_DELAY, REDIRECTS, RETRYABLE, SECRET_FIELDS

#: Redirects that are followed, by what is read (fixed values).
MAX_HOPS = {"page": 5, "sitemap": 3, "robots": 3}
SCHEMA = "url string, final_url string, http_status int, headers map<string,string>, body binary, attempts int, error_type string"


def exchange(url: str, agent: str, cap: int, timeout: float) -> tuple[int | None, dict[str, str], bytes | None, str | None]:
    """(status, headers without secrets, body, error) of one GET, without following redirects."""
    parts = urlsplit(url)
    kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
    link = kind(parts.hostname or "", parts.port, timeout=timeout)
    try:
        link.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": agent, "Accept": "text/html,application/xhtml+xml"})
        answer = link.getresponse()
        headers = {k.lower(): v for k, v in answer.getheaders() if k.lower() not in SECRET_FIELDS}
        if int(headers.get("content-length") or 0) > cap:
            return answer.status, headers, None, "size_exceeded"
        body = answer.read(cap + 1)
        return (answer.status, headers, None, "size_exceeded") if len(body) > cap else (answer.status, headers, body, None)
    except TimeoutError:
        return None, {}, None, "timeout"
    except (OSError, http.client.HTTPException, ValueError):
        return None, {}, None, "connection_failure"
    finally:
        link.close()


def wait_of(headers: dict[str, str], attempt: int) -> float:
    """Seconds before the next attempt: what the server asks for, else doubling."""
    asked = headers.get("retry-after", "").strip()
    if asked.isdigit():
        return min(float(asked), MAX_DELAY)
    try:
        return min(max(parsedate_to_datetime(asked).timestamp() - time.time(), 0.0), MAX_DELAY)
    except (TypeError, ValueError):
        return min(BASE_BACKOFF * 2 ** (attempt - 1), MAX_DELAY)


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = json.loads(options.get("urls", "[]"))
        self.hosts = set(json.loads(options.get("hosts", "[]")))
        self.schemes = set(json.loads(options.get("schemes", '["https"]')))
        self.prefixes = json.loads(options.get("prefixes", "[]"))
        self.hops = MAX_HOPS[options.get("kind", "page")]
        self.agent, self.cap = options.get("agent", "siltstone"), int(options.get("cap", MAX_BODY))
        self.robots = json.loads(options.get("robots", "{}"))  # host: text of its rules, null where nothing is allowed
        self.attempts, self.rps, self.timeout = int(options.get("attempts", MAX_ATTEMPTS)), float(options.get("rps", 1.0)), float(options.get("timeout", 20.0))
        self.pause = float(options.get("pause_scale", 1.0))

    def partitions(self) -> list[HostPartition]:
        by: dict[str, list[str]] = defaultdict(list)
        for url in self.urls:
            by[(urlsplit(url).hostname or "").lower()].append(url)
        return [HostPartition(sorted(urls)) for _, urls in sorted(by.items())]

    def refused(self, url: str, rules: dict[str, RobotFileParser | None]) -> str | None:
        """Why an address may not be read: its scheme, credentials, host or path, or the host's robots rules."""
        parts = urlsplit(url)
        host, path = (parts.hostname or "").lower(), parts.path or "/"
        if parts.scheme not in self.schemes or "@" in parts.netloc or (self.hosts and host not in self.hosts):
            return "rejected"
        if self.prefixes and not any(path == p or path.startswith(p.rstrip("/") + "/") for p in self.prefixes):
            return "rejected"
        if host in self.robots:
            if host not in rules:
                rules[host] = None if self.robots[host] is None else RobotFileParser()
                if rules[host] is not None:
                    rules[host].parse(self.robots[host].splitlines())
            if rules[host] is None or not rules[host].can_fetch(self.agent, url):
                return "robots_disallowed"
        return None

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        interval = 1.0 / self.rps if self.rps > 0 else 0.0
        last, rules = float("-inf"), {}
        for url in partition.urls:
            at, tries, status, headers, body, error = url, 0, None, {}, None, None
            for hop in range(self.hops + 1):
                error = self.refused(at, rules)
                if error:
                    body = None
                    break
                for attempt in range(1, self.attempts + 1):
                    time.sleep(max(0.0, last + interval - time.monotonic()))
                    last = time.monotonic()
                    status, headers, body, error = exchange(at, self.agent, self.cap, self.timeout)
                    tries += 1
                    if attempt == self.attempts or not (error in ("timeout", "connection_failure") or status in RETRYABLE):
                        break
                    time.sleep(self.pause * wait_of(headers, attempt))
                if status not in REDIRECTS or error:
                    break
                if hop == self.hops:
                    error, body = "too_many_redirects", None
                    break
                at = urljoin(at, headers.get("location", ""))
            yield url, at, status, headers, body, tries, error


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siltstone_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HttpReader:  # noqa: ANN001
        return HttpReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)
