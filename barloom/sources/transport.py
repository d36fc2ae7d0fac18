"""Reading from a remote archive or service through an injected transport: retries, listings, verified downloads.

Nothing here opens a connection. ``fetch`` is a callable the caller supplies, so the same code reads a mirror on disk, as in
tests, or a client of the caller's. It runs on the driver, or in a task of its own per prefix.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path

Fetch = Callable[[str], bytes]


class Failed(Exception):
    """A response that is none: its HTTP-like status and what it says about waiting."""

    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(status)
        self.status, self.retry_after = status, retry_after


def retrying(fetch: Callable, attempts: int = 4, first: float = 1.0, most: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``fetch`` called again while it fails with OSError or a passing status (418, 429, 5xx), after waits that double up to
    ``most`` seconds or that the failure names. The last failure is raised; other statuses at once."""

    def run(*args, **kw):
        for k in range(attempts):
            try:
                return fetch(*args, **kw)
            except (OSError, Failed) as e:
                status = getattr(e, "status", None)
                if k == attempts - 1 or (status is not None and status not in (418, 429) and status < 500):
                    raise
                wait = getattr(e, "retry_after", None)
                sleep(min(most, first * 2**k) if wait is None else wait)

    return run


def get_json(send: Callable[[str, Mapping], bytes], path: str, params: Mapping | None = None, key: str | None = None, key_header: str = "X-API-KEY") -> object:
    """The JSON of a read-only request; ``key`` goes into a header. Wrap ``send`` in retrying()."""
    query = "&".join(f"{k}={v}" for k, v in sorted((params or {}).items()))
    return json.loads(send(f"{path}?{query}" if query else path, {key_header: key} if key else {}))


@dataclass(frozen=True)
class Listed:
    """An object of a listing."""

    key: str
    size: int
    etag: str = ""
    modified: str = ""


@dataclass
class Page:
    """One page of a listing: objects, common prefixes, and the token of the next page."""

    objects: list[Listed] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    token: str | None = None


def parse_page(xml: bytes) -> Page:
    """A page of a bucket listing (version 2). A truncated one without a token is an error."""
    root = ET.fromstring(xml)
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    page, truncated = Page(), False
    for e in root:
        parts = {name(c): (c.text or "") for c in e}
        if name(e) == "Contents":
            page.objects.append(Listed(parts["Key"], int(parts.get("Size") or 0), parts.get("ETag", "").strip('"'), parts.get("LastModified", "")))
        elif name(e) == "CommonPrefixes":
            page.prefixes.append(parts["Prefix"])
        elif name(e) == "NextContinuationToken":
            page.token = e.text
        elif name(e) == "IsTruncated":
            truncated = (e.text or "").lower() == "true"
    if truncated and not page.token:
        raise ValueError("a truncated listing without a token")
    return page if truncated else Page(page.objects, page.prefixes)


def _pages(fetch_page: Callable[[str, str | None], bytes], prefix: str) -> Iterator[Page]:
    token, seen = None, set()
    while True:
        page = parse_page(fetch_page(prefix, token))
        yield page
        if page.token is None:
            return
        if page.token in seen:
            raise ValueError("a listing repeats its token")
        seen.add(page.token)
        token = page.token


def list_objects(fetch_page: Callable[[str, str | None], bytes], prefix: str) -> list[Listed]:
    """All objects under a prefix, sorted by key; one listed twice with different contents is an error."""
    found: dict[str, Listed] = {}
    for page in _pages(fetch_page, prefix):
        for o in page.objects:
            if found.setdefault(o.key, o) != o:
                raise ValueError(f"{o.key} is listed with different contents")
    return [found[k] for k in sorted(found)]


def list_prefixes(fetch_page: Callable[[str, str | None], bytes], prefix: str) -> list[str]:
    return sorted({p for page in _pages(fetch_page, prefix) for p in page.prefixes})


def download(fetch: Fetch, url: str, target: str) -> dict:
    """An archive and its published SHA-256 (``url``.CHECKSUM) to a file that is never changed, and a manifest beside it,
    written once. A payload that differs from its checksum, or from the file that is there, is an error."""
    payload = fetch(url)
    want, have = fetch(f"{url}.CHECKSUM").decode().split()[0].lower(), hashlib.sha256(payload).hexdigest()
    if want != have:
        raise ValueError(f"checksum of {url}: published {want}, computed {have}")
    path = Path(target)
    if path.exists():
        if path.read_bytes() != payload:
            raise ValueError(f"{target} holds another archive")
    else:
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f"{path.name}.{os.getpid()}.part")
        part.write_bytes(payload)
        os.replace(part, path)
    record = {"url": url, "sha256": have, "bytes": len(payload), "path": str(path)}
    manifest = path.with_name(path.name + ".manifest.json")
    if not manifest.exists():
        manifest.write_text(json.dumps(record, sort_keys=True) + "\n")
    return record
