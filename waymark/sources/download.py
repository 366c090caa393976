"""Fetching source files to a folder, on the driver: a name for each state of a file, never half a file."""

from __future__ import annotations

import ftplib
import os
import re
import tempfile
import urllib.request
from email.utils import parsedate_to_datetime

# Fixed value: a fetched file's name is the time of its last change, a dot, and its own name.
STAMP = r"\d{4}_\d{2}_\d{2}T\d{2}_\d{2}_\d{2}"


def stamped(last_modified: str, base: str) -> str:
    return f"{parsedate_to_datetime(last_modified):%Y_%m_%dT%H_%M_%S}.{base}"


def _target(response, folder: str, base: str) -> str:
    changed = response.headers.get("Last-Modified")
    if changed is None:
        raise ValueError(f"no Last-Modified for {response.url}")
    return os.path.join(folder, stamped(changed, base))


def _publish(folder: str, target: str, fill) -> str:
    fd, temp = tempfile.mkstemp(".tmp", os.path.basename(target), folder)
    try:
        with os.fdopen(fd, "wb") as out:
            fill(out)
        os.replace(temp, target)
    except BaseException:
        os.unlink(temp)
        raise
    return target


def fetch(url: str, folder: str, base: str | None = None, timeout: float = 60) -> str | None:
    """The new file, or None if this state of it is there already."""
    base = base or url.rsplit("/", 1)[-1]
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as head:
        if os.path.exists(_target(head, folder, base)):
            return None
    with urllib.request.urlopen(url, timeout=timeout) as got:
        target = _target(got, folder, base)

        def fill(out) -> None:
            while part := got.read(1 << 20):
                out.write(part)

        return None if os.path.exists(target) else _publish(folder, target, fill)


def fetch_newest_ftp(host: str, directory: str, pattern: str, folder: str, user: str = "", password: str = "", timeout: float = 60) -> str | None:
    """The greatest file name that matches, if it is greater than all that match here."""
    with ftplib.FTP(host, user, password, timeout=timeout) as ftp:
        ftp.cwd(directory)
        top = newest(ftp.nlst(), pattern)
        here = newest(os.listdir(folder), pattern)
        if top is None or (here is not None and top <= here):
            return None
        return _publish(folder, os.path.join(folder, top), lambda out: ftp.retrbinary(f"RETR {top}", out.write))


def newest(names: list[str], pattern: str) -> str | None:
    return max((n for n in names if re.fullmatch(pattern, n)), default=None)


def current_files(folder: str, urls: list[str]) -> dict[str, str]:
    """The newest fetched file of each URL's name: name to path."""
    out = {}
    for base in (u.rsplit("/", 1)[-1] for u in urls):
        found = newest(os.listdir(folder), rf"{STAMP}\.{re.escape(base)}")
        if found:
            out[base] = os.path.join(folder, found)
    return out


def version(folder: str, urls: list[str]) -> str | None:
    """The newest time stamp among the current files."""
    return max((os.path.basename(p).split(".")[0] for p in current_files(folder, urls).values()), default=None)


def drop_old(folder: str, pattern: str, keep: int = 1) -> list[str]:
    """Deletes all but the last matching files by name; returns their names."""
    old = sorted(n for n in os.listdir(folder) if re.fullmatch(pattern, n))[:-keep]
    for n in old:
        os.unlink(os.path.join(folder, n))
    return old
