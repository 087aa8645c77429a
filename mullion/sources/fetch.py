"""Fetching listed files: resumed where they broke off, proved by digest, put in place at once."""

from __future__ import annotations

import hashlib
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes read at a time.
CHUNK = 1 << 20


def _digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(CHUNK):
            h.update(block)
    return h.hexdigest()


def _append(url: str, part: str, timeout: float) -> None:
    """Reads on from where the part ends; a server that can't do so is read from the start."""
    have = os.path.getsize(part) if os.path.exists(part) else 0
    request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
    try:
        answer = urllib.request.urlopen(request, timeout=timeout)
    except urllib.error.HTTPError as e:
        if e.code == 416:
            # Nothing is left to read; the digest decides whether the part is the file.
            return
        raise
    with answer:
        status = getattr(answer, "status", None)
        if have and status is None:
            answer.read(have)
        with open(part, "ab" if have and status in (206, None) else "wb") as out:
            while block := answer.read(CHUNK):
                out.write(block)


def fetch_one(url: str, path: str, sha256: str | None, retries: int = 4, backoff: float = 2.0, timeout: float = 60.0) -> str:
    """kept, fetched, resumed, mismatch or failed.

    A file that is there with the wanted digest (any, if none is wanted) is kept. Another is read into <path>.part, which
    a later try goes on with, proved, and renamed. A part with the wrong digest is removed and read anew.
    """
    if os.path.exists(path) and (sha256 is None or _digest(path) == sha256.lower()):
        return "kept"
    part, outcome = f"{path}.part", "failed"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    resumed = os.path.exists(part)
    for k in range(max(1, retries)):
        if k:
            time.sleep(backoff * 2 ** (k - 1))
        try:
            _append(url, part, timeout)
        except (OSError, ValueError):
            continue
        if sha256 is None or _digest(part) == sha256.lower():
            os.replace(part, path)
            return "resumed" if resumed else "fetched"
        os.remove(part)
        resumed, outcome = False, "mismatch"
    return outcome


def fetch_files(wanted: DataFrame, folder: str, retries: int = 4, backoff: float = 2.0) -> DataFrame:
    """(relpath, outcome) of wanted files (url, relpath, sha256), fetched into a folder that all executors mount.

    Rows are spread over the executors; nothing passes through the driver. A task that is run again keeps what is there.
    Rows without an address or a path, and paths that lead out of the folder, fail. Nothing is fetched before the result
    is read; read it once, or keep it.
    """
    root = os.path.abspath(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for url, rel, sha in b.itertuples(index=False):
                path = os.path.abspath(os.path.join(root, rel)) if rel else ""
                out.append((rel, fetch_one(url, path, sha, retries, backoff) if url and path.startswith(root + os.sep) else "failed"))
            yield pd.DataFrame(out, columns=["relpath", "outcome"])

    return wanted.select("url", "relpath", "sha256").mapInPandas(run, "relpath string, outcome string")
