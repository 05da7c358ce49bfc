"""Archives from the network into a folder, kept there; what is already there is not fetched again."""

from __future__ import annotations

import io
import time
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path


#: What fetches an address within some seconds; tests and other networks bring their own.
Get = Callable[[str, float], bytes]


def get(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept-Encoding": "identity"}), timeout=timeout) as r:
        return r.read()


def download(url: str, attempts: int = 3, timeout: float = 120, get: Get | None = None) -> bytes:
    """The bytes at an address, tried several times."""
    for n in range(attempts):
        try:
            return (get or globals()["get"])(url, timeout)
        except OSError as e:
            last = e
            time.sleep(min(2**n, 60) if get is None else 0)
    raise RuntimeError(f"{url} could not be fetched in {attempts} attempts") from last


def archive(url: str, folder: str, patterns: tuple[str, ...], suffixes: tuple[str, ...] = (".xml", ".txt"), force: bool = False, get: Get | None = None) -> list[str]:
    """The files of an archive with the first of the suffixes that it holds, by path; from the folder if a pattern matches there."""
    root = Path(folder)
    if not force:
        for p in patterns:
            if have := sorted(root.glob(p)):
                return [str(f) for f in have]
    with zipfile.ZipFile(io.BytesIO(download(url, get=get))) as z:
        for s in suffixes:
            if names := [n for n in z.namelist() if n.lower().endswith(s)]:
                break
        else:
            raise FileNotFoundError(f"{url} holds no file of {suffixes}")
        root.mkdir(parents=True, exist_ok=True)
        out = []
        for n in names:
            f = root / Path(n).name
            f.write_bytes(z.read(n))
            out.append(str(f))
        return out
