"""Frozen inputs: restored from their archives and compared with known digests."""

from __future__ import annotations

import gzip
import hashlib
import os
import shutil
import zipfile
from collections.abc import Sequence

from galeframe.operators.validation import IntegrityError


def sha256(path: str) -> str:
    """Digest of a local file, a megabyte at a time."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def restore_gzip(archive: str, target: str, digest: str) -> None:
    """Unpack archive to target unless it is there; a target with another digest raises, and one just made is removed first."""
    fresh = not os.path.exists(target)
    if fresh:
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        with gzip.open(archive, "rb") as source, open(f"{target}.part", "wb") as out:
            shutil.copyfileobj(source, out)
        if sha256(f"{target}.part") == digest:
            os.replace(f"{target}.part", target)
            return
        os.remove(f"{target}.part")
    if fresh or sha256(target) != digest:
        raise IntegrityError(f"{target} has not the digest {digest}")


def restore_members(archive: str, folder: str, names: Sequence[str], digest: str) -> None:
    """Unpack named members of a zip file of a known digest; members that are there must be equal."""
    if sha256(archive) != digest:
        raise IntegrityError(f"{archive} has not the digest {digest}")
    with zipfile.ZipFile(archive) as z:
        for name in names:
            target, content = os.path.join(folder, name), z.read(name)
            if os.path.exists(target):
                with open(target, "rb") as f:
                    if f.read() != content:
                        raise IntegrityError(f"{target} differs from the archive")
                continue
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as f:
                f.write(content)
