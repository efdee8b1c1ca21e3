"""Numpy arrays as raw files in the shared folder, memory-mapped by workers.

The folder is the one of ``spark.checkpoint.dir``, on any file system that pyarrow can
reach. Files on a mounted file system are mapped where they lie. From other stores a
worker fetches a file once into its temporary folder and maps that copy, so a lost
executor's successor fetches it again. A file appears under its name when it is whole;
a task that runs twice writes the same bytes.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def save(folder: str, name: str, array: np.ndarray) -> None:
    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).tobytes() or b"")
    store.move(part, f"{path}/{name}")


_FETCHED: dict[tuple[str, str], str] = {}


def load(folder: str, name: str, dtype) -> np.ndarray:
    """The array as a read-only map."""
    store, path = _open(folder)
    if isinstance(store, fs.LocalFileSystem):
        local = f"{path}/{name}"
    else:
        local = _FETCHED.get((folder, name))
        if local is None or not os.path.exists(local):
            handle, local = tempfile.mkstemp(prefix="array-")
            with os.fdopen(handle, "wb") as out, store.open_input_stream(f"{path}/{name}") as data:
                while piece := data.read(1 << 22):
                    out.write(piece)
            _FETCHED[folder, name] = local
    if os.path.getsize(local) == 0:
        return np.zeros(0, dtype)
    return np.memmap(local, dtype, mode="r")


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 where a key is missing."""
    if len(keys) == 0 or len(wanted) == 0:
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)
