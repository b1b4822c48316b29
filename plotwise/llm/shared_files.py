"""Plain files in the shared folder, whatever store it is in: local paths directly, others by pyarrow's file systems."""

from __future__ import annotations

import os

import numpy as np


def _local(uri: str) -> str | None:
    return uri.removeprefix("file://") if uri.startswith("file://") else uri.removeprefix("file:") if uri.startswith(("file:/", "/")) else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def open_out(uri: str):
    """A new file; its folder is made."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    store, path = _remote(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def move(uri: str, to: str) -> None:
    """Rename over what may be there: how a task commits a file, whichever attempt comes last."""
    if path := _local(uri):
        os.replace(path, _local(to))
    else:
        store, path = _remote(uri)
        store.move(path, _remote(to)[1])


def read_array(uri: str, dtype) -> np.ndarray:
    """A flat array file: memory-mapped where the path is local, else read whole."""
    dtype = np.dtype(dtype)
    if path := _local(uri):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    store, path = _remote(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_bytes(uri: str) -> bytes:
    if path := _local(uri):
        with open(path, "rb") as f:
            return f.read()
    store, path = _remote(uri)
    with store.open_input_file(path) as f:
        return f.read()
