"""Binary files in the shared folder, written and read inside tasks by URI."""

from __future__ import annotations

from contextlib import contextmanager
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """A binary output stream; folders are made as needed."""
    system, path = _located(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None, buffer_size=1 << 20) as out:
        yield out


@contextmanager
def reading(uri: str):
    """A seekable binary input file."""
    system, path = _located(uri)
    with system.open_input_file(path) as src:
        yield src


@contextmanager
def mapped(uri: str, dtype: str):
    """The file as a flat array: memory-mapped where the folder is mounted, else read."""
    system, path = _located(uri)
    kind = np.dtype(dtype)
    if isinstance(system, fs.LocalFileSystem):
        if not system.get_file_info(path).size:
            yield np.zeros(0, kind)
            return
        yield np.memmap(path, dtype=kind, mode="r")
    else:
        with system.open_input_file(path) as src:
            yield np.frombuffer(src.read(), dtype=kind)


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
