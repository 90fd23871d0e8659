"""Files in the shared folder, opened by URI from any task."""
from __future__ import annotations


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a Hadoop-style URI or a plain path."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + rest)


def make_folder(uri: str) -> None:
    system, path = filesystem(uri)
    system.create_dir(path, recursive=True)


def write_bytes(uri: str, data: bytes) -> None:
    system, path = filesystem(uri)
    with system.open_output_stream(path, compression=None) as f:
        f.write(data)


def read_bytes(uri: str) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def read_range(uri: str, begin: int, size: int) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_file(path) as f:
        f.seek(begin)
        return f.read(size)
