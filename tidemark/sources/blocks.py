"""Files opened by tasks, a block at a time: for what must read or leave a file that no single value can hold."""

from __future__ import annotations

import hashlib
import sys

from pyarrow import fs
from pyspark import cloudpickle

# the functions below run on executors, which need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 8 << 20


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, written as Hadoop prints paths (nothing encoded), and the path in it.

    Local paths, ``file:``, ``s3a:`` and what Arrow knows (``hdfs:`` and ``viewfs:`` through Hadoop's own
    client, ``gs:``, ``abfss:``); any other scheme raises ``ValueError``.
    """
    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme == "s3a":
        return fs.FileSystem.from_uri("s3://" + rest.lstrip("/").partition("/")[0])[0], rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(uri)
    except (OSError, NotImplementedError, ValueError) as failure:  # Arrow's own errors are among them
        raise ValueError(f"{scheme}: cannot be opened by a task: {failure}") from failure


def digest_file(uri: str, algorithm: str, block: int = BLOCK_BYTES) -> str:
    """The hexadecimal digest of a whole file, read in blocks."""
    system, path = file_system(uri)
    found = hashlib.new(algorithm)
    with system.open_input_stream(path) as stream:
        while data := stream.read(block):
            found.update(data)
    return found.hexdigest()


def is_there(uri: str) -> bool:
    system, path = file_system(uri)
    return system.get_file_info(path).type == fs.FileType.File


def put_file(uri: str, data: bytes = b"") -> None:
    """Write a small file; its folder must be there on file systems that have folders."""
    system, path = file_system(uri)
    with system.open_output_stream(path) as stream:
        stream.write(data)


def move_file(source: str, target: str) -> None:
    """Move a file; done once more it changes nothing."""
    system, path = file_system(source)
    place = file_system(target)[1]
    if system.get_file_info(path).type == fs.FileType.NotFound:
        if system.get_file_info(place).type != fs.FileType.File:
            raise OSError(f"neither {source} nor {target} is there")
        return
    system.create_dir(place.rpartition("/")[0], recursive=True)
    system.move(path, place)


def drop_file(uri: str) -> None:
    """Delete a file if it is there."""
    system, path = file_system(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        system.delete_file(path)


def make_folder(uri: str) -> None:
    system, path = file_system(uri)
    system.create_dir(path, recursive=True)
