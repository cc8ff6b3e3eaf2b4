"""Paths and whole files, on local disks, HDFS and object stores alike."""

from __future__ import annotations

import posixpath

from pyarrow import fs

from keyweave.model import Status, StatusError
from keyweave.sources.records import file_system, list_files


def join(base: str, child: str) -> str:
    """An absolute child stands for itself."""
    return posixpath.join(base, child) if base else child


def normalize(path: str) -> str:
    """Without doubled slashes, ``.`` and ``..``; a leading slash stays, an empty path is empty."""
    plain = posixpath.normpath(path) if path else ""
    return "/" + plain.lstrip("/") if path.startswith("/") else plain


def base_name(path: str) -> str:
    """The last part; a slash for the root."""
    bare = path.rstrip("/")
    return bare.rpartition("/")[2] if bare else "/" if path else ""


def directory(path: str) -> str:
    """All but the last part; ``.`` without one, a slash for the root and what lies in it."""
    bare = path.rstrip("/")
    if not bare:
        return "/" if path else "."
    head, slash, _ = bare.rpartition("/")
    return (head.rstrip("/") or "/") if slash else "."


def extension(path: str) -> str:
    """What follows the last dot of the last part, without the dot."""
    return base_name(path).rpartition(".")[2] if "." in base_name(path) else ""


def exists(path: str) -> bool:
    system, p = file_system(path)
    return system.get_file_info(p).type != fs.FileType.NotFound


def read(path: str) -> bytes:
    system, p = file_system(path)
    if system.get_file_info(p).type != fs.FileType.File:
        raise StatusError(Status.NOT_FOUND, path)
    with system.open_input_stream(p) as f:
        return f.read()


def write(path: str, data: bytes) -> None:
    """Replaces the file, through a hidden one that is renamed."""
    system, p = file_system(path)
    hidden = join(directory(p), f".{base_name(p)}.tmp")
    with system.open_output_stream(hidden) as f:
        f.write(data)
    system.move(hidden, p)


def copy(source: str, dest: str) -> None:
    """Between file systems too."""
    a, b = file_system(source), file_system(dest)
    fs.copy_files(a[1], b[1], a[0], b[0])


def children(path: str) -> list[str]:
    """Names of the files of a folder."""
    return [f.rpartition("/")[2] for f in list_files(path)]


def remove(path: str) -> None:
    system, p = file_system(path)
    kind = system.get_file_info(p).type
    if kind == fs.FileType.NotFound:
        raise StatusError(Status.NOT_FOUND, path)
    system.delete_dir(p) if kind == fs.FileType.Directory else system.delete_file(p)
