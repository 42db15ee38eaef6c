"""Reading parts of files by path, on the executors."""

from __future__ import annotations

_STORAGES: dict[str, object] = {}


def storage_of(uri: str):
    """The file system of a URI, made once for each storage and Python worker, and the place in it."""
    from pyarrow import fs

    head = "/".join(uri.split("/", 3)[:3])
    storage, place = (None, None) if head in _STORAGES else fs.FileSystem.from_uri(uri)
    if storage is None:
        storage = _STORAGES[head]
        place = uri.split("://", 1)[1] if storage.type_name in ("s3", "gcs") else uri[len(head) :]
    return _STORAGES.setdefault(head, storage), place


def read_range(path: str, start: int, length: int) -> bytes:
    """The bytes [start, start + length) of a file, fewer at its end."""
    if "://" not in path:
        with open(path, "rb") as file:
            file.seek(start)
            return file.read(length)
    storage, place = storage_of(path)
    with storage.open_input_file(place) as file:
        file.seek(start)
        return file.read(length)
