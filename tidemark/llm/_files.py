"""Files in the shared folder, read and written inside tasks."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def opened(uri: str):
    """(file system, path) of a URI."""
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def replacing(uri: str) -> Iterator:
    """A stream whose file appears under ``uri`` only when complete, so that a repeated or parallel attempt of a task does no harm."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(part) as out:
            yield out
        system.move(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(part)
        raise
