"""Arrays in files of a task's local disk, for what may outgrow the memory of a task.

The files have no name and end with the arrays. What is read stays in the system's page cache as long as there is room.
"""

from __future__ import annotations

import math
import os
import tempfile
from typing import BinaryIO

import numpy as np

#: Arrays below this many bytes stay in memory.
SMALL = 1 << 18


def _file() -> BinaryIO:
    """An unnamed file in one of Spark's local folders, or where temporary files go."""
    folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(f) and os.access(f, os.W_OK)]
    return tempfile.TemporaryFile(dir=folders[os.getpid() % len(folders)] if folders else None)


def empty(shape: tuple[int, ...] | int, dtype: type) -> np.ndarray:
    """As ``np.empty``, in a file unless it is small."""
    shape = (shape,) if isinstance(shape, int) else shape
    size = math.prod(shape) * np.dtype(dtype).itemsize
    if size < SMALL:
        return np.empty(shape, dtype)
    with _file() as file:
        # A full disk is told here, and not by a signal where the array is written.
        os.posix_fallocate(file.fileno(), 0, size)
        return np.memmap(file, dtype, "r+", shape=shape).view(np.ndarray)


class Growing:
    """Rows that are added from time to time and read as one array in the end."""

    def __init__(self, dtype: type, *width: int):
        self.dtype, self.width, self.rows = np.dtype(dtype), width, 0
        self.file = _file()

    def add(self, rows: np.ndarray) -> None:
        self.rows += len(rows)
        self.file.write(np.ascontiguousarray(rows, self.dtype).data)

    def array(self) -> np.ndarray:
        """All rows; none can be added afterwards."""
        shape = (self.rows, *self.width)
        with self.file as file:
            file.flush()
            return np.memmap(file, self.dtype, "r+", shape=shape).view(np.ndarray) if self.rows else np.empty(shape, self.dtype)
