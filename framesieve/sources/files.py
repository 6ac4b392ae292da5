"""Image files read by ranges: headers alone, and rows of pixels without those around them."""

from __future__ import annotations

import numpy as np

from framesieve.sources import fits, xisf

FORMATS = {"fit": fits, "fits": fits, "fts": fits, "xisf": xisf}
#: Bytes of samples read at a time where a whole image is looked through.
STEP_BYTES = 16 << 20


def kind_of(path: str):
    """The module that reads a file of that name, or None."""
    return FORMATS.get(path.rsplit(".", 1)[-1].lower())


def store_of(path: str):
    """(file system, path in it) of a path or URI, as executors reach it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)  # blanks and the like are no part of a URI


class ImageFile:
    """An open image file; ``image`` holds what its header tells, ``bytes_read`` how much of it was read so far.

    Samples that are compressed, and floats, whose scale depends on the largest of them, take the whole file: it is read once.
    """

    def __init__(self, path: str) -> None:
        kind = kind_of(path)
        if kind is None:
            raise ValueError("unsupported file type")
        store, place = store_of(path)
        self.file = store.open_input_file(place)
        self.bytes_read = 0
        self.xisf = kind is xisf
        self.image, self.layout = kind.describe(self._head())
        self.whole: np.ndarray | None = None
        self.top: float | None = None

    def __enter__(self) -> ImageFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _at(self, start: int, size: int) -> bytes:
        data = self.file.read_at(size, start)
        self.bytes_read += len(data)
        return data

    def _head(self) -> bytes:
        if self.xisf:
            start = self._at(0, 16)
            return start + self._at(16, int.from_bytes(start[8:12], "little"))
        data = b""
        while len(block := self._at(len(data), fits.BLOCK)) == fits.BLOCK:
            data += block
            if any(block[at : at + fits.CARD].rstrip() == b"END" for at in range(0, fits.BLOCK, fits.CARD)):
                return data
        return data + block

    @property
    def parts(self) -> bool:
        """Whether rows can be read without the others."""
        return not (self.layout.compression or self.layout.by_top)

    def _raw(self, first: int, last: int) -> np.ndarray:
        """(rows, width, channels) as stored."""
        width, height, channels = (self.image[c] for c in ("width", "height", "channels"))
        layout = self.layout
        layout.values(np.zeros(0, layout.dtype))  # an error if there are no samples to be read
        row = width * layout.dtype.itemsize * (1 if layout.planar else channels)

        def rows(start: int) -> np.ndarray:
            data = self._at(start + first * row, (last - first) * row)
            if len(data) < (last - first) * row:
                raise ValueError("the file ends before its samples do")
            return np.frombuffer(data, layout.dtype)

        if layout.compression:
            if self.whole is None:
                self.whole = np.frombuffer(xisf.unpacked(self._at(layout.start, layout.size), layout), layout.dtype, width * height * channels)
            shaped = self.whole.reshape(channels, height, width).transpose(1, 2, 0) if layout.planar else self.whole.reshape(height, width, channels)
            return shaped[first:last]
        if layout.planar:
            return np.stack([rows(layout.start + c * height * row).reshape(-1, width) for c in range(channels)], axis=2)
        return rows(layout.start).reshape(-1, width, channels)

    def rows(self, first: int, last: int) -> np.ndarray:
        """(rows, width, channels) of rows ``first`` to before ``last``, as 32-bit floats; the same samples as of the whole image."""
        values = self.layout.values(self._raw(first, last))
        if self.layout.by_top and values.size:
            values = fits.over_top(values, self._largest())
        return values.astype(np.float32)

    def _largest(self) -> float:
        if self.top is None:
            step = max(1, STEP_BYTES // max(1, self.image["width"] * self.image["channels"] * self.layout.dtype.itemsize))
            parts = (self.layout.values(self._raw(at, min(at + step, self.image["height"]))) for at in range(0, self.image["height"], step))
            self.top = float(np.nanmax([np.nanmax(v) for v in parts if v.size] or [0.0]))
        return self.top
