"""FITS files as bytes to images and back: the primary array and its header cards."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

BLOCK, CARD = 2880, 80
#: Cards that describe the array itself and are written from it.
STRUCTURE = re.compile(r"^(SIMPLE|BITPIX|NAXIS\d*|EXTEND|BZERO|BSCALE|END)$")
_DTYPE = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}


def _card(line: str) -> tuple[str, str, str | None] | None:
    name, rest = line[:8].strip(), line[10:]
    if line[8:10] != "= " or not name or name in ("COMMENT", "HISTORY"):
        return None
    if quoted := re.match(r"\s*'((?:[^']|'')*)'\s*(?:/\s*(.*))?", rest):
        return name, quoted[1].replace("''", "'").rstrip(), (quoted[2] or "").strip() or None
    value, _, comment = rest.partition("/")
    return name, value.strip(), comment.strip() or None


def read_header(data: bytes) -> tuple[dict[str, tuple[str, str | None]], int]:
    """(name to (value, comment), where the array starts)."""
    cards: dict[str, tuple[str, str | None]] = {}
    for at in range(0, len(data) - CARD + 1, CARD):
        line = data[at : at + CARD].decode("ascii", "replace")
        if line[:8].strip() == "END":
            return cards, -(-(at + CARD) // BLOCK) * BLOCK
        if card := _card(line):
            cards.setdefault(card[0], card[1:])
    raise ValueError("no END card")


@dataclass
class Layout:
    """Where a file's samples are and what makes values of them."""

    start: int
    size: int
    dtype: np.dtype
    planar: bool
    compression: str | None
    values: Callable[[np.ndarray], np.ndarray]
    by_top: bool  # the values depend on the image's largest sample


def describe(data: bytes) -> tuple[dict, Layout]:
    """(width, height, channels, bit_depth, color_space, keywords, and pixels: None; layout) of a file or its header.

    16-bit integers with the usual zero point are u16, other signed ones are held to 0..65535, 32-bit ones keep their high half.
    """
    cards, start = read_header(data)
    number = lambda name, default: float(cards.get(name, (str(default), None))[0])
    axes = [int(number(f"NAXIS{i}", 0)) for i in range(1, int(number("NAXIS", 0)) + 1)]
    if len(axes) not in (2, 3) or len(axes) == 3 and axes[2] not in (1, 3):
        raise ValueError(f"not an image of one or three planes: {axes}")
    width, height, channels = axes[0], axes[1], axes[2] if len(axes) == 3 else 1
    bits, zero, scale = int(number("BITPIX", 8)), number("BZERO", 0), number("BSCALE", 1)
    keywords = {k: v for k, v in cards.items() if not STRUCTURE.match(k)}
    depth = {8: "u8", 16: "u16", 32: "u16"}.get(bits, "f32")
    space = "RGB" if channels == 3 else "Bayer" if "BAYERPAT" in cards else "Mono"

    def values(raw: np.ndarray) -> np.ndarray:
        if bits == 32:
            return np.clip((raw.astype(np.float64) * scale + zero), 0, 2**32 - 1) // 65536 if zero else np.clip(raw, 0, 65535)
        if bits == 16:
            return np.clip(raw.astype(np.float64) * scale + zero, 0, 65535)
        return raw.astype(np.float64) * scale + zero

    dtype = np.dtype(_DTYPE[bits])
    out = {"width": width, "height": height, "channels": channels, "bit_depth": depth, "color_space": space, "keywords": keywords, "pixels": None}
    return out, Layout(start, width * height * channels * dtype.itemsize, dtype, True, None, values, depth == "f32")


def over_top(values: np.ndarray, top: float) -> np.ndarray:
    """Floats that were stored as whole numbers, told by the image's largest, come down to 0..1."""
    return values / 65535 if top > 255 else values / 255 if top > 1.5 else values


def read(data: bytes, pixels: bool = True) -> dict:
    """What ``describe`` gives and (if asked for) interleaved samples."""
    out, layout = describe(data)
    if pixels:
        values = layout.values(np.frombuffer(data, layout.dtype, out["width"] * out["height"] * out["channels"], layout.start))
        if layout.by_top and len(values):
            values = over_top(values, np.nanmax(values))
        out["pixels"] = values.reshape(out["channels"], -1).T.ravel().astype(np.float32)
    return out


def _value(text: str) -> str:
    if text in ("T", "F"):
        return text.rjust(20)
    if re.fullmatch(r"-?(0|[1-9]\d*)", text) or re.fullmatch(r"-?(0|[1-9]\d*)\.\d+([eE][-+]?\d+)?", text):
        return text.rjust(20)
    return "'" + text.replace("'", "''").ljust(8) + "'"


def _lines(keywords: dict[str, tuple[str, str | None]]) -> list[str]:
    return [f"{name:<8}= {_value(value)}" + (f" / {comment}" if comment else "") for name, (value, comment) in sorted(keywords.items()) if not STRUCTURE.match(name)]


def _block(lines: list[str]) -> bytes:
    header = "".join(line[:CARD].ljust(CARD) for line in [*lines, "END"]).encode("ascii", "replace")
    return header.ljust(-(-len(header) // BLOCK) * BLOCK)


def with_keywords(data: bytes, keywords: dict[str, tuple[str, str | None]]) -> bytes:
    """The file with other keywords: cards that describe the array stay as they are, and so does the array."""
    _, start = read_header(data)
    cards = [data[at : at + CARD].decode("ascii", "replace") for at in range(0, start, CARD)]
    own = [c for c in cards if STRUCTURE.match(c[:8].strip()) and c[:8].strip() != "END"]
    return _block([*own, *_lines(keywords)]) + data[start:]


def write(image: dict) -> bytes:
    """The file of an image as ``read`` gives it."""
    depth, channels = image["bit_depth"], image["channels"]
    bits, zero = {"u8": (8, 0), "u16": (16, 32768), "f32": (-32, 0)}[depth]
    cards = [("SIMPLE", "T"), ("BITPIX", str(bits)), ("NAXIS", "3" if channels > 1 else "2"), ("NAXIS1", str(image["width"])), ("NAXIS2", str(image["height"]))]
    cards += [("NAXIS3", str(channels))] * (channels > 1) + [("BZERO", str(zero)), ("BSCALE", "1")] * bool(zero)
    lines = [f"{k:<8}= {_value(v)}" for k, v in cards] + _lines(image["keywords"])
    planes = np.asarray(image["pixels"], np.float64).reshape(-1, channels).T
    data = (planes - zero).astype(_DTYPE[bits]).tobytes()
    return _block(lines) + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")
