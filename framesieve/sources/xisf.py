"""XISF files as bytes to images and back: the first image, attached, plain or compressed."""

from __future__ import annotations

import zlib
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa

from framesieve.sources.fits import Layout

SIGNATURE, ALIGN = b"XISF0100", 4096
_DTYPE = {"UInt8": "<u1", "UInt16": "<u2", "UInt32": "<u4", "Float32": "<f4", "Float64": "<f8", "Byte": "<u1", "UShort": "<u2", "UInt": "<u4", "Float": "<f4", "Double": "<f8"}
_SPACE = {"RGB": "RGB", "CFA": "Bayer"}


def _decompressed(data: bytes, how: str) -> bytes:
    codec, size, *item = how.split(":")
    codec, _, shuffled = codec.partition("+")
    if codec == "zlib":
        out = zlib.decompress(data)
    else:
        out = pa.decompress(data, int(size), codec={"lz4": "lz4_raw", "lz4hc": "lz4_raw", "zstd": "zstd"}[codec], asbytes=True)
    if shuffled:
        width = int(item[0])
        whole = len(out) // width * width
        out = np.frombuffer(out, np.uint8, whole).reshape(width, -1).T.tobytes() + out[whole:]
    return out


def describe(data: bytes) -> tuple[dict, Layout]:
    """As the FITS reader gives it; 32-bit integers keep their high half. Data outside an attachment is an error once it is read."""
    if data[:8] != SIGNATURE:
        raise ValueError("no XISF signature")
    length = int.from_bytes(data[8:12], "little")
    root = ElementTree.fromstring(data[16 : 16 + length].rstrip(b"\0"))
    image = next((e for e in root.iter() if e.tag.rpartition("}")[2] == "Image"), None)
    if image is None:
        raise ValueError("no image")
    width, height, *rest = (int(x) for x in image.get("geometry", "").split(":"))
    channels = rest[0] if rest else 1
    keywords = {e.get("name", "").upper(): (e.get("value", "").strip().strip("'").strip(), e.get("comment") or None) for e in image if e.tag.rpartition("}")[2] == "FITSKeyword"}
    kind = image.get("sampleFormat", "UInt16")
    space = _SPACE.get(image.get("colorSpace", "Gray"), "Mono")
    if space == "Mono" and "BAYERPAT" in keywords:
        space = "Bayer"
    dtype = np.dtype(_DTYPE[kind])
    depth = "f32" if dtype.kind == "f" else "u8" if dtype.itemsize == 1 else "u16"
    out = {"width": width, "height": height, "channels": channels, "bit_depth": depth, "color_space": space, "keywords": keywords, "pixels": None}
    place, *where = image.get("location", "").split(":")
    start, size = (int(where[0]), int(where[1])) if place == "attachment" else (-1, 0)
    planar = image.get("pixelStorage", "Planar").lower() != "normal"

    def values(raw: np.ndarray) -> np.ndarray:
        if start < 0:
            raise ValueError(f"unsupported location: {place}")
        return raw >> 16 if dtype.itemsize == 4 and dtype.kind == "u" else raw

    return out, Layout(start, size, dtype, planar, image.get("compression"), values, False)


def unpacked(data: bytes, layout: Layout) -> bytes:
    """The samples' bytes, decompressed, of what is attached."""
    return _decompressed(data, layout.compression) if layout.compression else data


def read(data: bytes, pixels: bool = True) -> dict:
    """What ``describe`` gives and (if asked for) interleaved samples."""
    out, layout = describe(data)
    if pixels:
        channels = out["channels"]
        raw = unpacked(data[layout.start : layout.start + layout.size], layout) if layout.start >= 0 else b""
        values = layout.values(np.frombuffer(raw, layout.dtype, out["width"] * out["height"] * channels if raw else 0))
        if layout.planar:
            values = values.reshape(channels, -1).T.ravel()
        out["pixels"] = values.astype(np.float32)
    return out


def write(image: dict, compress: bool = False) -> bytes:
    """The file of an image; compressed data is LZ4 over shuffled bytes, unless that is no smaller."""
    channels = image["channels"]
    kind = {"u8": "UInt8", "u16": "UInt16", "f32": "Float32"}[image["bit_depth"]]
    dtype = np.dtype(_DTYPE[kind])
    raw = np.asarray(image["pixels"]).astype(dtype).reshape(-1, channels).T.tobytes()
    attributes = {"geometry": f"{image['width']}:{image['height']}:{channels}", "sampleFormat": kind, "colorSpace": "RGB" if channels == 3 else "Gray"}
    if kind == "Float32":
        attributes["bounds"] = "0:1"
    data = raw
    if compress:
        shuffled = np.frombuffer(raw, np.uint8).reshape(-1, dtype.itemsize).T.tobytes()
        packed = pa.compress(shuffled, codec="lz4_raw", asbytes=True)
        if len(packed) < len(raw):
            data, attributes["compression"] = packed, f"lz4hc+sh:{len(raw)}:{dtype.itemsize}"
    at = ALIGN
    while True:  # the header names the place of the data, which depends on the header's length
        root = ElementTree.Element("xisf", {"version": "1.0", "xmlns": "http://www.pixinsight.com/xisf"})
        element = ElementTree.SubElement(root, "Image", attributes | {"location": f"attachment:{at}:{len(data)}"})
        for name, (value, comment) in sorted(image["keywords"].items()):
            ElementTree.SubElement(element, "FITSKeyword", {"name": name, "value": value, "comment": comment or ""})
        header = ElementTree.tostring(root, "utf-8", xml_declaration=True)
        need = -(-(16 + len(header)) // ALIGN) * ALIGN
        if need == at:
            return (SIGNATURE + len(header).to_bytes(4, "little") + bytes(4) + header).ljust(at, b"\0") + data
        at = need
