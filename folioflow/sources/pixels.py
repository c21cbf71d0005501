"""Samples of PDF images as PNG files: grey, RGB, CMYK, palettes, spot colours, 1 to 16 bits, stencils, soft masks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

#: Pixels beyond which an image is not taken apart.
MOST = 1 << 27


class Unsupported(ValueError):
    """An image whose samples are not understood."""


def samples(data: bytes, width: int, height: int, colors: int, bits: int) -> np.ndarray:
    """[row, column, color] as integers; rows begin at whole bytes."""
    if bits not in (1, 2, 4, 8, 16) or width < 1 or height < 1 or width * height * colors > MOST:
        raise Unsupported("bits or size")
    stride = (width * colors * bits + 7) // 8
    if len(data) < stride * height:
        raise Unsupported("too short")
    raw = np.frombuffer(data, dtype=np.uint8, count=stride * height).reshape(height, stride)
    if bits == 16:
        values = raw.reshape(height, -1, 2).astype(np.uint16)
        values = values[:, :, 0] << 8 | values[:, :, 1]
    elif bits == 8:
        values = raw
    else:
        steps = np.arange(8 - bits, -1, -bits)
        values = (raw[:, :, None] >> steps & (1 << bits) - 1).reshape(height, -1)
    return values[:, : width * colors].reshape(height, width, colors)


def unit(values: np.ndarray, bits: int, decode: list[float], colors: int) -> np.ndarray:
    """Samples as numbers from 0 to 1, by the image's Decode array where it has one."""
    x = values / float((1 << bits) - 1)
    if len(decode) == 2 * colors:
        low, high = np.array(decode[::2], dtype=float), np.array(decode[1::2], dtype=float)
        x = low + x * (high - low)
    return np.clip(x, 0, 1)


def rgb_of_cmyk(x: np.ndarray) -> np.ndarray:
    return (1 - x[..., :3]) * (1 - x[..., 3:])


def png(values: np.ndarray, bits: int, kind: int, palette: bytes = b"") -> bytes:
    """A PNG from [row, column, channel] integers of 8 or 16 bits, or packed rows of bytes for fewer."""
    height, width = values.shape[:2]
    raw = values.astype(">u2" if bits == 16 else np.uint8).reshape(height, -1)
    if bits < 8:
        each = np.zeros((height, -(-raw.shape[1] * bits // 8) * 8 // bits), dtype=np.uint8)
        each[:, : raw.shape[1]] = raw
        parts = each.reshape(height, -1, 8 // bits)
        raw = (parts << np.arange(8 - bits, -1, -bits)).sum(axis=2).astype(np.uint8)
    rows = b"".join(b"\0" + r.tobytes() for r in raw)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", width, height, bits, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


class Space:
    """A colour space: how many colours a sample has, and what they are as grey (1 channel) or RGB (3), from 0 to 1."""

    def __init__(self, file, value, resources: dict | None = None, depth: int = 0):
        if depth > 4:
            raise Unsupported("colour spaces within each other")
        value = file.get(value)
        named = file.dict((resources or {}).get("ColorSpace"))
        if isinstance(value, str) and value in named:
            value = file.get(named[value])
        parts = [file.get(x) for x in value] if isinstance(value, list) else [value]
        kind = str(parts[0])
        self.palette: bytes | None = None
        self.convert: Callable[[np.ndarray], np.ndarray] = lambda x: x
        if kind in ("DeviceGray", "G", "CalGray"):
            self.colors = 1
        elif kind in ("DeviceRGB", "RGB", "CalRGB"):
            self.colors = 3
        elif kind in ("DeviceCMYK", "CMYK"):
            self.colors, self.convert = 4, rgb_of_cmyk
        elif kind == "ICCBased" and len(parts) > 1:
            self.colors = int(file.number(file.dict(parts[1]).get("N"), 3))
            if self.colors not in (1, 3, 4):
                raise Unsupported("profile")
            self.convert = rgb_of_cmyk if self.colors == 4 else self.convert
        elif kind in ("Indexed", "I") and len(parts) > 3:
            base = Space(file, parts[1], resources, depth + 1)
            table = parts[3] if isinstance(parts[3], bytes) else file.decoded(parts[3])
            if base.palette is not None:
                raise Unsupported("palette of a palette")
            n = min(int(file.number(parts[2])) + 1, 256, len(table) // base.colors)
            colours = base.convert(np.frombuffer(table, dtype=np.uint8, count=n * base.colors).reshape(n, base.colors) / 255.0)
            colours = np.repeat(colours, 3, axis=1) if colours.shape[1] == 1 else colours
            self.colors, self.palette = 1, np.rint(colours * 255).astype(np.uint8).tobytes()
        elif kind in ("Separation", "DeviceN") and len(parts) > 3:
            self.colors = len(file.list(parts[1])) if kind == "DeviceN" else 1
            base, tint = Space(file, parts[2], resources, depth + 1), function(file, parts[3])
            if tint is None and self.colors == 1:
                self.convert = lambda x: 1 - x  # more of a colour is darker
            elif tint is None or base.palette is not None:
                raise Unsupported("tints")
            else:
                self.convert = lambda x: base.convert(tint(x))
        else:
            raise Unsupported("colour space")


def function(file, value) -> Callable[[np.ndarray], np.ndarray] | None:
    """A tint function of one variable: exponential, sampled or stitched; None for others."""
    info = file.dict(value)
    numbers = lambda key: [float(file.number(x)) for x in file.list(info.get(key))]
    kind = int(file.number(info.get("FunctionType"), -1))
    domain = numbers("Domain") or [0.0, 1.0]
    if len(domain) != 2:
        return None
    if kind == 2:
        low, high, power = np.array(numbers("C0") or [0.0]), np.array(numbers("C1") or [1.0]), float(file.number(info.get("N"), 1))
        return lambda x: low + np.clip(x[..., :1], *domain) ** power * (high - low)
    if kind == 0:
        size, bits, span = int(file.number((file.list(info.get("Size")) or [0])[0])), int(file.number(info.get("BitsPerSample"), 8)), numbers("Range")
        if size < 2 or len(span) < 2:
            return None
        colors = len(span) // 2
        packed = file.decoded(file.get(value))
        table = samples(packed, size * colors, 1, 1, bits).reshape(size, colors) / float((1 << bits) - 1)
        decode = numbers("Decode") or span
        table = np.array(decode[::2]) + table * (np.array(decode[1::2]) - np.array(decode[::2]))

        def sampled(x: np.ndarray) -> np.ndarray:
            at = (np.clip(x[..., 0], *domain) - domain[0]) / (domain[1] - domain[0]) * (size - 1)
            return np.stack([np.interp(at, np.arange(size), table[:, c]) for c in range(colors)], axis=-1)

        return sampled
    return None


def image(file, info: dict, data: bytes, resources: dict | None = None, mask: np.ndarray | None = None) -> bytes:
    """A PNG of an image's samples. info: its dictionary, long or short names. Bits are kept where PNG has them."""
    either = lambda a, b: file.get(info.get(a, info.get(b)))
    width, height = int(file.number(either("Width", "W"))), int(file.number(either("Height", "H")))
    decode = [float(file.number(x)) for x in file.list(either("Decode", "D"))]
    if str(either("ImageMask", "IM")) == "true":
        values = samples(data, width, height, 1, 1)
        return png(1 - values if decode[:1] == [1.0] else values, 1, 0)
    bits = int(file.number(either("BitsPerComponent", "BPC"), 8))
    space = Space(file, either("ColorSpace", "CS"), resources)
    values = samples(data, width, height, space.colors, bits)
    plain = not decode or decode == [0.0, 1.0] * space.colors or space.palette is not None and decode == [0.0, float((1 << bits) - 1)]
    if mask is not None and mask.shape != (height, width):
        mask = None
    if space.palette is not None:
        if bits > 8 or not plain:
            raise Unsupported("palette")
        n = len(space.palette) // 3
        if n == 0:
            raise Unsupported("palette")
        values = np.minimum(values, n - 1)
        if mask is None:
            return png(values, bits, 3, space.palette)
        colours = np.frombuffer(space.palette, dtype=np.uint8).reshape(n, 3)[values[:, :, 0]]
        return png(np.dstack([colours, mask]), 8, 6)
    convert = space.convert(np.zeros((1, 1, space.colors)))
    if plain and mask is None and convert.shape[-1] == space.colors and space.colors == 1 and not convert.any():
        return png(values, bits, 0)
    if plain and mask is None and space.colors == 3 and bits in (8, 16):
        return png(values, bits, 2)
    out = np.clip(space.convert(unit(values, bits, decode, space.colors)), 0, 1)
    out = np.rint(out * 255).astype(np.uint8)
    if out.shape[-1] not in (1, 3):
        raise Unsupported("colours")
    kind = 0 if out.shape[-1] == 1 else 2
    return png(out, 8, kind) if mask is None else png(np.dstack([out, mask]), 8, kind + 4)
