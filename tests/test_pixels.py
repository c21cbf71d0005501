from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from folioflow.config import Limits
from folioflow.sources import pdf, pixels
from folioflow.sources import samples as s


def png_pixels(data: bytes) -> tuple[int, int, np.ndarray]:
    """Bits, kind and [row, column, channel] of a PNG without filters; palettes are looked up."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        parts[name] = parts.get(name, b"") + data[at + 8 : at + 8 + n]
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        at += 12 + n
    width, height, bits, kind = struct.unpack(">IIBB", parts[b"IHDR"][:10])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    stride = (width * channels * bits + 7) // 8
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), dtype=np.uint8).reshape(height, stride + 1)
    assert not rows[:, 0].any()
    values = pixels.samples(rows[:, 1:].tobytes(), width, height, channels, bits)
    if kind == 3:
        values = np.frombuffer(parts[b"PLTE"], dtype=np.uint8).reshape(-1, 3)[values[:, :, 0]]
    return bits, kind, values


def image(entries: str, data: bytes, extra: list[bytes] = ()) -> tuple[int, int, np.ndarray]:
    """The image of a file with one page; extra objects are numbered from 20."""
    content = s.pdf_with_image(entries, data, list(extra))
    items = pdf.extract(content, Limits()).items
    found = [i for i in items if i.kind == "image"]
    assert len(found) == 1 and found[0].ext == ".png", [i.text for i in items]
    return png_pixels(found[0].content)


def test_grey_of_all_bits():
    for bits in (1, 2, 4, 8, 16):
        values = np.arange(15).reshape(3, 5) % (1 << min(bits, 8))
        packed = b"".join(int("".join(f"{v:0{bits}b}" for v in row).ljust(-(-5 * bits // 8) * 8, "0"), 2).to_bytes(-(-5 * bits // 8), "big") for row in values)
        got = image(f"/Width 5/Height 3/ColorSpace/DeviceGray/BitsPerComponent {bits}", packed)
        assert got[:2] == (bits, 0) and (got[2][:, :, 0] == values).all()


def test_palettes():
    table = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    got = image("/Width 3/Height 1/ColorSpace[/Indexed/DeviceRGB 3 20 0 R]/BitsPerComponent 2", bytes([0b00_11_10_00]), [b"<</Length 12>>\nstream\n" + table + b"\nendstream"])
    assert got[2].tolist() == [[[255, 0, 0], [9, 9, 9], [0, 0, 255]]]
    got = image("/Width 2/Height 1/ColorSpace[/Indexed/DeviceCMYK 1 <00000000 000000FF>]/BitsPerComponent 8", bytes([1, 0]))
    assert got[2].tolist() == [[[0, 0, 0], [255, 255, 255]]]
    got = image("/Width 2/Height 1/ColorSpace[/Indexed/DeviceGray 1 (\\000\\200)]/BitsPerComponent 8", bytes([1, 7]))
    assert got[2].tolist() == [[[128] * 3, [128] * 3]]  # an index beyond the palette is its last entry


def test_cmyk_spots_and_decode():
    got = image("/Width 2/Height 1/ColorSpace/DeviceCMYK/BitsPerComponent 8", bytes([255, 0, 0, 0, 0, 0, 0, 128]))
    assert got[2].tolist() == [[[0, 255, 255], [127, 127, 127]]]
    got = image("/Width 1/Height 1/ColorSpace/DeviceCMYK/BitsPerComponent 8/Decode[1 0 1 0 1 0 1 0]", bytes([0, 255, 255, 255]))
    assert got[2].tolist() == [[[0, 255, 255]]]
    got = image("/Width 2/Height 1/ColorSpace[/Separation/Spot/DeviceRGB<</FunctionType 2/Domain[0 1]/C0[1 1 1]/C1[1 0 0]/N 1>>]/BitsPerComponent 8", bytes([255, 0]))
    assert got[2].tolist() == [[[255, 0, 0], [255, 255, 255]]]
    got = image("/Width 2/Height 1/ColorSpace[/Separation/Spot/DeviceGray 20 0 R]/BitsPerComponent 8", bytes([255, 0]), [b"<</FunctionType 0/Domain[0 1]/Range[0 1]/Size[2]/BitsPerSample 8/Length 2>>\nstream\n\xff\x40\nendstream"])
    assert got[2].tolist() == [[[64], [255]]]
    got = image("/Width 2/Height 1/ColorSpace[/Separation/Spot/DeviceCMYK<</FunctionType 4>>]/BitsPerComponent 8", bytes([255, 0]))
    assert got[2].tolist() == [[[0], [255]]]
    got = image("/Width 3/Height 1/ColorSpace/DeviceGray/BitsPerComponent 8/Decode[1 0]", bytes([0, 100, 255]))
    assert got[2][:, :, 0].tolist() == [[255, 155, 0]]
    got = image("/Width 2/Height 1/ColorSpace/DeviceRGB/BitsPerComponent 4", bytes([0xF0, 0x0F, 0x00]))
    assert got[2].tolist() == [[[255, 0, 0], [255, 0, 0]]]
    got = image("/Width 1/Height 1/ColorSpace/DeviceRGB/BitsPerComponent 16", bytes([1, 2, 3, 4, 5, 6]))
    assert got[:2] == (16, 2) and got[2].tolist() == [[[0x102, 0x304, 0x506]]]


def test_stencils_and_soft_masks():
    got = image("/Width 3/Height 1/ImageMask true/BitsPerComponent 1", bytes([0b01000000]))
    assert got[2][:, :, 0].tolist() == [[0, 1, 0]]
    assert image("/Width 3/Height 1/ImageMask true/Decode[1 0]", bytes([0b01000000]))[2][:, :, 0].tolist() == [[1, 0, 1]]
    mask = b"<</Type/XObject/Subtype/Image/Width 2/Height 1/ColorSpace/DeviceGray/BitsPerComponent 8/Length 2>>\nstream\n\x00\x80\nendstream"
    got = image("/Width 2/Height 1/ColorSpace/DeviceRGB/BitsPerComponent 8/SMask 20 0 R", bytes([1, 2, 3, 4, 5, 6]), [mask])
    assert got[1] == 6 and got[2].tolist() == [[[1, 2, 3, 0], [4, 5, 6, 128]]]
    got = image("/Width 2/Height 1/ColorSpace/DeviceGray/BitsPerComponent 8/SMask 20 0 R", bytes([1, 2]), [mask])
    assert got[1] == 4 and got[2].tolist() == [[[1, 0], [2, 128]]]
    got = image("/Width 1/Height 1/ColorSpace/DeviceGray/BitsPerComponent 8/SMask 20 0 R", bytes([7]), [mask])  # of another size
    assert got[1] == 0 and got[2].tolist() == [[[7]]]


def test_inline_images():
    plain = "q 9 0 0 9 0 0 cm BI /W 3 /H 1 /CS /G /BPC 8 ID \x01 EI EI Q " + s.text_at(50, 700, "after")
    items = pdf.extract(s.pdf([plain.replace("\x01 EI", "\x01 E")]), Limits()).items
    assert [png_pixels(i.content)[2].ravel().tolist() for i in items if i.kind == "image"] == [[1, 32, 69]]
    assert next(i.text for i in items if i.kind == "page") == "after"
    packed = "BI /W 2 /H 1 /CS /RGB /BPC 8 /F /AHx ID 010203040506> EI " + s.text_at(50, 700, "more")
    items = pdf.extract(s.pdf([packed]), Limits()).items
    assert [png_pixels(i.content)[2].ravel().tolist() for i in items if i.kind == "image"] == [[1, 2, 3, 4, 5, 6]]
    assert next(i.text for i in items if i.kind == "page") == "more"


@pytest.mark.parametrize("entries", ["/Width 9/Height 9/ColorSpace/DeviceRGB/BitsPerComponent 8", "/Width 1/Height 1/ColorSpace/Pattern/BitsPerComponent 8", "/Width 1/Height 1/ColorSpace/DeviceGray/BitsPerComponent 3", "/Width 1/Height 1/BitsPerComponent 8", "/Width 99999/Height 99999/ColorSpace/DeviceGray/BitsPerComponent 8", "/Width 1/Height 1/ColorSpace/DeviceGray/BitsPerComponent 1/Filter/JBIG2Decode"])
def test_what_cannot_be_read_leaves_a_warning(entries):
    items = pdf.extract(s.pdf_with_image(entries, b"\0\0"), Limits()).items
    assert [i.text for i in items if i.kind == "warning"] == ["Page 1 contains an image that could not be extracted."]
