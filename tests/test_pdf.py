"""PDF files that are protected, updated, or packed in less common ways."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import pytest

from folioflow.config import Limits
from folioflow.sources import cipher, pdf
from folioflow.sources import samples as s
from folioflow.sources.items import Failure

ID = bytes(range(16))
PERMISSIONS = -44


def text_of(content: bytes) -> str:
    return next(i.text for i in pdf.extract(content, Limits()).items if i.kind == "page")


def protected(content: bytes, kind: str, password: bytes = b"") -> bytes:
    """A file with all streams enciphered: RC4 of 40 or 128 bits, AES of 128 or 256 bits."""
    pad = (password + cipher.PADDING)[:32]
    owner = hashlib.sha256(b"owner").digest()
    if kind == "aes256":
        key, salts = hashlib.sha256(b"file key").digest(), (b"validate", b"keysalt!")
        user = cipher.hardened(password, salts[0]) + salts[0] + salts[1]
        user_key = cipher.Aes(cipher.hardened(password, salts[1])).encrypted(key, bytes(16))
        entry = f"/V 5/R 6/Length 256/UE<{user_key.hex()}>/CF<</StdCF<</CFM/AESV3/Length 32>>>>/StmF/StdCF/StrF/StdCF"
    else:
        n = 5 if kind == "rc40" else 16
        key = hashlib.md5(pad + owner + struct.pack("<i", PERMISSIONS) + ID).digest()
        if kind == "rc40":
            user, entry = cipher.rc4(key[:n], cipher.PADDING), "/V 1/R 2"
        else:
            for _ in range(50):
                key = hashlib.md5(key[:n]).digest()
            user = hashlib.md5(cipher.PADDING + ID).digest()
            for i in range(20):
                user = cipher.rc4(bytes(b ^ i for b in key), user)
            user += bytes(16)
            entry = "/V 4/R 4/Length 128/CF<</StdCF<</CFM/AESV2/Length 16>>>>/StmF/StdCF/StrF/StdCF" if kind == "aes128" else "/V 2/R 3/Length 128"
        key = key[:n]

    def enciphered(m: re.Match) -> bytes:
        number, raw = int(m[1]), m[3]
        if kind == "aes256":
            own = key
        else:
            own = hashlib.md5(key + struct.pack("<I", number)[:3] + b"\0\0" + (b"sAlT" if kind == "aes128" else b"")).digest()[: min(16, len(key) + 5)]
        if kind.startswith("aes"):
            fill = 16 - len(raw) % 16
            raw = ID + cipher.Aes(own).encrypted(raw + bytes([fill]) * fill, ID)
        else:
            raw = cipher.rc4(own, raw)
        return b"%d 0 obj\n%s/Length %d>>\nstream\n%s\nendstream" % (number, re.sub(rb"/Length \d+>>\Z", b"", m[2]), len(raw), raw)

    content = re.sub(rb"(\d+) 0 obj\n(<<[^\n]*>>)\nstream\n(.*?)\nendstream", enciphered, content, flags=re.S)
    head, tail = content.split(b"trailer\n<<")
    entry = f"<</Filter/Standard/P {PERMISSIONS}/O<{owner.hex()}>/U<{user.hex()}>{entry}>>"
    return head + f"99 0 obj\n{entry}\nendobj\ntrailer\n<</ID[<{ID.hex()}><{ID.hex()}>]/Encrypt 99 0 R".encode() + tail


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("kind", ["rc40", "rc128", "aes128", "aes256"])
def test_files_that_open_without_a_password(kind, packed):
    content = s.pdf([s.text_at(50, 700, "Only the owner may print this")], packed=packed)
    assert text_of(protected(content, kind)) == "Only the owner may print this"
    with pytest.raises(Failure) as failure:
        pdf.extract(protected(content, kind, b"secret"), Limits())
    assert failure.value.code == "PASSWORD_PROTECTED"


def test_damaged_protection_is_a_code():
    content = s.pdf([s.text_at(50, 700, "x")])
    for entry in (b"<<>>", b"<</V 4/R 4/Filter/Standard>>", b"<</V 5/R 6/U(short)/Filter/Standard>>", b"<</V 9/Filter/Own>>"):
        broken = content.replace(b"trailer\n<<", b"99 0 obj\n" + entry + b"\nendobj\ntrailer\n<</Encrypt 99 0 R")
        with pytest.raises(Failure) as failure:
            pdf.extract(broken, Limits())
        assert failure.value.code == "PASSWORD_PROTECTED"


def test_published_vectors():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert cipher.Aes(bytes(range(16))).encrypted(plain, bytes(16)).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert cipher.Aes(bytes(range(32))).encrypted(plain, bytes(16)).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert cipher.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    data = bytes(i * 7 & 255 for i in range(16 * 9))
    for n in (16, 24, 32):
        assert cipher.Aes(bytes(n)).decrypted(cipher.Aes(bytes(n)).encrypted(data, ID), ID) == data


def stream(body: bytes, entries: bytes = b"") -> bytes:
    return b"<<%s/Length %d>>\nstream\n%s\nendstream" % (entries, len(body), body)


def test_the_last_definition_of_an_object_counts():
    content = s.pdf([s.text_at(50, 700, "old words")])
    number = int(re.search(rb"/Contents (\d+) 0 R", content)[1])
    new = s.text_at(50, 700, "new words").encode()
    updated = content + b"\n%d 0 obj\n%s\nendobj\ntrailer\n<</Root 1 0 R>>" % (number, stream(new))
    assert text_of(updated) == "new words"
    # the same, with the page in an object stream that comes later
    page = re.search(rb"(\d+) 0 obj\n(<</Type/Page/.*?)\nendobj", content, re.S)
    inner = page[2].replace(b"/Contents %d 0 R" % number, b"/Contents 80 0 R")
    packed = zlib.compress(b"%d 0 %s" % (int(page[1]), inner))
    head = len(b"%d 0 " % int(page[1]))
    late = content + b"\n80 0 obj\n%s\nendobj\n81 0 obj\n%s\nendobj" % (stream(new), stream(packed, b"/Type/ObjStm/N 1/First %d/Filter/FlateDecode" % head))
    assert text_of(late) == "new words"
    # and an object stream that comes before does not count
    early = content[:9] + b"81 0 obj\n%s\nendobj\n" % stream(packed, b"/Type/ObjStm/N 1/First %d/Filter/FlateDecode" % head) + content[9:]
    assert text_of(early) == "old words"


def lzw(data: bytes) -> bytes:
    """Codes of nine bits only: the table is emptied before it grows further."""
    bits = ""
    for at in range(0, len(data), 100):
        bits += f"{256:09b}" + "".join(f"{b:09b}" for b in data[at : at + 100])
    bits += f"{257:09b}"
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def test_less_common_filters():
    words = s.text_at(50, 700, "aaaa bbbb " * 30)
    assert pdf.unpacked_lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 1, 1000) == b"-----A---B"
    runs = b"".join(bytes([len(words[i : i + 100]) - 1]) + words[i : i + 100].encode() for i in range(0, len(words), 100)) + b"\x80"
    content = s.pdf([s.text_at(50, 700, "plain")])
    number = int(re.search(rb"/Contents (\d+) 0 R", content)[1])
    for body, name in ((lzw(words.encode()), b"LZWDecode"), (runs, b"RunLengthDecode")):
        made = content + b"\n%d 0 obj\n%s\nendobj" % (number, stream(body, b"/Filter/" + name))
        assert text_of(made).strip() == ("aaaa bbbb " * 30).strip()
    with pytest.raises(Failure):
        pdf.unpacked_runs(bytes([129, 65]) * 100, 50)
    with pytest.raises(ValueError):
        pdf.unpacked_lzw(bytes([0xFF] * 9), 1, 100)


def test_images_that_pass_as_they_are():
    image = b"/Type/XObject/Subtype/Image/Width 8/Height 4/BitsPerComponent 1/ColorSpace/DeviceGray"
    content = s.pdf(["q 60 0 0 80 0 0 cm /I Do Q"], {"I": (1, 1, b"\0")})
    number = int(re.search(rb"/I (\d+) 0 R", content)[1])
    for body, entries, ext, begins in ((b"\0\0\0\x0cjP  ", b"/Filter/JPXDecode", ".jp2", b"\0\0\0\x0cjP"), (b"codes", b"/Filter/CCITTFaxDecode/DecodeParms<</K -1/Columns 8>>", ".tiff", b"II*\0")):
        made = content + b"\n%d 0 obj\n%s\nendobj" % (number, stream(body, image + entries))
        (found,) = [i for i in pdf.extract(made, Limits()).items if i.kind == "image"]
        assert found.ext == ext and found.content.startswith(begins) and found.content.endswith(body)
    tags = struct.unpack_from("<H", found.content, 8)[0]
    entry = {struct.unpack_from("<H", found.content, 10 + 12 * i)[0]: struct.unpack_from("<I", found.content, 18 + 12 * i)[0] for i in range(tags)}
    assert (entry[256], entry[257], entry[259], found.content[entry[273] :], entry[279]) == (8, 4, 4, b"codes", 5)


def test_fonts_whose_codes_are_utf16():
    content = s.pdf([s.text_at(50, 700, "x")])
    number = int(re.search(rb"/Contents (\d+) 0 R", content)[1])
    font = int(re.search(rb"/F1 (\d+) 0 R", content)[1])
    made = content + b"\n%d 0 obj\n<</Type/Font/Subtype/Type0/Encoding/UniJIS-UTF16-H>>\nendobj\n%d 0 obj\n%s\nendobj" % (font, number, stream(b"BT /F1 12 Tf 50 700 Td <65e5672c> Tj ET"))
    assert text_of(made) == "日本"
