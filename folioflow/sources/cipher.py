"""The ciphers of PDF files, for documents that open without a password (ISO 32000-2, section 7.6; FIPS 197).

Only what the standard's library lacks is here: RC4, and AES in CBC mode. Many blocks are deciphered at once,
as no block of CBC needs the plain text of another one.
"""

from __future__ import annotations

import functools
import hashlib
import struct

import numpy as np

#: Fixed value: what fills up a password.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, byte in enumerate(data):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        b = s[j]
        s[i], s[j] = b, a
        out[n] = byte ^ s[(a + b) & 255]
    return bytes(out)


def times(a: int, b: int) -> int:
    """The product of two bytes in the field of AES."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@functools.cache
def substitution() -> tuple[list[int], list[int]]:
    """The table of AES (the inverse in the field, then an affine map) and its inverse."""
    power = [1]  # of the generator 3
    for _ in range(254):
        power.append(times(power[-1], 3))
    inverse = {x: power[-i % 255] for i, x in enumerate(power)} | {0: 0}
    turned = lambda x, n: (x << n | x >> (8 - n)) & 255
    forth = [0x63 ^ functools.reduce(lambda acc, n: acc ^ turned(inverse[x], n), range(5), 0) for x in range(256)]
    back = [0] * 256
    for x, y in enumerate(forth):
        back[y] = x
    return forth, back


@functools.cache
def mixed() -> tuple[list[int], ...]:
    """For each row of a column, what a byte there contributes to the whole column after substitution and mixing."""
    forth = substitution()[0]
    first = [times(y, 2) << 24 | y << 16 | y << 8 | times(y, 3) for y in forth]
    return tuple([(x >> 8 * r | x << (32 - 8 * r)) & 0xFFFFFFFF for x in first] for r in range(4))


class Aes:
    def __init__(self, key: bytes):
        forth, n = substitution()[0], len(key) // 4
        self.rounds = n + 6
        words, constant = [key[i : i + 4] for i in range(0, len(key), 4)], 1
        for i in range(n, 4 * (self.rounds + 1)):
            w = words[-1]
            if i % n == 0:
                w = bytes([forth[w[1]] ^ constant, forth[w[2]], forth[w[3]], forth[w[0]]])
                constant = times(constant, 2)
            elif n > 6 and i % n == 4:
                w = bytes(forth[x] for x in w)
            words.append(bytes(a ^ b for a, b in zip(words[i - n], w, strict=True)))
        self.words = [int.from_bytes(w, "big") for w in words]
        self.keys = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, 16)

    def encrypted(self, data: bytes, iv: bytes) -> bytes:
        """CBC over whole blocks."""
        forth, (t0, t1, t2, t3), words, out = substitution()[0], mixed(), self.words, bytearray()
        state = struct.unpack(">4I", iv)
        for at in range(0, len(data), 16):
            s = [a ^ b ^ c for a, b, c in zip(state, struct.unpack_from(">4I", data, at), words, strict=False)]
            for k in range(4, 4 * self.rounds, 4):
                s = [t0[s[c] >> 24] ^ t1[s[c - 3] >> 16 & 255] ^ t2[s[c - 2] >> 8 & 255] ^ t3[s[c - 1] & 255] ^ words[k + c] for c in range(4)]
            k = 4 * self.rounds
            state = [(forth[s[c] >> 24] << 24 | forth[s[c - 3] >> 16 & 255] << 16 | forth[s[c - 2] >> 8 & 255] << 8 | forth[s[c - 1] & 255]) ^ words[k + c] for c in range(4)]
            out += struct.pack(">4I", *state)
        return bytes(out)

    def decrypted(self, data: bytes, iv: bytes) -> bytes:
        """CBC over whole blocks, all at once."""
        blocks = np.frombuffer(data, dtype=np.uint8).reshape(-1, 16)
        back = np.array(substitution()[1], dtype=np.uint8)
        rows = np.array([(r + 4 * ((c - r) % 4)) for c in range(4) for r in range(4)])
        by = {m: np.array([times(x, m) for x in range(256)], dtype=np.uint8) for m in (9, 11, 13, 14)}
        s = blocks ^ self.keys[self.rounds]
        for k in range(self.rounds - 1, -1, -1):
            s = back[s[:, rows]] ^ self.keys[k]
            if k:
                c = s.reshape(-1, 4, 4)
                around = [np.roll(c, -r, axis=2) for r in range(4)]
                s = (by[14][around[0]] ^ by[11][around[1]] ^ by[13][around[2]] ^ by[9][around[3]]).reshape(-1, 16)
        return (s ^ np.concatenate([np.frombuffer(iv, dtype=np.uint8).reshape(1, 16), blocks[:-1]])).tobytes()


def hardened(password: bytes, salt: bytes) -> bytes:
    """The hash of revision 6."""
    k, i = hashlib.sha256(password + salt).digest(), 0
    while True:
        e = Aes(k[:16]).encrypted((password + k) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Cipher:
    """Deciphers the streams of a file that opens with an empty user password."""

    def __init__(self, key: bytes, method: str):
        self.key, self.method = key, method

    def stream(self, raw: bytes, number: int, generation: int) -> bytes:
        if self.method == "Identity":
            return raw
        if self.method == "AESV3":
            key = self.key
        else:
            salt = struct.pack("<I", number)[:3] + struct.pack("<I", generation)[:2] + (b"sAlT" if self.method == "AESV2" else b"")
            key = hashlib.md5(self.key + salt).digest()[: min(16, len(self.key) + 5)]
        if self.method == "V2":
            return rc4(key, raw)
        whole = len(raw) // 16 * 16
        if whole < 32:
            return b""
        plain = Aes(key).decrypted(raw[16:whole], raw[:16])
        return plain[: -plain[-1]] if 1 <= plain[-1] <= 16 else plain


def opened(version: int, revision: int, length: int, owner: bytes, user: bytes, permissions: int, identifier: bytes, method: str, whole: bool = True, user_key: bytes = b"") -> Cipher | None:
    """The cipher of a file, from its encryption dictionary; None if an empty password does not open it."""
    if version >= 5:
        check = hardened if revision >= 6 else lambda password, salt: hashlib.sha256(password + salt).digest()
        if check(b"", user[32:40]) != user[:32]:
            return None
        return Cipher(Aes(check(b"", user[40:48])).decrypted(user_key[:32], bytes(16)), method)
    n = length // 8 if revision >= 3 else 5
    key = hashlib.md5(PADDING + owner[:32] + struct.pack("<I", permissions & 0xFFFFFFFF) + identifier + (b"" if whole or revision < 4 else b"\xff" * 4)).digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key[:n]).digest()
    key = key[:n]
    if revision == 2:
        fits = rc4(key, PADDING) == user[:32]
    else:
        x = hashlib.md5(PADDING + identifier).digest()
        for i in range(20):
            x = rc4(bytes(b ^ i for b in key), x)
        fits = x == user[:16]
    return Cipher(key, method) if fits else None
