"""The standard security handler of PDF files, for those that open without a password."""

from __future__ import annotations

import struct
from functools import cache
from hashlib import md5, sha256, sha384, sha512

#: Fixed value: what a short password is filled up with.
PADDING = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


class Locked(Exception):
    """The file needs a password, or a way of encryption that is not known."""


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = j + s[i] + key[i % len(key)] & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(data), 0, 0
    for k in range(len(out)):
        i = i + 1 & 255
        j = j + s[i] & 255
        s[i], s[j] = s[j], s[i]
        out[k] ^= s[s[i] + s[j] & 255]
    return bytes(out)


def _double(x: int) -> int:
    return x << 1 ^ (0x11B if x & 0x80 else 0)


def _product(x: int, y: int) -> int:
    out = 0
    while y:
        out ^= x * (y & 1)
        x, y = _double(x), y >> 1
    return out


@cache
def _boxes() -> tuple[bytes, bytes]:
    """Substitution: the inverse in the field of 256 elements, then an affine map; and the way back."""
    box = bytearray(256)
    for x in range(256):
        inverse = next((y for y in range(256) if _product(x, y) == 1), 0)
        turned = [(inverse << n | inverse >> 8 - n) & 255 for n in range(5)]
        box[x] = turned[0] ^ turned[1] ^ turned[2] ^ turned[3] ^ turned[4] ^ 0x63
    back = bytearray(256)
    for x, y in enumerate(box):
        back[y] = x
    return bytes(box), bytes(back)


@cache
def _products(y: int) -> bytes:
    return bytes(_product(x, y) for x in range(256))


class Aes:
    """AES in blocks of 16 bytes; a block is four columns of four bytes."""

    def __init__(self, key: bytes):
        box, _ = _boxes()
        n = len(key) // 4
        words = [key[4 * k : 4 * k + 4] for k in range(n)]
        turn = 1
        while len(words) < 4 * (n + 7):
            w = words[-1]
            if len(words) % n == 0:
                w = bytes([box[w[1]] ^ turn, box[w[2]], box[w[3]], box[w[0]]])
                turn = _double(turn)
            elif n > 6 and len(words) % n == 4:
                w = bytes(box[x] for x in w)
            words.append(bytes(a ^ b for a, b in zip(words[-n], w, strict=True)))
        self.rounds = [b"".join(words[k : k + 4]) for k in range(0, len(words), 4)]

    @staticmethod
    def _mixed(s: bytes, factors: tuple[int, int, int, int]) -> bytes:
        p, q, r, t = map(_products, factors)
        out = bytearray(16)
        for c in range(0, 16, 4):
            w, x, y, z = s[c : c + 4]
            out[c] = p[w] ^ q[x] ^ r[y] ^ t[z]
            out[c + 1] = t[w] ^ p[x] ^ q[y] ^ r[z]
            out[c + 2] = r[w] ^ t[x] ^ p[y] ^ q[z]
            out[c + 3] = q[w] ^ r[x] ^ t[y] ^ p[z]
        return bytes(out)

    @staticmethod
    def _added(a: bytes, b: bytes) -> bytes:
        return (int.from_bytes(a) ^ int.from_bytes(b)).to_bytes(16)

    def encrypt(self, block: bytes) -> bytes:
        box, _ = _boxes()
        s = self._added(block, self.rounds[0])
        for k in self.rounds[1:]:
            s = bytes(box[s[(i + 4 * (i % 4)) % 16]] for i in range(16))
            if k is not self.rounds[-1]:
                s = self._mixed(s, (2, 3, 1, 1))
            s = self._added(s, k)
        return s

    def decrypt(self, block: bytes) -> bytes:
        _, back = _boxes()
        s = self._added(block, self.rounds[-1])
        for k in self.rounds[-2::-1]:
            s = bytes(back[s[(i - 4 * (i % 4)) % 16]] for i in range(16))
            s = self._added(s, k)
            if k is not self.rounds[0]:
                s = self._mixed(s, (14, 11, 13, 9))
        return s


def cbc_decrypted(key: bytes, start: bytes, data: bytes) -> bytes:
    aes, out = Aes(key), []
    for k in range(0, len(data) - 15, 16):
        out.append(Aes._added(aes.decrypt(data[k : k + 16]), start))
        start = data[k : k + 16]
    return b"".join(out)


def cbc_encrypted(key: bytes, start: bytes, data: bytes) -> bytes:
    aes, out = Aes(key), []
    for k in range(0, len(data) - 15, 16):
        start = aes.encrypt(Aes._added(data[k : k + 16], start))
        out.append(start)
    return b"".join(out)


def _hash(password: bytes, salt: bytes, revision: int) -> bytes:
    """The hash of revisions 5 and 6, of a user's password."""
    k = sha256(password + salt).digest()
    if revision < 6:
        return k
    turn, last = 0, 0
    while turn < 64 or last > turn - 32:
        e = cbc_encrypted(k[:16], k[16:32], (password + k) * 64)
        k = (sha256, sha384, sha512)[sum(e[:16]) % 3](e).digest()
        last, turn = e[-1], turn + 1
    return k[:32]


class Handler:
    """Decrypts the streams of a file by its Encrypt entries (resolved) and the first part of its ID."""

    def __init__(self, entries: dict, file_id: bytes, password: bytes = b""):
        version, revision = entries.get("V", 0), entries.get("R", 0)
        if entries.get("Filter", "Standard") != "Standard" or version not in (1, 2, 4, 5):
            raise Locked
        self.method = "V2"
        if version >= 4:
            chosen = (entries.get("CF") or {}).get(entries.get("StmF", "Identity"))
            self.method = chosen.get("CFM", "None") if isinstance(chosen, dict) else "None"
        u = entries["U"]
        if version == 5:
            if _hash(password, u[32:40], revision) != u[:32]:
                raise Locked
            self.key = cbc_decrypted(_hash(password, u[40:48], revision), bytes(16), entries["UE"][:32])
            return
        n = 5 if version == 1 else 16 if version == 4 else entries.get("Length", 40) // 8
        more = b"\xff" * 4 if revision >= 4 and entries.get("EncryptMetadata") is False else b""
        padded = (password + PADDING)[:32]
        h = md5(padded + entries["O"][:32] + struct.pack("<I", entries["P"] & 0xFFFFFFFF) + file_id + more).digest()
        for _ in range(50 if revision >= 3 else 0):
            h = md5(h[:n]).digest()
        self.key = h[:n]
        if revision >= 3:
            proof = md5(PADDING + file_id).digest()
            for k in range(20):
                proof = rc4(bytes(x ^ k for x in self.key), proof)
            ok = proof == u[:16]
        else:
            ok = rc4(self.key, PADDING) == u[:32]
        if not ok:
            raise Locked

    def stream(self, number: int, generation: int, data: bytes) -> bytes:
        if self.method == "None":
            return data
        if self.method == "AESV3":
            key = self.key
        else:
            salt = b"sAlT" if self.method == "AESV2" else b""
            key = md5(self.key + struct.pack("<I", number)[:3] + struct.pack("<H", generation) + salt).digest()[: min(16, len(self.key) + 5)]
        if self.method == "V2":
            return rc4(key, data)
        out = cbc_decrypted(key, data[:16], data[16:])
        return out[: len(out) - out[-1]] if out and 0 < out[-1] <= 16 else out
