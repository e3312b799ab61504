"""The standard security handler: keys from passwords, RC4 and AES-128, strings and streams of objects.

AES works on all blocks of a message at once where it can (decryption does not wait for
the block before). Its tables are computed from the field that defines them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np

from folioframe.functions.cos import Hex, ParseError, Ref, Stream

# The padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class Locked(ParseError):
    """A file that is encrypted in a way, or under a password, that is not known."""


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + state[i]) & 255
        state[i], state[j] = state[j], state[i]
        out.append(c ^ state[(state[i] + state[j]) & 255])
    return bytes(out)


# ---- AES-128 ----


def _times(a: int, b: int) -> int:
    """The product in the field of AES."""
    out = 0
    while b:
        out ^= a * (b & 1)
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _substitution() -> np.ndarray:
    box = np.zeros(256, np.uint8)
    for x in range(256):
        inverse = 1
        for _ in range(254):
            inverse = _times(inverse, x)  # x^254 is the inverse, and 0 that of 0
        wide = inverse | inverse << 8
        box[x] = (inverse ^ wide >> 4 ^ wide >> 5 ^ wide >> 6 ^ wide >> 7 ^ 0x63) & 0xFF
    return box


class _Tables:
    """Made on first use."""

    def __init__(self) -> None:
        self.box = _substitution()
        self.back = np.argsort(self.box).astype(np.uint8)
        self.times = {n: np.array([_times(x, n) for x in range(256)], np.uint8) for n in (1, 2, 3, 9, 11, 13, 14)}
        self.rows = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])  # where each byte comes from when rows shift
        self.rows_back = np.argsort(self.rows)


_made: list[_Tables] = []


def _tables() -> _Tables:
    if not _made:
        _made.append(_Tables())
    return _made[0]


def _round_keys(key: bytes) -> np.ndarray:
    t, words, factor = _tables(), [list(key[i : i + 4]) for i in range(0, 16, 4)], 1
    for i in range(4, 44):
        word = words[-1]
        if i % 4 == 0:
            word = [int(t.box[b]) for b in word[1:] + word[:1]]
            word[0] ^= factor
            factor = _times(factor, 2)
        words.append([a ^ b for a, b in zip(words[-4], word, strict=True)])
    return np.array(words, np.uint8).reshape(11, 16)


def _mixed(blocks: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    times, columns = _tables().times, blocks.reshape(-1, 4, 4)
    out = np.zeros_like(columns)
    for row in range(4):
        for j in range(4):
            out[:, :, row] ^= times[factors[(j - row) % 4]][columns[:, :, j]]
    return out.reshape(-1, 16)


def _decrypted_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    t, keys = _tables(), _round_keys(key)
    x = blocks ^ keys[10]
    for n in range(9, -1, -1):
        x = t.back[x[:, t.rows_back]] ^ keys[n]
        if n:
            x = _mixed(x, (14, 11, 13, 9))
    return x


def _encrypted_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    t, keys = _tables(), _round_keys(key)
    x = blocks ^ keys[0]
    for n in range(1, 11):
        x = t.box[x][:, t.rows]
        if n < 10:
            x = _mixed(x, (2, 3, 1, 1))
        x = x ^ keys[n]
    return x


def aes_decrypt(key: bytes, data: bytes) -> bytes:
    """CBC with the initial vector in front; padding that is none stays."""
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    if len(blocks) < 2:
        return b""
    out = (_decrypted_blocks(key, blocks[1:]) ^ blocks[:-1]).tobytes()
    return out[: -out[-1]] if 1 <= out[-1] <= 16 and out.endswith(bytes([out[-1]]) * out[-1]) else out


def aes_encrypt(key: bytes, data: bytes) -> bytes:
    """CBC with the initial vector in front, which follows from key and data."""
    vector = hashlib.md5(key + data).digest()
    padded = data + bytes([16 - len(data) % 16]) * (16 - len(data) % 16)
    out, before = [vector], np.frombuffer(vector, np.uint8)
    for block in np.frombuffer(padded, np.uint8).reshape(-1, 16):
        before = _encrypted_blocks(key, (block ^ before).reshape(1, 16))[0]
        out.append(before.tobytes())
    return b"".join(out)


# ---- keys ----


def file_key(password: bytes, owner: bytes, p: int, file_id: bytes, revision: int, length: int, metadata: bool = True) -> bytes:
    seed = (password + PAD)[:32] + owner[:32] + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id
    digest = hashlib.md5(seed + (b"" if metadata or revision < 4 else b"\xff" * 4)).digest()
    for _ in range(50 if revision >= 3 else 0):
        digest = hashlib.md5(digest[:length]).digest()
    return digest[:length]


def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    """``/U``; from revision 3 on of MD5(PAD, id), padded to 32 bytes (B9)."""
    if revision == 2:
        return rc4(key, PAD)
    value = rc4(key, hashlib.md5(PAD + file_id).digest())
    for i in range(1, 20):
        value = rc4(bytes(b ^ i for b in key), value)
    return value + bytes(16)


def _owner_key(password: bytes, revision: int, length: int) -> bytes:
    digest = hashlib.md5((password + PAD)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        digest = hashlib.md5(digest[:length]).digest()
    return digest[:length]


def owner_entry(owner_password: bytes, user_password: bytes, revision: int, length: int) -> bytes:
    key, value = _owner_key(owner_password, revision, length), (user_password + PAD)[:32]
    for i in range(20 if revision >= 3 else 1):
        value = rc4(bytes(b ^ i for b in key), value)
    return value


def authenticate(password: bytes, owner: bytes, user: bytes, p: int, file_id: bytes, revision: int, length: int, metadata: bool = True) -> tuple[str | None, bytes | None]:
    """``user`` or ``owner`` and the file key, or nothing."""
    for role in ("user", "owner"):
        word = password
        if role == "owner":
            key, word = _owner_key(password, revision, length), owner
            for i in reversed(range(20 if revision >= 3 else 1)):
                word = rc4(bytes(b ^ i for b in key), word)
        key = file_key(word, owner, p, file_id, revision, length, metadata)
        n = 32 if revision == 2 else 16
        if user_entry(key, file_id, revision)[:n] == user[:n]:
            return role, key
    return None, None


def object_key(key: bytes, num: int, gen: int, aes: bool = False) -> bytes:
    salted = key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if aes else b"")
    return hashlib.md5(salted).digest()[: min(16, len(key) + 5)]


# ---- objects ----


@dataclass(frozen=True)
class Crypt:
    """What encrypts the strings and streams of a file: ``V2`` (RC4), ``AESV2`` or ``Identity``."""

    key: bytes
    strings: str
    streams: str
    metadata: bool = True

    def _apply(self, method: str, ref: Ref, data: bytes, back: bool) -> bytes:
        if method == "V2":
            return rc4(object_key(self.key, *ref), data)
        if method == "AESV2":
            return (aes_decrypt if back else aes_encrypt)(object_key(self.key, *ref, True), data)
        return data

    def changed(self, ref: Ref, value: Any, back: bool) -> Any:
        """An object decrypted (``back``) or encrypted."""
        if isinstance(value, Stream):
            label, chain = value.dict.get("Type"), value.dict.get("Filter")
            if label == "XRef":
                return value
            own = "Identity" if label == "Metadata" and not self.metadata or chain == "Crypt" or isinstance(chain, list) and "Crypt" in chain else self.streams
            return Stream(self.changed(ref, value.dict, back), self._apply(own, ref, value.raw, back))
        if isinstance(value, bytes):
            return (Hex if isinstance(value, Hex) else bytes)(self._apply(self.strings, ref, bytes(value), back))
        if isinstance(value, dict):
            return {k: self.changed(ref, v, back) for k, v in value.items()}
        return [self.changed(ref, v, back) for v in value] if isinstance(value, list) else value


def handler(entry: Any, file_id: bytes, password: bytes, resolve: Callable[[Any], Any]) -> Crypt | None:
    """The handler that an encryption dictionary describes; None if the password is wrong or the handler is not known."""
    entry = resolve(entry)
    if not isinstance(entry, dict) or str(entry.get("Filter")) != "Standard":
        return None
    version, revision = resolve(entry.get("V", 0)), resolve(entry.get("R", 2))
    owner, user, p = (resolve(entry.get(k)) for k in ("O", "U", "P"))
    if version not in (1, 2, 4) or revision not in (2, 3, 4) or not isinstance(owner, bytes) or not isinstance(user, bytes) or not isinstance(p, int):
        return None
    metadata = resolve(entry.get("EncryptMetadata", True)) is not False
    length, methods = 16 if version == 4 else 5 if version == 1 else int(resolve(entry.get("Length", 40))) // 8, ("V2", "V2")
    if not 5 <= length <= 16:
        return None
    if version == 4:
        filters = resolve(entry.get("CF")) or {}

        def method(name: Any) -> str:
            found = resolve(filters.get(name)) if name != "Identity" else None
            return str(found.get("CFM", "None")) if isinstance(found, dict) else "Identity"

        methods = method(str(entry.get("StrF", "Identity"))), method(str(entry.get("StmF", "Identity")))
        if not set(methods) <= {"V2", "AESV2", "Identity", "None"}:
            return None
    _, key = authenticate(password, bytes(owner), bytes(user), p, file_id, revision, length, metadata)
    return Crypt(key, *methods, metadata) if key else None


def encryption(method: str, user_password: bytes, owner_password: bytes, p: int, file_id: bytes) -> tuple[Crypt, dict[str, Any]]:
    """A handler for new files, and its dictionary: ``RC4-40``, ``RC4-128`` or ``AES-128``."""
    from folioframe.functions.cos import Name

    version, revision, length = {"RC4-40": (1, 2, 5), "RC4-128": (2, 3, 16), "AES-128": (4, 4, 16)}[method]
    owner = owner_entry(owner_password, user_password, revision, length)
    key = file_key(user_password, owner, p, file_id, revision, length)
    head = {"Filter": Name("Standard"), "V": version, "R": revision, "Length": 8 * length, "P": p, "O": Hex(owner), "U": Hex(user_entry(key, file_id, revision))}
    own = "AESV2" if version == 4 else "V2"
    if version == 4:
        head |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "AuthEvent": Name("DocOpen"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    return Crypt(key, own, own), head
