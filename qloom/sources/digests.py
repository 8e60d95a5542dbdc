"""SHA-256 and SHA-1 of one text of bytes, carried on from task to task."""

from __future__ import annotations

import _hashlib
import ctypes
import hashlib

# The states are plain structures of fixed size (SHA256_CTX, SHA_CTX); hashlib keeps its own to itself.
_STATES = {"SHA256": 112, "SHA1": 96}


def _functions() -> dict:
    """OpenSSL's functions out of the library that Python itself uses, where it shows them."""
    found = {}
    for kind in _STATES:
        for step, more in (("Init", 0), ("Update", 2), ("Final", 1)):
            function = getattr(ctypes.CDLL(_hashlib.__file__), f"{kind}_{step}")
            function.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t][: 1 + more]
            found[kind, step] = function
    return found


class Digests:
    """Both hashes of what was added, here or before ``state`` was taken."""

    def __init__(self, state: bytes | None = None) -> None:
        self.functions, at = _functions(), 0
        self.states = {}
        for kind, size in _STATES.items():
            self.states[kind] = ctypes.create_string_buffer(state[at : at + size] if state else size, size)
            at += size
            if state is None:
                self.functions[kind, "Init"](self.states[kind])

    def add(self, address: int, size: int) -> None:
        for kind, state in self.states.items():
            self.functions[kind, "Update"](state, address, size)

    def add_bytes(self, data: bytes) -> None:
        self.add(ctypes.cast(ctypes.c_char_p(data), ctypes.c_void_p).value, len(data))

    def state(self) -> bytes:
        return b"".join(state.raw for state in self.states.values())

    def hexdigests(self) -> tuple[str, str]:
        """(SHA-256, SHA-1); the state stays as it is."""
        out = []
        for kind, size in (("SHA256", 32), ("SHA1", 20)):
            digest, copy = ctypes.create_string_buffer(size), ctypes.create_string_buffer(self.states[kind].raw)
            # Final takes the digest first.
            self.functions[kind, "Final"](digest, ctypes.addressof(copy))
            out.append(digest.raw.hex())
        return out[0], out[1]


class WholeDigests:
    """The same where no state can be taken, for bytes that one task adds."""

    def __init__(self) -> None:
        self.hashes = hashlib.sha256(), hashlib.sha1()

    def add(self, address: int, size: int) -> None:
        data = memoryview((ctypes.c_char * size).from_address(address)) if size else b""
        for h in self.hashes:
            h.update(data)

    def add_bytes(self, data: bytes) -> None:
        for h in self.hashes:
            h.update(data)

    def state(self) -> bytes:
        return b""

    def hexdigests(self) -> tuple[str, str]:
        sha256, sha1 = (h.hexdigest() for h in self.hashes)
        return sha256, sha1


def can_carry() -> bool:
    """Whether states can be carried on here: a text in two parts has the hashes of the whole."""
    try:
        first = Digests()
        first.add_bytes(b"a" * 100)
        second = Digests(first.state())
        second.add_bytes(b"b" * 77)
        whole = b"a" * 100 + b"b" * 77
        return second.hexdigests() == (hashlib.sha256(whole).hexdigest(), hashlib.sha1(whole).hexdigest())
    except (OSError, AttributeError):
        return False
