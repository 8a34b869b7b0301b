"""Token ids of whole texts, with a cache of white-space separated chunks.

White space only separates in this vocabulary, so the ids of a text are the
ids of its chunks in a row. Chunks repeat a lot; each worker keeps a bounded
cache of them, in two halves: when the younger one is full it becomes the
older one, and chunks met again come back from there, so common ones stay. A
chunk is kept from the second time on: most rare ones never come again, and a
table of marks by hash, wiped from time to time, tells which were met before.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from struct import pack

import public_tokenizers
import regex
from tokenizers import Tokenizer

# Chunks a worker remembers, and the bytes of the longest of them.
CACHED_CHUNKS, CACHED_BYTES = 300_000, 64
# Places for marks, and how many are set before they are wiped.
MARKS, MARKED = 1 << 21, 1 << 19
# Chunks of a long text that are looked up together.
STRETCH = 10_000

# The pattern by which the vocabulary splits a chunk, in full and for printable ASCII.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPLIT_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

_PLAIN = re.compile(rb"[!-~]+")
_LATIN = re.compile("[!-~¡-¬®-ɏ]+")


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in a byte-level vocabulary:
    printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + n) for n, b in enumerate(others)}


_LETTERS = _byte_letters()


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Callable[[str], bytes]:
    """Text -> its ids as little-endian unsigned 32-bit numbers; special
    tokens are never added. `vocabulary` names a file of the tokenizers."""
    whole = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    model = whole.model
    cache: dict[bytes, bytes] = {}
    older: dict[bytes, bytes] = {}
    met = bytearray(MARKS)
    marked = 0

    def ids_of(part: str) -> bytes:
        ids = [token.id for token in model.tokenize(part)]
        return pack(f"<{len(ids)}I", *ids)

    def known(raw: bytes, make: Callable[[bytes], bytes]) -> bytes:
        nonlocal cache, older, met, marked
        found = cache.get(raw)
        if found is None:
            found = older.get(raw)
            if found is None:
                found = make(raw)
                mark = hash(raw) % MARKS
                if not met[mark]:
                    if marked >= MARKED:
                        met, marked = bytearray(MARKS), 0
                    met[mark], marked = 1, marked + 1
                    return found
            if len(raw) <= CACHED_BYTES:
                if len(cache) >= CACHED_CHUNKS // 2:
                    cache, older = {}, cache
                cache[raw] = found
        return found

    def plain(part: bytes) -> bytes:
        return ids_of(part.decode())

    def chunk(raw: bytes) -> bytes:
        if raw.isalpha():
            return ids_of(raw.lower().decode())
        if _PLAIN.fullmatch(raw):
            return b"".join([known(part, plain) for part in SPLIT_ASCII.findall(raw.lower())])
        text = raw.decode()
        if _LATIN.fullmatch(text):
            parts = SPLIT.findall(unicodedata.normalize("NFC", text).lower())
            return b"".join([ids_of(part.encode().decode("latin-1").translate(_LETTERS)) for part in parts])
        ids = whole.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def encode(text: str) -> bytes:
        raw = text.encode("utf-8", "replace")
        if b"<|" in raw:  # may hold the name of a special token
            ids = whole.encode(raw.decode(), add_special_tokens=False).ids
            return pack(f"<{len(ids)}I", *ids)
        chunks = (raw.lower() if raw.isascii() else raw).split()
        return b"".join([ids_of_chunks(chunks[at : at + STRETCH]) for at in range(0, len(chunks), STRETCH)])

    def ids_of_chunks(chunks: list[bytes]) -> bytes:
        found = list(map(cache.get, chunks))
        if None in found:
            found = [known(raw, chunk) if ids is None else ids for raw, ids in zip(chunks, found, strict=True)]
        return b"".join(found)

    return encode
