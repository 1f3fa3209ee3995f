"""Words and word shingles of a text as hashes, computed with numpy inside tasks."""

from __future__ import annotations

import re
import secrets
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

U = np.uint64
#: Bytes that are split at a time; bounds the memory for very long texts.
BLOCK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
#: Starts and multipliers of the two hashes of a word.
SEEDS, ODD = (0x243F6A8885A308D3, 0x13198A2E03707344), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
SHINGLE_WORDS = 5
#: Longer words are hashed one by one.
LONG = 64
FENCE = np.ones(1, bool)
BLANK = re.compile(rb"[\x20\x09-\x0D]")
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Keeps the first bytes of eight.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _stretches(data: bytes) -> Iterator[bytes]:
    """The data in stretches of about BLOCK_BYTES that end with a word."""
    at = 0
    while at < len(data):
        blank = BLANK.search(data, at + BLOCK_BYTES)
        end = blank.start() if blank else len(data)
        yield data[at:end]
        at = end


def new_key() -> int:
    """A secret key for one run. Who doesn't know it can't write words whose hashes agree; tasks get it with their code, so retries agree."""
    return secrets.randbits(64)


def _of_block(block: bytes, lanes: int, key: int) -> np.ndarray:
    """The first `lanes` hashes of each word under a key, eight bytes at a time.

    A step adds eight bytes to what has been mixed so far and mixes again, so that words of one length up to eight bytes
    never collide, and longer ones have no structure (as a polynomial has) in which different words agree. Words over
    LONG bytes are hashed by BLAKE2b. Under a secret key that holds for words made to collide too: the state is unknown.
    """
    data = np.frombuffer(block, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate((FENCE, IS_BLANK[data], FENCE)).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    eight = np.ndarray((len(data) + 1,), "<u8", block + bytes(8), 0, (1,))  # the eight bytes from each place on
    out = np.empty((lanes, len(starts)), U)
    first = eight[starts] & MASKS[np.minimum(size, 8)]
    for k in range(lanes):
        out[k] = mix((mix(size.astype(U) * U(ODD[k]) + U(SEEDS[k] ^ key)) ^ first) * U(ODD[k]))
    live = np.flatnonzero(size > 8)
    for step in range(8, LONG, 8):
        if not len(live):
            break
        part = eight[starts[live] + step] & MASKS[np.minimum(size[live] - step, 8)]
        for k in range(lanes):
            out[k, live] = mix((out[k, live] ^ part) * U(ODD[k]))
        live = live[size[live] > step + 8]
    for i in live.tolist():
        out[:, i] = np.frombuffer(blake2b(block[starts[i] : ends[i]], digest_size=16, key=key.to_bytes(8, "little")).digest(), U)[:lanes]
    return out


def word_digests(text: str | None, lanes: int = 2, key: int = 0) -> np.ndarray:
    """A row for each of up to two independent 64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, in order."""
    if not text:
        return np.empty((lanes, 0), U)
    parts = [_of_block(part, lanes, key) for part in _stretches(text.encode().lower())]
    return parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)


def word_hashes(text: str | None, key: int = 0) -> np.ndarray:
    """The first of the two hashes of each word."""
    return word_digests(text, 1, key)[0]


def chain(rows: np.ndarray, n: int) -> np.ndarray:
    """A hash of each row's first n values, in order."""
    h = mix(rows[:, 0] + U(n))
    for j in range(1, n):
        h = mix(h * U(BASE) + rows[:, j])
    return h


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, in order; none where there are fewer words."""
    if len(words) < n:
        return np.empty(0, U)
    return chain(np.lib.stride_tricks.sliding_window_view(words, n), n)


def _set_of(words: np.ndarray, n: int) -> np.ndarray:
    return np.unique(ngrams(words, min(n, len(words)))) if len(words) else np.empty(0, U)


def shingle_set(text: str | None, n: int = SHINGLE_WORDS, key: int = 0) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; the whole sequence where there are fewer; none without words."""
    return _set_of(word_hashes(text, key), n)


def shingle_set_and_print(text: str | None, key: int, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, int, bytes | None]:
    """The shingle set without a key, which is the same in every run; its size under the key; and a 128-bit digest of both sets, whatever their size."""
    plain, keyed = shingle_set(text, n), shingle_set(text, n, key)
    return plain, len(keyed), blake2b(keyed.tobytes() + plain.tobytes(), digest_size=16).digest() if len(plain) else None
