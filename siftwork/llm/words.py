"""Word hashing over batches of texts, vectorised with numpy.

A word is a maximal run of bytes of one non-zero class in a 256-entry class table over the UTF-8 form, so a table fixes what
separates words. Hashes are 64-bit polynomial hashes taken from one prefix sum, independent of where a word stands, of the batch
and of the process. Texts are worked off in pieces of at most 128 KB that end between words, so memory does not follow a text's length.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

PIECE = 1 << 17
FACTOR = 0x9E3779B97F4A7C15
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_BYTES = np.arange(256, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F)


def byte_classes(**groups: str | range | list[int]) -> np.ndarray:
    """Class table: every byte is of class 1 unless a group ``c0``, ``c2``, ... names it."""
    table = np.ones(256, np.uint8)
    for name, members in groups.items():
        table[[ord(x) if isinstance(x, str) else x for x in members]] = int(name[1:])
    return table


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return run(FACTOR), run(pow(FACTOR, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit words over all their bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    hash: np.ndarray     # uint64
    size: np.ndarray     # bytes
    last: np.ndarray     # last byte, folded
    kind: np.ndarray     # class of the bytes
    upper: np.ndarray    # A-Z in the word
    lower: np.ndarray    # a-z in the word
    offsets: np.ndarray  # word range of text i: offsets[i]..offsets[i+1]
    prefix: tuple[np.ndarray, ...] = ()  # hashes of the first bytes, for each length asked for; 0 if the word isn't longer

    @property
    def text(self) -> np.ndarray:
        """Number of the text each word is from."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def _pieces(data: bytes, table: np.ndarray) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PIECE:
        window = table[np.frombuffer(data, np.uint8, PIECE, at)]
        cut = np.flatnonzero(window[1:] != window[:-1])
        if len(cut):
            end = at + int(cut[-1]) + 1
        else:  # one run longer than a piece
            rest = table[np.frombuffer(data, np.uint8, -1, at)]
            more = np.flatnonzero(rest != rest[0])
            end = at + int(more[0]) if len(more) else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def _hash_piece(data: bytes, table: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(data, np.uint8)
    kind = table[raw]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = np.concatenate([[0], edge])
    end = np.concatenate([edge, [len(raw)]])
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    n = PIECE + 1 if len(raw) <= PIECE else 1 << len(raw).bit_length()
    power, back = _powers(n)
    folded = FOLD[raw]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[folded] * power[: len(raw)], out=total[1:])
    count = np.zeros((2, len(raw) + 1), np.int32)
    np.cumsum((raw > 64) & (raw < 91), out=count[0, 1:])
    np.cumsum((raw > 96) & (raw < 123), out=count[1, 1:])
    tall = count[:, end] - count[:, start]
    heads = [np.where(end - start > n, mix((total[np.minimum(start + n, end)] - total[start]) * back[start] + np.uint64(n)), np.uint64(0)) for n in prefixes]
    return mix((total[end] - total[start]) * back[start]), (end - start).astype(np.int32), folded[end - 1], kind[start], tall[0], tall[1], *heads, start


def hash_words(texts: list[bytes | None], table: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """All words of each text. None has no words. The line feed must be of class 0."""
    parts: list[tuple[np.ndarray, ...]] = []
    counts = np.zeros(len(texts), np.int64)
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not group:
            return
        found = _hash_piece(b"\n".join(x for _, x in group), table, prefixes)
        ends = np.cumsum([len(x) + 1 for _, x in group])
        upto = np.searchsorted(found[-1], ends)
        np.add.at(counts, [i for i, _ in group], np.diff(upto, prepend=0))
        parts.append(found[:-1])
        group.clear()
        held = 0

    for i, text in enumerate(texts):
        for piece in _pieces(text, table) if text else ():
            if held + len(piece) > PIECE:
                flush()
            group.append((i, piece))
            held += len(piece) + 1
    flush()
    columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, t) for t in (np.uint64, np.int32, np.uint8, np.uint8, np.int32, np.int32, *[np.uint64] * len(prefixes))]
    return Words(*columns[:6], np.concatenate([[0], np.cumsum(counts)]), tuple(columns[6:]))


def column_bytes(batch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, without decoding."""
    import pyarrow as pa
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def in_sorted(keys: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Position of each probe in the sorted keys, -1 if absent."""
    if not len(keys):
        return np.full(len(probe), -1)
    at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
    return np.where(keys[at] == probe, at, -1)
