"""Words of a block of texts as arrays."""

from __future__ import annotations

from collections.abc import Iterator


def forget(*modules: str) -> None:
    """Gives back what earlier stages have left in this worker, which Spark uses again: encoders and indexes that the
    named modules of this package hold for the process, and memory that was freed but not returned."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    for name in modules:
        if (module := sys.modules.get(f"{__package__}.{name}")) is not None:
            module._loaded.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def hash_words(words: list[list[bytes]]):
    """A 64-bit hash of each word, all texts in a row, and the first position of each text (then the end)."""
    import numpy as np
    import xxhash

    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for ws in words for w in ws), np.int64, sum(map(len, words)))
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen))
    return table[codes], np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def mix(x):
    """A bijection of 64-bit integers that spreads them evenly."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def roll(h, n: int):
    """A hash of each n consecutive entries."""
    import numpy as np

    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
    return mix(out)


def chunks(batch, column: str = "__text", most: int = 1 << 22) -> Iterator:
    """Slices of a record batch with about ``most`` bytes of text each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield batch.slice(at)


def texts_of(batch, column: str = "__text") -> list[bytes]:
    return [(t.as_py() or "").encode() for t in batch.column(column)]
