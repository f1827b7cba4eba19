"""Small helpers on one text, shared by the operators: words, rolling hashes, bounded Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

# Rows and bytes that one Arrow batch may hold, so that long texts do not pile up in a Python worker.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

# Bytes to words: A-Z are lower-cased, other ASCII but 0-9 and a-z separates, bytes over 0x7F stay.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def bound_batches(spark: SparkSession) -> None:
    """Cap the Arrow batches of this session, unless somebody has set them lower already."""
    for key, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        try:
            now = int(spark.conf.get(name))
        except Exception:  # noqa: BLE001 a Spark without this setting
            continue
        if now <= 0 or now > bound:
            spark.conf.set(name, str(bound))


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column has it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2^64, from which the hash of any slice follows."""
    up, _ = _pow(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=out[1:])
    return out


def slices(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the slices starts..ends; equal slices hash alike wherever they stand."""
    _, down = _pow(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k codes."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = _pow(n)
    return mix((sums[k:] - sums[:n]) * down + np.uint64(k))


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def shingles(tokens: list[bytes], k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; a shorter text is one run; no words, none."""
    if not tokens:
        return np.zeros(0, np.uint64)
    line = np.frombuffer(b" ".join(tokens), np.uint8)
    gaps = np.flatnonzero(line == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(line)]])
    k = min(k, len(tokens))
    return np.unique(slices(prefix_sums(line), starts[: len(starts) - k + 1], ends[k - 1 :]))
