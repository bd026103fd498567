"""Numeric buckets with readable labels, for a wanted number of rows."""

from __future__ import annotations

from math import floor

# Response times in milliseconds.
ELAPSED_BOUNDS = (
    1, 2, 3, 5, 7, 10, 15, 20, 30, 50, 70, 100,
    150, 200, 300, 500, 700, 1000,
    1500, 2000, 3000, 5000, 7000, 10000,
    15000, 20000, 30000, 60000,
)
# Requests per rate-limit window.
RATE_BOUNDS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000)
# Fixed rule: 1/2/5 steps from 10 B to 100 MB.
SIZE_BOUNDS = tuple(m * 10**e for e in range(1, 9) for m in (1, 2, 5) if m * 10**e <= 100_000_000)


def pick_evenly(bounds: tuple[int, ...], n: int) -> list[int]:
    """``n`` of the bounds, first and last included, halves rounded up."""
    last = len(bounds) - 1
    if n > last:
        return list(bounds)
    if n <= 1:
        return [bounds[last]]
    return [bounds[floor(i * last / (n - 1) + 0.5)] for i in range(n)]


def _shorten(x: float) -> str:
    return f"{x:g}"


def size_label(n: int) -> str:
    for unit, scale in (("MB", 1_000_000), ("KB", 1_000)):
        if n >= scale:
            return f"{_shorten(n / scale)} {unit}"
    return f"{n} B" if n else "0"


def elapsed_label(ms: int) -> str:
    return f"{ms}ms" if ms < 1000 else f"{_shorten(round(ms / 1000, 1))}s"


def _spans(bounds: list[int], label) -> list[str]:
    return [f"{label(a)}-{label(b)}" for a, b in zip(bounds, bounds[1:])]


def _case(bounds: list[int], labels: list[str], column: str, first: str = "") -> str:
    """A NULL number has no label."""
    whens = " ".join(f"WHEN {column} < {b} THEN '{text}'" for b, text in zip(bounds, labels))
    return f"CASE WHEN {column} IS NULL THEN NULL {first}{whens} ELSE '{labels[-1]}' END"


def size_labels(rows: int) -> list[str]:
    bounds = pick_evenly(SIZE_BOUNDS, max(1, rows - 2))
    head = ["0 (empty)", f"1 B-{size_label(bounds[0])}"]
    return head + _spans(bounds, size_label) + [f"≥ {size_label(bounds[-1])}"]


def size_buckets(rows: int, column: str) -> str:
    labels = size_labels(rows)
    empty = f"WHEN {column} = 0 THEN '{labels[0]}' "
    return _case(pick_evenly(SIZE_BOUNDS, max(1, rows - 2)), labels[1:], column, empty)


def elapsed_labels(rows: int) -> list[str]:
    bounds = pick_evenly(ELAPSED_BOUNDS, max(1, rows - 1))
    return [f"< {elapsed_label(bounds[0])}", *_spans(bounds, elapsed_label),
            f"≥ {elapsed_label(bounds[-1])}"]


def elapsed_buckets(rows: int, column: str) -> str:
    return _case(pick_evenly(ELAPSED_BOUNDS, max(1, rows - 1)), elapsed_labels(rows), column)


def rate_labels(rows: int) -> list[str]:
    """The last label reads "more than" though the bucket starts at its bound."""
    bounds = pick_evenly(RATE_BOUNDS, max(1, rows - 1))
    return [f"< {bounds[0]}", *_spans(bounds, str), f"> {bounds[-1]}"]


def rate_buckets(rows: int, column: str) -> str:
    return _case(pick_evenly(RATE_BOUNDS, max(1, rows - 1)), rate_labels(rows), column)
