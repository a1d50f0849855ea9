"""Readable times, sizes and rates."""

from __future__ import annotations


def _scaled(value: float, units: list[tuple[float, str]]) -> str:
    for least, unit in units:
        if abs(value) >= least:
            return f"{value / least:.2f} {unit}"
    return f"{value / units[-1][0]:.2f} {units[-1][1]}"


def time_text(ns: float) -> str:
    return _scaled(ns, [(60e9, "min"), (1e9, "s"), (1e6, "ms"), (1e3, "us"), (1, "ns")])


def size_text(n_bytes: float) -> str:
    return _scaled(n_bytes, [(1e9, "GB"), (1e6, "MB"), (1e3, "KB"), (1, "B")])


def rate_text(n_bytes: float, ns: float) -> str:
    return size_text(n_bytes / ns * 1e9) + "/s" if ns else "-"


def threads_text(n: int) -> str:
    return "single-threaded" if n == 1 else f"using {n} threads"


def support_suffix(support: str) -> str:
    """The part of an index's file name that tells what it supports."""
    known = ("count", "locate_one", "locate_move", "locate_rlzsa")
    if support not in known:
        raise ValueError(f"support is one of {', '.join(known)}")
    return support
