"""XXH64 of many byte spans at once."""

from __future__ import annotations

import numpy as np

from retrace.llm.textbytes import U64, loads

# fixed values of the published hash function
P1 = U64(0x9E3779B185EBCA87)
P2 = U64(0xC2B2AE3D27D4EB4F)
P3 = U64(0x165667B19E3779F9)
P4 = U64(0x85EBCA77C2B2AE63)
P5 = U64(0x27D4EB2F165667C5)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def _lane(total, value):
    return _turn(total + value * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of `data[starts[i]:starts[i] + lengths[i]]`."""
    eight, seed = loads(data), U64(seed)
    out = np.full(len(starts), seed + P5, dtype=U64)
    with np.errstate(over="ignore"):
        long = np.flatnonzero(lengths >= 32)
        if len(long):
            at, stripes = starts[long], lengths[long] // 32
            total = [np.full(len(long), v, dtype=U64) for v in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            for step in range(int(stripes.max())):
                go = np.flatnonzero(stripes > step) if step else slice(None)
                for i in range(4):
                    total[i][go] = _lane(total[i][go], eight[at[go] + 32 * step + 8 * i])
            mix = _turn(total[0], 1) + _turn(total[1], 7) + _turn(total[2], 12) + _turn(total[3], 18)
            for part in total:
                mix = (mix ^ _lane(U64(0), part)) * P1 + P4
            out[long] = mix
        out += lengths.astype(U64)
        at, rest = starts + lengths // 32 * 32, lengths % 32
        for step in range(3):
            go = np.flatnonzero(rest >= 8 * (step + 1))
            out[go] = _turn(out[go] ^ _lane(U64(0), eight[at[go] + 8 * step]), 27) * P1 + P4
        at, rest = at + rest // 8 * 8, rest % 8
        go = np.flatnonzero(rest >= 4)
        out[go] = _turn(out[go] ^ ((eight[at[go]] & U64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at, rest = at + rest // 4 * 4, rest % 4
        for step in range(3):
            go = np.flatnonzero(rest > step)
            out[go] = _turn(out[go] ^ ((eight[at[go] + step] & U64(0xFF)) * P5), 11) * P1
        out = (out ^ (out >> U64(33))) * P2
        out = (out ^ (out >> U64(29))) * P3
        return out ^ (out >> U64(32))
