"""SuperMinHash signatures for many sets at once.

Each element has one random permutation of the registers (Fisher-Yates) and one fraction per step: at step j it
offers j + fraction to the register that the permutation has at j, and a register keeps the least offer. The ranks
of one element over the registers are a permutation, hence correlated, which lowers the variance of the estimate.
All elements take step j together; a set is done as soon as its worst register is below j, as later offers cannot win.
"""

from __future__ import annotations

import numpy as np

from hazeline.llm.spans import U64, mixed

_STEP = 0x9E3779B97F4A7C15
_FULL = U64(0xFFFFFFFFFFFFFFFF)


def _draw(elements: np.ndarray, step: int, choices: int) -> tuple[np.ndarray, np.ndarray]:
    """A choice in [0, choices) and a 32-bit fraction for each element at this step."""
    x = mixed(elements + U64(((step + 1) * _STEP) & 0xFFFFFFFFFFFFFFFF))
    return ((x >> U64(32)) * U64(choices) >> U64(32)).astype(np.int64), x & U64(0xFFFFFFFF)


def signatures(elements: np.ndarray, bounds: np.ndarray, registers: int) -> np.ndarray:
    """One row of registers for each set; sets without elements keep the largest value everywhere."""
    sets = len(bounds) - 1
    best = np.full((sets, registers), _FULL)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(sets), sizes)
    pick, part = _draw(elements, 0, registers)
    np.minimum.at(best.reshape(-1), owner * registers + pick, part)
    open_ = (best.max(axis=1) >= U64(1 << 32)) & (sizes > 0)
    keep = open_[owner]
    left, owner, pick = elements[keep], owner[keep], pick[keep]
    perm = np.tile(np.arange(registers, dtype=np.uint8 if registers <= 256 else np.int32), (len(left), 1))
    row = np.arange(len(left))
    perm[row, 0], perm[row, pick] = perm[row, pick], perm[row, 0].copy()
    for step in range(1, registers):
        if not len(left):
            break
        pick, part = _draw(left, step, registers - step)
        pick += step
        row = np.arange(len(left))
        chosen = perm[row, pick]
        perm[row, pick] = perm[row, step]
        perm[row, step] = chosen
        np.minimum.at(best.reshape(-1), owner * registers + chosen, part | U64(step << 32))
        open_ &= best.max(axis=1) >= U64((step + 1) << 32)
        keep = open_[owner]
        if not keep.all():
            left, owner, perm = left[keep], owner[keep], perm[keep]
    return best
