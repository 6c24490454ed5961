"""Key names and modifier lists of key-press rows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key codes with a name of their own.
SPECIAL_KEYS = {
    36: "return", 48: "tab", 49: "space", 51: "delete", 53: "escape", 76: "enter", 117: "forwarddelete",
    123: "left", 124: "right", 125: "down", 126: "up",
    115: "home", 119: "end", 116: "pageup", 121: "pagedown",
    122: "f1", 120: "f2", 99: "f3", 118: "f4", 96: "f5", 97: "f6",
    98: "f7", 100: "f8", 101: "f9", 109: "f10", 103: "f11", 111: "f12",
}

# Modifier bits of the platform's event flags, in output order. Caps lock is not reported.
MODIFIER_BITS = {"cmd": 1 << 20, "opt": 1 << 19, "ctrl": 1 << 18, "shift": 1 << 17, "fn": 1 << 23}

# Code points that renderers ignore by default (soft hyphen, joiners, directional marks, variation selectors).
IGNORABLE = (
    r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}"
    r"\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}"
    r"\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
)


def key_name(code: Column, chars: Column) -> Column:
    """Named keys first, then printable characters, else `keyN`."""
    names = F.create_map(*[F.lit(v) for v in chain.from_iterable(SPECIAL_KEYS.items())])
    printable = (F.length(chars) > 0) & ~chars.rlike(r"[\x00-\x1f]") & ~chars.rlike(IGNORABLE)
    return F.coalesce(
        F.element_at(names, code.cast("int")),
        F.when(printable, chars),
        F.concat(F.lit("key"), code.cast("string")),
    )


def modifiers(flags: Column) -> Column:
    bits = flags.cast("bigint")
    return F.array_compact(
        F.array(*[F.when(bits.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in MODIFIER_BITS.items()])
    )
