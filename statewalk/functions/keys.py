"""Text keys of states: four schemes, and the representative of a class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statewalk.sources.fixed import CANONICAL_PERMUTATIONS


def digits(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), "")


def flags(values: Column, at_least: int = 8) -> Column:
    return digits(F.transform(values, lambda v: (v >= at_least).cast("int")))


def buckets(values: Column, width: int = 4) -> Column:
    return digits(F.transform(values, lambda v: F.call_function("div", v, F.lit(width))))


def hex_digits(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.hex(v)), "")


def canonical(text: Column) -> Column:
    """Representative of an arrangement of the characters 0-7.

    The characters 0-3, in order of appearance, are permuted so that 0 comes
    first, and put back into the places the four of them held; likewise 4-7
    with 4.  Deleting the other four characters gives the order of appearance,
    and one `translate` from old to new order puts all eight back.
    """
    before, after = [], []
    for members, others in (("0123", "4567"), ("4567", "0123")):
        group = F.translate(text, others, "")
        where = F.instr(group, members[0])
        moved = None
        for at, permutation in enumerate(CANONICAL_PERMUTATIONS, start=1):
            picked = F.concat(*[F.substring(group, i + 1, 1) for i in permutation])
            moved = F.when(where == at, picked) if moved is None else moved.when(where == at, picked)
        before.append(group)
        after.append(moved)
    return F.call_function("translate", text, F.concat(*before), F.concat(*after))


SCHEMES = {
    # stage number: key of a state from its four arrays
    "digits": lambda s: digits(s["edge_ori"]),
    "flags": lambda s: F.concat(digits(s["corner_ori"]), flags(s["edge_pos"])),
    "buckets": lambda s: F.concat(canonical(digits(s["corner_pos"])), buckets(s["edge_pos"])),
    "hex": lambda s: F.concat(digits(s["corner_pos"]), hex_digits(s["edge_pos"])),
    "full": lambda s: F.concat(
        digits(s["corner_pos"]),
        hex_digits(s["edge_pos"]),
        digits(s["corner_ori"]),
        digits(s["edge_ori"]),
    ),
}
STAGE_SCHEME = {1: "digits", 2: "flags", 3: "buckets", 4: "hex"}
