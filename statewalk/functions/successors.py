"""Successor of a key under a transition that sits beside it in the row.

A layout names the segments of a key: ("corner", "pos") is gathered through the
corner permutation, ("edge", "ori") is gathered and then offset modulo 2, and so
on.  The small transition table carries, for every slot of the key, where its
new content comes from; the successor is then one flat generated expression,
the same for all transitions.  At most 18 transitions exist, all known when the
plan is built, so the table is one constant array and pairing a state with it is
an explode: no join, no broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.functions.algebra import BY_TOKEN, MODULUS, SLOTS

Layout = list[tuple[str, str]]


def _constant(rows: list[dict[str, str]]) -> Column:
    """Array of structs from SQL literals; one expression, parsed once."""
    structs = [
        "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in row.items()) + ")"
        for row in rows
    ]
    return F.expr(f"array({', '.join(structs)})")


def _ints(values: list[int]) -> str:
    return f"array({', '.join(map(str, values))})"


class TextKeys:
    """Keys kept as text, one character per slot."""

    type = "string"

    def __init__(self, layout: Layout):
        self.layout = layout

    def pack(self, text: str) -> str:
        return text

    def text(self, key: Column) -> Column:
        return key

    def moves(self, tokens: list[str]) -> Column:
        """number, token, and per slot the place to read and the offset to add."""
        rows = []
        for number, token in enumerate(tokens):
            move, places, turns, low = BY_TOKEN[token], [], [], 1
            for part, kind in self.layout:
                places += [low + src for src in move.pos[part]]
                turns += move.ori[part] if kind == "ori" else [0] * SLOTS[part]
                low += SLOTS[part]
            rows.append(
                {
                    "number": str(number),
                    "token": f"'{token}'",
                    "places": _ints(places),
                    "turns": _ints(turns),
                }
            )
        return _constant(rows)

    def successor(self, rows: DataFrame) -> DataFrame:
        chars, slot = [], 0
        for part, kind in self.layout:
            for _ in range(SLOTS[part]):
                read = f"substr(state, places[{slot}], 1)"
                if kind == "ori":
                    read = f"cast((cast({read} as int) + turns[{slot}]) % {MODULUS[part]} as string)"
                chars.append(read)
                slot += 1
        return rows.withColumn("state", F.expr(f"concat({', '.join(chars)})"))


class PackedKeys:
    """Keys of small digits packed in a bigint, most significant slot first.

    Hashing, comparing and shuffling a bigint is far cheaper than a string, and
    a gather is a row of shifts and masks.
    """

    type = "bigint"

    def __init__(self, layout: Layout, widths: dict[str, int] | None = None):
        """`widths` has the bits of a position digit by part; one bit each if it is left out."""
        self.slots = []  # (part, kind, bits) per slot
        for part, kind in layout:
            bits = (2 if part == "corner" else 1) if kind == "ori" else (widths or {}).get(part, 1)
            self.slots += [(part, kind, bits)] * SLOTS[part]
        self.layout = layout
        low, shifts = 0, []
        for _, _, bits in reversed(self.slots):
            shifts.append(low)
            low += bits
        if low > 62:
            raise ValueError("layout does not fit a bigint")
        self.shifts = shifts[::-1]

    def pack(self, text: str) -> int:
        return sum(int(ch) << shift for ch, shift in zip(text, self.shifts))

    def text(self, key: Column) -> Column:
        pieces, at = [], 0
        for part, _ in self.layout:
            size, bits = SLOTS[part], self.slots[at][2]
            field = F.shiftright(key, self.shifts[at + size - 1]).bitwiseAND(
                F.lit((1 << bits * size) - 1)
            )
            pieces.append(F.lpad(F.conv(field.cast("string"), 10, 1 << bits), size, "0"))
            at += size
        return F.concat(*pieces)

    def _mask(self, wanted) -> int:
        return sum(1 << s for i, s in enumerate(self.shifts) if wanted(i))

    def moves(self, tokens: list[str]) -> Column:
        """number, token, per slot the shift to read at, and masks of offsets."""
        rows = []
        for number, token in enumerate(tokens):
            move, reads, turns, at = BY_TOKEN[token], [], [], 0
            for part, kind in self.layout:
                reads += [self.shifts[at + src] for src in move.pos[part]]
                turns += move.ori[part] if kind == "ori" else [0] * SLOTS[part]
                at += SLOTS[part]
            one, two = [self._mask(lambda i, n=n: turns[i] == n) for n in (1, 2)]
            rows.append(
                {
                    "number": str(number),
                    "token": f"'{token}'",
                    "reads": _ints(reads),
                    "plus_one": f"{one}L",
                    "plus_two": f"{two}L",
                }
            )
        return _constant(rows)

    def successor(self, rows: DataFrame) -> DataFrame:
        gathered = " | ".join(
            f"shiftleft(shiftright(state, reads[{slot}]) & {(1 << bits) - 1}, {shift})"
            for slot, ((_, _, bits), shift) in enumerate(zip(self.slots, self.shifts))
        )
        rows = rows.withColumn("state", F.expr(gathered))

        if all(kind != "ori" for _, kind, _ in self.slots):
            return rows
        wide = self._mask(lambda i: self.slots[i][1:] == ("ori", 2))
        if not wide:
            return rows.withColumn("state", F.expr("state ^ plus_one"))
        # Digits of two bits, modulo 3, all slots at once: low bit, high bit, a
        # bit that says the digit is zero, and one that says it stays as it is.
        rows = rows.withColumns(
            {
                "_low": F.expr(f"state & {wide}L"),
                "_high": F.expr(f"shiftright(state, 1) & {wide}L"),
                "_stay": F.expr(f"(plus_one | plus_two) ^ {wide}L"),
            }
        ).withColumn("_zero", F.expr(f"(_low | _high) ^ {wide}L"))
        low = "((_low & _stay) | (_zero & plus_one) | (_high & plus_two))"
        high = "((_high & _stay) | (_low & plus_one) | (_zero & plus_two))"
        rest = f"(state & {~(wide * 3)}L)"
        digits = F.expr(f"{rest} | {low} | shiftleft({high}, 1)")
        return rows.withColumn("state", digits).drop("_low", "_high", "_zero", "_stay")


class OrbitKeys(PackedKeys):
    """Keys of positions, each kept as a number within the orbit of its slot.

    The tokens of a search move a slot's content only within the orbit of the
    slot, so a few bits tell which member it is: an arrangement of twelve that
    keeps to three orbits of four takes 24 bits, not 48.  A key or token that
    leaves the orbits is refused.
    """

    def __init__(self, layout: Layout, tokens: list[str]):
        if any(kind != "pos" for _, kind in layout):
            raise ValueError("orbits are of positions")
        self.orbits: list[list[int]] = []
        widths = {}
        for part, _ in layout:
            of = _orbits(part, tokens)
            widths[part] = max((len(of[slot]) - 1).bit_length() or 1 for slot in range(SLOTS[part]))
            self.orbits += [of[slot] for slot in range(SLOTS[part])]
        super().__init__(layout, widths)

    def pack(self, text: str) -> int:
        return sum(orbit.index(int(ch, 16)) << shift for ch, orbit, shift in zip(text, self.orbits, self.shifts))

    def text(self, key: Column) -> Column:
        pieces = []
        for (_, _, bits), orbit, shift in zip(self.slots, self.orbits, self.shifts):
            member = F.shiftright(key, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
            names = "".join(f"{value:X}" for value in orbit)
            pieces.append(F.substring(F.lit(names), member + 1, F.lit(1)))
        return F.concat(*pieces)

    def moves(self, tokens: list[str]) -> Column:
        at = 0
        for part, _ in self.layout:
            for token in tokens:
                for slot, source in enumerate(BY_TOKEN[token].pos[part]):
                    if self.orbits[at + slot] != self.orbits[at + source]:
                        raise ValueError(f"{token} leaves the orbits of these keys")
            at += SLOTS[part]
        return super().moves(tokens)


def _orbits(part: str, tokens: list[str]) -> dict[int, list[int]]:
    """For each slot the slots that the tokens can bring its content to."""
    of = {slot: {slot} for slot in range(SLOTS[part])}
    for token in tokens:
        for slot, source in enumerate(BY_TOKEN[token].pos[part]):
            joined = of[slot] | of[source]
            for member in joined:
                of[member] = joined
    return {slot: sorted(members) for slot, members in of.items()}
