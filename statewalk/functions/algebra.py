"""Oriented permutations: literals, composition and inverse-token lookup.

A state and a transition are the same thing seen from two sides: two
permutations (8 corners, 12 edges), each with an offset per slot that is
added modulo 3 or 2.  Composition is associative, which is what lets long
folds be cut into blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from statewalk.sources.fixed import BASIC_TRANSITIONS

MODULUS = {"corner": 3, "edge": 2}
SLOTS = {"corner": 8, "edge": 12}
STATE_FIELDS = ["corner_pos", "edge_pos", "corner_ori", "edge_ori"]
MOVE_FIELDS = ["corner_move", "edge_move", "corner_turn", "edge_turn"]
STATE_TYPE = ", ".join(f"{name}: array<int>" for name in STATE_FIELDS)


@dataclass(frozen=True)
class Transition:
    """One literal transition; `pos` and `ori` are keyed by corner/edge."""

    turns: int
    initial: str
    token: str
    inverse: str
    pos: dict
    ori: dict


def _literal_transitions() -> list[Transition]:
    out = []
    for initial, (cm, em, ct, et) in BASIC_TRANSITIONS.items():
        base_pos = {"corner": cm, "edge": em}
        base_ori = {"corner": ct, "edge": et}
        names = [initial, initial + "2", initial.lower()]
        pos, ori = base_pos, base_ori
        for turns in (1, 2, 3):
            out.append(
                Transition(turns, initial, names[turns - 1], names[3 - turns], pos, ori)
            )
            ori = {
                part: [
                    (ori[part][src] + base_ori[part][slot]) % MODULUS[part]
                    for slot, src in enumerate(base_pos[part])
                ]
                for part in MODULUS
            }
            pos = {part: [pos[part][src] for src in base_pos[part]] for part in MODULUS}
    return out


TRANSITIONS = _literal_transitions()
TOKENS = sorted(t.token for t in TRANSITIONS)
BY_TOKEN = {t.token: t for t in TRANSITIONS}


def int_array(values) -> Column:
    """An array<int> literal."""
    return F.expr(_ints(values))


def _ints(values) -> str:
    return f"array({', '.join(str(int(v)) for v in values)})"


def identity_struct() -> Column:
    """The start state: every slot holds its own number, no offset."""
    return F.struct(
        int_array(range(8)).alias("corner_pos"),
        int_array(range(12)).alias("edge_pos"),
        int_array([0] * 8).alias("corner_ori"),
        int_array([0] * 12).alias("edge_ori"),
    )


def inverse_map(transitions=TRANSITIONS) -> Column:
    return F.expr(f"map({', '.join(f"'{t.token}', '{t.inverse}'" for t in transitions)})")


def compose(state: Column, move: Column) -> Column:
    """Apply `move` to `state`; both are structs with the STATE_FIELDS."""

    def part_pos(part):
        pos = state[f"{part}_pos"]
        return F.transform(move[f"{part}_pos"], lambda src: F.get(pos, src))

    def part_ori(part):
        ori, turn, k = state[f"{part}_ori"], move[f"{part}_ori"], MODULUS[part]
        return F.transform(
            move[f"{part}_pos"],
            lambda src, slot: (F.get(ori, src) + F.get(turn, slot)) % F.lit(k),
        )

    return F.struct(
        part_pos("corner").alias("corner_pos"),
        part_pos("edge").alias("edge_pos"),
        part_ori("corner").alias("corner_ori"),
        part_ori("edge").alias("edge_ori"),
    )


# For folds the four arrays are flattened into one permutation of 8x3 + 12x2
# faces: face r of slot d holds face (ori[d] + r) mod k of piece pos[d].  Then
# composing is one gather, with no modulus left to take.
FACE_BASE = {"corner": 0, "edge": 24}


def literal_faces(t: Transition) -> list[int]:
    faces = []
    for part, k in MODULUS.items():
        for piece, turn in zip(t.pos[part], t.ori[part]):
            faces += [FACE_BASE[part] + k * piece + (turn + r) % k for r in range(k)]
    return faces


def to_faces(state: Column) -> Column:
    def side(part):
        base, k, ori = FACE_BASE[part], MODULUS[part], state[f"{part}_ori"]
        faces_of = lambda piece, slot: F.array(
            *[F.lit(base) + piece * k + (F.get(ori, slot) + r) % k for r in range(k)]
        )
        return F.flatten(F.transform(state[f"{part}_pos"], faces_of))

    return F.concat(side("corner"), side("edge"))


def from_faces(faces: Column) -> Column:
    def firsts(part):
        base, k, n = FACE_BASE[part], MODULUS[part], SLOTS[part]
        return int_array(range(base, base + k * n, k))

    def pos(part):
        base, k = FACE_BASE[part], MODULUS[part]
        return F.transform(
            firsts(part),
            lambda f: F.call_function("div", F.get(faces, f) - base, F.lit(k)).cast("int"),
        )

    def ori(part):
        base, k = FACE_BASE[part], MODULUS[part]
        return F.transform(firsts(part), lambda f: (F.get(faces, f) - base) % k)

    return F.struct(
        pos("corner").alias("corner_pos"),
        pos("edge").alias("edge_pos"),
        ori("corner").alias("corner_ori"),
        ori("edge").alias("edge_ori"),
    )


def compose_faces(first: Column, then: Column) -> Column:
    return F.transform(then, lambda face: F.get(first, face))


def face_map(transitions=TRANSITIONS) -> Column:
    """token -> faces, a constant the optimizer folds to one literal."""
    pairs = [f"'{t.token}', {_ints(literal_faces(t))}" for t in transitions]
    return F.expr(f"map({', '.join(pairs)})")


# Running value of a fold: the composed faces, how many tokens it took in, how
# many it saw, and whether an unknown token has stopped it.
FOLD_TYPE = "struct<faces: array<int>, n_applied: bigint, n_tokens: bigint, stopped: boolean>"


def _fold_value(faces: Column, n_applied: Column, n_tokens: Column, stopped: Column) -> Column:
    return F.struct(
        faces.alias("faces"),
        n_applied.alias("n_applied"),
        n_tokens.alias("n_tokens"),
        stopped.alias("stopped"),
    )


def fold_start(state=None, faces: Column | None = None) -> Column:
    """A fold that has seen no token, from a state or its faces."""
    if faces is None:
        faces = int_array(range(48)) if state is None else to_faces(state)
    zero = F.lit(0).cast("bigint")
    return _fold_value(faces, zero, zero, F.lit(False)).cast(FOLD_TYPE)


def fold_combine(acc: Column, nxt: Column) -> Column:
    """Join two neighbouring fold values; associative."""
    seen = acc["n_tokens"] + nxt["n_tokens"]
    joined = _fold_value(
        compose_faces(acc["faces"], nxt["faces"]),
        acc["n_applied"] + nxt["n_applied"],
        seen,
        nxt["stopped"],
    )
    halted = _fold_value(acc["faces"], acc["n_applied"], seen, F.lit(True))
    return F.when(acc["stopped"], halted).otherwise(joined)


def token_faces(tokens: Column, transitions=TRANSITIONS) -> Column:
    """The faces of every token; NULL for an unknown or NULL token."""
    known = face_map(transitions)
    return F.transform(tokens, lambda token: F.try_element_at(known, token))


def fold_move(acc: Column, faces: Column) -> Column:
    """Take in the faces of one token; a NULL stops the fold for good."""
    seen = acc["n_tokens"] + F.lit(1)
    joined = _fold_value(
        compose_faces(acc["faces"], faces), acc["n_applied"] + F.lit(1), seen, F.lit(False)
    )
    halted = _fold_value(acc["faces"], acc["n_applied"], seen, F.lit(True))
    return F.when(acc["stopped"] | faces.isNull(), halted).otherwise(joined)


def fold_tokens(tokens: Column, start: Column | None = None, transitions=TRANSITIONS) -> Column:
    """Fold an array of tokens held in one row into a fold value."""
    return F.aggregate(
        token_faces(tokens, transitions),
        fold_start() if start is None else start,
        fold_move,
    )


def undo_tokens(path: Column, transitions=TRANSITIONS) -> Column:
    """The path taken backwards: reversed, each token replaced by its inverse."""
    inverse = inverse_map(transitions)
    return F.transform(F.reverse(path), lambda token: F.try_element_at(inverse, token))
