"""They must be exactly these for results to be right."""

# --- fixed values: the six basic transitions -------------------------------
# name: corner_move, edge_move, corner_turn, edge_turn
BASIC_TRANSITIONS = {
    "U": (
        [4, 1, 2, 7, 3, 5, 6, 0],
        [8, 1, 2, 11, 4, 5, 6, 7, 3, 9, 10, 0],
        [2, 0, 0, 2, 1, 0, 0, 1],
        [1, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 1],
    ),
    "D": (
        [0, 5, 6, 3, 4, 2, 1, 7],
        [0, 10, 9, 3, 4, 5, 6, 7, 8, 1, 2, 11],
        [0, 2, 2, 0, 0, 1, 1, 0],
        [0, 1, 1, 0, 0, 0, 0, 0, 0, 1, 1, 0],
    ),
    "F": (
        [0, 6, 2, 4, 1, 5, 3, 7],
        [0, 1, 2, 3, 4, 9, 8, 7, 5, 6, 10, 11],
        [0, 1, 0, 1, 2, 0, 2, 0],
        [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    ),
    "B": (
        [7, 1, 5, 3, 4, 0, 6, 2],
        [0, 1, 2, 3, 11, 5, 6, 10, 8, 9, 4, 7],
        [1, 0, 1, 0, 0, 2, 0, 2],
        [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    ),
    "L": (
        [5, 4, 2, 3, 0, 1, 6, 7],
        [4, 5, 2, 3, 1, 0, 6, 7, 8, 9, 10, 11],
        [0, 0, 0, 0, 0, 0, 0, 0],
        [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    ),
    "R": (
        [0, 1, 7, 6, 4, 5, 2, 3],
        [0, 1, 7, 6, 4, 5, 2, 3, 8, 9, 10, 11],
        [0, 0, 0, 0, 0, 0, 0, 0],
        [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    ),
}

# --- fixed values: seeds, barred tokens and depth caps of the four stages ---
STAGE_SEEDS = {
    1: ["000000000000"],
    2: ["00000000000000001111"],
    3: [
        "01234567000011112222",
        "01324576000011112222",
        "02134657000011112222",
        "02314675000011112222",
        "03124756000011112222",
        "03214765000011112222",
    ],
    4: ["012345670123456789AB"],
}
STAGE_BARRED = {
    1: [],
    2: ["U", "u", "D", "d"],
    3: ["U", "u", "D", "d", "F", "f", "B", "b"],
    4: ["U", "u", "D", "d", "F", "f", "B", "b", "L", "l", "R", "r"],
}
STAGE_DEPTH = {1: 7, 2: 10, 3: 13, 4: 15}

# --- fixed values: the permutation applied by position of the least member --
CANONICAL_PERMUTATIONS = [
    [0, 1, 2, 3],
    [1, 0, 3, 2],
    [2, 3, 0, 1],
    [3, 2, 1, 0],
]
