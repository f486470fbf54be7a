"""Plain Python counterparts, for small inputs."""

from statewalk.functions.algebra import BY_TOKEN, MODULUS

START = {
    "pos": {"corner": list(range(8)), "edge": list(range(12))},
    "ori": {"corner": [0] * 8, "edge": [0] * 12},
}


def turn(state, token):
    move = BY_TOKEN[token]
    return {
        "pos": {p: [state["pos"][p][s] for s in move.pos[p]] for p in MODULUS},
        "ori": {
            p: [(state["ori"][p][s] + move.ori[p][d]) % MODULUS[p] for d, s in enumerate(move.pos[p])]
            for p in MODULUS
        },
    }


def fold(tokens):
    state, n = START, 0
    for token in tokens:
        if token not in BY_TOKEN:
            break
        state, n = turn(state, token), n + 1
    return state, n


def arrays(row):
    return {
        "pos": {"corner": row["corner_pos"], "edge": row["edge_pos"]},
        "ori": {"corner": row["corner_ori"], "edge": row["edge_ori"]},
    }


def bfs(edges, seeds, cap, directed):
    """node -> (distance, path) with the smallest of the shortest paths."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        if not directed:
            out.setdefault(b, set()).add(a)
    found = {s: (0, [s]) for s in seeds}
    level = sorted(found)
    for distance in range(1, cap + 1):
        new = {}
        for node in sorted(level, key=lambda n: found[n][1]):
            for nxt in out.get(node, ()):
                if nxt not in found and nxt not in new:
                    new[nxt] = (distance, found[node][1] + [nxt])
        found.update(new)
        level = list(new)
    return found
