"""SQL that gives each registered query's rows from the same tables.

Written for a single-node SQL engine with list functions.  It follows other
routes than the Spark code on purpose: folds are recursive steps, one token at a
time, and a stage is searched as pairs of two small component graphs.
"""

from __future__ import annotations

from statewalk.functions.algebra import FACE_BASE, MODULUS, SLOTS, TOKENS
from statewalk.plans.stages import stage_tokens
from statewalk.sources.fixed import (
    BASIC_TRANSITIONS,
    CANONICAL_PERMUTATIONS,
    STAGE_DEPTH,
    STAGE_SEEDS,
)


def _compose(first: str, then: str, var: str = "x") -> str:
    return f"list_transform({then}, lambda {var}: {first}[{var} + 1])"


def _basic_faces() -> str:
    rows = []
    for name, (cm, em, ct, et) in BASIC_TRANSITIONS.items():
        faces = []
        for part, pos, ori in (("corner", cm, ct), ("edge", em, et)):
            k, base = MODULUS[part], FACE_BASE[part]
            faces += [base + k * p + (o + r) % k for p, o in zip(pos, ori) for r in range(k)]
        rows.append(f"('{name}', {faces})")
    return ", ".join(rows)


IDENTITY = str(list(range(48)))


def _lists(s: str) -> dict[str, str]:
    """The four arrays of a face list."""
    out = {}
    for part, k in MODULUS.items():
        base = FACE_BASE[part]
        places = f"range({base}, {base + k * SLOTS[part]}, {k})"
        out[f"{part}_pos"] = f"list_transform({places}, lambda x: (({s})[x + 1] - {base}) // {k})"
        out[f"{part}_ori"] = f"list_transform({places}, lambda x: (({s})[x + 1] - {base}) % {k})"
    return out


MOVES = f"""
basic(initial, f) AS (VALUES {_basic_faces()}),
named AS (
  SELECT initial, initial AS token, lower(initial) AS inverse, 1 AS turns, f AS faces FROM basic
  UNION ALL
  SELECT initial, initial || '2', initial || '2', 2, {_compose('f', 'f')} FROM basic
  UNION ALL
  SELECT initial, lower(initial), initial, 3, {_compose(_compose('f', 'f'), 'f', 'y')} FROM basic
),
moves AS MATERIALIZED (
  SELECT token, inverse, faces, row_number() OVER (ORDER BY token) - 1 AS number,
         {', '.join(f'{sql} AS {name}' for name, sql in _lists('faces').items())}
  FROM named
)"""

EVENT_TOKENS = """
seq AS MATERIALIZED (
  SELECT user_id AS k, event_id, m.token, m.faces,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events JOIN moves m
    ON m.number = ((event_id + floor(value)::BIGINT) % 18 + 18) % 18
)"""


def _line_tokens(key: str) -> str:
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_orderkey", "l_quantity", "l_extendedprice"]
    order.remove(key)
    return f"""
seq AS MATERIALIZED (
  SELECT {key} AS k, m.token, m.faces,
         row_number() OVER (PARTITION BY {key} ORDER BY {', '.join(order)}) AS rn
  FROM lineitem JOIN moves m
    ON m.number = (l_partkey + l_linenumber + l_orderkey) % 18
)"""


WALK = f"""
walk(k, i, token, s) AS (
  SELECT DISTINCT k, 1::BIGINT, NULL::VARCHAR, {IDENTITY} FROM seq
  UNION ALL
  SELECT w.k, w.i + 1, q.token, {_compose('w.s', 'q.faces')}
  FROM walk w JOIN seq q ON q.k = w.k AND q.rn = w.i
)"""
LAST = """
final AS MATERIALIZED (
  SELECT k, arg_max(s, i) AS s, max(i) - 1 AS n FROM walk GROUP BY k
)"""


def _state_text(s: str = "s", names=None) -> str:
    names = names or {}
    return ", ".join(
        f"array_to_string({sql}, ',') AS {names.get(name, name)}" for name, sql in _lists(s).items()
    )


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


HEX = "substr('0123456789AB', (x + 1)::INT, 1)"
PARTS = _lists("s")
KEY = {
    "digits": f"array_to_string({PARTS['edge_ori']}, '')",
    "flags": f"array_to_string({PARTS['corner_ori']}, '') || array_to_string(list_transform({PARTS['edge_pos']}, lambda x: (x >= 8)::INT), '')",
    "hex": f"array_to_string({PARTS['corner_pos']}, '') || array_to_string(list_transform({PARTS['edge_pos']}, lambda x: {HEX}), '')",
}
KEY["full"] = (
    KEY["hex"]
    + f" || array_to_string({PARTS['corner_ori']}, '') || array_to_string({PARTS['edge_ori']}, '')"
)
PERMS = str(CANONICAL_PERMUTATIONS)


def _canonical(c: str) -> str:
    """Representative of a list of 0-7: per group, permute and put back by rank."""

    def moved(test, least):
        group = f"list_filter({c}, lambda v: v {test})"
        return f"list_transform({PERMS}[list_position({group}, {least})], lambda p: ({group})[p + 1])"

    def rank(test):
        return f"len(list_filter(({c})[1:d], lambda v: v {test}))"

    return (
        f"list_transform(range(1, 9), lambda d: CASE WHEN ({c})[d] <= 3 "
        f"THEN ({moved('<= 3', 0)})[{rank('<= 3')}] ELSE ({moved('> 3', 4)})[{rank('> 3')}] END)"
    )


KEY["buckets"] = (
    "array_to_string(" + _canonical("c") + ", '') || "
    f"array_to_string(list_transform({PARTS['edge_pos']}, lambda x: x // 4), '')"
)

USERS = _with(MOVES, EVENT_TOKENS, WALK)
USERS_LAST = _with(MOVES, EVENT_TOKENS, WALK, LAST)


# --- searches over edge tables ------------------------------------------------

ORDER_PART = "SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem"
TRADE = (
    ORDER_PART
    + " UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"
    + " UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem"
)
SUPPLY = (
    "SELECT 's' || l_suppkey AS src, 'o' || l_orderkey AS dst FROM lineitem"
    " UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem"
    " UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem"
)
FIRST_PART = "SELECT 'p' || min(l_partkey) AS node FROM lineitem"


def _search(edges: str, seeds: str, depth: int | None = None, directed: bool = False) -> str:
    """Rounds until nothing new is found; each carries all nodes seen so far, d = round marks the new ones."""
    both = edges if directed else f"SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs"
    cap = "" if depth is None else f"s.round < {depth} AND "
    return f"""WITH RECURSIVE pairs AS ({edges}),
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({both}) WHERE src <> dst),
seen(node, path, d, round) AS (
  SELECT DISTINCT node, [node], 0, 0 FROM ({seeds})
  UNION ALL
  SELECT * FROM (
    WITH fresh AS (
      SELECT e.dst AS node, min(s.path) AS before FROM seen s JOIN e ON e.src = s.node
      WHERE {cap}s.d = s.round AND e.dst NOT IN (SELECT node FROM seen) GROUP BY e.dst
    )
    SELECT node, list_append(before, node), len(before), len(before) FROM fresh
    UNION ALL
    SELECT node, path, d, round + 1 FROM seen WHERE EXISTS (SELECT 1 FROM fresh)
  )
),
found AS (SELECT node, d::INT AS distance, path FROM seen WHERE d = round)
"""


PATHS = "SELECT node, distance, array_to_string(path, '>') AS path FROM found"


# --- stage tables -------------------------------------------------------------


def _next(part: str, kind: str, lst: str) -> str:
    n = SLOTS[part]
    read = f"{lst}[m.{part}_pos[d + 1] + 1]"
    if kind == "ori":
        read = f"({read} + m.{part}_ori[d + 1]) % {MODULUS[part]}"
    return f"list_transform(range({n}), lambda d: {read})"


def _component(name: str, tokens: str, part: str, kind: str, seeds: list, canonical: bool) -> list[str]:
    start = ", ".join(f"({[int(ch, 16) for ch in s]}::BIGINT[])" for s in sorted(set(seeds)))
    step = f"SELECT z.l, m.number, {_next(part, kind, 'z.l')} AS c FROM {{src}} z, {tokens} m"
    shape = _canonical("c") if canonical else "c"
    return [
        f"""{name}_all(l) AS (
  SELECT l::BIGINT[] FROM (VALUES {start}) v(l)
  UNION
  SELECT ({shape})::BIGINT[] FROM ({step.format(src=name + '_all')}) t
)""",
        f"{name} AS MATERIALIZED (SELECT l, row_number() OVER (ORDER BY l) AS id FROM {name}_all)",
        f"""{name}_step AS MATERIALIZED (
  SELECT a.id, t.number, b.id AS nxt
  FROM (SELECT l, number, ({shape})::BIGINT[] AS c FROM ({step.format(src=name)}) q) t
  JOIN {name} a ON a.l = t.l JOIN {name} b ON b.l = t.c
)""",
    ]


def _stage(k: int) -> list[str]:
    """CTEs up to g{k}(state, path): pairs of component ids, searched by level."""
    parts = {
        1: [("edge", "ori", 0, 12), None],
        2: [("corner", "ori", 0, 8), ("edge", "pos", 8, 20)],
        3: [("corner", "pos", 0, 8), ("edge", "pos", 8, 20)],
        4: [("corner", "pos", 0, 8), ("edge", "pos", 8, 20)],
    }[k]
    names = ", ".join(f"'{x}'" for x in stage_tokens(k))
    tokens = f"t{k}"
    ctes = [
        f"""{tokens} AS MATERIALIZED (
  SELECT * REPLACE (row_number() OVER (ORDER BY token) - 1 AS number) FROM moves WHERE token IN ({names})
)"""
    ]
    seeds = STAGE_SEEDS[k]
    for side, spec in zip("ab", parts):
        if spec is None:
            ctes += [
                f"{side}{k} AS (SELECT []::BIGINT[] AS l, 1 AS id)",
                f"{side}{k}_step AS (SELECT 1 AS id, number, 1 AS nxt FROM {tokens})",
            ]
            continue
        part, kind, lo, hi = spec
        ctes += _component(
            f"{side}{k}", tokens, part, kind, [s[lo:hi] for s in seeds], k == 3 and part == "corner"
        )
    lo_a, hi_a = parts[0][2:]
    hexed = "array_to_string(list_transform({}, lambda x: " + HEX + "), '')"
    both = f"{hexed.format('a.l')} || {hexed.format('b.l')}"
    first = ", ".join(f"'{s}'" for s in seeds)
    width = 1 << (len(stage_tokens(k)) - 1).bit_length()
    ctes.append(
        f"""s{k}_0 AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b, 0::BIGINT AS code FROM a{k} a, b{k} b WHERE {both} IN ({first})
)"""
    )
    for d in range(1, STAGE_DEPTH[k] + 1):
        old = " UNION ALL ".join(f"SELECT a, b FROM s{k}_{o}" for o in range(max(0, d - 2), d))
        ctes.append(
            f"""s{k}_{d} AS MATERIALIZED (
  SELECT n.* FROM (
    SELECT x.nxt AS a, y.nxt AS b, min(f.code * {width} + x.number)::BIGINT AS code
    FROM s{k}_{d - 1} f JOIN a{k}_step x ON x.id = f.a JOIN b{k}_step y ON y.id = f.b AND y.number = x.number
    GROUP BY ALL) n
  ANTI JOIN ({old}) o USING (a, b)
)"""
        )
    union = " UNION ALL ".join(
        f"SELECT a, b, code, {d} AS distance FROM s{k}_{d}" for d in range(STAGE_DEPTH[k] + 1)
    )
    ctes.append(
        f"""g{k} AS MATERIALIZED (
  SELECT {both} AS state,
         list_transform(range(f.distance - 1, -1, -1),
           lambda j: [{names}][(f.code // ({width}::BIGINT ** j)::BIGINT) % {width} + 1]) AS path
  FROM ({union}) f JOIN a{k} a ON a.id = f.a JOIN b{k} b ON b.id = f.b
)"""
    )
    return ctes


TOKEN_FACES = (
    "tokenmap AS MATERIALIZED (SELECT map_from_entries(list((token, faces))) AS faces,"
    " map_from_entries(list((token, inverse))) AS inverse FROM moves)"
)


def _undo(path: str) -> str:
    return f"list_transform(list_reverse({path}), lambda z: tm.inverse[z])"


def _fold(start: str, applied: str) -> str:
    """Faces after the tokens of a list."""
    steps = f"list_prepend({start}, list_transform({applied}, lambda z: tm.faces[z]))"
    return f"list_reduce({steps}, lambda p, q: list_transform(q, lambda x: p[x + 1]))"


SCHEME = {1: "digits", 2: "flags", 3: "buckets", 4: "hex"}


def _resolved(upto: int = 4) -> list[str]:
    """Tables r1 to r4: every user's state s0 before a stage, the tokens applied, s after it."""
    ctes = [MOVES, EVENT_TOKENS, WALK, LAST, TOKEN_FACES]
    for k in range(1, upto + 1):
        ctes += _stage(k)
    ctes.append("r0 AS (SELECT k, n, s, []::VARCHAR[] AS done FROM final)")
    for k in range(1, upto + 1):
        scheme = SCHEME[k]
        ctes.append(
            f"""r{k} AS MATERIALIZED (
  SELECT v.k, v.n, {_fold('v.s', 'v.applied')} AS s, list_concat(v.done, v.applied) AS done,
         v.s AS s0, v.applied
  FROM (SELECT q.k, q.n, q.s, q.done, {_undo('g.path')} AS applied
        FROM (SELECT *, {KEY[scheme]} AS state FROM (SELECT *, {PARTS['corner_pos']} AS c FROM r{k - 1})) q
        JOIN g{k} g USING (state), tokenmap tm) v, tokenmap tm)"""
        )
    return ctes


def _resolve_trace() -> str:
    steps = " UNION ALL ".join(
        f"SELECT k, {j}::INT AS stage, s0, applied, unnest(range(0, len(applied) + 1)) AS step FROM r{j}"
        " WHERE k IN (SELECT k FROM r4)"
        for j in (1, 2, 3, 4)
    )
    return _with(*_resolved()) + (
        f"SELECT k AS user_id, stage, step::INT AS step, applied[step] AS move, {_state_text('z')}"
        f" FROM (SELECT v.k, v.stage, v.step, v.applied, {_fold('v.s0', 'v.applied[1:v.step]')} AS z"
        f" FROM ({steps}) v, tokenmap tm)"
    )


def _resolve() -> str:
    return _with(*_resolved()) + (
        "SELECT k AS user_id, n AS n_tokens, n AS n_applied,"
        " CASE WHEN len(done) > 0 THEN array_to_string(done, ' ') END AS result,"
        f" len(done)::INT AS n_moves, s = {IDENTITY} AS solved FROM r4"
    )


def _late_lookup(k: int) -> str:
    """Paths of stage k for every user's state after the stages before."""
    return _with(*_resolved(k - 1), *_stage(k)) + (
        "SELECT w.k AS user_id, w.state, array_to_string(g.path, ' ') AS path"
        f" FROM (SELECT *, {KEY[SCHEME[k]]} AS state FROM (SELECT *, {PARTS['corner_pos']} AS c FROM r{k - 1})) w"
        f" JOIN g{k} g USING (state)"
    )


def _neighbourhood() -> str:
    ctes = [MOVES, EVENT_TOKENS, WALK, LAST]
    ctes.append("n0 AS MATERIALIZED (SELECT DISTINCT s, []::VARCHAR[] AS path FROM final)")
    for d in (1, 2):
        old = " UNION ALL ".join(f"SELECT s FROM n{o}" for o in range(d))
        ctes.append(
            f"""n{d} AS MATERIALIZED (
  SELECT z.* FROM (
    SELECT {_compose('f.s', 'm.faces')} AS s, min(list_append(f.path, m.token)) AS path
    FROM n{d - 1} f, moves m GROUP BY 1) z
  ANTI JOIN ({old}) o USING (s))"""
        )
    union = " UNION ALL ".join(f"SELECT s, {d}::INT AS distance, path FROM n{d}" for d in range(3))
    return _with(*ctes) + (
        f"SELECT {KEY['full']} AS state, distance, array_to_string(path, '>') AS path FROM ({union})"
    )


def _key_counts(scheme: str) -> str:
    return USERS + (
        f"SELECT {KEY[scheme]} AS state, count(*) AS n_states"
        f" FROM (SELECT *, {PARTS['corner_pos']} AS c FROM walk) GROUP BY 1"
    )


def _lookup(k: int, scheme: str) -> str:
    return _with(MOVES, EVENT_TOKENS, WALK, *_stage(k)) + (
        "SELECT w.k AS user_id, w.i, w.state, array_to_string(g.path, ' ') AS path"
        f" FROM (SELECT *, {KEY[scheme]} AS state FROM walk) w JOIN g{k} g USING (state)"
    )


def _tokens(source: str, keep: str) -> str:
    return f"""
SELECT {keep}, i::BIGINT AS i, parts[i] AS token
FROM (SELECT {keep}, parts, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT {keep}, string_split(text, ' ') AS parts FROM {source} WHERE text <> ''))"""


MOVE_NAMES = {
    "corner_pos": "corner_move",
    "edge_pos": "edge_move",
    "corner_ori": "corner_turn",
    "edge_ori": "edge_turn",
}
CORNERS = f"array_to_string({PARTS['corner_pos']}, '')"
CANONICAL = f"array_to_string({_canonical('c')}, '')"

ORACLE = {
    "bfs_paths": _search(ORDER_PART, FIRST_PART) + PATHS,
    "bfs_multi_source": _search(TRADE, "SELECT 's' || s_suppkey AS node FROM supplier") + PATHS,
    "bfs_directed": _search(SUPPLY, FIRST_PART, directed=True) + PATHS,
    "bfs_level_histogram": _search(TRADE, FIRST_PART)
    + "SELECT distance, count(*) AS n_nodes FROM found GROUP BY distance",
    "expand_once": """
SELECT 'o' || l_orderkey AS node, 1::INT AS distance,
       'p' || p_partkey || '>' || 'o' || l_orderkey AS path
FROM part JOIN lineitem ON p_partkey = l_partkey""",
    "expand_dedup": """
SELECT node, array_to_string(min(path), '>') AS path
FROM (SELECT 'o' || l_orderkey AS node, ['p' || p_partkey, 'o' || l_orderkey] AS path
      FROM part JOIN lineitem ON p_partkey = l_partkey)
WHERE node NOT IN (SELECT 'p' || p_partkey FROM part)
GROUP BY node""",
    "expand_two_pass": _search(TRADE, "SELECT 'c' || c_custkey AS node FROM customer", depth=2) + PATHS,
    "bfs_states": _neighbourhood(),
    "stored_paths_roundtrip": _search(TRADE, "SELECT 'c' || c_custkey AS node FROM customer")
    + "SELECT node AS state, array_to_string(path, '>') AS path FROM found",
    "lookup_nodes": _search(ORDER_PART, FIRST_PART)
    + "SELECT 'p' || l_partkey AS state, l_orderkey, l_linenumber, distance,"
    " array_to_string(path, '>') AS path FROM lineitem JOIN found ON node = 'p' || l_partkey",
    "reverse_paths": _search(TRADE, FIRST_PART)
    + "SELECT node, distance, array_to_string(list_reverse(path), '>') AS path FROM found",
    "supplier_powers": _with(MOVES, _line_tokens("l_suppkey"), WALK, LAST)
    + f"""SELECT turns::INT AS turns, initial,
  CASE turns WHEN 1 THEN initial WHEN 2 THEN initial || '2' ELSE lower(initial) END AS move,
  CASE turns WHEN 1 THEN lower(initial) WHEN 2 THEN initial || '2' ELSE initial END AS reverse,
  {_state_text('s', MOVE_NAMES)}
FROM (
  SELECT 'S' || k AS initial, 1 AS turns, s FROM final
  UNION ALL SELECT 'S' || k, 2, {_compose('s', 's')} FROM final
  UNION ALL SELECT 'S' || k, 3, {_compose(_compose('s', 's'), 's', 'y')} FROM final)""",
    "apply_transitions": USERS_LAST
    + f"""SELECT event_id, k AS user_id, token AS move, {_state_text('z')}
FROM (SELECT q.event_id, q.k, q.token, {_compose('f.s', 'q.faces')} AS z
      FROM seq q JOIN final f ON f.k = q.k)""",
    "apply_with_nulls": USERS_LAST
    + f"""SELECT event_id, k AS user_id, token AS move, {_state_text('z')}
FROM (SELECT q.event_id, q.k, q.token, {_compose('f.s', 'q.faces')} AS z
      FROM seq q JOIN final f ON f.k = q.k WHERE q.event_id % 3 <> 0 AND q.event_id % 5 <> 0)""",
    "explode_characters": """
SELECT event_id, i::BIGINT AS i, event_type[i] AS token
FROM (SELECT event_id, event_type, unnest(range(1, length(event_type) + 1)) AS i FROM events)""",
    "fold_events": USERS_LAST
    + f"SELECT k AS user_id, {_state_text()}, n AS n_tokens, n AS n_applied FROM final",
    "fold_lineitem": _with(MOVES, _line_tokens("l_orderkey"), WALK, LAST)
    + f"SELECT k AS l_orderkey, {_state_text()}, n AS n_tokens, n AS n_applied FROM final",
    "fold_history": USERS + f"SELECT k AS user_id, i, token, {_state_text()} FROM walk",
    "last_per_key": USERS
    + f"SELECT k AS user_id, i, token, {_state_text()} FROM walk"
    " QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1",
    "last_turn": "SELECT conv_id, turn, role, text FROM conversations"
    " QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "concat_events": "SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id)"
    " FILTER (event_type <> '') AS result FROM events GROUP BY user_id",
    "concat_roles": "SELECT conv_id, string_agg(role, ' ' ORDER BY turn)"
    " FILTER (role <> '') AS result FROM conversations GROUP BY conv_id",
    "explode_tokens": _tokens("documents", "doc_id"),
    "explode_turns": _tokens("conversations", "conv_id, turn"),
    "key_digits": _key_counts("digits"),
    "key_flags": _key_counts("flags"),
    "key_buckets": _key_counts("buckets"),
    "key_hex": _key_counts("hex"),
    "canonical_classes": USERS
    + f"""SELECT canonical, sum(n)::BIGINT AS n_rows, count(*) AS n_keys
FROM (SELECT {CANONICAL} AS canonical, n
      FROM (SELECT {PARTS['corner_pos']} AS c, count(*) AS n FROM walk GROUP BY 1))
GROUP BY canonical""",
    "canonical_rows": USERS
    + f"SELECT k AS user_id, i, array_to_string(c, '') AS corners, {CANONICAL} AS canonical"
    f" FROM (SELECT *, {PARTS['corner_pos']} AS c FROM walk)",
    "lookup_stage1": _lookup(1, "digits"),
    "lookup_stage2": _lookup(2, "flags"),
    "lookup_stage3": _late_lookup(3),
    "lookup_stage4": _late_lookup(4),
    "lookup_buckets": _search(ORDER_PART, FIRST_PART)
    + "SELECT CASE WHEN l_orderkey % 7 <> 0 THEN 'p' || l_partkey END AS state, l_orderkey, l_linenumber,"
    " array_to_string(path, ' ') AS path"
    " FROM lineitem LEFT JOIN found ON node = 'p' || l_partkey AND l_orderkey % 7 <> 0",
    "replay_broken": _with(MOVES, EVENT_TOKENS, WALK, TOKEN_FACES, *_stage(1))
    + f"""SELECT k AS user_id, i, broken, array_to_string(applied, ' ') AS applied, {_state_text('z')}
FROM (SELECT v.k, v.i, v.broken, v.applied, {_fold('v.s', 'v.applied')} AS z
      FROM (SELECT w.k, w.i, w.s, w.i % 3 = 0 AND len(g.path) > 1 AS broken,
                   CASE WHEN w.i % 3 = 0 AND len(g.path) > 1 THEN ({_undo('g.path')})[1:len(g.path) - 2]
                        ELSE {_undo('g.path')} END AS applied
            FROM (SELECT *, {KEY['digits']} AS state FROM walk) w JOIN g1 g USING (state), tokenmap tm) v,
           tokenmap tm)""",
    "replay_stage1": _with(MOVES, EVENT_TOKENS, WALK, TOKEN_FACES, *_stage(1))
    + f"""SELECT k AS user_id, i, array_to_string(applied, ' ') AS applied, {_state_text('z')}
FROM (SELECT v.k, v.i, v.applied, {_fold('v.s', 'v.applied')} AS z
      FROM (SELECT w.k, w.i, w.s, {_undo('g.path')} AS applied
            FROM (SELECT *, {KEY['digits']} AS state FROM walk) w JOIN g1 g USING (state), tokenmap tm) v,
           tokenmap tm)""",
    "replay_trace": _with(MOVES, EVENT_TOKENS, WALK, LAST, TOKEN_FACES, *_stage(2))
    + f"""SELECT k AS user_id, step::INT AS step, applied[step] AS move, {_state_text('z')}
FROM (SELECT v.k, v.step, v.applied, {_fold('v.s', 'v.applied[1:v.step]')} AS z
      FROM (SELECT k, s, applied, unnest(range(0, len(applied) + 1)) AS step
            FROM (SELECT w.k, w.s, {_undo('g.path')} AS applied
                  FROM (SELECT *, {KEY['flags']} AS state FROM final) w JOIN g2 g USING (state), tokenmap tm)) v,
           tokenmap tm)""",
    "resolve_sequences": _resolve(),
    "resolve_trace": _resolve_trace(),
}
ORACLE["canonical_join"] = _with(
    MOVES,
    EVENT_TOKENS,
    WALK,
    LAST,
    _line_tokens("l_orderkey").replace("seq AS", "lseq AS"),
    WALK.replace("walk", "lwalk").replace("seq", "lseq"),
    LAST.replace("final", "lfinal").replace("walk", "lwalk"),
) + f"""SELECT canonical, user_id, corners, n_rows, n_keys
FROM (SELECT k AS user_id, array_to_string(c, '') AS corners, {CANONICAL} AS canonical
      FROM (SELECT k, {PARTS['corner_pos']} AS c FROM final)) u
JOIN (SELECT canonical, sum(n)::BIGINT AS n_rows, count(*) AS n_keys
      FROM (SELECT {CANONICAL} AS canonical, n
            FROM (SELECT {PARTS['corner_pos']} AS c, count(*) AS n FROM lfinal GROUP BY 1))
      GROUP BY canonical) z USING (canonical)"""
