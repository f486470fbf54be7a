"""The registered queries: each runs one operator over whole given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.functions.algebra import MOVE_FIELDS, STATE_FIELDS, TOKENS
from statewalk.functions.keys import digits
from statewalk.functions.successors import TextKeys
from statewalk.operators.fold import (
    concat_trace,
    explode_tokens,
    fold_events,
    fold_history,
    last_state,
)
from statewalk.operators.joins import lookup_join
from statewalk.operators.keyed import canonical_groups, class_sizes, key_states
from statewalk.operators.replay import lookup_paths, lookup_stored, replay_inverse, replay_trace, reverse_paths
from statewalk.operators.resolve import resolve_states, resolve_trace
from statewalk.operators.search import (
    bfs_paths as search_edges,
    bfs_states as search_states,
    dedupe_new,
    expand_edges,
    expand_n,
)
from statewalk.operators.transitions import (
    apply_transitions as turn_states,
    power_table,
    transition_table,
)
from statewalk.plans.stages import stage_table
from statewalk.sources import tables as t
from statewalk.sources.store import bucket_paths, cut, load_paths, save_paths, scratch_path

FULL_LAYOUT = [("corner", "pos"), ("edge", "pos"), ("corner", "ori"), ("edge", "ori")]


def _joined(columns: list[str]) -> list[Column]:
    return [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in columns]


def _path_text(found: DataFrame) -> DataFrame:
    return found.withColumn("path", F.array_join("path", ">"))


def _user_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_events(t.event_tokens(spark, sf_dir), "user_id", ["ts", "event_id"], "token")


def _user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_history(t.event_tokens(spark, sf_dir), "user_id", ["ts", "event_id"], "token")


# --- search over edge tables --------------------------------------------------


def bfs_paths(spark, sf_dir):
    return _path_text(
        search_edges(t.order_part_edges(spark, sf_dir), t.first_part(spark, sf_dir))
    )


def bfs_multi_source(spark, sf_dir):
    return _path_text(
        search_edges(t.trade_edges(spark, sf_dir), t.supplier_nodes(spark, sf_dir))
    )


def bfs_directed(spark, sf_dir):
    return _path_text(
        search_edges(
            t.supply_edges(spark, sf_dir), t.first_part(spark, sf_dir), directed=True
        )
    )


def bfs_level_histogram(spark, sf_dir):
    found = search_edges(t.trade_edges(spark, sf_dir), t.first_part(spark, sf_dir))
    return found.groupBy("distance").agg(F.count(F.lit(1)).alias("n_nodes"))


def _parts_frontier(spark, sf_dir):
    return t.part_nodes(spark, sf_dir).select("node", F.array("node").alias("path"))


def _part_order_edges(spark, sf_dir):
    return t.order_part_edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def expand_once(spark, sf_dir):
    return _path_text(
        expand_edges(_parts_frontier(spark, sf_dir), _part_order_edges(spark, sf_dir), 1)
    )


def expand_dedup(spark, sf_dir):
    frontier = _parts_frontier(spark, sf_dir)
    candidates = expand_edges(frontier, _part_order_edges(spark, sf_dir), 1).drop("distance")
    return _path_text(dedupe_new(candidates, frontier, "node", F.min("path").alias("path")))


def expand_two_pass(spark, sf_dir):
    return _path_text(expand_n(t.trade_edges(spark, sf_dir), t.customer_nodes(spark, sf_dir), 2))


def reverse_edge_paths(spark, sf_dir):
    found = search_edges(t.trade_edges(spark, sf_dir), t.first_part(spark, sf_dir))
    return _path_text(reverse_paths(found))


def stored_paths_roundtrip(spark, sf_dir):
    found = search_edges(t.trade_edges(spark, sf_dir), t.customer_nodes(spark, sf_dir))
    place = scratch_path(spark, "paths")
    save_paths(found.withColumnRenamed("node", "state"), place)
    return _path_text(load_paths(spark, place))


def lookup_nodes(spark, sf_dir):
    """Every line item with the path of its part from the smallest part."""
    paths = search_edges(t.order_part_edges(spark, sf_dir), t.first_part(spark, sf_dir))
    lines = t.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("state")
    )
    return _path_text(lookup_paths(lines, paths.withColumnRenamed("node", "state")))


def lookup_buckets(spark, sf_dir):
    """The same from paths stored in buckets, NULL keys for every seventh order among the entries."""
    paths = search_edges(t.order_part_edges(spark, sf_dir), t.first_part(spark, sf_dir))
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    lines = t.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, part).alias("state")
    )
    found = lookup_stored(lines, bucket_paths(paths.withColumnRenamed("node", "state")), how="left")
    return found.withColumn("path", F.array_join("path", " "))


# --- transitions --------------------------------------------------------------


def _supplier_operators(spark, sf_dir):
    order = [c for c in t.LINE_ORDER if c != "l_suppkey"]
    folded = fold_events(t.line_tokens(spark, sf_dir), "l_suppkey", order, "token")
    return folded.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("initial"),
        *[F.col(s).alias(m) for s, m in zip(STATE_FIELDS, MOVE_FIELDS)],
    )


def supplier_powers(spark, sf_dir):
    powers = power_table(_supplier_operators(spark, sf_dir), "initial")
    return powers.select("turns", "initial", "move", "reverse", *_joined(MOVE_FIELDS))


def apply_transitions(spark, sf_dir):
    """Each user's final state turned by every event of that user."""
    events = t.event_tokens(spark, sf_dir).select("user_id", "event_id", F.col("token").alias("move"))
    # written out: its size is measured before the join, and the join reads it
    states = lookup_join(events, cut(_user_states(spark, sf_dir)), "user_id")
    moves = transition_table(spark).select("move", *MOVE_FIELDS)
    turned = turn_states(states, moves, "move", small=True)
    return turned.select("event_id", "user_id", "move", *_joined(STATE_FIELDS))


def apply_with_nulls(spark, sf_dir):
    """The same where every third event lacks an array and every fifth its token: those give no row."""
    events = t.event_tokens(spark, sf_dir).select("user_id", "event_id", F.col("token").alias("move"))
    states = lookup_join(events, cut(_user_states(spark, sf_dir)), "user_id")
    states = states.withColumn("edge_ori", F.when(F.col("event_id") % 3 != 0, F.col("edge_ori")))
    states = states.withColumn("move", F.when(F.col("event_id") % 5 != 0, F.col("move")))
    moves = transition_table(spark).select("move", *MOVE_FIELDS)
    turned = turn_states(states, moves, "move", small=True)
    return turned.select("event_id", "user_id", "move", *_joined(STATE_FIELDS))


def bfs_states(spark, sf_dir):
    """Every state within two tokens of some user's final state."""
    seeds = key_states(_user_states(spark, sf_dir), "full").select("state")
    return _path_text(search_states(seeds, TextKeys(FULL_LAYOUT), TOKENS, 2))


# --- folds --------------------------------------------------------------------


def fold_user_events(spark, sf_dir):
    return _user_states(spark, sf_dir).select("user_id", *_joined(STATE_FIELDS), "n_tokens", "n_applied")


def fold_lineitem(spark, sf_dir):
    order = [c for c in t.LINE_ORDER if c != "l_orderkey"]
    folded = fold_events(t.line_tokens(spark, sf_dir), "l_orderkey", order, "token")
    return folded.select("l_orderkey", *_joined(STATE_FIELDS), "n_tokens", "n_applied")


def history(spark, sf_dir):
    return _user_history(spark, sf_dir).select("user_id", "i", "token", *_joined(STATE_FIELDS))


def last_per_key(spark, sf_dir):
    newest = last_state(_user_history(spark, sf_dir), "user_id")
    return newest.select("user_id", "i", "token", *_joined(STATE_FIELDS))


def last_turn(spark, sf_dir):
    turns = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return last_state(turns, "conv_id", "turn")


def concat_events(spark, sf_dir):
    events = t.event_tokens(spark, sf_dir)
    return concat_trace(events, "user_id", ["ts", "event_id"], "event_type")


def concat_roles(spark, sf_dir):
    turns = t.table(spark, sf_dir, "conversations")
    return concat_trace(turns, "conv_id", "turn", "role")


def explode_documents(spark, sf_dir):
    return explode_tokens(t.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def explode_turns(spark, sf_dir):
    turns = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return explode_tokens(turns, "text")


def explode_characters(spark, sf_dir):
    events = t.table(spark, sf_dir, "events").select("event_id", "event_type")
    return explode_tokens(events, "event_type", sep=None)


# --- keys ---------------------------------------------------------------------


def _key_counts(scheme):
    def run(spark, sf_dir):
        keyed = key_states(_user_history(spark, sf_dir), scheme)
        return keyed.groupBy("state").agg(F.count(F.lit(1)).alias("n_states"))

    return run


def _corner_history(spark, sf_dir):
    return _user_history(spark, sf_dir).select(
        "user_id", "i", digits(F.col("corner_pos")).alias("corners")
    )


def canonical_sizes(spark, sf_dir):
    return class_sizes(_corner_history(spark, sf_dir), "corners")


def canonical_rows(spark, sf_dir):
    return canonical_groups(_corner_history(spark, sf_dir), "corners")


def canonical_join(spark, sf_dir):
    """Every user's final corners with how many line-item states share their class."""
    users = _user_states(spark, sf_dir).select("user_id", digits(F.col("corner_pos")).alias("corners"))
    order = [c for c in t.LINE_ORDER if c != "l_orderkey"]
    lines = fold_events(t.line_tokens(spark, sf_dir), "l_orderkey", order, "token")
    sizes = class_sizes(lines.select(digits(F.col("corner_pos")).alias("corners")), "corners")
    # 8! arrangements fall into 2,520 classes, so the counts are few whatever the data
    return lookup_join(canonical_groups(users, "corners"), sizes, "canonical", small=True)


# --- lookup and replay --------------------------------------------------------


def _looked_up(stage, scheme):
    def run(spark, sf_dir):
        keyed = key_states(_user_history(spark, sf_dir), scheme)
        return lookup_paths(keyed, stage_table(spark, stage), small=True)

    return run


def _lookup_stage(stage, scheme):
    def run(spark, sf_dir):
        found = _looked_up(stage, scheme)(spark, sf_dir)
        return found.select("user_id", "i", "state", F.array_join("path", " ").alias("path"))

    return run


def _late_lookup(stage, scheme):
    """Every user's state on entering a late stage, with its path there."""

    def run(spark, sf_dir):
        before = {k: stage_table(spark, k) for k in range(1, stage)}
        states = _user_states(spark, sf_dir).drop("n_tokens", "n_applied")
        # the last step of the stage before is the state that enters this one
        trace = resolve_trace(states, before).where(F.col("stage") == stage - 1)
        entered = last_state(trace.drop("stage", "move"), "user_id", "step").drop("step")
        found = lookup_paths(key_states(entered, scheme), stage_table(spark, stage), small=True)
        return found.select("user_id", "state", F.array_join("path", " ").alias("path"))

    return run


def replay_broken(spark, sf_dir):
    """Paths of stage 1 with one token made unknown, undone as far as they go."""
    found = _looked_up(1, "digits")(spark, sf_dir).drop("token")
    spoilt = F.transform("path", lambda x, at: F.when((F.col("i") % 3 == 0) & (at == 1), F.lit("?")).otherwise(x))
    return replay_inverse(found.withColumn("path", spoilt), keep_broken=True).select(
        "user_id", "i", "broken", F.array_join("applied", " ").alias("applied"), *_joined(STATE_FIELDS)
    )


def replay_stage1(spark, sf_dir):
    found = _looked_up(1, "digits")(spark, sf_dir).drop("token")
    return replay_inverse(found).select(
        "user_id", "i", F.array_join("applied", " ").alias("applied"), *_joined(STATE_FIELDS)
    )


def replay_trace_stage2(spark, sf_dir):
    keyed = key_states(_user_states(spark, sf_dir), "flags")
    found = lookup_paths(keyed, stage_table(spark, 2), small=True).drop("n_tokens", "n_applied")
    return replay_trace(found).select("user_id", "step", "move", *_joined(STATE_FIELDS))


def _stage_tables(spark):
    return {k: stage_table(spark, k) for k in (1, 2, 3, 4)}


def resolve_sequences(spark, sf_dir):
    """Every user's events folded to a state, which is taken back to the start."""
    return resolve_states(_user_states(spark, sf_dir), _stage_tables(spark))


def trace_of_resolve(spark, sf_dir):
    """The same, step by step."""
    states = _user_states(spark, sf_dir).drop("n_tokens", "n_applied")
    found = resolve_trace(states, _stage_tables(spark))
    return found.select("user_id", "stage", "step", "move", *_joined(STATE_FIELDS))


QUERIES = {
    "bfs_paths": bfs_paths,
    "bfs_multi_source": bfs_multi_source,
    "bfs_directed": bfs_directed,
    "bfs_level_histogram": bfs_level_histogram,
    "expand_once": expand_once,
    "expand_dedup": expand_dedup,
    "expand_two_pass": expand_two_pass,
    "bfs_states": bfs_states,
    "stored_paths_roundtrip": stored_paths_roundtrip,
    "lookup_nodes": lookup_nodes,
    "lookup_buckets": lookup_buckets,
    "reverse_paths": reverse_edge_paths,
    "supplier_powers": supplier_powers,
    "apply_transitions": apply_transitions,
    "apply_with_nulls": apply_with_nulls,
    "fold_events": fold_user_events,
    "fold_lineitem": fold_lineitem,
    "fold_history": history,
    "last_per_key": last_per_key,
    "last_turn": last_turn,
    "concat_events": concat_events,
    "concat_roles": concat_roles,
    "explode_tokens": explode_documents,
    "explode_turns": explode_turns,
    "explode_characters": explode_characters,
    "key_digits": _key_counts("digits"),
    "key_flags": _key_counts("flags"),
    "key_buckets": _key_counts("buckets"),
    "key_hex": _key_counts("hex"),
    "canonical_classes": canonical_sizes,
    "canonical_rows": canonical_rows,
    "canonical_join": canonical_join,
    "lookup_stage1": _lookup_stage(1, "digits"),
    "lookup_stage2": _lookup_stage(2, "flags"),
    "lookup_stage3": _late_lookup(3, "buckets"),
    "lookup_stage4": _late_lookup(4, "hex"),
    "replay_stage1": replay_stage1,
    "replay_broken": replay_broken,
    "replay_trace": replay_trace_stage2,
    "resolve_sequences": resolve_sequences,
    "resolve_trace": trace_of_resolve,
}
