"""Chains of segments through the ordered buckets of a scene.

Scene ids count within a project, so a scene is always meant by project and scene id. Its
assignments come from its candidate pool, so the nodes of one scene are bounded by the pool
size, whatever the number of scenes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolake.functions import scalars as s
from kinolake.operators import ordering as o
from kinolake.operators.describe import rating_or_good
from kinolake.settings import EDITOR, VELOCITY_CHANNELS

# Paths examined per wanted chain, and widenings of the duration range.
PATHS_PER_CHAIN, WIDENINGS, WIDENING_FACTOR = 10, 3, 1.2

SCENE = ("project", "scene_id")
SEGMENT_FIELDS = ("start", "end", "video_file", "rating",
                  *[f"{c}_{k}" for c in VELOCITY_CHANNELS for k in ("entry_vel", "exit_vel", "std_deriv", "monotonicity")])


def _velocity(prefix: str, edge: str) -> list[Column]:
    return [F.col(f"{prefix}{c}_{edge}_vel") for c in VELOCITY_CHANNELS]


def segment_penalty(settings=EDITOR) -> Column:
    return s.penalty_from_stats([F.col(f"{c}_std_deriv") for c in VELOCITY_CHANNELS],
                                [F.col(f"{c}_monotonicity") for c in VELOCITY_CHANNELS], settings.w3, settings.w4)


def step_cost(out_prefix: str, settings=EDITOR) -> Column:
    """Cost of entering the row's segment from the one whose exit velocity has the prefix."""
    kinematic = s.kinematic_cost(_velocity(out_prefix, "exit"), _velocity("", "entry"), settings.w1, settings.w2)
    return s.total_cost(kinematic, segment_penalty(settings), F.col("narrative_score"), rating_or_good(F.col("rating")), settings.w5)


def scene_nodes(assignments: DataFrame, segments: DataFrame) -> DataFrame:
    """Known segments of each bucket with the bucket's rank among the scene's buckets.

    Ranks come from the assignments alone: a bucket of only unknown segments keeps its
    rank and so disconnects the scene. A repeated assignment counts once, the last one.
    """
    scene = Window.partitionBy(*SCENE)
    rows = assignments.repartition(*SCENE)  # one exchange serves all three windows
    repeated = Window.partitionBy(*SCENE, "bucket_idx", "segment_id").orderBy(F.desc("seq"))
    rows = rows.withColumn("_r", F.row_number().over(repeated)).filter("_r = 1").drop("_r", "seq")
    rows = rows.withColumn("rank", F.dense_rank().over(scene.orderBy("bucket_idx")))
    rows = rows.withColumn("last_rank", F.max("rank").over(scene))
    return rows.join(segments.select("segment_id", *SEGMENT_FIELDS), "segment_id")


def bucket_edges(nodes: DataFrame, settings=EDITOR) -> DataFrame:
    """Pairs from each bucket to the next present bucket of the scene, with their cost."""
    source = nodes.select(*SCENE, (F.col("rank") + 1).alias("rank"), F.col("segment_id").alias("from_id"),
                          F.col("bucket_idx").alias("from_bucket"),
                          *[F.col(f"{c}_exit_vel").alias(f"_out_{c}_exit_vel") for c in VELOCITY_CHANNELS])
    pairs = nodes.join(source, [*SCENE, "rank"])
    return pairs.select(*SCENE, "rank", "last_rank", "from_id", "from_bucket", "segment_id", "bucket_idx",
                        "start", "end", "video_file", step_cost("_out_", settings).alias("cost"))


def scene_layers(assignments: DataFrame, segments: DataFrame, targets: DataFrame, settings=EDITOR) -> DataFrame:
    """One row per scene: its nodes by bucket in order (``layers``), its assignments (``rows``) and its ``targets``.

    Assignments meet their segment first and then travel once, by scene, with what the costs read of it; all further
    steps work inside the scene's row. ``files`` has what links alone read, at the place ``at`` of a node, and
    does not travel where links are not asked for. An unknown segment has no ``copy``, one that is listed
    several times is as many nodes.
    """
    number = F.row_number().over(Window.partitionBy("segment_id").orderBy("segment_id")).alias("copy")
    facts = segments.select(
        "segment_id", number, *[f"{c}_{edge}_vel" for edge in ("entry", "exit") for c in VELOCITY_CHANNELS],
        segment_penalty(settings).alias("penalty"), s.quality_multiplier(rating_or_good(F.col("rating"))).alias("multiplier"),
        "start", "end", "video_file")
    known = [c for c in facts.columns if c not in ("segment_id", "copy", "video_file")]
    order = ("bucket_idx", "segment_id", "copy", "seq", "narrative_score")
    rows = assignments.select(*SCENE, "bucket_idx", "segment_id", "seq", "narrative_score").filter(_keyed())
    rows = rows.join(facts, "segment_id", "left").withColumn("_assigned", F.lit(True))
    rows = rows.unionByName(targets.select(*SCENE, "min", "max", "ideal").filter(_keyed()), allowMissingColumns=True)
    assigned = lambda *names: F.collect_list(F.when(F.col("_assigned"), F.struct(*names)))
    # bound by CPU, not by bytes: small partitions are not merged
    scenes = o.by_series(rows, *SCENE).groupBy(*SCENE).agg(
        assigned(*order, *known).alias("_rows"), assigned("video_file").alias("files"),
        F.collect_list(F.when(F.col("_assigned").isNull(), F.struct("min", "max", "ideal"))).alias("targets"))
    scenes = scenes.filter((F.size("_rows") > 0) & (F.size("targets") > 0))
    placed = F.sort_array(F.transform("_rows", lambda x, i: F.struct(
        *[x[c].alias(c) for c in order], i.alias("at"), *[x[c].alias(c) for c in known])))

    def layers(rows: Column) -> Column:
        # a repeated assignment counts once, the last one
        following = lambda x, y: y.isNotNull() & reduce(lambda p, q: p & q, [x[c].eqNullSafe(y[c]) for c in order[:3]])
        nodes = F.filter(rows, lambda x, i: x["copy"].isNotNull() & ~following(x, F.get(rows, i + 1)))
        buckets = F.array_distinct(F.transform(rows, lambda x: x["bucket_idx"]))
        return let(nodes, lambda kept: F.transform(buckets, lambda b: F.filter(kept, lambda x: x["bucket_idx"].eqNullSafe(b))))

    both = let(placed, lambda rows: F.struct(rows.alias("rows"), layers(rows).alias("layers")))
    return scenes.select(*SCENE, both.alias("_b"), "files", "targets").select(*SCENE, "_b.rows", "_b.layers", "files", "targets")


def _keyed() -> Column:
    """A scene without its keys meets no target."""
    return reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in SCENE])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _entry_cost(a: Column, b: Column, settings, narrative: Column | None = None) -> Column:
    """As :func:`step_cost`: entering node ``b`` from node ``a``."""
    kinematic = s.kinematic_cost([a[f"{c}_exit_vel"] for c in VELOCITY_CHANNELS], [b[f"{c}_entry_vel"] for c in VELOCITY_CHANNELS],
                                 settings.w1, settings.w2)
    narrative = b["narrative_score"] if narrative is None else narrative
    return s.weighted_cost(kinematic, b["penalty"], narrative, b["multiplier"], settings.w5)


def cheapest_paths(layers: Column, keep: int, settings=EDITOR) -> Column:
    """The ``keep`` cheapest full paths of a scene: ``total_cost``, ``ids`` in order, ``total_duration``; cheapest first.

    Layer by layer, the cheapest partial paths into each segment are extended. With layered
    edges a full path among the cheapest has only such prefixes, so none is missed. Equal
    costs are ordered by segment ids. A partial path is its ids and two sums.
    """
    def path(cost: Column, ids: Column, duration: Column, last: Column) -> Column:
        return F.struct(cost.alias("total_cost"), ids.alias("ids"), duration.alias("total_duration"), last.alias("last"))

    def first(x: Column) -> Column:
        nothing = F.when(x["copy"].isNotNull(), F.lit(0.0))  # of a type that may be null, as later costs may
        return path(nothing, F.array(x["segment_id"]), x["end"] - x["start"], x["segment_id"])

    def into(b: Column, state: Column) -> Column:
        """Paths into node ``b`` from all nodes of the layer before."""
        edges = F.transform(state["layer"], lambda a: F.struct(a["segment_id"].alias("from_id"), _entry_cost(a, b, settings).alias("cost")))
        return F.flatten(F.transform(edges, lambda e: F.transform(
            F.filter(state["paths"], lambda p: p["last"] == e["from_id"]),
            lambda p: path(p["total_cost"] + e["cost"], F.concat(p["ids"], F.array(b["segment_id"])),
                           p["total_duration"] + (b["end"] - b["start"]), b["segment_id"]))))

    def step(state: Column, layer: Column) -> Column:
        best = lambda i: F.slice(F.sort_array(F.flatten(F.transform(
            F.filter(layer, lambda x: x["segment_id"] == i), lambda b: into(b, state)))), 1, keep)
        ids = F.array_distinct(F.transform(layer, lambda x: x["segment_id"]))
        return F.struct(layer.alias("layer"), F.flatten(F.transform(ids, best)).alias("paths"))

    start = let(F.get(layers, F.lit(0)), lambda layer: F.struct(layer.alias("layer"), F.transform(layer, first).alias("paths")))
    later = F.slice(layers, F.lit(2), F.size(layers))
    return F.slice(F.sort_array(F.aggregate(later, start, step, lambda state: state["paths"])), 1, keep)


def accept_chains(paths: Column, targets: Column, k: int = EDITOR.chains_per_scene) -> Column:
    """Of a scene's paths the first k within its duration range, nearest to the ideal first.

    A range without any path is widened in steps around its middle; the first step that
    holds a path decides.
    """
    def leveled(p: Column, i: Column, t: Column) -> Column:
        middle, half = (t["min"] + t["max"]) / 2, (t["max"] - t["min"]) / 2
        duration = p["total_duration"]
        level = F.when((duration >= t["min"]) & (duration <= t["max"]), F.lit(0))
        for step in range(1, WIDENINGS + 1):
            reach = half * WIDENING_FACTOR ** step
            level = level.when((duration >= middle - reach) & (duration <= middle + reach), F.lit(step))
        return F.struct(level.alias("level"), i.alias("path_no"), F.abs(duration - t["ideal"]).alias("duration_delta"),
                        p["total_cost"].alias("total_cost"), duration.alias("total_duration"), p["ids"].alias("ids"))

    within = F.flatten(F.transform(targets, lambda t: F.transform(paths, lambda p, i: leveled(p, i, t))))
    ranked = F.sort_array(F.filter(within, lambda x: x["level"].isNotNull()))
    taken = let(ranked, lambda rows: F.slice(F.filter(rows, lambda x: x["level"] == F.get(rows, F.lit(0))["level"]), 1, k))
    facts = ("duration_delta", "path_no", "total_cost", "total_duration", "ids")
    return F.sort_array(F.transform(taken, lambda x: F.struct(*[x[c].alias(c) for c in facts])))


def _link(x: Column, cost: Column, *order: str) -> Column:
    return F.struct(*[x[c].alias(c) for c in order], x["start"].alias("start"), x["end"].alias("end"), cost.alias("edge_cost"), x["at"].alias("at"))


def with_links(ids: Column, layers: Column, settings=EDITOR) -> Column:
    """Links in full in place of the segment ids of a path."""
    def links(i: Column, at: Column) -> Column:
        link = lambda b, cost: _link(b, cost, "segment_id", "bucket_idx")
        nodes = lambda place, which: F.filter(F.get(layers, place), lambda x: x["segment_id"] == which)
        before = F.when(at > 0, nodes(at - 1, F.get(ids, at - 1)))
        return F.sort_array(F.flatten(F.transform(nodes(at, i), lambda b: F.coalesce(
            F.transform(before, lambda a: link(b, _entry_cost(a, b, settings))), F.array(link(b, F.lit(0.0)))))))
    return F.flatten(F.transform(ids, links))


def _sum(values: Column) -> Column:
    """Sum of the values that are not null; null without any."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda held, x: F.coalesce(held + x, held, x))


def greedy_links(rows: Column, layers: Column, settings=EDITOR) -> Column:
    """Links of the highest narrative score of each bucket, the first on a tie.

    The winner is chosen before it is looked up, so an unknown winner leaves its bucket out.
    """
    best = F.sort_array(F.transform(rows, lambda x: F.struct(
        x["bucket_idx"].alias("bucket_idx"), x["narrative_score"].alias("narrative_score"), (-x["seq"]).alias("place"), x["segment_id"].alias("segment_id"))))

    def winners(best: Column) -> Column:
        higher = lambda x, y: F.coalesce(y["bucket_idx"].eqNullSafe(x["bucket_idx"]) & y.isNotNull(), F.lit(False))
        return F.filter(best, lambda x, i: ~higher(x, F.get(best, i + 1)))

    def entries(won: Column, i: Column) -> Column:
        found = F.filter(F.get(layers, i), lambda x: x["segment_id"] == won["segment_id"])
        return F.transform(found, lambda x: F.struct(x.alias("node"), won["narrative_score"].alias("narrative_score")))

    def linked(entries: Column) -> Column:
        def cost(b: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(entries, i - 1)["node"])
            return F.when(before[f"{VELOCITY_CHANNELS[0]}_exit_vel"].isNull(), F.lit(0.0)).otherwise(
                _entry_cost(before, b["node"], settings, b["narrative_score"]))
        return F.transform(entries, lambda b, i: _link(b["node"], cost(b, i), "bucket_idx", "segment_id"))

    return F.sort_array(let(F.flatten(F.transform(let(best, winners), entries)), linked))


CHAIN_FACTS = ("total_cost", "total_duration", "duration_delta")


def _chain(number: Column, facts: Sequence[Column], steps: Column, origin: str) -> Column:
    places = F.transform(steps, lambda x: F.struct(*[x[c].alias(c) for c in ("segment_id", "bucket_idx", "start", "end", "edge_cost", "at")]))
    return F.struct(number.cast("int").alias("chain_no"), *[c.alias(name) for c, name in zip(facts, CHAIN_FACTS)],
                    places.alias("steps"), F.lit(origin).alias("origin"))


def _greedy(rows: Column, layers: Column, targets: Column, settings) -> Column:
    """Greedy chains of a scene, one for each of its targets; none without a link."""
    def chains(steps: Column) -> Column:
        cost, duration = _sum(F.transform(steps, lambda x: x["edge_cost"])), _sum(F.transform(steps, lambda x: x["end"] - x["start"]))
        return F.transform(F.filter(targets, lambda t: F.size(steps) > 0), lambda t: _chain(
            F.lit(0), (cost, duration, F.abs(duration - t["ideal"])), steps, "greedy"))
    return let(greedy_links(rows, layers, settings), chains)


def _unfold(scenes: DataFrame, chains: Column) -> DataFrame:
    """One row per chain; ``segment_ids`` are those of its links, for readers that need no more of them."""
    rows = scenes.select(*SCENE, "files", F.explode(chains).alias("_c")).select(*SCENE, "files", "_c.*")
    link = lambda x: F.struct(*[x[c].alias(c) for c in ("segment_id", "bucket_idx", "start", "end")],
                              F.get("files", x["at"])["video_file"].alias("video_file"), x["edge_cost"].alias("edge_cost"))
    return rows.select(*SCENE, "chain_no", *CHAIN_FACTS, F.transform("steps", link).alias("links"),
                       F.transform("steps", lambda x: x["segment_id"]).alias("segment_ids"), "origin")


def greedy_chains(assignments: DataFrame, segments: DataFrame, targets: DataFrame, settings=EDITOR) -> DataFrame:
    """One chain per scene: the highest narrative score of each bucket, the first on a tie."""
    scenes = scene_layers(assignments, segments, targets, settings)
    return _unfold(scenes, _greedy(F.col("rows"), F.col("layers"), F.col("targets"), settings))


def find_chains(assignments: DataFrame, segments: DataFrame, targets: DataFrame, settings=EDITOR) -> DataFrame:
    """Cheapest chains per scene under its duration target, else one greedy chain."""
    k = settings.chains_per_scene
    rows, layers, ranges = F.col("rows"), F.col("layers"), F.col("targets")
    accepted = let(cheapest_paths(layers, k * PATHS_PER_CHAIN, settings), lambda paths: accept_chains(paths, ranges, k))
    linked = lambda x, i: _chain(i, [x[c] for c in CHAIN_FACTS], with_links(x["ids"], layers, settings), "path")
    chains = let(accepted, lambda found: F.when(F.size(found) > 0, F.transform(found, linked)).otherwise(
        _greedy(rows, layers, ranges, settings)))
    return _unfold(scene_layers(assignments, segments, targets, settings), chains)


def chain_links(chains: DataFrame) -> DataFrame:
    """One row per link of each chain, with its place."""
    return chains.select(*SCENE, "chain_no", F.posexplode("links").alias("link_pos", "_l")).select(
        *SCENE, "chain_no", "link_pos", "_l.*")


def clamp_selection(index: Column, override: Column, chains: Column) -> Column:
    """Selected chain index: an override wins; limited to the chains there are."""
    return F.greatest(F.lit(0), F.least(F.coalesce(override, index), chains - 1))


def selected_chain(scenes: DataFrame, chains: DataFrame, selections: DataFrame) -> DataFrame:
    """Chain chosen per scene: index out of range takes the first; no selection gives null.

    ``selections``: project, scene_id, chain_index, override_index. ``chains``: project, scene_id, chain_no, …
    """
    picked = selections.select(*SCENE, F.coalesce("override_index", "chain_index").alias("_want"))
    counted = chains.withColumn("_chains", F.count(F.lit(1)).over(Window.partitionBy(*SCENE)))
    rows = scenes.join(picked, [*SCENE], "left").join(counted, [*SCENE], "left")
    want = F.col("_want")
    pick = F.when((want >= 0) & (want < F.col("_chains")), want).otherwise(F.lit(0))
    rows = rows.filter(F.col("chain_no").isNull() | (F.col("chain_no") == pick))
    facts = {c: F.when(want.isNotNull(), F.col(c)) for c in chains.columns if c not in (*SCENE, "chain_no")}
    facts["chain_no"] = F.when(want.isNotNull(), F.coalesce("chain_no", F.lit(0))).cast("int")
    return rows.withColumns(facts).drop("_want", "_chains")


def only_scenes(df: DataFrame, flagged: DataFrame | None) -> DataFrame:
    """Restrict a reassembly to the flagged scenes (project, scene_id); None redoes all."""
    return df if flagged is None else df.join(flagged.select(*SCENE).distinct(), [*SCENE], "left_semi")
