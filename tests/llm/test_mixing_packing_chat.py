import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kinolake.llm.chat_perspectives import loss_mask, rotate_perspectives
from kinolake.llm.mixing import fill_targets, mix_sources, route
from kinolake.llm.packing import pack_documents


def test_targets_are_capped_and_reshared():
    assert [float(t) for t in fill_targets([10, 100, 100], [5, 2, 1], 3)] == [30, 120, 60]
    assert sum(fill_targets([1, 2, 300, 7], [5, 2, 1, 5], 3)) == 310
    assert fill_targets([0, 0], [5, 2], 3) == [0, 0] and fill_targets([], [], 3) == []


def best_cost(supply, members, quotas, most):
    """Fewest words left unfilled, then least repetition, over all supplies of the patterns."""
    def fits(amounts):
        # Hall's condition over all sets of patterns
        n = len(supply)
        return all(sum(amounts[p] for p in range(n) if s >> p & 1)
                   <= sum(quotas[q] for q in {m for p in range(n) if s >> p & 1 for m in members[p]})
                   for s in range(1 << n))
    best = None
    def walk(p, amounts):
        nonlocal best
        if p == len(supply):
            if fits(amounts):
                cost = sum(sum(max(0, a - k * s) for k in range(1, most)) for a, s in zip(amounts, supply))
                key = (-sum(amounts), cost)
                best = key if best is None else min(best, key)
            return
        for a in range(most * supply[p] + 1):
            walk(p + 1, amounts + [a])
    walk(0, [])
    return best


def test_flow_is_largest_with_least_repetition():
    rng = random.Random(6)
    for _ in range(40):
        members = [sorted(rng.sample(range(3), rng.randint(1, 3))) for _ in range(3)]
        supply, quotas = [rng.randint(0, 3) for _ in range(3)], [rng.randint(0, 6) for _ in range(3)]
        flow = route(supply, members, quotas, 3)
        amounts = [sum(f) for f in flow]
        into = Counter()
        for m, f in zip(members, flow):
            for s, words in zip(m, f):
                into[s] += words
        assert all(into[s] <= q for s, q in enumerate(quotas)) and all(a <= 3 * s for a, s in zip(amounts, supply))
        cost = sum(sum(max(0, a - k * s) for k in (1, 2)) for a, s in zip(amounts, supply))
        assert (-sum(amounts), cost) == best_cost(supply, members, quotas, 3)


def mixed_rows():
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", None, "é"])) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "x " * 9, "tiny"), (1003, "y\t\ny", "Zero"), (5, "w w", "b"),
             (None, "n n n", "b"), (None, "n n n", "b")]
    return rows


def test_mix_meets_targets_and_repeats_itself(spark):
    frame = spark.createDataFrame(mixed_rows(), "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    mixed, plan = mix_sources(frame)
    assert mixed.columns == ["doc_id", "text", "source", "size", "taken"]
    rows, plan = mixed.collect(), {r.source: r for r in plan.collect()}
    assert len(rows) == 907
    assert list(plan) == ["Zero", "a", "b", "tiny", "é", None]
    total = sum(r.size for r in rows)
    assert abs(sum(r.target for r in plan.values()) - total) < 1e-6
    for name, p in plan.items():
        mine = [r for r in rows if r.source == name]
        assert sum(r.size for r in mine) == p.source_size
        assert abs(sum(r.taken for r in mine) - p.target) <= max(r.size for r in mine) / 2 + 1
    assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0 for r in rows)
    again = mix_sources(frame.repartition(7))[0].collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    empty, none = mix_sources(frame.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_overlapping_sources_share_words(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["b"]) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    mixed, plan = mix_sources(frame, weights=(1,), sources=F.col("tags"))
    plan = {r.source: r.routed for r in plan.collect()}
    assert abs(plan["a"] - 2000) <= 1 and abs(plan["b"] - 2000) <= 1
    assert abs(mixed.agg(F.sum("taken")).first()[0] - 4000) <= 20
    assert mixed.agg(F.max("taken")).first()[0] == 10


def packable(seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 5, 40, 90, 250, 1000]), rng.choice(["hot", "hot", "a", "b", None]),
             rng.choice([None, 1, 2, i + 10])) for i in range(600)]
    return rows + [(None, 7, "a", 1), (None, 7, "a", 1), (3, None, "b", 2)]


def test_bins_keep_every_rule_and_every_word(spark):
    frame = spark.createDataFrame(packable(), "doc_id long, size long, source string, cluster long")
    for shard_rows in (100, 4096):
        got = pack_documents(frame.withColumn("bin_id", F.lit(1)), 100, shard_rows).collect()
        bins, pieces = defaultdict(list), Counter()
        for r in got:
            bins[r.bin_id].append(r)
            pieces[r.doc_id, r.source, r.cluster] += r.length
        want = Counter()
        for i, size, source, cluster in packable():
            want[i, source, cluster] += size or 0
        assert pieces == want
        for rows in bins.values():
            rows.sort(key=lambda r: (r.bin_offset, r.length))
            assert sum(r.length for r in rows) <= 100 and len({r.source for r in rows}) == len(rows)
            clusters = [r.cluster for r in rows if r.cluster is not None]
            assert len(set(clusters)) == len(clusters)
            assert all(a.bin_offset + a.length == b.bin_offset for a, b in zip(rows, rows[1:]))
    assert pack_documents(frame.limit(0)).count() == 0


def test_equal_rows_are_dealt_to_all_shards(spark):
    rows = [(7, 40, "hot", None)] * 3000 + [(i, 30, "b", None) for i in range(100, 1100)]
    frame = spark.createDataFrame(rows, "doc_id long, size long, source string, cluster long")
    got = pack_documents(frame, 100, 100).collect()
    shards = Counter(r.bin_id >> 32 for r in got)
    assert len(got) == 4000 and len(shards) == 40 and max(shards.values()) < 250
    assert Counter((r.bin_id, r.source) for r in got).most_common(1)[0][1] == 1


def test_bins_match_plain_best_fit(spark):
    rows = packable(4)
    frame = spark.createDataFrame(rows, "doc_id long, size long, source string, cluster long")
    got = pack_documents(frame, 300, 10**6)
    items = sorted(({"d": i, "n": n or 0, "s": s, "c": c} for i, n, s, c in rows),
                   key=lambda r: (-(r["n"] % 300), r["d"] is None, r["d"] or 0, r["s"] or "", r["n"]))
    bins, full = [], 0
    for item in items:
        full += item["n"] // 300
        rest = item["n"] % 300
        if not rest and item["n"]:
            continue
        fit = [b for b in bins if b["room"] >= rest and item["s"] not in b["s"]
               and (item["c"] is None or item["c"] not in b["c"])]
        b = min(fit, key=lambda b: (b["room"], b["at"])) if fit else {"room": 300, "s": set(), "c": set(), "at": len(bins)}
        if not fit:
            bins.append(b)
        b["room"] -= rest
        b["s"].add(item["s"])
        b["c"].add(item["c"])
    assert got.select("bin_id").distinct().count() == len(bins) + full


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "ü"),
            (2, 0, "system", "only"), (None, 0, "ann", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit(1))
    got = rotate_perspectives(frame).withColumn("mask", loss_mask(F.col("rendered"), F.col("mask_start"), F.col("mask_length")))
    rows = got.orderBy("conv_id", "perspective", "turn").collect()
    assert Counter((r.conv_id, r.perspective) for r in rows) == {
        (1, "ann"): 5, (1, "bob"): 5, (1, "unknown"): 5, (None, "ann"): 1}
    for r in rows:
        assert len(r["mask"]) == len(r.rendered)
        learnt = "".join(c for c, m in zip(r.rendered, r["mask"]) if m == "1")
        assert (r.role == "assistant") == (r.speaker == r.perspective) == bool(learnt)
        assert not learnt or re.fullmatch(r"(hi|ü|)<\|im_end\|>", learnt)
    one = [r.rendered for r in rows if r.perspective == "bob" and r.turn < 2]
    assert one == ["<|im_start|>system\nrules<|im_end|>\n", "<|im_start|>user name=ann\nhi<|im_end|>\n"]
    assert rotate_perspectives(frame.limit(0)).count() == 0
