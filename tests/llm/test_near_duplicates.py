import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kinolake.llm import near_copies
from kinolake.llm.components import connected_components
from kinolake.llm.embedding_dedup import link_vectors
from kinolake.llm.gray_index import GrayIndex, gray_rank
from kinolake.llm.near_copies import drop_near_copies
from kinolake.llm.simhash_dedup import fingerprint_links, group_near_duplicates, simhash
from kinolake.llm.vector_search import nearest
from kinolake.session import in_buckets


def labels_of(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    links += [(i, i + 1) for i in range(400, 470)] + [(900, x) for x in range(901, 990)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    nodes = {x for pair in real for x in pair}
    assert got == labels_of(nodes, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gray_rank_is_the_reflected_order():
    codes = [i ^ (i >> 1) for i in range(1000)]
    assert gray_rank(np.array(codes, np.uint64)).tolist() == list(range(1000))


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)),
                             np.arange(120, dtype=np.uint64)])
    group = np.sort(rng.integers(0, 3, len(values)))
    order = np.lexsort((gray_rank(values), group))
    values, group = values[order], group[order]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for distance in (0, 1, 2, 5):
        got = {p for a, b in GrayIndex(values, starts).links(distance) for p in zip(a.tolist(), b.tolist())}
        want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if group[i] == group[j]
                and int(values[i] ^ values[j]).bit_count() <= distance}
        assert got == want


def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_match_brute_force(docs):
    rng = random.Random(9)
    words = ["Wort" + str(i) for i in range(200)] + ["ÄB", "z"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 80, 300])))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + rng.choice(["", " z", "\n\nÄB"])) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (302, " \t\n"), (303, "A"), (304, "a")]
    got = sorted(map(tuple, group_near_duplicates(docs(rows)).collect()))
    prints = {(i, t): slow_simhash(t) for i, t in rows}
    links = [(a[0], b[0]) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2]
    label = labels_of({i for i, _ in rows}, links)
    signed = [(i, int(np.uint64(prints[i, t]).astype(np.int64)), label[i]) for i, t in rows]
    assert got == sorted(signed)
    assert group_near_duplicates(docs([])).count() == 0


def test_large_keys_are_split_without_loss(spark):
    rng = random.Random(3)
    values = {sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)}
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    frame = spark.createDataFrame(signed, "fingerprint long")
    want = labels_of(values, [(a, b) for a in values for b in values if (a ^ b).bit_count() <= 2])
    sizes = sorted(list(want.values()).count(x) for x in set(want.values()))
    for large in (4096, 5):
        got = connected_components(fingerprint_links(frame, 2, large)).groupBy("component").count().collect()
        assert sorted([r["count"] for r in got] + [1] * (len(values) - sum(r["count"] for r in got))) == sizes


def test_simhash_of_long_text_is_cut_into_steps():
    text = " ".join(f"w{i % 977}" for i in range(140000)).encode()
    assert simhash(text) == slow_simhash(text.decode())


def vectors(seed=1, n=400, size=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, size))
    base[:150] = base[0] + 0.04 * rng.standard_normal((150, size))
    base[200:230] = base[200]
    return base


def odd_rows(size):
    return [(9000, None), (9001, []), (9002, [0.0] * size), (9003, [float("nan")] * size),
            (9004, [float("inf")] + [1.0] * (size - 1)), (9005, [None] + [1.0] * (size - 1)), (None, [1.0] * size),
            (9006, [1.0, 2.0]), (9007, [2.0, 4.0])]


def test_links_match_brute_force(spark):
    base = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + odd_rows(24)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(frame, chunk=300, window=128).collect()}
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = labels_of(range(len(base)), np.argwhere(near).tolist())
    assert {i: got[i][1:] for i in range(len(base))} == {i: (label[i], label[i] == i) for i in range(len(base))}
    links = np.array([got[i][0] for i in range(len(base))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum()
    assert (links[200:230] == near.sum(1)[200:230]).all()
    for i in range(9000, 9006):
        assert got[i] == (0, i, True)
    assert got[9006] == (1, 9006, True) and got[9007] == (1, 9006, False) and got[None] == (0, None, True)


def test_search_recall_and_order(spark):
    base = vectors(5, 700, 70)
    base[300:340] = base[20]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + odd_rows(70)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(frame, frame.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    hits = 0
    for q in range(0, 700, 20):
        scores = (base * base[q]).sum(1)
        scores[q] = -np.inf
        want = np.lexsort((np.arange(700), -scores))[:20]
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        assert all(abs(scores[i] - s) < 1e-9 for i, s in got[q])
        hits += len(set(want.tolist()) & {i for i, _ in got[q]})
    assert hits >= 0.98 * 20 * 35 and set(got) == set(range(0, 700, 20))
    assert nearest(frame.limit(0), frame).count() == 0
    assert nearest(frame.where("vec_id < 3"), frame.where("vec_id = 0")).count() == 2


def test_near_copies_are_linked_and_confirmed(spark):
    rng = random.Random(8)
    words = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "rst", "tz", "", "pf")]
    rows = []
    for i in range(30):
        text = [rng.choice(words) for _ in range(rng.randint(80, 400))]
        rows.append((10 * i, " ".join(text)))
        for j in range(1, i % 4):  # copies of copies, each one word further
            text[rng.randrange(len(text))] = "neu"
            rows.append((10 * i + j, " ".join(text).upper() if j == 1 else " ".join(text)))
        rng.shuffle(text)
        rows.append((10 * i + 9, " ".join(text)))  # the same words in another order: alike in every view, but no copy
    rows += [(5000, None), (5001, ""), (5002, " "), (None, rows[0][1] + " ende"), (5003, "ein paar"), (5004, "ein paar")]
    docs = spark.createDataFrame([(k, i, t, "x") for k, (i, t) in enumerate(rows)], "k long, doc_id long, text string, fingerprint string")
    kept = drop_near_copies(docs, "k").collect()

    def parts(text):
        w = (text or "").lower().split()
        return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [parts(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    want = {min((k for k in range(len(rows)) if label[k] == v), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)) for v in set(label)}
    assert len(want) < len(rows) - 15 and {r.k for r in kept} == want
    assert kept[0].asDict().keys() == {"k", "doc_id", "text", "fingerprint"}
    assert drop_near_copies(docs.limit(0), "k").count() == 0


def test_near_copies_that_share_no_leader_are_found(spark):
    """Texts of the same different words share every view, but only some of them are alike."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for g in range(4):
        words = rng.sample(words, len(words))
        for j in range(3):
            text = list(words)
            for k in range(j):
                text[10 * k], text[10 * k + 1] = text[10 * k + 1], text[10 * k]
            rows.append((len(rows), " ".join(text), 100 - len(rows)))
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, k long"), "k").collect()

    def parts(text):
        w = text.split()
        return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = {r[0]: parts(r[1]) for r in rows}
    label = labels_of(sets, [(a, b) for a in sets for b in sets
                             if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert sorted(r["doc_id"] for r in kept) == sorted(set(label.values())) == [0, 3, 6, 9]


def test_links_of_groups_wider_than_a_window_are_all_counted(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 16))
    base[:200] = base[0] + 0.05 * rng.standard_normal((200, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in link_vectors(frame, chunk=90, window=8).collect()}
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    assert got == dict(enumerate(((unit @ unit.T >= 0.95).sum(1) - 1).tolist()))


def test_only_texts_that_meet_a_candidate_travel(spark, capsys):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["x"])), (3, " ".join(words[::-1])), (4, None), (5, " ".join(words))]
    kept = in_buckets(spark.createDataFrame(rows, "k long, text string").repartition(4, "k"), "k", 4, "met-texts")
    assert sorted(map(tuple, kept.collect())) == rows
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "a long, b long")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = near_copies._alike(pairs, kept.select(F.col("k").alias(near_copies.KEY), "text"), 0.8, 5)
        found.explain("formatted")
        assert [tuple(r) for r in found.collect()] == [(2, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", capsys.readouterr().out)
    assert moved and not any("text#" in columns for columns in moved)


def test_large_groups_are_compared_without_a_row_per_pair(spark, monkeypatch):
    """Texts of the same different words, a quarter of each in another order: all meet in one group, few are alike."""
    rng = random.Random(14)
    words = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        text = list(words)
        cut = rng.randrange(60)
        part = text[cut:cut + 26]
        rng.shuffle(part)
        text[cut:cut + 26] = part
        rows.append((2 * i, " ".join(text)))
        if i % 4 == 0:  # an alike pair: two words change places
            at = rng.randrange(89)
            text[at], text[at + 1] = text[at + 1], text[at]
            rows.append((2 * i + 1, " ".join(text)))

    def parts(text):
        w = text.split()
        return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = {k: parts(t) for k, t in rows}
    label = labels_of(sets, [(a, b) for a in sets for b in sets if a > b
                             and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.col("doc_id"))
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", (8 << 10, 64 << 10))  # 16 blocks, also on one machine
    made, alike = [], near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, *rest: made.append(pairs.count()) or alike(pairs, *rest))
    kept = drop_near_copies(docs, "k").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(label.values())) and 60 < len(kept) < 135
    assert sum(made) < len(rows)  # before, a row for each pair of texts that share a rare shingle
