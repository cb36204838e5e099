import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from test_near_duplicates import labels_of, slow_simhash  # noqa: E402
from test_substring_dedup import WORD, brute_windows  # noqa: E402


def fixture(n=260, seed=12):
    rng = random.Random(seed)
    words = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in ("n", "rst", "tz", "", "pf", "ss")]
    shared = [rng.choice(words) for _ in range(45)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(25, 160))]
        toxic = i % 5 == 2
        if toxic:
            for _ in range(6):
                text[rng.randrange(len(text))] = rng.choice(["vilon", "schund", "grobian"])
        elif i % 7 == 0:
            text[10:10] = shared
        rows.append([i, " ".join(text), "en", rng.choice(["s0", "s0", "s1", "s2", None]), 0])
        labels.append((i, int(toxic)))
    clean = [r for r in rows if r[0] % 5 != 2]
    for j, r in enumerate(clean[:25]):
        rows.append([1000 + j, r[1] + rng.choice(["", "\n", " \t"]), "en", "s1", 0])
    for j, r in enumerate(r for r in clean[30:] if len(r[1].split()) > 110):  # one word apart
        text = r[1].split()
        text[50 + j % 50] = "anders"
        rows.append([3000 + j, " ".join(text), "en", "s2", 0])
    rows += [[2000, None, None, None, None], [2001, "", "en", "s1", 0]]
    for r in rows:
        r[4] = len(r[1] or "")
    return [tuple(r) for r in rows], labels


def shingles(text):
    words = WORD.findall(text.lower())
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_match_brute_force(spark, tmp_path):
    rows, labels = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), [rows]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append([tuple(r) for r in docs.collect()])
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {i for i, y in labels if y}
    assert {r[0] for r in kept[1]} == {r[0] for r in rows} - toxic
    prints = {r[0]: slow_simhash(r[1]) for r in kept[1]}
    label = labels_of(prints, [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2])
    alike = {r[0]: shingles(r[1]) for r in kept[1] if label[r[0]] == r[0] and r[1]}
    pairs = [(a, b) for a in alike for b in alike if a < b
             and len(alike[a] & alike[b]) >= 0.8 * len(alike[a] | alike[b])]
    assert len(pairs) > 20
    assert sorted(r[0] for r in kept[2]) == sorted(set(label.values()) - {b for _, b in pairs})
    want = {i: text for i, _, _, text in brute_windows([(r[0], r[1]) for r in kept[2]], 20)}
    assert {r[0]: r[1] for r in kept[3]} == want and all(r[4] == len(r[1]) for r in kept[3])
    sizes = {r[0]: len(WORD.findall(r[1])) for r in kept[3]}
    times, words = Counter(r[0] for r in kept[4]), defaultdict(int)
    assert max(times.values()) <= 3 and not {i for i in times if not sizes[i]}
    source = {r[0]: r[3] for r in kept[3]}
    for i, t in times.items():
        words[source[i]] += t * sizes[i]
    assert abs(sum(words.values()) - sum(sizes.values())) <= 5 * max(sizes.values())
    packed = defaultdict(list)
    for doc, piece, bin_, start, length, offset, src, cluster in kept[5]:
        packed[bin_].append((length, src, doc))
    assert sum(p[0] for rows in packed.values() for p in rows) == sum(words.values())
    for pieces in packed.values():
        assert sum(p[0] for p in pieces) <= 2048 and len({p[1] for p in pieces}) == len({p[2] for p in pieces}) == len(pieces)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, again.collect())) == Counter(kept[5])


def test_empty_tables_give_an_empty_result(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
