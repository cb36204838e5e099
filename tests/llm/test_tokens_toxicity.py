import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinolake.llm.chain_field import ChainField
from kinolake.llm.token_counts import count_tokens, encoder, scan_separators, VOCABULARY
from kinolake.llm.toxicity import fit_toxicity, held_out, score_toxicity


def test_separators_across_blocks(spark):
    rng = random.Random(1)
    want, blocks = [], []
    for file in range(4):
        flat = [rng.choice([7, 8, 9]) if rng.random() < (0.9, 0.5, 1, 0.02)[file] else 5 for _ in range(300)]
        start = ordinal = 0
        for i, token in enumerate(flat):
            if token == 5:
                want.append((file, ordinal, start, i - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < len(flat):
            want.append((file, ordinal, start, len(flat) - start, False))
        at = block = 0
        while at < len(flat):
            size = rng.choice([0, 1, 1, 2, 7, 30])
            blocks.append((file, block, np.array(flat[at:at + size], np.uint16).tobytes() or None, "x"))
            at, block = at + size, block + 1
    frame = spark.createDataFrame(blocks, "file int, block long, tokens binary, ends string")
    for span in (4096, 3):
        assert sorted(map(tuple, scan_separators(frame, 5, blocks_per_span=span).collect())) == want
    assert scan_separators(frame.limit(0), 5).count() == 0


def test_counts_match_the_encoder(spark, docs):
    rows = [(i, f"Grüße {i} <|endoftext|> " * (i % 7)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "z" * 4000), (103, "word " * 20000), (5, "again"), (None, "no id")]
    got = count_tokens(spark, docs(rows).withColumn("tokens", F.lit(1)).repartition(3), block_tokens=500).collect()
    model = encoder(VOCABULARY)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted([(i, len(model.encode_ordinary(t or ""))) for i, t in rows], key=key)
    assert count_tokens(spark, docs([])).count() == 0


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    chain = ChainField(2)
    chain.step = rng.normal(size=3)
    lengths = np.array([5, 3, 1])
    emission = rng.normal(size=(5, 3))
    got = chain.marginals(emission, lengths)
    step = {(0, 0): 0.0, (0, 1): chain.step[0], (1, 0): chain.step[1], (1, 1): chain.step[2]}
    for lane, n in enumerate(lengths):
        total, ones = 0.0, np.zeros(n)
        for code in range(1 << n):
            tags = [code >> t & 1 for t in range(n)]
            weight = np.exp(sum(emission[t, lane] * tags[t] for t in range(n))
                            + sum(step[a, b] for a, b in zip(tags, tags[1:])))
            total += weight
            ones += weight * np.array(tags)
        assert np.allclose(got[:n, lane], ones / total)


def labelled(n=700, seed=5):
    rng = random.Random(seed)
    words = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in ("n", "rst", "tz", "")]
    bad = ["vilo" + x for x in ("n", "rst", "ka", "mi", "tz")] + ["Schund"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 5)):
                text[rng.randrange(len(text))] = rng.choice(bad) + rng.choice(["", ",", "!"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_documents_are_told_apart(spark, docs):
    rows, labels = labelled()
    # labels of the held-out fifth are wrong on purpose: they must not be read
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    rows += [(9000, None), (9001, ""), (9002, "vilon " * 30000), (9003, "bat " * 30000), (None, "bat"), (9003, "bat " * 30000)]
    frame = docs(rows).withColumn("score", F.lit("x"))
    lab = spark.createDataFrame([*wrong, (None, 1), (3, None), (labels[1][0], labels[1][1])], "doc_id long, toxic int")
    model = fit_toxicity(frame, lab)
    got = score_toxicity(frame, model).withColumn("held", held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [(truth[r.doc_id], r.score >= 0.5) for r in got if r.held and r.doc_id in truth]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[9002].score > 0.5 > by[9003].score and by[9000].score == by[9001].score < 0.5
    assert by[9002].toxic_spans == [[0, 30000 * 6 - 1]] and by[9003].toxic_spans == []
    for r in got:
        for a, b in r.toxic_spans:
            assert r.doc_id is None or r.held or any(w.lower().startswith(("vilo", "schund")) for w in r.text[a:b].split())


@pytest.mark.parametrize("toxic,score", [([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)])
def test_nothing_to_learn(spark, docs, toxic, score):
    frame = docs([(1, "a b"), (2, "c")])
    model = fit_toxicity(frame, spark.createDataFrame([(i + 1, y) for i, y in enumerate(toxic)], "doc_id long, toxic int"))
    assert [r.score for r in score_toxicity(frame, model).collect()] == [score, score]
    assert score_toxicity(docs([]), model).count() == 0
