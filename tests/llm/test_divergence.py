"""Source divergence against a plain count over all terms."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from kinolake.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, rank int, value string"


def brute(rows, min_docs=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", term.findall((text or "").translate(lower))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in seen if seen[t] >= min_docs]
        groups = {s: Counter() for _, s, _ in own}
        for _, s, words in own:
            groups[s].update(t for t in words if seen[t] >= min_docs)
        whole = sum(groups.values(), Counter())

        def p(counts, t):
            return 1 + 1000000000 * (counts[t] + 1) // (sum(counts.values()) + len(kept))

        f = lambda a, b: (a - b) * (a - b) // b
        for s, counts in groups.items():
            pairs = [(sum(f(p(counts, t), p(other, t)) for t in kept), o) for o, other in groups.items() if o != s]
            terms = [(f(p(counts, t), p(whole, t)), t) for t in kept if counts[t] and p(counts, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def audited(spark, rows, **options):
    table = spark.createDataFrame([(1, *r, 5, "x") for r in rows], SCHEMA)
    got = dv.audit_sources(table, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["rank"] == "int"
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("tile,bucket", [(1024, 500_000), (2, 40)])
def test_equals_a_plain_count(spark, monkeypatch, tile, bucket):
    monkeypatch.setattr(dv, "STEP", 7)
    rnd = random.Random(5)
    words = ["the", "The", "Éa", "éa", "x1y", "z_z", "q", "日本"] + [f"w{chr(97 + i)}" for i in range(25)]
    rows = [(" ".join(rnd.choices(words, k=rnd.choice([0, 3, 30]))), rnd.choice(["en", "de", None]),
             rnd.choice(["s0"] * 4 + ["s1", "s2", "s3", None])) for _ in range(90)]
    rows += [(None, "en", "silent"), ("", "en", "silent"), ("alone here", "fr", "a"), ("other words", "fr", "b"),
             (None, None, None), ("the " * 50_000, "en", "long")] + [("copy of the text", "en", "s1")] * 5
    assert audited(spark, rows, tile=tile, bucket_postings=bucket) == brute(rows)


def test_tops_ties_and_empty_tables(spark):
    rows = [("b a c", "en", "s0")] * 3 + [("d d d", "en", "s1")] * 3
    assert audited(spark, rows, top=2) == brute(rows, top=2)
    assert audited(spark, []) == []
    assert audited(spark, [("one two", "en", "s0"), (None, "en", "s1")]) == [
        ("en", "s0", "pair", "s1", 0, 1), ("en", "s1", "pair", "s0", 0, 1)]


def test_shares_are_exact_for_large_counts():
    for n, total, kinds in ((0, 0, 1), (10**12, 3 * 10**14, 10**9), (7 * 10**13 + 5, 7 * 10**13 + 11, 12345)):
        got = dv.shares(np.array([n], np.int64), np.array([total], np.int64), kinds)
        assert got[0] == 1 + 1000000000 * (n + 1) // (total + kinds)
