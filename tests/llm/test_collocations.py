"""Collocations against separate counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinolake.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, n int, rank string"


def brute(rows, min_count, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < min_count:
                continue
            if any(len(p) > len(phrase) and f[p] >= a and any(p[i:i + len(phrase)] == phrase for i in range(len(p)))
                   for p in f if f[p] >= min_count):
                continue
            score, _, l, r = min((1000 * a * totals[lang] // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]])
                                 for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), l, r))
        found.sort()
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(found[:top], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    got = co.mine_collocations(spark.createDataFrame([(1, *r, 4, "x") for r in rows], SCHEMA), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("slice_bytes,bits", [(6 << 20, co.MAX_BITS), (200, co.SEGMENT)])
def test_equals_separate_counts(spark, monkeypatch, slice_bytes, bits):
    monkeypatch.setattr(co, "SLICE", slice_bytes)
    rnd = random.Random(8)
    words = ["new", "New", "york", "city", "a", "of", "the", "Ünder", "ünder", "x\x85y", " ", "日本", "r2"] + [f"t{i}" for i in range(40)]
    ends = [" ", "  ", "\t", " ", " ", " ", ". ", ",", "\n", "\r\n", "\x0b", "!?"]
    rows = [("".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.choice([0, 5, 60]))), rnd.choice(["en", "de", None, "und"]))
            for _ in range(80)]
    rows += [("a new york city of the north", "en")] * 9 + [("in new york", "en")] * 4 + [(None, "en"), ("", None), ("...", "xx")]
    rows += [("the the the the the the the the", "en")] * 3
    assert mined(spark, rows, min_count=4, max_bits=bits) == brute(rows, 4, 2000)
    assert mined(spark, rows, min_count=4, top=3, max_bits=bits) == brute(rows, 4, 3)


def test_one_very_long_piece_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(co, "SLICE", 1000)
    rows = [("left right " * 20_000, "en"), ("up down, " * 3000, None)]
    assert mined(spark, rows) == brute(rows, 100, 2000)
    assert mined(spark, []) == []
    assert mined(spark, [("too few words", "en")]) == []


def test_counted_cells_travel_in_few_bytes():
    rng = np.random.default_rng(3)
    steps = rng.integers(0, 14, 100_000)
    cases = [steps, rng.integers(0, 4000, 1000), np.array([0, 254, 255, 65534, 65535, 70_000, 1 << 28]), np.zeros(0, np.int64)]
    payload = b"".join(map(co._narrow, cases))
    at = 0
    for values in cases:
        got, at = co._widen(payload, at)
        assert got.tolist() == values.tolist()
    assert at == len(payload) and len(co._narrow(steps)) < 101_000


def test_equal_windows_are_added_up_before_the_rollup(spark, monkeypatch):
    seen, cut = [], co.cut_lineage
    monkeypatch.setattr(co, "cut_lineage", lambda df: seen.append(df) or cut(df))
    docs = spark.createDataFrame([("one two three " * 150, "en")], "text string, lang string")
    assert co.count_phrases(docs).count() == 15  # three of each size
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    rolled = [p for p in plans if "Expand" in p]
    assert len(rolled) == 1 and "Exchange" in rolled[0].split("Expand", 1)[1]
