"""Quality counts against plain loops, and the verdict on made texts."""

import base64
import random
import re
from collections import Counter

import zstandard

from kinolake.llm import compression_bands as cb

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    raw = text.encode()
    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))

    def fits(b):
        low, high = cb.limits_at(len(b))
        return low <= ratio(b) <= high
    chunks = [raw[a:a + 2048] for a in range(0, len(raw) - 2047, 2048)]
    out = sum(not fits(c) for c in chunks)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(inside), failed, not failed and fits(raw) and out <= 0.25 * len(chunks))


def prose(rnd, n):
    parts = "an er in on re th st ea ti ing tion nd ha or ed is at en ou ly sh ble es wh".split()
    short = "the of and to in is that it for was on by with as at be".split()
    return " ".join(rnd.choice(short) if rnd.random() < 0.3 else "".join(rnd.choices(parts, k=rnd.randint(2, 4)))
                    for _ in range(n))


def judged(spark, texts):
    table = spark.createDataFrame([(i, t, "was here", 3) for i, t in enumerate(texts)], "doc_id long, text string, kept string, ratio int")
    got = cb.apply_quality_rules(table)
    assert got.columns == ["doc_id", "text", *cb.ADDED.fieldNames()]
    return [tuple(r) for r in got.orderBy("doc_id").select(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()]


def test_counts_and_verdicts_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(cb, "WORDS_AT_ONCE", 50)
    rnd = random.Random(2)
    words = ["a", "b", "Éé", "#x*", "日本", " ", "\u0085y", "<|>"]
    texts = [None, "", " \t\x0b\x0c\r\n", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a", "x\n\nx\nx \n y\nx"]
    texts += ["".join(rnd.choice(words) + rnd.choice([" ", "\n", "\t", "\r\n", "  "]) for _ in range(rnd.randint(1, 60)))
              for _ in range(60)]
    texts += [prose(rnd, n) for n in (12, 60, 400, 4000)] * 2 + [prose(rnd, 200_000)]
    assert judged(spark, texts) == [brute(t) for t in texts]


def test_repetitive_and_incompressible_texts_go(spark):
    rnd = random.Random(9)
    plain = [prose(rnd, n) for n in (300, 1500)]
    tables = [" | ".join(f"row {rnd.randint(0, 9)} {rnd.randint(0, 99)}" for _ in range(n)) for n in (200, 2000)]
    noise = [" ".join(base64.b64encode(rnd.randbytes(30)).decode() for _ in range(n)) for n in (20, 200)]
    half = plain[1] + " " + " ".join(base64.b64encode(rnd.randbytes(30)).decode() for _ in range(200))
    got = judged(spark, plain + tables + noise + [half])
    assert [r[-1] for r in got] == [True, True, False, False, False, False, False]
    assert not any(r[-2] for r in got[4:])


def test_empty_table(spark):
    assert cb.apply_quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []
