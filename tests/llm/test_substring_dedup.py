import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from kinolake.llm.run_length_index import RunLengthIndex
from kinolake.llm.suffix_dedup import remove_repeats
from kinolake.llm.window_dedup import dedup_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, copies=6):
    rng = random.Random(seed)
    words = [rng.choice("äabcde") * rng.randint(1, 3) + rng.choice("xyz") + str(rng.randint(0, 400)) for _ in range(900)]
    rows = []
    for i in range(40):
        a = rng.randint(0, 700)
        picked = words[a:a + rng.randint(0, 150)]
        for _ in range(rng.randint(0, 3)):
            if picked:
                picked[rng.randrange(len(picked))] = "edit" + str(rng.randint(0, 9))
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(picked)))
    rows += [(1000 + i, rows[0][1]) for i in range(copies)]
    rows += [(2000, None), (2001, ""), (2002, "a " * 3000), (2003, "z" * 5000), (None, "null id " * 30)]
    return rows


def brute_windows(rows, size):
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    for i, text in order:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - size + 1):
            key = tuple(words[s:s + size])
            if key in seen:
                gone[s:s + size] = [True] * size
            seen.setdefault(key, 1)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def key(row):
    return -1 if row[0] is None else row[0]


def test_windows_match_brute_force(spark, docs):
    rows = corpus(3)
    got = dedup_windows(docs(rows), block_bytes=3000).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_windows(rows, 20), key=key)


def test_windows_keep_other_columns_and_replace_clashing_ones(docs):
    frame = docs([(1, "a b c", "x", 7), (2, "a b c", None, 8)], "doc_id long, text string, source string, n_words int")
    got = dedup_windows(frame, window=2)
    assert got.columns == ["doc_id", "text", "source", "n_words", "n_removed", "kept_text", "removed_spans"]
    assert [(r.source, r.n_words, r.kept_text, r.removed_spans) for r in got.orderBy("doc_id").collect()] == [
        ("x", 3, "a b c", []), (None, 3, "", [[0, 3]])]
    assert dedup_windows(docs([])).count() == 0


def brute_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s:s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        out.append((i, len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_bytes_match_brute_force(docs):
    rows = corpus(5)
    for length, block, contents in ((400, 4000, 512), (100, 2500, 512), (100, 2500, 1)):
        got = remove_repeats(docs(rows), length=length, block_bytes=block, contents_per_index=contents)
        got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept_bytes)) for r in got.collect()]
        assert sorted(got, key=key) == sorted(brute_bytes(rows, length), key=key)


def test_bytes_empty_table_and_clashing_columns(docs):
    assert remove_repeats(docs([])).count() == 0
    frame = docs([(1, "q" * 500, "s")], "doc_id long, text string, n_removed string")
    row = remove_repeats(frame).first()
    assert (row.n_removed, row.removed_spans, bytes(row.kept_bytes)) == (500, [[0, 500]], b"")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=5))
def test_matching_statistics(texts):
    texts = [t.encode() for t in texts]
    want = []
    places = [(i, s) for i, t in enumerate(texts) for s in range(len(t))]
    for i, s in places:
        best = 0
        for j, q in places:
            n = 0
            while (i, s) != (j, q) and s + n < len(texts[i]) and q + n < len(texts[j]) and texts[i][s + n] == texts[j][q + n]:
                n += 1
            best = max(best, n)
        want.append(best)
    assert RunLengthIndex(texts).matching_statistics().tolist() == want
