import random
import re
from collections import Counter

import numpy as np

from tabellion.llm import phrases

SCHEMA = "doc_id long, text string, lang string, score string, words string"
TRANS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    counted, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(TRANS)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counted[lang, tuple(words[i : i + k])] += 1
    return counted, totals


def plain(rows, least, first):
    counted, totals = plain_counts(rows)
    candidates = {key: n for key, n in counted.items() if len(key[1]) > 1 and n >= least}
    longest = Counter()
    for (lang, words), n in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, words[i : i + k])
                longest[part] = max(longest[part], n)
    found = {}
    for (lang, words), a in candidates.items():
        if 100 * longest[lang, words] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counted[lang, words[:k]], counted[lang, words[k:]]
            cuts.append((2000000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return {
        (lang, rank + 1, p.decode(), -a, l, r, totals[lang], -s)
        for lang, rows in found.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:first])
    }


def texts(count=160, seed=5):
    random.seed(seed)
    words = ["The", "of", "new", "york", "machine", "learning", "model", "naïve", "été", "data\tlake", "x\x1cy", "z\x85"]
    common = ["machine learning model of the new york", "in spite of the", "New York; New York", "a b c d e f"]
    rows = []
    for i in range(count):
        parts = [random.choice(words) for _ in range(random.randrange(40))] + random.choices(common, k=random.randrange(3))
        random.shuffle(parts)
        text = "".join(p + random.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!?"]) for p in parts)
        rows.append((i, text, random.choice(["en", "en", "fr", None, "und"]), "s", "w"))
    return rows + [(900, None, "en", "s", "w"), (901, "", "fr", "s", "w"), (None, "the of new york", "en", "s", "w")] * 2


def mined(spark, rows, least, first, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = phrases.collocations(frame, least=least, first=first, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_brute_force(spark):
    rows = texts()
    expected = plain(rows, 4, 25)
    assert len({r[0] for r in expected}) == 3
    assert mined(spark, rows, 4, 25) == expected


def test_sample_and_bitmap_do_not_change_the_result(spark):
    rows = texts(90, 8)
    expected = plain(rows, 3, 2000)
    assert mined(spark, rows, 3, 2000, sample=0.0) == expected
    assert mined(spark, rows, 3, 2000, sample=0.02) == expected
    assert mined(spark, rows, 3, 2000, sample=1.0, bits=15) == expected


def test_border_failures_lead_to_further_passes(spark):
    rows = [(i, "alpha beta gamma delta epsilon", "en", "s", "w") for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    texts = phrases.encoded(frame.select("text", "lang"))
    empty = np.zeros(1 << (phrases.BITS - 3), dtype=np.uint8)
    found, known, passes = phrases.closed(texts, 30, empty)
    assert passes > 2 and found.count() == 5 + 4 + 3 + 2
    full = phrases.closed(texts, 30, known)
    assert full[2] == 1 and {tuple(r) for r in full[0].collect()} == {tuple(r) for r in found.collect()}
    counted = phrases.frequent(frame, sample=0.02).collect()
    assert {(r.words, r.phrase): r.n for r in counted if r.words}[4, "beta gamma delta epsilon"] == 40


def test_small_buffers_and_chunks_count_alike(monkeypatch):
    rows = texts(60, 3)
    longer = " ".join(["no end here"] * 400)
    data = [(r[1] or "", r[2] or "und") for r in rows] + [(longer, "en")]

    def counted():
        words, held, out = phrases.Words(), [], Counter()
        for text, lang in data:
            for part in phrases.cut(text):
                held += [words.of(lang)[w] for w in part]
            held.append(0)
        every = np.full(1 << 12, 255, dtype=np.uint8)
        ids = np.array(held + [0, 0, 0], dtype=np.int64)
        for batch in phrases.count_phrases(every)(ids, words):
            for r in batch.to_pylist():
                out[r["lang"], r["words"], r["phrase"]] += r["n"]
        codes = Counter()
        for n, _, counts in phrases.count_codes(every, None, True)(np.array(words.codes, dtype=np.uint32)[ids]):
            codes[n] += int(counts.sum())
        assert codes == Counter({k: sum(n for key, n in out.items() if key[1] == k) for k in (1, 2, 3, 4)})
        return out

    whole = counted()
    assert {k: n for k, n in whole.items() if k[1]} == {
        (lang, len(w), " ".join(w)): n for (lang, w), n in plain_counts([(0, t, lang) for t, lang in data])[0].items()
    }
    monkeypatch.setattr(phrases, "CHUNK", 7)
    assert counted() == whole


def test_flushes_inside_a_text(spark, monkeypatch):
    rows = texts(80, 4) + [(5000, " ".join(["no end here"] * 500), "en", "s", "w")]
    frame = spark.createDataFrame([(r[1] or "", r[2] or "und") for r in rows], "text string, lang string").repartition(2)
    every = np.full(1 << 12, 255, dtype=np.uint8)

    def counted(buffer, remembered, ranges=4):
        source = open(phrases.__file__).read().replace("BUFFER, REMEMBERED, CHUNK = 1 << 19, 1 << 20", f"BUFFER, REMEMBERED, CHUNK = {buffer}, {remembered}").replace("HELD = 16, 1 << 19, 1 << 21", f"HELD = 16, 1 << 19, {4 * buffer}")
        scope = {"__name__": "phrases_small"}
        exec(compile(source, "phrases_small", "exec"), scope)
        found = scope["named"](frame, every).groupBy("lang", "words", "phrase").sum("n").collect()
        codes = scope["passed"](scope["encoded"](frame), scope["count_codes"](every, None, True), 1, ranges).collect()
        return {tuple(r) for r in found}, {tuple(r) for r in codes}

    assert counted(50, 10, 7) == counted(1 << 20, 1 << 20)


def test_empty_tables(spark):
    assert mined(spark, [], 1, 10) == set()
    assert mined(spark, [(1, None, None, "s", "w"), (2, " \t.", "en", "s", "w")], 1, 10) == set()
    assert mined(spark, [(1, "a b", None, "s", "w")], 1, 10) == {("und", 1, "a b", 1, 1, 1, 2, 1000000)}


def test_blocks_round_trip():
    draw = np.random.default_rng(1)
    for top, most in ((1 << 20, 3), (1 << 40, 3), (1 << 47, 70_000)):
        low = np.unique(draw.integers(0, top, 500).astype(np.uint64))
        counts = draw.integers(1, most, len(low))
        codes, again = phrases.unpacked(phrases.packed(low, counts))
        assert (codes == low).all() and (again == counts).all()
    codes, counts = phrases.added(np.array([5, 1, 5, 9, 1], np.uint64), np.array([1, 2, 3, 4, 5]))
    assert codes.tolist() == [1, 5, 9] and counts.tolist() == [7, 4, 4]


def test_remembered_words_are_bounded_by_their_bytes():
    codes = phrases.Codes("en")
    words = [b"%d" % i + b"x" * 1000 for i in range(3000)]
    assert [codes[w] for w in words] == [phrases.code(w, phrases.seed("en")) for w in words]
    assert sum(map(len, codes)) <= phrases.REMEMBERED and codes[b"\xff"] == 0


def test_forgotten_words_free_their_memory(spark, monkeypatch):
    """A vocabulary and its tables refer to each other; they must not wait for a collection."""
    import gc

    import pyarrow as pa

    taken, alive = [], []

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            taken.append(run)

    class Counted(phrases.Words):
        def __init__(self):
            super().__init__()
            alive.append(id(self))

        def __del__(self):
            alive.remove(id(self))

    monkeypatch.setattr(phrases, "Words", Counted)
    monkeypatch.setattr(phrases, "REMEMBERED", 10)
    monkeypatch.setattr(phrases, "BUFFER", 50)
    phrases.named(Frame(), np.full(1 << 12, 255, dtype=np.uint8))
    batch = pa.RecordBatch.from_arrays([pa.array([f"a{i} b{i} " * 40 for i in range(40)]), pa.array(["en"] * 40)], names=["text", "lang"])
    gc.disable()
    try:
        most = max(len(alive) for _ in taken[0](iter([batch])))
    finally:
        gc.enable()
    assert most <= 2
