import hashlib
import random

from pyspark.sql import functions as F

from tabellion.llm import syncmers

SCHEMA = "doc_id long, text string, key string, copies string, anchors string"


def anchored(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = frame.select("i", syncmers.anchors(F.col("text")).alias("a")).collect()
    return {r.i: [(x.place, x.hash) for x in r.a] for r in rows}


def plain_places(spark, words, span=syncmers.SPAN, inner=syncmers.INNER):
    """Places of closed syncmers, by their definition, from the hashes of inner runs."""
    runs = [words[i : i + inner] for i in range(len(words) - inner + 1)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(runs)], "i int, a string, b string")
    hashed = frame.select("i", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()
    values = [h for _, h in sorted((r.i, r.h) for r in hashed)]
    window = span - inner + 1
    out = []
    for i in range(len(words) - span + 1):
        part = values[i : i + window]
        if min(part) in (part[0], part[-1]):
            out.append(i)
    return out


def words(count, seed):
    random.seed(seed)
    return [random.choice("abcdefgh") + random.choice("aeiou") + random.choice("xyz") for _ in range(count)]


def test_chosen_runs_follow_the_definition(spark):
    one = words(300, 1)
    found = anchored(spark, [" ".join(one), " ".join(one[:5]), " ".join(one[:6])])
    assert [p for p, _ in found[0]] == plain_places(spark, one)
    assert all(p in (0, 1) for p, _ in found[2])
    assert len(found[0]) < len(one) - 4


def test_anchors_do_not_depend_on_their_context(spark):
    passage, other, last = words(80, 2), words(37, 3), words(50, 4)
    found = anchored(spark, [" ".join(passage), "\n".join(other + passage + last)])
    inside = {(p - 37, h) for p, h in found[1] if 37 <= p <= 37 + 80 - syncmers.SPAN}
    assert inside == set(found[0])


def test_texts_without_blanks_and_short_ones(spark):
    han = "".join(chr(0x4E00 + i * 7 % 500) for i in range(200))
    found = anchored(spark, ["", None, "  \n ", "one", "one two", "one  two ", han, han[:120] + han[150:]])
    assert found[0] == found[1] == found[2] == []
    assert len(found[3]) == len(found[4]) == 1 and found[4] == found[5] != found[3]
    shared = {h for _, h in found[6]} & {h for _, h in found[7]}
    assert len(found[6]) > 50 and len(shared) > 0.6 * len(found[7])


def test_alignments_find_a_moved_passage(spark):
    passage = words(90, 5)
    left, right = words(30, 6) + passage, passage + words(60, 7)
    pairs = spark.createDataFrame([(1, " ".join(left), " ".join(right)), (2, "a b", None)], "pair int, left string, right string")
    best = syncmers.alignments(pairs).orderBy(F.col("anchors").desc()).first()
    assert (best.pair, best.shift) == (1, -30) and best.first >= 30 and best.anchors > 20


def plain_edits(rows):
    """(doc_id, n_chars, sha256 of the edited text) by sorting everything in one place."""
    ordered = sorted(
        ((k is not None, k or 0, hashlib.md5(f"{'n' if k is None else f'k|{k}'}|{t or ''}".encode()).hexdigest(), t or "") for k, t, *_ in rows)
    )
    out = []
    for i, (known, key, _, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][3]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        out.append((key if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


def compared(spark, rows):
    made = syncmers.compare_edited(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return made.withColumn("sha", F.sha2("edited", 256)).collect()


def test_every_document_meets_the_next_one(spark, monkeypatch):
    rows = [(i * 3, " ".join(words(random.Random(i).randrange(60), i)), "k", "c", "a") for i in range(90)]
    rows += [(500, "é😀" * 50, "k", "c", "a"), (501, None, "k", "c", "a"), (502, "", "k", "c", "a"), (None, "null key", "k", "c", "a")]
    rows += [(600, "same text of some words that is here", "k", "c", "a")] * 7 + [(600, "another text", "k", "c", "a")] * 2
    rows += [(None, None, "k", "c", "a")] * 5
    found = compared(spark, rows)
    assert sorted(((r.doc_id, r.n_chars, r.sha) for r in found), key=str) == plain_edits(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    copies = [r for r in found if r.doc_id == 600 and r.n_chars == 36]
    assert sum(r.near_next == 1.0 for r in copies) == 6


def test_likeness_tells_edited_from_other(spark):
    rows = [(i, " ".join(words(300, 100 + i)), "k", "c", "a") for i in range(20)] + [(20, " ".join(words(300, 119)), "k", "c", "a")]
    found = {r.doc_id: r for r in compared(spark, rows)}
    assert all(0.6 < found[i].near_edited < 0.9 and found[i].near_next < 0.1 for i in range(19))
    assert found[19].near_next == 1.0 and found[19].anchors == found[20].anchors


def test_empty_one_and_long(spark):
    assert compared(spark, []) == []
    only = compared(spark, [(1, "a b c d e f g h", "k", "c", "a")])
    assert [(r.doc_id, r.edited, r.near_next) for r in only] == [(1, "a b c d e fa b", 1.0)] or only[0].near_next == 1.0
    long = compared(spark, [(1, "word " * 200_000, "k", "c", "a"), (2, "x" * 1_000_000, "k", "c", "a")])
    assert {r.n_chars for r in long} == {1_000_000} and all(r.near_next == 0 for r in long)


def test_digest_of_equal_texts_is_equal(spark):
    frame = spark.createDataFrame([("a b c d e f g",), ("a b c d e f g",), ("a b c d e f h",)], "text string")
    prints = [r[0] for r in frame.select(syncmers.digest(syncmers.marks(syncmers.anchors(F.col("text"))))).collect()]
    assert prints[0] == prints[1] and len(prints[0]) % 8 == 0
