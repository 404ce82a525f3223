"""Document fingerprints from closed syncmers, on DataFrame functions only.

Of all runs of SPAN tokens of a text those are chosen whose smallest inner run of INNER tokens
(by hash) lies at the run's beginning or end. Whether a run is chosen depends on the run alone,
so the chosen anchors of a passage are the same in every text that holds it, and their places
line passages up. Tokens are words; in scripts written without blanks every character is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabellion.functions.ordered import OrderedGroups
from tabellion.llm.common import written

#: tokens of a run, and of the inner runs that decide whether it is chosen
SPAN, INNER = 5, 2
#: tasks that the global order of the documents is spread over
PIECES = 64
#: white space, and the place after a character of a script without blanks
# (Thai to Burmese, Khmer, kana, Han)
TOKEN_END = r"\s+|(?<=[฀-႟ក-៿぀-ヿ㐀-鿿豈-﫿])"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambda it is read."""
    return F.transform(F.array(value), body)[0]


def _sliding(values: Column, size: int, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` over each run of ``size`` neighbours, by runs of half the size; shorter arrays give none."""

    def shifted(array: Column, by: int) -> Column:
        return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))

    def paired(by: int) -> Callable[[Column], Column]:
        return lambda array: F.zip_with(F.slice(array, 1, F.greatest(F.size(array) - by, F.lit(0))), shifted(array, by), join)

    done = 1
    while done < size:
        step = min(done, size - done)
        values = bound(values, paired(step))
        done += step
    return values


def anchors(text: Column, span: int = SPAN, inner: int = INNER) -> Column:
    """The chosen runs of a text in order: array<struct<place int, hash int>>; place is the number of the first token.

    A text of fewer tokens than ``span`` has one anchor, its whole sequence of tokens; one
    without tokens (or null) has none.
    """
    window = span - inner + 1
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), TOKEN_END), lambda t: t != "")
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))

    def joined(words: Column, place: Column) -> Column:
        return F.hash(*[words[place + i] for i in range(span)])

    def chosen(words: Column) -> Column:
        runs = _sliding(words, inner, lambda a, b: F.xxhash64(a, b)) if inner <= 2 else F.transform(
            F.sequence(F.lit(0), F.size(words) - inner), lambda i: F.xxhash64(F.slice(words, i + 1, inner))
        )
        return bound(runs, lambda r: bound(_sliding(r, window, lambda a, b: F.least(a, b)), lambda m: F.transform(
            F.filter(
                F.sequence(F.lit(0), F.size(m) - 1), lambda i: (r[i] == m[i]) | (r[i + (window - 1)] == m[i])
            ),
            lambda i: F.struct(i.alias("place"), joined(words, i).alias("hash")),
        )))

    def short(words: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("place"), F.hash(words).alias("hash")))

    none = F.array().cast("array<struct<place:int,hash:int>>")
    return bound(hashes, lambda words: F.when(F.size(words) == 0, none).when(F.size(words) < span, short(words)).otherwise(chosen(words)))


def marks(found: Column) -> Column:
    """The different hashes of anchors, in the order of the text."""
    return F.array_distinct(F.transform(found, lambda a: a["hash"]))


def digest(hashes: Column) -> Column:
    """The fingerprint as text: eight hexadecimal digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.right(F.lpad(F.hex(h.cast("long")), 16, "0"), F.lit(8)))), "")


def likeness(left: Column, right: Column) -> Column:
    """Twice the shared hashes over all hashes of both (0 to 1); two empty fingerprints are alike."""
    total = F.size(left) + F.size(right)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(left, right)) / total)


def alignments(pairs: DataFrame, key: str = "pair", left: str = "left", right: str = "right") -> DataFrame:
    """(key, shift, anchors, first, last): the shared passages of given pairs of texts.

    Anchors with one hash are matched; matches with one ``shift`` (tokens that the right place
    lies behind the left one) belong to one passage, whose left places are first to last. A
    hash that repeats inside a text is matched by its first place there. Null and empty texts
    share nothing; keys should be unique.
    """

    def side(column: str, place: str) -> DataFrame:
        exploded = pairs.select(F.col(key), F.explode(anchors(F.col(column))).alias("_a"))
        return exploded.groupBy(key, F.col("_a.hash").alias("_hash")).agg(F.min("_a.place").alias(place))

    both = side(left, "_left").join(side(right, "_right"), [key, "_hash"])
    return both.groupBy(key, (F.col("_right") - F.col("_left")).alias("shift")).agg(
        F.count("*").alias("anchors"), F.min("_left").alias("first"), F.max("_left").alias("last")
    )


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit("")).alias("text")
    key = F.md5(F.concat_ws("|", F.when(F.col(doc_id).isNull(), "n").otherwise("k"), F.col(doc_id).cast("string"), whole))
    return docs.select(F.col(doc_id).alias("doc_id"), whole, key.alias("key"))


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, before, n_before): for each different (doc_id, text) the one before it in the order of doc_id, and its length.

    The first follows the last. Only keys and lengths are sorted, in PIECES tasks.
    """
    rows = _texts(docs, doc_id, text).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min(F.length("text")).alias("n"))
    rows = written(rows.withColumn("all", F.lit(0)), "keys")
    ends = rows.agg(F.count("*"), F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "key", "n"))).first()
    if not ends[0]:
        return rows.select("key", F.col("key").alias("before"), F.col("n").alias("n_before"))
    ordered = OrderedGroups(rows, ["all"], ["doc_id", "key"], max_group_rows=-(-ends[0] // (PIECES // 2)))
    linked = ordered.previous({"before": "key", "n_before": "n"})
    return linked.select("key", F.coalesce("before", F.lit(ends[1]["key"])).alias("before"), F.coalesce("n_before", F.lit(ends[1]["n"])).alias("n_before"))


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document are.

    The edited text ends in the beginning of the next document, in ascending order of
    ``doc_id``, in place of its own last floor(n / share) code points; the first document
    follows the last. Gives doc_id, n_chars, edited, anchors, edited_anchors (arrays of
    different hashes), near_edited and near_next.

    A null text is empty. Null keys come first; equal keys are ordered by a digest of the
    text, and of rows equal in both the next one is the next, so that all but one follow
    themselves. Such rows are compared once, however many they are. Other columns are not
    read; an empty table gives an empty result.
    """
    place = neighbours(docs, doc_id, text)
    # one exchange of the texts serves both joins: neither may read fewer columns of it than the other
    rows = _texts(docs, doc_id, text).groupBy("key").agg(F.min(F.struct("doc_id", "text")).alias("_row"), F.count("*").alias("copies"))
    rows = rows.where("copies > 0").select("key", "_row.doc_id", "_row.text", "copies")
    head = F.substring("text", F.lit(1), F.floor(F.col("n_before") / share).cast("int"))
    sent = rows.join(place, "key", "left").select(
        F.col("before").alias("key"), head.alias("head"), marks(anchors(F.col("text"))).alias("next")
    )
    n = F.length("text")
    own = rows.withColumn("anchors", marks(anchors(F.col("text")))).join(sent, "key", "left")
    itself = F.struct(
        (F.col("copies") - 1).alias("rows"), F.substring("text", F.lit(1), F.floor(n / share).cast("int")).alias("head"),
        F.col("anchors").alias("next"),
    )
    follows = F.struct(F.lit(1).cast("long").alias("rows"), F.col("head"), F.col("next"))
    variants = F.when(F.col("copies") == 1, F.array(follows)).otherwise(F.array(itself, follows))
    own = own.select("doc_id", "text", "anchors", F.explode(variants).alias("_v"))
    edited = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / share)).cast("int")), "_v.head")
    made = own.select(
        F.col("doc_id").alias(doc_id), n.cast("long").alias("n_chars"), edited.alias("edited"), "anchors",
        F.col("_v.next").alias("_next"), F.col("_v.rows").alias("_rows"),
    )
    made = made.withColumn("edited_anchors", marks(anchors(F.col("edited"))))
    made = made.withColumn("near_edited", likeness(F.col("anchors"), F.col("edited_anchors")))
    made = made.withColumn("near_next", likeness(F.col("anchors"), F.col("_next"))).drop("_next")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))
    return made.withColumn("_each", each).drop("_each", "_rows")
