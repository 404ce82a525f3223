"""Searching the catalog, serving asset context by role, masking values, gating prompts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabellion.functions.columns import any_of, joined
from tabellion.operators.catalog import tagged_columns
from tabellion.operators.contained import Texts, concatenated, stretches
from tabellion.session import checkpointed

# fixed values: search weights
PHRASE_IN_NAME, PHRASE_IN_TEXT = 50, 25
TOKEN_IN_NAME, TOKEN_IN_TEXT = 20, 10
CERTIFIED_BOOST = 15

# fixed values: roles that see unmasked data, and the policy text shown to the others
PRIVILEGED_ROLES = ("COMPLIANCE_STEWARD", "SECURITY_ADMIN")
MASKING_POLICY = "POL-002 & POL-006: PII restricted from unauthorized role access."

# fixed values: substrings that mark a prompt as asking for personal data
PROMPT_TRIGGERS = (
    "customer_id",
    "email",
    "phone",
    "address",
    "zip",
    "personal names",
    "raw pii",
    "street",
    "employee",
    "birth",
    "emergency",
    "contact",
    "tax",
    "credit card",
    "notes",
    "residence",
    "complaint",
)
REFUSED, PERMITTED = "REFUSED_BY_POLICY", "PERMITTED"


def search(
    assets: DataFrame,
    queries: Mapping[str, str],
    limit: int = 10,
    asset_type: str | None = None,
    boost_requires_hit: bool = False,
) -> DataFrame:
    """The best ``limit`` assets per query: query_id, rank, asset_id, name, relevance_score.

    The queries are compiled into score columns, so each asset text is read and lower-cased
    once for all of them and nothing is joined; only (query, id, name, score) rows go through
    the top-k, which cuts to ``limit`` in every task before the shuffle. Without
    ``boost_requires_hit`` a certified asset matches every query, by its boost alone.
    """
    if asset_type is not None:
        assets = assets.filter(F.col("asset_type") == asset_type.upper())
    lowered = assets.select(
        "asset_id",
        "name",
        F.lower(F.coalesce("name", F.lit(""))).alias("_name"),
        F.lower(F.coalesce("description", F.lit(""))).alias("_text"),
        (F.coalesce("certification_status", F.lit("")) == "CERTIFIED").alias("_certified"),
    )
    scores = []
    for query_id, query in queries.items():
        hits = _relevance(query)
        boosted = F.col("_certified") & (hits > 0) if boost_requires_hit else F.col("_certified")
        score = hits + F.when(boosted, CERTIFIED_BOOST).otherwise(0)
        scores.append(F.struct(F.lit(query_id).alias("query_id"), score.cast("double").alias("relevance_score")))
    matched = (
        lowered.select("asset_id", "name", F.explode(F.array(*scores)).alias("s"))
        .select("s.*", "asset_id", "name")
        .filter(F.col("relevance_score") > 0)
    )
    best = Window.partitionBy("query_id").orderBy(F.col("relevance_score").desc(), "name", "asset_id")
    return matched.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)


def query_tokens(query: str) -> list[str]:
    tokens = [t.lower() for t in query.split() if len(t) > 1]
    return tokens or [query.strip().lower()]


def asset_context(assets: DataFrame, tags: DataFrame, role: str = "ANALYST") -> DataFrame:
    """Each table with its columns as the role may see them, one row per column.

    A table without columns gives one row with null column fields. The rows stay flat, so a
    very wide table is never gathered into one task.
    """
    masked = F.col("is_pii") & F.lit(not is_privileged(role))
    columns = tagged_columns(assets, tags).select(
        F.col("parent_id").alias("_table"),
        F.col("asset_id").alias("column_asset_id"),
        F.col("name").alias("column_name"),
        F.col("data_type").alias("column_type"),
        "is_pii",
        "pii_type",
        masked.alias("is_masked"),
        F.when(masked, MASKING_POLICY).alias("masking_policy"),
    )
    tables = assets.filter(F.col("asset_type") == "TABLE").drop("data_type")
    joined_rows = tables.join(columns, F.col("asset_id") == F.col("_table"), "left").drop("_table")
    return joined_rows.withColumn("caller_role", F.lit(role))


def one_asset_context(assets: DataFrame, tags: DataFrame, asset_id: str, role: str = "ANALYST") -> DataFrame:
    """Context of one table, with its own tags; an unknown id is an error."""
    wanted = assets.filter((F.col("asset_id") == asset_id) | (F.col("parent_id") == asset_id))
    if wanted.filter(F.col("asset_id") == asset_id).isEmpty():
        raise KeyError(f"asset {asset_id!r} is not in the catalog")
    own_tags = tags.filter(F.col("asset_id") == asset_id).select("asset_id", "tag_name", "tag_value").distinct()
    listed = own_tags.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("tag_name", "tag_value"))).alias("tags"))
    context = asset_context(wanted, tags, role).filter(F.col("asset_id") == asset_id)
    return context.join(listed, "asset_id", "left")


def is_privileged(role: str) -> bool:
    return role.upper() in PRIVILEGED_ROLES


def mask_value(value: Column, method: str, label: str, kind: str = "string", salt: str = "") -> Column:
    """A value of type ``kind`` as an unprivileged role sees it, in the same type.

    ``null``; ``hash``, salted, of whole numbers again a whole number; ``partial`` or a fixed
    ``label`` for strings (null for other types).
    """
    text = value.cast("string")
    if method == "null":
        return F.lit(None).cast(kind)
    if method == "hash":
        digest = F.sha2(F.concat(F.lit(salt), F.lit("|"), text), 256)
        digits = {"bigint": 15, "int": 7}.get(kind)
        return digest.cast(kind) if digits is None else F.conv(F.substring(digest, 1, digits), 16, 10).cast(kind)
    if method not in ("partial", "label"):
        raise ValueError(f"unknown masking method {method!r}")
    if kind != "string":
        return F.lit(None).cast(kind)
    if method == "partial":
        return F.concat(F.left(text, F.lit(2)), F.repeat(F.lit("*"), F.greatest(F.length(text) - 2, F.lit(0))))
    return F.when(value.isNotNull(), F.lit(f"[RESTRICTED_{label}]"))


def mask_frame(
    df: DataFrame, pii_types: Mapping[str, str], role: str, methods: Mapping[str, str] | None = None, salt: str = ""
) -> DataFrame:
    """``df`` with its PII columns (column -> PII type) masked unless the role is privileged; the schema stays."""
    if is_privileged(role):
        return df
    methods, kinds = methods or {}, dict(df.dtypes)
    masked = {
        c: mask_value(F.col(c), methods.get(c, "label"), label, kinds[c], salt) for c, label in pii_types.items() if c in kinds
    }
    return df.withColumns(masked)


def gate_prompts(prompts: DataFrame, text: str, role: str = "ANALYST", triggers: Sequence[str] = PROMPT_TRIGGERS) -> DataFrame:
    """Adds the gate's verdict on each prompt and the triggers that occur in it."""
    lowered = F.lower(text)
    found = F.array_compact(F.array(*[F.when(lowered.contains(t), F.lit(t)) for t in triggers]))
    hit = any_of([lowered.contains(t) for t in triggers]) & F.lit(not is_privileged(role))
    return prompts.withColumns(
        {
            "status": F.when(hit, REFUSED).otherwise(PERMITTED),
            "triggers": joined(found),
            "policy_citation": F.when(hit, "POL-002,POL-006"),
        }
    )


def _relevance(query: str) -> Column:
    phrase = query.lower()
    score = _if(F.col("_name").contains(phrase), PHRASE_IN_NAME) + _if(F.col("_text").contains(phrase), PHRASE_IN_TEXT)
    for token in query_tokens(query):
        score = score + _if(F.col("_name").contains(token), TOKEN_IN_NAME) + _if(F.col("_text").contains(token), TOKEN_IN_TEXT)
    return score


def _if(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


# --- many queries, as a table -----------------------------------------------------------------

#: assets, or bytes of their texts, that are searched together; pieces of that work where they have a megabyte each
BLOCK, BLOCK_BYTES, PIECES = 1 << 15, 3 << 23, 16
#: different queries that are scored together, and that are handed on together
UNITS, PACK = 1 << 18, 1 << 13
#: a list of places is held as a row of marks if it has more than one of so many places
_MARKED = 24
#: places of short lists that are scored at once
_SCORED = 1 << 19
_FIELDS = {"name": (PHRASE_IN_NAME, TOKEN_IN_NAME), "description": (PHRASE_IN_TEXT, TOKEN_IN_TEXT)}
_SPACE = r"\s+"


def _trimmed(text: Column | str) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def query_patterns(queries: DataFrame) -> DataFrame:
    """(query_id, pattern, phrase, times): the lower-cased query and its words, and how often each counts.

    Words have two letters at least; a query without such words is a word itself, trimmed. Null
    queries ask for nothing.
    """
    whole = queries.where("query is not null").select("query_id", F.lower("query").alias("q"))
    trimmed = _trimmed("q")
    words = F.filter(F.split(trimmed, _SPACE), lambda w: F.length(w) > 1)
    tokens = F.when(F.size(words) > 0, words).otherwise(F.array(trimmed))
    asked = F.transform(tokens, lambda t: F.struct(t.alias("pattern"), F.lit(False).alias("phrase")))
    phrase = F.array(F.struct(F.col("q").alias("pattern"), F.lit(True).alias("phrase")))
    return whole.select("query_id", F.explode(F.concat(phrase, asked)).alias("p")).groupBy("query_id", "p.pattern", "p.phrase").agg(F.count(F.lit(1)).alias("times"))


def _best(limit: int, merged: bool):
    """For the postings and the queries of a block: (unit, block, place, score) of the ``limit`` best places of each query.

    Places are in the order of ties; a position is twice the place, and one more for certified assets.
    Long lists are added up as rows of marks, once for all queries that ask for the same of them; the
    places of short lists are scored one by one.
    """

    def run(key: tuple[pa.Scalar, ...], postings: pa.Table, asked: pa.Table) -> pa.Table:
        known = postings.column("pattern").combine_chunks().dictionary_encode()
        places = postings.column("places").chunks
        lengths = np.concatenate([np.zeros(0, np.int64), *(p.value_lengths().to_numpy(zero_copy_only=False) for p in places)])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        positions = [p.flatten().to_numpy(zero_copy_only=False) for p in places]
        present = np.zeros(max((int(p.max()) + 1 for p in positions if len(p)), default=0), dtype=bool)
        for some in positions:
            present[some] = True
        slots = np.flatnonzero(present)
        n = len(slots)
        slot_of = np.cumsum(present, dtype=np.int32) - 1
        at = np.concatenate([np.zeros(0, np.int32), *(slot_of[p] for p in positions)])
        patterns_of, (phrase, token) = known.dictionary, (postings.column(c).to_numpy().astype(np.int64) for c in ("phrase_points", "token_points"))
        del postings, places, positions
        place, certified = slots >> 1, (slots & 1).astype(np.uint8)
        boost, backward = certified * np.uint8(CERTIFIED_BOOST), np.arange(n - 1, -1, -1, dtype=np.int64)
        paired = merged and bool((place[1:] == place[:-1]).any())
        # an asset can be at two positions
        take = limit * (2 if paired else 1)

        pattern = known.indices.to_numpy()
        rows_by = np.argsort(pattern, kind="stable")
        rows_from = np.searchsorted(pattern[rows_by], np.arange(len(patterns_of) + 1))
        code = pc.index_in(asked.column("pattern").combine_chunks(), value_set=patterns_of).fill_null(-1).to_numpy(zero_copy_only=False)
        units = asked.column("unit").combine_chunks().dictionary_encode()
        ask = np.flatnonzero(code >= 0)
        counts = rows_from[code[ask] + 1] - rows_from[code[ask]]
        row, ask = rows_by[stretches(rows_from[code[ask]], counts)], np.repeat(ask, counts)
        is_phrase, times = (asked.column(c).to_numpy() for c in ("is_phrase", "times"))
        weight = np.where(is_phrase[ask], phrase[row], token[row]) * times[ask]
        unit = units.indices.to_numpy()[ask].astype(np.int64)
        # the queries that ask for the same long lists follow each other; a query's long lists come first
        long = lengths > n // _MARKED
        mixed = np.where(long[row], (row * np.int64(0x5851F42D4C957F2D) ^ weight) * np.int64(0x14057B7EF767814F), 0)
        alike = np.zeros(len(units.dictionary), dtype=np.int64)
        np.add.at(alike, unit, mixed)
        order = np.lexsort((weight, row, ~long[row], unit, alike[unit]))
        unit = unit[order]
        row, weight = row[order].astype(np.int32), weight[order]
        del order, mixed, alike, ask, counts, code
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else np.zeros(0, dtype=np.int64)
        last = np.append(first[1:], len(unit))[: len(first)]
        split = first + np.add.reduceat(long[row].astype(np.int64), first) if len(first) else first
        used = np.unique(row[long[row]])
        marks = np.zeros((len(used), n), dtype=np.uint8)
        for r, name in enumerate(used.tolist()):
            marks[r, at[starts[name] : ends[name]]] = 1
        mark = np.searchsorted(used, row).astype(np.int32)

        def by_long(lists: list[tuple[int, int]]) -> np.ndarray:
            """The best places by long lists alone, as score * n + how far from the last."""
            kind = np.uint8 if sum(w for _, w in lists) + CERTIFIED_BOOST < 256 else np.int64
            score = marks[lists[0][0]] * kind(lists[0][1])
            for r, w in lists[1:]:
                score += marks[r] * kind(w)
            score += boost * (score > 0)
            small = backward if kind is np.int64 or n > 1 << 22 else backward_small
            keys = np.multiply(score, n, dtype=small.dtype)
            keys += small
            keys = np.partition(keys, n - take)[n - take :] if n > take else keys
            return keys[keys >= n].astype(np.int64)

        backward_small = backward.astype(np.int32)
        same, common = None, np.zeros(0, dtype=np.int64)
        commons = []
        marks_of, weights = mark.tolist(), weight.tolist()
        for f, s in zip(first.tolist(), split.tolist(), strict=True):
            lists = [*zip(marks_of[f:s], weights[f:s], strict=True)]
            if lists != same:
                same, common = lists, by_long(lists) if lists else np.zeros(0, dtype=np.int64)
            commons.append(common)
        del marks_of, weights
        common_from = np.append(0, np.cumsum(np.fromiter(map(len, commons), np.int64, len(commons))))

        query = np.repeat(np.arange(len(first), dtype=np.int32), last - first)
        short = np.where(long[row], 0, lengths[row])
        bits = int(weight.max(initial=1)).bit_length()
        most = max(min(1 << 16, (1 << (62 - bits)) // max(n, 1)), 1)
        work = np.cumsum(np.add.reduceat(short, first)) if len(first) else first
        found = []
        low = 0
        while low < len(first):
            done = work[low - 1] if low else 0
            high = min(max(int(np.searchsorted(work, done + _SCORED, side="right")), low + 1), low + most)
            entry = np.arange(first[low], last[high - 1])
            entry = entry[short[entry] > 0]
            count = short[entry]
            places_of = np.repeat(query[entry].astype(np.int64) - low, count) * n + at[stretches(starts[row[entry]], count)]
            places_of = places_of << bits | np.repeat(weight[entry], count)
            places_of.sort()
            hit = places_of >> bits
            once = np.flatnonzero(np.append(True, hit[1:] != hit[:-1])) if len(hit) else hit
            score = np.add.reduceat(places_of & ((1 << bits) - 1), once) if len(hit) else hit
            hit = hit[once]
            which = hit // n
            slot = hit - which * n
            lists = split[low:high] - first[low:high]
            for j in range(int(lists.max(initial=0))):
                more = np.flatnonzero(lists[which] > j)
                asks = first[low + which[more]] + j
                score[more] += marks[mark[asks], slot[more]] * weight[asks]
            keys = (score + boost[slot]) * n + backward[slot]
            # what is only in long lists
            other = np.concatenate(commons[low:high])
            of = np.repeat(np.arange(high - low), np.diff(common_from[low : high + 1]))
            if len(hit):
                wanted = of * n + (n - 1 - other % n)
                place_in = np.minimum(np.searchsorted(hit, wanted), len(hit) - 1)
                other, of = other[hit[place_in] != wanted], of[hit[place_in] != wanted]
            keys, which = np.concatenate([keys, other]), np.concatenate([which, of])
            top = int(keys.max(initial=0)) + 1
            ranks = which * top + (top - 1 - keys)
            ranks.sort()
            which, keys = ranks // top, top - 1 - ranks % top
            begins = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else which
            keep = np.arange(len(which)) - np.repeat(begins, np.diff(np.append(begins, len(which)))) < take
            keys, which = keys[keep], unit[first[low + which[keep]]]
            best = which, place[n - 1 - keys % n], keys // n
            found.append([b.astype(np.int32) if b.max(initial=0) < 1 << 31 else b for b in (_cut(limit, *_once(*best)) if paired else best)])
            low = high
        del commons
        which, best_places, scores = (concatenated([b[i] for b in found], np.int64) for i in range(3))
        block = np.full(len(which), key[0].as_py(), dtype=np.int64)
        return pa.table(
            [units.dictionary.take(pa.array(which)), *map(pa.array, (block, best_places, scores))], names=["unit", "block", "place", "score"]
        )

    return run


def _once(unit: np.ndarray, place: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each place of a query once, by its best score."""
    order = np.lexsort((-score, place, unit))
    unit, place, score = unit[order], place[order], score[order]
    first = np.append(True, (unit[1:] != unit[:-1]) | (place[1:] != place[:-1]))[: len(unit)]
    return unit[first], place[first], score[first]


def _cut(limit: int, unit: np.ndarray, place: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``limit`` best places of each query, in order."""
    order = np.lexsort((place, -score, unit))
    unit, place, score = unit[order], place[order], score[order]
    keep = _rank(unit) <= limit
    return unit[keep], place[keep], score[keep]


def _rank(unit: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else unit
    return np.arange(len(unit)) - np.repeat(first, np.diff(np.append(first, len(unit)))) + 1


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def _packs(size: int):
    """(pack, asked): queries of up to ``size`` consecutive numbers, the first of which is the pack's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), size):
                batch = whole.slice(low, size)
                asks, unit = batch.column("asks"), batch.column("unit")
                flat = asks.flatten()
                units = np.repeat(unit.to_numpy(), asks.value_lengths().to_numpy(zero_copy_only=False))
                asked = [units, flat.field("pattern"), flat.field("phrase"), flat.field("times")]
                blob = _packed(pa.table([pa.array(asked[0]), *asked[1:]], names=["unit", "pattern", "is_phrase", "times"]))
                yield pa.RecordBatch.from_arrays([unit.slice(0, 1), pa.array([blob], pa.binary())], names=["pack", "asked"])

    return run


def _postings(runs: tuple[np.ndarray, np.ndarray, np.ndarray], points: tuple[int, int], position: np.ndarray, alike: np.ndarray) -> Iterator[pa.Table]:
    """What patterns are found in which texts as lists of positions; an asset of several rows counts each of them as often as it has rows."""
    pattern, count, texts = runs

    del runs

    def listed(name: np.ndarray, own: np.ndarray, weight: np.ndarray, positions: np.ndarray) -> pa.Table:
        places = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(own)), pa.array(positions))
        names = ["pattern", "phrase_points", "token_points", "places"]
        return pa.table([pa.array(name), pa.array(weight * points[0]), pa.array(weight * points[1]), places], names=names)

    several = alike[texts] > 1
    if several.any():
        flat = np.repeat(pattern, count)
        size = int(position.max()) + 1
        weights = np.zeros(size, dtype=np.int64)
        weights[position] = alike
        pairs, times = np.unique(flat[several] * size + position[texts[several]], return_counts=True)
        name, at = pairs // size, pairs % size
        weight = times * weights[at]
        order = np.lexsort((at, weight, name))
        name, at, weight = name[order], at[order], weight[order]
        first = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (weight[1:] != weight[:-1])))
        yield listed(name[first], np.diff(np.append(first, len(name))), weight[first], at.astype(position.dtype))
        flat, texts = flat[~several], texts[~several]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else flat
        pattern, count = flat[first], np.diff(np.append(first, len(flat)))
    yield listed(pattern, count, np.ones(len(pattern), dtype=np.int64), position[texts])


def _handed(tables: list[pa.Table]) -> pa.Table:
    """All rows in one table, which nothing else holds."""
    whole = pa.concat_tables(tables)
    tables.clear()
    return whole


def _searched(best, together: int):
    """For the assets of a block, and their places and all packs of queries: (pack, found), the best places of each query of a pack."""

    def run(key: tuple[pa.Scalar, ...], assets: pa.Table, known: pa.Table) -> pa.Table:
        packs, blobs = [], []
        if len(assets):
            own = known.filter(pc.is_valid(known.column("key")))
            rows = {k: (p, a) for k, p, a in zip(*(own.column(c).to_pylist() for c in ("key", "place", "alike")), strict=True)}
            placed = np.array([rows[k] for k in assets.column("key").to_pylist()], dtype=np.int64).reshape(-1, 2)
            del rows, own
            places, local = np.unique(placed[:, 0], return_inverse=True)
            position = (local * 2 + assets.column("_certified").to_numpy()).astype(np.int32)
            fields = [(Texts(assets.column(f"_{f}")), points) for f, points in _FIELDS.items()]
            asked = known.filter(pc.is_valid(known.column("pack"))).select(["pack", "asked"]).sort_by("pack")
            del known
            tables: list[pa.Table] = []
            names: list[int] = []
            for i, (pack, blob) in enumerate(zip(asked.column("pack").to_pylist(), asked.column("asked"), strict=True)):
                tables.append(_unpacked(blob))
                names.append(pack)
                if i + 1 < len(asked) and sum(len(pc.unique(t.column("unit"))) for t in tables) < together:
                    continue
                flat = pa.concat_tables(tables)
                encoded = pa.chunked_array(flat.column("pattern").chunks).dictionary_encode()
                patterns = [p.encode() for p in encoded.chunk(0).dictionary.to_pylist()]
                code = np.concatenate([c.indices.to_numpy() for c in encoded.chunks]).astype(np.int64)
                postings = [t for texts, points in fields for t in _postings(texts.find(patterns), points, position, placed[:, 1])]
                flat = flat.set_column(flat.schema.get_field_index("pattern"), "pattern", pa.array(code))
                del encoded, patterns, code, tables
                if i + 1 == len(asked):
                    fields.clear()
                # each table is let go when it has been read
                found = best(key, _handed(postings), flat)
                unit, place, score = (found.column(c).to_numpy() for c in ("unit", "place", "score"))
                pack_of = np.searchsorted(names, unit, side="right") - 1
                order = np.argsort(pack_of, kind="stable")
                cuts = np.searchsorted(pack_of[order], np.arange(len(names) + 1))
                for j, name in enumerate(names):
                    part = order[cuts[j] : cuts[j + 1]]
                    if len(part):
                        packs.append(name)
                        blobs.append(_packed(_scored(unit[part], places[place[part]], score[part])))
                tables, names = [], []
        return pa.table([pa.array(packs, pa.int64()), pa.array(blobs, pa.binary())], names=["pack", "found"])

    return run


def _scored(unit: np.ndarray, place: np.ndarray, score: np.ndarray) -> pa.Table:
    order = np.lexsort((place, unit))
    return pa.table([pa.array(x[order]) for x in (unit, place, score)], names=["unit", "place", "score"])


def _ranked(limit: int, boosted: Sequence[int]):
    """For what all blocks found for a pack, and the pack: (unit, place, score, rank) of the best places; ``boosted`` ones match every query."""

    def run(key: tuple[pa.Scalar, ...], found: pa.Table, pack: pa.Table) -> pa.Table:
        best = (np.zeros(0, dtype=np.int64),) * 3
        for blob in found.column("found"):
            table = _unpacked(blob)
            best = _cut(limit, *(np.concatenate([b, table.column(c).to_numpy()]) for b, c in zip(best, ("unit", "place", "score"), strict=True)))
        if len(boosted) and len(pack):
            units = np.unique(_unpacked(pack.column("asked")[0]).column("unit").to_numpy())
            more = np.repeat(units, len(boosted)), np.tile(boosted, len(units)), np.full(len(units) * len(boosted), CERTIFIED_BOOST)
            best = _cut(limit, *_once(*(np.concatenate(b) for b in zip(best, more, strict=True))))
        return pa.table([*map(pa.array, best), pa.array(_rank(best[0]).astype(np.int32))], names=["unit", "place", "score", "rank"])

    return run


def search_queries(
    assets: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    asset_type: str | None = None,
    boost_requires_hit: bool = False,
) -> DataFrame:
    """``search`` for a table of queries (query_id, query) of any length: the same scores and ranks.

    The texts are dealt out by blocks of assets, once. Each block gets all different queries in compressed
    packs, finds their patterns in its vocabulary and the runs of words of its texts, adds up the lists of
    places of each query and hands on its ``limit`` best as packed numbers, so that neither words and
    assets nor queries and assets are ever rows. Equal queries are scored once. ``assets`` is read
    twice, first for the lengths of its texts, and must give the same rows.
    """
    if asset_type is not None:
        assets = assets.filter(F.col("asset_type") == asset_type.upper())
    assets = assets.withColumn("_certified", F.coalesce("certification_status", F.lit("")) == "CERTIFIED")
    size = sum((F.coalesce(F.octet_length(f), F.lit(0)).cast("bigint") for f in _FIELDS), F.lit(0).cast("bigint"))
    named = assets.groupBy("asset_id", "name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("_certified").alias("certified"), F.sum(size).alias("bytes")
    )
    # numbers in the order of ties
    placed = checkpointed(named.orderBy(F.col("name").asc_nulls_first(), "asset_id").withColumn("place", F.monotonically_increasing_id()))
    rows, size = placed.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    blocks = max(rows // BLOCK, size // BLOCK_BYTES, min(size >> 20, PIECES - 1)) + 1
    block = F.pmod(F.xxhash64("asset_id"), F.lit(blocks)).alias("block")
    key = F.to_json(F.struct("asset_id", "name")).alias("key")
    texts = assets.where("asset_id is not null").select(
        block, key, "_certified", *(F.lower(F.coalesce(f, F.lit(""))).alias(f"_{f}") for f in _FIELDS)
    )

    ask = F.array_sort(F.collect_list(F.struct("pattern", "phrase", "times"))).alias("asks")
    wanted = query_patterns(queries).groupBy("query_id").agg(ask)
    wanted = checkpointed(wanted.withColumn("same", F.unhex(F.sha2(F.to_json("asks"), 256))))
    units = checkpointed(wanted.groupBy("same").agg(F.first("asks").alias("asks")).withColumn("unit", F.monotonically_increasing_id()))
    packs = checkpointed(units.select("unit", "asks").mapInArrow(_packs(min(UNITS, PACK)), "pack long, asked binary"))

    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block")
    alike = F.sum("rows").over(Window.partitionBy("asset_id")).alias("alike")
    known = placed.where("asset_id is not null").select(block, key, "place", alike).unionByName(packs.select(every, "pack", "asked"), allowMissingColumns=True)
    found = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _searched(_best(limit, not boost_requires_hit), UNITS), "pack long, found binary"
    )
    boosted = []
    if not boost_requires_hit:
        # of the assets that have nothing but the boost only the first few can be shown
        left = limit
        for place, certified in placed.where("certified > 0").orderBy("place").limit(limit).select("place", "certified").collect():
            if left > 0:
                boosted.append(place)
            left -= certified
    best = found.groupBy("pack").cogroup(packs.groupBy("pack")).applyInArrow(
        _ranked(limit, boosted), "unit long, place long, score long, rank int"
    )
    shown = best.join(placed.select("place", "asset_id", "name"), "place").join(units.join(wanted, "same").select("query_id", "unit"), "unit")
    return shown.select("query_id", F.col("score").cast("double").alias("relevance_score"), "asset_id", "name", "rank")
