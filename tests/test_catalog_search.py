import random

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabellion.operators import catalog, search
from tabellion.sources import tables as sources

CHANGES = "asset_id string, ts timestamp_ntz, id int, name string, description string, owner string, certification_status string, quality_score double"


def changes(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [
        ("e.p.t", at, 1, None, "first", None, None, None),
        ("e.p.t", at, 2, None, None, "ann", None, 0.5),
        ("e.p.t", at, 3, "T", "third", None, "CERTIFIED", None),
        ("e.p.u", at, 4, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, CHANGES)


@pytest.mark.parametrize("limit", [1, 1000])
def test_versions(spark, limit):
    history = {(r.asset_id, r.version): r for r in catalog.asset_history(changes(spark), ["ts", "id"], max_group_rows=limit).collect()}
    first, second, third = (history["e.p.t", v] for v in (1, 2, 3))
    assert (first.change_type, first.before_state, first.owner, first.name) == ("CREATE", None, "Data Governance Guild", "t")
    assert (second.change_type, second.description, second.owner) == ("UPDATE", "first", "ann")
    assert (third.name, third.certification_status, third.quality_score) == ("T", "CERTIFIED", 0.5)
    assert '"owner":"ann"' in third.before_state and '"version":2' in third.before_state
    assert '"description":"third"' in third.after_state and '"owner":null' in third.after_state
    assert history["e.p.u", 1].certification_status == "DRAFT" and history["e.p.u", 1].description == ""


def test_history_on_a_base_equals_one_history(spark):
    whole = catalog.asset_history(changes(spark), ["ts", "id"])
    first = catalog.asset_history(changes(spark).filter("id < 3"), ["ts", "id"])
    base = catalog.current_assets(first, "ts")
    second = catalog.asset_history(changes(spark).filter("id >= 3"), ["ts", "id"], base=base)
    assert sorted(map(str, whole.collect())) == sorted(map(str, first.unionByName(second).select(whole.columns).collect()))


def test_sync_modes(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    update = spark.createDataFrame([(2, None, 9), (3, "c", None)], "k int, x string, y int")
    merged = {m: sorted(map(tuple, sources.merge_by_key(stored, update, ["k"], m).collect()), key=str) for m in ("upsert", "replace", "append")}
    assert merged["upsert"] == [(1, "a", 1), (2, "b", 9), (3, "c", None)]
    assert merged["replace"] == [(1, "a", 1), (2, None, 9), (3, "c", None)]
    assert len(merged["append"]) == 4
    with pytest.raises(ValueError):
        sources.merge_by_key(stored, update, ["k"], "guess")


def test_models_build_in_dependency_order(spark, tmp_path):
    start = spark.range(5)
    built = sources.materialise(
        spark,
        {"c": (["b"], lambda b: b.filter("id > 2")), "b": (["a"], lambda a: a.withColumn("x", F.col("id") * 2))},
        {"a": start},
        str(tmp_path),
    )
    assert built["c"].count() == 2
    with pytest.raises(ValueError):
        sources.materialise(spark, {"x": (["y"], lambda y: y)}, {}, str(tmp_path))


def assets(spark):
    return spark.createDataFrame(
        [
            ("e.p.orders", "e", "TABLE", "orders", "Customer order facts", "CERTIFIED"),
            ("e.p.log", "e", "TABLE", "log", None, "DRAFT"),
            ("e.p.orders.email", "e.p.orders", "COLUMN", "email", "Contact of the order", "DRAFT"),
            ("e.p.orders.n", "e.p.orders", "COLUMN", "n", "Count", "DRAFT"),
        ],
        "asset_id string, parent_id string, asset_type string, name string, description string, certification_status string",
    ).withColumns({"display_name": F.lit(None).cast("string"), "data_type": F.lit("string"), "owner": F.lit("o"), "quality_score": F.lit(0.9)})


def test_search_scores(spark):
    found = {r.asset_id: r.relevance_score for r in search.search(assets(spark), {"q": "Order facts"}).collect()}
    # phrase and both tokens in the text, one token in the name, and the boost
    assert found["e.p.orders"] == 25 + 10 + 10 + 20 + 15 and found["e.p.orders.email"] == 10
    assert "e.p.log" not in found
    boosted = search.search(assets(spark), {"q": "zzz"}).collect()
    assert [r.asset_id for r in boosted] == ["e.p.orders"] and boosted[0].relevance_score == 15
    assert search.search(assets(spark), {"q": "zzz"}, boost_requires_hit=True).isEmpty()
    plan = search.search(assets(spark), {"q": "a b", "r": "c"})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" in plan


def test_masking_by_role(spark):
    tags = spark.createDataFrame([("e.p.orders.email", "PII", "EMAIL")], "asset_id string, tag_name string, tag_value string")
    for role, masked in (("ANALYST", True), ("COMPLIANCE_STEWARD", False), ("security_admin", False)):
        rows = {r.column_name: r for r in search.one_asset_context(assets(spark), tags, "e.p.orders", role).collect()}
        assert rows["email"].is_masked == masked and not rows["n"].is_masked and rows["email"].pii_type == "EMAIL"
    with pytest.raises(KeyError):
        search.one_asset_context(assets(spark), tags, "e.p.none")
    df = spark.createDataFrame([("ann@x", 5), (None, 6)], "email string, n int")
    assert [r.email for r in search.mask_frame(df, {"email": "EMAIL"}, "ANALYST").collect()] == ["[RESTRICTED_EMAIL]", None]
    assert search.mask_frame(df, {"email": "EMAIL"}, "ANALYST", {"email": "partial"}).first().email == "an***"
    assert search.mask_frame(df, {"email": "EMAIL"}, "SECURITY_ADMIN").first().email == "ann@x"


def test_prompt_gate(spark):
    prompts = spark.createDataFrame([("dump customer_id, email and address",), ("total revenue by state",)], "text string")
    rows = search.gate_prompts(prompts, "text").collect()
    assert rows[0].status == "REFUSED_BY_POLICY" and rows[0].policy_citation == "POL-002,POL-006" and rows[1].status == "PERMITTED"
    assert search.gate_prompts(prompts, "text", "SECURITY_ADMIN").first().status == "PERMITTED"


def test_asset_list_preview(spark):
    tags = spark.createDataFrame([("e.p.orders.email", "PII", "EMAIL")], "asset_id string, tag_name string, tag_value string")
    rows = {r.name: r for r in catalog.asset_list(assets(spark), tags, preview=1).collect()}
    assert (rows["orders"].total_columns, rows["orders"].pii_columns_count, rows["orders"].columns) == (2, 1, ["email"])
    assert rows["log"].total_columns == 0 and rows["log"].display_name == "Log"
    assert [r.name for r in catalog.asset_list(assets(spark), tags, query="FACTS", pii_only=True).collect()] == ["orders"]


def test_inventory(spark):
    table = spark.createDataFrame([(1, None), (2, "x")], "id int, note string")
    rows = {r.asset_id: r for r in catalog.schema_inventory({"fct_sales": table, "raw_x": table}, consumers={"dashboard.d": ("D", "fct_sales")}).collect()}
    assert rows["estate.public.fct_sales"].certification_status == "CERTIFIED" and rows["estate.public.raw_x"].owner == "Data Engineering"
    assert rows["estate.public.fct_sales.note"].null_percentage == 50.0 and rows["estate.public.fct_sales"].display_name == "Fct Sales"
    assert rows["dashboard.d"].asset_type == "DASHBOARD"


def test_masking_keeps_types_and_takes_a_salt(spark):
    df = spark.createDataFrame([(7, 7, 1.5, "ann")], "k long, i int, x double, t string")
    kinds = {c: "FINANCIAL" for c in df.columns}
    for methods in ({"k": "hash", "i": "hash", "x": "null", "t": "hash"}, {c: "label" for c in df.columns}):
        assert search.mask_frame(df, kinds, "ANALYST", methods, "s").schema.simpleString() == df.schema.simpleString()
    one, two = (search.mask_frame(df, kinds, "ANALYST", {"k": "hash"}, salt).first().k for salt in ("a", "b"))
    assert one != two and one != 7


def test_queries_as_a_table_score_like_queries_in_the_plan(spark):
    rng = random.Random(2)
    words = ["order", "Facts", "customer", "a", "of", "né", "ée", "x%y", "tier_1", "id", "AN"]
    rows = [
        (f"t{i}", rng.choice([None, "_".join(rng.choices(words, k=2))]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(6)))]),
         rng.choice(["CERTIFIED", "DRAFT", None]), rng.choice(["TABLE", "COLUMN"]))
        for i in range(120)
    ]
    frame = spark.createDataFrame(rows, "asset_id string, name string, description string, certification_status string, asset_type string")
    queries = {f"q{i}": q for i, q in enumerate(
        ["order facts", "a", "", "  ", "né ée", "customer customer id", "x%y tier_1", "zzz", " Facts of", "ORDER", "of", "order of a customer"]
    )}
    table = spark.createDataFrame([*queries.items(), ("none", None)], "query_id string, query string")
    for options in ({}, {"boost_requires_hit": True}, {"asset_type": "table", "limit": 3}, {"limit": 500}):
        one = {tuple(r) for r in search.search(frame, queries, **options).collect()}
        many = {tuple(r) for r in search.search_queries(frame, table, **options).collect()}
        assert many == one
    assert search.search_queries(frame, table.limit(0)).count() == 0
    assert search.search_queries(frame.limit(0), table).count() == 0


def test_many_queries_are_scored_by_blocks_without_pairs(spark, monkeypatch):
    """Common words are in every asset and every query: the pairs must not become rows."""
    rng = random.Random(5)
    words = ["the", "of", "data", "Order", "x", "theory", "é"]
    assets = [
        (i // 2 if i < 20 else i, f"n{i % 5}" if i % 9 else None, "".join(w + rng.choice([" ", "  ", "\n", ". "]) for w in rng.choices(words, k=12)),
         rng.choice(["CERTIFIED", "DRAFT"]))
        for i in range(20, 400)
    ]
    frame = spark.createDataFrame([(*a, "TABLE") for a in assets], "asset_id long, name string, description string, certification_status string, asset_type string")
    queries = {i: q for i, q in enumerate(
        ["the of data", "the of", "of  the", " the", "the ", "data order x theory", "e", "x.", ". of", "order\nthe", "the of data", "n1", "he o", "\n"] * 3
    )}
    table = spark.createDataFrame([*queries.items()], "query_id int, query string")
    monkeypatch.setattr(search, "BLOCK", 50)
    monkeypatch.setattr(search, "UNITS", 4)
    handed, best = [], search._best

    def counted(limit, merged):
        handed.append((limit, merged))
        return best(limit, merged)

    monkeypatch.setattr(search, "_best", counted)
    one = {tuple(r) for r in search.search(frame, queries, limit=4).collect()}
    many = {tuple(r) for r in search.search_queries(frame, table, limit=4).collect()}
    assert many == one and handed == [(4, True)]


def test_best_places_of_a_block():
    import pyarrow as pa

    places = pa.table({
        "pattern": ["a", "a", "b"], "phrase_points": [25, 50, 25], "token_points": [10, 20, 10], "places": pa.array([[0, 3, 4], [7], [3, 8, 9]], pa.list_(pa.int64())),
    })
    asked = pa.table({"unit": ["u", "u", "v", "w"], "pattern": ["a", "b", "b", "none"], "is_phrase": [False, False, True, False], "times": [2, 1, 1, 1]})
    for limit, u in ((2, {(1, 45), (3, 55)}), (9, {(0, 20), (1, 45), (2, 20), (3, 55), (4, 25)})):
        found = search._best(limit, True)((pa.scalar(6), pa.scalar(0)), places, asked).to_pylist()
        assert {(r["place"], r["score"]) for r in found if r["unit"] == "u"} == u
        assert {(r["place"], r["score"]) for r in found if r["unit"] == "v"} == {(1, 40), (4, 40)}
        assert {r["block"] for r in found} == {6} and len(found) == len(u) + 2


def test_no_rows_per_word_are_kept_for_many_queries(spark, monkeypatch):
    """What is kept between the steps are assets and queries, not the words of the texts (which filled the disk)."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    frame = spark.createDataFrame(
        [(i, "n", " ".join(rng.choices(words, k=200)), None, "TABLE") for i in range(40)],
        "asset_id long, name string, description string, certification_status string, asset_type string",
    )
    queries = {i: " ".join(rng.sample(words, 3)) for i in range(20)}
    kept, checkpointed = [], search.checkpointed

    def counted(df):
        done = checkpointed(df)
        kept.append((done.count(), done.columns))
        return done

    monkeypatch.setattr(search, "checkpointed", counted)
    many = {tuple(r) for r in search.search_queries(frame, spark.createDataFrame([*queries.items()], "query_id int, query string")).collect()}
    assert many == {tuple(r) for r in search.search(frame, queries).collect()}
    assert kept and all(rows <= 40 for rows, _ in kept)


def test_long_and_short_lists_marks_and_boosts_agree_with_the_plan(spark, monkeypatch):
    """Rare and common words, the same asset in several rows and at two positions, more than one block, and ids that are null."""
    rng = random.Random(11)
    words = ["the", "of", *[f"rare{i}" for i in range(40)]]
    rows = [(i, f"n{i % 7}", " ".join(rng.choices(words, weights=[20, 20, *[1] * 40], k=15)), "CERTIFIED" if i % 10 == 0 else None, "TABLE") for i in range(300)]
    queries = {i: " ".join(rng.choices(words, k=3)) for i in range(60)}
    schema = "asset_id long, name string, description string, certification_status string, asset_type string"
    table = spark.createDataFrame([*queries.items()], "query_id int, query string")
    monkeypatch.setattr(search, "BLOCK", 70)
    frame = spark.createDataFrame(rows, schema)
    for options in ({}, {"boost_requires_hit": True}):
        one = {tuple(r) for r in search.search(frame, queries, **options).collect()}
        assert {tuple(r) for r in search.search_queries(frame, table, **options).collect()} == one
    # an asset with both states is shown once, by the better one; null ids are only found by their boost
    odd = spark.createDataFrame([(1, "a", "the", "CERTIFIED", "TABLE"), (1, "a", "rare1", None, "TABLE"), (None, None, "of", "CERTIFIED", "TABLE")], schema)
    got = {(r.query_id, r.asset_id): r.relevance_score for r in search.search_queries(odd, spark.createDataFrame([(1, "rare1"), (2, "of")], "query_id int, query string")).collect()}
    assert got == {(1, 1): 70.0, (1, None): 15.0, (2, None): 15.0, (2, 1): 15.0}
