import random
import time

import pytest
from pyspark.sql import functions as F

from tabellion.functions import patterns
from tabellion.operators import classify, profile, reconcile, textscan

HEX = "06b8999e2fba1a1fbc88172c00ba8bc7"


def people(spark):
    return spark.createDataFrame(
        [(1, "a@x.org", "1234", None, 1.5, HEX), (2, "b@x.org", "12345", None, -2.0, HEX), (3, "c@x.org", None, None, None, HEX)],
        "customer_id long, contact string, zip_code_prefix string, nothing string, amount double, token string",
    )


def test_profile_invariants(spark):
    rows = {r.column_name: r for r in profile.profile_table(people(spark), "people").collect()}
    assert rows["customer_id"].is_unique and rows["customer_id"].distinct_count == 3
    assert rows["contact"].detected_patterns == ["EMAIL_PATTERN"]
    assert rows["zip_code_prefix"].null_percentage == 33.33 and "ZIP_PATTERN" in rows["zip_code_prefix"].detected_patterns
    assert rows["nothing"].min_value is None and rows["nothing"].cardinality_ratio == 0.0 and rows["nothing"].sample_values == []
    assert (rows["amount"].min_value, rows["amount"].max_value, rows["amount"].avg_value) == ("-2", "1.5", -0.25)
    assert rows["token"].detected_patterns == ["HEX_ID_PATTERN"]
    assert rows["amount"].neighbor_columns == ["customer_id", "contact", "zip_code_prefix", "nothing", "token"]


def test_profile_of_an_empty_table(spark):
    rows = profile.profile_table(people(spark).filter("false"), "people").collect()
    assert len(rows) == 6
    assert all(r.total_rows == 0 and r.null_percentage == 0.0 and r.sample_values == [] for r in rows)


def test_profile_of_a_union_adds_up(spark):
    once = {r.column_name: r for r in profile.profile_table(people(spark), "t").collect()}
    twice = {r.column_name: r for r in profile.profile_table(people(spark).unionAll(people(spark)), "t").collect()}
    for name, row in once.items():
        assert twice[name].total_rows == 2 * row.total_rows and twice[name].null_count == 2 * row.null_count
        assert twice[name].distinct_count == row.distinct_count and twice[name].sample_values == row.sample_values


def test_long_texts_are_counted_whole(spark):
    texts = ["x" * 400 + str(i % 7) for i in range(30)] + [None, "short"]
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    row = profile.profile_table(df, "notes").first()
    assert (row.total_rows, row.null_count, row.distinct_count) == (32, 1, 8)
    assert row.min_value == "short" and row.max_value == "x" * 400 + "6"
    assert row.sample_values == ["short", *["x" * 400 + str(i) for i in range(4)]]


def test_a_long_value_does_not_change_the_samples(spark):
    short = [(f"v{i:02d}",) for i in range(20)]
    for more in ([], [("z" * 300,)], [("z" * 3000,), ("z" * 3000 + "y",)]):
        row = profile.profile_table(spark.createDataFrame([*short, *more], "body string"), "t").first()
        assert row.sample_values == [f"v{i:02d}" for i in range(5)]
        assert row.max_value == (more[-1][0] if more else "v19") and row.distinct_count == 20 + len(more)


def test_redaction_ignores_case(spark):
    rows = spark.createDataFrame([("Ask JO@X.org, jo@x.ORG or (a.b)\\E.", ["jo@x.org", "(A.B)\\E"])], "text string, leaks array<string>")
    found = rows.select(reconcile.redact_values(F.col("text"), F.col("leaks")).alias("t")).first().t
    assert found == "Ask [REDACTED_PII], [REDACTED_PII] or [REDACTED_PII]."


def test_column_names_resolve_without_case_and_punctuation(spark):
    row = profile.profile_column(people(spark), "people", "CustomerID").first()
    assert row.column_name == "customer_id" and row.total_rows == 3 and row.ordinal == 0


def test_few_scans_per_family(spark, tmp_path):
    people(spark).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    found = profile.profile_table(df, "people")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") <= 5  # whole numbers, real numbers; strings for counts, smallest and largest values


def annotated(spark, **options):
    return classify.annotate(profile.profile_table(people(spark), "people"), **options)


def test_classification_and_glossary(spark):
    rows = {r.column_name: r for r in annotated(spark).collect()}
    kinds = {n: r.classification.pii_type for n, r in rows.items()}
    assert kinds["contact"] == "EMAIL" and kinds["zip_code_prefix"] == "POSTAL_CODE" and kinds["customer_id"] == "CUSTOMER_ID"
    assert not rows["amount"].classification.is_pii
    assert rows["customer_id"].glossary.term_name == "Customer Identifier" and not rows["customer_id"].glossary.is_new_term
    assert rows["amount"].glossary.term_name == "Amount" and rows["amount"].description.confidence == 0.94
    kinds = [r.rule_type for r in rows["amount"].rules]
    assert kinds == ["RANGE_CHECK"] and rows["amount"].rules[0].min_value == -2.2


def test_upstream_tag_makes_a_column_sensitive(spark):
    profiles = profile.profile_table(people(spark), "people").withColumn("up", F.array(F.lit("PII")))
    rows = {r.column_name: r.classification for r in classify.annotate(profiles, upstream_tags="up").collect()}
    assert rows["amount"].pii_type == "CUSTOMER_ID" and rows["amount"].confidence == 0.95
    assert rows["contact"].pii_type == "EMAIL"


def test_leaked_sample_is_redacted_and_blocks_the_write(spark):
    leaky = annotated(spark).withColumn(
        "description", F.col("description").withField("description", F.concat(F.lit("Like "), F.coalesce(F.get("sample_values", F.lit(0)), F.lit("none"))))
    )
    rows = {r.column_name: r for r in reconcile.reconcile(leaky).collect()}
    assert rows["contact"].description == "Like [REDACTED_PII]" and not rows["contact"].can_auto_write
    assert [f.flag_type for f in rows["contact"].flags] == ["PII_SAMPLE_LEAKAGE"]
    assert rows["token"].description == f"Like {HEX}"


def test_disagreement_and_low_confidence(spark):
    odd = annotated(spark, rules=()).withColumn("description", F.col("description").withField("confidence", F.lit(0.5)))
    rows = {r.column_name: r for r in reconcile.reconcile(odd).collect()}
    assert rows["zip_code_prefix"].pii_type == "POSTAL_CODE" and rows["contact"].pii_type == "SENSITIVE"
    assert {f.flag_type for f in rows["contact"].flags} == {"PATTERN_DISAGREEMENT", "LOW_CONFIDENCE"}


def test_text_scan_reads_whole_texts(spark):
    body = "word " * 5000 + "mail me at jo@site.example.org or 10.0.0.1 "
    df = spark.createDataFrame([(1, body), (2, "nothing")], "id int, text string")
    assert {(r.id, r.pattern, r.hits) for r in textscan.scan_text(df, "id", "text").collect()} == {(1, "EMAIL", 1), (1, "IP_ADDRESS", 1)}
    clean = df.select(textscan.redact_text(F.col("text")).alias("t")).first().t
    assert "jo@site" not in clean and clean.endswith("[REDACTED_PII] ")


def test_the_longest_value_is_redacted_first(spark):
    rows = spark.createDataFrame(
        [("Anna Schmidt met Anna and REDACTED", ["Anna", "Anna Schmidt", "redacted", "", None]), ("none", []), ("no list", None)],
        "text string, leaks array<string>",
    )
    found = [r.t for r in rows.select(reconcile.redact_values(F.col("text"), F.col("leaks")).alias("t")).collect()]
    assert found == ["[REDACTED_PII] met [REDACTED_PII] and [REDACTED_PII]", "none", "no list"]


ADVERSARIAL = {
    "EMAIL": ["x@" + "a." * 500_000 + "!", "x@" + "a" * 1_000_000, "a" * 1_000_000 + " @", "a.b@" * 250_000, "x@" + "-." * 500_000],
    "IP_ADDRESS": ["1." * 500_000, "1" * 1_000_000, "1.1.1." * 160_000],
    "CARD_NUMBER": ["1" * 1_000_000, "1234 " * 200_000],
    "PHONE": ["+" * 1_000_000, "+1" + " " * 1_000_000, "+1 (" * 250_000, "+" + "1" * 1_000_000],
    "DATE_ISO": ["2024-" * 200_000, "2024-01-" * 120_000, "-" * 1_000_000],
}


@pytest.mark.parametrize("name", list(patterns.SCAN_PATTERNS))
def test_patterns_read_a_megabyte_in_linear_time(spark, name):
    texts = [(i, t) for i, t in enumerate(ADVERSARIAL[name])]
    rows = spark.createDataFrame(texts, "i int, text string")
    start = time.perf_counter()
    assert len(textscan.scan_text(rows, "i", "text", {name: patterns.SCAN_PATTERNS[name]}).collect()) <= len(texts)
    rows.select(F.length(textscan.redact_text(F.col("text"), {name: patterns.SCAN_PATTERNS[name]}))).collect()
    assert time.perf_counter() - start < 30


@pytest.mark.parametrize("name", list(patterns.VALUE_PATTERNS))
def test_value_patterns_read_a_megabyte_in_linear_time(spark, name):
    texts = [*ADVERSARIAL["EMAIL"], "1" * 1_000_000, "a\U0001d49c" * 300_000 + "@", "$" + "1" * 1_000_000 + ".", "a" * 32 * 30_000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    start = time.perf_counter()
    rows.select(patterns.matches(F.col("text"), name)).collect()
    assert time.perf_counter() - start < 20


def test_both_email_patterns_find_the_same(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1.-_+@@.. x") for _ in range(rng.randrange(60))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain, quick = (F.regexp_extract_all("text", F.lit(p["EMAIL"]), 0) for p in (patterns.TEXT_PATTERNS, patterns.SCAN_PATTERNS))
    assert rows.where(plain != quick).count() == 0 and rows.where(F.size(quick) > 0).count() > 100


def test_short_strings_are_read_once(spark, tmp_path):
    rows = [(f"s{n % 7:02d}", ("x" * 64 + str(n % 5)) if n % 2 else None, "only") for n in range(40)]
    spark.createDataFrame(rows, "short string, long string, same string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    bare = profile.profile_tables({"t": df.select("short", "same")})
    assert "Scan parquet" not in bare._jdf.queryExecution().executedPlan().toString()
    got = {r.column_name: r for r in profile.profile_tables({"t": df}).collect()}
    assert (got["short"].min_value, got["short"].max_value, got["short"].distinct_count) == ("s00", "s06", 7)
    assert got["short"].sample_values == [f"s{n:02d}" for n in range(5)]
    assert (got["long"].min_value, got["long"].max_value) == ("x" * 64 + "0", "x" * 64 + "4")
    assert (got["long"].distinct_count, got["long"].null_count, got["same"].sample_values) == (5, 20, ["only"])
