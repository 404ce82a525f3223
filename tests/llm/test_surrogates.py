import re

from pyspark.sql import functions as F

from tabellion.llm import surrogates as s
from tabellion.llm.common import table


def replaced(spark, texts, key="k"):
    rows = [(i, t, "mine") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, mention string")
    out = s.pseudonymise(frame, key, keep_count="n")
    assert out.columns == ["doc_id", "text", "mention", "n"]
    return [r for r in out.orderBy("doc_id").collect()]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def test_types_formats_and_coreference(spark):
    texts = [
        "Mail bob.smith@corp.example.com or BOB.SMITH@CORP.EXAMPLE.COM and eve@corp.example.com.",
        "Call +1 (499) 555-6503, +1 499-555-6503 or +49 30 1234 5678.",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### and 24BE64439E3E49CF46B2D7C90F3602A3D0B907FF!',
        "cards 4111 1111 1111 1111, 4111-1111-1111-1111 and 9807915762804490$$$ at 152.143.123.131###",
        "Mrs Anna Schmidt met Mr. John Miller and Г-жа Ирина Петрова. MRS ANNA SCHMIDT left; SSN 123-45-6789.",
        "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000",
        None, "", "no entity, version 3. 2024", "password: hunter2xyz " * 3000,
    ]
    got = replaced(spark, texts)
    out = [r.text for r in got]
    assert [r.n for r in got] == [3, 3, 2, 4, 5, 2, 0, 0, 0, 3000]
    assert out[6:9] == texts[6:9]
    a, b, c = re.findall(r"[\w.]+@[\w.]+\w", out[0])
    assert b == a.upper() and a != "bob.smith@corp.example.com" and c.split("@")[1] == a.split("@")[1] and a.count(".") == 3
    p, q = re.findall(r"\+1 \(?\d{3}\)?[ -]\d{3}-\d{4}", out[1])
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q) != "14995556503" and "(" in p and "(" not in q
    low, up = re.findall(r"[0-9a-f]{40}|[0-9A-F]{40}", out[2])
    assert up == low.upper() and out[2].startswith('token = "') and out[2].endswith("!")
    x, y = re.findall(r"(?:\d{4}[ -]){3}\d{4}", out[3])
    assert x.replace(" ", "") == y.replace("-", "") != "4111111111111111" and luhn(x.replace(" ", ""))
    assert "9807915762804490" not in out[3] and "152.143.123.131" not in out[3] and out[3].count("###") == 1
    ip = re.search(r"\d+\.\d+\.\d+\.\d+", out[3]).group()
    assert all(int(n) < 256 for n in ip.split("."))
    names = re.match(r"Mrs (\w+ \w+) met Mr\. (\w+ \w+) and Г-жа ([А-Яа-я]+ [А-Яа-я]+)\. MRS (\w+ \w+) left", out[4]).groups()
    assert names[0].split()[0] in s.GIVEN["female", "latin"] and names[1].split()[0] in s.GIVEN["male", "latin"]
    assert names[2].split()[0] in s.GIVEN["female", "cyrillic"] and names[3] == names[0].upper() and names[0] != "Anna Schmidt"
    iban = re.findall(r"DE[\d ]+\d", out[5])
    assert iban[0].replace(" ", "") == iban[1] and iban[0].count(" ") == 5 and "3704" not in iban[0]
    assert len(set(out[9].split())) == 2 and "hunter2xyz" not in out[9]


def test_keys_and_repeats(spark):
    texts = ["ip 10.1.2.3", "ip 10.1.2.3", "again 10.1.2.3 and 10.1.2.4"]
    first, other = replaced(spark, texts), replaced(spark, texts, "other key")
    assert first == replaced(spark, texts) and first[0].text == first[1].text != other[0].text
    one = first[0].text.split()[1]
    assert one in first[2].text and len(set(re.findall(r"[\d.]{7,}", first[2].text))) == 2


def test_collisions_are_redrawn(spark):
    """All 16 identities of one hexadecimal digit: surrogates must differ and be no identity, so they grow."""
    ids = spark.createDataFrame([("secret", c) for c in "0123456789abcdef"], "family string, identity string")
    got = s.surrogates(ids, "k").collect()
    drawn = [r.surrogate for r in got]
    assert len(got) == 16 and len(set(drawn)) == 16 and not set(drawn) & set("0123456789abcdef")


def test_distinct_over_a_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = s.pseudonymise(docs, "k").collect()
    assert len(after) == len(before)
    pattern = r"[\w.+-]+@[\w.-]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b|\+1 \(\d+\) \d+-\d+|[0-9a-f]{40}|[0-9A-F]{40}"
    known = {m.lower() for t in before.values() for m in re.findall(pattern, t)}
    seen: dict[str, str] = {}
    for row in after:
        old, new = re.findall(pattern, before[row.doc_id]), re.findall(pattern, row.text)
        assert len(old) == len(new)
        assert re.split(pattern, before[row.doc_id]) == re.split(pattern, row.text)
        for a, b in zip(old, new, strict=True):
            assert seen.setdefault(a.lower(), b.lower()) == b.lower() and b.lower() not in known
    assert len(set(seen.values())) == len(seen)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert s.pseudonymise(frame, "k").count() == 0
    assert s.mentions(spark.createDataFrame([(1, "x")], "doc_id long, text string")).agg(F.count("*")).first()[0] == 0


ADVERSARIAL = {
    "email": ["x@" + "a." * 500_000 + "1", "x@" + "a" * 1_000_000, "a" * 1_000_000, "x@" * 500_000, "x@" + "a.bc" * 250_000],
    "secret": ["password=" * 110_000, "password=" + "a" * 1_000_000, "token: '" + "x" * 1_000_000],
    "hex": ["a" * 1_000_000, "aA" * 500_000],
    "iban": ["DE89" + " 3704" * 10_000, "DE89" * 250_000],
    "ip": ["1." * 500_000, "1.1.1." * 160_000],
    "card": ["1 " * 20_000, "4111-" * 10_000, "1" * 1_000_000],
    "ssn": ["123-45-" * 5_000, "123-" * 250_000],
    "phone": ["+1 (" * 250_000, "123 " * 10_000, "+" * 1_000_000],
    "person": ["Mr " * 10_000, "Mr " + "A" * 1_000_000, "Mrs Anna " * 2_000],
}


def test_adversarial_texts_of_any_kind_end_no_task(spark):
    """Neither the stack nor the time of the search grows beyond the text."""
    texts = [t for kind in s.KINDS for t in ADVERSARIAL[kind]]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    assert len(frame.select(F.regexp_count("text", F.lit(s.PATTERN))).collect()) == len(texts)


def test_domains_of_many_labels(spark):
    many = "x@" + "ab." * 100 + "com"
    out = replaced(spark, [f"mail {many} now", "mail a.b-c@d-e.co.uk. and x@y..z and p@q.r1com"])
    assert many not in out[0].text and out[0].n == 1 and out[1].n == 1
