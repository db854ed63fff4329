import random

from pyspark.sql import functions as F

from lookout.functions import text


def column(spark, values, name="s"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id INT, {name} STRING")


def strip(spark, values, **kw):
    df = text.with_stripped_html(column(spark, values), "s", "out", **kw)
    return [r.out for r in df.orderBy("id").collect()]


# Each text with what is left of it, worked out by hand.
STRIPPED = [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a</p><br>b", "a b"), ("R&D &amp; more", "R&D & more"),
    ("&amp;lt;b&amp;gt;", "&lt;b&gt;"), ("a&nbsp;b", "a b"), ("&eacute;&eacute", "éé"), ("&#233;&#xe9;", "éé"),
    ("&notit; &ampx", "¬it; &x"), ("x\x1cy z", "x y z"), ("&", "&"), ("a & b &", "a & b &"), ("<a\nb>c", "c"),
    ("1 < 2 > 0", "1 0"), ("<>", "<>"), ("&copy;&middot;&quot;&#39;&apos;", "©·\"''"), ("&;", "&;"), ("&am", "&am"),
]


def test_strip_html_cases(spark):
    assert strip(spark, [given for given, _ in STRIPPED]) == [left for _, left in STRIPPED]


def test_strip_html_random(spark):
    rng = random.Random(3)
    bits = ["<b>", "</b>", "x", " ", "\n", "R&D", "é", ";", "\x1f"]
    entities = {"&amp;": "&", "&eacute;": "é", "&#65;": "A", "&middot;": "·", "&copy;": "©"}
    values = ["".join(rng.choices([*bits, *entities], k=rng.randint(0, 14))) for _ in range(500)]
    for given, left in zip(values, strip(spark, values)):
        assert "<b>" not in left and "</b>" not in left and "  " not in left and left == left.strip()
        for name, char in entities.items():
            assert name not in left and (name not in given or char in left)
        assert left.count("x") == given.count("x")


def test_strip_html_unescape_first_drops_encoded_markup(spark):
    assert strip(spark, ["&lt;b&gt;x&lt;/b&gt;"]) == ["<b>x</b>"]
    assert strip(spark, ["&lt;b&gt;x&lt;/b&gt;"], unescape_first=True) == ["x"]


def test_common_entities_stay_in_the_jvm(spark):
    df = column(spark, ["a &amp; b", "R&D", "&eacute;"])
    rare = [r[0] for r in df.select(F.col("s").rlike(text.OTHER_ENTITY)).collect()]
    assert rare == [False, True, True]


def test_escape_and_alert(spark):
    df = spark.createDataFrame(
        [("A & <B>", "C&C", "", 7, "http://x?a=1&b=2"), (None, None, None, 1, None)],
        "title STRING, company STRING, location STRING, score INT, url STRING")
    out = [r[0] for r in df.select(text.alert_text()).collect()]
    assert out[0] == ("\U0001f6a8 <b>A &amp; &lt;B&gt;</b>\n\U0001f3e2 C&amp;C\n\U0001f4cd —\n"
                      "⭐ score: 7\n\U0001f517 <a href=\"http://x?a=1&amp;b=2\">Apply</a>")
    assert out[1].startswith("\U0001f6a8 <b></b>\n")


def test_small_functions(spark):
    row = spark.createDataFrame([("", None, "x", ["a", "b", "c", "d"])],
                                "a STRING, b STRING, c STRING, l ARRAY<STRING>").select(
        text.first_non_empty(F.col("a"), F.col("b"), F.col("c")).alias("first"),
        text.first_non_empty(F.col("a"), F.col("b")).alias("none"),
        text.join_non_empty(F.col("c"), F.col("a"), F.col("b"), F.col("c")).alias("joined"),
        text.join_array(F.col("l"), 3).alias("three"),
        text.join_array(F.lit(None).cast("array<string>")).alias("no_array"),
        text.dedup_key("c", "b").alias("key"),
        text.key_company(F.lit("a:b:c")).alias("company"),
        text.truncate(F.lit("abcdef"), 3).alias("cut"),
    ).first()
    assert tuple(row) == ("x", "", "x, x", "a, b, c", "", "x:", "a", "abc")


def test_posted_ts(spark):
    values = ["2026-01-02T03:04:05Z", "1700000000000", "Posted Today", "", None, "2026-01-02"]
    out = [r[0] for r in column(spark, values).orderBy("id")
           .select(F.unix_seconds(text.posted_ts("s"))).collect()]
    assert out == [1767323045, 1700000000, None, None, None, 1767312000]


def test_company_error_and_summary(spark):
    df = spark.createDataFrame([("n", "f", "p"), ("n", None, "p")], "n STRING, f STRING, p STRING")
    errors = [r[0] for r in df.select(text.company_error(F.col("n"), F.col("f"), F.col("p"))).collect()]
    assert errors == ["n (f): p", "n: no fetcher specified"]
    one, none = [F.array(F.lit("a<b")), F.array().cast("array<string>")]
    row = spark.range(1).select(
        text.summary_text(F.lit(3), F.lit(2), F.lit(1), one).alias("s"),
        text.summary_text(F.lit(3), F.lit(2), F.lit(1), none).alias("t")).first()
    assert row.s == ("\U0001f4ca Run summary\nFetched: 3\nNew: 2\nAlerted: 1\n\n⚠️ Errors:\n• a&lt;b")
    assert row.t is None
