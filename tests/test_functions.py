"""Column functions against literal cases."""

import pytest
from pyspark.sql import functions as F

from spendloom.fixed_values import MODEL_BY_BILLING_NAME, REGION_BY_CODE
from spendloom.functions import billing, calls, common, identity


def values(spark, texts, **columns):
    """Evaluate the columns over one text column `c`, row by row in order."""
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i int, c string")
    out = rows.select("i", *[c.alias(name) for name, c in columns.items()]).orderBy("i").collect()
    return [tuple(row[name] for name in columns) for row in out]


def test_usage_type_parts(spark):
    tokens = ["input-tokens", "output-tokens", "cache-read-input-token-count", "cache-write-input-token-count"]
    crosses = ["none", "cross-region-global", "cross-region-geo"]
    texts, expected = [], []
    for token in tokens:
        for cross in crosses:
            texts.append(f"USE1-Jamba1-5Large-{token}" + ("" if cross == "none" else f"-{cross}"))
            expected.append(("USE1", "Jamba1-5Large", token, cross))
    texts += ["ZZZ1-X-input-tokens", "", "DataTransfer-Out-Bytes", "USE1", "USE1-", "USE1-input-tokens", "USE1-Model"]
    expected += [("ZZZ1", "X", "input-tokens", "none")] + [(None,) * 4] * 6
    texts += [None, "USE1--input-tokens", "USE1-a-input-tokens-output-tokens", "USE1-M-input-tokens\n"]
    expected += [(None,) * 4, (None,) * 4, ("USE1", "a-input-tokens", "output-tokens", "none"), (None,) * 4]
    assert values(spark, texts, **billing.usage_type_parts(F.col("c"))) == expected


def test_fixed_lists_have_their_size():
    assert len(REGION_BY_CODE) == 17
    assert len(MODEL_BY_BILLING_NAME) == 22


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("$0.003 per 1K input tokens", 0.003),
        ("costs $12 per image", 12.0),
        ("no price", None),
        ("", None),
        ("$1.2.3 per unit", 1.2),
        ("$. per unit", None),
    ],
)
def test_unit_price(spark, text, expected):
    assert values(spark, [text], p=billing.unit_price(F.col("c"))) == [(expected,)]


def test_number_or_zero(spark):
    texts = ["3.5", "3.5abc", "", "n/a", "-2", "1.0E-7", " 7 ", ".5", None]
    expected = [3.5, 3.5, 0.0, 0.0, -2.0, 1e-7, 7.0, 0.5, 0.0]
    assert [v for (v,) in values(spark, texts, n=billing.number_or_zero(F.col("c")))] == expected


def test_measure_for(spark):
    rows = spark.createDataFrame(
        [("Images", "input-tokens"), ("Seconds", "output-tokens"), ("1K tokens", "output-tokens"), ("", "other")],
        "unit string, token string",
    )
    got = [r[0] for r in rows.select(billing.measure_for(F.col("unit"), F.col("token"))).collect()]
    assert got == ["imagecount", "videodurationseconds", "outputtokens", "inputtokens"]


@pytest.mark.parametrize(
    ("model", "expected"),
    [
        ("arn:aws:bedrock:us-east-1:1:inference-profile/us.a.b", ("a.b", "us-east-1", "geo")),
        ("arn:aws:bedrock:eu-west-1:1:inference-profile/eu.a.b", ("a.b", "eu-west-1", "geo")),
        ("arn:aws:bedrock:us-east-1:1:inference-profile/global.a.b", ("global.a.b", "us-east-1", "global")),
        ("us.a.b", ("a.b", "here", "geo")),
        ("global.a.b", ("global.a.b", "here", "none")),
        ("eurollm-x", ("eurollm-x", "here", "none")),
        ("arn:aws-cn:bedrock:x:1:inference-profile/us.a", ("arn:aws-cn:bedrock:x:1:inference-profile/us.a", "here", "none")),
    ],
)
def test_profile_resolution(spark, model, expected):
    parts = calls.profile_resolution(F.col("c"), F.lit("here"))
    got = values(spark, [model], **{k: parts[k] for k in ("resolvedmodelid", "sourceregion", "crossregiontype")})
    assert got == [expected]


def test_tier_and_ttl(spark):
    bodies = [
        '{"service_tier":"priority"}', '{"service_tier":"flex"}', '{"service_tier":"reserved"}',
        '{"service_tier":"default"}', "not json", "7", '{"x":{"ttl":"1h"}}', '{"x":{"ttl": "1h"}}', "",
    ]
    got = values(spark, bodies, t=calls.inference_tier(F.col("c")), l=calls.cache_ttl(F.col("c")))
    standard = [("standard", "5m")]
    assert got == [("priority", "5m"), ("flex", "5m"), *standard * 4, *[("standard", "1h")] * 2, *standard]


def test_cache_type_write_wins(spark):
    rows = spark.createDataFrame([(5, 5, ""), (0, 5, ""), (0, 0, ""), (1, 0, '"ttl":"1h"')], "w int, r int, b string")
    got = [r[0] for r in rows.select(calls.cache_type(F.col("w"), F.col("r"), F.col("b"))).collect()]
    assert got == ["cacheWrite5m", "cacheRead", "none", "cacheWrite1h"]


def test_latency_falls_back_to_body(spark):
    rows = spark.createDataFrame(
        [(5, '{"metrics":{"latencyMs":9}}'), (0, '{"metrics":{"latencyMs":9}}'), (None, "broken"), (0, None)],
        "l bigint, b string",
    )
    assert [r[0] for r in rows.select(calls.latency_ms(F.col("l"), F.col("b"))).collect()] == [5, 9, 0, 0]


def test_user_name_from_arn(spark):
    cases = {
        "arn:aws:iam::1:user/alice": "alice",
        "arn:aws:sts::1:assumed-role/MyRole/session": "MyRole/session",
        "arn:aws:iam::1:role/MyRole": "MyRole",
        "arn:aws:iam::1:root": "root",
        "arn:aws:iam::1:": "unknown",
        "arn:aws:iam::1:user/a:b": "a:b",
        "plain": "plain",
        "": "unknown",
        None: "unknown",
    }
    got = values(spark, list(cases), n=calls.user_name_from_arn(F.col("c")))
    assert [v for (v,) in got] == list(cases.values())


def test_billing_cross_region(spark):
    rows = spark.createDataFrame(
        [
            ("global.m", "", ""), ("x/global.m", "", ""), ("us.m", "", ""), ("x/ap.m", "", ""),
            ("m", "us-east-1", "US-EAST-1"), ("m", "us-east-1", "eu-west-1"), ("m", None, "eu-west-1"), ("eurollm", "", ""),
        ],
        "m string, s string, e string",
    )
    got = [r[0] for r in rows.select(calls.billing_cross_region(F.col("m"), F.col("s"), F.col("e"))).collect()]
    assert got == [
        "cross-region-global", "cross-region-global", "cross-region-geo", "cross-region-geo",
        "none", "cross-region-global", "none", "none",
    ]


def test_prefix_is_stripped_only_before_a_dot(spark):
    got = values(spark, ["us.m", "global.m", "eurollm-x", "ap.m.x"], m=calls.strip_cross_region_prefix(F.col("c")))
    assert [v for (v,) in got] == ["m", "m", "eurollm-x", "m.x"]


def test_principal_parts_and_session_name(spark):
    arns = [
        "arn:aws:iam::1:user/alice", "arn:aws:iam::1:user/path/alice", "arn:aws:iam::1:role/MyRole",
        "arn:aws-us-gov:sts::1:assumed-role/MyRole/s-1", "arn:aws:sts::1:federated-user/bob", "other",
    ]
    got = values(spark, arns, **identity.principal_parts(F.col("c")), session=identity.session_name(F.col("c")))
    assert got == [
        ("alice", None, "user", "alice"), ("path/alice", None, "user", "alice"), (None, "MyRole", "role", "MyRole"),
        (None, "MyRole", "assumed-role", "s-1"), ("bob", None, "federated", "bob"), (None, None, "unknown", "other"),
    ]


def test_model_names(spark):
    got = values(
        spark,
        ["arn:x::foundation-model/a.b-c", "a.b-c", "a/"],
        n=common.model_name(F.col("c")),
        f=common.friendly_model_name(F.col("c")),
    )
    assert got == [("a.b-c", "a b c"), ("a.b-c", "a b c"), ("", "a/")]


def test_partition_values(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-12-31T23:59:59.999Z", "2024-01-01T00:30:00+02:00", "bad"]
    got = values(spark, texts, **common.partition_columns(F.col("c")))
    assert got == [
        ("2024", "01", "01", "00"), ("2024", "12", "31", "23"), ("2023", "12", "31", "22"), (None,) * 4,
    ]


def test_decode_key(spark):
    got = values(spark, ["a+b%2Fc", "100%", None], k=common.decode_key(F.col("c")))
    assert [v for (v,) in got] == ["a b/c", "100%", None]
