import pytest
from pyspark.sql import functions as F

from evifuse.functions import fields as ff
from evifuse.functions import geo


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("17-03-2026", "2026-03-17 00:00:00"),
        ("2025/05/29 11:09:00", "2025-05-29 11:09:00"),
        ("01/06/25 21:53:47", "2025-06-01 21:53:47"),
        ("01/06/2025 21:53:47", "2025-06-01 21:53:47"),
        ("2025-06-01 7:05", "2025-06-01 07:05:00"),
        ("1-6-2025 7:05", "2025-06-01 07:05:00"),
        ("19-Jul-2026", "2026-07-19 00:00:00"),
        ("19-jul-26", "2026-07-19 00:00:00"),
        ("01-02-71", "1971-02-01 00:00:00"),
        ("20250601215347", "2025-06-01 21:53:47"),
        ("05/28/2025", "2025-05-28 00:00:00"),
        ("2025-06-01T21:53:47", "2025-06-01 21:53:47"),
        ("45-13-2025", None),
        ("nan", None),
        ("soon", None),
        ("", None),
    ],
)
def test_moment(spark, text, want):
    got = one(spark, ff.moment, text)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(
    "text,want", [("₹1,234.50", 1234.5), ("$7", 7.0), ("", 0.0), ("nan", 0.0), ("12d", 0.0), ("-3.5", -3.5), (None, 0.0), (" 1e3 ", 1000.0)]
)
def test_money(spark, text, want):
    assert one(spark, ff.money, text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("UPI/DR/123456789012/a.b@ok/Payment", ("123456789012", "a.b@ok", "UPI")),
        ("UPI-DEBIT-195544399726-zeeshan.sheikh@paytm", ("195544399726", "zeeshan.sheikh@paytm", "UPI")),
        ("NEFT-CREDIT-679392876776-SALARY", ("679392876776", "SALARY", "NEFT")),
        ("IMPS-451934415259-Saanvi Saxena", ("451934415259", None, "IMPS")),
        ("IMPS-P2A/451934415259/RAVI/HDFC0001", ("451934415259", "RAVI", "IMPS")),
        ("RTGS/19546636166/rok'am jama", (None, None, "RTGS")),
        ("UPI/yahvi.kala@okhdfcbank/chukvani", (None, "yahvi.kala@okhdfcbank", "UPI")),
        ("", (None, None, None)),
    ],
)
def test_narration(spark, text, want):
    assert tuple(one(spark, lambda c: F.struct(*[x.alias(f"c{i}") for i, x in enumerate(ff.narration_parts(c))]), text)) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("9846913810", "phone"), ("ACCT_12", "account"), ("acc-9", "account"), ("a@b", "vpa"), ("350000000000001", "imei"),
        ("1.2.3.4", "ip"), ("120000000000001", "imei"), ("12345678901", "phone"), ("8386", "account"),
    ],
)
def test_identifier_type(spark, text, want):
    assert one(spark, ff.identifier_type, text) == want


def test_repeated_header_by_content(spark):
    head = ["S.No", "Account No", "Date", "Description", "Amount", "Type (DR/CR)", "Bal."]
    txn = ["42", "8644925192", "01/06/25 21:53:47", "UPI/500000/x@y", "500000.00", "CR", "512345.67"]
    d = spark.createDataFrame([(head, True), (txn, False), (["S.No", "Date"], False), ([None] * 7, False)], "cells array<string>, want boolean")
    h = F.array(*[F.lit(x) for x in head])
    assert all(r["want"] == r["got"] for r in d.withColumn("got", ff.repeats_header(F.col("cells"), h)).collect())


def test_address_prefix_keeps_octets(spark):
    assert one(spark, geo.address_city, "103.211.102.180") is None
    assert one(spark, lambda c: geo.address_city(c, whole_octets=False), "103.211.102.180") == "Mumbai"
    assert one(spark, geo.address_city, "103.25.1.1") == "Surat"


@pytest.mark.parametrize(
    "loc,ip,want",
    [
        ("SRT-T02", None, "Adajan, Surat"), ("mum-t09", None, "Andheri, Mumbai"), ("Delhi", None, "Connaught Place, Delhi"),
        ("BRD-T01", "103.21.1.1", "IP-Geo (Mumbai)"), ("Surat", None, "Surat"), ("nowhere", None, None), (None, "103.28.0.1", "IP-Geo (Chennai)"),
    ],
)
def test_place_order(spark, loc, ip, want):
    d = spark.createDataFrame([(loc, ip)], "l string, i string").select(geo.event_place(F.col("l"), F.col("i"))["label"].alias("x"))
    assert d.first()["x"] == want


def test_distance(spark):
    d = spark.range(1).select(geo.distance_km(F.lit(21.1702), F.lit(72.8311), F.lit(19.0760), F.lit(72.8777)).alias("x")).first()["x"]
    assert 232 < d < 234
