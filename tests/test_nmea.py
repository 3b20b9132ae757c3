"""Sentences with right and wrong checksums, and fragments in and out of order."""

from functools import reduce

from wakeline.functions import nmea


def sentence(body):
    return f"!{body}*{reduce(lambda a, b: a ^ ord(b), body, 0):02X}"


def test_messages(spark):
    rows = [
        ("s", 0.0, sentence("AIVDM,1,1,,A,15MgK45P3@G?fl0E`JbR0OwT0@MS,0")),
        ("s", 1.0, sentence("AIVDM,1,1,,A,bad,0")[:-2] + "00"),
        ("s", 2.0, sentence("AIVDM,2,1,3,B,first,0")),
        ("s", 3.0, sentence("AIVDM,2,2,3,B,second,2")),
        ("s", 100.0, sentence("AIVDM,2,1,3,B,late,0")),
        ("s", 130.0, sentence("AIVDM,2,2,3,B,toolate,2")),
        ("s", 200.0, sentence("AIVDM,2,2,4,A,order,2")),
        ("s", 201.0, sentence("AIVDM,2,1,4,A,wrong,0")),
        ("s", 300.0, "$GPGGA,nothing"),
        ("s", 301.0, sentence("AIVDM,1,2,,A,x,0")),
        ("s", 302.0, None),
    ]
    df = spark.createDataFrame(rows, "source string, t double, line string")
    got = sorted((r.t, r.channel, r.payload) for r in nmea.messages(nmea.fragments(df)).collect())
    assert got == [(0.0, "A", "15MgK45P3@G?fl0E`JbR0OwT0@MS"), (2.0, "B", "firstsecond")]
