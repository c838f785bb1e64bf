import duckdb

from pyspark.sql import functions as F

from sitegraph.functions.text import epoch_micros

EVENTS = "/root/testdata/sf0.1/events.parquet"


def test_epoch_independent_of_session_zone(spark):
    exp = dict(duckdb.sql(f"SELECT event_id, epoch_us(ts) FROM '{EVENTS}'").fetchall())
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ["UTC", "America/Los_Angeles", "Asia/Kolkata"]:
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = dict((r[0], r[1]) for r in spark.read.parquet(EVENTS)
                       .select("event_id", epoch_micros(F.col("ts")).alias("us")).collect())
            assert got == exp, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
