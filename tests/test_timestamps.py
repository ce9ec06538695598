from argentum.operators import timestamps

SPANS = "zone string, year int, spans array<struct<from_us: bigint, to_us: bigint, offset_s: int, abbr: string>>"
EXPORTS = "source_id string, export_locale string, home_zone string"


def stamped(spark, texts):
    rows = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(texts)], "i int, source_id string, text string")
    exports = spark.createDataFrame([("a", "de", "Europe/Berlin"), ("b", "de", None)], EXPORTS)
    second = 1_000_000
    spans = spark.createDataFrame([("Europe/Berlin", 2020, [(1577836800 * second, 1609459200 * second, 3600, "CET")])], SPANS)
    return timestamps.stamp(rows, exports, spans)


def test_unknown_home_zones_meet_no_intervals(spark):
    got = {r["i"]: (r["how"], r["utc_us"]) for r in stamped(spark, [("a", "2020-01-02 00:00:00"), ("b", "2020-01-02 00:00:00"), (None, "2020-01-02 00:00:00"), ("a", "2021-01-02 00:00:00"), ("b", "2020-01-02 00:00:00+01:00"), ("a", None)]).collect()}
    assert got == {0: ("zone", 1577919600 * 1_000_000), 1: ("unknown zone", None), 2: ("unknown zone", None), 3: ("unknown zone", None), 4: ("offset", 1577919600 * 1_000_000), 5: ("unreadable", None)}


def test_driver_plans_parsing_in_little_memory(spark):
    def allocated():
        return threads.getThreadAllocatedBytes(spark._jvm.java.lang.Thread.currentThread().getId())

    threads = spark._jvm.java.lang.management.ManagementFactory.getThreadMXBean()
    plan = stamped(spark, [("a", "2020-01-02 00:00:00")])._jdf.queryExecution()
    before = allocated()
    plan.optimizedPlan()
    assert allocated() - before < 200 << 20
