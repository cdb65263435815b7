"""Queries of the number, date and place encoders."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.functions import numbers as N
from bitloom.operators import ordering
from bitloom.plans.registry import query
from bitloom.sources.tables import table

_BUCKET = "CAST(greatest(0, ceil((least(greatest({0}, -1000.0), 1000.0) + 1000.0) / 20.0) - 1) AS BIGINT)"


def _events(spark, d):
    return table(spark, d, "events")


@query("number_bucket", f"""
    SELECT event_id, {_BUCKET.format("value")} AS bucket, 15000 + {_BUCKET.format("value")} AS pos, 1000 + {_BUCKET.format("value")} AS compat_pos FROM events""")
def number_bucket(spark, d):
    """Bucket and bit position of event values, with the position that the compatible layout gives."""
    v = F.col("value")
    return _events(spark, d).select("event_id", N.number_bucket(v).alias("bucket"), F.get(N.number_bits(v), F.lit(0)).alias("pos"), F.get(N.number_bits(v, True), F.lit(0)).alias("compat_pos"))


@query("number_clamped", f"SELECT {_BUCKET.format('o_totalprice')} AS bucket, count(*) AS n FROM orders GROUP BY 1")
def number_clamped(spark, d):
    """Order prices lie beyond the range: they are clamped to the last bucket."""
    return table(spark, d, "orders").groupBy(N.number_bucket(F.col("o_totalprice")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("number_decode", f"""
    SELECT event_id, -1000.0::DOUBLE + 20 * b + 10 AS middle, round(abs(value - (-1000.0::DOUBLE + 20 * b + 10)), 6) AS error, round(-1000.0::DOUBLE + 20.0::DOUBLE * (b + 0.25::DOUBLE), 6) AS quarter
    FROM (SELECT event_id, value, {_BUCKET.format("value")} AS b FROM events)""")
def number_decode(spark, d):
    """Middles of buckets, their errors, and a value interpolated inside the bucket."""
    b = N.number_bucket(F.col("value"))
    return _events(spark, d).select("event_id", N.bucket_middle(b).alias("middle"), F.round(F.abs(F.col("value") - N.bucket_middle(b)), 6).alias("error"), F.round(N.interpolate(b, F.lit(0.25)), 6).alias("quarter"))


@query("number_text", f"""
    WITH b AS (SELECT event_id, {_BUCKET.format("value")} AS low, {_BUCKET.format("value + 50")} AS high FROM events)
    SELECT event_id, (20 * low - 990) || CASE WHEN event_id % 3 = 0 THEN ' ? ' ELSE ' ' END || (20 * high - 990) AS numbers, '[' || (20 * low - 1000) || ', ' || (20 * high - 980) || ']' AS span FROM b""")
def number_text(spark, d):
    """Lists of number positions as text, some with a position that no number has, and ranges of buckets as text."""
    b = _events(spark, d).select("event_id", N.number_bucket(F.col("value")).alias("low"), N.number_bucket(F.col("value") + 50).alias("high"))
    low, high = (F.col(c) + N.NUMBER_START for c in ("low", "high"))
    listed = F.when(F.col("event_id") % 3 == 0, F.array(low, F.lit(14_000).cast("long"), high)).otherwise(F.array(low, high))
    return b.select("event_id", N.number_text(listed).alias("numbers"), N.range_text(F.col("low"), F.col("high")).alias("span"))


@query("number_range", f"""
    WITH r AS (SELECT user_id, min(value) AS lo, max(value) AS hi, max(value) - min(value) AS step FROM events GROUP BY user_id)
    SELECT user_id, {_BUCKET.format("lo")} AS low_bucket, {_BUCKET.format("hi")} AS high_bucket, CASE WHEN step = 1 THEN NULL ELSE {_BUCKET.format("step")} END AS step_bucket FROM r WHERE lo <= hi AND step > 0""")
def number_range(spark, d):
    """Each user's value range as buckets of both ends and of the step."""
    r = _events(spark, d).groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).withColumn("step", F.col("hi") - F.col("lo"))
    b = r.select("user_id", N.range_buckets(F.col("lo"), F.col("hi"), F.col("step")).alias("b")).filter("b IS NOT NULL")
    return b.select("user_id", *(F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("low_bucket", "high_bucket", "step_bucket"))))


@query("number_strings", r"""
    WITH t AS (SELECT page_id, replace(unnest(regexp_split_to_array(regexp_replace(url, '[/?=&.:_-]', ' ', 'g'), '[ \t\n\r]+')), ',', '') AS w FROM pages)
    SELECT page_id, count(*) AS n, round(sum(CAST(w AS DOUBLE)), 6) AS total FROM t WHERE regexp_full_match(w, '[+-]?[0-9]+(\.[0-9]+)?') GROUP BY page_id""")
def number_strings(spark, d):
    """Numbers among the parts of URLs."""
    parts = table(spark, d, "pages").select("page_id", F.explode(N.numbers_in(F.regexp_replace("url", "[/?=&.:_-]", " "))).alias("v"))
    return parts.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query("bucket_stats", f"""
    SELECT {_BUCKET.format("value")} AS bucket, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value) * count(*), 4) AS m2 FROM events GROUP BY 1""")
def bucket_stats(spark, d):
    """Count, mean and sum of squared deviations of each bucket."""
    v = F.col("value")
    return _events(spark, d).groupBy(N.number_bucket(v).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.var_pop(v) * F.count(F.lit(1)), 4).alias("m2"))


@query("boundary_step", f"""
    WITH s AS (SELECT {_BUCKET.format("value")} AS b, avg(value) AS m FROM events GROUP BY 1)
    SELECT y.b AS boundary, round(-1000.0::DOUBLE + 20 * y.b + 0.01::DOUBLE * ((x.m + y.m) / 2 - (-1000.0::DOUBLE + 20 * y.b)), 6) AS moved FROM s x JOIN s y ON y.b = x.b + 1""")
def boundary_step(spark, d):
    """One step of the boundary optimiser: each boundary moves a hundredth of the way to the middle of its neighbours' means."""
    v = F.col("value")
    s = _events(spark, d).groupBy(N.number_bucket(v).alias("boundary")).agg(F.avg(v).alias("m"))
    below = s.select((F.col("boundary") + 1).alias("boundary"), F.col("m").alias("below"))
    at = N.LOW + N.WIDTH * F.col("boundary")
    return s.join(below, "boundary").select("boundary", F.round(at + 0.01 * ((F.col("below") + F.col("m")) / 2 - at), 6).alias("moved"))


@query("quantile_bins", """
    WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events),
    b AS (SELECT unnest(range(101)) AS boundary)
    SELECT CAST(boundary AS BIGINT) AS boundary, value FROM r JOIN b ON i = least(boundary * n // 100, n - 1)""")
def quantile_bins(spark, d):
    """Boundaries that hold equally many values each, by rank.

    Values are ranked by their distinct values' counts within buckets of a width, so that no task sees all rows.
    """
    counted = _events(spark, d).groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.floor(F.col("value") / 2))
    starts = counted.groupBy("bucket").agg(F.sum("n").alias("total"))
    starts = starts.select("bucket", (F.sum("total").over(W.orderBy("bucket")) - F.col("total")).alias("start"), F.sum("total").over(W.partitionBy()).alias("rows"))
    inside = F.sum("n").over(W.partitionBy("bucket").orderBy("value"))
    ranked = counted.withColumn("upto", inside).join(starts, "bucket")
    spans = ranked.select("value", (F.col("start") + F.col("upto") - F.col("n")).alias("lo"), (F.col("start") + F.col("upto")).alias("hi"), "rows")
    wanted = F.filter(F.transform(F.sequence(F.lit(0), F.lit(100)), lambda b: F.struct(b.cast("long").alias("boundary"), F.least(F.floor(b * F.col("rows") / 100), F.col("rows") - 1).alias("i"))), lambda x: (x["i"] >= F.col("lo")) & (x["i"] < F.col("hi")))
    return spans.select("value", F.explode(wanted).alias("w")).select(F.col("w.boundary").alias("boundary"), "value")


@query("compression_constant", "SELECT 64 / 11.0::DOUBLE AS ratio, 100 AS buckets")
def compression_constant(spark, d):
    """Bits of a double over bits of a bucket number with its sparse overhead."""
    return spark.range(1).select((F.lit(64) / F.lit(11.0)).alias("ratio"), F.lit(N.BUCKETS).alias("buckets"))


_DATE = """[2000 + year(ts) - 1900, 2000 + 199 + month(ts), 2000 + 299 + day(ts), 2400 + hour(ts), 2460 + minute(ts), 2520 + second(ts)]
    || CASE WHEN epoch_us(ts) % 1000000 > 0 THEN [2580 + epoch_us(ts) % 1000000] ELSE [] END || [3220]"""


@query("datetime_bits", f"SELECT event_id, unnest(bits) AS pos, generate_subscripts(bits, 1) - 1 AS part FROM (SELECT event_id, {_DATE} AS bits FROM events)")
def datetime_bits(spark, d):
    """Positions of the parts of event times."""
    bits = _events(spark, d).select("event_id", F.posexplode(N.date_bits(F.col("ts"))).alias("part", "pos"))
    return bits.select("event_id", "pos", F.col("part").cast("long").alias("part"))


@query("datetime_roundtrip", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS decoded FROM events")
def datetime_roundtrip(spark, d):
    """Whole seconds of the decoded positions as text."""
    return _events(spark, d).select("event_id", F.date_format(N.date_decode(N.date_bits(F.col("ts"))), "yyyy-MM-dd'T'HH:mm:ss").alias("decoded"))


@query("time_range_bits", """
    WITH r AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id)
    SELECT user_id, 100 + year(a) AS first_year, 2199 + month(a) AS first_month, 2299 + day(a) AS first_day, 100 + year(b) AS last_year, 2199 + month(b) AS last_month, 2299 + day(b) AS last_day,
           CAST(date_diff('day', CAST(a AS DATE), CAST(b AS DATE)) AS BIGINT) AS days FROM r""")
def time_range_bits(spark, d):
    """Start, end and length of each user's activity as date positions."""
    r = _events(spark, d).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    get = lambda c, i, n: F.get(N.date_bits(F.col(c)), F.lit(i)).alias(n)
    ends = [get(c, i, f"{e}_{n}") for c, e in (("a", "first"), ("b", "last")) for i, n in enumerate(("year", "month", "day"))]
    return r.select("user_id", *ends, F.datediff("b", "a").cast("long").alias("days"))


_WRITTEN = """CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(ts, '%Y%m%d%H%M%S')
    WHEN 2 THEN 'last ' || event_type WHEN 3 THEN CAST(event_id AS VARCHAR) ELSE 'next week' END"""


@query("datetime_format_detect", f"""
    SELECT event_id, CASE WHEN regexp_full_match(w, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]+)?([+-][0-9]{{2}}:?[0-9]{{2}}|Z)?') THEN 'iso8601'
        WHEN regexp_full_match(w, '[0-9]{{14}}(\\.[0-9]+)?') THEN 'compact'
        WHEN regexp_full_match(lower(w), '(now|today|tomorrow|yesterday|last|next|this)[ ]*(day|week|month|year|hour|minute|second)s?[ ]*(ago)?') THEN 'relative'
        WHEN regexp_full_match(w, '[0-9]+') THEN 'unix' ELSE 'unknown' END AS format FROM (SELECT event_id, {_WRITTEN} AS w FROM events)""")
def datetime_format_detect(spark, d):
    """Formats of times written in several ways."""
    e = F.col("event_id") % 5
    written = (
        F.when(e == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(e == 1, F.date_format("ts", "yyyyMMddHHmmss"))
        .when(e == 2, F.concat(F.lit("last "), F.col("event_type"))).when(e == 3, F.col("event_id").cast("string")).otherwise("next week")
    )
    return _events(spark, d).select("event_id", N.date_format(written).alias("format"))


@query("relative_time_bits", """
    SELECT q AS qualifier, u AS unit, ago, [2750 + i - 1, 2760 + j - 1] || CASE WHEN ago THEN [2770] ELSE [] END AS bits
    FROM (SELECT unnest(['now', 'last', 'next', 'this']) AS q, unnest([1, 2, 3, 4]) AS i),
         (SELECT unnest(['second', 'minute', 'hour', 'day', 'week', 'month', 'year']) AS u, unnest([1, 2, 3, 4, 5, 6, 7]) AS j), (SELECT unnest([true, false]) AS ago)""")
def relative_time_bits(spark, d):
    """The table of relative times."""
    base = spark.range(1).select(F.explode(F.array(*map(F.lit, N.QUALIFIERS))).alias("qualifier"))
    base = base.select("qualifier", F.explode(F.array(*map(F.lit, N.UNITS))).alias("unit"))
    base = base.select("qualifier", "unit", F.explode(F.array(F.lit(True), F.lit(False))).alias("ago"))
    bits = N.relative_bits(F.col("qualifier"), F.col("unit"), F.col("ago"))
    return base.select("qualifier", "unit", "ago", bits.cast("array<bigint>").alias("bits"))


_PLACE = "CAST(c_custkey * 37 % 200 - 100 AS DOUBLE) AS lat, CAST(c_custkey * 91 % 400 - 200 AS DOUBLE) AS lon"


def _places(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", (k * 37 % 200 - 100).cast("double").alias("lat"), (k * 91 % 400 - 200).cast("double").alias("lon"))


@query("geo_bits", f"""
    SELECT c_custkey, CAST(floor((least(greatest(lat, -90), 90) + 90) / 180 * 999) AS BIGINT) AS lat_cell, CAST(floor((least(greatest(lon, -180), 180) + 180) / 360 * 999) AS BIGINT) AS lon_cell
    FROM (SELECT c_custkey, {_PLACE} FROM customer)""")
def geo_bits(spark, d):
    """Cells of places derived from customer keys; some lie beyond the poles and are clamped."""
    return _places(spark, d).select("c_custkey", N.geo_bits(F.col("lat"), F.col("lon")).alias("g")).select("c_custkey", "g.lat_cell", "g.lon_cell")


@query("geo_roundtrip", f"""
    SELECT c_custkey, round(lat_cell / 999.0::DOUBLE * 180 - 90, 6) AS lat, round(lon_cell / 999.0::DOUBLE * 360 - 180, 6) AS lon FROM (
    SELECT c_custkey, floor((least(greatest(lat, -90), 90) + 90) / 180 * 999) AS lat_cell, floor((least(greatest(lon, -180), 180) + 180) / 360 * 999) AS lon_cell
    FROM (SELECT c_custkey, {_PLACE} FROM customer))""")
def geo_roundtrip(spark, d):
    """Degrees of the cells."""
    g = geo_bits(spark, d)
    return g.select("c_custkey", F.round(N.geo_decode(F.col("lat_cell"), 90.0), 6).alias("lat"), F.round(N.geo_decode(F.col("lon_cell"), 180.0), 6).alias("lon"))


@query("value_ranks", "SELECT event_id, CAST(row_number() OVER (ORDER BY value, event_id) - 1 AS BIGINT) AS place FROM events")
def value_ranks(spark, d):
    """Global ranks of event values without a single-task window."""
    e = _events(spark, d).select("event_id", "value")
    return ordering.global_rank(e, F.floor(F.col("value") / 2), [F.col("value"), F.col("event_id")], "place").select("event_id", F.col("place").cast("long").alias("place"))
