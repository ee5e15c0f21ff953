"""Point-in-time joins that look strictly back.  Running totals take the place of joins on ranges, so no row is multiplied by its group's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Numbers of a group's history rows whose last values are put together by one task.
RUN = 10_000


def _newest(candidates: DataFrame, history: DataFrame, group: str, key: str, at: str, happened: str, value: str, n: int) -> DataFrame:
    """(k, newest): for each candidate with history the n newest rows (hks, vs: id, value) with happened < at, itself left out, as an array.

    History rows are numbered in their group and carry the n before them; a
    running count over candidates and history together says how many precede
    each candidate; an equi join on (group, number) fetches the last of them.
    Ties go to the lesser key first.  Groups are split by bins of time, then by
    runs of numbers that begin with the last n of the run before; sizes are in
    proportion to the input.  Candidates' ids are unique.
    """
    hist = history.where(F.col(happened).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("hk"), F.col(happened).alias("t"), F.col(value).alias("v"))
    ranked = hist.where("g IS NOT NULL").withColumn("m", _micros("t"))
    inside = Window.partitionBy("g", "_bin").orderBy("m", F.col("hk").desc())
    cut = ranked.withColumn("_bin", F.floor(F.col("m") / BIN))
    sizes = cut.groupBy("g", "_bin").agg(F.count("*").alias("_n"))
    earlier = sizes.withColumn("_n", F.coalesce(F.sum("_n").over(Window.partitionBy("g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = cut.withColumn("seq", F.row_number().over(inside)).join(earlier, ["g", "_bin"]).select("g", "hk", "v", (F.col("seq") + F.col("_n")).alias("seq"))
    size = max(RUN, n)
    run, place = F.floor((F.col("seq") - 1) / size), F.pmod(F.col("seq") - 1, F.lit(size))
    runs = F.when(place >= size - n, F.array(run, run + 1)).otherwise(F.array(run))
    order = Window.partitionBy("g", "_run").orderBy("seq")
    back = lambda c: F.array(F.col(c), *(F.lag(c, i).over(order) for i in range(1, n + 1)))
    carried = numbered.withColumn("_run", F.explode(runs)).withColumns({"hks": back("hk"), "vs": back("v")}).where(F.col("_run") == run).select("g", "seq", "hks", "vs")
    cand = candidates.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(at).alias("t"))
    both = cand.select("g", "k", "t", F.lit(0).alias("is_hist")).unionAll(hist.select("g", F.lit(None).alias("k"), "t", F.lit(1).alias("is_hist")))
    both = both.where("g IS NOT NULL AND t IS NOT NULL").select("g", "k", _micros("t").alias("t"), "is_hist", F.col("is_hist").cast("long").alias("cnt"))
    counted = running(both, "g", "t", "is_hist", "cnt").where("is_hist = 0 AND cnt > 0")
    met = counted.select("g", "k", F.col("cnt").alias("seq")).join(carried, ["g", "seq"])
    others = F.filter(F.arrays_zip("hks", "vs"), lambda h: h["hks"] != F.col("k"))
    return met.select("k", F.slice(others, 1, n).alias("newest")).where(F.size("newest") > 0)


def newest_before(candidates: DataFrame, history: DataFrame, group: str, key: str, at: str, happened: str, value: str, n: int) -> DataFrame:
    """(key, hist_value, recency): for each candidate the n newest history rows with happened < at, itself left out."""
    found = _newest(candidates, history, group, key, at, happened, value, n).select("k", F.posexplode("newest").alias("at", "h"))
    return found.select(F.col("k").alias(key), F.col("h.vs").alias("hist_value"), (F.col("at") + 1).alias("recency"))


def rolling_mean(candidates: DataFrame, history: DataFrame, group: str, key: str, at: str, happened: str, value: str, n: int = 10) -> DataFrame:
    """Mean of the n newest values; a NULL value takes a place and doesn't count."""
    found = _newest(candidates, history, group, key, at, happened, value, n)
    known = found.select("k", F.filter(F.transform("newest", lambda h: h["vs"].cast("double")), lambda v: v.isNotNull()).alias("known"))
    mean = F.when(F.size("known") > 0, F.aggregate("known", F.lit(0.0), lambda a, v: a + v) / F.size("known"))
    return known.select(F.col("k").alias(key), mean.alias("rolling_mean"))


def most_recent(candidates: DataFrame, history: DataFrame, group: str, key: str, at: str, happened: str, value: str) -> DataFrame:
    return _newest(candidates, history, group, key, at, happened, value, 1).select(F.col("k").alias(key), F.col("newest")[0]["vs"].alias("most_recent"))


#: Microseconds of the bins of time that a group's running totals are split by.
BIN = 30 * 86400 * 1_000_000


def _micros(column: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column))


def running(rows: DataFrame, group: str, at: str, tie: str, *values: str) -> DataFrame:
    """Running totals of values over a group's rows by (at, tie), at in microseconds, in place of the values.

    A group is split by bins of time: each bin is summed up by itself, and the
    totals of the bins before, a small table, are added.
    """
    cut = rows.withColumn("_bin", F.floor(F.col(at) / BIN))
    totals = cut.groupBy(group, "_bin").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    before = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_bin", *(F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values))
    inside = Window.partitionBy(group, "_bin").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumns({v: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    return summed.join(offsets, [group, "_bin"]).withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_bin", *(f"_{v}" for v in values))


def look_back(candidates: DataFrame, history: DataFrame, group: str, key: str, at: str, happened: str, days: int, **values: Column) -> DataFrame:
    """(key, n_past, and for each value its sum and the count of its non-null rows) over the group's history with at - days <= happened < at.

    A candidate reads the running totals at both ends of its span; what it adds
    to its own history is taken off.  Candidates without history are left out.
    Ids are unique in history.
    """
    span = days * 86400 * 1_000_000
    past = history.where(F.col(happened).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), _micros(happened).alias("t"), *(v.cast("double").alias(n) for n, v in values.items()))
    cand = candidates.where(F.col(at).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), _micros(at).alias("t"))
    adds = {"n_past": F.lit(1).cast("long")} | {f"{n}_n": F.col(n).isNotNull().cast("long") for n in values} | {n: F.coalesce(n, F.lit(0.0)) for n in values}
    nothing = {n: F.lit(0.0 if n in values else 0).cast("double" if n in values else "long").alias(n) for n in adds}
    steps = past.select("g", F.lit(None).cast(cand.schema["k"].dataType).alias("k"), "t", F.lit(1).alias("kind"), *(c.alias(n) for n, c in adds.items()))
    ends = [cand.select("g", "k", (F.col("t") - back).alias("t"), F.lit(kind).alias("kind"), *nothing.values()) for back, kind in ((0, 0), (span, -1))]
    totals = running(steps.unionAll(ends[0]).unionAll(ends[1]), "g", "t", "kind", *adds).where("kind < 1")
    own = cand.select("g", "k", F.col("t").alias("at")).join(past, ["g", "k"]).where((F.col("t") < F.col("at")) & (F.col("t") >= F.col("at") - span))
    own = own.select("g", "k", F.lit(0).alias("kind"), *((-c).alias(n) for n, c in adds.items()))
    signed = totals.select("g", "k", "kind", *(F.when(F.col("kind") == 0, F.col(n)).otherwise(-F.col(n)).alias(n) for n in adds)).unionAll(own)
    return signed.groupBy(F.col("k").alias(key)).agg(*(F.sum(n).alias(n) for n in adds)).where("n_past > 0")


def stabbing_count(df: DataFrame, group: str, key: str, start: str, end: str) -> DataFrame:
    """(key, n): other intervals [start, end] of the group that hold the row's start.

    Starts so far less ends that lie before, by running totals.  Intervals that
    end before they start hold nothing.
    """
    ok = df.where((F.col(start).isNotNull()) & (F.col(end) >= F.col(start)))
    point = lambda frame, t, kind, d: frame.select(F.col(group).alias("g"), F.col(key).alias("k"), _micros(t).alias("t"), F.lit(kind).alias("kind"), F.lit(d).cast("long").alias("d"))
    events = point(ok, start, 0, 1).unionAll(point(ok, end, 2, -1)).unionAll(point(df.where(F.col(start).isNotNull()), start, 1, 0))
    counted = running(events.where("g IS NOT NULL"), "g", "t", "kind", "d").where("kind = 1").select(F.col("k").alias(key), F.col("d").alias("n"))
    itself = ok.select(key).withColumn("_self", F.lit(1))
    return counted.join(itself, key, "left").select(key, (F.col("n") - F.coalesce("_self", F.lit(0))).cast("long").alias("n"))
