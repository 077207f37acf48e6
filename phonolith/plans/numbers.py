"""Queries on numbers: scalars, summaries, runs of benchmarks, result-set joins, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from phonolith.functions import scalar as N
from phonolith.operators import selection, stats

from .registry import query



@query("r031_dbfs", "select l_orderkey, l_linenumber, case when l_discount > 0 then round(greatest(-100.0, 20 * log10(l_discount)), 6) else -100.0::double end as db from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", F.round(N.dbfs(F.col("l_discount")), 6).alias("db"))


@query("r032_amplitude", "select l_orderkey, l_linenumber, round(pow(10, -l_quantity / 20), 9) as amplitude from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", F.round(N.amplitude(-F.col("l_quantity")), 9).alias("amplitude"))


@query("r034_align_duration", "select l_orderkey, l_linenumber, greatest(16.0::double, floor(l_quantity * 7.3 / 16) * 16) as down, greatest(16.0::double, ceil(l_quantity * 7.3 / 16) * 16) as up, greatest(16.0::double, floor(l_quantity * 7.3 / 16 + 0.5) * 16) as near from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    d, g = F.col("l_quantity") * 7.3, F.lit(16.0)
    return lineitem.select("l_orderkey", "l_linenumber", N.align(d, g, "floor").alias("down"), N.align(d, g, "ceil").alias("up"), N.align(d, g).alias("near"))


@query("r035_chunk_frames", "select l_orderkey, l_linenumber, case when l_tax > 0 then cast(greatest(1, floor(greatest(1, floor(l_quantity + 0.5)) / 1000 * (l_tax * 200000) + 0.5)) as bigint) else 256 end as frames from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", N.chunk_frames(F.col("l_tax") * 200000, F.col("l_quantity")).alias("frames"))


@query("r036_frames_to_ms", "select l_orderkey, l_linenumber, case when l_tax > 0 then l_quantity / (l_tax * 1000) * 1000 else 0.0::double end as ms from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", N.frames_to_ms(F.col("l_quantity"), F.col("l_tax") * 1000).alias("ms"))


@query("r037_round_metric", "select l_orderkey, l_linenumber, floor((l_discount - 0.05) * l_extendedprice * 1000 + 0.5) / 1000 as rounded from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", N.round_half_up((F.col("l_discount") - 0.05) * F.col("l_extendedprice")).alias("rounded"))


@query("r038_clamp_probability", "select event_id, case when value > 100 then least(1.0, (value - 100) / 50) else 0.0::double end as p from events", "events")
def _(events: DataFrame) -> DataFrame:
    return events.select("event_id", N.clamp_unit((F.col("value") - 100) / 50).alias("p"))


@query("r039_safe_number", "select event_id, case when event_id % 3 = 0 then 0.0::double when event_id % 3 = 1 then value end as number from events", "events")
def _(events: DataFrame) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, " ").when(F.col("event_id") % 3 == 1, F.col("value").cast("string")).otherwise("x1")
    return events.select("event_id", N.safe_number(text).alias("number"))


@query("r040_rtfx", "select l_orderkey, l_linenumber, case when l_quantity > 0 and l_extendedprice > 0 and l_tax > 0 then round(l_quantity * 1000 / (l_extendedprice * l_tax), 6) end as rtfx from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", F.round(N.rtfx(F.col("l_quantity"), F.col("l_extendedprice") * F.col("l_tax")), 6).alias("rtfx"))


@query("r041_rtf", "select l_orderkey, l_linenumber, floor(l_extendedprice / (l_quantity * 1000) * 10000 + 0.5) / 10000 as rtf, case when l_quantity > 0 then floor(l_quantity * 1000 / l_extendedprice * 10000 + 0.5) / 10000 end as rtfx from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    s, ms = F.col("l_quantity"), F.col("l_extendedprice")
    return lineitem.select("l_orderkey", "l_linenumber", N.rtf(s, ms).alias("rtf"), N.round_half_up(N.rtfx(s, ms), 4).alias("rtfx"))


@query("r042_remaining_ms", "select l_orderkey, l_linenumber, case when l_discount > 0 then l_extendedprice / l_discount * (1 - l_discount) end as ms from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", N.remaining_ms(F.col("l_extendedprice"), F.col("l_discount")).alias("ms"))


@query("r044_mel_scales", "select o_orderkey, round(case when hz >= 1000 then 15 + ln(hz / 1000) * 27 / ln(6.4::double) else hz * 3 / 200 end, 6) as mel, round(1127 * ln(1 + hz / 700), 6) as mel_kaldi, round(hz, 4) as back, round(hz, 4) as back_kaldi from (select o_orderkey, o_totalprice / 50 as hz from orders)", "orders")
def _(orders: DataFrame) -> DataFrame:
    hz = F.col("o_totalprice") / 50
    mel, kaldi = N.hz_to_mel(hz), N.hz_to_mel_kaldi(hz)
    return orders.select("o_orderkey", F.round(mel, 6).alias("mel"), F.round(kaldi, 6).alias("mel_kaldi"), F.round(N.mel_to_hz(mel), 4).alias("back"), F.round(N.mel_to_hz_kaldi(kaldi), 4).alias("back_kaldi"))


@query("r045_seconds_per_frame", "select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then l_quantity / l_linenumber when l_linenumber % 3 = 1 then l_extendedprice * 0.01 / l_linenumber else 0.0::double end as seconds from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    n = F.col("l_linenumber")
    duration, hop = F.when(n % 3 == 0, F.col("l_quantity")), F.when(n % 3 == 1, 0.01)
    return lineitem.select("l_orderkey", "l_linenumber", N.seconds_per_frame(duration, F.col("l_extendedprice"), hop, n).alias("seconds"))


@query("r046_live_thresholds", "select l_orderkey, l_linenumber, greatest(l_quantity, l_tax * 100, l_discount * 500) as release_ms, case when l_returnflag = 'R' then -l_quantity + 6 end as threshold_db from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    release = N.release_ms(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 500)
    return lineitem.select("l_orderkey", "l_linenumber", release.alias("release_ms"), N.foreground_threshold(F.col("l_returnflag") == "R", -F.col("l_quantity"), F.lit(6.0)).alias("threshold_db"))


@query("r137_vignette", "select l_orderkey, l_linenumber, round(exp(-pow(l_linenumber - 1 - (n - 1) / 2.0::double, 2) / (2 * (n * 0.25::double) * (n * 0.25::double))), 9) as weight from (select *, count(*) over (partition by l_orderkey) as n from lineitem)", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("l_orderkey"))
    d = lineitem.withColumn("n", n)
    return d.select("l_orderkey", "l_linenumber", F.round(N.vignette(F.col("l_linenumber") - 1, F.col("n")), 9).alias("weight"))


@query("r158_overlap_cost", "select p_partkey, cast(greatest(1, ceil((5400 - 6) / (60.0 + p_size - 6))) as bigint) as steps, cast(greatest(1, ceil((5400 - 6) / (60.0 + p_size - 6))) * (60.0 + p_size) as double) as processed, round((greatest(1, ceil((5400 - 6) / (60.0 + p_size - 6))) * (60.0 + p_size) - 5400) / 5400.0::double, 9) as overhead from part", "part")
def _(part: DataFrame) -> DataFrame:
    steps, done, over = N.overlap_cost(F.lit(5400.0), 60.0 + F.col("p_size"), F.lit(6.0))
    return part.select("p_partkey", steps.cast("long").alias("steps"), done.cast("double").alias("processed"), F.round(over, 9).alias("overhead"))


@query("r162_max_new_tokens", "select l_orderkey, l_linenumber, case when l_linenumber = 1 then greatest(1, 40 - l_linenumber) else greatest(1, least(cast(trunc(l_quantity + 0.7) as bigint), 40 - l_linenumber)) end as budget from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    n = F.col("l_linenumber")
    return lineitem.select("l_orderkey", "l_linenumber", N.max_new_tokens(F.when(n > 1, F.col("l_quantity") + 0.7), F.lit(40), n).alias("budget"))


@query("r085_display_gain", "select user_id, case when peak > 0 then least(8.0::double, greatest(1.0, 500 / peak)) else 1.0::double end as gain from (select user_id, greatest(abs(min(value)), abs(max(value))) as peak from events group by user_id)", "events")
def _(events: DataFrame) -> DataFrame:
    ends = events.groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.select("user_id", N.display_gain(F.col("low"), F.col("high"), 500.0, 8.0).alias("gain"))


#: Benchmark runs of the driver's tables: quantity as seconds of audio, price as milliseconds of work.
SUMMARY = "count({0}) as count, min({0}) as min, max({0}) as max, round(avg({0}), 6) as mean, median({0}) as median, quantile_disc({0}, 0.9) as p90, round(case when count({0}) = 1 then 0 else stddev_samp({0}) end, 6) as stddev"


def tidy(df: DataFrame) -> DataFrame:
    return df.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query("r049_finite_filter", "select event_id, value as finite from events where event_id % 4 > 1", "events")
def _(events: DataFrame) -> DataFrame:
    k = F.col("event_id") % 4
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("value"))
    return events.select("event_id", v.alias("finite")).filter(N.finite(F.col("finite")))


for _n, _name, _agg in (
    (67, "mean", ("round(avg(l_extendedprice), 6)", lambda: F.round(F.avg("l_extendedprice"), 6))),
    (68, "median", ("median(l_extendedprice)", lambda: F.median("l_extendedprice"))),
    (70, "stddev", ("round(case when count(*) = 1 then 0 else stddev_samp(l_extendedprice) end, 6)", lambda: F.round(F.when(F.count("*") == 1, 0.0).otherwise(F.stddev_samp("l_extendedprice")), 6))),
):
    query(f"r{_n:03d}_{_name}", f"select l_returnflag, {_agg[0]} as {_name} from lineitem group by l_returnflag", "lineitem")(lambda lineitem, a=_agg[1], n=_name: lineitem.groupBy("l_returnflag").agg(a().alias(n)))


@query("r069_percentile", "select l_returnflag, quantile_disc(l_extendedprice, 0.9) as percentile, quantile_disc(l_extendedprice, 0.5) as p50, quantile_disc(l_extendedprice, 0.0) as p0, quantile_disc(l_extendedprice, 1.0) as p100 from lineitem group by l_returnflag", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of coarse keys, selected without a task that holds a group."""
    ranks = [selection.nearest(n, q) for n, q in (("percentile", 0.9), ("p50", 0.5), ("p0", 0.0), ("p100", 1.0))]
    return selection.select(lineitem, ["l_returnflag"], "l_extendedprice", ranks)


@query("r071_numeric_summary", f"select l_returnflag, l_linestatus, {SUMMARY.format('l_extendedprice')} from lineitem group by all", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return tidy(stats.summary(lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", coarse=True))


@query("r071_order_summary", f"select o_custkey, {SUMMARY.format('o_totalprice')} from orders group by o_custkey", "orders")
def _(orders: DataFrame) -> DataFrame:
    return tidy(stats.summary(orders, ["o_custkey"], "o_totalprice"))


@query("r072_confidence_averages", """with f as (select user_id, event_id % 50 as frame, avg(case when event_type <> 'error' then least(1.0, value / 200) end) as m, sum(case when event_type <> 'error' then least(1.0, value / 200) else 0 end) as s, count(case when event_type <> 'error' then 1 end) as k, count(*) as n from events group by all)
select user_id, round(sum(case when k > 0 then s end) / sum(k) + 1e-13, 10) as utterance, round(sum(s) / sum(n) + 1e-13, 10) as word, round(avg(m) + 1e-13, 10) as frame from f group by user_id""", "events")
def _(events: DataFrame) -> DataFrame:
    """A little is added before rounding, so that halves go one way in any order of summation.

    Mean of known confidences, mean with missing ones as 0, mean of per-frame means."""
    c = F.when(F.col("event_type") != "error", F.least(F.lit(1.0), F.col("value") / 200))
    frames = events.groupBy("user_id", (F.col("event_id") % 50).alias("frame")).agg(F.avg(c).alias("m"), F.sum(c).alias("s"), F.count(c).alias("k"), F.count("*").alias("n"))
    return frames.groupBy("user_id").agg(F.round(F.sum("s") / F.sum("k") + 1e-13, 10).alias("utterance"), F.round(F.coalesce(F.sum("s"), F.lit(0.0)) / F.sum("n") + 1e-13, 10).alias("word"), F.round(F.avg("m") + 1e-13, 10).alias("frame"))


@query("r073_frame_confidence", "select user_id, event_id % 50 as frame, round(sum(least(1.0, value / 200)), 10) as total, count(*) as n, round(avg(least(1.0, value / 200)), 10) as mean from events group by all", "events")
def _(events: DataFrame) -> DataFrame:
    c = F.least(F.lit(1.0), F.col("value") / 200)
    return events.groupBy("user_id", (F.col("event_id") % 50).alias("frame")).agg(F.round(F.sum(c), 10).alias("total"), F.count("*").alias("n"), F.round(F.avg(c), 10).alias("mean"))


@query("r074_weighted_confidence", "select l_orderkey, round(least(1.0, exp(sum(-l_discount * l_linenumber) / sum(l_linenumber))), 6) as confidence from lineitem group by l_orderkey", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_orderkey").agg(F.round(stats.weighted_confidence(-F.col("l_discount"), F.col("l_linenumber")), 6).alias("confidence"))


@query("r075_trimmed_low_mean", """select user_id, event_id, round(list_sum(list_sort(x)[1:greatest(1, cast(floor(len(x) * 0.6) as int))]) / greatest(1, cast(floor(len(x) * 0.6) as int)), 10) as background
from (select user_id, event_id, list(value) over (partition by user_id order by ts, event_id rows between 63 preceding and current row) as x from events)""", "events")
def _(events: DataFrame) -> DataFrame:
    from phonolith.functions.arrays import trimmed_low_mean

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-63, 0)
    d = events.withColumn("x", F.collect_list("value").over(w))
    return d.select("user_id", "event_id", F.round(trimmed_low_mean(F.col("x")), 10).alias("background"))


@query("r081_corpus_rtf", "select l_shipmode, rtf from (select l_linestatus as l_shipmode, case when sum(l_quantity) > 0 then round(sum(l_extendedprice) / 1000 / sum(l_quantity), 6) end as rtf from lineitem group by 1)", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    seconds = F.sum("l_quantity")
    return lineitem.groupBy(F.col("l_linestatus").alias("l_shipmode")).agg(F.when(seconds > 0, F.round(F.sum("l_extendedprice") / 1000 / seconds, 6)).alias("rtf"))


@query("r082_numeric_parity", "select l_linenumber, max(abs(l_discount - l_tax)) as max_abs, round(avg(abs(l_discount - l_tax)), 6) as mean_abs, round(sqrt(avg(pow(l_discount - l_tax, 2))), 6) as rmse, max(abs(l_discount - l_tax)) <= 0.09 as passed from lineitem group by l_linenumber", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    d = lineitem.groupBy("l_linenumber").agg(*stats.parity(F.col("l_discount"), F.col("l_tax")))
    return d.select("l_linenumber", "max_abs", F.round("mean_abs", 6).alias("mean_abs"), F.round("rmse", 6).alias("rmse"), (F.col("max_abs") <= 0.09).alias("passed"))


@query("r083_tensor_diff", "select a.vec_id, len(a.embedding) = len(b.embedding) as same_shape, round(list_max(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::double - b.embedding[i]::double))), 6) as max_abs, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::double - b.embedding[i]::double))) / 64, 6) as mean_abs from embeddings a join embeddings b on b.vec_id = a.vec_id + 1", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    other = embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    diff = F.zip_with("embedding", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    d = embeddings.join(other, "vec_id").select("vec_id", (F.size("embedding") == F.size("b")).alias("same_shape"), diff.alias("d"))
    return d.select("vec_id", "same_shape", F.round(F.array_max("d"), 6).alias("max_abs"), F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d"), 6).alias("mean_abs"))


#: Two result sets by file: lines of filled orders and lines that weren't returned, a later line overwriting an earlier one.
SIDES = "l as (select l_orderkey as file, (list(l_quantity order by l_linenumber desc, l_quantity desc))[1] as v from lineitem where l_linestatus = 'F' group by 1), r as (select l_orderkey as file, (list(l_quantity order by l_linenumber desc, l_quantity desc))[1] as v from lineitem where l_returnflag <> 'R' group by 1)"


def sides(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    last = lambda d: stats.keep_last(d.select(F.col("l_orderkey").alias("file"), F.col("l_quantity").alias("v"), "l_linenumber"), ["file"], F.struct("l_linenumber", "v")).select("file", "v")
    return last(lineitem.filter("l_linestatus = 'F'")), last(lineitem.filter("l_returnflag <> 'R'"))


@query("r059_result_sets", f"with {SIDES} select coalesce(l.file, r.file) as file, case when r.file is null then 'left' when l.file is null then 'right' else 'both' end as side, l.v as v_left, r.v as v_right from l full join r on l.file = r.file", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    left, right = (d.withColumnRenamed("v", n) for d, n in zip(sides(lineitem), ("v_left", "v_right")))
    both = left.join(right, "file", "full")
    side = F.when(F.col("v_right").isNull(), "left").when(F.col("v_left").isNull(), "right").otherwise("both")
    return both.select("file", side.alias("side"), "v_left", "v_right")


@query("r060_common_files", f"with {SIDES}, o as (select o_orderkey as file from orders where o_orderstatus = 'O') select l.file, l.v as v_left, r.v as v_right from l join r using (file) join o using (file)", "lineitem", "orders")
def _(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    left, right = (d.withColumnRenamed("v", n) for d, n in zip(sides(lineitem), ("v_left", "v_right")))
    return left.join(right, "file").join(orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("file")), "file")


@query("r107_key_sets", "select 'both' as part, count(*) as n from (select doc_id from documents intersect select doc_id from labels) union all select 'left', count(*) from (select doc_id from documents except select doc_id from labels) union all select 'right', count(*) from (select doc_id from labels except select doc_id from documents)", "documents", "labels")
def _(documents: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = documents.select("doc_id"), labels.select("doc_id")
    count = lambda d, part: d.groupBy().agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return count(a.intersect(b), "both").union(count(a.subtract(b), "left")).union(count(b.subtract(a), "right"))


@query("r080_match_counts", "select role, count(*) as files, count(*) filter (where a = b) as exact, count(*) filter (where lower(a) = lower(b)) as normalized, coalesce(round(avg(case when length(a) = 0 then 0 else levenshtein(a, b)::double / length(a) end), 6), 0) as mean_cer from (select a.role, regexp_replace(coalesce(a.text, ''), '[^ -~]', '', 'g') as a, regexp_replace(coalesce(b.text, ''), '[^ -~]', '', 'g') as b from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1) group by role", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    """Whole turns against the next ones."""
    from phonolith.functions.text import cer

    a = conversations.select("conv_id", "turn", "role", F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "").alias("a"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    same = lambda x, y: F.count_if(x == y)
    return a.join(b, ["conv_id", "turn"]).groupBy("role").agg(F.count("*").alias("files"), same(F.col("a"), F.col("b")).alias("exact"), same(F.lower("a"), F.lower("b")).alias("normalized"), F.coalesce(F.round(F.avg(cer(F.col("a"), F.col("b"))), 6), F.lit(0.0)).alias("mean_cer"))


@query("r105_top_mismatches", "select l_orderkey, l_linenumber, abs(l_discount - l_tax) as diff from lineitem order by diff desc, l_orderkey, l_linenumber limit 10", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    d = lineitem.select("l_orderkey", "l_linenumber", F.abs(F.col("l_discount") - F.col("l_tax")).alias("diff"))
    return d.orderBy(F.col("diff").desc(), "l_orderkey", "l_linenumber").limit(10)


def differences(lineitem: DataFrame) -> DataFrame:
    """The ten worst differences of two result sets, each with the whole summary."""
    left, right = (d.withColumnRenamed("v", n) for d, n in zip(sides(lineitem), ("a", "b")))
    d = left.join(right, "file").select("file", F.abs(F.col("a") - F.col("b")).alias("diff"))
    worst = d.orderBy(F.col("diff").desc(), "file").limit(10)
    return worst.join(F.broadcast(d.agg(F.count("*").alias("shared"), F.round(F.avg("diff"), 6).alias("mean_diff"))))


@query("r020_transcript_diff", f"with {SIDES}, d as (select file, abs(l.v - r.v) as diff from l join r using (file)) select file, diff, (select count(*) from d) as shared, (select round(avg(diff), 6) from d) as mean_diff from d order by diff desc, file limit 10", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return differences(lineitem)


RUN = """select l_orderkey || '-' || l_linenumber as run_id, l_quantity as audio_duration_sec, l_extendedprice as encode_ms, l_discount as decode_ms, case when l_returnflag = 'R' then 'failed, badly' end as error from lineitem"""


def runs(lineitem: DataFrame) -> DataFrame:
    """Nested run records."""
    metrics = F.struct(F.col("l_extendedprice").alias("encode_ms"), F.col("l_discount").alias("decode_ms"))
    return lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("run_id"), F.col("l_quantity").alias("audio_duration_sec"), metrics.alias("metrics"), F.when(F.col("l_returnflag") == "R", "failed, badly").alias("error"))


def flatten(r: DataFrame) -> DataFrame:
    s = F.col("audio_duration_sec")
    return r.select("run_id", "audio_duration_sec", "metrics.*", F.coalesce("error", F.lit("")).alias("error")).withColumns({"encode_rtfx": N.rtfx(s, F.col("encode_ms")), "decode_rtfx": N.rtfx(s, F.col("decode_ms"))})


@query("r047_flatten_runs", f"select run_id, audio_duration_sec, encode_ms, decode_ms, coalesce(error, '') as error, round(case when encode_ms > 0 then audio_duration_sec * 1000 / encode_ms end, 6) as encode_rtfx, round(case when decode_ms > 0 then audio_duration_sec * 1000 / decode_ms end, 6) as decode_rtfx from ({RUN})", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return flatten(runs(lineitem)).withColumns({c: F.round(c, 6) for c in ("encode_rtfx", "decode_rtfx")})


@query("r018_benchmark_csv", f"select run_id, ',,,' || run_id || ',,,,,' || cast(cast(audio_duration_sec as bigint) as varchar) || repeat(',', 18) || case when error is null then '' else '\"failed, badly\"' end || repeat(',', 13) as line from ({RUN})", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    r = flatten(runs(lineitem)).select("run_id", F.col("audio_duration_sec").cast("long").alias("audio_duration_sec"), "error")
    return stats.csv_lines(r, stats.RUN_COLUMNS).select("run_id", "line")


@query("r055_valid_rows", "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_linestatus = 'F'", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    prediction, reference = F.when(F.col("l_returnflag") == "R", "a"), F.when(F.col("l_linestatus") == "F", "b")
    return lineitem.filter(prediction.isNotNull() & reference.isNotNull()).select("l_orderkey", "l_linenumber")


@query("r021_report", """with s as (select l_returnflag as model, l_orderkey as file, avg(l_discount) as wer from lineitem group by all), c as (select file from s group by file having count(*) = (select count(distinct model) from s)),
r as (select model, count(*) as files, avg(wer) as wer from s join c using (file) group by model)
select 0::bigint as pos, '| model | files | wer |' as line union all select 1, '| - | - | - |' union all select 1 + row_number() over (order by model), '| ' || model || ' | ' || files || ' | ' || printf('%.4f', wer) || ' |' from r""", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    """A Markdown report over the files that all models have, a row a line."""
    scores = lineitem.groupBy(F.col("l_returnflag").alias("model"), F.col("l_orderkey").alias("file")).agg(F.avg("l_discount").alias("wer"))
    return stats.report(scores, "model", "file", ["wer"])
