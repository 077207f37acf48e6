"""Queries on sample arrays: channels, framing, resampling, levels, spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phonolith.functions import arrays as A, scalar as N, signal

from .registry import query

EACH = "unnest(range(1, {0} + 1))"


def exploded(df: DataFrame, column: str, name: str = "v") -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("i", name)).withColumn("i", F.col("i").cast("long"))


@query("r001_pcm_normalize", "select vec_id, c, i, round(embedding[i * 2 + c + 1]::double / 32768, 9) as v from embeddings, range(0, 2) t(c), range(0, 32) s(i)", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """Interleaved stereo as planar channels, scaled as 16-bit samples are."""
    planes = A.deinterleave(F.transform(F.col("embedding"), lambda v: v.cast("double")), 2, 1 / 32768)
    d = embeddings.select("vec_id", F.posexplode(planes).alias("c", "plane")).select("vec_id", F.col("c").cast("long").alias("c"), F.posexplode("plane").alias("i", "v"))
    return d.select("vec_id", "c", F.col("i").cast("long").alias("i"), F.round("v", 9).alias("v"))


@query("r002_deinterleave", "select vec_id, c, i, embedding[i * 3 + c + 1]::double as v from embeddings, range(0, 3) t(c), range(0, 21) s(i)", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """Three channels; the partial last frame is dropped."""
    planes = A.deinterleave(F.transform(F.col("embedding"), lambda v: v.cast("double")), 3)
    d = embeddings.select("vec_id", F.posexplode(planes).alias("c", "plane")).select("vec_id", F.col("c").cast("long").alias("c"), F.posexplode("plane").alias("i", "v"))
    return d.select("vec_id", "c", F.col("i").cast("long").alias("i"), "v")


@query("r025_downmix", "select vec_id, i, round((embedding[i * 2 + 1]::double + embedding[i * 2 + 2]::double) / 2, 9) as v from embeddings, range(0, 32) s(i)", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    mono = A.downmix(A.deinterleave(F.col("embedding"), 2), 2)
    return exploded(embeddings.select("vec_id", mono.alias("m")), "m").withColumn("v", F.round("v", 9))


@query("r026_media_mix", "select vec_id, i, round(embedding[i + 1]::double / 2 + embedding[i + 33]::double / 2, 9) as v from embeddings, range(0, 32) s(i)", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """Two planes, each adding its share."""
    planes = [F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)]
    mixed = F.zip_with(*planes, lambda a, b: a.cast("double") / 2 + b.cast("double") / 2)
    return exploded(embeddings.select("vec_id", mixed.alias("m")), "m").withColumn("v", F.round("v", 9))


@query("r027_slice_frames", "select vec_id, cast(greatest(0, least(64, ceil(vec_id % 80 + 10.5)) - greatest(0, least(64, floor(vec_id % 80 - 4.5)))) as int) as n, cast(embedding[cast(greatest(0, least(64, floor(vec_id % 80 - 4.5))) as int) + 1] as double) as first from embeddings", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    k = F.col("vec_id") % 80
    part = A.slice_frames(F.col("embedding"), k - 4.5, k + 10.5)
    return embeddings.select("vec_id", F.size(part).alias("n"), F.get(part, F.lit(0)).cast("double").alias("first"))


@query("r028_rate_policy", "select vec_id, 8000 * (1 + vec_id % 3) as rate, case when vec_id % 3 <> 1 then 'rate-mismatch' end as warning from embeddings", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """Audio passes through; a warning names those of another rate."""
    rate = 8000 * (1 + F.col("vec_id") % 3)
    return embeddings.select("vec_id", rate.alias("rate"), F.when(rate != 16000, "rate-mismatch").alias("warning"))


@query("r029_resample", "select vec_id, i, round(a + (b - a) * (p - floor(p)), 6) as v from (select vec_id, i, i * 1.5::double as p, embedding[cast(floor(i * 1.5::double) as int) + 1]::double as a, embedding[least(cast(floor(i * 1.5::double) as int) + 2, 64)]::double as b from embeddings, range(0, 43) s(i))", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    return exploded(embeddings.select("vec_id", A.resample(F.col("embedding"), 24000, 16000).alias("m")), "m").withColumn("v", F.round("v", 6))


@query("r033_rms", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double)) / 64), 9) as rms from embeddings", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", F.round(A.rms(F.col("embedding")), 9).alias("rms"))


@query("r056_foreground_filter", """with w as (select vec_id, k, 20 * log10(greatest(1e-5, sqrt(list_sum(list_transform(embedding[k * 8 + 1:k * 8 + 8], lambda v: v::double * v::double)) / 8))) as db from embeddings, range(0, 8) s(k)),
p as (select vec_id, quantile_disc(db, 0.9) as seg, quantile_disc(db, 0.9) filter (where k < 2) as onset from w group by vec_id)
select vec_id, round(seg + 20, 6) as foreground_db, round(onset + 20, 6) as onset_db, case when seg + 20 < 6 then 'foreground-too-quiet' when onset + 20 < 8 then 'short-onset-too-quiet' else 'accepted' end as reason from p""", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """A segment's 90th percentile level over the noise floor, whole and at its onset, against thresholds in turn."""
    return embeddings.select("vec_id", signal.foreground(F.col("embedding"), window=8, onset=16, noise_db=F.lit(-20.0), least_db=6.0, onset_db=8.0).alias("f")).select("vec_id", F.round("f.foreground_db", 6).alias("foreground_db"), F.round("f.onset_db", 6).alias("onset_db"), "f.reason")


FRAMES = "(select vec_id, k as sequence, k * {1} as start, least(64, k * {1} + {0}) - k * {1} as n, k * {1} + {0} >= 64 as is_last from embeddings, range(0, 64) s(k) where k * {1} < 64 and (k = 0 or k * {1} - {1} + {0} < 64))"


@query("r145_framing", f"select vec_id, sequence, start, n, is_last from {FRAMES.format(20, 8)}", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    f = embeddings.select("vec_id", F.explode(A.frames(F.col("embedding"), 20, 8)).alias("f"))
    return f.select("vec_id", F.col("f.sequence").cast("long").alias("sequence"), F.col("f.start").cast("long").alias("start"), F.size("f.samples").cast("long").alias("n"), "f.is_last")


@query("r146_chunk_overlap", f"select vec_id, sequence, start, n, is_last from {FRAMES.format(24, 18)}", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    f = embeddings.select("vec_id", F.explode(signal.chunks(F.col("embedding"), 24, 6)).alias("f"))
    return f.select("vec_id", F.col("f.sequence").cast("long").alias("sequence"), F.col("f.start").cast("long").alias("start"), F.size("f.samples").cast("long").alias("n"), "f.is_last")


@query("r147_audio_chunker", f"select vec_id, sequence, round(start / 16000.0::double, 6) as start_s, round((start + n) / 16000.0::double, 6) as end_s from {FRAMES.format(32, 24)}", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """Chunks of 2 ms with 0.5 ms overlap at 16 kHz."""
    f = embeddings.select("vec_id", F.explode(signal.chunks(F.col("embedding"), 32, 8)).alias("f"))
    return f.select("vec_id", F.col("f.sequence").cast("long").alias("sequence"), F.round(F.col("f.start") / 16000, 6).alias("start_s"), F.round((F.col("f.start") + F.size("f.samples")) / 16000, 6).alias("end_s"))


@query("r148_pre_emphasis", "select vec_id, i, round(embedding[i + 1]::double - case when i = 0 then 0 else 0.97::double * embedding[i]::double end, 9) as v from embeddings, range(0, 64) s(i)", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    return exploded(embeddings.select("vec_id", A.pre_emphasis(F.col("embedding")).alias("m")), "m").withColumn("v", F.round("v", 9))


@query("r149_hann_window", "select vec_id, round(list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::double * case when i between 7 and 56 then 0.5 - 0.5 * cos(2 * pi() * (i - 7) / 49) else 0 end)), 6) as windowed from embeddings", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    product = F.zip_with(F.col("embedding"), A.hann(50, 64), lambda a, b: a.cast("double") * b)
    return embeddings.select("vec_id", F.round(A.total(product), 6).alias("windowed"))


@query("r150_power_spectrum", "select vec_id, i, round(sum(v * cos(2 * pi() * i * n / 64)) ** 2 + sum(v * sin(2 * pi() * i * n / 64)) ** 2, 6) as v from (select vec_id, generate_subscripts(embedding, 1) - 1 as n, unnest(embedding)::double as v from embeddings), range(0, 33) k(i) group by vec_id, i", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    return exploded(embeddings.select("vec_id", signal.power_spectrum(64)("embedding").alias("m")), "m").withColumn("v", F.round("v", 6))


@query("r151_mel_filterbank", """with e as (select m, case when x >= 15 then 1000 * exp((x - 15) * ln(6.4) / 27) else x * 200 / 3 end as hz from (select m, m * (15 + ln(8) * 27 / ln(6.4)) / 13 as x from range(0, 14) t(m))),
t as (select a.m, i, 2 / (c.hz - a.hz) * greatest(0, least((i * 250 - a.hz) / (b.hz - a.hz), (c.hz - i * 250) / (c.hz - b.hz))) as w from e a join e b on b.m = a.m + 1 join e c on c.m = a.m + 2, range(0, 33) s(i)),
p as (select vec_id, i, sum(v * cos(2 * pi() * i * n / 64)) ** 2 + sum(v * sin(2 * pi() * i * n / 64)) ** 2 as v from (select vec_id, generate_subscripts(embedding, 1) - 1 as n, unnest(embedding)::double as v from embeddings), range(0, 33) k(i) group by vec_id, i)
select vec_id, m::int as mel, round(sum(v * w), 6) as energy from p join t using (i) group by vec_id, m""", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """Energies of each vector's spectrum in twelve mel bands, at 16 kHz."""
    bank = F.array(*[F.array(*map(F.lit, w.tolist())) for w in signal.mel_filterbank(16000, 64, 12)])
    power = embeddings.select("vec_id", signal.power_spectrum(64)("embedding").alias("power"))
    energy = F.transform(bank, lambda w: F.aggregate(F.zip_with("power", w, lambda p, x: p * x), F.lit(0.0), lambda n, x: n + x))
    return power.select("vec_id", F.posexplode(energy).alias("mel", "v")).select("vec_id", "mel", F.round("v", 6).alias("energy"))


@query("r152_log_mel", None, "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    m = signal.log_mel(embeddings.select(F.col("vec_id").alias("key"), signal.tiled(F.col("embedding"), 40).alias("samples")))
    return m.groupBy("key").agg(F.count("*").alias("frames"), F.max("valid").alias("valid"), F.round(F.avg(F.aggregate("mel", F.lit(0.0), lambda a, v: a + v) / 80), 3).alias("mean"))


@query("r155_log_mel_kaldi", None, "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    m = signal.log_mel(embeddings.select(F.col("vec_id").alias("key"), signal.tiled(F.col("embedding"), 40).alias("samples")), style="kaldi")
    return m.groupBy("key").agg(F.count("*").alias("frames"), F.round(F.avg(F.aggregate("mel", F.lit(0.0), lambda a, v: a + v) / 80), 3).alias("mean"))


@query("r153_feature_normalize", "select vec_id // 50 as utt, vec_id, i, round((x - avg(x) over w) / (coalesce(stddev_samp(x) over w, 0) + 1e-5), 6) as v from (select vec_id, i, embedding[i + 1]::double as x from embeddings, range(0, 64) s(i)) window w as (partition by vec_id // 50, i)", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """Each feature over an utterance's frames to mean 0 and deviation 1."""
    d = exploded(embeddings, "embedding", "x").withColumn("utt", F.expr("vec_id div 50"))
    return signal.normalize_features(d, "utt", "i", "x").select("utt", "vec_id", "i", F.round("normal", 6).alias("v"))


@query("r156_transpose", "select vec_id // 50 as utt, i as mel, string_agg(cast(cast(floor(embedding[i + 1]::double * 1000) as bigint) as varchar), ',' order by vec_id) as row from embeddings, range(0, 64) s(i) group by all", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    d = exploded(embeddings, "embedding", "x").withColumn("utt", F.expr("vec_id div 50"))
    cell = F.struct("vec_id", F.floor(F.col("x").cast("double") * 1000).cast("string").alias("c"))
    return d.groupBy("utt", F.col("i").alias("mel")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["c"]), ",").alias("row"))


@query("r157_evenly_spaced", "select vec_id, i, embedding[cast(floor(i * 63 / 9.0::double + 0.5) as int) + 1]::double as v from embeddings, range(0, 10) s(i)", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    return exploded(embeddings.select("vec_id", A.evenly(F.col("embedding"), 10).alias("m")), "m").withColumn("v", F.col("v").cast("double"))


@query("r076_min_max", "select vec_id, i as bucket, list_min(embedding[i * 6 + 1:case when i = 9 then 64 else i * 6 + 6 end])::double as low, list_max(embedding[i * 6 + 1:case when i = 9 then 64 else i * 6 + 6 end])::double as high from embeddings, range(0, 10) s(i)", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", F.explode(A.min_max(F.col("embedding"), 10)).alias("b")).select("vec_id", F.col("b.bucket").cast("long").alias("bucket"), "b.low", "b.high")


@query("r103_nearest_hop", "select p_partkey, (list([c, p]::int[] order by abs(c - (100 + p_size * 5)), p))[1][1] as hop from part, (values (160, 0), (256, 1)) t(c, p) group by p_partkey", "part")
def _(part: DataFrame) -> DataFrame:
    """The supported hop (10 or 16 ms at 16 kHz) nearest to a wish; the first of equals."""
    return part.select("p_partkey", signal.nearest([160, 256], 100 + F.col("p_size") * 5).alias("hop"))


#: The key's steps in SQL: unsigned 32-bit products in 128 bits; s is the state, u a sample's 16 bits.
_M32 = "(({0})::hugeint & 4294967295)"
_ROTL = lambda x, n: _M32.format(f"(({x}) << {n}) | (({x}) >> {32 - n})")
_KEY = _M32.format(f"{_ROTL(_M32.format(f'u * {signal.MIX_A}'), 15)} * {signal.MIX_B}")
_STEP = _M32.format(f"{_ROTL(f'xor(s, {_KEY})', 13)} * 5 + {signal.MIX_C}")
_UNIT = "(greatest(-32768, least(32767, floor(v::double * 32768 + 0.5)))::hugeint & 65535)"
_END = lambda x, n, by: _M32.format(f"xor({x}, {x} >> {n}) * {by}")


def _audio_key_sql(places: str) -> str:
    """Keys of embeddings read at the places that a list expression of n, their length, gives."""
    return f"""with k as (select vec_id, len(embedding) as n, list_reduce(list_prepend(len(embedding)::hugeint, list_transform(list_transform({places.replace('$n', 'len(embedding)')}, lambda i: embedding[i + 1]), lambda v: {_UNIT})), lambda s, u: {_STEP}) as a from embeddings),
b as (select vec_id, n, {_END('a', 16, signal.END_A)} as b from k), c as (select vec_id, n, {_END('b', 13, signal.END_B)} as c from b)
select vec_id, n || '_' || xor(c, c >> 16) as key from c"""


@query("r113_audio_key", _audio_key_sql("range($n)"), "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", signal.audio_key(F.col("embedding")).alias("key"))


@query("r113_audio_key_long", _audio_key_sql("list_concat(range(8), range(8, $n - 8, ($n - 16) // (32 - 16)), range($n - 8, $n))"), "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """The key of signals that count as long: both edges and a strided middle."""
    return embeddings.select("vec_id", signal.audio_key(F.col("embedding"), whole=16, edge=8, points=32).alias("key"))


@query("r019_wav_round_trip", "select vec_id, 16000 as sample_rate, count(*)::int as n, round(max(abs(v - trunc(greatest(-1.0::double, least(1.0, v)) * case when v < 0 then 32768 else 32767 end) / 32768)), 6) as error from (select vec_id, unnest(embedding)::double / 10 as v from embeddings) group by vec_id", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """Samples as WAV bytes and back: how many, and the largest error."""
    from phonolith.sources import wav

    d = embeddings.select(F.col("vec_id").alias("key"), F.transform(F.col("embedding"), lambda v: v / 10).alias("samples"))
    back = wav.decode(wav.encode(d, 16000))
    both = d.join(back.withColumnRenamed("samples", "got"), "key")
    error = F.array_max(F.zip_with("samples", "got", lambda a, b: F.abs(a - b)))
    return both.select(F.col("key").alias("vec_id"), "sample_rate", F.size("got").alias("n"), F.round(error, 6).alias("error"))


@query("r003_wav_decode", "select vec_id, 32000 as sample_rate, i, cast(trunc(greatest(-1.0::double, least(1.0, v)) * case when v < 0 then 32768 else 32767 end) as int) / 32768.0::double as v from (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as v from embeddings)", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    from phonolith.sources import wav

    files = wav.encode(embeddings.select(F.col("vec_id").alias("key"), F.col("embedding").alias("samples")), 32000)
    return wav.decode(files).select(F.col("key").alias("vec_id"), "sample_rate", F.posexplode("samples").alias("i", "v")).withColumns({"i": F.col("i").cast("long"), "v": F.col("v").cast("double")})
