"""Queries over files: WAV folders read in ranges, as a stream and with labels; ordered CSV and JSON reports, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phonolith.operators import stats
from phonolith.session import scratch
from phonolith.sources import files, wav

from .numbers import SIDES, differences
from .registry import query

RATE = 16000
#: Samples of recordings, 50 vectors each, as their files hold them: v at place i of recording k.
SAMPLES = "(select 'rec-' || vec_id // 50 as key, (vec_id % 50) * 64 + i as i, trunc(greatest(-1.0::double, least(1.0::double, v)) * case when v < 0 then 32768 else 32767 end) / 32768.0::double as v from (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as v from embeddings))"


def recordings(embeddings: DataFrame) -> tuple[DataFrame, str]:
    """Recordings of at most 50 vectors, written as WAV files; and their folder."""
    spark = files.register(embeddings.sparkSession)
    parts = embeddings.groupBy(F.expr("vec_id div 50").alias("n")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("p"))
    audio = parts.select(F.concat(F.lit("rec-"), "n").alias("key"), F.lit(RATE).alias("sample_rate"), F.flatten(F.transform("p", lambda x: x["embedding"])).alias("samples"))
    path = scratch(spark, "wav")
    audio.write.format("wav").mode("append").save(path)
    return audio, path


@query("r004_wav_source", f"select key, {RATE} as sample_rate, (select count(*) from {SAMPLES} t where t.key = s.key) as frames, i // 1000 * 1000 as first_frame, count(*)::int as n, sum(v) as total from {SAMPLES} s group by key, i // 1000", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """WAV files in ranges of 1000 frames, each read by itself."""
    path = recordings(embeddings)[1]
    read = embeddings.sparkSession.read.format("wav").option("split", 2000).load(path)
    return read.select("key", "sample_rate", "frames", "first_frame", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query("r009_labelled_wav", f"select key, any_value(len) as frames, key || ' says' as transcription from (select key, i, count(*) over (partition by key) as len from {SAMPLES}) where substr(key, 5)::int % 2 = 0 group by key", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """Headers of WAV files joined with JSON labels of the same stem; every second recording has one."""
    audio, path = recordings(embeddings)
    spark = embeddings.sparkSession
    labelled = audio.filter(F.substring("key", 5, 9).cast("int") % 2 == 0)
    label = F.to_json(F.struct(F.concat("key", F.lit(" says")).alias("transcription")))
    labelled.select(F.concat("key", F.lit(".json")).alias("name"), label.alias("content")).write.format("named_files").mode("append").save(path)
    heads = spark.read.format("wav").option("header", "true").load(path).select("key", "frames")
    return heads.join(wav.labels(spark, path).withColumnRenamed("stem", "key"), "key").select("key", "frames", "transcription")


@query("r016_sample_stream", f"select key, i // 256 as sequence, i // 256 * 256 as first_frame, {RATE} as sample_rate, count(*)::int as n, sum(v) as total from {SAMPLES} group by key, i // 256", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """Recordings as a stream of chunks with the frames that they begin at."""
    path, spark = recordings(embeddings)[1], embeddings.sparkSession
    chunks = spark.readStream.format("wav").option("size", 256).load(path)
    out = scratch(spark, "chunks")
    small = chunks.select("key", "sequence", "first_frame", "sample_rate", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))
    small.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(small.schema).parquet(f"{out}/rows")


@query("r017_csv_files", "select 'l_orderkey,l_linenumber,note' as line union all select l_orderkey || ',' || l_linenumber || ',' || case when l_linestatus = 'F' then '\"' || l_returnflag || ',\"\"x\"\"\"' else '' end from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    """Rows in order as CSV part files with one header, read back as lines."""
    spark = files.register(lineitem.sparkSession)
    note = F.when(F.col("l_linestatus") == "F", F.concat("l_returnflag", F.lit(',"x"')))
    path = scratch(spark, "csv")
    lineitem.select("l_orderkey", "l_linenumber", note.alias("note")).orderBy("l_orderkey", "l_linenumber").write.format("ordered_csv").mode("append").save(path)
    return spark.read.text(f"{path}/part-*.csv").select(F.col("value").alias("line"))


@query("r018_csv_columns", f"select unnest({stats.RUN_COLUMNS}) as column_name, unnest(range({len(stats.RUN_COLUMNS)})) as pos", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    """The header of a written benchmark CSV: the columns in their fixed order."""
    spark = files.register(lineitem.sparkSession)
    path = scratch(spark, "csv")
    rows = lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("s"))
    rows.select(*[F.col("s").alias(c) if c == "audio_duration_sec" else F.lit(None).cast("string").alias(c) for c in stats.RUN_COLUMNS]).orderBy("audio_duration_sec").write.format("ordered_csv").mode("append").save(path)
    head = spark.read.text(f"{path}/part-00000000.csv")
    return head.select(F.posexplode(F.split("value", ",")).alias("pos", "column_name")).select("column_name", F.col("pos").cast("long").alias("pos"))


@query("r020_report_file", f"with {SIDES}, d as (select file, abs(l.v - r.v) as diff from l join r using (file)) select file, diff, (select count(*) from d) as shared, (select round(avg(diff), 6) from d) as mean_diff from d order by diff desc, file limit 10", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    """The ten worst differences and their summary as one JSON file, read back."""
    spark = files.register(lineitem.sparkSession)
    path = scratch(spark, "report")
    worst = differences(lineitem)
    worst.write.format("json_report").mode("append").save(path)
    return spark.read.schema(worst.schema).option("multiLine", True).json(f"{path}/report.json")
