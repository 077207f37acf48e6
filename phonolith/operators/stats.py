"""Summaries, parity and scores over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phonolith.functions.scalar import finite

from . import selection


def nearest_rank(column: str, q: float) -> Column:
    """Nearest-rank percentile of a named column; nulls don't count."""
    return F.expr(f"percentile_disc({q}) within group (order by `{column}`)")


def summary(df: DataFrame, keys: list[str], column: str, coarse: bool = False) -> DataFrame:
    """count, min, max, mean, median, p90 (nearest rank) and stddev (sample; 0 of one) of finite values by keys.

    One shuffle; the exact percentiles sort a group's distinct values with their counts in one task. For coarse keys,
    whose groups outgrow a task, they are selected in two passes that no task holds a group in.
    """
    v = F.col("_v")
    rows = df.select(*keys, F.when(finite(F.col(column)), F.col(column).cast("double")).alias("_v"))
    simple = [F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean")]
    spread = F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("stddev")
    if not coarse:
        return rows.groupBy(*keys).agg(*simple, F.median(v).alias("median"), nearest_rank("_v", 0.9).alias("p90"), spread)
    ranked = selection.select(rows, keys, "_v", [*selection.MIDDLE, selection.nearest("p90", 0.9)])
    ranked = ranked.select(*[F.col(k).alias(f"_of_{k}") for k in keys], ((F.col("_low") + F.col("_high")) / 2).alias("median"), "p90")
    sums = rows.groupBy(*keys).agg(*simple, spread)
    both = sums.join(ranked, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]) if keys else sums.join(F.broadcast(ranked))
    return both.select(*keys, "count", "min", "max", "mean", "median", "p90", "stddev")


def parity(a: Column, b: Column) -> list[Column]:
    """Largest and mean absolute difference, root mean square difference."""
    d = F.abs(a - b)
    return [F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rmse")]


def weighted_confidence(log_prob: Column, frames: Column) -> Column:
    """exp of the mean log-probability by frames, clamped to 0..1; 0 without frames."""
    return F.coalesce(F.least(F.lit(1.0), F.exp(F.sum(log_prob * frames) / F.nullif(F.sum(frames), F.lit(0)))), F.lit(0.0))


def keep_last(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """One row a key, that of the largest order: later duplicates overwrite."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


#: The fixed column order of a benchmark run's flat form.
RUN_COLUMNS = """batch_id started_at finished_at run_id sample_key sample_order sample_row_index repeat_index
audio_duration_sec speaker gender speed volume transcription reference_text exact_match_first similarity_first
preprocess_ms encode_ms decode_ms tokenize_ms total_ms rtf encode_rtfx decode_rtfx preprocessor_backend error
model_key backend encoder_quant decoder_quant preprocessor preprocessor_backend_setting hardware_cpu hardware_gpu
hardware_gpu_model hardware_gpu_cores hardware_vram hardware_memory hardware_webgpu""".split()


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a CSV line; columns that df lacks are empty."""
    from phonolith.functions.text import csv_field

    fields = [csv_field(F.col(c)) if c in df.columns else F.lit("") for c in columns]
    return df.withColumn("line", F.concat_ws(",", *fields))


def report(scores: DataFrame, model: str, file: str, metrics: list[str]) -> DataFrame:
    """(pos, line) of a Markdown table of each model's mean metrics over the files that all models have, a row a model."""
    models = scores.select(model).distinct()
    common = scores.groupBy(file).agg(F.count_distinct(model).alias("n")).join(F.broadcast(models.agg(F.count("*").alias("of"))), F.col("n") == F.col("of")).select(file)
    rows = scores.join(common, file, "left_semi").groupBy(model).agg(F.count_distinct(file).alias("files"), *[F.avg(m).alias(m) for m in metrics])
    line = lambda *cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    head = ["model", "files", *metrics]
    top = rows.sparkSession.range(2).select(F.col("id").alias("pos"), F.when(F.col("id") == 0, line(*map(F.lit, head))).otherwise(line(*[F.lit("-")] * len(head))).alias("line"))
    pos = F.row_number().over(Window.orderBy(model)).cast("long") + 1
    return top.union(rows.select(pos, line(F.col(model), F.col("files").cast("string"), *[F.format_string("%.4f", m) for m in metrics])))
