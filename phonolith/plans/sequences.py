"""Queries on ordered rows: runs, words, onsets, silence, merged results, logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from phonolith.functions import arrays as A, text as T
from phonolith.operators import islands, transcript

from .registry import query

#: Frames of a stream: an event's type as its token (error is blank), its value as a probability.
FRAMES = """(select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, case event_type when 'error' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then 3 when 'view' then 4 end as id, least(1.0::double, value / 200) as prob from events)"""
RUNS = "(select *, sum(new) over (partition by user_id order by pos) as run from (select *, case when lag({0}) over (partition by user_id order by pos) is not distinct from {0} then 0 else 1 end as new from {1}))"


def frames(events: DataFrame) -> DataFrame:
    ids = {"error": 0, "click": 1, "purchase": 2, "signup": 3, "view": 4}
    token = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ids.items()])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("user_id", "event_id", (F.row_number().over(w) - 1).alias("pos"), token.alias("id"), F.least(F.lit(1.0), F.col("value") / 200).alias("prob"))


def spans(events: DataFrame) -> DataFrame:
    """Collapsed runs of tokens, blanks dropped."""
    f = frames(events).withColumn("lp", F.log(F.greatest(F.col("prob"), F.lit(1e-6))))
    return islands.runs(f, ["user_id"], ["pos"], F.col("id"), F.avg("lp").alias("log_prob")).filter("value <> 0")


SPANS = f"(select user_id, run, min(id) as id, min(pos) as start, max(pos) as stop, count(*) as n, avg(ln(greatest(prob, 1e-6))) as lp from {RUNS.format('id', FRAMES)} group by user_id, run having min(id) <> 0)"


@query("r086_ctc_spans", f"select user_id, id, start as start_frame, stop as end_frame, n as frames, round(lp, 9) as log_prob, round(least(1.0, exp(lp)), 9) as confidence from {SPANS}", "events")
def _(events: DataFrame) -> DataFrame:
    s = spans(events)
    return s.select("user_id", F.col("value").alias("id"), F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), F.col("length").alias("frames"), F.round("log_prob", 9).alias("log_prob"), F.round(F.least(F.lit(1.0), F.exp("log_prob")), 9).alias("confidence"))


@query("r087_ctc_collapse", f"select user_id, string_agg(cast(id as varchar), ' ' order by start) as ids from {SPANS} group by user_id", "events")
def _(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("pos")
    kept = frames(events).withColumn("last", F.lag("id").over(w)).filter(~F.col("id").eqNullSafe(F.col("last")) & (F.col("id") != 0))
    return kept.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"].cast("string")), " ").alias("ids"))


@query("r088_utterance_extent", f"select user_id, min(pos) filter (where id <> 0) as first_frame, max(pos) filter (where id <> 0) as last_frame, round(avg(ln(greatest(prob, 1e-6))) filter (where id <> 0), 9) as log_prob from {FRAMES} group by user_id", "events")
def _(events: DataFrame) -> DataFrame:
    on = lambda c: F.when(F.col("id") != 0, c)
    lp = F.log(F.greatest(F.col("prob"), F.lit(1e-6)))
    return frames(events).groupBy("user_id").agg(F.min(on(F.col("pos"))).cast("long").alias("first_frame"), F.max(on(F.col("pos"))).cast("long").alias("last_frame"), F.round(F.avg(on(lp)), 9).alias("log_prob"))


@query("r164_span_times", f"select user_id, start as start_frame, round(start * 0.08::double, 6) as start_s, round((stop + 1) * 0.08::double, 6) as end_s, round(greatest(0, (stop + 1) * 0.08::double - start * 0.08::double), 6) as duration_s from {SPANS}", "events")
def _(events: DataFrame) -> DataFrame:
    s, e = F.col("start") * 0.08, (F.col("end") + 1) * 0.08
    return spans(events).select("user_id", F.col("start").alias("start_frame"), F.round(s, 6).alias("start_s"), F.round(e, 6).alias("end_s"), F.round(F.greatest(F.lit(0.0), e - s), 6).alias("duration_s"))


#: Tokens of a turn: its words, of which those in upper case begin a word.
TOKENS = "(select conv_id, turn, generate_subscripts(w, 1) - 1 as pos, unnest(w) as piece from (select conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as w from conversations))"


def tokens(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.posexplode(T.words(F.col("text"))).alias("pos", "piece"))


@query("r089_word_groups", f"select conv_id, turn, cast(word - 1 as bigint) as word, string_agg(piece, '' order by pos) as text, min(pos) * 0.08::double as start_s, (max(pos) + 1) * 0.08::double as end_s, round(avg(length(piece)), 6) as confidence from (select *, sum(case when pos = 0 or regexp_matches(piece, '^[A-Z]') then 1 else 0 end) over (partition by conv_id, turn order by pos) as word from {TOKENS}) group by conv_id, turn, word", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    """Words of tokens: one begins where a token is marked so, or where no word is open."""
    w = Window.partitionBy("conv_id", "turn").orderBy("pos")
    begins = ((F.col("pos") == 0) | F.col("piece").rlike("^[A-Z]")).cast("long")
    t = tokens(conversations).withColumn("begins", begins).withColumn("word", F.sum("begins").over(w) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    return t.groupBy("conv_id", "turn", "word").agg(text.alias("text"), (F.min("pos") * 0.08).alias("start_s"), ((F.max("pos") + 1) * 0.08).alias("end_s"), F.round(F.avg(F.length("piece")), 6).alias("confidence"))


@query("r058_control_tokens", f"select conv_id, turn, count(*) filter (where id is null) as kept, count(*) filter (where id = 1) as eou, count(*) filter (where id = 2) as eob, count(*) filter (where id = 3) as control from (select *, case when regexp_matches(piece, '^The') then 1 when regexp_matches(piece, '^An') then 2 when regexp_matches(piece, '^[A-Z]') then 3 end as id from {TOKENS}) group by all", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    p = F.col("piece")
    kind = F.when(p.rlike("^The"), "eou").when(p.rlike("^An"), "eob").when(p.rlike("^[A-Z]"), "control")
    t = tokens(conversations).withColumn("kind", kind)
    return t.groupBy("conv_id", "turn").agg(F.count_if(F.col("kind").isNull()).alias("kept"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("eou", "eob", "control")])


@query("r090_energy_average", f"select user_id, event_id, round(avg(prob) over (partition by user_id order by pos rows between 5 preceding and current row), 9) as energy from {FRAMES}", "events")
def _(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("pos").rowsBetween(-5, 0)
    return frames(events).select("user_id", "event_id", F.round(F.avg("prob").over(w), 9).alias("energy"))


@query("r091_rolling_rms", f"select user_id, event_id, round(sqrt(sum(prob * prob) over w / count(*) over w), 9) as level from {FRAMES} window w as (partition by user_id order by pos rows between 3 preceding and current row)", "events")
def _(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("pos").rowsBetween(-3, 0)
    return frames(events).select("user_id", "event_id", F.round(F.sqrt(F.sum(F.col("prob") * F.col("prob")).over(w) / F.count("*").over(w)), 9).alias("level"))


@query("r092_silence_tail", f"select user_id, (max(pos) - coalesce(max(pos) filter (where prob >= 0.5), min(pos) - 1)) * 160 as tail_frames from {FRAMES} group by user_id", "events")
def _(events: DataFrame) -> DataFrame:
    spoken = F.max(F.when(F.col("prob") >= 0.5, F.col("pos")))
    return frames(events).groupBy("user_id").agg(((F.max("pos") - F.coalesce(spoken, F.min("pos") - 1)) * 160).cast("long").alias("tail_frames"))


SPEECH = f"(select user_id, run, min(speech) as speech, min(pos) as start, max(pos) as stop, count(*) as n, max(prob) as p from {RUNS.format('speech', '(select *, case when prob >= 0.5 then 1 else 0 end as speech from ' + FRAMES + ')')} group by user_id, run)"


def speech(events: DataFrame) -> DataFrame:
    return islands.runs(frames(events), ["user_id"], ["pos"], (F.col("prob") >= 0.5).cast("int"), F.max("prob").alias("p"))


@query("r093_speech_onset", f"select u.user_id, min(start) * 160 as onset_frame from (select distinct user_id from events) u left join {SPEECH} s on s.user_id = u.user_id and speech = 1 and n >= 2 group by u.user_id", "events")
def _(events: DataFrame) -> DataFrame:
    """The first frame of the first run of at least two speaking hops; null if none."""
    ok = (F.col("value") == 1) & (F.col("length") >= 2)
    return speech(events).groupBy("user_id").agg((F.min(F.when(ok, F.col("start"))) * 160).alias("onset_frame"))


@query("r094_silence_boundary", f"select user_id, case when max(pos) filter (where prob < 0.5 and pos between 3 and 20) is null then 480 else least(3200, (max(pos) filter (where prob < 0.5 and pos between 3 and 20) + 1) * 160) end as boundary from {FRAMES} group by user_id", "events")
def _(events: DataFrame) -> DataFrame:
    """The end of the last silent hop of hops 3 to 20, at most frame 3200; hop 3's begin if there is none."""
    last = F.max(F.when((F.col("prob") < 0.5) & F.col("pos").between(3, 20), F.col("pos")))
    return frames(events).groupBy("user_id").agg(F.when(last.isNull(), 480).otherwise(F.least(F.lit(3200), (last + 1) * 160)).cast("long").alias("boundary"))


@query("r052_speech_in_range", f"select user_id, coalesce(bool_or(prob >= 0.5) filter (where pos between 2 and 6), false) as speaks from {FRAMES} group by user_id", "events")
def _(events: DataFrame) -> DataFrame:
    return frames(events).groupBy("user_id").agg(F.coalesce(F.bool_or(F.when(F.col("pos").between(2, 6), F.col("prob") >= 0.5)), F.lit(False)).alias("speaks"))


@query("r078_window_summary", f"select user_id, cast(sum(n) as bigint) as hops, cast(sum(case when speech = 1 then n else 0 end) as bigint) as speech_hops, cast(sum(case when speech = 0 then n else 0 end) as bigint) as other_hops, max(case when speech = 1 then n else 0 end) as longest, max(p) as max_prob from {SPEECH} group by user_id", "events")
def _(events: DataFrame) -> DataFrame:
    n = F.col("length")
    on, off = F.when(F.col("value") == 1, n).otherwise(0), F.when(F.col("value") == 0, n).otherwise(0)
    return speech(events).groupBy("user_id").agg(F.sum(n).alias("hops"), F.sum(on).alias("speech_hops"), F.sum(off).alias("other_hops"), F.max(on).alias("longest"), F.max("p").alias("max_prob"))


@query("r171_recent_activity", f"with r as (select *, max(pos) over (partition by user_id) as newest from {FRAMES}), k as (select user_id, count(*) as n, count_if(prob >= 0.5) as s from r where pos > newest - 8 group by user_id) select user_id, s >= 4 and s >= 0.5 * n as recent_speech, n - s >= 5 as recent_silence from k", "events")
def _(events: DataFrame) -> DataFrame:
    """Of the last 8 hops: whether many speak, whether many are silent."""
    newest = F.max("pos").over(Window.partitionBy("user_id"))
    k = frames(events).withColumn("newest", newest).filter("pos > newest - 8").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("prob") >= 0.5).alias("s"))
    return k.select("user_id", ((F.col("s") >= 4) & (F.col("s") >= 0.5 * F.col("n"))).alias("recent_speech"), (F.col("n") - F.col("s") >= 5).alias("recent_silence"))


@query("r057_monotonic", "select user_id, event_id, coalesce(s >= last - 0.05 and s <= e, s <= e) as monotonic from (select *, max(e) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as last from (select user_id, event_id, ts, event_id % 97 * 1.0 as s, event_id % 97 + value / 100 - 0.2 as e from events))", "events")
def _(events: DataFrame) -> DataFrame:
    """Whether a row starts before it ends, and not before the latest end so far less a tolerance."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    d = events.select("user_id", "event_id", "ts", (F.col("event_id") % 97 * 1.0).alias("s"), (F.col("event_id") % 97 + F.col("value") / 100 - 0.2).alias("e"))
    ordered = F.col("s") <= F.col("e")
    return d.withColumn("last", F.max("e").over(w)).select("user_id", "event_id", F.coalesce((F.col("s") >= F.col("last") - 0.05) & ordered, ordered).alias("monotonic"))


@query("r096_reindex", "select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as idx from conversations", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("idx"))


@query("r106_token_order", f"select conv_id, turn, pos, rank from (select *, row_number() over (partition by conv_id order by pos % 7, turn, pos) as rank from {TOKENS})", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.col("pos") % 7, "turn", "pos")
    return tokens(conversations).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.row_number().over(w).cast("long").alias("rank"))


@query("r108_concat_results", "select conv_id, string_agg(text, chr(10) order by turn) as text, count(*) as parts from conversations group by conv_id", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    half = lambda k: conversations.filter(F.col("turn") % 2 == k)
    both = half(0).unionByName(half(1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return both.groupBy("conv_id").agg(text.alias("text"), F.count("*").alias("parts"))


@query("r108_concat_pieces", """with t as (select conv_id, turn, text, coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as o from conversations)
select conv_id, o // 1000 as piece, min(case when o > 0 then o - 1 else 0 end) as begin, count(*) as parts, string_agg(case when o > 0 then chr(10) else '' end || text, '' order by turn) as text from t group by 1, 2""", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    """Results of a conversation in order, as pieces that follow each other; none holds a whole conversation."""
    return transcript.joined_pieces(conversations, ["conv_id"], ["turn"], "text", "\n", 1000)


@query("r129_join_pieces", """with p as (select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations), t as (select conv_id, turn, text, coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as o from p where text <> '')
select conv_id, o // 1000 as piece, min(case when o > 0 then o - 1 else 0 end) as begin, count(*) as parts, string_agg(case when o > 0 then ' ' else '' end || text, '' order by turn) as text from t group by 1, 2""", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    """Trimmed fragments joined by single spaces, as pieces that follow each other."""
    tidy = conversations.select("conv_id", "turn", T.squeeze(F.col("text")).alias("text")).filter("text <> ''")
    return transcript.joined_pieces(tidy, ["conv_id"], ["turn"], "text", " ", 1000)


@query("r079_merge_meta", "select conv_id, sum(length(text)) / 100.0::double as duration_s, count(*) as segments, bool_and(role <> 'system') as is_final, arg_max(role, turn) as last_role from conversations group by conv_id", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("conv_id").agg((F.sum(F.length("text")) / 100.0).alias("duration_s"), F.count("*").alias("segments"), F.bool_and(F.col("role") != "system").alias("is_final"), F.max_by("role", "turn").alias("last_role"))


@query("r104_argmax", "select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as bigint) as best from embeddings", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", A.argmax(F.col("embedding")).alias("best"))


LOG_PROB = "x[b]::double - list_max(x)::double - ln(list_sum(list_transform(x, lambda v: exp(v::double - list_max(x)::double))))"


@query("r134_log_softmax", f"select vec_id, round({LOG_PROB}, 6) as log_prob, round(exp({LOG_PROB}), 6) as confidence from (select vec_id, embedding as x, vec_id % 64 + 1 as b from embeddings)", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    lp = A.log_softmax_at(F.col("embedding"), F.col("vec_id") % 64)
    return embeddings.select("vec_id", F.round(lp, 6).alias("log_prob"), F.round(F.exp(lp), 6).alias("confidence"))


@query("r135_frame_argmax", f"select vec_id, cast(b - 1 as bigint) as best, round({LOG_PROB}, 6) as log_prob from (select vec_id, embedding as x, list_position(embedding, list_max(embedding)) as b from embeddings)", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    d = embeddings.withColumn("best", A.argmax(F.col("embedding")))
    return d.select("vec_id", "best", F.round(A.log_softmax_at(F.col("embedding"), F.col("best")), 6).alias("log_prob"))


#: Utterances of 25 logit frames over 64 tokens, token 0 blank.
LOGITS = "(select vec_id // 25 as utt, vec_id % 25 as pos, list_position(embedding, list_max(embedding)) - 1 as id from embeddings)"


@query("r163_ctc_pipeline", f"""with f as (select *, case when lag(id) over (partition by utt order by pos) is not distinct from id then 0 else 1 end as new from {LOGITS}),
r as (select *, sum(new) over (partition by utt order by pos) as run from f),
s as (select utt, run, min(id) as id, min(pos) as a, max(pos) as b from r group by utt, run having min(id) <> 0)
select utt, string_agg(chr(cast(96 + id as int)), '' order by a) as text, count(*) as tokens, round(min(a) * 0.04::double, 3) as start_s, round((max(b) + 1) * 0.04::double, 3) as end_s from s group by utt""", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """Logits to tokens to text with times, in one plan."""
    f = embeddings.select(F.expr("vec_id div 25").alias("utt"), (F.col("vec_id") % 25).alias("pos"), A.argmax(F.col("embedding")).alias("id"))
    s = islands.runs(f, ["utt"], ["pos"], F.col("id")).filter("value <> 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: F.char(96 + x["value"])), "")
    return s.groupBy("utt").agg(text.alias("text"), F.count("*").alias("tokens"), F.round(F.min("start") * 0.04, 3).alias("start_s"), F.round((F.max("end") + 1) * 0.04, 3).alias("end_s"))


@query("r127_sentence_tokens", """with w as (select conv_id, turn, generate_subscripts(w, 1) - 1 as pos, unnest(w) as piece, n from (select conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as w, length(text) as n from conversations)),
e as (select *, sum(length(piece) + 1) over (partition by conv_id, turn order by pos) - 1 as char_end from w),
t as (select conv_id, turn, array_to_string(list(piece order by pos), ' ') as text from w group by all),
s0 as (select conv_id, turn, generate_subscripts(s, 1) as k, unnest(s) as raw from (select conv_id, turn, regexp_extract_all(text, '[^.!?]+[.!?]+|[^.!?]+$') as s from t)),
s as (select conv_id, turn, k, sum(length(raw)) over (partition by conv_id, turn order by k) as stop, sum(length(raw)) over (partition by conv_id, turn order by k) - length(raw) + length(raw) - length(ltrim(raw)) as start from s0)
select s.conv_id, s.turn, k - 1 as sentence, min(pos) filter (where char_end > start) as first_token, min(pos) filter (where char_end >= stop) as last_token from s join e on s.conv_id = e.conv_id and s.turn = e.turn group by s.conv_id, s.turn, k, start, stop""", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    """A sentence's first and last tokens, by where characters of the joined text end."""
    w = Window.partitionBy("conv_id", "turn").orderBy("pos")
    t = tokens(conversations).withColumn("char_end", F.sum(F.length("piece") + 1).over(w) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ")
    raw = t.groupBy("conv_id", "turn").agg(F.regexp_extract_all(text, F.lit(T.SENTENCE), F.lit(0)).alias("s"))
    s = raw.select("conv_id", "turn", F.posexplode("s").alias("sentence", "raw"))
    upto = F.sum(F.length("raw")).over(Window.partitionBy("conv_id", "turn").orderBy("sentence"))
    s = s.withColumn("stop", upto).withColumn("begin", F.col("stop") - F.length(F.ltrim("raw")))
    both = s.join(t, ["conv_id", "turn"])
    first, last = F.min(F.when(F.col("char_end") > F.col("begin"), F.col("pos"))), F.min(F.when(F.col("char_end") >= F.col("stop"), F.col("pos")))
    return both.groupBy("conv_id", "turn", F.col("sentence").cast("long").alias("sentence"), "begin", "stop").agg(first.cast("long").alias("first_token"), last.cast("long").alias("last_token")).drop("begin", "stop")
