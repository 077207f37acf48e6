"""Queries on texts: normalisation, distances, sentences, rows and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phonolith.functions import edits, nested, scalar, text as T
from phonolith.operators import stats, transcript

from .registry import query

NORM = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
NORM_U = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '\\s+'), lambda w: w <> '')"
TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SENTENCES = "list_filter(list_transform(regexp_extract_all({0}, '[^.!?]+[.!?]+|[^.!?]+$'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


@query("r114_normalize_text", f"select doc_id, {NORM.format('text')} as norm from documents", "documents")
def _(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query("r115_normalize_unicode", f"select doc_id, {NORM_U.format('text')} as norm from documents", "documents")
def _(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", T.normalize_unicode(F.col("text")).alias("norm"))


#: Without compatibility forms, of which the tables have none.
COMPAT = "lower(trim(regexp_replace(translate(nfc_normalize(coalesce(text, '')), '‘’“”_*', repeat(chr(39), 2) || repeat(chr(34), 2) || '  '), '\\s+', ' ', 'g')))"


@query("r116_normalize_compat", f"select doc_id, {COMPAT} as norm from documents", "documents")
def _(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", T.normalize_compat("text").alias("norm"))


MARKED = "replace(replace(text, '. ', ' PARAGRAPH '), ', ', ' NEWLINE ')"


@query("r117_reference_text", f"select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace({MARKED}, 'PARAGRAPH', chr(10) || chr(10)), 'NEWLINE', chr(10)), '\\s+\\n', chr(10), 'g'), '\\n\\s+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as reference from documents", "documents")
def _(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", T.reference_text(F.expr(MARKED)).alias("reference"))


@query("r118_clean_reference", f"select doc_id, trim(regexp_replace(lower(replace(replace({MARKED}, 'PARAGRAPH', ' '), 'NEWLINE', ' ')), '[!-/:-@\\[-`{{-~]', '', 'g')) as cleaned from documents", "documents")
def _(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", T.clean_reference(F.expr(MARKED)).alias("cleaned"))


#: Turns of a conversation as reference and the next ones as results, whole.
PAIRS = f"select a.conv_id, a.turn, {NORM.format('a.text')} as a, {NORM.format('b.text')} as b, a.role from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1"


def pairs(conversations: DataFrame) -> DataFrame:
    turns = conversations.select("conv_id", "turn", T.normalize(F.col("text")).alias("a"), "role")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return turns.join(after, ["conv_id", "turn"])


@query("r119_levenshtein", f"select conv_id, turn, cast(levenshtein(a, b) as int) as distance from ({PAIRS})", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    return pairs(conversations).select("conv_id", "turn", F.levenshtein("a", "b").alias("distance"))


@query("r120_similarity", f"select conv_id, turn, case when greatest(length(a), length(b)) = 0 then 1.0::double else 1 - levenshtein(a, b)::double / greatest(length(a), length(b)) end as similarity from ({PAIRS})", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    return pairs(conversations).select("conv_id", "turn", T.similarity(F.col("a"), F.col("b")).alias("similarity"))


WORD_PAIRS = f"(select *, {WORDS.format('a')} as wa, {WORDS.format('b')} as wb from ({PAIRS}))"

def word_pairs(conversations: DataFrame) -> DataFrame:
    return pairs(conversations).withColumns({"wa": T.words(F.col("a")), "wb": T.words(F.col("b"))})


@query("r121_cer", f"select conv_id, turn, case when length(a) = 0 then 0.0::double else levenshtein(a, b)::double / length(a) end as cer from ({PAIRS})", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    return pairs(conversations).select("conv_id", "turn", T.cer(F.col("a"), F.col("b")).alias("cer"))


#: Word edits of pairs, as common tables ending in x(conv_id, turn, edits): a row of the distance matrix at each step.
#: (DuckDB's levenshtein() counts bytes, and bytes don't suffice for a turn's words.)
WORD_EDITS = f"""with recursive w as materialized {WORD_PAIRS},
n as materialized (select conv_id, turn, len(wa) as na, len(wb) as nb from w),
s as materialized (select conv_id, turn, i, j from (select conv_id, turn, generate_subscripts(wa, 1) as i, unnest(wa) as word from w) join (select conv_id, turn, generate_subscripts(wb, 1) as j, unnest(wb) as word from w) using (conv_id, turn, word)),
m as (select conv_id, turn, 0::bigint as i, unnest(range(0, nb + 1)) as j, unnest(range(0, nb + 1)) as d from n
union all select conv_id, turn, i + 1, j, j + min(t - j) over (partition by conv_id, turn order by j)
from (select m.*, least(d + 1, lag(d) over (partition by m.conv_id, m.turn order by m.j) + case when s.j is null then 1 else 0 end) as t
from m join n on n.conv_id = m.conv_id and n.turn = m.turn and m.i < na left join s on s.conv_id = m.conv_id and s.turn = m.turn and s.i = m.i + 1 and s.j = m.j)),
x as (select conv_id, turn, d::int as edits from n join m using (conv_id, turn) where i = na and j = nb)"""


@query("r121_cer_wer", f"{WORD_EDITS} select conv_id, turn, case when length(a) = 0 then 0.0::double else levenshtein(a, b)::double / length(a) end as cer, case when len(wa) = 0 then 0.0::double else edits::double / len(wa) end as wer from w join x using (conv_id, turn)", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    return word_pairs(conversations).select("conv_id", "turn", T.cer(F.col("a"), F.col("b")).alias("cer"), T.wer(F.col("wa"), F.col("wb")).alias("wer"))


@query("r121_word_edits_any", f"{WORD_EDITS} select * from x", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    return word_pairs(conversations).select("conv_id", "turn", T.word_edits(F.col("wa"), F.col("wb")).alias("edits"))


@query("r122_corpus_error_rates", f"{WORD_EDITS} select role, sum(edits)::double / sum(len(wa)) as corpus_wer, sum(levenshtein(a, b))::double / sum(length(a)) as corpus_cer from w join x using (conv_id, turn) group by role", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    p = word_pairs(conversations)
    edits, chars = T.word_edits(F.col("wa"), F.col("wb")), F.levenshtein("a", "b")
    return p.groupBy("role").agg((F.sum(edits) / F.sum(F.size("wa"))).alias("corpus_wer"), (F.sum(chars) / F.sum(F.length("a"))).alias("corpus_cer"))


#: Whole documents against the next ones.
NEXT = f"(select doc_id, {NORM.format('d.text')} as a, {NORM.format('e.text')} as b from documents d join (select doc_id - 1 as doc_id, text from documents) e using (doc_id))"


def document_pairs(documents: DataFrame) -> DataFrame:
    """Normalised texts of documents and the next ones. What follows costs far more than its bytes tell: no partitions are coalesced."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = documents.select("doc_id", T.normalize(F.col("text")).alias("a")).repartition(parts, "doc_id")
    after = documents.select((F.col("doc_id") - 1).alias("doc_id"), T.normalize(F.col("text")).alias("b"))
    return d.join(after.repartition(parts, "doc_id"), "doc_id")


@query("r119_document_distance", f"select doc_id, levenshtein(a, b)::bigint as distance, round(case when greatest(length(a), length(b)) = 0 then 1.0::double else 1 - levenshtein(a, b)::double / greatest(length(a), length(b)) end, 9) as similarity, round(case when length(a) = 0 then 0.0::double else levenshtein(a, b)::double / length(a) end, 9) as cer from {NEXT}", "documents")
def _(documents: DataFrame) -> DataFrame:
    """Character edits between whole documents, with their similarity and error rate."""
    d = document_pairs(documents).withColumn("distance", edits.char_edits("a", "b"))
    longer = F.greatest(F.length("a"), F.length("b"))
    return d.select("doc_id", "distance", F.round(F.when(longer == 0, 1.0).otherwise(1 - F.col("distance") / longer), 9).alias("similarity"), F.round(edits.rate(F.col("distance"), F.length("a")), 9).alias("cer"))


@query("r122_document_error_rates", f"select lang, sum(levenshtein(a, b)) / sum(length(a)) as corpus_cer from {NEXT} join (select doc_id, lang from documents) using (doc_id) group by lang", "documents")
def _(documents: DataFrame) -> DataFrame:
    """Pooled character error rates of whole documents, by language."""
    d = document_pairs(documents).select("doc_id", edits.char_edits("a", "b").alias("n"), F.length("a").alias("size"))
    d = d.join(documents.select("doc_id", "lang"), "doc_id")
    return d.groupBy("lang").agg((F.sum("n") / F.sum("size")).alias("corpus_cer"))


@query("r121_document_wer", None, "documents")
def _(documents: DataFrame) -> DataFrame:
    """Word edits and word error rates of whole documents."""
    d = document_pairs(documents).select("doc_id", T.words(F.col("a")).alias("a"), T.words(F.col("b")).alias("b")).withColumn("edits", edits.item_edits("a", "b"))
    return d.select("doc_id", "edits", edits.rate(F.col("edits"), F.size("a")).alias("wer"))


PREFIX = "cast(coalesce((select min(i) - 1 from range(1, least(len({0}), len({1})) + 1) r(i) where {0}[i] <> {1}[i]), least(len({0}), len({1}))) as bigint)"
RATIO4 = "case when {1} > 0 then floor({0}::double / {1} * 10000 + 0.5) / 10000 else 0.0::double end"


@query("r123_prefix_overlap", f"select conv_id, turn, n, m, matched, {RATIO4.format('matched', 'n')} as ratio from (select conv_id, turn, cast(len(wa) as int) as n, cast(len(wb) as int) as m, {PREFIX.format('wa', 'wb')} as matched from {WORD_PAIRS})", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    p = word_pairs(conversations).select("conv_id", "turn", F.size("wa").alias("n"), F.size("wb").alias("m"), T.matched_prefix(F.col("wa"), F.col("wb")).alias("matched"))
    return p.withColumn("ratio", T.ratio4(F.col("matched"), F.col("n")))


#: A text's sentences against those of its upper-cased first half.
HALVES = f"(select doc_id, {SENTENCES.format('lower(text)')} as e, {SENTENCES.format('lower(substr(text, 1, cast(floor(length(text) / 2) as int)))')} as g from documents)"


@query("r124_sentence_alignment", f"select doc_id, expected, got, exact, {RATIO4.format('exact', 'expected')} as exact_ratio, matched, {RATIO4.format('matched', 'expected')} as matched_ratio from (select doc_id, cast(len(e) as int) as expected, cast(len(g) as int) as got, cast((select count(*) from range(1, least(len(e), len(g)) + 1) r(i) where e[i] = g[i]) as bigint) as exact, {PREFIX.format('e', 'g')} as matched from {HALVES})", "documents")
def _(documents: DataFrame) -> DataFrame:
    half = F.expr("substr(text, 1, cast(floor(length(text) / 2) as int))")
    d = documents.select("doc_id", T.sentences(F.lower("text")).alias("e"), T.sentences(F.lower(half)).alias("g"))
    n = F.least(F.size("e"), F.size("g"))
    same = F.filter(F.zip_with(F.slice("e", F.lit(1), n), F.slice("g", F.lit(1), n), lambda x, y: x == y), lambda s: s)
    d = d.select("doc_id", F.size("e").alias("expected"), F.size("g").alias("got"), F.size(same).cast("long").alias("exact"), T.matched_prefix(F.col("e"), F.col("g")).alias("matched"))
    return d.withColumns({"exact_ratio": T.ratio4(F.col("exact"), F.col("expected")), "matched_ratio": T.ratio4(F.col("matched"), F.col("expected"))})


@query("r125_sentences", f"select doc_id, cast(generate_subscripts(s, 1) - 1 as int) as pos, unnest(s) as sentence from (select doc_id, {SENTENCES.format('text')} as s from documents)", "documents")
def _(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


KEY = "regexp_replace(lower({0}), '\\s+', '', 'g')"


@query("r126_sentence_boundaries", f"""with s as (select conv_id, turn, i, sum(length({KEY.format('x')})) over (partition by conv_id, turn order by i) as upto from (select conv_id, turn, generate_subscripts(s, 1) as i, unnest(s) as x from (select conv_id, turn, {SENTENCES.format('text')} as s from conversations))),
w as (select conv_id, turn, i, sum(length({KEY.format('x')})) over (partition by conv_id, turn order by i) as upto from (select conv_id, turn, generate_subscripts(w, 1) as i, unnest(w) as x from (select conv_id, turn, {WORDS.format('text')} as w from conversations)))
select s.conv_id, s.turn, cast(s.i - 1 as int) as sentence, cast(min(w.i) as int) as boundary from s join w on s.conv_id = w.conv_id and s.turn = w.turn and w.upto >= s.upto group by all""", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    """How many words a turn has up to the end of each sentence, by lengths without white space."""
    size = F.length(F.regexp_replace(F.lower("x"), r"\s+", "")).alias("size")
    items = lambda parts: conversations.select("conv_id", "turn", F.posexplode(parts).alias("i", "x")).select("conv_id", "turn", "i", size)
    d = transcript.boundaries(items(T.sentences(F.col("text"))), items(T.words(F.col("text"))), ["conv_id", "turn"])
    return d.select("conv_id", "turn", F.col("sentence").cast("int").alias("sentence"), F.col("boundary").cast("int").alias("boundary"))


DECODED = r"trim(regexp_replace(regexp_replace(replace(array_to_string(list_filter(p, lambda x: x <> '<blank>' and not regexp_matches(x, '^<.*>$')), ''), '▁', ' '), '\s+([.,!?;:])', '\1', 'g'), '\s+', ' ', 'g'))"
PIECES = "regexp_extract_all(replace(text, ' ', '▁') || '<eou>', '▁?[^▁.,!?]+|[.,!?]')"


@query("r128_decode_pieces", f"select conv_id, turn, {DECODED} as decoded from (select conv_id, turn, {PIECES} as p from conversations)", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    pieces = F.expr("regexp_extract_all(concat(replace(text, ' ', '▁'), '<eou>'), '▁?[^▁.,!?]+|[.,!?]', 0)")
    return conversations.select("conv_id", "turn", T.decode_pieces(pieces).alias("decoded"))


@query("r129_join_fragments", f"select conv_id, trim(regexp_replace(string_agg(trim(text), ' ' order by turn) filter (where trim(text) <> ''), '\\s+', ' ', 'g')) as joined from conversations group by conv_id", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return conversations.groupBy("conv_id").agg(T.join_fragments(parts).alias("joined"))


@query("r130_words", f"select doc_id, cast(len({WORDS.format('text')}) as int) as n_words, ({WORDS.format('text')})[1] as first_word from documents", "documents")
def _(documents: DataFrame) -> DataFrame:
    w = T.words(F.col("text"))
    return documents.select("doc_id", F.size(w).alias("n_words"), F.get(w, F.lit(0)).alias("first_word"))


#: Shapes in which a data set gives the place of its audio, by page; U stands for the page's URL.
SHAPES = ['{"src": "U"}', '[{"path": "U"}, "x"]', "U", '{"other": 1}', '[[], [[{"src": null, "url": "U"}]], "x"]', '[0, null, "", {"src": ""}, ["U"]]', '{"src": {"url": ["", "U"]}, "path": "x"}', '[[[[[{"path": "U"}]]]]]', '"U"', '[{"src": [false]}, {}]']
FIELD = f"replace(case page_id % 10 {' '.join(f"when {i} then '{x}'" for i, x in enumerate(SHAPES))} end, 'U', url)"


@query("r131_audio_url", "select page_id, case when page_id % 10 not in (3, 9) then url end as audio_url from pages", "pages")
def _(pages: DataFrame) -> DataFrame:
    """The first URL in nested JSON; as many levels as the deepest value has."""
    field = F.expr(FIELD)
    return pages.select("page_id", nested.audio_url(field, nested.deepest(pages, field)).alias("audio_url"))


@query("r132_dotted_path", "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.a.b') as missing from events", "events")
def _(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.a.b").alias("missing"))


WRAPPED = "named_struct('row_idx', event_id, 'row', named_struct('transcription', case when event_id % 3 = 0 then '' else event_type end, 'text', props, 'sample_rate', case when event_id % 2 = 0 then '0' else '22050' end, 'speed', props))"


@query("r133_normalize_row", "select event_id as row_index, case when event_id % 3 = 0 then props else event_type end as reference, case when event_id % 2 = 0 then 16000.0::double else 22050.0::double end as sample_rate, cast(null as double) as speed from events", "events")
def _(events: DataFrame) -> DataFrame:
    """Rows wrapped as JSON: the first non-empty text, numbers by coercion, 16000 for a missing or zero rate."""
    row = F.from_json(F.expr(f"to_json({WRAPPED})"), "row_idx long, row struct<transcription: string, text: string, transcript: string, sample_rate: string, speed: string>")
    r = events.select(row.alias("w")).select("w.row_idx", "w.row.*")
    ref = F.coalesce(F.nullif("transcription", F.lit("")), F.nullif("text", F.lit("")), F.nullif("transcript", F.lit("")), F.lit(""))
    rate = F.coalesce(F.nullif(scalar.safe_number(F.col("sample_rate")), F.lit(0.0)), F.lit(16000.0))
    return r.select(F.col("row_idx").alias("row_index"), T.reference_text(ref).alias("reference"), rate.alias("sample_rate"), scalar.safe_number(F.col("speed")).alias("speed"))


@query("r138_option_tokens", "select event_id, '<|' || event_type || '|>' as language, case event_type when 'click' then 'asr' when 'view' then 'translation' end as task, case when event_id % 3 = 0 then '<|pnc|>' else '<|nopnc|>' end as pnc from events", "events")
def _(events: DataFrame) -> DataFrame:
    language = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.concat(F.lit(" <|"), F.col("event_type"), F.lit("|>")))
    task = F.when(F.col("event_type") == "click", " ASR ").when(F.col("event_type") == "view", "Translate").otherwise("other")
    flag = T.boolean_option(F.when(F.col("event_id") % 3 == 0, "YES").when(F.col("event_id") % 3 == 1, "false"), False)
    return events.select("event_id", T.language_token(language).alias("language"), T.task_option(task).alias("task"), T.toggle_token("pnc", flag).alias("pnc"))


@query("r139_prompt_ids", "select doc_id, list_transform(['<|startofcontext|>', '<|' || lang || '|>', '<|missing|>'], lambda t: case t when '<|startofcontext|>' then 7 when '<|de|>' then 10 when '<|en|>' then 11 when '<|es|>' then 12 when '<|fr|>' then 13 end)::varchar as ids from documents", "documents")
def _(documents: DataFrame) -> DataFrame:
    """Special tokens in prompt order, looked up in a vocabulary; null where it lacks one."""
    vocabulary = F.create_map(*[F.lit(x) for kv in {"<|startofcontext|>": 7, "<|de|>": 10, "<|en|>": 11, "<|es|>": 12, "<|fr|>": 13}.items() for x in kv])
    prompt = F.array(F.lit("<|startofcontext|>"), T.language_token(F.col("lang")), F.lit("<|missing|>"))
    ids = F.transform(prompt, lambda t: F.coalesce(F.element_at(vocabulary, t).cast("string"), F.lit("NULL")))
    return documents.select("doc_id", F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("ids"))


@query("r143_first_mismatch", f"select conv_id, turn, (select min(i) - 1 from range(1, greatest(len(wa), len(wb)) + 1) r(i) where coalesce(wa[i], '') <> coalesce(wb[i], '')) as first_mismatch from {WORD_PAIRS}", "conversations")
def _(conversations: DataFrame) -> DataFrame:
    """The first place where two lists of words differ, the end of the shorter one included; null if none."""
    matched = T.matched_prefix(F.col("wa"), F.col("wb"))
    return word_pairs(conversations).select("conv_id", "turn", F.when((matched < F.size("wa")) | (matched < F.size("wb")), matched).alias("first_mismatch"))


@query("r017_csv_lines", "select l_orderkey, l_linenumber, concat_ws(',', cast(l_orderkey as varchar), '\"' || l_returnflag || ',' || l_linestatus || '\"', '\"say \"\"' || l_linestatus || '\"\"\"', '') as line from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    d = lineitem.select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("id"), F.concat("l_returnflag", F.lit(","), "l_linestatus").alias("pair"), F.concat(F.lit('say "'), "l_linestatus", F.lit('"')).alias("quoted"), F.lit(None).cast("string").alias("none"))
    return stats.csv_lines(d, ["id", "pair", "quoted", "none"]).select("l_orderkey", "l_linenumber", "line")
