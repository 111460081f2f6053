"""Filters, projections and scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.functions.chat import (
    around_speech,
    audio_parts,
    build_chat,
    extract_response,
    render_prompt,
    task_prompt,
)
from assay.functions.text import (
    as_col,
    blind_order,
    decode_pred,
    encode_pred,
    fingerprint,
    join_context,
    media_path,
    model_short_name,
    parse_pair,
    progress_text,
    rewrite_path,
    route,
    slice_identifier,
    strip,
    tokenizer_route,
    unblind,
    verbalize,
)
from assay.operators import prepare as P
from assay.operators.joins import apply_label_map, label_map_frame, score_label, with_error_policy
from assay.plans import fixtures as fx
from assay.plans.registry import query


def strip_sql(text: str) -> str:
    """SQL spelling of whitespace stripping."""
    return f"regexp_replace(regexp_replace({text}, '^{V.SPACE_CLASS}+', ''), '{V.SPACE_CLASS}+$', '')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values_sql(rows) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else ("NULL" if v is None else str(v)) for v in r) + ")" for r in rows)


@query("drop_null_target", fx.with_([fx.ITEMS_SQL], "SELECT doc_id, quality, split FROM items WHERE quality IS NOT NULL"))
def drop_null_target(spark, sf_dir):
    return P.drop_null_target(fx.items(spark, sf_dir), "quality").select("doc_id", "quality", "split")


@query("extract_answer_text", fx.with_(fx.QA_SQL, "SELECT id, array_to_string(answers, '|') AS answers, len(answers)::INT AS n FROM qa"))
def extract_answer_text(spark, sf_dir):
    mapped = P.extract_field(fx.qa(spark, sf_dir), "answers", "text")
    return mapped.select("id", F.array_join("answers", "|").alias("answers"), F.size("answers").alias("n"))


@query("nonempty_refs", fx.with_(fx.QA_SQL, "SELECT id, question FROM qa WHERE len(answers) > 0"))
def nonempty_refs(spark, sf_dir):
    mapped = P.extract_field(fx.qa(spark, sf_dir), "answers", "text")
    return P.nonempty(mapped, "answers").select("id", "question")


@query("select_rename", fx.with_([fx.ITEMS_SQL], "SELECT source AS audio, doc_id, quality AS \"Speaker B - NOTES\" FROM items"))
def select_rename(spark, sf_dir):
    df = fx.items(spark, sf_dir).withColumnsRenamed({"source": "audio", "quality": "Speaker B - NOTES "})
    return P.select_rename(df, ["audio", "doc_id", "Speaker B - NOTES "], {"Speaker B - NOTES ": "Speaker B - NOTES"})


@query("project_columns", fx.with_([fx.ITEMS_SQL], "SELECT doc_id, lang, source, n_chars, quality, toxic, split FROM items"))
def project_columns(spark, sf_dir):
    return fx.items(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", "quality", "toxic", "split")


@query(
    "build_media_path",
    fx.with_([fx.ITEMS_SQL], "SELECT doc_id, 'audio/' || CASE WHEN quality IS NOT NULL THEN doc_id::VARCHAR END || '.wav' AS path FROM items"),
)
def build_media_path(spark, sf_dir):
    key = F.when(F.col("quality").isNotNull(), F.col("doc_id"))
    return fx.items(spark, sf_dir).select("doc_id", media_path("audio/", key, ".wav").alias("path"))


@query(
    "rewrite_path",
    "SELECT page_id, replace(replace(url, 'example', 'mp4'), 'mp4', 'wav') AS url FROM pages",
)
def rewrite_path_query(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", rewrite_path("url", [("example", "mp4"), ("mp4", "wav")]).alias("url"))


@query(
    "slice_identifier",
    """SELECT doc_id, CASE WHEN length(source || doc_id::VARCHAR) > 7
       THEN substr(source || doc_id::VARCHAR, 4, length(source || doc_id::VARCHAR) - 7) ELSE '' END AS identifier FROM documents""",
)
def slice_identifier_query(spark, sf_dir):
    name = F.concat("source", F.col("doc_id").cast("string"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", slice_identifier(name).alias("identifier"))


@query("join_context", "SELECT doc_id, replace(text, chr(10), '. ') AS context FROM documents")
def join_context_query(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", join_context(F.split("text", "\n")).alias("context"))


@query(
    "verbalize_label",
    fx.with_([fx.ITEMS_SQL], "SELECT doc_id, CASE WHEN quality IS NOT DISTINCT FROM 1 THEN 'humor' ELSE 'not_humor' END AS label FROM items"),
)
def verbalize_label(spark, sf_dir):
    return fx.items(spark, sf_dir).select("doc_id", verbalize("quality").alias("label"))


@query("nan_to_null", fx.with_(fx.GAPS_SQL, "SELECT event_id, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM gaps"))
def nan_to_null(spark, sf_dir):
    return P.nan_to_null(fx.gaps(spark, sf_dir))


@query(
    "normalize_keys",
    "SELECT page_id::VARCHAR AS key, url FROM pages UNION ALL SELECT '1_' || page_id::VARCHAR, url FROM pages",
)
def normalize_keys(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    plain = P.normalize_keys(pages.select(F.col("page_id").alias("key"), "url"), "key")
    return plain.unionByName(pages.select(F.concat(F.lit("1_"), F.col("page_id").cast("string")).alias("key"), "url"))


@query(
    "decode_labels",
    fx.with_(
        [
            f"intents(code, name) AS (VALUES {values_sql(enumerate(V.INTENTS))})",
            f"four(code, name) AS (VALUES {values_sql(enumerate(V.EMOTIONS_4))})",
            f"seven(code, name) AS (VALUES {values_sql(enumerate(V.EMOTIONS_7))})",
        ],
        """SELECT vec_id, i.name AS intent, f.name AS emotion_4, s.name AS emotion_7 FROM embeddings e
           JOIN intents i ON i.code = (e.vec_id * 7 + e.label) % 101
           JOIN four f ON f.code = e.label % 4 JOIN seven s ON s.code = e.label % 7""",
    ),
)
def decode_labels(spark, sf_dir):
    df = fx.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        ((F.col("vec_id") * 7 + F.col("label")) % 101).alias("a"),
        (F.col("label") % 4).alias("b"),
        (F.col("label") % 7).alias("c"),
    )
    for code, names, out in (("a", V.INTENTS, "intent"), ("b", V.EMOTIONS_4, "emotion_4"), ("c", V.EMOTIONS_7, "emotion_7")):
        df = P.decode_labels(df, code, names, out)
    return df.select("vec_id", "intent", "emotion_4", "emotion_7")


@query(
    "parse_language_pair",
    fx.with_(
        [*fx.TRANSLATIONS_SQL, f"names(code, name) AS (VALUES {values_sql(V.LANGUAGES.items())})"],
        """SELECT id, 'en' AS source_code, substr(pair, 4) AS target_code, regexp_extract(substr(pair, 4), '^[a-z]+') AS base_code,
                  s.name AS source_name, t.name AS target_name
           FROM translations LEFT JOIN names s ON s.code = 'en' LEFT JOIN names t ON t.code = substr(pair, 4)""",
    ),
)
def parse_language_pair(spark, sf_dir):
    return fx.translations(spark, sf_dir).select("id", parse_pair("pair").alias("p")).select("id", "p.*")


# Run types and model names that meet every routing rule, assigned to the pages in turn.
MODEL_NAMES = [
    ("e2e", "Org/Qwen2-Audio-7B-Instruct"), ("e2e", "Org/Qwen-Audio-Chat"), ("e2e", "salmonn_7b"), ("e2e", "blsp_lslm_7b"),
    ("e2e", "via"), ("e2e", "Org/ultravox-v0_2"), ("e2e", "via-ultravox"), ("e2e", "other"), ("pipe", "Org/Qwen1.5-7B-Chat"),
    ("pipe", "Org/Qwen-Chat"), ("pipe", "Org/Meta-Llama-3-8B-Instruct"),
]
RUNS_SQL = f"""run_names(i, m_type, model) AS (VALUES {values_sql((i, *r) for i, r in enumerate(MODEL_NAMES))})"""
RUN_OF_PAGE_SQL = f"page_runs AS (SELECT page_id, m_type, model FROM pages JOIN run_names ON i = page_id % {len(MODEL_NAMES)})"


def page_runs(spark, sf_dir):
    names = F.array(*[F.struct(F.lit(t).alias("m_type"), F.lit(m).alias("model")) for t, m in MODEL_NAMES])
    run = F.get(names, (F.col("page_id") % len(MODEL_NAMES)).cast("int"))
    return fx.table(spark, sf_dir, "pages").select("page_id", run.alias("r")).select("page_id", "r.m_type", "r.model")


@query(
    "model_short_name",
    fx.with_([RUNS_SQL, RUN_OF_PAGE_SQL], "SELECT page_id, regexp_replace(lower(model), '^.*/', '') AS short FROM page_runs"),
)
def model_short_name_query(spark, sf_dir):
    return page_runs(spark, sf_dir).select("page_id", model_short_name("model").alias("short"))


@query(
    "route_handler",
    fx.with_(
        [RUNS_SQL, RUN_OF_PAGE_SQL, "s AS (SELECT *, regexp_replace(lower(model), '^.*/', '') AS n FROM page_runs)"],
        """SELECT page_id,
           CASE WHEN m_type <> 'e2e' THEN CASE WHEN n LIKE '%qwen%' AND n NOT LIKE '%1.5%' THEN 'pipeline_qwen' ELSE 'pipeline' END
                WHEN n LIKE '%qwen2%' THEN 'qwen2' WHEN n LIKE '%qwen%' THEN 'qwen' WHEN n LIKE '%salmonn%' THEN 'salmonn'
                WHEN n LIKE '%blsp%' THEN 'blsp' WHEN n LIKE '%via%' THEN 'via' WHEN n LIKE '%ultravox%' THEN 'ultravox'
                ELSE 'pipeline' END AS classification,
           CASE WHEN m_type <> 'e2e' THEN CASE WHEN n LIKE '%qwen%' AND n NOT LIKE '%1.5%' THEN 'pipeline_qwen' ELSE 'pipeline' END
                WHEN n LIKE '%qwen2%' THEN 'qwen2' WHEN n LIKE '%qwen%' THEN 'qwen' WHEN n LIKE '%salmonn%' THEN 'salmonn'
                WHEN n LIKE '%blsp%' THEN 'blsp' WHEN n LIKE '%ultravox%' THEN 'ultravox' WHEN n LIKE '%via%' THEN 'via'
                ELSE 'pipeline' END AS generation,
           CASE WHEN n LIKE '%via%' OR n LIKE '%llama%' THEN 'llama' WHEN n LIKE '%salmonn%' THEN 'vicuna'
                WHEN n LIKE '%qwen%' THEN 'qwen' END AS tokenizer
           FROM s""",
    ),
)
def route_handler(spark, sf_dir):
    short = model_short_name("model")
    return page_runs(spark, sf_dir).select(
        "page_id",
        route("m_type", short, V.CLASSIFICATION_ROUTES).alias("classification"),
        route("m_type", short, V.GENERATION_ROUTES).alias("generation"),
        tokenizer_route("model").alias("tokenizer"),
    )


FAMILY_SQL = "CASE conv_id % 3 WHEN 0 THEN 'mistral-7b' WHEN 1 THEN 'llama-3' ELSE 'qwen-chat' END"


def families(df):
    third = F.col("conv_id") % 3
    return df.withColumn("family", F.when(third == 0, "mistral-7b").when(third == 1, "llama-3").otherwise("qwen-chat"))


@query(
    "build_chat",
    fx.with_(
        [f"asked AS (SELECT conv_id, turn, text, {FAMILY_SQL} AS family FROM conversations WHERE role = 'user')",
         f"""turns AS (
  SELECT conv_id, turn, 'answer' AS task, 0 AS pos, 'system' AS role, {q(V.QA_SYSTEM)} AS content FROM asked WHERE family <> 'mistral-7b'
  UNION ALL SELECT conv_id, turn, 'answer', 1, 'user', text FROM asked WHERE family <> 'mistral-7b'
  UNION ALL SELECT conv_id, turn, 'answer', 0, 'user', {q(V.QA_SYSTEM)} || chr(10) || chr(10) || text FROM asked WHERE family = 'mistral-7b'
  UNION ALL SELECT conv_id, turn, 'classify', 0, 'system', {q(V.ASSISTANT + ' ' + V.TASK_PROMPTS['Mustard_sarcasm'])} FROM asked WHERE family <> 'mistral-7b'
  UNION ALL SELECT conv_id, turn, 'classify', 1, 'user', text FROM asked WHERE family <> 'mistral-7b'
  UNION ALL SELECT conv_id, turn, 'classify', 2, 'assistant', '' FROM asked WHERE family <> 'mistral-7b'
  UNION ALL SELECT conv_id, turn, 'classify', 0, 'user', {q(V.QA_SYSTEM)} || chr(10) || chr(10) || text FROM asked WHERE family = 'mistral-7b'
  UNION ALL SELECT conv_id, turn, 'distill', 0, 'user', text FROM asked)"""],
        "SELECT conv_id, turn, task, pos::INT AS pos, role, content FROM turns",
    ),
)
def build_chat_query(spark, sf_dir):
    asked = families(fx.table(spark, sf_dir, "conversations").where(F.col("role") == "user"))
    folded = F.lit(V.QA_SYSTEM)
    chats = {
        "answer": build_chat(F.lit(V.QA_SYSTEM), "text", "family"),
        "classify": build_chat(
            F.concat(F.lit(V.ASSISTANT + " "), task_prompt(F.lit("Mustard_sarcasm"))), "text", "family", True, folded
        ),
        "distill": build_chat(None, "text", "family"),
    }
    tasks = F.array(*[F.struct(F.lit(t).alias("task"), chat.alias("chat")) for t, chat in chats.items()])
    listed = asked.select("conv_id", "turn", F.inline(tasks))
    return listed.select("conv_id", "turn", "task", F.posexplode("chat").alias("pos", "t")).select(
        "conv_id", "turn", "task", "pos", "t.role", "t.content"
    )


@query(
    "chat_audio_parts",
    """SELECT conv_id, turn, 0 AS pos, 'audio' AS type, NULL AS text, conv_id::VARCHAR || '.wav' AS audio_url FROM conversations
       UNION ALL SELECT conv_id, turn, 1, 'text', text, NULL FROM conversations""",
)
def chat_audio_parts(spark, sf_dir):
    parts = audio_parts(media_path("", "conv_id", ".wav"), "text")
    talk = fx.table(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", F.posexplode(parts).alias("pos", "p")).select("conv_id", "turn", "pos", "p.*")


TASK_OF_PAIR = list(V.TASK_PROMPTS)


@query(
    "render_prompt",
    fx.with_(
        [*fx.TRANSLATIONS_SQL, f"names(code, name) AS (VALUES {values_sql(V.LANGUAGES.items())})",
         f"tasks(i, task, ask, grade) AS (VALUES {values_sql((i, t, V.TASK_PROMPTS[t], V.METRIC_PROMPTS[t]) for i, t in enumerate(TASK_OF_PAIR))})"],
        """SELECT id, 'You are a helpful assistant. Translate the inputs from English to ' || name || '.' AS translate, task, ask, grade,
                  'USER: <Speech>' AS left_side, '</Speech> ' || ask || chr(10) || 'ASSISTANT:' AS right_side,
                  '###[Human]:' || ask AS human, '###[Human]:' || ask || chr(10) || chr(10) || chr(10) || '###[Assistant]:' AS reply,
                  hyp || ' Give a simple one sentence answer.' AS answer, 'Translate the input from English to ' || name || '.' AS asked,
                  pair IN ('en_zh-CN', 'en_id', 'en_ar', 'en_ta', 'en_ja') AS active, hyp || '. Translate the inputs from English to ' || name || '.' AS suffixed
           FROM translations JOIN names ON code = substr(pair, 4) JOIN tasks ON i = id % 5""",
    ),
)
def render_prompt_query(spark, sf_dir):
    names = F.array(*[F.lit(t) for t in TASK_OF_PAIR])
    task = F.get(names, (F.col("id") % 5).cast("int"))
    df = fx.translations(spark, sf_dir).select("id", "hyp", "pair", parse_pair("pair").alias("p"), task.alias("task"))
    df = df.withColumn("ask", task_prompt("task")).withColumn("around", around_speech(F.col("ask")))
    source, target = F.col("p.source_name"), F.col("p.target_name")
    return df.select(
        "id",
        render_prompt(V.TRANSLATE_SYSTEM, source, target).alias("translate"),
        "task",
        "ask",
        task_prompt("task", V.METRIC_PROMPTS).alias("grade"),
        F.col("around.left").alias("left_side"),
        F.col("around.right").alias("right_side"),
        render_prompt(V.HUMAN_WRAPPER, as_col("ask")).alias("human"),
        F.concat(render_prompt(V.HUMAN_WRAPPER, as_col("ask")), F.lit(V.REPLY_WRAPPER)).alias("reply"),
        F.concat("hyp", F.lit(V.QA_SUFFIX)).alias("answer"),
        render_prompt(V.TRANSLATE_USER, source, target).alias("asked"),
        F.col("pair").isin(V.TRANSLATION_PAIRS).alias("active"),
        F.concat(F.col("hyp"), render_prompt(V.TRANSLATE_SUFFIX, source, target)).alias("suffixed"),
    )


def _response_sql(family: str) -> str:
    marker, end = V.RESPONSE_MARKERS[family]
    tail = strip_sql(f"string_split(raw_{family}, {q(marker)})[-1]")
    return f"replace({tail}, {q(end)}, '') AS {family}" if end else f"{tail} AS {family}"


def _raw_sql(family: str) -> str:
    marker, end = V.RESPONSE_MARKERS[family]
    return f"question || {q(marker)} || question || {q(marker)} || chr(10) || '  ' || pred || chr(160) || {q(end)} || ' ' AS raw_{family}"


@query(
    "extract_response",
    fx.with_(
        [*fx.QA_SQL, f"raw AS (SELECT id, {', '.join(_raw_sql(f) for f in V.RESPONSE_MARKERS)} FROM qa)"],
        f"SELECT id, {', '.join(_response_sql(f) for f in V.RESPONSE_MARKERS)} FROM raw",
    ),
)
def extract_response_query(spark, sf_dir):
    def raw(family):
        marker, end = V.RESPONSE_MARKERS[family]
        return F.concat("question", F.lit(marker), "question", F.lit(marker), F.lit("\n  "), "pred", F.lit(" " + end + " "))

    return fx.qa(spark, sf_dir).select("id", *[extract_response(raw(f), f).alias(f) for f in V.RESPONSE_MARKERS])


@query(
    "encode_prediction",
    f"""SELECT doc_id, '\"\"\"' || replace(text, chr(10), '[NEW_LINE]') || '\"\"\"' AS encoded,
        {strip_sql("replace(replace(text, chr(10), '[NEW_LINE]'), '" + chr(34) * 3 + "', '')")} AS decoded FROM documents""",
)
def encode_prediction(spark, sf_dir):
    encoded = encode_pred("text")
    return fx.table(spark, sf_dir, "documents").select("doc_id", encoded.alias("encoded"), decode_pred(encoded).alias("decoded"))


@query(
    "score_exact_label",
    fx.with_(fx.PREDICTIONS_SQL, "SELECT model, dial, id, truth, pred, score::INT AS score FROM predictions"),
)
def score_exact_label(spark, sf_dir):
    labels = label_map_frame(spark, fx.YES_NO, "int")
    return score_label(fx.answers(spark, sf_dir), "pred", "truth", labels).select("model", "dial", "id", "truth", "pred", "score")


@query(
    "error_sentinel",
    fx.with_(
        fx.PREDICTIONS_SQL,
        """SELECT model, id, pred, score::DOUBLE AS score_zero,
                  CASE WHEN pred = 'ERROR IN PROCESSING' THEN NULL ELSE score::DOUBLE END AS score_null FROM predictions""",
    ),
)
def error_sentinel(spark, sf_dir):
    made = fx.predictions(spark, sf_dir).withColumn("error", F.when(F.col("pred") == V.ERROR_TEXT, F.lit("failed")))
    zero = with_error_policy(made.withColumn("score_zero", F.col("score")), "zero", score="score_zero")
    both = with_error_policy(zero.withColumn("score_null", F.col("score")), "null", score="score_null")
    return both.select("model", "id", "pred", "score_zero", "score_null")


@query(
    "blind_order",
    fx.with_(
        [*fx.VOTES_SQL,
         "ranked AS (SELECT event_id, m, row_number() OVER (PARTITION BY event_id ORDER BY md5('42:' || event_id::VARCHAR || ':' || m)) AS r "
         "FROM votes, (VALUES ('a'), ('b'), ('c')) AS t(m))"],
        """SELECT event_id, string_agg(m, ',' ORDER BY r) AS shown, max(m) FILTER (r = 1) AS chosen FROM ranked GROUP BY event_id""",
    ),
)
def blind_order_query(spark, sf_dir):
    order = blind_order("event_id", ["a", "b", "c"])
    df = fx.votes(spark, sf_dir).select("event_id", order.alias("shown_order"))
    return df.select(
        "event_id", F.array_join("shown_order", ",").alias("shown"), unblind("shown_order", F.lit(0)).alias("chosen")
    )


@query("content_fingerprint", "SELECT doc_id, substr(md5(text), 1, 8) AS hash FROM documents")
def content_fingerprint(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", fingerprint("text").alias("hash"))


@query(
    "progress_text",
    fx.with_(
        fx.VOTES_SQL,
        """SELECT session, count(*) AS n_votes, CASE WHEN count(*) >= 20 THEN '# Completed! Completion Code: PLACEHOLDER'
                  ELSE '# ' || count(*)::VARCHAR || '/20 Preferences Submitted' END AS progress FROM votes GROUP BY session""",
    ),
)
def progress_text_query(spark, sf_dir):
    counted = fx.votes(spark, sf_dir).groupBy("session").agg(F.count(F.lit(1)).alias("n_votes"))
    return counted.withColumn("progress", progress_text("n_votes", 20))


@query("strip_text", f"SELECT doc_id, {strip_sql('text')} AS text FROM documents")
def strip_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", strip("text").alias("text"))


@query(
    "label_map_join",
    fx.with_(fx.ANSWERS_SQL, "SELECT model, id, pred, CASE pred WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS value FROM answers"),
)
def label_map_join(spark, sf_dir):
    labels = label_map_frame(spark, fx.YES_NO, "int")
    return apply_label_map(fx.answers(spark, sf_dir), "pred", labels).select("model", "id", "pred", "value")
