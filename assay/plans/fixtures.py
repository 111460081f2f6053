"""Evaluation-shaped tables derived from the given tables, in Spark and in SQL.

Every ``*_SQL`` text is a list of common table expressions that builds the same rows for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.functions.text import md5_uniform
from assay.operators.joins import label_map_frame, score_label
from assay.operators.predict import CentroidPredictor
from assay.session import local_rows, spread
from assay.sources.results_log import format_line

YES_NO = {"Yes": 1, "No": 0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u_sql(key: str, seed: int = V.SPLIT_SEED) -> str:
    """SQL twin of ``md5_uniform``."""
    return f"(('0x'||substr(md5('{seed}:'||({key})::VARCHAR),1,8))::BIGINT/4294967296.0)"


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# Labelled items: documents with their labels (null where unlabelled) and a split.
ITEMS_SQL = f"""items AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
         CASE WHEN {u_sql('d.doc_id')} < 0.8 THEN 'train' WHEN {u_sql('d.doc_id')} < 0.9 THEN 'dev' ELSE 'test' END AS split
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    share = md5_uniform("doc_id")
    split = F.when(share < 0.8, "train").when(share < 0.9, "dev").otherwise("test")
    return docs.join(labels, "doc_id", "left").withColumn("split", split)


# Raw answers of three rule models on the labelled items; some rows failed.
ANSWERS_SQL = [
    ITEMS_SQL,
    """answers AS (
  SELECT m.model, lang AS dial, doc_id AS id, quality AS truth,
         CASE WHEN doc_id % 17 = 0 THEN 'ERROR IN PROCESSING' WHEN m.hit THEN 'Yes' ELSE 'No' END AS pred
  FROM items, LATERAL (VALUES
     ('m_len', n_chars >= 400),
     ('m_line', length(text) - length(replace(text, chr(10), '')) >= 2),
     ('m_the', (length(text) - length(replace(text, 'the', ''))) / 3 >= 2)) AS m(model, hit)
  WHERE quality IS NOT NULL)""",
]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")

    def count_of(word: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))

    rules = {"m_len": F.col("n_chars") >= 400, "m_line": count_of("\n") >= 2, "m_the": count_of("the") >= 2}
    failed = F.col("doc_id") % 17 == 0
    runs = F.array(
        *[
            F.struct(
                F.lit(name).alias("model"),
                F.when(failed, V.ERROR_TEXT).when(hit, "Yes").otherwise("No").alias("pred"),
            )
            for name, hit in rules.items()
        ]
    )
    labelled = items(spark, sf_dir).where(F.col("quality").isNotNull())
    return labelled.select(
        F.col("lang").alias("dial"), F.col("doc_id").alias("id"), F.col("quality").alias("truth"), F.inline(runs)
    ).select("model", "dial", "id", "truth", "pred")


# The same answers with their 0/1 score.
PREDICTIONS_SQL = [
    *ANSWERS_SQL,
    """predictions AS (
  SELECT model, dial, id, truth, pred,
         CASE WHEN (pred = 'Yes' AND truth = 1) OR (pred = 'No' AND truth = 0) THEN 1 ELSE 0 END AS score
  FROM answers)""",
]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_map_frame(spark, YES_NO, "int")
    return score_label(answers(spark, sf_dir), "pred", "truth", labels)


# Result log lines of those answers; some scores are missing.
LINES_SQL = [
    *PREDICTIONS_SQL,
    """lines AS (
  SELECT model, dial, id, pred, CASE WHEN id % 13 = 0 THEN NULL ELSE score::DOUBLE END AS score,
         id::VARCHAR || '[SEP_DIAL]' || '\"\"\"' || replace(pred, chr(10), '[NEW_LINE]') || '\"\"\"' || '[SEP_DIAL]' ||
         CASE WHEN id % 13 = 0 THEN 'NA' ELSE score::VARCHAR END AS line
  FROM predictions)""",
]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = predictions(spark, sf_dir).withColumn("score", F.when(F.col("id") % 13 != 0, F.col("score")))
    return scored.select("model", "dial", format_line("id", "pred", "score").alias("line"))


# Spoken questions: a user turn, the assistant's reply, and the neighbouring assistant turns as references.
QA_SQL = [
    """qa AS (
  SELECT q.conv_id::VARCHAR || ':' || q.turn::VARCHAR AS id, q.text AS question, p.text AS pred,
         list_filter([a.text, b.text], lambda x: x IS NOT NULL) AS answers
  FROM conversations q
  JOIN conversations p ON p.conv_id = q.conv_id AND p.turn = q.turn + 1 AND p.role = 'assistant'
  LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn - 1 AND a.role = 'assistant'
  LEFT JOIN conversations b ON b.conv_id = q.conv_id AND b.turn = q.turn + 3 AND b.role = 'assistant'
  WHERE q.role = 'user')"""
]


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    replies = talk.where(F.col("role") == "assistant")

    def reply(shift: int, name: str) -> DataFrame:
        return replies.select("conv_id", (F.col("turn") - shift).alias("turn"), F.col("text").alias(name))

    asked = talk.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    joined = (
        asked.join(reply(1, "pred"), ["conv_id", "turn"])
        .join(reply(-1, "before"), ["conv_id", "turn"], "left")
        .join(reply(3, "after"), ["conv_id", "turn"], "left")
    )
    texts = F.filter(F.array("before", "after"), lambda t: t.isNotNull())
    return joined.select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"),
        "question",
        "pred",
        F.transform(texts, lambda t: F.struct(t.alias("text"))).alias("answers"),
    )


# Translation pairs: the whole text as reference, every seventh word missing from the hypothesis.
PAIR_OF_LANG = {"en": "en_id", "fr": "en_zh-CN", "de": "en_de", "es": "en_sv-SE"}
TRANSLATIONS_SQL = [
    r"""translations AS (
  SELECT doc_id AS id, lang,
         CASE lang WHEN 'en' THEN 'en_id' WHEN 'fr' THEN 'en_zh-CN' WHEN 'de' THEN 'en_de' WHEN 'es' THEN 'en_sv-SE' END AS pair,
         array_to_string(list_filter(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> ''), lambda x, i: i % 7 <> 0), ' ') AS hyp,
         text AS ref
  FROM documents)"""
]


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: (i + 1) % 7 != 0)
    pair = None
    for lang, code in PAIR_OF_LANG.items():
        pair = F.when(F.col("lang") == lang, code) if pair is None else pair.when(F.col("lang") == lang, code)
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("id"), "lang", pair.alias("pair"), F.array_join(kept, " ").alias("hyp"), F.col("text").alias("ref")
    )


# Blind votes: clicks choose model a, purchases model b.
VOTES_SQL = [
    """votes AS (
  SELECT user_id AS session, ts, event_id, substr(md5(user_id::VARCHAR || ':' || event_id::VARCHAR), 1, 8) AS audio_hash,
         CASE event_type WHEN 'click' THEN 'a' ELSE 'b' END AS best
  FROM events WHERE event_type IN ('click', 'purchase'))"""
]


def votes_of(events: DataFrame) -> DataFrame:
    chosen = events.where(F.col("event_type").isin("click", "purchase"))
    name = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_id").cast("string"))
    return chosen.select(
        F.col("user_id").alias("session"),
        "ts",
        "event_id",
        F.substring(F.md5(name), 1, 8).alias("audio_hash"),
        F.when(F.col("event_type") == "click", "a").otherwise("b").alias("best"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes_of(table(spark, sf_dir, "events"))


# Guided-session events: three event types stand for the three steps.
KIND_OF_EVENT = {"view": "page_load", "click": "recording_complete", "purchase": "responses_complete"}
SESSION_EVENTS_SQL = [
    """session_events AS (
  SELECT user_id AS session, event_id AS pos,
         CASE event_type WHEN 'view' THEN 'page_load' WHEN 'click' THEN 'recording_complete'
              WHEN 'purchase' THEN 'responses_complete' ELSE event_type END AS kind
  FROM events)"""
]


def session_events_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    out = None
    for name, step in KIND_OF_EVENT.items():
        out = F.when(kind == name, step) if out is None else out.when(kind == name, step)
    return events.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("pos"), out.otherwise(kind).alias("kind")
    )


# Class centroids on 80 % of the vectors, dot-product scores of the others.
SCORES_SQL = [
    f"""held AS (SELECT vec_id, label AS truth, embedding FROM embeddings WHERE {u_sql('vec_id')} < 0.2)""",
    f"""centroid_cells AS (
  SELECT label, pos, avg(value::DOUBLE) AS value
  FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS value
        FROM embeddings WHERE {u_sql('vec_id')} >= 0.2) GROUP BY label, pos)""",
    """centroids AS (SELECT label, list(value ORDER BY pos) AS vector FROM centroid_cells GROUP BY label)""",
    """label_scores AS (
  SELECT vec_id, truth, label, list_sum(list_transform(list_zip(embedding, vector), lambda p: p[1]::DOUBLE * p[2])) AS score
  FROM held CROSS JOIN centroids)""",
]


def vector_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fit rows and held-out rows of the vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    share = md5_uniform("vec_id")
    return vectors.where(share >= V.TEST_SHARE), vectors.where(share < V.TEST_SHARE)


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id``, ``truth`` and ``scores`` (label and dot product in label order) of held-out vectors."""
    fit, held = vector_parts(spark, sf_dir)
    model = CentroidPredictor.fit(fit, "label")
    return model.scores(held).select("vec_id", F.col("label").alias("truth"), "scores")


# Keyed JSON: one object per page; the allow list is half the keys and two that do not exist.
PAGE_KEYS_SQL = [
    """page_records AS (SELECT 'p' || page_id::VARCHAR AS key, url, length(html)::BIGINT AS n FROM pages)""",
    f"""allow AS (
  SELECT 'p' || page_id::VARCHAR AS key FROM pages WHERE {u_sql("'p' || page_id::VARCHAR")} < 0.5
  UNION ALL VALUES ('absent_1'), ('absent_2'))""",
]


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select(key.alias("key"), "url", F.length("html").cast("bigint").alias("n"))


def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = page_records(spark, sf_dir).where(md5_uniform("key") < 0.5).select("key")
    absent = local_rows(spark, [("absent_1",), ("absent_2",)], "key string")
    return present.unionByName(absent)


# One utterance in eleven dialect columns; about a tenth of the cells is empty.
def _cell_sql(dial: str) -> str:
    return f"CASE WHEN {u_sql(f'doc_id::VARCHAR || chr(58) || {chr(39)}{dial}{chr(39)}')} >= 0.1 THEN md5('{dial}:' || text) END AS {dial}"


WIDE_SQL = [f"wide AS (SELECT doc_id, lang, {', '.join(_cell_sql(d) for d in V.DIALECTS)} FROM documents)"]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    def cell(dial: str) -> Column:
        name = F.concat(F.col("doc_id").cast("string"), F.lit(f":{dial}"))
        return F.when(md5_uniform(name) >= 0.1, F.md5(F.concat(F.lit(f"{dial}:"), F.col("text")))).alias(dial)

    return table(spark, sf_dir, "documents").select("doc_id", "lang", *[cell(d) for d in V.DIALECTS])


# Measurements with NaN and null.
GAPS_SQL = [
    """gaps AS (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE ELSE value END AS value
  FROM events)"""
]


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 10 == 0, F.lit(float("nan")))
    return table(spark, sf_dir, "events").select("event_id", value.otherwise(F.col("value")).alias("value"))
