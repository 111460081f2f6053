"""Scans, sinks and round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.functions.text import md5_uniform
from assay.operators.ordinals import assign_ordinal, positional_shards
from assay.operators.preferences import append_preferences
from assay.plans import fixtures as fx
from assay.plans.registry import query
from assay.plans.tasks import load_task, task_names
from assay.session import scratch_path
from assay.sources.keyed_json import explode_keyed_json, read_indented_json, read_keyed_json, write_keyed_json
from assay.sources.results_log import read_results_log, write_results_log
from assay.sources.tables import (
    publish,
    read_delimited,
    read_split,
    write_delimited,
    write_json,
)


@query("keyed_json_scan", fx.with_(fx.PAGE_KEYS_SQL, "SELECT key, url, n FROM page_records"))
def keyed_json_scan(spark, sf_dir):
    path = scratch_path(spark, "keyed")
    write_keyed_json(fx.page_records(spark, sf_dir), "key", path)
    return read_keyed_json(spark, path, "struct<url:string,n:bigint>").select("key", "value.url", "value.n")


@query(
    "keyed_json_scalars",
    "SELECT event_id, 'k' AS key, (json_extract_string(props, '$.k'))::BIGINT AS value FROM events "
    "WHERE json_extract_string(props, '$.k') IS NOT NULL",
)
def keyed_json_scalars(spark, sf_dir):
    """Every event's properties, keyed by the event and the property."""
    events = fx.table(spark, sf_dir, "events").where(F.col("props").isNotNull())
    named = F.to_json(F.create_map(F.concat_ws(":", "event_id", F.lit("k")), F.get_json_object("props", "$.k").cast("bigint")))
    rows = explode_keyed_json(events.where(F.get_json_object("props", "$.k").isNotNull()).select(named.alias("doc")), "doc", "bigint")
    name = F.split("key", ":")
    return rows.select(name[0].cast("bigint").alias("event_id"), name[1].alias("key"), "value")


@query(
    "keyed_json_quarantine",
    """SELECT key, problem, count(*) AS n, sum(value)::BIGINT AS total FROM (
         SELECT 'n' AS key, NULL AS problem, n_chars AS value FROM documents WHERE doc_id % 7 <> 0
         UNION ALL SELECT 'l', 'not a bigint: ' || lang, NULL FROM documents WHERE doc_id % 7 <> 0
         UNION ALL SELECT NULL, 'not a JSON object', NULL FROM documents WHERE doc_id % 7 = 0) GROUP BY ALL""",
)
def keyed_json_quarantine(spark, sf_dir):
    """Objects with one value of another type each; every seventh is cut off."""
    docs = fx.table(spark, sf_dir, "documents")
    text = F.format_string('{"n": %d, "l": "%s"}', "n_chars", "lang")
    cut = F.when(F.col("doc_id") % 7 == 0, F.substring_index(text, ",", 1)).otherwise(text)
    rows = explode_keyed_json(docs.select(cut.alias("doc")), "doc", "bigint", mode="quarantine")
    return rows.groupBy("key", "problem").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("keyed_json_indented", fx.with_(fx.PAGE_KEYS_SQL, "SELECT key, url, n FROM page_records"))
def keyed_json_indented(spark, sf_dir):
    """Pages as indented objects, a file for every thousand pages, each read by as many tasks as it has ranges."""
    path = scratch_path(spark, "indented")
    pages = assign_ordinal(fx.page_records(spark, sf_dir), ["key"])
    shard, last = F.floor(F.col("ordinal") / 1000).cast("int"), F.lead("ordinal").over(Window.partitionBy("shard").orderBy("ordinal")).isNull()
    pages = pages.withColumn("shard", F.coalesce(shard, F.lit(0))).withColumns({"first": F.col("ordinal") % 1000 == 0, "last": last})
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)
    rows = F.array_compact(
        F.array(
            F.when(F.col("first"), F.lit("{")),
            F.concat(F.lit("  "), quoted("key"), F.lit(": {")),
            F.concat(F.lit('    "url": '), quoted("url"), F.lit(",")),
            F.concat(F.lit('    "n": '), F.col("n").cast("string")),
            F.when(F.col("last"), F.lit("  }")).otherwise(F.lit("  },")),
            F.when(F.col("last"), F.lit("}")),
        )
    )
    lines = pages.select("shard", "ordinal", F.posexplode(rows).alias("place", "value")).repartition("shard").sortWithinPartitions("shard", "ordinal", "place")
    lines.select("shard", "value").write.partitionBy("shard").text(path, lineSep="\n")
    return read_indented_json(spark, path, "struct<url:string,n:bigint>").select("key", "value.url", "value.n")


@query(
    "delimited_by_name",
    "SELECT doc_id, text, n_chars, lang FROM documents",
)
def delimited_by_name(spark, sf_dir):
    """Whole texts, line breaks and quotes included, through a delimited file whose columns stand in another order."""
    path = scratch_path(spark, "csv")
    docs = fx.table(spark, sf_dir, "documents")
    docs.select("lang", "text", "source", "n_chars", "doc_id").write.csv(path, header=True, escape='"', quoteAll=True, lineSep="\n")
    return read_delimited(spark, path, "doc_id long, text string, n_chars long, lang string", na_values=[], multi_line=True)


@query(
    "delimited_quarantine",
    """SELECT doc_id, n_chars, problem FROM (
         SELECT CASE WHEN doc_id % 5 IN (0, 4) THEN doc_id END AS doc_id, CASE WHEN doc_id % 5 IN (0, 4) THEN n_chars END AS n_chars,
                CASE doc_id % 5 WHEN 1 THEN 'not 3 fields but 4' WHEN 2 THEN 'not 3 fields but 2' WHEN 3 THEN 'n_chars is not bigint: ' || lang END AS problem
         FROM documents)""",
)
def delimited_quarantine(spark, sf_dir):
    """Lines with a field too many, one too few, and a value of another type."""
    path = scratch_path(spark, "tsv")
    kind, id_, n = F.col("doc_id") % 5, F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    line = (
        F.when(kind == 1, F.concat_ws("\t", "lang", id_, n, F.lit("x")))
        .when(kind == 2, F.concat_ws("\t", "lang", id_))
        .when(kind == 3, F.concat_ws("\t", "lang", id_, "lang"))
        .otherwise(F.concat_ws("\t", F.lit('"a\tb"'), id_, n))
    )
    fx.table(spark, sf_dir, "documents").select(line.alias("lang\tdoc_id\tn_chars")).write.csv(path, header=True, sep="\x01", quote="", lineSep="\n")
    rows = read_delimited(spark, path, "n_chars long, doc_id long", sep="\t", mode="quarantine")
    return rows.select("doc_id", "n_chars", "problem")


@query(
    "delimited_scan",
    fx.with_([fx.ITEMS_SQL], "SELECT doc_id, source, n_chars, quality, toxic, split FROM items"),
)
def delimited_scan(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    columns = ["doc_id", "source", "n_chars", "quality", "toxic", "split"]
    write_delimited(fx.items(spark, sf_dir).select(columns), path, sep="\t")
    schema = "doc_id long, source string, n_chars long, quality int, toxic int, split string"
    return read_delimited(spark, path, schema, sep="\t")


@query(
    "split_scan",
    fx.with_([fx.ITEMS_SQL], "SELECT doc_id, n_chars, split, lang AS language FROM items WHERE split = 'dev' AND lang = 'en'"),
)
def split_scan(spark, sf_dir):
    path = scratch_path(spark, "splits")
    published = fx.items(spark, sf_dir).select("doc_id", "n_chars", "split", F.col("lang").alias("language"))
    publish(published, path, "split", ("language",))
    return read_split(spark, path, "dev", "en").select("doc_id", "n_chars", "split", "language")


def _task_sql() -> str:
    """Every task's rows and distinct targets, written per task over the stand-in tables."""
    def bind(name, x, y, source):
        return f"SELECT '{name}' AS task, '{x}' AS x_label, '{y}' AS y_label, count(*) AS n, count(DISTINCT t) AS n_targets FROM ({source})"

    labelled = "SELECT quality AS t FROM items WHERE quality IS NOT NULL"
    both = [
        bind("Spoken_Dialect_QA", "kenya", "answers", "SELECT question AS t FROM qa"),
        bind("speech_fairness", "audio", "transcription", f"SELECT text AS t FROM items WHERE {fx.u_sql('doc_id')} < 0.2"),
        bind("non_social_HeySquad_QA", "audio", "answers", "SELECT question AS t FROM qa WHERE len(answers) > 0"),
        bind("non_social_SLURP_speaker_intent", "audio", "text_intent", "SELECT label AS t FROM embeddings"),
        bind("IEMOCAP_emotion_recognition", "audio", "emotion_label", "SELECT label % 4 AS t FROM embeddings"),
        bind("MELD_emotion_recognition", "audio", "emotion_label", "SELECT label % 7 AS t FROM embeddings"),
        bind("Mustard_sarcasm", "audio", "sarcasm", labelled + " AND split = 'train'"),
        bind("CommonVoice_speaker_identity", "audio", "sentence", "SELECT text AS t FROM items WHERE split = 'test' AND lang = 'en'"),
        bind("FLEURS_speaker_identity", "audio", "gender", labelled + " AND split = 'test' AND lang = 'en'"),
        bind("Callhome_relationships", "audio", "Speaker A - Primary", "SELECT toxic AS t FROM items WHERE toxic IS NOT NULL AND split = 'train'"),
        bind("URFunny_humor", "audio", "label", labelled + " AND split = 'train'"),
        bind("COVOST_translation", "audio", "translation", "SELECT ref AS t FROM translations WHERE pair = 'en_zh-CN'"),
    ]
    return fx.with_([fx.ITEMS_SQL, *fx.QA_SQL, *fx.TRANSLATIONS_SQL], "\nUNION ALL ".join(both))


@query("task_registry", _task_sql())
def task_registry(spark, sf_dir):
    from functools import reduce

    source = fx_tables(spark, sf_dir)
    language = {"Spoken_Dialect_QA": "kenya", "CommonVoice_speaker_identity": "en", "FLEURS_speaker_identity": "en",
                "COVOST_translation": "en_zh-CN"}
    counted = []
    for name in task_names():
        task = load_task(source, name, language.get(name))
        # Answer arrays are told apart by their question, long texts by their digest.
        target = F.col("question") if task.y == "answers" else F.col(f"`{task.y}`")
        counted.append(
            task.df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.md5(target.cast("string"))).alias("n_targets")).select(
                F.lit(task.name).alias("task"), F.lit(task.x).alias("x_label"), F.lit(task.y).alias("y_label"), "n", "n_targets"
            )
        )
    return reduce(lambda a, b: a.unionByName(b), counted)


def fx_tables(spark, sf_dir):
    """Resolver from evaluation-set name to its stand-in table, with the columns the real set has."""
    items = fx.items(spark, sf_dir)
    text = F.col("text")
    vectors = fx.table(spark, sf_dir, "embeddings")

    def resolve(name: str):
        if name == "Spoken_Dialect_QA":
            return fx.qa(spark, sf_dir).withColumns({"kenya": F.col("question"), "split": F.lit("dev")})
        if name == "non_social_HeySquad_QA":
            return fx.qa(spark, sf_dir).withColumns({"audio": F.col("question"), "split": F.lit("validation")})
        if name == "speech_fairness":
            return items.select("doc_id", F.col("source").alias("audio"), text.alias("transcription")).withColumn(
                "split", F.when(md5_uniform("doc_id") < 0.2, "test").otherwise("train")
            )
        if name == "non_social_SLURP_speaker_intent":
            return vectors.select(F.col("vec_id").alias("audio"), F.col("label").alias("intent"), F.lit("test").alias("split"))
        if name == "IEMOCAP_emotion_recognition":
            return vectors.select(F.col("vec_id").alias("audio"), (F.col("label") % 4).alias("label"), F.lit("session5").alias("split"))
        if name == "MELD_emotion_recognition":
            return vectors.select(F.col("vec_id").alias("audio"), (F.col("label") % 7).alias("label"), F.lit("test").alias("split"))
        if name == "COVOST_translation":
            return fx.translations(spark, sf_dir).select(
                "id", F.col("hyp").alias("audio"), F.col("ref").alias("translation"), F.col("pair").alias("language"),
                F.lit("validation").alias("split"),
            )
        target = {
            "Mustard_sarcasm": ("quality", "sarcasm"),
            "CommonVoice_speaker_identity": ("text", "sentence"),
            "FLEURS_speaker_identity": ("quality", "gender"),
            "Callhome_relationships": ("toxic", "Speaker A - Primary"),
            "URFunny_humor": ("quality", "label"),
        }[name]
        return items.select(
            F.col("source").alias("audio"), F.col(target[0]).alias(target[1]), F.col("lang").alias("language"), "split"
        )

    return resolve


@query(
    "results_log_scan",
    fx.with_(fx.LINES_SQL, "SELECT 'Mustard_sarcasm' AS dataset, 'e2e' AS m_type, model, dial, id::VARCHAR AS id, pred, score FROM lines"),
)
def results_log_scan(spark, sf_dir):
    """Log files of three models and four dials, named as the evaluation names them; the run columns come from the paths."""
    root = scratch_path(spark, "logs")
    lines = fx.lines(spark, sf_dir).persist()
    for model in ("m_len", "m_line", "m_the"):
        for dial in fx.PAIR_OF_LANG:
            one = lines.where((F.col("model") == model) & (F.col("dial") == dial)).select("line")
            one.write.text(f"{root}/Mustard_sarcasm_tmp_Results/e2e_{model}/{dial}_outs.txt", lineSep="\n")
    lines.unpersist()
    return read_results_log(spark, root, layout="flat")


@query(
    "results_log_write",
    fx.with_(
        fx.LINES_SQL,
        """SELECT 'sarcasm' AS dataset, m_type, model, dial, id::VARCHAR AS id, pred, score
           FROM lines, (VALUES ('e2e'), ('pipe')) AS t(m_type)""",
    ),
)
def results_log_write(spark, sf_dir):
    root = scratch_path(spark, "results")
    scored = fx.predictions(spark, sf_dir).withColumn("score", F.when(F.col("id") % 13 != 0, F.col("score")))
    runs = scored.withColumns({"dataset": F.lit("sarcasm"), "m_type": F.explode(F.array(F.lit("e2e"), F.lit("pipe")))})
    write_results_log(runs, root)
    return read_results_log(spark, root)


@query(
    "json_records_write",
    fx.with_(fx.PAGE_KEYS_SQL, "SELECT key, url, n FROM page_records WHERE key IN (SELECT key FROM allow)"),
)
def json_records_write(spark, sf_dir):
    from assay.operators.joins import keep_keys

    path = scratch_path(spark, "records")
    write_json(keep_keys(fx.page_records(spark, sf_dir), "key", fx.allow_list(spark, sf_dir)), path)
    return spark.read.schema("key string, url string, n long").json(path)


@query(
    "publish_splits",
    fx.with_([fx.ITEMS_SQL], "SELECT split, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM items GROUP BY split"),
)
def publish_splits(spark, sf_dir):
    path = scratch_path(spark, "published")
    publish(fx.items(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "publish_shards",
    """WITH u AS (SELECT length(text) AS chars, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, count(*) OVER () // 14 AS step
                  FROM conversations WHERE role = 'user')
       SELECT 'train.' || (i // step)::VARCHAR AS split, count(*) AS n, sum(chars)::BIGINT AS chars FROM u WHERE i < 14 * step GROUP BY ALL""",
)
def publish_shards(spark, sf_dir):
    """Fourteen numbered splits of the user turns."""
    asked = fx.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    shards = positional_shards(asked.select("conv_id", "turn", "text"), ["conv_id", "turn"], V.SHARD_COUNT)
    path = scratch_path(spark, "shards")
    publish(shards.withColumn("split", F.concat(F.lit("train."), F.col("shard").cast("string"))), path)
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query("preference_append", fx.with_(fx.VOTES_SQL, "SELECT session, event_id, audio_hash, best FROM votes"))
def preference_append(spark, sf_dir):
    path = scratch_path(spark, "votes")
    votes = fx.votes(spark, sf_dir).select("session", "event_id", "audio_hash", "best")
    for model in ("a", "b"):
        append_preferences(votes.where(F.col("best") == model), path)
    return spark.read.parquet(path)
