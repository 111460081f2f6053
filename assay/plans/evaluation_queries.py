"""Joins, metrics, ordinals, sampling and prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.functions.text import media_path
from assay.operators import joins as J
from assay.operators import metrics as M
from assay.operators import prepare as P
from assay.operators.ordinals import assign_ordinal, positional_shards
from assay.operators.predict import (
    BatchPredictor,
    CentroidPredictor,
    argmax_label,
    argmax_rows,
    best_of_blocks,
    draw_from_blocks,
    predict,
    sample_label,
    softmax_blocks,
    softmax_scores,
)
from assay.operators.preferences import preference_counter, preference_tally
from assay.plans import fixtures as fx
from assay.plans.registry import query
from assay.session import local_rows, scratch_path
from assay.sources.results_log import format_line, parse_lines, read_results_log, write_results_log


def rounded(name: str, out: str | None = None):
    return F.round(name, 6).alias(out or name)


# ---- joins ---------------------------------------------------------------------------------------------------


@query("allowlist_semi_join", fx.with_(fx.PAGE_KEYS_SQL, "SELECT key, url, n FROM page_records WHERE key IN (SELECT key FROM allow)"))
def allowlist_semi_join(spark, sf_dir):
    return J.keep_keys(fx.page_records(spark, sf_dir), "key", fx.allow_list(spark, sf_dir))


LAUGHTER_LIST = ", ".join(f"'{k}'" for k in V.LAUGHTER_KEYS)


@query(
    "laughter_allowlist",
    f"""WITH keyed AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN [{LAUGHTER_LIST}][page_id % {len(V.LAUGHTER_KEYS)} + 1]
            ELSE '1_' || page_id::VARCHAR END AS key FROM pages)
        SELECT page_id, key, url FROM keyed WHERE key IN ({LAUGHTER_LIST})""",
)
def laughter_allowlist(spark, sf_dir):
    """Every third page has a key of the list, the others keys of the same form."""
    keys = F.array(*[F.lit(str(k)) for k in V.LAUGHTER_KEYS])
    listed = F.get(keys, (F.col("page_id") % len(V.LAUGHTER_KEYS)).cast("int"))
    key = F.when(F.col("page_id") % 3 == 0, listed).otherwise(F.concat(F.lit("1_"), F.col("page_id").cast("string")))
    keyed = fx.table(spark, sf_dir, "pages").select("page_id", key.alias("key"), "url")
    return J.keep_keys(keyed, "key", local_rows(spark, [(str(k),) for k in V.LAUGHTER_KEYS], "key string")).select("page_id", "key", "url")


def _clips(spark, sf_dir):
    """Documents whose clip name may or may not be among the listed (labelled) files."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", media_path("", "doc_id", ".mp3").alias("clip"))
    name = media_path("", "doc_id", ".mp3")
    listing = fx.table(spark, sf_dir, "labels").select(name.alias("name"), F.concat(F.lit("audio/"), name).alias("path"))
    return J.attach_existing(docs, "clip", listing)


@query(
    "existence_left_join",
    """SELECT d.doc_id, d.doc_id::VARCHAR || '.mp3' AS clip,
              CASE WHEN l.doc_id IS NOT NULL THEN 'audio/' || d.doc_id::VARCHAR || '.mp3' END AS path
       FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""",
)
def existence_left_join(spark, sf_dir):
    return _clips(spark, sf_dir)


@query("match_rate", "SELECT (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS n_found, count(*) AS n_rows FROM documents")
def match_rate(spark, sf_dir):
    return J.match_rate(_clips(spark, sf_dir))


@query(
    "required_lookup_join",
    fx.with_(
        [fx.ITEMS_SQL],
        """SELECT split, doc_id AS file_id, CASE WHEN quality = 1 THEN 'humor' ELSE 'not_humor' END AS label,
                  string_split(text, chr(10))[-1] AS punchline, replace(text, chr(10), '. ') AS context
           FROM items WHERE quality IS NOT NULL""",
    ),
)
def required_lookup_join(spark, sf_dir):
    from assay.functions.text import join_context, verbalize

    folds = P.drop_null_target(fx.items(spark, sf_dir), "quality").select("split", F.col("doc_id").alias("file_id"))
    labels = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), "quality")
    parts = F.split("text", "\n")
    texts = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.element_at(parts, -1).alias("punchline"), join_context(parts).alias("context")
    )
    found = J.assemble_folds(folds, labels, texts)
    return found.select("split", "file_id", verbalize("quality").alias("label"), "punchline", "context")


@query(
    "positional_align_join",
    fx.with_(
        fx.PREDICTIONS_SQL,
        """SELECT model, dial, row_number() OVER (PARTITION BY model, dial ORDER BY id) - 1 AS ordinal, id, truth, pred,
                  score::DOUBLE AS score FROM predictions""",
    ),
)
def positional_align_join(spark, sf_dir):
    """Each run's log is written in example order and paired with the examples by the place of its lines in their files."""
    run = ["model", "dial"]
    scored = assign_ordinal(fx.predictions(spark, sf_dir), ["id"], by=run)
    log = logged(spark, scored.withColumns({"dataset": F.lit("yes_no"), "place": F.col("ordinal")}))
    pairs = J.align(log.select(*run, "stored", "ordinal", "pred", "score"), scored.select(*run, "ordinal", "id", "truth"), run)
    return pairs.select(*run, "ordinal", "id", "truth", "pred", "score")


def logged(spark, scored):
    """Rows with dataset, model, dial, ordinal, place, pred, score as logs in the order of ``place``, read back: the index in
    the line as ``stored``, the place of the line in its run as ``ordinal``."""
    root = scratch_path(spark, "logs")
    rows = scored.select("dataset", F.lit("e2e").alias("m_type"), "model", "dial", F.col("ordinal").alias("id"), "pred", "score", "place")
    write_results_log(rows, root, order="place")
    return read_results_log(spark, root, places=True).withColumns({"stored": F.col("id").cast("bigint"), "ordinal": F.col("place")}).drop("id", "place")


@query(
    "positional_align_file",
    fx.with_(
        [*fx.PREDICTIONS_SQL,
         "numbered AS (SELECT model, dial, row_number() OVER (PARTITION BY model, dial ORDER BY id) - 1 AS o, count(*) OVER (PARTITION BY model, dial) AS n, id, pred FROM predictions)",
         """logs AS (
            SELECT 'right' AS dataset, model, dial, o AS stored, o AS place, pred FROM numbered
            UNION ALL SELECT 'swapped', model, dial, o, CASE WHEN o % 10 = 4 AND o + 1 < n THEN o + 1 WHEN o % 10 = 5 THEN o - 1 ELSE o END, pred FROM numbered
            UNION ALL SELECT 'short', model, dial, o, row_number() OVER (PARTITION BY model, dial ORDER BY o) - 1, pred FROM numbered WHERE o % 50 <> 20)"""],
        """SELECT v.dataset, e.model, e.dial, e.o AS ordinal, e.id, l.pred, coalesce(l.stored = e.o, false) AS aligned
           FROM numbered e CROSS JOIN (VALUES ('right'), ('swapped'), ('short')) AS v(dataset)
           LEFT JOIN logs l ON l.dataset = v.dataset AND l.model = e.model AND l.dial = e.dial AND l.place = e.o""",
    ),
)
def positional_align_file(spark, sf_dir):
    """A right log, one with neighbouring lines swapped and one that misses lines, each held against the examples by place."""
    run = ["dataset", "model", "dial"]
    scored = assign_ordinal(fx.predictions(spark, sf_dir), ["id"], by=["model", "dial"])
    sizes = scored.groupBy("model", "dial").agg(F.count(F.lit(1)).alias("n"))
    o = F.col("ordinal")
    swapped = F.when((o % 10 == 4) & (o + 1 < F.col("n")), o + 1).when(o % 10 == 5, o - 1).otherwise(o)
    kinds = F.array(*[F.struct(F.lit(name).alias("dataset"), place.alias("place")) for name, place in (("right", o), ("swapped", swapped), ("short", o))])
    every = scored.join(sizes, ["model", "dial"]).select("*", F.inline(kinds))
    log = logged(spark, every.where((F.col("dataset") != "short") | (o % 50 != 20)))
    pairs = J.align(log.select(*run, "stored", "ordinal", "pred"), every.select(*run, "ordinal", "id"), run, strict=False)
    return pairs.select(*run, "ordinal", "id", "pred", "aligned")


@query(
    "positional_align_gaps",
    fx.with_(
        [*fx.PREDICTIONS_SQL,
         "numbered AS (SELECT model, dial, row_number() OVER (PARTITION BY model, dial ORDER BY id) - 1 AS ordinal, id, pred FROM predictions)",
         """kept AS (SELECT model, dial, ordinal AS stored, pred, row_number() OVER (PARTITION BY model, dial ORDER BY ordinal) - 1 AS ordinal
            FROM numbered WHERE ordinal % 11 <> 3)"""],
        """SELECT n.model, n.dial, n.ordinal, n.id, k.pred, coalesce(k.stored = n.ordinal, false) AS aligned
           FROM numbered n LEFT JOIN kept k ON k.model = n.model AND k.dial = n.dial AND k.ordinal = n.ordinal""",
    ),
)
def positional_align_gaps(spark, sf_dir):
    """A log that misses every eleventh line: from the first gap on, lines no longer belong to the example beside them."""
    run = ["model", "dial"]
    scored = assign_ordinal(fx.predictions(spark, sf_dir), ["id"], by=run)
    log = scored.where(F.col("ordinal") % 11 != 3).select(*run, format_line("ordinal", "pred", "score").alias("line"))
    log = parse_lines(log, "line").withColumn("stored", F.col("id").cast("bigint")).drop("id")
    log = assign_ordinal(log, ["stored"], by=run)
    pairs = J.align(log, scored.select(*run, "ordinal", "id"), run, strict=False)
    return pairs.select(*run, "ordinal", "id", "pred", "aligned")


@query(
    "run_matrix_cross",
    """SELECT r.dataset, r.m_type, r.model, d.lang AS dial, d.doc_id AS id
       FROM (SELECT *, CASE WHEN n_chars >= 400 THEN 'long' ELSE 'short' END AS dataset FROM documents) d
       JOIN (VALUES ('long', 'e2e', 'm_len'), ('long', 'pipe', 'm_line'), ('short', 'e2e', 'm_the')) AS r(dataset, m_type, model)
         ON r.dataset = d.dataset""",
)
def run_matrix_cross(spark, sf_dir):
    runs = local_rows(
        spark, [("long", "e2e", "m_len"), ("long", "pipe", "m_line"), ("short", "e2e", "m_the")],
        "dataset string, m_type string, model string",
    )
    examples = fx.table(spark, sf_dir, "documents").select(
        F.when(F.col("n_chars") >= 400, "long").otherwise("short").alias("dataset"),
        F.col("lang").alias("dial"), F.col("doc_id").alias("id"),
    )
    dials = examples.select("dataset", "dial").distinct()
    return J.run_matrix(runs, dials, examples).select("dataset", "m_type", "model", "dial", "id")


@query(
    "unpivot_dialects",
    fx.with_(fx.WIDE_SQL, " UNION ALL ".join(f"SELECT doc_id, lang, '{d}' AS dial, {d} AS x FROM wide" for d in V.DIALECTS)),
)
def unpivot_dialects(spark, sf_dir):
    return J.unpivot_dialects(fx.wide(spark, sf_dir), ["doc_id", "lang"], V.DIALECTS)


@query("pending_work", fx.with_(fx.ANSWERS_SQL, "SELECT model, id FROM answers WHERE pred = 'ERROR IN PROCESSING'"))
def pending_work(spark, sf_dir):
    answers = fx.answers(spark, sf_dir).withColumn("key", F.concat_ws(":", "model", F.col("id").cast("string")))
    return J.pending(answers, answers, key="key").select("model", "id")


# ---- metrics -------------------------------------------------------------------------------------------------


@query("accuracy", fx.with_(fx.PREDICTIONS_SQL, "SELECT model, dial, round(avg(score), 6) AS accuracy, count(*) AS n FROM predictions GROUP BY ALL"))
def accuracy(spark, sf_dir):
    return M.accuracy(fx.predictions(spark, sf_dir), ["model", "dial"]).withColumn("accuracy", F.round("accuracy", 6))


def _log(spark, sf_dir):
    return parse_lines(fx.lines(spark, sf_dir), "line")


@query("mean_skip_na", fx.with_(fx.LINES_SQL, "SELECT model, dial, round(avg(score), 6) AS mean_score, count(score) AS n_scored FROM lines GROUP BY ALL"))
def mean_skip_na(spark, sf_dir):
    return M.mean_skip_na(_log(spark, sf_dir), ["model", "dial"]).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "mean_na_as_zero",
    fx.with_(fx.LINES_SQL, "SELECT model, dial, round(sum(coalesce(score, 0)) / count(*), 6) AS mean_score, count(*) AS n_lines FROM lines GROUP BY ALL"),
)
def mean_na_as_zero(spark, sf_dir):
    return M.mean_na_as_zero(_log(spark, sf_dir), ["model", "dial"]).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "score_table",
    fx.with_(fx.PREDICTIONS_SQL, "SELECT model, " + ", ".join(f"round(avg(score) FILTER (dial = '{d}'), 6) AS {d}" for d in ("en", "fr", "de", "es")) + " FROM predictions GROUP BY model"),
)
def score_table(spark, sf_dir):
    dials = ["en", "fr", "de", "es"]
    return M.score_table(fx.predictions(spark, sf_dir), dials).select("model", *[rounded(d) for d in dials])


@query("confusion_counts", fx.with_(fx.ANSWERS_SQL, "SELECT model, truth, pred, count(*) AS n FROM answers GROUP BY ALL"))
def confusion_counts(spark, sf_dir):
    return M.confusion(fx.answers(spark, sf_dir), ["model"])


@query(
    "f1_binary",
    fx.with_(
        [*fx.ANSWERS_SQL,
         """counts AS (SELECT model, dial, sum((truth = 1 AND pred = 'Yes')::INT)::BIGINT AS tp, sum((truth = 0 AND pred = 'Yes')::INT)::BIGINT AS fp,
            sum((truth = 1 AND pred <> 'Yes')::INT)::BIGINT AS fn, sum((pred NOT IN ('Yes', 'No'))::INT)::BIGINT AS n_error FROM answers GROUP BY ALL)"""],
        "SELECT *, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM counts",
    ),
)
def f1_binary(spark, sf_dir):
    mapped = J.apply_label_map(fx.answers(spark, sf_dir), "pred", J.label_map_frame(spark, fx.YES_NO, "int"))
    return M.f1_binary(mapped, 1, ["model", "dial"], pred="value").withColumn("f1", F.round("f1", 6))


# Predicted label of the held-out vectors by dot product, with failed rows.
CALLED_SQL = [
    *fx.SCORES_SQL,
    """called AS (
  SELECT vec_id, truth::VARCHAR AS truth, CASE WHEN vec_id % 19 = 0 THEN 'neutral' ELSE best::VARCHAR END AS pred
  FROM (SELECT vec_id, truth, arg_max(label, score) AS best FROM label_scores GROUP BY vec_id, truth))""",
]
WEIGHTED_SQL = """
  classes AS (SELECT truth AS cls FROM {t} UNION SELECT pred FROM {t}),
  per_class AS (SELECT cls, (SELECT count(*) FROM {t} WHERE truth = cls) AS support, (SELECT count(*) FROM {t} WHERE pred = cls) AS said,
                       (SELECT count(*) FROM {t} WHERE truth = cls AND pred = cls) AS tp FROM classes)"""


@query(
    "f1_weighted",
    fx.with_(
        [*CALLED_SQL, WEIGHTED_SQL.format(t="called")],
        """SELECT round(sum(support * 2.0::DOUBLE * tp / (support + said)) / sum(support), 6) AS f1_weighted,
                  sum(support)::BIGINT AS n, count(*) AS n_classes FROM per_class""",
    ),
)
def f1_weighted(spark, sf_dir):
    best = argmax_label(F.col("scores")).cast("string")
    called = fx.label_scores(spark, sf_dir).select(
        "truth", F.when(F.col("vec_id") % 19 == 0, V.ERROR_TEXT).otherwise(best).alias("pred")
    )
    return M.f1_weighted(called).select(rounded("f1_weighted"), "n", "n_classes")


@query(
    "label_uniqueness",
    """WITH names AS (SELECT DISTINCT role AS task, text AS label FROM conversations)
       SELECT task, count(*) AS n_labels, sum((contains(label, ' '))::INT)::BIGINT AS n_multi_word,
              count(DISTINCT string_split(label, ' ')[1]) AS n_distinct, count(*) = count(DISTINCT string_split(label, ' ')[1]) AS is_unique
       FROM names GROUP BY task""",
)
def label_uniqueness(spark, sf_dir):
    talk = fx.table(spark, sf_dir, "conversations")
    names = talk.select(F.col("role").alias("task"), F.col("text").alias("label")).distinct()
    return P.check_labels(names)


@query("preference_tally", fx.with_(fx.VOTES_SQL, "SELECT best, count(*) AS votes, round(count(*) / (SELECT count(*) FROM votes), 6) AS share FROM votes GROUP BY best"))
def preference_tally_query(spark, sf_dir):
    return preference_tally(fx.votes(spark, sf_dir)).withColumn("share", F.round("share", 6))


# ---- ordering, windows, sampling -----------------------------------------------------------------------------


@query("sort_by_key", fx.with_(fx.PAGE_KEYS_SQL, "SELECT key, url, row_number() OVER (ORDER BY key) - 1 AS position FROM page_records"))
def sort_by_key(spark, sf_dir):
    records = fx.page_records(spark, sf_dir).select("key", "url")
    return assign_ordinal(records, ["key"], name="position").orderBy("key")


@query("assign_ordinal", fx.with_([fx.ITEMS_SQL], "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS ordinal FROM items"))
def assign_ordinal_query(spark, sf_dir):
    return assign_ordinal(fx.table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"])


@query(
    "assign_ordinal_in_groups",
    "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS ordinal FROM events",
)
def assign_ordinal_in_groups(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    # Many ranges, so that each of the few groups spans several of them.
    return assign_ordinal(events, ["ts", "event_id"], by=["event_type"], ranges=40).drop("ts")


@query(
    "positional_shards",
    """WITH u AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ordinal, count(*) OVER () // 14 AS step
                  FROM conversations WHERE role = 'user')
       SELECT conv_id, turn, ordinal, ordinal // step AS shard FROM u WHERE ordinal < 14 * step""",
)
def positional_shards_query(spark, sf_dir):
    asked = fx.table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn")
    return positional_shards(asked, ["conv_id", "turn"], V.SHARD_COUNT)


ALLOWED = [1, 3, 4, 6, 8]


@query(
    "argmax_label",
    fx.with_(
        fx.SCORES_SQL,
        f"""SELECT vec_id, arg_max(label, score) AS best, arg_max(label, score) FILTER (label IN {tuple(ALLOWED)}) AS best_allowed
            FROM label_scores GROUP BY vec_id""",
    ),
)
def argmax_label_query(spark, sf_dir):
    scores = F.col("scores")
    return fx.label_scores(spark, sf_dir).select(
        "vec_id", argmax_label(scores).alias("best"), argmax_label(scores, ALLOWED).alias("best_allowed")
    )


@query(
    "argmax_label_rows",
    fx.with_(fx.SCORES_SQL, f"SELECT vec_id, arg_max(label, score) AS pred FROM label_scores WHERE label IN {tuple(ALLOWED)} GROUP BY vec_id"),
)
def argmax_label_rows(spark, sf_dir):
    long = fx.label_scores(spark, sf_dir).select("vec_id", F.posexplode("scores").alias("ord", "e")).select("vec_id", "ord", "e.*")
    return argmax_rows(long, "vec_id", local_rows(spark, [(v,) for v in ALLOWED], "label int"))


SOFTMAX_SQL = [
    *fx.SCORES_SQL,
    "raised AS (SELECT vec_id, label, exp((score - max(score) OVER (PARTITION BY vec_id)) / 0.1) AS e FROM label_scores)",
    "probs AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM raised)",
]


@query("softmax_temperature", fx.with_(SOFTMAX_SQL, "SELECT vec_id, label, round(prob, 6) AS prob FROM probs"))
def softmax_temperature(spark, sf_dir):
    probs = fx.label_scores(spark, sf_dir).select("vec_id", F.inline(softmax_scores(F.col("scores"), 0.1)))
    return probs.withColumn("prob", F.round("prob", 6))


@query(
    "categorical_sample",
    fx.with_(
        [*SOFTMAX_SQL, "running AS (SELECT vec_id, label, sum(prob) OVER (PARTITION BY vec_id ORDER BY label) AS mass FROM probs)"],
        f"SELECT vec_id, min(label) FILTER (mass >= {fx.u_sql('vec_id', 7)}) AS label FROM running GROUP BY vec_id",
    ),
)
def categorical_sample(spark, sf_dir):
    probs = softmax_scores(F.col("scores"), 0.1)
    return fx.label_scores(spark, sf_dir).select("vec_id", sample_label(probs, "vec_id", 7).alias("label"))


LABEL_BLOCK = 3 * 64 * 8  # three labels, so that the queries have several blocks


def label_blocks(spark, sf_dir):
    """Held-out vectors' scores in blocks of labels, and the labels by code."""
    fit, held = fx.vector_parts(spark, sf_dir)
    model = CentroidPredictor.fit(fit, "label")
    return model.score_blocks(held, "vec_id", LABEL_BLOCK), model.centroids.select("code", "label")


@query("argmax_label_blocks", fx.with_(fx.SCORES_SQL, "SELECT vec_id, arg_max(label, score) AS best FROM label_scores GROUP BY vec_id"))
def argmax_label_blocks(spark, sf_dir):
    blocks, labels = label_blocks(spark, sf_dir)
    return best_of_blocks(blocks, "vec_id").join(labels, "code").select("vec_id", F.col("label").alias("best"))


@query("softmax_label_blocks", fx.with_(SOFTMAX_SQL, "SELECT vec_id, label, round(prob, 6) AS prob FROM probs"))
def softmax_label_blocks(spark, sf_dir):
    blocks, labels = label_blocks(spark, sf_dir)
    probs = softmax_blocks(blocks, "vec_id", 0.1).select("vec_id", "first", F.posexplode("probs").alias("at", "prob"))
    rows = probs.withColumn("code", F.col("first") + F.col("at")).join(labels, "code")
    return rows.select("vec_id", "label", F.round("prob", 6).alias("prob"))


@query(
    "categorical_sample_blocks",
    fx.with_(
        [*SOFTMAX_SQL, "running AS (SELECT vec_id, label, sum(prob) OVER (PARTITION BY vec_id ORDER BY label) AS mass FROM probs)"],
        f"SELECT vec_id, min(label) FILTER (mass >= {fx.u_sql('vec_id', 7)}) AS label FROM running GROUP BY vec_id",
    ),
)
def categorical_sample_blocks(spark, sf_dir):
    blocks, labels = label_blocks(spark, sf_dir)
    return draw_from_blocks(blocks, "vec_id", 0.1, 7).join(labels, "code").select("vec_id", "label")


@query("hash_split", f"SELECT doc_id, CASE WHEN {fx.u_sql('doc_id')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return P.hash_split(fx.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    "sample_n",
    "SELECT vec_id, label, row_number() OVER (ORDER BY md5('42:' || vec_id::VARCHAR), vec_id) - 1 AS draw FROM embeddings QUALIFY draw < 64",
)
def sample_n(spark, sf_dir):
    return P.sample_n(fx.table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 64)


@query(
    "sample_n_with_replacement",
    """WITH n AS (SELECT count(*) AS rows FROM benchmark),
       draws AS (SELECT unnest(range(0, 2 * rows)) AS draw, rows FROM n),
       picks AS (SELECT draw, ('0x' || substr(md5('42:draw:' || draw::VARCHAR), 1, 8))::BIGINT % rows AS pick FROM draws),
       numbered AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pick FROM benchmark)
       SELECT item_id, draw FROM picks JOIN numbered USING (pick)""",
)
def sample_n_with_replacement(spark, sf_dir):
    items = fx.table(spark, sf_dir, "benchmark").select("item_id")
    return P.sample_n(items, "item_id", 2 * items.count())


@query(
    "preference_counter",
    fx.with_(
        [*fx.VOTES_SQL, "c AS (SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS n_votes FROM votes)"],
        """SELECT session, event_id, n_votes, n_votes >= 10 AS completed,
                  CASE WHEN n_votes >= 10 THEN '# Completed! Completion Code: PLACEHOLDER'
                       ELSE '# ' || n_votes::VARCHAR || '/10 Preferences Submitted' END AS progress FROM c""",
    ),
)
def preference_counter_query(spark, sf_dir):
    counted = preference_counter(fx.votes(spark, sf_dir))
    return counted.select("session", "event_id", "n_votes", "completed", "progress")


# ---- prediction ----------------------------------------------------------------------------------------------

NEAREST_SQL = [
    *fx.SCORES_SQL[:3],
    """unit AS (SELECT vec_id, truth, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS z FROM held)""",
    """nearest AS (
  SELECT vec_id, truth, arg_min(label, list_inner_product(vector, vector) - 2 * list_inner_product(z, vector)) AS label
  FROM unit CROSS JOIN centroids GROUP BY vec_id, truth)""",
]


@query("batch_predict", fx.with_(NEAREST_SQL, "SELECT vec_id, label::VARCHAR AS pred, NULL::VARCHAR AS error FROM nearest"))
def batch_predict(spark, sf_dir):
    fit, held = fx.vector_parts(spark, sf_dir)
    return predict(held, CentroidPredictor.fit(fit, "label")).select("vec_id", "pred", "error")


def _load_rule():
    def model(rows):
        if any(row["doc_id"] % 17 == 0 for row in rows):
            raise ValueError("broken clip")
        return ["Yes" if len(row["text"]) >= 400 else "No" for row in rows]

    return model


@query(
    "batch_predict_external",
    """SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'ERROR IN PROCESSING' WHEN n_chars >= 400 THEN 'Yes' ELSE 'No' END AS pred,
              CASE WHEN doc_id % 17 = 0 THEN 'ValueError: broken clip' END AS error FROM documents""",
)
def batch_predict_external(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return predict(docs, BatchPredictor(_load_rule, ["doc_id", "text"])).select("doc_id", "pred", "error")


@query(
    "heldout_evaluation",
    fx.with_(
        [*NEAREST_SQL, fx.SCORES_SQL[3],
         """runs AS (
  SELECT 'dot_product' AS run, vec_id, truth::VARCHAR AS truth, arg_max(label, score)::VARCHAR AS pred FROM label_scores GROUP BY vec_id, truth
  UNION ALL SELECT 'nearest_centroid', vec_id, truth::VARCHAR, label::VARCHAR FROM nearest)""",
         """classes AS (SELECT run, truth AS cls FROM runs UNION SELECT run, pred FROM runs)""",
         """per_class AS (
  SELECT c.run, c.cls, count(*) FILTER (r.truth = c.cls) AS support, count(*) FILTER (r.pred = c.cls) AS said,
         count(*) FILTER (r.truth = c.cls AND r.pred = c.cls) AS tp
  FROM classes c JOIN runs r ON r.run = c.run GROUP BY ALL)"""],
        """SELECT run, round(sum(tp) / sum(support), 6) AS accuracy,
                  round(sum(support * 2.0::DOUBLE * tp / (support + said)) / sum(support), 6) AS f1_weighted, sum(support)::BIGINT AS n
           FROM per_class GROUP BY run""",
    ),
)
def heldout_evaluation(spark, sf_dir):
    fit, held = fx.vector_parts(spark, sf_dir)
    model = CentroidPredictor.fit(fit, "label")
    both = predict(model.scores(held), model)
    runs = F.array(
        F.struct(F.lit("dot_product").alias("run"), argmax_label(F.col("scores")).cast("string").alias("called")),
        F.struct(F.lit("nearest_centroid").alias("run"), F.col("pred").alias("called")),
    )
    called = both.select(F.col("label").cast("string").alias("truth"), F.inline(runs))
    # One table of confusion counts gives both figures.
    return M.f1_weighted(called, ["run"], pred="called").select("run", rounded("accuracy"), rounded("f1_weighted"), "n")
