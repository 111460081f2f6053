"""Tokenisers, BLEU, answer overlap and best-over-references."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.functions.textmetrics import (
    answer_tokens,
    best_over_references,
    f1_of_tokens,
    pair_bleu,
    sentence_bleu,
    token_f1,
    tokenize_13a,
    tokenize_zh,
)
from assay.operators import metrics as M
from assay.operators import prepare as P
from assay.operators.predict import BatchScorer
from assay.plans import fixtures as fx
from assay.plans.registry import query
from assay.session import spread


def _replace_all(text: str, rules) -> str:
    for pattern, replacement in rules:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


# The separation rules again, in RE2 spelling.
RULES_SQL = [
    (r"([!-+:-@\[-`{-~/ ])", r" \1 "),
    (r"([^0-9])([.,])", r"\1 \2 "),
    (r"([.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{V.SPACE_CLASS}+'), lambda t: t <> '')"


def tokens_13a_sql(text: str) -> str:
    out = f"regexp_replace({text}, '{V.SPACE_CLASS}+$', '')"
    for old, new in [("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "chr(34)"),
                     ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")]:
        out = f"replace({out}, {old}, {new})"
    return words_sql(_replace_all(f"' ' || {out} || ' '", RULES_SQL))


def tokens_zh_sql(text: str) -> str:
    stripped = f"regexp_replace(regexp_replace({text}, '^{V.SPACE_CLASS}+', ''), '{V.SPACE_CLASS}+$', '')"
    return words_sql(_replace_all(f"regexp_replace({stripped}, '({V.CJK_CLASS})', ' \\1 ', 'g')", RULES_SQL))


def bleu_ctes(source: str, tokens) -> list[str]:
    """BLEU of ``source(id, hyp, ref)`` by counting n-grams in rows."""
    return [
        f"tok AS (SELECT id, {tokens('hyp')} AS h, {tokens('ref')} AS r FROM {source})",
        "orders(n) AS (VALUES (1), (2), (3), (4))",
        """words AS (
  SELECT id, side, t, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3, lead(t, 3) OVER w AS t4
  FROM (SELECT id, 'h' AS side, unnest(h) AS t, unnest(range(len(h))) AS i FROM tok
        UNION ALL SELECT id, 'r', unnest(r), unnest(range(len(r))) FROM tok)
  WINDOW w AS (PARTITION BY id, side ORDER BY i))""",
        """grams AS (
  SELECT id, n, side, gram, count(*) AS c FROM (
    SELECT id, n, side, CASE n WHEN 1 THEN t WHEN 2 THEN t || ' ' || t2 WHEN 3 THEN t || ' ' || t2 || ' ' || t3
                                   ELSE t || ' ' || t2 || ' ' || t3 || ' ' || t4 END AS gram
    FROM words CROSS JOIN orders) WHERE gram IS NOT NULL GROUP BY id, n, side, gram)""",
        """clipped AS (
  SELECT a.id, a.n, sum(least(a.c, b.c)) AS c FROM grams a JOIN grams b USING (id, n, gram)
  WHERE a.side = 'h' AND b.side = 'r' GROUP BY a.id, a.n)""",
        """parts AS (
  SELECT id, n, coalesce(c, 0) AS c, greatest(len(h) - n + 1, 0) AS t, len(h) AS hl, len(r) AS rl,
         sum((coalesce(c, 0) = 0)::INT) OVER (PARTITION BY id ORDER BY n) AS zeros
  FROM tok CROSS JOIN orders LEFT JOIN clipped USING (id, n))""",
        """bleu AS (
  SELECT id, CASE WHEN sum(c) = 0 OR min(t) = 0 THEN 0 ELSE
           CASE WHEN min(hl) >= min(rl) THEN 1 ELSE exp(1 - min(rl) / min(hl)) END *
           exp(avg(ln(CASE WHEN t = 0 THEN 1 WHEN c = 0 THEN 100 / (pow(2, zeros) * t) ELSE 100.0::DOUBLE * c / t END))) END AS bleu
  FROM parts GROUP BY id)""",
    ]


@query("tokenize_13a", f"SELECT doc_id, array_to_string({tokens_13a_sql('text')}, ' ') AS tokens FROM documents")
def tokenize_13a_query(spark, sf_dir):
    return spread(fx.table(spark, sf_dir, "documents")).select("doc_id", F.array_join(tokenize_13a("text"), " ").alias("tokens"))


@query("tokenize_13a_markup", f"SELECT page_id, array_to_string({tokens_13a_sql('html')}, ' ') AS tokens FROM pages")
def tokenize_13a_markup(spark, sf_dir):
    return spread(fx.table(spark, sf_dir, "pages")).select("page_id", F.array_join(tokenize_13a("html"), " ").alias("tokens"))


@query("sentence_bleu", fx.with_([*fx.TRANSLATIONS_SQL, *bleu_ctes("translations", tokens_13a_sql)], "SELECT id, round(bleu, 6) AS bleu FROM bleu"))
def sentence_bleu_query(spark, sf_dir):
    return fx.translations(spark, sf_dir).select("id", F.round(sentence_bleu("hyp", "ref"), 6).alias("bleu"))


# Vowels become CJK characters, so that every text mixes both scripts.
CJK = ("aeiou", "你好世界我")


def _zh(column):
    return F.translate(column, *CJK)


@query("tokenize_zh", f"SELECT doc_id, array_to_string({tokens_zh_sql(f'translate(text, {chr(39)}{CJK[0]}{chr(39)}, {chr(39)}{CJK[1]}{chr(39)})')}, ' ') AS tokens FROM documents")
def tokenize_zh_query(spark, sf_dir):
    return spread(fx.table(spark, sf_dir, "documents")).select("doc_id", F.array_join(tokenize_zh(_zh("text")), " ").alias("tokens"))


@query(
    "sentence_bleu_zh",
    fx.with_(
        [*fx.TRANSLATIONS_SQL,
         f"zh AS (SELECT id, translate(hyp, '{CJK[0]}', '{CJK[1]}') AS hyp, translate(ref, '{CJK[0]}', '{CJK[1]}') AS ref FROM translations)",
         *bleu_ctes("zh", tokens_zh_sql)],
        "SELECT id, round(bleu, 6) AS bleu FROM bleu",
    ),
)
def sentence_bleu_zh(spark, sf_dir):
    return fx.translations(spark, sf_dir).select("id", F.round(sentence_bleu(_zh("hyp"), _zh("ref"), "zh"), 6).alias("bleu"))


def _pair_tokens_sql(text: str) -> str:
    return f"CASE WHEN pair LIKE '%!_zh%' ESCAPE '!' THEN {tokens_zh_sql(text)} ELSE {tokens_13a_sql(text)} END"


@query(
    "translation_scores",
    fx.with_(
        [*fx.TRANSLATIONS_SQL, *bleu_ctes("translations", _pair_tokens_sql)],
        "SELECT pair, round(avg(bleu), 6) AS mean_score, count(*) AS n_scored FROM bleu JOIN translations USING (id) GROUP BY pair",
    ),
)
def translation_scores(spark, sf_dir):
    """Mean BLEU per language pair, each with the tokeniser of its target language."""
    scored = fx.translations(spark, sf_dir).select("pair", pair_bleu("hyp", "ref", "pair").alias("score"))
    return M.mean_skip_na(scored, ["pair"]).withColumn("mean_score", F.round("mean_score", 6))


def answer_words_sql(text: str) -> str:
    return words_sql(f"regexp_replace(lower({text}), '[!-/:-@\\[-`{{-~]', '', 'g')")


# Token F1 of qa candidates against every reference, by counting tokens in rows.
ANSWER_F1_SQL = [
    *fx.QA_SQL,
    "refs AS (SELECT id, pred, unnest(answers) AS ref, unnest(range(len(answers))) AS k FROM qa)",
    f"ref_tok AS (SELECT id, k, {answer_words_sql('pred')} AS h, {answer_words_sql('ref')} AS r FROM refs)",
    """counts AS (SELECT id, k, tok, count(*) FILTER (side = 'h') AS a, count(*) FILTER (side = 'r') AS b
  FROM (SELECT id, k, 'h' AS side, unnest(h) AS tok FROM ref_tok UNION ALL SELECT id, k, 'r', unnest(r) FROM ref_tok) GROUP BY ALL)""",
    "hits AS (SELECT id, k, sum(least(a, b)) AS c FROM counts GROUP BY ALL)",
    """ref_f1 AS (SELECT id, k, CASE WHEN len(h) + len(r) = 0 THEN 1 ELSE 2.0::DOUBLE * coalesce(c, 0) / (len(h) + len(r)) END AS f1
  FROM ref_tok LEFT JOIN hits USING (id, k))""",
]


@query("answer_token_f1", fx.with_(ANSWER_F1_SQL, "SELECT id, k::INT AS k, round(f1, 6) AS f1 FROM ref_f1"))
def answer_token_f1(spark, sf_dir):
    pairs = fx.qa(spark, sf_dir).select("id", "pred", F.posexplode("answers.text").alias("k", "ref"))
    return pairs.select("id", "k", F.round(token_f1("pred", "ref"), 6).alias("f1"))


@query("max_over_references", fx.with_(ANSWER_F1_SQL, "SELECT id, round((SELECT max(f1) FROM ref_f1 r WHERE r.id = qa.id), 6) AS score FROM qa"))
def max_over_references(spark, sf_dir):
    return fx.qa(spark, sf_dir).select("id", F.round(best_over_references("answers.text", "pred"), 6).alias("score"))


@query(
    "answer_scores",
    fx.with_(ANSWER_F1_SQL, "SELECT round(avg(s), 6) AS mean_score, count(s) AS n_scored FROM (SELECT (SELECT max(f1) FROM ref_f1 r WHERE r.id = qa.id) AS s FROM qa)"),
)
def answer_scores(spark, sf_dir):
    scored = fx.qa(spark, sf_dir).select(best_over_references("answers.text", "pred").alias("score"))
    return M.mean_skip_na(scored).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "pluggable_scorer",
    fx.with_(
        [*fx.QA_SQL, "refs AS (SELECT id, pred, unnest(answers) AS ref FROM qa)"],
        """SELECT qa.id, round((SELECT max(least(length(pred), length(ref))::DOUBLE / nullif(greatest(length(pred), length(ref)), 0))
                  FROM refs r WHERE r.id = qa.id), 6) AS score FROM qa""",
    ),
)
def pluggable_scorer(spark, sf_dir):
    """Any Column function can be the scorer: here, how near two whole texts are in length."""
    def like_length(hyp, ref):
        longer = F.nullif(F.greatest(F.length(hyp), F.length(ref)), F.lit(0))
        return F.least(F.length(hyp), F.length(ref)) / longer

    return fx.qa(spark, sf_dir).select("id", F.round(best_over_references("answers.text", "pred", like_length), 6).alias("score"))


def _load_length_scorer():
    def scorer(triples):
        if any("q" in question for _, _, question in triples):
            raise ValueError("unscorable")
        return [len(prediction) / (len(prediction) + len(reference)) for reference, prediction, _ in triples]

    return scorer


@query(
    "pluggable_scorer_external",
    fx.with_(
        [*fx.QA_SQL, "refs AS (SELECT id, pred, unnest(answers) AS ref FROM qa WHERE NOT contains(question, 'q'))"],
        """SELECT id, round((SELECT max(length(pred)::DOUBLE / (length(pred) + length(ref))) FROM refs r WHERE r.id = qa.id), 6) AS score
           FROM qa""",
    ),
)
def pluggable_scorer_external(spark, sf_dir):
    """A Python scorer behind the batch contract; a row it fails on has no score."""
    pairs = P.extract_field(fx.qa(spark, sf_dir), "answers", "text")
    return BatchScorer(_load_length_scorer).apply(pairs).select("id", F.round("score", 6).alias("score"))


@query(
    "document_overlap",
    f"""WITH tok AS (SELECT d.doc_id, {answer_words_sql('d.text')} AS h, {answer_words_sql('b.text')} AS r
                     FROM documents d JOIN (SELECT item_id, text, count(*) OVER () AS n FROM benchmark) b ON b.item_id = d.doc_id % b.n),
        counts AS (SELECT doc_id, w, count(*) FILTER (side = 'h') AS a, count(*) FILTER (side = 'r') AS b
          FROM (SELECT doc_id, 'h' AS side, unnest(h) AS w FROM tok UNION ALL SELECT doc_id, 'r', unnest(r) FROM tok) GROUP BY ALL),
        hits AS (SELECT doc_id, sum(least(a, b)) AS c FROM counts GROUP BY ALL)
        SELECT doc_id, round(2.0::DOUBLE * coalesce(c, 0) / (len(h) + len(r)), 6) AS f1 FROM tok LEFT JOIN hits USING (doc_id)""",
)
def document_overlap(spark, sf_dir):
    """Token F1 of whole documents, however long, against a reference item each."""
    items = fx.table(spark, sf_dir, "benchmark")
    n = items.count()
    docs = spread(fx.table(spark, sf_dir, "documents")).select("doc_id", "text", (F.col("doc_id") % n).alias("item_id"))
    pairs = docs.join(items.select("item_id", F.col("text").alias("ref")), "item_id")
    f1 = f1_of_tokens(answer_tokens("text"), answer_tokens("ref"))
    return pairs.select("doc_id", F.round(f1, 6).alias("f1"))


LINES_F1_SQL = f"""WITH pairs AS (SELECT d.doc_id, b.text AS hyp, string_split(d.text, chr(10)) AS refs
    FROM documents d JOIN (SELECT item_id, text, count(*) OVER () AS n FROM benchmark) b ON b.item_id = d.doc_id % b.n),
  one AS (SELECT doc_id, hyp, unnest(refs) AS ref, unnest(range(len(refs))) AS k FROM pairs),
  tok AS (SELECT doc_id, k, {answer_words_sql('hyp')} AS h, {answer_words_sql('ref')} AS r FROM one),
  counts AS (SELECT doc_id, k, w, count(*) FILTER (side = 'h') AS a, count(*) FILTER (side = 'r') AS b
    FROM (SELECT doc_id, k, 'h' AS side, unnest(h) AS w FROM tok UNION ALL SELECT doc_id, k, 'r', unnest(r) FROM tok) GROUP BY ALL),
  hits AS (SELECT doc_id, k, sum(least(a, b)) AS c FROM counts GROUP BY ALL)
  SELECT doc_id, round(max(CASE WHEN len(h) + len(r) = 0 THEN 1 ELSE 2.0::DOUBLE * coalesce(c, 0) / (len(h) + len(r)) END), 6) AS score, count(*) AS n_references
  FROM tok LEFT JOIN hits USING (doc_id, k) GROUP BY doc_id"""


@query("max_over_many_references", LINES_F1_SQL)
def max_over_many_references(spark, sf_dir):
    """Each line of a document is a reference of one benchmark text: many references in a row, and no join for them."""
    items = fx.table(spark, sf_dir, "benchmark")
    n = items.count()
    docs = spread(fx.table(spark, sf_dir, "documents")).select("doc_id", F.split("text", "\n").alias("refs"), (F.col("doc_id") % n).alias("item_id"))
    pairs = docs.join(items.select("item_id", F.col("text").alias("hyp")), "item_id")
    return pairs.select("doc_id", F.round(best_over_references("refs", "hyp"), 6).alias("score"), F.size("refs").cast("bigint").alias("n_references"))
