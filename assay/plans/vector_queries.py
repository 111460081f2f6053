"""Array functions and codebook jobs over the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import arrays as A
from assay.functions import fixed_values as V
from assay.operators import vectors as O
from assay.plans import fixtures as fx
from assay.plans.registry import query


def vectors(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings")


def cells(df, arr, ids=("vec_id",)):
    """Array entries as rows with a rounded value."""
    return df.select(*ids, F.posexplode(arr).alias("pos", "v")).select(*ids, "pos", F.round("v", 6).alias("value"))


# Long form of the vectors in SQL: 0-based position and double value.
LONG_SQL = """long AS (SELECT vec_id, label, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"""


def rounded(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


@query("peak_normalize", fx.with_([LONG_SQL], f"SELECT vec_id, pos, {rounded('x / max(abs(x)) OVER (PARTITION BY vec_id)')} AS value FROM long"))
def peak_normalize(spark, sf_dir):
    return cells(vectors(spark, sf_dir), A.peak_normalize("embedding"))


UNIT_SQL = [LONG_SQL, "unit AS (SELECT vec_id, label, pos, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12) AS x FROM long)"]


@query("l2_normalize", fx.with_(UNIT_SQL, f"SELECT vec_id, pos, {rounded('x')} AS value FROM unit"))
def l2_normalize(spark, sf_dir):
    return cells(vectors(spark, sf_dir), A.l2_normalize("embedding"))


@query("clip_length", fx.with_([LONG_SQL], f"SELECT vec_id, pos, {rounded('x')} AS value FROM long WHERE pos < 30"))
def clip_length(spark, sf_dir):
    """Thirty seconds at one sample per second."""
    return cells(vectors(spark, sf_dir), A.clip_length(A.doubles("embedding"), 1))


@query("first_channel", fx.with_([LONG_SQL], f"SELECT vec_id, pos, {rounded('x')} AS value FROM long"))
def first_channel(spark, sf_dir):
    stereo = F.zip_with(A.doubles("embedding"), F.reverse(A.doubles("embedding")), lambda a, b: F.array(a, b))
    return cells(vectors(spark, sf_dir), A.first_channel(stereo))


@query(
    "frame_windows",
    fx.with_(
        [LONG_SQL, "sizes AS (SELECT vec_id, label, 6 + label AS kernel FROM embeddings)",
         """frames AS (SELECT s.vec_id, f.frame, s.kernel, 4 * f.frame AS at FROM sizes s, LATERAL (SELECT unnest(range((64 - s.kernel) // 4 + 1)) AS frame) f)"""],
        f"""SELECT f.vec_id, f.frame::INT AS frame, count(*)::INT AS n, {rounded('sum(x)')} AS total, {rounded('arg_min(x, pos)')} AS first
            FROM frames f JOIN long l ON l.vec_id = f.vec_id AND l.pos >= f.at AND l.pos < f.at + f.kernel GROUP BY ALL""",
    ),
)
def frame_windows(spark, sf_dir):
    """Kernel of 6..15 entries by label, stride 4."""
    framed = vectors(spark, sf_dir).select(
        "vec_id", F.posexplode(A.frames(A.doubles("embedding"), 6 + F.col("label"), 4)).alias("frame", "w")
    )
    return framed.select(
        "vec_id", "frame", F.size("w").alias("n"), F.round(A.total(F.col("w")), 6).alias("total"),
        F.round(F.get("w", F.lit(0)), 6).alias("first"),
    )


@query(
    "frame_sizes",
    """SELECT doc_id, round_even(n_chars * 0.333333 / 30, 0)::INT AS kernel, round_even(n_chars * 0.125 / 30, 0)::INT AS stride FROM documents""",
)
def frame_sizes(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", A.frame_size(F.col("n_chars"), 0.333333).alias("kernel"), A.frame_size(F.col("n_chars"), 0.125).alias("stride")
    )


@query("standardize", fx.with_([LONG_SQL], f"SELECT vec_id, pos, {rounded(f'(x - {V.FBANK_MEAN}) / (2 * {V.FBANK_STD})')} AS value FROM long"))
def standardize(spark, sf_dir):
    return cells(vectors(spark, sf_dir), A.standardize("embedding"))


@query(
    "standardize_fitted",
    fx.with_(
        [LONG_SQL, "fit AS (SELECT label, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY label)"],
        f"SELECT vec_id, pos, {rounded('(x - m) / (2 * s)')} AS value FROM long JOIN fit USING (label)",
    ),
)
def standardize_fitted(spark, sf_dir):
    return cells(O.standardize_by_group(vectors(spark, sf_dir), "embedding", ["label"]), "standardized")


@query(
    "pad_to_length",
    fx.with_([LONG_SQL], f"SELECT vec_id, pos, {rounded('x')} AS value FROM long UNION ALL SELECT vec_id, unnest(range(64, 64 + label * 2))::INT, 0.0 FROM embeddings"),
)
def pad_to_length(spark, sf_dir):
    return cells(vectors(spark, sf_dir), A.pad_to("embedding", 64 + F.col("label") * 2))


@query(
    "concat_features",
    fx.with_(
        [LONG_SQL],
        f"""SELECT vec_id, pos // 8 AS frame, pos % 8 AS pos, {rounded('x')} AS value FROM long
            UNION ALL SELECT vec_id, pos // 8, 8 + pos % 8, {rounded('x * x')} FROM long""",
    ),
)
def concat_features(spark, sf_dir):
    """Two streams of frames joined per vector and frame."""
    def stream(arr, name):
        framed = vectors(spark, sf_dir).select("vec_id", F.posexplode(A.frames(arr, 8, 8)).alias("frame", name))
        return framed

    x = A.doubles("embedding")
    both = stream(x, "a").join(stream(F.transform(x, lambda v: v * v), "b"), ["vec_id", "frame"])
    return cells(both, A.concat_features("a", "b"), ("vec_id", "frame"))


# Sixteen sampled vectors as a codebook, in SQL.
BOOK_SQL = [
    """book AS (SELECT row_number() OVER (ORDER BY md5('42:' || vec_id::VARCHAR), vec_id) - 1 AS code, embedding::DOUBLE[] AS vector
  FROM embeddings QUALIFY code < 16)"""
]
COSINE_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12))"
NEAREST_SQL = [
    *BOOK_SQL,
    f"z AS (SELECT vec_id, {COSINE_UNIT} AS z FROM embeddings)",
    """dists AS (SELECT vec_id, code, z, vector, list_inner_product(z, z) + list_inner_product(vector, vector) - 2 * list_inner_product(z, vector) AS d
  FROM z CROSS JOIN book)""",
    "assigned AS (SELECT vec_id, arg_min(code, d) AS code, min(d) AS dist, arg_min(vector, d) AS vector, arg_min(z, d) AS z FROM dists GROUP BY vec_id)",
]


def codebook(spark, sf_dir, k=16):
    return O.initial_means(vectors(spark, sf_dir), "vec_id", "embedding", k)


CODED_SQL = f"""SELECT vec_id, code::INT AS code, {rounded('dist')} AS dist, unnest(range(len(vector)))::INT AS pos, round(unnest(vector), 6) + 0.0 AS value
  FROM assigned"""


@query(
    "nearest_codeword",
    fx.with_(NEAREST_SQL, CODED_SQL),
)
def nearest_codeword(spark, sf_dir):
    coded = O.assign_codes(vectors(spark, sf_dir), codebook(spark, sf_dir), with_codeword=True)
    return cells(coded.withColumn("dist", F.round("dist", 6)), "codeword", ("vec_id", "code", "dist"))


@query("nearest_codeword_blocks", fx.with_(NEAREST_SQL, CODED_SQL))
def nearest_codeword_blocks(spark, sf_dir):
    """The same with five codes in a block, so that the best of several blocks is kept."""
    coded = O.assign_codes(vectors(spark, sf_dir), codebook(spark, sf_dir), with_codeword=True, block_bytes=5 * 64 * 8)
    return cells(coded.withColumn("dist", F.round("dist", 6)), "codeword", ("vec_id", "code", "dist"))


def kmeans_sql(k: int, iters: int, cosine: bool) -> str:
    """Lloyd's rounds written out one after the other."""
    near = "arg_max(code, list_inner_product(p.x, vector))" if cosine else "arg_min(code, list_inner_product(vector, vector) - 2 * list_inner_product(p.x, vector))"
    ctes = [
        "p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)",
        f"""m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('42:' || vec_id::VARCHAR), vec_id) - 1 AS code, x AS vector FROM p QUALIFY code < {k})""",
    ]
    for i in range(1, iters + 1):
        scale = "list_transform(v, lambda t: t / greatest(sqrt(list_inner_product(v, v)), 1e-12))" if cosine else "v"
        ctes += [
            f"a{i} AS MATERIALIZED (SELECT p.vec_id, {near} AS code FROM p CROSS JOIN m{i - 1} GROUP BY p.vec_id)",
            f"""c{i} AS (SELECT code, pos, avg(x) AS v FROM (SELECT code, unnest(range(len(x))) AS pos, unnest(x) AS x FROM a{i} JOIN p USING (vec_id)) GROUP BY code, pos)""",
            f"f{i} AS (SELECT code, list(v ORDER BY pos) AS v FROM c{i} GROUP BY code)",
            f"m{i} AS MATERIALIZED (SELECT code, CASE WHEN v IS NULL THEN vector ELSE {scale} END AS vector FROM m{i - 1} LEFT JOIN f{i} USING (code))",
        ]
    body = f"""SELECT code::INT AS code, unnest(range(64))::INT AS pos, round(unnest(vector), 6) + 0.0 AS value,
                (SELECT count(*) FROM a{iters} WHERE a{iters}.code = m{iters}.code) AS n FROM m{iters}"""
    return fx.with_(ctes, body)


@query("kmeans", kmeans_sql(8, V.KMEANS_ROUNDS, False))
def kmeans(spark, sf_dir):
    means = O.kmeans(vectors(spark, sf_dir), 8)
    return cells(means, "vector", ("code", "n"))


@query("kmeans_blocks", kmeans_sql(8, 2, False))
def kmeans_blocks(spark, sf_dir):
    """Two rounds with three means in a block."""
    means = O.kmeans(vectors(spark, sf_dir), 8, iters=2, block_bytes=3 * 64 * 8)
    return cells(means, "vector", ("code", "n"))


@query("kmeans_cosine", kmeans_sql(8, 3, True))
def kmeans_cosine(spark, sf_dir):
    means = O.kmeans(vectors(spark, sf_dir), 8, iters=3, cosine=True)
    return cells(means, "vector", ("code", "n"))


@query(
    "code_usage",
    fx.with_([*NEAREST_SQL], "SELECT c::INT AS code, (SELECT count(*) FROM assigned WHERE code = c) AS uses FROM (SELECT unnest(range(20)) AS c)"),
)
def code_usage(spark, sf_dir):
    """Twenty codes of which four never occur."""
    return O.code_usage(O.assign_codes(vectors(spark, sf_dir), codebook(spark, sf_dir)), 20)


EMA_SQL = """hourly AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS value FROM events GROUP BY ALL),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM hourly)"""


@query(
    "ema_over_batches",
    f"WITH {EMA_SQL} SELECT event_type, {rounded('sum(value * (1 - 0.99) * pow(0.99, n - i))')} AS ema, count(*) AS n FROM numbered GROUP BY event_type",
)
def ema_over_batches(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    hourly = events.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("value"))
    return O.ema(hourly, "event_type", ["hour"], "value").withColumn("ema", F.round("ema", 6))


@query(
    "masked_mean_pool",
    fx.with_(
        [LONG_SQL],
        """SELECT vec_id, cls, round(1 / (1 + exp(-avg(x) FILTER (NOT padded))), 6) AS pooled
           FROM (SELECT vec_id, pos % 8 AS cls, x, pos // 8 >= 8 - label AS padded FROM long) GROUP BY ALL""",
    ),
)
def masked_mean_pool(spark, sf_dir):
    """Eight frames of eight classes; the last ``label`` frames are padding."""
    long = vectors(spark, sf_dir).select("vec_id", "label", F.posexplode(A.doubles("embedding")).alias("pos", "value"))
    framed = long.select(
        "vec_id",
        (F.col("pos") % 8).alias("cls"),
        "value",
        (F.floor(F.col("pos") / F.lit(8)) >= 8 - F.col("label")).alias("padded"),
    )
    return O.masked_mean_pool(framed, ["vec_id", "cls"]).withColumn("pooled", F.round("pooled", 6))


@query(
    "chunk_mask_all",
    fx.with_([LONG_SQL], "SELECT vec_id, (pos // 2)::INT AS pos, bool_and(x > -0.05) AS value FROM long WHERE pos < 60 GROUP BY ALL"),
)
def chunk_mask_all(spark, sf_dir):
    """64 entries to 30 steps of two; the last four are dropped."""
    mask = F.transform(A.doubles("embedding"), lambda v: v > -0.05)
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(A.chunk_all(mask, 30)).alias("pos", "value"))


@query(
    "codebook_update",
    fx.with_(
        [*NEAREST_SQL,
         "cells AS (SELECT code, pos, avg(x) AS v FROM (SELECT code, unnest(range(len(z))) AS pos, unnest(z) AS x FROM assigned) GROUP BY ALL)",
         "means AS (SELECT code, list(v ORDER BY pos) AS v, FROM cells GROUP BY code)",
         "target AS (SELECT code, vector AS old, CASE WHEN v IS NULL THEN vector ELSE list_transform(v, lambda t: t / sqrt(list_inner_product(v, v))) END AS new FROM book LEFT JOIN means USING (code))",
         "mixed AS (SELECT code, list_transform(list_zip(old, new), lambda p: p[1] * 0.99 + p[2] * (1 - 0.99)) AS m FROM target)"],
        """SELECT code::INT AS code, unnest(range(64))::INT AS pos, round(unnest(list_transform(m, lambda t: t / sqrt(list_inner_product(m, m)))), 6) + 0.0 AS value,
                  (SELECT count(*) FROM assigned a WHERE a.code = mixed.code) AS n FROM mixed""",
    ),
)
def codebook_update(spark, sf_dir):
    updated = O.update_codebook(codebook(spark, sf_dir), vectors(spark, sf_dir))
    return cells(updated, "vector", ("code", "n"))
