"""A Merkle manifest of a table, by lag and lead windows.

The rows of each group, numbered from 0 in their order, are the leaves of a tree of threes; the tops of all groups are the
leaves of one more. Inside a block of ``3 ** LEVELS`` consecutive leaves a node of level l stays in the row of its first leaf,
so its siblings stand at the fixed offsets 3**l and 2 * 3**l: lag and lead columns give them, masked by the node's place
among three and by the length of the block, and the first child's row hashes the parent. Blocks hold whole runs at each of
their levels, so no window looks beyond its block; the nodes on top of the blocks are the leaves of the next round. A group
of any size spreads over its blocks, and a round has 3 ** LEVELS times fewer rows than the one before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from assay.llm.registry import query, table
from assay.llm.storage import written
from assay.operators.ordinals import assign_ordinal

ARITY = 3
LEVELS = 7
BLOCK = ARITY**LEVELS


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after another; a null part is left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def encoded(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and the value, or ``-`` for null: no two rows of values look alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(*[encoded(v) for v in values])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["left"], node, level["right"]))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda level: F.concat(level["left"], level["right"])))


def _block_rows() -> WindowSpec:
    return Window.partitionBy("_group", "_block").orderBy("_slot")


def _climbed(nodes: DataFrame) -> tuple[DataFrame, list[str]]:
    """The nodes (_group, _slot, _node) with ``_top``, their block's top in the row of its first node, and a column for
    each level with the siblings of the node of that level whose first leaf the row is."""
    rows = nodes.withColumn("_block", F.floor(F.col("_slot") / BLOCK)).withColumn("_in_block", F.count(F.lit(1)).over(Window.partitionBy("_group", "_block")))
    names, node, block = [], F.col("_node"), _block_rows()
    for level in range(LEVELS):
        step = ARITY**level
        at = F.pmod(F.floor(F.col("_slot") / step), F.lit(ARITY))
        # A single node is the top; a block that others stand beside goes on to its last level.
        parted = (F.col("_block") > 0) | (F.col("_in_block") > step)
        two_before, before = F.lag(node, 2 * step).over(block), F.lag(node, step).over(block)
        after, two_after = F.lead(node, step).over(block), F.lead(node, 2 * step).over(block)
        name = f"_siblings{level}"
        left = F.when(at == 0, F.lit("")).when(at == 1, before).otherwise(F.concat(two_before, before))
        right = F.when(at == 0, F.concat_ws("", after, two_after)).when(at == 1, F.coalesce(after, F.lit(""))).otherwise(F.lit(""))
        rows = rows.withColumn(name, F.when(parted & (F.col("_slot") % step == 0), F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(parted, digest(node, F.col(name)["right"])).otherwise(node)
        rows = rows.withColumn(f"_node{level + 1}", F.when(F.col("_slot") % (ARITY * step) == 0, parent))
        names.append(name)
        node = F.col(f"_node{level + 1}")
    return rows.withColumn("_top", node), names


def _rounds(leaves: DataFrame) -> list[DataFrame]:
    """The leaves, the tops of their blocks, the tops of these, and so on until each group has one."""
    rounds = [leaves]
    while len(rounds) == 1 or (rounds[-1].agg(F.max("_slot")).first()[0] or 0) > 0:
        rows, _ = _climbed(rounds[-1].select("_group", "_slot", "_node"))
        tops = rows.where(F.col("_slot") % BLOCK == 0).select("_group", F.col("_block").alias("_slot"), F.col("_top").alias("_node"))
        rounds.append(written(tops, "tops"))
    return rounds


def _with_paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows of the first round with the path from their leaf up; ``tops`` are those of the last one, with ``_path`` and
    what else goes to every leaf of a group."""
    for nodes in reversed(rounds[:-1]):
        rows, names = _climbed(nodes)
        fill = _block_rows().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # The last row before that starts a node of a level is the start of the node above this leaf.
        own = F.array_compact(F.array(*[F.last(n, ignorenulls=True).over(fill) for n in names]))
        rows = rows.withColumn("_own", own).select(*nodes.columns, "_block", "_own")
        above = tops.drop("_node").withColumnRenamed("_slot", "_block")
        tops = rows.join(above, ["_group", "_block"]).withColumn("_path", F.concat("_own", "_path")).drop("_own", "_block")
    return tops


def manifest(rows: DataFrame, order: Sequence[str], group: str, values: Sequence[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of ``rows``: ``group`` and ``order``, leaf, subroot, root, path.

    A leaf is the digest of the row's ``values``. Leaves of a group (null is one) stand by ``order``, nulls first, equal ones
    by digest; groups stand by name, null first, byte by byte. ``path`` has for each level the digests ``left`` and
    ``right`` of the node, as texts. ``keep`` adds columns computed from the row. Any value may be null, texts may have
    any length, rows may repeat (each is a leaf), an empty table gives an empty result; other columns are not looked at.
    """
    name = F.col(f"`{group}`").cast("string")
    keys = {f"_by{i}": F.col(f"`{c}`") for i, c in enumerate(order)}
    extra = {f"_keep{i}": c for i, c in enumerate((keep or {}).values())}
    columns = {"_group": F.coalesce(F.concat(F.lit("="), name), F.lit("")), "_name": F.col(f"`{group}`"), **keys, "_node": leaf_of([F.col(f"`{v}`") for v in values]), **extra}
    hashed = written(rows.select(*[c.alias(n) for n, c in columns.items()]), "leaves")
    leaves = written(assign_ordinal(hashed, [*keys, "_node"], by=["_group"], name="_slot"), "leaves")
    rounds = _rounds(leaves)
    subroots = rounds[-1].select(F.col("_group").alias("_member"), F.col("_node"))
    top = _rounds(written(assign_ordinal(subroots, ["_member"], name="_slot").withColumn("_group", F.lit("")), "subroots"))
    path = "array<struct<left:string,right:string>>"
    root = top[-1].withColumns({"_path": F.array().cast(path), "_root": F.col("_node")})
    paths = _with_paths(top, root).select(F.col("_member").alias("_group"), F.lit(0).cast("long").alias("_slot"), "_path", "_root", F.col("_node").alias("_subroot"))
    found = _with_paths(rounds, written(paths, "subroots"))
    return found.select(
        F.col("_name").alias(group),
        *[F.col(k).alias(c) for k, c in zip(keys, order)],
        F.col("_node").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.col("_root").alias("root"),
        F.col("_path").alias("path"),
        *[F.col(k).alias(n) for k, n in zip(extra, keep or {})],
    )


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

# CRC-32 of a short ASCII text, bit by bit (reflected polynomial 0xEDB88320).
_CRC32_SQL = """xor(4294967295, list_reduce(list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT), lambda r, b:
    list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(r, b)), 4294967295::BIGINT))"""


def _sql() -> str:
    def part(value):
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(part(text if f == "text" else f) for f in FIELDS) + ")"

    crc = _CRC32_SQL.format("doc_id::VARCHAR")
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf("text")} AS leaf,
         CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS seen FROM documents),
slots AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM leaves),
low AS (
  SELECT grp, slot, leaf AS node, 0 AS level, count(*) OVER (PARTITION BY grp) AS n FROM slots
  UNION ALL
  SELECT grp, slot // 3, sha256(string_agg(node, '' ORDER BY slot)), level + 1, (any_value(n) + 2) // 3
  FROM (SELECT * FROM low WHERE n > 1) GROUP BY grp, slot // 3, level),
subroots AS (SELECT grp, node AS subroot, level AS top, row_number() OVER (ORDER BY grp) - 1 AS place FROM low WHERE n = 1),
high AS (
  SELECT place AS slot, subroot AS node, 0 AS level, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT slot // 3, sha256(string_agg(node, '' ORDER BY slot)), level + 1, (any_value(n) + 2) // 3
  FROM (SELECT * FROM high WHERE n > 1) GROUP BY slot // 3, level),
-- The siblings of every node, as texts to its left and right.
beside AS (
  SELECT a.grp, a.level, a.slot, coalesce(string_agg(b.node, '' ORDER BY b.slot) FILTER (b.slot < a.slot), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.slot) FILTER (b.slot > a.slot), '') AS r
  FROM low a JOIN low b ON a.grp = b.grp AND a.level = b.level AND a.slot // 3 = b.slot // 3 WHERE a.n > 1 GROUP BY ALL),
above AS (
  SELECT a.level, a.slot, coalesce(string_agg(b.node, '' ORDER BY b.slot) FILTER (b.slot < a.slot), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.slot) FILTER (b.slot > a.slot), '') AS r
  FROM high a JOIN high b ON a.level = b.level AND a.slot // 3 = b.slot // 3 WHERE a.n > 1 GROUP BY ALL),
steps AS (
  SELECT doc_id, s.grp, s.slot, b.level, l, r FROM slots s JOIN beside b ON s.grp = b.grp AND b.slot = s.slot // (3 ** b.level)::BIGINT
  UNION ALL
  SELECT doc_id, s.grp, s.slot, top + a.level, l, r FROM slots s JOIN subroots u USING (grp) JOIN above a ON a.slot = u.place // (3 ** a.level)::BIGINT),
walk AS (
  SELECT grp, slot, seen AS node, 0 AS level FROM slots
  UNION ALL
  SELECT w.grp, w.slot, sha256(l || node || r), w.level + 1 FROM walk w JOIN steps t ON w.grp = t.grp AND w.slot = t.slot AND w.level = t.level),
ends AS (SELECT grp, slot, arg_max(node, level) AS folded_root FROM walk GROUP BY grp, slot),
proofs AS (SELECT grp, slot, string_agg(l || r, '' ORDER BY level) AS proof FROM steps GROUP BY grp, slot),
root AS (SELECT node AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM slots JOIN subroots USING (grp) JOIN ends USING (grp, slot) LEFT JOIN proofs USING (grp, slot), root"""


@query("op12_merkle_manifest", _sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, checked against a copy that lost its line ends where the id's CRC-32 is even."""
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    seen = leaf_of([text if f == "text" else F.col(f) for f in FIELDS])
    found = manifest(table(spark, sf_dir, "documents"), ["doc_id"], "source", FIELDS, {"seen": seen})
    return found.select(
        "doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("path"))).alias("proof_sha256"), folded(F.col("seen"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
