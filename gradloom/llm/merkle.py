"""Merkle manifest of a dataset, with coordinate lookup proofs.

Leaves are digests of rows; per source they ascend by id and every 16 become one node, level by level, until one is left,
the source's subroot; the subroots, in the order of their sources, become the root in the same way.  All nodes are one
written table of (tree, level, index, digest).

A proof needs the other nodes of the leaf's run of 16, then those of the run's parent, and so on.  Their coordinates follow
from an index and the number of leaves alone: they are exploded, joined to the node table, put in order, concatenated and
folded.  The leaves of a run share all coordinates, so these are exploded once a run; a node near the root, which a large
part of all runs asks for, is dealt to them by ``spread_join``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import placed
from .shared import documents, spread_join, written

FAN = 16
_MOST_LEVELS = 15  # 16 ** 15 leaves
#: The tree of the subroots; sources are "-" (null) or "=" and their name, which sorts null first and then by bytes.
_TOP = ""


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value; integers are decimal."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leaf_table(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None) -> DataFrame:
    """(doc_id, part, leaf, given) per row; ``given`` is the leaf of a row that ``tampered`` marks, with its text replaced, else null."""
    leaf = lambda text: digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))
    given = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(tampered_text))
    part = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), leaf(F.col("text")).alias("leaf"), given.alias("given"))


def levels(leaves: DataFrame, most: int) -> list[DataFrame]:
    """Tables (part, level, idx, digest) of all levels over ``leaves`` (part, idx, digest), the largest of whose trees has ``most`` leaves.

    Smaller trees go on above their roots with nodes of one child; nothing asks for those.
    """
    below = leaves.select("part", F.lit(0).alias("level"), "idx", "digest")
    out, level = [below], 0
    while most > FAN**level:
        level += 1
        run = F.floor(F.col("idx") / FAN)
        nodes = below.groupBy("part", run.alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))  # at most 16
        nodes = nodes.select("part", F.lit(level).alias("level"), F.col("up").alias("idx"), F.sha2(F.array_join("run.digest", "").cast("binary"), 256).alias("digest"))
        below = written(nodes, f"merkle-level{level}")
        out.append(below)
    return out


def _height(n: Column) -> Column:
    """Levels below the root of a tree of ``n`` leaves."""
    return F.aggregate(F.array(*[F.lit(FAN**k) for k in range(_MOST_LEVELS)]), F.lit(0), lambda acc, p: acc + F.when(n > p, 1).otherwise(0))


def _wanted(tree: Column, own: Column, n: Column, first: int, height: Column, place: Column) -> Column:
    """Array of (place, part, level, own, last) for the levels from ``first`` to below ``height``: what a node's siblings are.

    ``own`` and ``n`` are its index and the number of nodes at level ``first``.
    """
    powers = F.array(*[F.lit(FAN**k) for k in range(_MOST_LEVELS)])
    at = lambda k: F.element_at(powers, k - first + 1)
    ks = F.filter(F.array(*[F.lit(k) for k in range(first, _MOST_LEVELS)]), lambda k: k < height)
    one = lambda k: F.struct((place + k - first).alias("place"), tree.alias("part"), k.alias("level"), F.floor(own / at(k)).alias("own"), (F.ceil(n / at(k)) - 1).alias("last"))
    return F.transform(ks, one)


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` marks the rows whose text is replaced by ``tampered_text`` before their root is folded anew; they should
    not verify, unless the text stays as it is.  ``proof_sha256`` is the digest of the siblings' digests, level by level
    through the subroot to the root, left to right; without siblings that of the empty string.

    Null values have a leaf of their own; null sources are a source, the first; null ids come first within a source; rows
    of one id are ordered by leaf, so that repeated rows are leaves of their own.  Empty and very long texts are texts.
    An empty table gives an empty result; other columns are ignored.
    """
    leaves = written(leaf_table(docs, tampered, tampered_text), "merkle-leaves")
    tie = F.monotonically_increasing_id()  # rows that are all the same needn't share a range
    leaves = placed(leaves.withColumn("tie", tie), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tie"), within=("part",), name="idx").drop("tie")
    leaves = written(leaves, "merkle-numbered")
    sources = written(leaves.groupBy("part").agg((F.max("idx") + 1).alias("n")).withColumn("height", _height(F.col("n"))), "merkle-sources")
    size = sources.agg(F.max("n").alias("most"), F.count("*").alias("n")).first()
    trees = levels(leaves.select("part", "idx", F.col("leaf").alias("digest")), size["most"] or 0)
    firsts = [t.where("idx = 0").select("part", "level", "digest") for t in trees]
    for more in firsts[1:]:
        firsts[0] = firsts[0].unionByName(more)
    subroots = sources.join(firsts[0], "part").where("level = height").select("part", "n", "height", F.col("digest").alias("subroot"))
    subroots = written(placed(subroots, F.col("part"), name="top"), "merkle-subroots")
    top = levels(subroots.select(F.lit(_TOP).alias("part"), F.col("top").alias("idx"), F.col("subroot").alias("digest")), size["n"])
    root = top[-1].select(F.col("digest").alias("root"))  # one row

    # the node table; level 0 carries what the leaves' rows say
    nodes = leaves.select("part", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"), "doc_id", "given")
    for more in [*trees[1:], *top]:
        nodes = nodes.unionByName(more, allowMissingColumns=True)
    key = F.xxhash64("part", "level", "idx")
    nodes = written(nodes.withColumn("node", key), "merkle-nodes")

    runs = leaves.where(F.col("idx") % FAN == 0).select("part", F.floor(F.col("idx") / FAN).alias("run"))
    runs = spread_join(runs, subroots.drop("run"), "part", "run")
    n_top, own = F.lit(size["n"]), F.lit(0)
    inside = F.greatest(F.col("height") - 1, F.lit(0))
    upper = F.concat(
        _wanted(F.col("part"), F.col("run"), F.ceil(F.col("n") / FAN), 1, F.col("height"), F.lit(1)),
        _wanted(F.lit(_TOP), F.col("top"), n_top, 0, _height(n_top), inside + 1),
    )
    own = F.struct(F.lit(0).alias("place"), F.col("part").alias("part"), F.lit(0).alias("level"), (F.col("run") * FAN).alias("own"), (F.col("n") - 1).alias("last"))
    runs = runs.withColumn("upper", F.size(upper)).withColumn("w", F.explode(F.concat(F.array(own), upper)))
    start = F.floor(F.col("w.own") / FAN) * FAN
    wanted = runs.withColumn("i", F.explode(F.sequence(start, F.least(start + FAN - 1, F.col("w.last"))))).where("w.place = 0 OR i <> w.own")
    wanted = wanted.select(F.col("part").alias("of"), "run", "n", "subroot", "upper", F.col("w.place").alias("place"), (F.col("i") < F.col("w.own")).alias("left"), F.col("w.part").alias("part"), F.col("w.level").alias("level"), "i")
    wanted = wanted.withColumn("node", F.xxhash64("part", "level", "i"))
    facts = nodes.select("node", F.struct("part", "level", "idx", "digest", "doc_id", "given").alias("fact"))
    met = spread_join(wanted, facts, "node", "of", "run")
    met = met.where((F.col("fact.part") == F.col("part")) & (F.col("fact.level") == F.col("level")) & (F.col("fact.idx") == F.col("i")))  # hashes may collide

    item = F.struct("place", "i", "left", F.col("fact.digest").alias("digest"), F.col("fact.doc_id").alias("doc_id"), F.col("fact.given").alias("given"))
    paths = met.groupBy("of", "run").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("n").alias("n"), F.first("subroot").alias("subroot"), F.first("upper").alias("upper"))
    joined = lambda items, which: F.array_join(F.transform(F.filter(items, which), lambda x: x["digest"]), "")
    step = lambda p: F.struct(joined("items", lambda x: (x["place"] == p) & x["left"]).alias("l"), joined("items", lambda x: (x["place"] == p) & ~x["left"]).alias("r"))
    above = F.when(F.col("upper") > 0, F.transform(F.sequence(F.lit(1), F.col("upper")), step)).otherwise(F.array().cast("array<struct<l:string,r:string>>"))
    paths = paths.select("n", "subroot", above.alias("above"), F.filter("items", lambda x: x["place"] == 0).alias("members"))
    beside = lambda m: F.struct(joined("members", lambda x: x["i"] < m["i"]).alias("l"), joined("members", lambda x: x["i"] > m["i"]).alias("r"))
    path = lambda m: F.when(F.col("n") > 1, F.concat(F.array(beside(m)), "above")).otherwise(F.col("above"))
    proof = lambda x: F.sha2(F.array_join(F.transform(x["path"], lambda p: F.concat(p["l"], p["r"])), "").cast("binary"), 256)
    folded = lambda x: F.aggregate(x["path"], F.coalesce(x["m"]["given"], x["m"]["digest"]), lambda acc, p: digest(p["l"], acc, p["r"]))
    # a run's proofs are folded within its row, so that no row of a leaf carries siblings
    own = F.transform(F.transform("members", lambda m: F.struct(m.alias("m"), path(m).alias("path"))), lambda x: F.struct(x["m"]["doc_id"].alias("doc_id"), x["m"]["digest"].alias("leaf"), proof(x).alias("proof_sha256"), folded(x).alias("folded_root")))
    rows = paths.select("subroot", F.explode(own).alias("own")).select("own.doc_id", "own.leaf", "subroot", "own.proof_sha256", "own.folded_root")
    rows = rows.join(F.broadcast(root))  # one row
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents; where 5 divides the crc32 of the id, tampering lower-cases the text's A-Z."""
    docs = documents(spark, sf_dir)
    return merkle_manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lower_ascii(F.col("text")))


def _sql_field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(strlen(CAST({x} AS VARCHAR)), ':', {x}) END"


def _sql_leaf(text: str) -> str:
    return f"sha256(concat({', '.join(map(_sql_field, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"


_SQL_NODES = "SELECT {key}n, level + 1, idx // 16, sha256(string_agg(d, '' ORDER BY idx)) FROM {name} WHERE n > 16 ** level GROUP BY {key}n, level, idx // 16"

OP12_SQL = f"""WITH RECURSIVE bits AS (SELECT i AS b, i::UBIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT b, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END), k + 1 FROM bits WHERE k < 8),
crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS p, 4294967295::UBIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents) UNION ALL
  SELECT doc_id, s, p + 1, xor(crc.c >> 8, b.c) FROM crc JOIN (SELECT * FROM bits WHERE k = 8) b ON b.b = xor(crc.c & 255, ascii(substr(s, p + 1, 1))::UBIGINT) WHERE p < length(s)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n FROM
  (SELECT d.doc_id, coalesce('=' || source, '-') AS part, {_sql_leaf('text')} AS leaf, CASE WHEN x.c % 5 = 0 THEN {_sql_leaf(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} END AS given
   FROM (SELECT *, doc_id AS id FROM documents) d LEFT JOIN (SELECT doc_id AS cid, xor(c, 4294967295::UBIGINT) AS c FROM crc WHERE p = length(s)) x ON cid = id)),
nodes AS (SELECT part, n, 0 AS level, idx, leaf AS d FROM leaves UNION ALL {_SQL_NODES.format(key='part, ', name='nodes')}),
subs AS (SELECT *, row_number() OVER (ORDER BY part) - 1 AS top, count(*) OVER () AS s FROM (SELECT part, arg_max(d, level) AS subroot, max(level) AS h FROM nodes GROUP BY 1)),
tops AS (SELECT s AS n, 0 AS level, top AS idx, subroot AS d FROM subs UNION ALL {_SQL_NODES.format(key='', name='tops')}),
siblings AS (SELECT l.part, l.idx AS leaf_idx, k.level AS place, k.idx, l.idx // CAST(16 ** k.level AS BIGINT) AS own, k.d FROM leaves l JOIN nodes k ON k.part = l.part AND k.n > 16 ** k.level AND k.idx // 16 = l.idx // CAST(16 ** (k.level + 1) AS BIGINT)
  UNION ALL SELECT l.part, l.idx, h + k.level, k.idx, top // CAST(16 ** k.level AS BIGINT), k.d FROM leaves l JOIN subs u ON u.part = l.part JOIN tops k ON k.n > 16 ** k.level AND k.idx // 16 = top // CAST(16 ** (k.level + 1) AS BIGINT)),
paths AS (SELECT part, leaf_idx, place, coalesce(string_agg(d, '' ORDER BY idx) FILTER (idx < own), '') AS l, coalesce(string_agg(d, '' ORDER BY idx) FILTER (idx > own), '') AS r FROM siblings GROUP BY 1, 2, 3),
folds AS (SELECT part, idx, 0 AS place, coalesce(given, leaf) AS acc FROM leaves UNION ALL SELECT f.part, f.idx, f.place + 1, sha256(concat(p.l, f.acc, p.r)) FROM folds f JOIN paths p ON p.part = f.part AND p.leaf_idx = f.idx AND p.place = f.place),
proofs AS (SELECT part, leaf_idx, sha256(string_agg(concat(l, r), '' ORDER BY place)) AS proof FROM paths GROUP BY 1, 2)
SELECT l.doc_id, l.leaf, u.subroot, r.root, coalesce(p.proof, sha256('')) AS proof_sha256, f.acc AS folded_root, f.acc = r.root AS verified FROM leaves l JOIN subs u ON u.part = l.part LEFT JOIN proofs p ON p.part = l.part AND p.leaf_idx = l.idx
  JOIN (SELECT part, idx, arg_max(acc, place) AS acc FROM folds GROUP BY 1, 2) f ON f.part = l.part AND f.idx = l.idx, (SELECT arg_max(d, level) AS root FROM tops) r"""
