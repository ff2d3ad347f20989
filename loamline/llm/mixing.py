"""Mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only.

Targets: the sources, in code point order and null last, weigh 3, 1, 2 and so on in turn and share 150 % of all words;
a target stops at twice its source's size and the excess goes to the others by weight. Blocks of BLOCK words are
apportioned to the sources below their cap, then each source's quota to its shards, by highest quotients. Inside a shard the
documents' blocks are ordered by a seeded digest and taken up to the quota; where the quota exceeds the shard's size,
every word is taken once and the blocks chosen are taken again. A shard has about SHARD blocks, so that no source is
one task; what is chosen there comes down to one digest, up to which blocks are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed, unpacked, written

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, SHARD, SEED = 32, 1 << 16, "mix"
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with ix, weight and target. With the sources by rising size per weight, the level at which
    the budget runs out is the largest of (budget less the caps below) / (weights from there on)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("ix", F.row_number().over(order))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("ix") - 1) % len(WEIGHTS) + 1).cast("long"))
    below = Window.orderBy(F.col("source_size") / F.col("weight"), "ix").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumns({"under": F.coalesce(F.sum(MOST * F.col("source_size")).over(below), F.lit(0)), "used": F.coalesce(F.sum("weight").over(below), F.lit(0)), "all_size": F.sum("source_size").over(whole), "all_weight": F.sum("weight").over(whole)})
    s = s.withColumn("level", F.max((F.col("all_size") * F.lit(SHARE) - F.col("under")) / (F.col("all_weight") - F.col("used"))).over(whole))
    return s.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), F.col("level") * F.col("weight"))).select("ix", "source", "source_size", "target")


def apportioned(units: DataFrame, group: list[str], unit: str, weight: str, seats: str) -> DataFrame:
    """units with quota: within each group, `seats` are given to the units by the highest quotients weight / (2k - 1).

    With n units and quota q in proportion, a unit whose share is p gets q within p n / 2 + 1/2 seats (each is a rounded
    multiple of its weight), so only the quotients near q are ranked."""
    g = Window.partitionBy(*group)
    u = units.withColumns({"_w": F.col(weight).cast("double"), "_all": F.sum(F.col(weight).cast("double")).over(g), "_n": F.count("*").over(g)})
    u = u.withColumn("_p", F.when(F.col("_all") > 0, F.col("_w") / F.col("_all")).otherwise(0.0))
    slack = F.col("_p") * F.col("_n") / 2 + 1
    u = u.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_p") * F.col(seats) - slack)).cast("long"))
    u = u.withColumn("_high", F.greatest(F.col("_low") + 1, F.ceil(F.col("_p") * F.col(seats) + slack).cast("long")))
    u = u.withColumn("_left", F.col(seats) - F.sum("_low").over(g))
    k = u.withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    k = k.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy((F.col("_w") / (2 * F.col("_k") - 1)).desc(), unit, "_k")))
    won = k.withColumn("_won", ((F.col("_rank") <= F.col("_left")) & (F.col("_w") > 0)).cast("long"))
    return won.groupBy(*units.columns).agg((F.first("_low") + F.sum("_won")).alias("quota"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column, Column]:
    """Size in words, number of blocks and digest of a document."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))
    return size, F.ceil(size / BLOCK).cast("long"), digest


def _shard(digest: Column, shards: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % shards


def _key(digest: Column, block: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", digest, block.cast("string")).cast("binary")), 1, 16)


def _words(size: Column, block: Column) -> Column:
    return F.least(F.lit(BLOCK).cast("long"), size - block * BLOCK)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The shards: ix, source, source_size, target, shards (of the source), shard, quota (blocks), whole (times that
    every word is taken: 0 or 1) and upto (the digest up to which blocks are taken once more, null for none)."""
    size, blocks, digest = sized(docs, id_col, text_col, source_col)
    d = written(docs.select(F.col(source_col).alias("source"), size.alias("size"), blocks.alias("blocks"), digest.alias("digest")), "mix")
    s = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("blocks").alias("_blocks"))
    t = targets(s.select("source", "source_size"))
    # a source at its cap is taken MOST times whole; blocks are apportioned among the others
    t = t.withColumn("share", F.when(F.col("target") < MOST * F.col("source_size"), F.col("target")).otherwise(0.0))
    t = apportioned(t.withColumn("seats", F.round(F.sum("share").over(Window.partitionBy()) / BLOCK).cast("long")), [], "ix", "share", "seats")
    t = t.withColumnRenamed("quota", "source_quota").withColumn("source_", F.col("source")).drop("seats", "source")
    t = t.join(s.select(F.col("source").alias("s"), "_blocks"), F.col("source_").eqNullSafe(F.col("s"))).drop("s")
    t = t.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("_blocks") / SHARD)).cast("long")).drop("_blocks")
    t = written(t, "mix")
    dealt = d.join(t.select("ix", "source_", "shards"), F.col("source").eqNullSafe(F.col("source_"))).select("ix", _shard(F.col("digest"), F.col("shards")).alias("shard"), "size", "blocks", "digest")
    shards = dealt.groupBy("ix", "shard").agg(F.sum("size").alias("shard_size")).join(t, "ix")
    q = apportioned(shards, ["ix"], "shard", "shard_size", "source_quota")
    take = F.when(F.col("share") > 0, F.least(F.col("quota") * BLOCK, MOST * F.col("shard_size"))).otherwise(MOST * F.col("shard_size"))
    q = q.withColumn("whole", (take >= F.col("shard_size")).cast("long")).withColumn("rest", take - F.col("whole") * F.col("shard_size"))
    q = written(q, "mix")
    b = dealt.where("blocks > 0").join(q.select("ix", "shard", "rest").where("rest > 0"), ["ix", "shard"])
    b = b.select("ix", "shard", "rest", "size", "digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    b = b.select("ix", "shard", "rest", _words(F.col("size"), F.col("b")).alias("words"), _key(F.col("digest"), F.col("b")).alias("key"))
    # equal rows have equal keys and are taken together
    b = b.withColumn("upto_words", F.sum("words").over(Window.partitionBy("ix", "shard").orderBy("key")))
    upto = b.where(2 * F.col("upto_words") - F.col("words") <= 2 * F.col("rest")).groupBy("ix", "shard").agg(F.max("key").alias("upto"))
    return written(q.join(upto, ["ix", "shard"], "left").select("ix", F.col("source_").alias("source"), "source_size", "target", "shards", "shard", "quota", "whole", "upto"), "mix")


RESULTS = tuple(f"mix_{x}" for x in ("size", "source_size", "target", "taken", "whole", "again"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """own (the columns of docs) and RESULTS."""
    p = plan(docs, id_col, text_col, source_col)
    size, blocks, digest = sized(docs, id_col, text_col, source_col)
    s = p.groupBy("source").agg(F.first("shards").alias("shards"), F.first("ix").alias("ix")).withColumnRenamed("source", "of")
    d = docs.select(packed(docs), F.col(source_col).alias("source"), size.alias("mix_size"), blocks.alias("blocks"), digest.alias("digest"))
    d = d.join(s, F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", _shard(F.col("digest"), F.col("shards"))).drop("of", "shards", "source")
    q = p.select("ix", "shard", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("whole").alias("mix_whole"), "upto")
    d = d.join(q, ["ix", "shard"])
    all_ = F.when(F.col("blocks") > 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array().cast("array<bigint>"))
    again = F.filter(all_, lambda b: F.coalesce(_key(F.col("digest"), b) <= F.col("upto"), F.lit(False)))
    d = d.withColumn("mix_again", again)
    more = F.aggregate("mix_again", F.lit(0).cast("long"), lambda n, b: n + _words(F.col("mix_size"), b))
    return d.withColumn("mix_taken", F.col("mix_whole") * F.col("mix_size") + more).select("own", *RESULTS)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target, taken, whole (times the whole text is taken) and again (the numbers of the
    32-word blocks taken besides), in columns prefixed mix_.

    A null text has no words, a null source is a source of its own, and a null id is a value like any other. Documents
    without words take none. Equal rows are taken alike; the mix over all rows stays near the target as long as no one
    row's repeats outweigh a block. Columns of docs keep their names and values, unless they are named like a result, which
    takes their place; an empty table gives an empty one."""
    return _mixed(docs, id_col, text_col, source_col).select(*unpacked(docs, RESULTS), *RESULTS)


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with the text that the mix takes of each: the whole text if it is taken, then the blocks taken besides, with
    their white space. Documents of which nothing is taken go, unless they have no words. Other columns stay as they are."""
    m = _mixed(docs, id_col, text_col, source_col).where("mix_taken > 0 or mix_size = 0")
    m = m.withColumn("text", F.col("own")[f"c{docs.columns.index(text_col)}"])
    words = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    again = F.array_join(F.transform("mix_again", lambda b: F.array_join(F.slice("words", (b * BLOCK + 1).cast("int"), F.lit(BLOCK)), "")), "")
    whole = F.when(F.col("mix_whole") == 1, F.col("text")).otherwise("")
    text = F.when(F.size("mix_again") == 0, whole).when(F.col("mix_whole") == 0, again).otherwise(F.concat(F.col("text"), F.lit("\n"), again))
    m = m.withColumn("words", F.when(F.size("mix_again") > 0, words)).withColumn("text", F.when(F.col("mix_size") == 0, F.col("text")).otherwise(text))
    return m.select(*(F.col("text").alias(c) if c == text_col else own for c, own in zip(docs.columns, unpacked(docs))))


#: DuckDB SQL for the mix of documents, with the same digests.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))) AS digest
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, sum((size + 31) // 32)::BIGINT AS blocks, row_number() OVER (ORDER BY source NULLS LAST) AS ix FROM d GROUP BY source),
s1 AS (SELECT *, ([3, 1, 2])[((ix - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s0),
s2 AS (SELECT *, coalesce(sum(2 * source_size) OVER b, 0)::BIGINT AS under, coalesce(sum(weight) OVER b, 0)::BIGINT AS used, sum(source_size) OVER ()::BIGINT AS all_size, sum(weight) OVER ()::BIGINT AS all_weight
       FROM s1 WINDOW b AS (ORDER BY source_size::DOUBLE / weight, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max((all_size * 1.5::DOUBLE - under) / (all_weight - used)) OVER () AS level FROM s2),
s4 AS (SELECT ix, source, source_size, least((2 * source_size)::DOUBLE, level * weight) AS target, greatest(1, (blocks + 65535) // 65536) AS shards FROM s3),
s45 AS (SELECT *, CASE WHEN target < 2 * source_size THEN target ELSE 0.0::DOUBLE END AS share FROM s4),
s5 AS (SELECT *, round(sum(share) OVER () / 32)::BIGINT AS seats, sum(share) OVER () AS t_all, count(*) OVER () AS n FROM s45),
s6 AS (SELECT *, CASE WHEN t_all > 0 THEN share / t_all ELSE 0 END AS p FROM s5),
s7 AS (SELECT *, greatest(0, floor(p * seats - p * n / 2 - 1))::BIGINT AS low, ceil(p * seats + p * n / 2 + 1)::BIGINT AS high FROM s6),
s8 AS (SELECT *, seats - sum(low) OVER () AS rest FROM s7),
s9 AS (SELECT *, unnest(range(low + 1, greatest(low + 1, high) + 1)) AS k FROM s8),
s10 AS (SELECT *, row_number() OVER (ORDER BY share / (2 * k - 1) DESC, ix, k) AS rank FROM s9),
q AS (SELECT ix, source, source_size, target, share, shards, (min(low) + count(*) FILTER (WHERE rank <= rest AND share > 0))::BIGINT AS quota FROM s10 GROUP BY ALL),
e AS (SELECT d.*, q.ix, q.source_size, q.target, q.share, q.quota, ('0x' || substr(digest, 1, 8))::BIGINT % shards AS shard FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
h0 AS (SELECT ix, shard, share, quota AS seats, sum(size)::BIGINT AS shard_size FROM e GROUP BY ix, shard, share, quota),
h1 AS (SELECT *, sum(shard_size::DOUBLE) OVER (PARTITION BY ix) AS t_all, count(*) OVER (PARTITION BY ix) AS n FROM h0),
h2 AS (SELECT *, CASE WHEN t_all > 0 THEN shard_size::DOUBLE / t_all ELSE 0 END AS p FROM h1),
h3 AS (SELECT *, greatest(0, floor(p * seats - p * n / 2 - 1))::BIGINT AS low, ceil(p * seats + p * n / 2 + 1)::BIGINT AS high FROM h2),
h4 AS (SELECT *, seats - sum(low) OVER (PARTITION BY ix) AS left_ FROM h3),
h5 AS (SELECT *, unnest(range(low + 1, greatest(low + 1, high) + 1)) AS k FROM h4),
h6 AS (SELECT *, row_number() OVER (PARTITION BY ix ORDER BY shard_size::DOUBLE / (2 * k - 1) DESC, shard, k) AS rank FROM h5),
h7 AS (SELECT ix, shard, shard_size, CASE WHEN share = 0 THEN 2 * shard_size ELSE least((min(low) + count(*) FILTER (WHERE rank <= left_ AND shard_size > 0))::BIGINT * 32, 2 * shard_size) END AS take FROM h6 GROUP BY ix, shard, share, shard_size),
h8 AS (SELECT *, (take >= shard_size)::BIGINT AS whole, take - (take >= shard_size)::BIGINT * shard_size AS rest FROM h7),
b0 AS (SELECT ix, shard, size, digest, unnest(range(0, (size + 31) // 32)) AS b FROM e),
b1 AS (SELECT ix, shard, digest, least(32, size - b * 32)::BIGINT AS words, substr(md5(digest || '|' || b::VARCHAR), 1, 16) AS key FROM b0),
b2 AS (SELECT b1.*, rest, sum(words) OVER (PARTITION BY b1.ix, b1.shard ORDER BY key) AS upto_words FROM b1 JOIN h8 ON b1.ix = h8.ix AND b1.shard = h8.shard WHERE rest > 0),
b3 AS (SELECT ix, shard, max(key) AS upto FROM b2 WHERE 2 * upto_words - words <= 2 * rest GROUP BY ix, shard),
b4 AS (SELECT digest, sum(words)::BIGINT AS more FROM (SELECT DISTINCT b1.* FROM b1) b1 JOIN b3 ON b1.ix = b3.ix AND b1.shard = b3.shard WHERE key <= upto GROUP BY digest)
SELECT e.doc_id, e.size, e.source_size, e.target, (h8.whole * e.size + coalesce(b4.more, 0))::BIGINT AS taken
FROM e JOIN h8 ON e.ix = h8.ix AND e.shard = h8.shard LEFT JOIN b4 ON e.digest = b4.digest
"""
