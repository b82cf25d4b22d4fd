"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

A source's documents, in the order of a hash, are laid end to end and cut into
blocks of `block_words` words. A source's target gives an exact quota of block
draws: every block once for each whole pass, then a part of one more pass, the
last block of it cut to the word. The quotas of all sources are split
recursively among the output shards: a node with n shards hands its lower half
a multivariate-hypergeometric draw of its blocks, so each shard gets an exact
number of blocks and a fair, random mixture. The shards' quotas cut each
source's permuted sequence of draws into disjoint runs, and each shard shuffles
its own draws by a hash.

Everything is DataFrame and SQL work. The place of a document in its source's
line is a sum in two levels, over about sqrt(n) parts of about sqrt(n) rows, so
a source with a third of all rows is no task of its own. Tables of one row per
source or shard are the only ones that are ordered as a whole.

Defined cases: null and empty texts have size 0 and nothing is taken of them. A
null source is a source, the last. Repeated rows are documents of their own; a
null doc_id is fine. Empty input gives empty output. Other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Written, named

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1024
#: Fewest output shards, and the words of a shard beyond that.
SHARDS = 16
SHARD_WORDS = 4_000_000
SEED = 20240
WORD = "[^\\x20\\x09-\\x0D]+"
#: Standard deviations to either side of the mode that a draw's inversion covers; beyond lies less than double precision shows.
_SPAN = 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: rank, source, source_size, n_docs, weight, target.

    Sources in order of code points, null last, take the weights in turn. With
    sources by the ratio of cap and weight, those that the level of all later
    ones exceeds stop at their cap, which is what resharing ends with.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("bigint"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    first = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(whole)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * first["level"]))
    return ranked.select("rank", "source", "source_size", "n_docs", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def quotas(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """targets with the words and block draws of each source's two passes, and what its permutation of blocks needs."""
    b = block_words
    return targets.selectExpr(
        "*",
        f"least(cast(round(target) as bigint), {MOST} * source_size) AS quota_words",
        f"source_size div {b} AS full_blocks",
        f"(source_size + {b - 1}) div {b} AS blocks",
        f"length(bin(greatest(source_size div {b} - 1, 1L))) AS bits",
    ).selectExpr(
        "*", "least(quota_words, source_size) AS rest0", "greatest(quota_words - source_size, 0L) AS rest1", "cast((bits + 1) div 2 as int) AS low_bits"
    ).selectExpr("*", "shiftleft(1L, low_bits) - 1 AS low_mask", "shiftleft(1L, bits - low_bits) - 1 AS high_mask", *(
        f"CASE WHEN rest{e} = source_size THEN blocks ELSE rest{e} div {b} + if(rest{e} % {b} > 0, 1, 0) END AS draws{e}" for e in (0, 1)
    )).withColumn("draws", F.col("draws0") + F.col("draws1")).drop("bits")


def _permuted(k: str, n: str, key: str) -> str:
    """SQL of a keyed permutation of 0 to n - 1: four Feistel rounds over the least power of two that holds n, walked until back in range.

    Each walk of a step leaves the range with a chance below one half, so 64 steps do.
    """
    rounds = (
        f"aggregate(array(0, 1, 2, 3), x, (v, r) -> IF(r % 2 = 0, v ^ shiftleft(xxhash64({key}, r, v & low_mask) & high_mask, low_bits), "
        f"v ^ (xxhash64({key}, r, shiftright(v, low_bits)) & low_mask)))"
    )
    return f"IF({n} <= 1, 0L, aggregate(sequence(1, 64), {k}, (x, i) -> IF(i > 1 AND x < {n}, x, {rounds})))"


def _hypergeometric(good: str, bad: str, n: str, u: str) -> str:
    """SQL of a hypergeometric draw by exact inversion outward from the mode; u is uniform in [0, 1)."""
    total = f"({good} + {bad})"
    low, high = f"greatest(0L, {n} - {bad})", f"least({good}, {n})"
    mode = f"least({high}, greatest({low}, cast(floor(({n} + 1.0D) * ({good} + 1.0D) / ({total} + 2.0D)) as bigint)))"
    sd = f"sqrt(greatest(0.0D, 1.0D * {n} * {good} / greatest(1.0D, {total}) * {bad} / greatest(1.0D, {total}) * ({total} - {n}) / greatest(1.0D, {total} - 1.0D)))"
    up = "a.w * ({h}.k - a.x) * ({h}.n - a.x) / ((a.x + 1.0D) * ({h}.r - {h}.n + a.x + 1.0D))"
    down = "a.w * a.x * ({h}.r - {h}.n + a.x) / (({h}.k - a.x + 1.0D) * ({h}.n - a.x + 1.0D))"
    # weights relative to the mode's: total first, then the value at which the running sum passes u of it
    zero = "named_struct('x', {h}.m, 'w', 1.0D, 's', {s}, 'at', {at})"
    hit = "IF(a.at IS NULL AND a.s + {w} > {h}.goal, {x}, a.at)"

    def walk(sign: str, s: str, at: str, h: str = "h") -> str:
        w, x = (up.format(h=h), "a.x + 1L") if sign == "+" else (down.format(h=h), "a.x - 1L")
        return (
            f"aggregate(sequence(1, {h}.span), {zero.format(h=h, s=s, at=at)}, (a, i) -> IF(a.w = 0.0D, a, "
            f"named_struct('x', {x}, 'w', {w}, 's', a.s + {w}, 'at', {hit.format(h=h, w=w, x=x)})))"
        )

    start = f"named_struct('k', {good}, 'r', {bad}, 'n', {n}, 'm', {mode}, 'span', cast(ceil({_SPAN} * {sd}) as int) + 2, 'goal', 1e300D)"
    none = "cast(null as bigint)"
    mass = f"({walk('+', '1.0D', none)}.s + {walk('-', '0.0D', none)}.s)"
    with_goal = f"transform(array({start}), h -> named_struct('k', h.k, 'r', h.r, 'n', h.n, 'm', h.m, 'span', h.span, 'goal', {u} * {mass}))"
    first = walk("+", "1.0D", "IF(1.0D > h.goal, h.m, cast(null as bigint))")
    ups = f"transform({with_goal}, h -> named_struct('h', h, 'up', {first}))"
    second = walk("-", "g.up.s", "g.up.at", "g.h")
    return f"element_at(transform({ups}, g -> coalesce({second}.at, g.h.m)), 1)"


def split_tree(quota: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, rank, draws): how many of each source's block draws each shard gets.

    quota has rank and draws. One row per node and level; a node's quotas are
    an array with one number per source.
    """
    node = quota.agg(F.expr("transform(sort_array(collect_list(struct(rank, draws))), x -> x.draws)").alias("q")).selectExpr(
        "0L AS first", f"{shards}L AS n", "q", "aggregate(q, 0L, (a, x) -> a + x) AS total"
    )
    levels = max(0, (shards - 1).bit_length())
    for depth in range(levels):
        u = f"(shiftrightunsigned(xxhash64({seed}L, {depth}, first, i), 11) / 9007199254740992.0D)"
        draw = _hypergeometric("element_at(q, i)", "(s.left - element_at(q, i))", "s.n", u)
        fold = (
            "aggregate(sequence(1, size(q)), named_struct('left', total, 'n', total * (n div 2) div n, 'out', cast(array() as array<bigint>)), (s, i) -> "
            f"transform(array({draw}), x -> named_struct('left', s.left - element_at(q, i), 'n', s.n - x, 'out', array_append(s.out, x)))[0])"
        )
        # a node of one shard is done; its lower half would be empty
        halves = node.selectExpr("first", "n", "q", f"IF(n > 1 AND size(q) > 0, {fold}.out, q) AS low")
        node = halves.selectExpr(
            "explode(IF(n > 1, array(named_struct('first', first, 'n', n div 2, 'q', low), "
            "named_struct('first', first + n div 2, 'n', n - n div 2, 'q', zip_with(q, low, (a, b) -> a - b))), array(named_struct('first', first, 'n', n, 'q', q)))) AS c"
        ).selectExpr("c.first", "c.n", "c.q", "aggregate(c.q, 0L, (a, x) -> a + x) AS total")
    return node.selectExpr("first AS shard", "posexplode(q) AS (rank, draws)")


def _draws_of_pass(e: int, b: int, seed: int) -> str:
    """SQL of the words lo to hi of a document, in its source's line, that each of its blocks' draws in pass e takes; t is the draw's number."""
    place = f"IF(k < full_blocks, {_permuted('k', 'full_blocks', f'{seed}L, rank, {e}')}, full_blocks)"
    most = f"CASE WHEN rest{e} = source_size OR y.p < rest{e} div {b} THEN {b}L WHEN y.p = rest{e} div {b} THEN rest{e} % {b} ELSE 0L END"
    return (
        f"transform(transform(sequence(_at div {b}, (_at + size - 1) div {b}), k -> named_struct('k', k, 'p', {place})), "
        f"y -> named_struct('pass', {e}, 'block', y.k, 't', y.p + {e} * blocks, 'lo', greatest(_at, y.k * {b}), 'hi', least(_at + size, (y.k + 1) * {b}, y.k * {b} + {most})))"
    )


OWN = ("size", "source_size", "target", "draws")


def _drawn(docs: DataFrame, shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """_d, a struct of docs' columns, so that no name of theirs meets one used here, with size, source_size, target and draws."""
    b = block_words
    base = docs.select(F.struct(*map(named, docs.columns)).alias("_d"), "source", words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_perm"))
    sizes = Written(base.select("_d.doc_id", "source", "size", "_perm")).df
    plan = Written(quotas(source_targets(sizes), b)).df
    if shards is None:
        shards = max(SHARDS, -(-(plan.agg(F.sum("quota_words")).first()[0] or 0) // SHARD_WORDS))
    tree = Written(split_tree(plan.select("rank", "draws"), shards, seed)).df
    ends = tree.withColumn("end", F.sum("draws").over(Window.partitionBy("rank").orderBy("shard"))).groupBy("rank").agg(
        F.expr("transform(sort_array(collect_list(struct(shard, end))), x -> x.end)").alias("ends")
    )
    plan = Written(plan.join(ends, "rank").drop("draws").withColumn("parts", F.ceil(F.sqrt("n_docs")).cast("bigint"))).df
    placed = base.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d._d", "d.size", "d._perm", *(f"p.{c}" for c in plan.columns if c != "source"))
    placed = placed.withColumn("_part", F.pmod(F.col("_perm"), F.col("parts")))
    # the same parts, from the small table: where each part of a source's line begins
    parts = sizes.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).groupBy("rank", F.pmod(F.col("_perm"), F.col("parts")).alias("_part")).agg(F.sum("size").alias("_words"))
    along = Window.partitionBy("rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("rank", "_part", F.coalesce(F.sum("_words").over(along), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("rank", "_part").orderBy("_perm", "_d.doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = placed.withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["rank", "_part"]).withColumn("_at", F.col("_at") + F.col("_base"))
    typed = "array<struct<pass:int,block:bigint,t:bigint,lo:bigint,hi:bigint>>"
    found = f"IF(size > 0, filter(concat({_draws_of_pass(0, b, seed)}, {_draws_of_pass(1, b, seed)}), z -> z.hi > z.lo), cast(array() as {typed}))"
    # how many ends are at most t, by halving
    mid = "cast((s.lo + s.hi) div 2 as int)"
    shard = (
        f"aggregate(sequence(1, {max(1, shards.bit_length() + 1)}), named_struct('lo', 0, 'hi', size(ends)), (s, i) -> IF(s.lo >= s.hi, s, "
        f"IF(element_at(ends, {mid} + 1) <= z.t, named_struct('lo', {mid} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid})))).lo"
    )
    draws = (
        f"transform(_found, z -> named_struct('pass', z.pass, 'block', z.block, 'shard', {shard}, "
        f"'place', xxhash64({seed}L, rank, z.t), 'start', z.lo - _at, 'length', z.hi - z.lo))"
    )
    lined = lined.withColumn("_found", F.expr(found)).withColumn("draws", F.expr(draws))
    return lined.select("_d", *OWN)


def mix_draws(docs: DataFrame, **parameters) -> DataFrame:
    """docs with size, source_size, target and draws: an array of (pass, block, shard, place, start, length).

    Each is a run of `length` words from word `start` of the document that its
    block's draw gives to the shard; `place` orders a shard's draws. By default
    shards grow in number with the mixture, so that one stays a task's size.
    Columns of docs with these four names are replaced; any other name is free.
    """
    return _drawn(docs, **parameters).select(*(F.col("_d")[c].alias(c) for c in docs.columns if c not in OWN), *OWN)


#: A word with the white space after it, so that joined runs read as they stood.
_WITH_SPACE = WORD + "[\\x20\\x09-\\x0D]*"


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mixture: docs' columns once for each document, pass and shard that takes anything of it, text cut to
    the words taken where they aren't all, with shard and place (columns of docs with these two names are replaced).

    A shard's words are exactly what the splitting tree gives it. Its rows lie
    in one partition, in the order of place; a partition may hold several shards.
    """
    m = _drawn(docs, **parameters).where("size(draws) > 0")
    own = "filter(draws, z -> z.pass = g.pass AND z.shard = g.shard)"
    m = m.withColumn("_runs", F.expr(
        "transform(array_distinct(transform(draws, z -> struct(z.pass, z.shard))), g -> struct(g.shard AS shard, "
        f"aggregate({own}, 9223372036854775807L, (a, z) -> least(a, z.place)) AS place, array_sort(transform({own}, z -> struct(z.start AS start, z.length AS length))) AS runs))"
    ))
    taken = "aggregate(r.runs, 0L, (a, x) -> a + x.length)"
    cut = "array_join(transform(r.runs, x -> array_join(slice(o.w, cast(x.start as int) + 1, cast(x.length as int)), '')), '')"
    # the words are found once for each document, and only where a part of it is taken
    m = m.withColumn("_w", F.when(F.exists("_runs", lambda r: F.aggregate(r["runs"], F.lit(0).cast("bigint"), lambda a, x: a + x["length"]) < F.col("size")), F.regexp_extract_all(F.col("_d")["text"], F.lit(_WITH_SPACE), F.lit(0))))
    each = m.select("_d", F.explode(F.expr(f"transform(array(struct(_w AS w, size AS n, _d.text AS t)), o -> transform(_runs, r -> struct(r.shard AS shard, r.place AS place, IF({taken} = o.n, o.t, {cut}) AS text)))[0]")).alias("_r"))
    keep = [c for c in docs.columns if c not in ("shard", "place")]
    out = each.select(*((F.col("_r.text") if c == "text" else F.col("_d")[c]).alias(c) for c in keep), F.col("_r.shard").alias("shard"), F.col("_r.place").alias("place"))
    return out.repartition("shard").sortWithinPartitions("shard", "place")


def digest(docs: DataFrame) -> DataFrame:
    """With shards: the words that each output shard takes of the document."""
    own = "aggregate(filter(draws, z -> z.shard = s), 0L, (a, z) -> a + z.length)"
    return mix_draws(docs.select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", F.expr("aggregate(draws, 0L, (a, z) -> a + z.length)").alias("taken"),
        F.expr(f"transform(array_sort(array_distinct(transform(draws, z -> z.shard))), s -> struct(s AS shard, {own} AS words))").alias("shards"),
    )
