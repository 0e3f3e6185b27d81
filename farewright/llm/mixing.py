"""Mixing sources to target weights, in DataFrame and SQL functions only.

Documents of a source fall into blocks by hash. A source's target becomes an exact quota of blocks:
pass 0 draws its blocks in a permuted order up to the target, pass 1 (where the target exceeds the
source) draws again in another order. A splitting tree deals the quotas out: each node gives its
left half a multivariate hypergeometric draw of its blocks, down to the output shards. Each shard
then owns disjoint blocks, whose rows it shuffles for itself.

Sources and blocks may be many: running sums over them are made in two levels, within ranges of the
order and over the ranges, and the tree deals groups of sources first, then the sources of a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewright.llm.shared import SPACE, fresh, written

WEIGHTS = (3, 1, 2)
SHARE, MOST_TIMES = 1.5, 2
#: Words of a block.
BLOCK_WORDS = 1 << 14
#: Sources are ranked in ranges of so many; a node of the tree holds a row of so many at most.
RANGE, FAN = 100_000, 256
#: The tree has 2**depth leaves, the output shards, as many as the mix has this many words, so that
#: a shard (which one task shuffles) does not grow with the input; but 2**LEAST_DEPTH at least.
SHARD_WORDS = 1 << 23
LEAST_DEPTH = 3
#: The level from which the nodes of a deeper tree are spread over tasks.
SPREAD_AT = 8
SEED = "mix"
#: So many rows of sources or draws are broadcast at most; more are joined by shuffle.
MAX_BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, f"[{SPACE}]+"))).cast("long")


def _before(rows: DataFrame, keys: list[str], order: list[Column], part: Column, sums: dict[str, Column]) -> DataFrame:
    """rows with sums over the rows of their keys that come before. part: the range of the order that a
    row is in, rising with it; only rows of one range meet in a task."""
    at = rows.withColumn("_part", part)
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = at.groupBy(*keys, "_part").agg(*(F.sum(x).alias(f"_{n}") for n, x in sums.items()))
    over = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_part", *(F.coalesce(F.sum(f"_{n}").over(over), F.lit(0)).alias(f"_{n}") for n in sums))
    inner = at.withColumns({n: F.coalesce(F.sum(x).over(within), F.lit(0)) for n, x in sums.items()})
    return inner.join(totals, [*keys, "_part"]).withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *(f"_{n}" for n in sums))


def _ranged(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """rows, written, with the number of the range of the order that each is in."""
    return written(rows.repartitionByRange(-(-n // RANGE) or 1, *order).withColumn("range", F.spark_partition_id()), "ranges")


def _key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: (source, source_size). Adds sid (rank by code point, null last), weight and target.

    All sources share SHARE times the sum of sizes by weight. Sorted by cap over weight, a source is
    at its cap if the share left after all before it were capped is above; the first that is not
    sets the rate for itself and the rest."""
    sizes = written(sizes, "source_sizes")
    n = sizes.count()
    name = F.col("source").asc_nulls_last()
    one = F.lit(1).cast("long")
    ranked = _before(_ranged(sizes, n, name), [], [name], F.col("range"), {"before": one})
    ranked = ranked.select("source", "source_size", (F.col("before") + 1).alias("sid"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(MOST_TIMES) * F.col("source_size")).withColumn("_by", F.col("cap") / F.col("weight"))
    ranked = written(_before(_ranged(ranked, n, F.col("_by"), F.col("sid")), [], [F.col("_by"), F.col("sid")], F.col("range"), {"caps": F.col("cap"), "weights": F.col("weight")}), "ranked")
    size, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    ranked = ranked.withColumn("rate", (F.lit(SHARE) * F.lit(size) - F.col("caps")) / (F.lit(weight) - F.col("weights")))
    open_ = F.col("rate") * F.col("weight") <= F.col("cap")
    rate = ranked.agg(F.max(F.when(open_, F.col("rate")))).first()[0]
    share = F.lit(rate).cast("double") * F.col("weight")
    return ranked.withColumn("target", F.least(share, F.col("cap").cast("double"))).select("source", "source_size", "sid", "weight", "target")


def _hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the number of marked among the drawn, by inversion of the distribution at u. Its
    terms are built by their ratios from the mode, 9 standard deviations each way: beyond that they
    vanish in double precision."""
    n, k, m = f"cast({total} as double)", f"cast({marked} as double)", f"cast({drawn} as double)"
    up = f"(({k} - i) * ({m} - i)) / ((i + 1) * ({n} - {k} - {m} + i + 1))"
    down = f"(i * ({n} - {k} - {m} + i)) / (({k} - i + 1) * ({m} - i + 1))"
    lo, hi = f"greatest(0L, {drawn} - {total} + {marked})", f"least({marked}, {drawn})"
    return f"""
      transform(array(named_struct('mode', least(greatest(cast(floor(({m} + 1) * ({k} + 1) / ({n} + 2)) as bigint), {lo}), {hi}),
          'wide', cast(ceil(9 * sqrt(greatest({m} * {k} * ({n} - {k}) * ({n} - {m}), 0d) / greatest({n} * {n} * ({n} - 1), 1d))) as bigint) + 2)), s ->
        transform(array(named_struct(
            'below', if(s.mode > {lo}, sequence(s.mode, greatest(s.mode - s.wide, {lo} + 1), -1L), array()),
            'above', if(s.mode < {hi}, sequence(s.mode, least(s.mode + s.wide, {hi} - 1), 1L), array()))), r ->
          transform(array(named_struct(
              'b', aggregate(r.below, named_struct('w', 1d, 'z', 0d), (v, i) -> named_struct('w', v.w * {down}, 'z', v.z + v.w * {down})),
              'a', aggregate(r.above, named_struct('w', 1d, 'z', 0d), (v, i) -> named_struct('w', v.w * {up}, 'z', v.z + v.w * {up})))), z ->
            if({u} * (1 + z.a.z + z.b.z) < z.b.z,
              s.mode - aggregate(r.below, named_struct('w', 1d, 'c', z.b.z, 'k', 0L), (v, i) -> named_struct('w', v.w * {down},
                'c', v.c - v.w * {down}, 'k', v.k + if({u} * (1 + z.a.z + z.b.z) < v.c, 1L, 0L))).k,
              s.mode + aggregate(r.above, named_struct('w', 1d, 'c', z.b.z + 1, 'k', 0L), (v, i) -> named_struct('w', v.w * {up},
                'c', v.c + v.w * {up}, 'k', v.k + if({u} * (1 + z.a.z + z.b.z) >= v.c, 1L, 0L))).k))[0])[0])[0]"""


def split_quotas(quotas: DataFrame, depth: int, fan: int = FAN) -> DataFrame:
    """quotas: (sid, n). (shard, sid, n): how many of its blocks go to each of the 2**depth shards.

    Every node halves its number of blocks and draws the left half without replacement: source by
    source, each conditional on the ones before. Node, source and SEED fix the random number. More
    than fan sources are dealt as groups of fan first; then the tree of each group deals its sources,
    with what the group got as the size of each half, which gives the same distribution."""
    quotas = written(quotas, "quotas")
    group = F.floor(F.col("sid") / fan).cast("long")
    if quotas.count() <= fan:
        return _deal(quotas.withColumn("g", F.lit(-1).cast("long")), depth, None)
    groups = split_quotas(quotas.groupBy(group.alias("sid")).agg(F.sum("n").alias("n")), depth, fan)
    return _deal(quotas.withColumn("g", group), depth, written(groups, "groups"))


def _deal(quotas: DataFrame, depth: int, wants: DataFrame | None) -> DataFrame:
    """quotas: (g, sid, n). A tree for each g; wants: (shard, sid, n), what each g gets, or None to
    halve."""
    nodes = quotas.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("sid", "n"))).alias("q")).select("g", F.lit(1).cast("long").alias("node"), "q")
    draw = _hypergeometric("a.total", "x.n", "a.want", "(cast(conv(substring(md5(concat_ws('|', 'SEED', node, x.sid)), 1, 13), 16, 10) as double) / 4503599627370496)").replace("SEED", SEED)
    total = "aggregate(q, 0L, (t, x) -> t + x.n)"
    for level in range(depth):
        nodes = nodes.repartition("node", "g") if level == SPREAD_AT else nodes
        if wants is None:
            nodes = nodes.withColumn("want", F.expr(f"cast(floor({total} / 2) as bigint)"))
        else:
            here = F.expr(f"shiftright(shard + {1 << depth}L, {depth - level - 1})")
            left = wants.select(F.col("sid").alias("g"), here.alias("half"), F.col("n").alias("got")).where("half % 2 = 0").groupBy("g", "half").agg(F.sum("got").alias("want"))
            left = left.select("g", F.expr("half div 2").alias("node"), "want")
            nodes = nodes.join(left, ["g", "node"], "left").withColumn("want", F.coalesce("want", F.lit(0).cast("long")))
        left = f"""aggregate(q, named_struct('want', want, 'total', {total}, 'out', cast(array() as array<struct<sid: bigint, n: bigint>>)),
          (a, x) -> transform(array({draw}), k -> named_struct('want', a.want - k, 'total', a.total - x.n, 'out', array_append(a.out, named_struct('sid', x.sid, 'n', k))))[0]).out"""
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("zip_with(q, l, (x, y) -> named_struct('sid', x.sid, 'n', x.n - y.n))").alias("q")))
        nodes = nodes.select("g", "node", "q", F.expr(left).alias("l")).select("g", F.explode(halves).alias("s")).select("g", "s.node", F.filter("s.q", lambda x: x["n"] > 0).alias("q"))
    return nodes.select((F.col("node") - (1 << depth)).alias("shard"), F.explode("q").alias("x")).select("shard", "x.sid", "x.n")


@dataclass
class Plan:
    """sources: source, sid, source_size, target, blocks. draws: sid, block, and for each pass what
    it takes of the block (words), whether that is all of it, and the shard that gets it. There are
    2**depth shards."""

    sources: DataFrame
    draws: DataFrame
    depth: int


def plan(rows: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, least_depth: int = LEAST_DEPTH) -> Plan:
    """rows: (doc_id, source, size, salt), written."""
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    n = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    sources = written(sources.withColumn("blocks", F.greatest(F.lit(1), n).cast("long")), "sources")
    total = sources.agg(F.sum("target")).first()[0] or 0
    depth = max(least_depth, int(-(-total // shard_words) - 1).bit_length() if total > 0 else 0)
    blocks = placed(rows, sources).groupBy("sid", "block").agg(F.sum("size").alias("words"))
    ordered = blocks.join(_bounded(sources.select("sid", "source_size", "target")), "sid").withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    ordered = written(ordered.withColumn("at", _key("block", F.col("sid"), F.col("pass"), F.col("block"))), "ordered")
    ordered = _before(ordered, ["sid", "pass"], [F.col("at"), F.col("block")], F.substring("at", 1, 3), {"before": F.col("words")})
    goal = F.least(F.col("target") - F.col("pass") * F.col("source_size"), F.col("source_size"))
    rest = goal - F.col("before")
    draws = ordered.withColumn("rest", rest).where("rest > 0").select("sid", "block", "pass", F.least("rest", "words").alias("part"), (F.col("rest") >= F.col("words")).alias("all"))
    draws = written(draws, "draws")
    dealt = split_quotas(draws.groupBy("sid").agg(F.count("*").alias("n")), depth)
    up_to = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = dealt.where("n > 0").withColumn("end", F.sum("n").over(up_to)).select("sid", F.col("shard").cast("int").alias("shard"), F.explode(F.sequence(F.col("end") - F.col("n") + 1, F.col("end"))).alias("j"))
    turn = draws.withColumn("at", _key("draw", F.col("sid"), F.col("pass"), F.col("block")))
    turn = _before(turn, ["sid"], [F.col("at"), F.col("pass"), F.col("block")], F.substring("at", 1, 3), {"j": F.lit(1).cast("long")}).withColumn("j", F.col("j") + 1)
    turn = turn.drop("at").join(places, ["sid", "j"])
    both = turn.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "part", "all", "shard"))).alias("draws"))
    return Plan(sources, written(both, "dealt"), depth)


def _bounded(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with their source's figures and their block."""
    s = _bounded(sources.withColumnRenamed("source", "_of"))
    joined = rows.join(s, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    digits = F.conv(F.substring(_key("doc", F.col("doc_id"), F.col("salt")), 1, 8), 16, 10).cast("long")
    return joined.withColumn("block", F.pmod(digits, F.col("blocks")))


def mix(rows: DataFrame, made: Plan) -> DataFrame:
    """rows: doc_id, source, size, salt and any others. Adds source_size, target and copies: for each time
    the mix takes the row, its pass, its shard, and its place in that shard's order.

    A block drawn whole gives all its rows. The last block of a pass gives rows in a permuted order,
    each taken if at least half of it fits. A row falls into its block by its id and its text, so that
    null or repeated ids spread; rows alike in both are together. Null sources are a source of their
    own; empty texts have size 0 and may be taken at no words; repeated rows count each."""
    on = placed(rows, made.sources).join(_bounded(made.draws), ["sid", "block"], "left")
    place = lambda p: _key("row", F.col("doc_id"), F.col("salt"), F.lit(p))
    entry = lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), _key("row", F.col("doc_id"), F.col("salt"), d["pass"]).alias("place"))
    draws = F.coalesce("draws", F.expr("cast(array() as array<struct<pass: int, part: double, all: boolean, shard: int>>)"))
    on = on.withColumn("draws", draws)
    split = F.exists("draws", lambda d: ~d["all"])
    whole = on.where(~split).withColumn("copies", F.transform("draws", entry))
    cut = on.where(split)
    for p in (0, 1):
        order = Window.partitionBy("sid", "block").orderBy(place(p), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = cut.withColumn(f"_upto{p}", F.sum("size").over(order))
    upto = lambda d: F.when(d["pass"] == 0, F.col("_upto0")).otherwise(F.col("_upto1"))
    fits = lambda d: d["all"] | (upto(d) - F.col("size") / 2 <= d["part"])
    cut = cut.withColumn("copies", F.transform(F.filter("draws", fits), entry)).drop("_upto0", "_upto1")
    return whole.unionByName(cut).drop("sid", "block", "blocks", "weight", "draws", "salt")


def _sized(doc_id: str, text: str, source: str) -> list[Column]:
    salt = F.substring(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), 1, 8)
    return [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), salt.alias("salt")]


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, salt): words of the text, and 8 hex digits that stand for it."""
    return docs.select(*_sized(doc_id, text, source))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the columns of docs plus mix_shard, mix_pass and mix_place; a document that is
    taken twice has two rows. Each shard's rows are together, in their shuffled order."""
    made = plan(written(sized(docs, doc_id, text, source), "sizes"))
    shard, turn, where = fresh(docs, "mix_shard", "mix_pass", "mix_place")
    own = F.struct(*docs.columns)
    rows = docs.select(*_sized(doc_id, text, source), own.alias("row"))
    out = mix(rows, made).select("row", F.explode("copies").alias("c"))
    out = out.select("row.*", F.col("c.shard").alias(shard), F.col("c.pass").alias(turn), F.col("c.place").alias(where))
    return out.repartitionById(1 << made.depth, shard).sortWithinPartitions(shard, where)
