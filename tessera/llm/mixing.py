"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame and SQL functions only.  Sources' shares are levelled under their caps,
turned into exact quotas of word blocks, and the quotas are split down a binary
tree to the output shards; within a source, blocks stand in a permuted order of
which each shard takes its own stretch, shuffled again inside the shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.arrays import let
from tessera.llm.common import clash_free, shuffle_width, staged, table, unit_hash

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Texts longer than this are drawn in several blocks.
BLOCK_WORDS = 4096
#: Ranks in a permuted order are counted within buckets of about so many blocks.
BUCKET_ROWS = 256
#: Levels of the tree after which its nodes are dealt anew.
SPREAD_LEVELS = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of characters other than space and \\t to \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, hash (of the text), copy: rows alike in the first four, repeated ones, are numbered by copy."""
    alike = Window.partitionBy("doc_id", "source", "size", "hash").orderBy("size")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), _text_hash().alias("hash"))
    return rows.withColumn("copy", F.row_number().over(alike))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: src (its number), source, source_size, n_blocks, target, epochs, rest.

    Sources in code-point order, null last, weigh ``weights`` in turn and share all
    words; none gets over ``max_epochs`` times its words, and what one can't take
    goes to the others by weight.  Of the levels at which exactly the sources of
    smallest cap per weight are full, the highest is the one that holds.
    ``target`` rounds to ``epochs`` whole passes and ``rest`` words of another.
    The sources' own table passes through one task; it has a row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.ceil(F.col("size") / block_words)).cast("long").alias("n_blocks"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(1))
    filled = Window.partitionBy(F.lit(1)).orderBy(F.col("_cap") / F.col("_weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("src", F.lit(len(weights))) + 1).cast("int"))
    before = lambda c: F.coalesce(F.sum(c).over(filled), F.lit(0))
    level = (F.sum("source_size").over(all_rows) - before("_cap")) / (F.sum("_weight").over(all_rows) - before("_weight"))
    out = per.withColumn("src", F.row_number().over(by_name) - 1).withColumn("_weight", weight).withColumn("_cap", max_epochs * F.col("source_size"))
    out = out.withColumn("_level", level).withColumn("_level", F.max("_level").over(all_rows))
    out = out.withColumn("target", F.least(F.col("_weight") * F.col("_level"), F.col("_cap").cast("double")))
    words = F.least(F.round("target").cast("long"), F.col("_cap"))
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("epochs", epochs).withColumn("rest", words - F.col("epochs") * F.col("source_size"))
    return out.select("src", "source", "source_size", "n_blocks", "target", "epochs", "rest")


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the number of ``marked`` among ``drawn`` of ``total``, inverted at ``u`` in [0, 1).

    The distribution is summed over all its support within 12 standard deviations
    and 12 of the mode; beyond, nothing is left at double precision.
    """
    support = (
        f"named_struct('n', cast({total} as double), 'k', cast({marked} as double), 'd', cast({drawn} as double),"
        f" 'lo', greatest(0L, {drawn} - ({total} - {marked})), 'hi', least({drawn}, {marked}),"
        f" 'mode', cast(floor((cast({drawn} as double) + 1) * (cast({marked} as double) + 1) / ({total} + 2)) as bigint),"
        f" 'half', 12 + cast(ceil(12 * sqrt(greatest(0d, cast({drawn} as double) * {marked} / greatest({total}, 1L) * ({total} - {marked}) / greatest({total}, 1L) * ({total} - {drawn}) / greatest({total} - 1, 1L)))) as bigint))"
    )
    ends = "named_struct('s', s, 'a', greatest(s.lo, least(s.hi, s.mode - s.half)), 'b', least(s.hi, greatest(s.lo, s.mode + s.half)))"
    step = "(e.s.k - x) * (e.s.d - x) / ((x + 1) * (e.s.n - e.s.k - e.s.d + x + 1))"
    steps = "slice(sequence(e.a, e.b), 1, cast(e.b - e.a as int))"
    whole = f"aggregate({steps}, named_struct('w', 1d, 't', 1d), (z, x) -> named_struct('w', z.w * {step}, 't', z.t + z.w * {step}), z -> z.t)"
    found = (
        f"aggregate({steps}, named_struct('w', 1d, 't', 1d, 'at', if(1d > g, e.a, cast(null as bigint))),"
        f" (z, x) -> named_struct('w', z.w * {step}, 't', z.t + z.w * {step}, 'at', coalesce(z.at, if(z.t + z.w * {step} > g, x + 1, cast(null as bigint)))), z -> coalesce(z.at, e.b))"
    )
    return _let("s", support, _let("e", ends, _let("g", f"{u} * {whole}", found)))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Split each source's quota exactly among ``shards`` (a power of two): src, shard, lo, hi.

    lo..hi is the shard's stretch in the source's permuted order; empty ones are left
    out.  Each node of the tree gives half its blocks to its left child; how many of
    each source these are is drawn source by source from the hypergeometric law.
    Nodes are dealt anew every few levels, so many tasks draw.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    ordered = F.sort_array(F.collect_list(F.struct("src", "quota")))
    nodes = quotas.groupBy().agg(ordered.alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    u = f"(shiftrightunsigned(xxhash64({seed}, level, node, y.src), 11) / 9007199254740992d)"
    draw = hypergeometric("c.total", "y.quota", "c.todo", u)
    taken = _let("v", draw, "named_struct('total', c.total - y.quota, 'todo', c.todo - v, 'left', concat(c.left, array(named_struct('src', y.src, 'quota', v))))")
    half = f"aggregate(q, named_struct('total', aggregate(q, 0L, (t, y) -> t + y.quota), 'todo', aggregate(q, 0L, (t, y) -> t + y.quota) div 2, 'left', cast(array() as array<struct<src:int,quota:bigint>>)), (c, y) -> {taken}, c -> c.left)"
    for level in range(shards.bit_length() - 1):
        nodes = nodes.withColumn("level", F.lit(level)).withColumn("half", F.expr(half))
        right = F.zip_with("q", "half", lambda a, b: F.struct(a["src"].alias("src"), (a["quota"] - b["quota"]).alias("quota")))
        children = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("half").alias("q")), F.struct((2 * F.col("node") + 1).alias("node"), right.alias("q")))
        nodes = nodes.select(F.inline(children))
        if level % SPREAD_LEVELS == SPREAD_LEVELS - 1:
            nodes = nodes.repartition(min(2 << level, shuffle_width(quotas.sparkSession)), "node")
    leaves = nodes.select(F.col("node").cast("int").alias("shard"), F.inline("q"))
    upto = Window.partitionBy("src").orderBy("shard")
    return leaves.where("quota > 0").withColumn("hi", F.sum("quota").over(upto)).select("src", "shard", (F.col("hi") - F.col("quota")).alias("lo"), "hi")


def _ranked(blocks: DataFrame, per_source: Column, words: bool, *key: str) -> DataFrame:
    """``blocks`` with _rank, and with _before (words ahead), in the order of column _u.

    Buckets of _u hold about BUCKET_ROWS blocks each, so no source meets in one task.
    """
    cut = blocks.withColumn("_bucket", F.floor(F.col("_u") * (1 + F.floor(per_source / BUCKET_ROWS))).cast("long"))
    earlier = Window.partitionBy("src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("src", "_bucket").agg(F.count("*").alias("_n"), F.sum("words").alias("_w"))
    base = sums.select("src", "_bucket", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_base{c}") for c in ("_n", "_w")))
    inside = Window.partitionBy("src", "_bucket").orderBy("_u", *key)
    out = cut.withColumn("_rank", F.row_number().over(inside) - 1)
    if words:
        out = out.withColumn("_before", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    out = out.join(base, ["src", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base_n"))
    return (out.withColumn("_before", F.col("_before") + F.col("_base_w")) if words else out).drop("_bucket", "_base_n", "_base_w")


def mix(sized: DataFrame, targets: DataFrame, shards: int, block_words: int = BLOCK_WORDS, seed: int = 20) -> DataFrame:
    """The blocks that the mix takes, each with the shard and the place it goes to.

    ``sized`` and ``targets`` are tables, as both are read several times.  Columns:
    doc_id, source, size, hash, copy, epoch, block, start, words (the block is the
    words from ``start`` on), shard, place (0, 1, ... in the shard).  Every document
    is taken ``epochs`` times; in one more pass, blocks in permuted order fill
    ``rest``, and the last is cut to meet it.  Documents without words are never
    taken.  A block finds its shard by a join of ranks with the shards' stretches, in
    bins about as long as a stretch.
    """
    key = ("doc_id", "size", "hash", "copy", "block")
    named = targets.withColumnRenamed("source", "_source")
    numbered = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    blocks = numbered.where("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / block_words).cast("int"))))
    blocks = blocks.withColumn("start", F.col("block").cast("long") * block_words).withColumn("words", F.least(F.lit(block_words), F.col("size") - F.col("start")))
    order = lambda what: unit_hash(F.lit(seed), F.lit(what), F.coalesce(F.col("doc_id"), F.lit(-1)), *(F.col(c) for c in key[1:]))
    partial = _ranked(blocks.where("rest > 0").withColumn("_u", order(0)), F.col("n_blocks"), True, *key).where("_before < rest")
    partial = partial.withColumn("words", F.least("words", F.col("rest") - F.col("_before"))).withColumn("epoch", F.col("epochs")).drop("_u", "_rank", "_before")
    full = blocks.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    draws = staged(full.unionByName(partial), "draws")
    quotas = draws.groupBy("src").agg(F.count("*").alias("quota"))
    stretches = split_quotas(quotas, shards, seed)
    # a row per source, as in ``targets``
    bins = quotas.select("src", F.ceil(F.col("quota") / shards).alias("_width"))
    binned = stretches.join(bins, "src").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / F.col("_width")), F.floor((F.col("hi") - 1) / F.col("_width"))))).drop("_width")
    ranked = _ranked(draws.withColumn("_u", unit_hash(F.lit(seed), order(1), F.col("epoch"))), F.col("n_blocks") * (F.col("epochs") + 1), False, *key, "epoch")
    ranked = ranked.join(bins, "src").withColumn("_bin", F.floor(F.col("_rank") / F.col("_width")))
    ranked = ranked.join(staged(binned, "shards"), ["src", "_bin"]).where("lo <= _rank and _rank < hi")
    place = Window.partitionBy("shard").orderBy(unit_hash(F.lit(seed), F.lit(2), F.col("_u"), F.col("shard")), *key, "epoch")
    ranked = ranked.withColumn("place", F.row_number().over(place) - 1)
    return ranked.select("doc_id", "source", "size", "hash", "copy", "epoch", "block", "start", "words", "shard", "place")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` as the mix takes them: a row for each pass in which a document is taken, with its text.

    A document taken whole keeps its text; of one taken in part, the words of the
    blocks taken stand in order, a space between.  ``n_chars`` follows the text.
    A shard's rows stand together, by place; a row of several blocks where its first is.
    Repeated rows are taken each for itself, a null doc_id or source is one like others,
    texts without words are never taken, and no rows give no rows.
    """
    doc, source, size, text_hash, copy = clash_free(docs, "_doc", "_source", "_size", "_hash", "_copy")
    sized = staged(sized_documents(docs), "sized")
    targets = staged(source_targets(sized, block_words=block_words), "targets")
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    drawn = mix(sized, targets, shards_for(words), block_words)
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))]
    passes = drawn.groupBy("doc_id", "source", "size", "hash", "copy", "epoch").agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("blocks"), F.sum("words").alias("taken"), F.min_by(F.struct("shard", "place"), "start").alias("at"))
    passes = passes.select(key[0].alias("_d"), key[1].alias("_s"), F.col("size").alias("_z"), F.col("hash").alias("_h"), F.col("copy").alias("_c"), F.struct("taken", "blocks", "at").alias("one"))
    passes = passes.groupBy("_d", "_s", "_z", "_h", "_c").agg(F.collect_list("one").alias("_passes"))  # no more than passes over the source
    named = docs.withColumn(doc, key[0]).withColumn(source, key[1]).withColumn(size, n_words(F.col("text"))).withColumn(text_hash, _text_hash())
    named = named.withColumn(copy, F.row_number().over(Window.partitionBy(doc, source, size, text_hash).orderBy(size)))
    # rows lie by these keys for the numbering already; the copy's own number is compared without being one, so that texts move once
    same = [F.col(a) == F.col(b) for a, b in ((doc, "_d"), (source, "_s"), (size, "_z"), (text_hash, "_h"))]
    same += [F.col(copy) <= F.col("_c"), F.col(copy) >= F.col("_c")]
    rows = named.join(passes, same).withColumn("_pass", F.explode("_passes"))
    part = let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda every: F.array_join(F.flatten(F.transform("_pass.blocks", lambda b: F.slice(every, b["start"].cast("int") + 1, b["words"].cast("int")))), " "))
    text = F.when(F.col("_pass.taken") == F.col(size), F.col("text")).otherwise(part)
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.repartition("_pass.at.shard").sortWithinPartitions("_pass.at.shard", "_pass.at.place").select(*docs.columns)


def shards_for(words: int, least: int = 64, shard_words: int = 1 << 24) -> int:
    n = max(least, -(-words // shard_words))
    return 1 << (n - 1).bit_length()


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document; draws: where its blocks go.

    A row for every row, repeated or not; null doc_ids and sources are values like others.
    """
    sized = staged(sized_documents(table(spark, sf_dir, "documents")), "sized")
    targets = staged(source_targets(sized), "targets")
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    drawn = mix(sized, targets, shards_for(words))
    key = ["doc_id", "source", "size", "hash", "copy"]
    draw = drawn.select(*key, "words", F.struct("epoch", "block", "shard", "place", "words").alias("draw"))
    both = sized.select(*key, F.lit(0).cast("long").alias("words")).unionByName(draw, allowMissingColumns=True)
    per = both.groupBy(*key).agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list("draw")).alias("draws"))
    per = per.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    return per.select("doc_id", "size", "source_size", "target", "taken", "source", "copy", "draws")
