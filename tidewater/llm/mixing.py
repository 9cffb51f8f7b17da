"""Mixing sources to target weights, over fixed-length blocks of words. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import WORD, written

WEIGHTS = (3, 1, 2)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: str = "source") -> Column:
    """A source as a text that is never null, so that joins and windows on it share a partitioning."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size) to (source, source_size, target): ``share`` of all words by weight, at most ``most`` times a source's own.

    Sources in code point order, null last, take the weights in turn. With the sources ordered by the share at which
    each meets its limit, the first j limited leave (total - their limits) / (other weights) a unit of weight; the right
    j is the least whose level the next source can take, which is also the highest such level. One row a source, so its windows need no partition.
    """
    order, cap = Window.orderBy(F.col("source").asc_nulls_last()), F.col("source_size") * F.lit(most)
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    by_cap = Window.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    before, everyone = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everyone) * F.lit(share)
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    open_at = weighed.select("source", "source_size", "w", cap.alias("cap"), level.alias("level"))
    holds = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(Window.partitionBy())
    return open_at.select("source", "source_size", F.coalesce(F.least(holds * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def permuted(i: Column, n: Column, seed: Column, rounds: int = 24) -> Column:
    """A pseudorandom permutation of 0 .. n-1 at ``i``: rounds of swap-or-not, each pairing k with (key - k) mod n."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - at, n)
        return F.when(F.pmod(F.xxhash64(seed, r, F.greatest(at, other)), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i.cast("long"), step)


def _starts(counts: DataFrame, at: str, what: str) -> DataFrame:
    """(key, at, ahead): what a source has before each of its places: sums over runs of 1024 places first, then inside each run."""
    so_far = lambda w: F.coalesce(F.sum(what).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.withColumn("run", F.floor(F.col(at) / 1024))
    runs = places.groupBy("key", "run").agg(F.sum(what).alias(what))
    runs = runs.select("key", "run", so_far(Window.partitionBy("key").orderBy("run")).alias("before"))
    inner = places.withColumn("inner", so_far(Window.partitionBy("key", "run").orderBy(at)))
    return inner.join(runs, ["key", "run"]).select("key", at, (F.col("before") + F.col("inner")).alias("ahead"))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Few wide rows dealt over the named number of partitions, so that they don't end in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shard_counts(sources: DataFrame, shards: Column, seed: int) -> DataFrame:
    """(shard, key, slots): how many of its ``slots`` each source (key, slots) has in every output shard.

    A multinomial draw over the shards with each source's total given, so totals are the targets': each slot falls into a
    shard by a hash of its source and number. Shards without a slot of a source have no row.
    """
    c = F.col
    runs = sources.withColumn("shards", shards).where("slots > 0").select("key", "slots", "shards", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((c("slots") - 1) / 1024))).alias("run"))
    each = _spread(runs, "key", "run").select("key", "shards", F.explode(F.sequence(c("run") * 1024, F.least(c("slots"), (c("run") + 1) * 1024) - 1)).alias("i"))
    return each.groupBy(F.pmod(F.xxhash64(F.lit(seed), "key", "i"), c("shards")).alias("shard"), "key").agg(F.count("*").alias("slots"))


def plan_blocks(df: DataFrame, id_col: str, text_col: str, source_col: str, block: int, share: float, most: float, weights: tuple[int, ...], seed: int, docs_per_cell: int = 512, per_shard: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Lay each source's words end to end in blocks, and draw slots for the mix.

    Returns the documents (doc_id, source, size, source_size, target, block: words of a block of its source, at: the place
    of the first word in its source; key, cell, nth: a key of the row; print: a hash of its text) and the slots (shard,
    source, key, i: the slot's number in its source, turn: its place in the round, n: blocks of the source).

    Documents follow each other in a pseudorandom order; a source is laid out in cells of a few hundred documents, so a
    source with most of the rows needs no single task. Blocks have ``block`` words, or a 512th of a smaller source. A
    source's slots are dealt to output shards of about ``per_shard`` slots by ``shard_counts`` and numbered shard by shard.
    """
    c = F.col
    rows = df.select(c(id_col).cast("long").alias("doc_id"), c(source_col).cast("string").alias("source"), n_words(c(text_col).cast("string")).alias("size"), F.xxhash64(c(text_col).cast("string")).alias("print"))
    cells = max(1, -(-df.count() // docs_per_cell))
    rows = rows.withColumn("key", _key()).withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "print"), F.lit(cells)))
    by_cell = written(rows.groupBy("key", "cell").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "cells")
    aims = targets(by_cell.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights).withColumn("key", _key())
    aims = written(aims.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(c("source_size") / 512))).cast("long")), "targets")
    inside = Window.partitionBy("key", "cell").orderBy(F.xxhash64(F.lit(seed), F.lit(1), "doc_id", "print"), "doc_id", "size", "print")
    placed = rows.withColumn("nth", F.row_number().over(inside)).withColumn("before", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(_starts(by_cell, "cell", "words").hint("merge"), ["key", "cell"]).join(aims.drop("source"), "key")
    docs = placed.select("doc_id", "source", "size", "source_size", "target", "block", (c("ahead") + c("before")).alias("at"), "key", "cell", "nth", "print")

    drawn = aims.where("source_size > 0").withColumn("n", F.ceil(c("source_size") / c("block")))
    drawn = drawn.withColumn("slots", F.least(F.round(c("target") * c("n") / c("source_size")), F.floor(c("n") * F.lit(most))).cast("long"))
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("slots").over(Window.partitionBy()) / per_shard))
    counts = written(shard_counts(drawn.select("key", "slots"), shards, seed), "counts")
    numbered = counts.join(_starts(counts, "shard", "slots"), ["key", "shard"]).join(drawn.select("key", "source", "n"), "key")
    slots = _spread(numbered, "key", "shard").select("shard", "source", "key", "n", F.explode(F.sequence(c("ahead"), c("ahead") + c("slots") - 1)).alias("i"))
    return docs, slots.withColumn("turn", c("i") % c("n"))


def with_block(slots: DataFrame, seed: int) -> DataFrame:
    """Slots with b: the block of their source that its permutation gives them."""
    return slots.withColumn("b", permuted(F.col("turn"), F.col("n"), F.xxhash64(F.lit(seed), "key")))


def overlaps(docs: DataFrame, slots: DataFrame, seed: int) -> DataFrame:
    """A row for each document and drawn block that it reaches into: its key, cell and nth, lo and hi (words of the document), times (1 or 2)."""
    c = F.col
    drawn = with_block(slots, seed).groupBy("key", "b").agg(F.count("*").alias("times"))
    spans = docs.where("size > 0").select("key", "cell", "nth", "at", "size", "block", F.explode(F.sequence(F.floor(c("at") / c("block")), F.floor((c("at") + c("size") - 1) / c("block")))).alias("b"))
    met = spans.join(drawn.hint("merge"), ["key", "b"])
    return met.select("key", "cell", "nth", F.greatest(c("b") * c("block") - c("at"), F.lit(0)).alias("lo"), F.least((c("b") + 1) * c("block") - c("at"), c("size")).alias("hi"), "times")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 256, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """doc_id, size (words), source_size, target (words of its source), taken (words that the mix takes, repeats counted).

    Words are packed into blocks by source; every source has as many slots as its target holds blocks, and a multinomial
    draw tells how many of them each output shard gets. Slots, numbered shard by shard, go round the source's permutation of
    its blocks, so a block is taken once or twice at most before any is taken again.

    A null or empty text has size 0 and takes 0. A null source is a source of its own, the last. Null ids are kept,
    repeated rows each count and get a row (a few hundred rows of one id and text are placed by one task, and more in it if
    there are more), other columns are not used, an empty table gives an empty result. Texts are only counted, one at a
    time. The sources' own table, a row each, is ordered in one task.
    """
    docs, slots = plan_blocks(df, id_col, text_col, source_col, block, share, most, weights, seed)
    docs = written(docs, "placed")
    taken = overlaps(docs, slots, seed).groupBy("key", "cell", "nth").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    met = docs.join(taken.hint("merge"), ["key", "cell", "nth"], "left")
    return met.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 256, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The mix as blocks: (shard, source, i: the slot's number in its source, b: the block that it takes), as ``mix`` takes them."""
    _, slots = plan_blocks(df, id_col, text_col, source_col, block, share, most, weights, seed)
    return with_block(slots, seed).select("shard", "source", "i", "b")


def mixed_documents(df: DataFrame, block: int = 256, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The mix itself, for documents (doc_id, text, lang, source, n_chars): the words that it takes, as documents.

    A document whose blocks are drawn gives a row with its taken words, in order and with the white space before them,
    and a second row with the words taken twice; a document of which nothing is taken gives none. Texts taken whole stay
    as they are. Null and empty texts give none; a null id, language or source is kept; repeated rows are each a document;
    other columns are not returned; an empty table gives an empty result. A text is held whole, split into its words, while
    it is cut.
    """
    c = F.col
    docs, slots = plan_blocks(df, "doc_id", "text", "source", block, share, most, weights, seed)
    docs = written(docs, "placed")
    parts = overlaps(docs, slots, seed).groupBy("key", "cell", "nth").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "times"))).alias("parts"))
    # a row finds its text by id, source and a hash of the text; rows alike in all of these are numbered on both sides
    same = Window.partitionBy("doc_id", "key", "print")
    taken = docs.withColumn("copy", F.row_number().over(same.orderBy("cell", "nth"))).join(parts.hint("merge"), ["key", "cell", "nth"])
    taken = taken.select(c("doc_id").alias("d"), c("key").alias("s"), c("print").alias("p"), c("copy").alias("k"), "parts", "size")
    texts = df.select("doc_id", "text", "lang", "source").withColumns({"key": _key(), "print": F.xxhash64("text")}).withColumn("copy", F.row_number().over(same.orderBy("lang")))
    met = texts.join(taken.hint("merge"), c("doc_id").eqNullSafe(c("d")) & (c("key") == c("s")) & (c("print") == c("p")) & (c("copy") == c("k")))
    turns = met.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("parts", lambda p: p["times"])))))
    turns = turns.withColumn("mine", F.filter("parts", lambda p: p["times"] >= c("turn")))
    words = F.aggregate("mine", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"])
    turns = turns.withColumn("tokens", F.when(words < c("size"), F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1))))
    cut = F.array_join(F.flatten(F.transform("mine", lambda p: F.slice("tokens", (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), "")
    text = F.when(c("tokens").isNull(), c("text")).otherwise(cut)
    return turns.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.char_length("text").cast("long"))
