"""Document fingerprints by one-permutation MinHash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 128
BITS = 8
SHINGLE = 5
#: Probes for an empty bin before the rank among all filled bins decides.
PROBES = 6


def _bin(hash_: Column) -> Column:
    """A hash's bin by its top seven bits, in the order of signed longs."""
    return F.call_function("shiftrightunsigned", hash_, F.lit(57)).bitwiseXOR(F.lit(64)).cast("int")


def _bit(mask: Column, at: Column) -> Column:
    return F.call_function("shiftright", mask, at).bitwiseAND(F.lit(1)) == 1


def with_fingerprint(df: DataFrame, text: str, out: str, size: int = SHINGLE) -> DataFrame:
    """Add ``out``: the low byte of each of the 128 bins' least shingle hash, as array<tinyint>; empty for no word.

    Every shingle of ``size`` words (the whole sequence if shorter) is hashed once; its top bits name its bin, and a bin
    keeps its least hash. An empty bin takes over the value of a filled one: the first filled one of a few that a hash
    of (bin, probe) names, else the filled one of least hash of (bin, filled bin). Both depend on the filled bins only,
    are spread evenly and independent for each empty bin, so likeness stays unbiased.
    """
    c, made = F.col, ["_w", "_h", "_s", "_m", "_lo", "_hi"]
    df = df.withColumn("_w", F.array_remove(F.split(c(text), "[ \t\n\x0b\f\r]+"), ""))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    runs = F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[c("_h")[i + k] for k in range(1, size)]))
    short = F.when(F.size("_h") > 0, F.array(F.xxhash64(F.concat_ws(" ", "_w")))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_s", F.sort_array(F.when(F.size("_h") >= size, runs).otherwise(short)))
    df = df.withColumn("_m", F.filter("_s", lambda x, i: (i == 0) | (_bin(x) != _bin(c("_s")[F.greatest(i - 1, F.lit(0))]))))

    def mask(low: int) -> Column:
        one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), _bin(x) - low)
        return F.aggregate(F.filter("_m", lambda x: (_bin(x) >= low) & (_bin(x) < low + 64)), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(one(x)))

    df = df.withColumns({"_lo": mask(0), "_hi": mask(64)})
    filled = lambda at: _bit(F.when(at < 64, c("_lo")).otherwise(c("_hi")), at % 64)

    def pick(j: Column) -> Column:
        probes = [F.pmod(F.xxhash64(j, F.lit(p)), F.lit(BINS)).cast("int") for p in range(PROBES)]
        last = F.array_min(F.transform("_m", lambda x: F.struct(F.xxhash64(F.lit(-1), j, _bin(x)).alias("h"), _bin(x).alias("b"))))["b"]
        found = F.when(filled(j), j)
        for p in probes:
            found = found.when(filled(p), p)
        return found.otherwise(last)

    def rank(at: Column) -> Column:
        """How many filled bins lie before a bin: its place in the list of minima."""
        below = lambda m, k: F.bit_count(m.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), k))))
        return F.when(at < 64, below(c("_lo"), at)).otherwise(F.bit_count("_lo") + below(c("_hi"), at - 64))

    picks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), pick)
    lows = F.transform(picks, lambda at: (c("_m")[rank(at)].bitwiseAND(F.lit(255)) - 128).cast("tinyint"))
    return df.withColumn(out, F.when(F.size("_m") > 0, lows).otherwise(F.array().cast("array<tinyint>"))).drop(*made)


def packed(lows: Column) -> Column:
    """The fingerprint as text: two hex digits a bin; all zeros for a text without words."""
    digits = F.array_join(F.transform(lows, lambda v: F.lpad(F.hex(v.cast("int") + 128), 2, "0")), "")
    return F.when(F.size(lows) > 0, F.lower(digits)).otherwise("0" * (2 * BINS))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness: the share of equal bins less the share that equal low bits reach by chance.

    1 for two texts without words, 0 if only one has none.
    """
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, e: n + e) / float(BINS)
    chance = 2.0**-BITS
    none = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(none == 2, 1.0).when(none == 1, 0.0).otherwise(F.greatest((equal - chance) / (1 - chance), F.lit(0.0)))


def _buckets(ids: DataFrame, count: int) -> tuple[Column, list[int]]:
    """The bucket of ``doc_id`` between quantiles (a few hundred ids each; 65,536 buckets at most), and the bounds."""
    n = max(1, min(count // 128, 65_536))
    if n == 1:
        return F.lit(0), []
    found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0]
    bounds = sorted(set(found or []))
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    under = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("doc_id")))
    coarse = under(F.array(*[F.lit(g[-1]).cast("long") for g in groups]))
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups], F.array().cast("array<bigint>"))
    return coarse * step + under(F.element_at(fine, coarse + 1)), bounds


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """A row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones (or all) of the next
    document's, by ascending doc_id, after the last the first. Texts of a few hundred neighbouring ids meet in one bucket
    between quantiles of the ids; the first document of a bucket is also sent to the bucket before, so each text is
    shuffled once. A null text is empty. Equal ids follow each other by text. A row with a null id is no one's next and
    has an empty text next. A single row is its own next. Other columns, whatever their names, are not used; an empty
    table gives an empty result. A text is held whole as a row, with 8 bytes a word for its hashes; rows of one id are ordered by
    one task, which spills them if they are many.
    """
    c = F.col
    docs = df.select(c(id_col).cast("long").alias("doc_id"), F.coalesce(c(text_col).cast("string"), F.lit("")).alias("text"))
    ids = df.select(c(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    bucket, _ = _buckets(ids, ids.count())
    firsts = sorted((r["bucket"], r["doc_id"]) for r in ids.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("doc_id")).collect())  # a row a bucket
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    came = F.array(*[F.lit(before.get(b, 0)) for b in range(max(before, default=0) + 1)])
    known = docs.where("doc_id IS NOT NULL").withColumn("bucket", bucket)
    is_first = c("doc_id").isin([i for _, i in firsts]) if firsts else F.lit(False)
    places = F.when(is_first, F.array(F.struct(F.lit(False).alias("ghost"), c("bucket").alias("at")), F.struct(F.lit(True).alias("ghost"), F.element_at(came, c("bucket") + 1).alias("at"))))
    dealt = known.withColumn("place", F.explode(places.otherwise(F.array(F.struct(F.lit(False).alias("ghost"), c("bucket").alias("at"))))))
    dealt = dealt.select("doc_id", "text", c("place.ghost").alias("ghost"), c("place.at").alias("at"))
    own = with_fingerprint(dealt, "text", "own", size)
    ahead = Window.partitionBy("at").orderBy("ghost", "doc_id", "text")
    met = own.withColumns({"next": F.lead("text").over(ahead), "next_own": F.lead("own").over(ahead)}).where(~c("ghost"))
    alone = with_fingerprint(docs.where("doc_id IS NULL"), "text", "own", size)
    alone = alone.select("doc_id", "text", "own", F.lit("").alias("next"), F.array().cast("array<tinyint>").alias("next_own"))
    both = met.select("doc_id", "text", "own", "next", "next_own").unionAll(alone)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next", F.lit(1), half))
    both = both.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    done = with_fingerprint(both, "edited", "other", size)
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(c("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(c("own")).alias("fingerprint"),
        packed(c("other")).alias("edited_fingerprint"),
        likeness(c("own"), c("other")).alias("near_edited"),
        likeness(c("own"), c("next_own")).alias("near_next"),
    )
