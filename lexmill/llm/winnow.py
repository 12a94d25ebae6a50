"""Operator 4: document fingerprints by winnowing, with DataFrame functions only.

A text's tokens are its single non-blank characters (code points), so grams begin at every character and
no script needs blanks. Every K successive tokens give a hash; of every WINDOW successive hashes the least
is chosen, the rightmost of equal ones, and kept with its position (blanks are not counted). So two texts
that share K + WINDOW - 1 successive tokens share a chosen hash. A text of fewer than K tokens is one gram,
one of fewer hashes than WINDOW is one window.

A fingerprint is written as position:hash pairs; likeness is the Jaccard index of the chosen hashes
(1 if both are empty). Equal texts have equal fingerprints. Null text counts as empty.

The next document is that of the next lower doc_id (null is the lowest; after the last comes the
first). If rows share a doc_id, the greatest text among them stands for it as a next document.
Other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import materialize, table

#: Characters of a token, of a gram and hashes of a window.
TOKEN = 1
K = 20
WINDOW = 44
#: Blocks of a window, whose minima are computed first.
BLOCKS = 4
LOW = (1 << 31) - 1
#: Stands for a null doc_id in joins.
NULL_ID = -(1 << 63)


def bound(c, f):
    """f(c), with c computed once by a one-element transform, else it would be computed for every use."""
    return F.element_at(F.transform(F.array(c), f), 1)


def bare(text):
    """The text without its blanks."""
    return F.regexp_replace(text, r"\s+", "")


def position(picked):
    return F.lit(LOW) - picked.bitwiseAND(F.lit(0xFFFFFFFF))


def steps(window: int) -> list[list[int]]:
    """Offsets of each pass of minima(): up to four neighbouring minima give one over as many times the values, up to the window."""
    out, n = [], 1
    while n < window:
        m = min(4, -(-window // n))
        out.append([min(j * n, window - n) for j in range(1, m)])
        n = min(m * n, window)
    return out


def minima(g, window: int):
    """The least of each value and those after it, window values in all (fewer at the end); a window cut out at each place would be 44 steps a character."""

    def wider(offsets):
        return lambda m: F.transform(m, lambda x, i: F.least(x, *(F.get(m, i + n) for n in offsets)))

    for offsets in steps(window):
        g = bound(g, wider(offsets))
    return g


def window_minima(g, base, window: int):
    """The distinct least values of the windows of g, by position: minima of blocks of a quarter window first, then only what is less.

    A window begins in a block, holds the three after it and ends in the fourth. Where neither end has a value below
    the three blocks' least, that is the minimum of all windows that begin in the block; else the minimum changes only
    where a lesser value of the first block has left or one of the last has entered.
    """
    step = window // BLOCKS
    last = F.greatest(F.size(g) - window, F.lit(0))
    place = lambda x: (F.lit(LOW) - base - x.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")

    def ends(at, most):
        def changes(less):
            starts = F.transform(less, lambda x: bound(place(x), lambda p: F.when(p < at + step, p + 1).otherwise(p - (window - 1))))
            starts = F.filter(F.sort_array(F.concat(F.array(at), starts)), lambda s: s <= last)
            return F.transform(starts, lambda s: F.least(most, F.get(F.sort_array(F.filter(less, lambda x: place(x).between(s, s + (window - 1)))), F.lit(0))))

        some = lambda first: F.filter(F.slice(g, first + 1, step), lambda x: x < most)
        return bound(F.concat(some(at), some(at + window)), changes)

    def every(m):
        def one(at, i):
            middle = F.coalesce(F.least(*(F.get(m, i + n) for n in range(1, BLOCKS))), F.lit((1 << 63) - 1))
            return bound(middle, lambda most: F.when(F.least(F.get(m, i), F.get(m, i + BLOCKS)) > most, F.array(most)).otherwise(ends(at, most)))

        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), last, F.lit(step)), one)))

    blocks = F.transform(F.sequence(F.lit(0), F.size(g) - 1, F.lit(step)), lambda at: F.least(*(F.get(g, at + n) for n in range(step))))
    return bound(blocks, every)


def picks(solid, base=0, k: int = K, window: int = WINDOW):
    """array<long>: hash << 32 | (LOW - position) of each chosen gram of a text without blanks, by position; base: the first position."""
    none = F.array().cast("array<long>")

    def grams(t):
        last = F.greatest(F.size(t) - k, F.lit(0))
        def one(i):  # noqa: E306
            # a hash of several values is that of each in turn; there is none past the end
            h = F.xxhash64(*(F.get(t, i + n) for n in range(k)))
            return F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(LOW << 32)) + (F.lit(LOW) - base - i)
        return F.transform(F.sequence(F.lit(0), last), one)

    def least(g):
        if window % BLOCKS == 0 and window > BLOCKS:
            return window_minima(g, base, window)
        return F.array_distinct(F.slice(minima(g, window), 1, F.greatest(F.size(g) - window, F.lit(0)) + 1))

    return bound(solid, lambda x: F.when(x == "", none).otherwise(bound(bound(F.transform(F.split(x, ""), lambda c: c.cast("binary")), grams), least)))


def chosen(text, k: int = K, window: int = WINDOW):
    """picks() of a text with blanks."""
    return picks(bare(text), k=k, window=window)


def gram_blocks(rows: DataFrame, keys: list[str], k: int = K, window: int = WINDOW) -> DataFrame:
    """(keys, at, begins, g) of rows (keys, text): blocks of a quarter window of packed grams from `at` on, null past the last; begins: where the last window begins.

    A block is a row, so its hashes are compiled; in a lambda they are interpreted, value by value.
    """
    step = window // BLOCKS
    solid = rows.select(*keys, bare(F.col("text")).alias("solid")).where("solid != ''").select(*keys, F.split("solid", "").alias("t"))
    solid = solid.select(*keys, "t", F.greatest(F.size("t") - k, F.lit(0)).alias("last"))
    solid = solid.select(*keys, "t", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(step))).alias("at"))

    def packed(j: int):
        # a hash of an array is that of its values in turn
        h = F.xxhash64(F.slice("t", F.col("at") + (j + 1), k))
        return F.when(F.col("at") + j <= F.col("last"), F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(LOW << 32)) + (F.lit(LOW - j) - F.col("at")))

    return solid.select(*keys, "at", F.greatest(F.col("last") + 1 - window, F.lit(0)).alias("begins"), F.array(*map(packed, range(step))).alias("g"))


def picked_rows(rows: DataFrame, keys: list[str], k: int = K, window: int = WINDOW) -> DataFrame:
    """(keys, picked): chosen() of the text of each of rows (keys, text) that isn't blank; keys tell texts apart. No exchange if rows lie by a key.

    A window begins in a block, holds the BLOCKS - 1 after it and ends in the one after those, so its least value is
    that of the first block's end, those blocks and the last block's beginning.
    """
    step = window // BLOCKS
    after = Window.partitionBy(*keys).orderBy("at")
    least = lambda some: F.least(*some) if len(some) > 1 else F.col(some[0])
    g, h, m = ([f"{x}{j}" for j in range(n)] for x, n in (("g", step), ("h", step), ("m", BLOCKS)))
    # the JVM compiles no method of over 8,000 bytes, so the minima are taken in two steps with a window function between them
    met = gram_blocks(rows, keys, k, window).select(*keys, "at", "begins", "g", F.lead("g", BLOCKS).over(after).alias("h"))
    met = met.select(*keys, "at", "begins", *(F.get(x, F.lit(j)).alias(f"{x}{j}") for x in "gh" for j in range(step)))
    met = met.select(*keys, "at", "begins", least(g).alias("m0"), F.array(*(least(g[j:]) for j in range(step))).alias("ends"), F.array(*(least(h[: j + 1]) for j in range(step))).alias("starts"))
    met = met.select(*keys, "at", "begins", "ends", "starts", *(F.lead("m0", j).over(after).alias(m[j]) for j in range(1, BLOCKS)))
    met = met.where(F.col("at") <= F.col("begins")).select(*keys, "at", "begins", "ends", "starts", least(m[1:]).alias("middle"))

    def first(o: int):
        parts = [F.get("ends", F.lit(o)), F.col("middle"), *([F.get("starts", F.lit(o - 1))] if o else [])]
        return F.when(F.col("at") + o <= F.col("begins"), F.least(*parts))

    each = met.select(*keys, F.struct("at", F.array_distinct(F.array(*map(first, range(step)))).alias("x")).alias("x"))
    each = each.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return each.select(*keys, F.array_compact(F.array_distinct(F.flatten("x.x"))).alias("picked"))


def chosen_again(picked, head, tail, k: int = K, window: int = WINDOW):
    """chosen() of head + tail, where picked are those of a text that begins with head.

    The windows within head are known, so only the last of them and those that follow are computed.
    """
    span = k + window - 1

    def joined(x):
        start = F.greatest(x["n"] - span, F.lit(0))
        new = picks(F.substring(x["all"], start + 1, F.char_length(x["all"])), start, k, window)
        # chosen positions only grow from window to window
        known = lambda y: F.when(x["n"] >= span, F.filter(picked, lambda z: position(z) < position(F.get(y, F.lit(0))))).otherwise(F.array().cast("array<long>"))
        return bound(new, lambda y: F.concat(known(y), y))

    return bound(bare(head), lambda h: bound(F.struct(F.char_length(h).alias("n"), F.concat(h, bare(tail)).alias("all")), joined))


def hashes(picked):
    """The chosen hashes of chosen()."""
    return F.array_distinct(F.transform(picked, lambda x: F.shiftright(x, 32).cast("int")))


def written(picked):
    """The fingerprint as text."""
    return F.array_join(F.transform(picked, lambda x: F.concat_ws(":", (F.lit(LOW) - x.bitwiseAND(F.lit(0xFFFFFFFF))).cast("string"), F.lower(F.hex(F.shiftright(x, 32))))), " ")


def likeness(a, b):
    """Jaccard index of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def neighbours(ids: DataFrame) -> DataFrame:
    """(id, next_id) of distinct ids in descending order, in a circle; ids are ranked by ranges, not in one task."""
    parts = max(8, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(
        ids.repartitionByRange(parts, F.desc("id")).sortWithinPartitions(F.desc("id")).withColumn("m", F.monotonically_increasing_id())
    ).select("id", F.shiftright("m", 33).cast("int").alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"), F.sum("n").over(Window.partitionBy()).alias("all"))
    ranked = placed.join(F.broadcast(before), "part").select("id", (F.col("base") + F.col("at")).alias("rank"), "all")
    after = ranked.select(F.col("id").alias("next_id"), F.pmod(F.col("rank") - 1, F.col("all")).alias("rank"))
    return ranked.select("id", "rank").join(after, "rank").select("id", "next_id")


def edited_pairs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited text digest, both fingerprints, likeness to the edited and to the next document)."""
    raw = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    third = lambda c: F.floor(F.char_length(c) / 3).cast("int")
    ids = materialize(raw.groupBy("id").agg(F.max(third("text")).alias("need"), F.count("*").alias("n")))
    repeated = not ids.where("n > 1").isEmpty()
    # one exchange of the texts and one of what is chosen of them, which both branches below read: the number keeps filters from
    # being pushed below the first, and the id is negated twice so that the second isn't taken for needless and all is computed twice
    texts = raw.repartition("id").withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("text")))
    chosen_ = picked_rows(texts, ["id", "nth"]).select(F.bitwise_not(F.bitwise_not("id")).alias("id"), "nth", "picked").repartition("id")
    # a join by both keys would exchange the texts once more
    base = texts.join(chosen_, ["id", "nth"], "left") if repeated else texts.join(chosen_.drop("nth"), "id", "left")
    base = base.select("id", "text", F.coalesce("picked", F.array().cast("array<long>")).alias("picked"))
    asked = neighbours(ids.select("id")).join(ids.select("id", "need"), "id").select(F.col("id").alias("asker"), F.col("next_id").alias("id"), "need")
    heads = base.join(asked, "id").select("asker", "need", "text", "picked")
    if repeated:
        best = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("text")))
        heads = heads.withColumn("_n", best).where("_n = 1")
    heads = heads.select(F.col("asker").alias("id"), F.substring("text", F.lit(1), F.col("need")).alias("head"), hashes(F.col("picked")).alias("next_hashes"))
    # only heads and hashes move again for this join
    joined = base.join(heads, "id").select(
        F.when(F.col("id") != NULL_ID, F.col("id")).cast(docs.schema[key].dataType).alias(key), F.char_length("text").cast("long").alias("n_chars"), "picked", "next_hashes",
        F.substring("text", F.lit(1), F.char_length("text") - third("text")).alias("start"), F.substring("head", F.lit(1), third("text")).alias("end"),
    )
    joined = joined.withColumn("edited", F.concat("start", "end")).withColumn("edited_picked", chosen_again(F.col("picked"), F.col("start"), F.col("end")))
    own, other = hashes(F.col("picked")), hashes(F.col("edited_picked"))
    return joined.select(
        key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("picked")).alias("fingerprint"), written(F.col("edited_picked")).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, F.col("next_hashes")).alias("near_next"),
    )


def fingerprint(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint array<struct<position,hash>>) of each row."""
    picked = chosen(F.coalesce("text", F.lit("")))
    return docs.select(key, F.transform(picked, lambda x: F.struct((F.lit(LOW) - x.bitwiseAND(F.lit(0xFFFFFFFF))).alias("position"), F.shiftright(x, 32).alias("hash"))).alias("fingerprint"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
