"""Operator 1: SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints link if they differ in few bits. With radius r, the bits are labelled with vectors of
r + 1 bits; each of the 2 ** (r + 1) - 1 non-zero vectors v gives a mask of the bits whose label has
odd inner product with v. Any r bits leave some v orthogonal to all their labels, so every pair
within the radius agrees under some mask. Equal fingerprints are one node; nodes that agree under a
mask meet in a bucket. A bucket of over BUCKET nodes is masked again over the bits its mask leaves
out (a pair in it differs only there), which ends with at most 8 free bits, so 256 nodes. Within a
bucket all distances are computed but only a spanning forest of the links leaves it.

Fingerprints: a bit is set if it is in over half the shingles' XXH64 (seed 42). Null texts have no
words; no word: fingerprint zero. A node is a fingerprint, whoever holds it: rows of a null doc_id link
and bridge like any other, but a component's id is its least doc_id that is not null (null if all are).
Repeated rows get equal results; texts of any length are read whole; an empty table gives no rows. Other
columns are dropped, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import components, materialize, table

SEED = 42
BUCKET = 512


def fingerprint(text: str | None, shingle: int = 3, distinct: bool = False, seed: int = SEED) -> int:
    """distinct: each shingle counts once. Lower-cases A-Z; words are parted by ASCII white space."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    if shingle > 1:
        w = [b" ".join(t) for t in zip(*(w[k:] for k in range(shingle)))] or [b" ".join(w)]
    if distinct:
        w = set(w)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x, seed) for x in w], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = 3, distinct: bool = False, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """(key, fp0, fp1, ...): a 64-bit fingerprint, as a signed long, for each seed."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({key: batch[key]})
            for k, s in enumerate(seeds):
                out[f"fp{k}"] = np.array([signed(fingerprint(t, shingle, distinct, s)) for t in batch["text"]], dtype=np.int64)
            yield out

    return docs.select(key, "text").mapInPandas(run, ", ".join([f"`{key}` {kind}", *(f"fp{k} long" for k in range(len(seeds)))]))


def masks(bits: list[int], radius: int) -> list[int]:
    """Covering masks over the given bit places; labels go round, so each mask keeps about half of them."""
    n = 1 << (radius + 1)
    return [sum(1 << b for k, b in enumerate(bits) if ((k % n) & v).bit_count() & 1) for v in range(1, n)]


def forest(fps: np.ndarray, ids: np.ndarray, others: np.ndarray | None, radius: int, total: int) -> list[tuple[int, int]]:
    """The components of the links among distinct fingerprints of one bucket, as stars (least id, id).

    others: second fingerprints; then a link needs at most total differing bits in both. Stars of one
    group from several buckets mostly share their centre, so few distinct links are left.
    """
    n = parts = len(fps)
    label = np.arange(n)
    for k in range(n - 1):
        gap = np.bitwise_count(fps[k + 1 :] ^ fps[k])
        near = gap <= radius
        if others is not None:
            near &= gap + np.bitwise_count(others[k + 1 :] ^ others[k]) <= total
        for old in np.unique(label[k + 1 :][near]):
            if old != label[k]:
                label[label == old] = label[k]
                parts -= 1
        if parts == 1:
            break
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    root = least[label]
    return [(int(r), int(i)) for r, i in zip(root, ids, strict=True) if r != i]


def bucket_links(rows: DataFrame, radius: int, total: int, two: bool) -> DataFrame:
    """Links (a, b) among rows (id, fp, other, key...) of buckets known to be small, grouped by key and sub."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for members in batch["members"]:
                ids = np.array([m["id"] for m in members], dtype=np.int64)
                fps = np.array([m["fp"] for m in members], dtype=np.int64).view(np.uint64)
                others = np.array([m["other"] for m in members], dtype=np.int64).view(np.uint64) if two else None
                out += forest(fps, ids, others, radius, total)
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return (
        rows.groupBy("key").agg(F.collect_list(F.struct("id", "fp", "other")).alias("members")).select("members").mapInPandas(run, "a long, b long")
    )


def hashed_masks(fp, of: list[int], *salt):
    """array<struct<key,mask>>: the bucket of fp under each mask."""
    table_ = F.array(*(F.lit(signed(m)) for m in of))
    return F.transform(table_, lambda m: F.struct(F.xxhash64(fp.bitwiseAND(m), m, *salt).alias("key"), m.alias("mask")))


def links(nodes: DataFrame, radius: int = 3, total: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect the nodes (id, fp, other) just as all pairs within the radius do.

    With total, pairs must also differ in at most total bits of (fp, other) together.
    The bucket key hashes the masked bits to 64 bits; distances are checked on the bits themselves.
    """
    first = masks(list(range(64)), radius)
    two = total is not None
    # buckets are found on (id, key) alone; fingerprints are fetched for those that met another
    rows = nodes.select("id", F.explode(hashed_masks(F.col("fp"), first)).alias("x")).select("id", F.col("x.key").alias("key"), F.col("x.mask").alias("used"))
    found, level = None, 0
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        met = materialize(rows.join(counts, "key"))
        # the last level has 8 free bits at most, so its buckets are small whatever the input
        small = met if level == 2 else met.where(F.col("n") <= bucket)
        part = bucket_links(small.join(nodes, "id"), radius, total if two else 64, two)
        found = part if found is None else found.unionByName(part)
        hot = met.where(F.col("n") > bucket).drop("n")
        if level == 2 or hot.isEmpty():
            return found
        # each used mask has masks of its own over the bits it leaves out; there are few used masks
        used = sorted({r[0] for r in hot.select("used").distinct().collect()})  # at most (2 ** (radius + 1) - 1) ** level
        again = {}
        for u in used:
            free = [b for b in range(64) if not (u >> b) & 1]
            again[u] = [signed(m | (u & ((1 << 64) - 1))) for m in masks(free, radius)]
        spark = nodes.sparkSession
        deeper = spark.createDataFrame([(u, m) for u, ms in again.items() for m in ms], "used long, mask long")
        rows = hot.join(F.broadcast(deeper), "used").join(nodes, "id").select(
            "id", F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "mask", "key").alias("key"), F.col("mask").alias("used")
        )
        level += 1


def condensed(found: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the same components: a node's centres are hung below the least of them.

    A node has at most one centre in each bucket it is in, so its set is bounded by the number of masks.
    """
    sets = found.groupBy(F.col("b").alias("node")).agg(F.collect_set("a").alias("centres"))
    below = F.array_union(F.array("node"), F.col("centres"))
    return sets.select(F.explode(below).alias("a"), F.array_min("centres").alias("b")).where("a != b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) of each row: links are fingerprints within the radius."""
    fps = materialize(fingerprints(docs, key, shingle))
    nodes = materialize(fps.groupBy(F.col("fp0").alias("fp")).agg(F.min(key).alias("least")))
    roots = components(condensed(links(nodes.select(F.col("fp").alias("id"), "fp", F.lit(0).cast("long").alias("other")), radius)))
    # a fingerprint without links is its own root; the least ids are combined before any exchange
    placed = materialize(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(named, "root").select("fp", "component_id")
    return fps.join(of, F.col("fp0") == F.col("fp"), "left").select(
        key, F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: The pipeline's near copies: distinct five-word shingles, LIKE[0] of LIKE[1] alike or more.
SHINGLE = 5
LIKE = (4, 5)
#: MinHash bytes of a text: BANDS bands of BAND bytes, of which the first SKETCH are compared inside a bucket.
BANDS, BAND, SKETCH = 32, 6, 64
#: Words of one block of texts that are compared in one task.
BLOCK_WORDS = 1_000_000
ODD = np.array([xxhash.xxh64_intdigest(b"minhash", k) | 1 for k in range(BANDS * BAND)], dtype=np.uint64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct shingles; a text of fewer words is one shingle, one of no word has none."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))
    size = min(shingle, len(w))
    out = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def minhash(shingles: np.ndarray) -> bytes:
    """A byte for each multiplier, of the least product; zeros for no shingle."""
    if not len(shingles):
        return bytes(len(ODD))
    least = np.full(len(ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (ODD[:, None] * shingles[None, at : at + 1024]).min(axis=1), out=least)
    least ^= least >> np.uint64(32)
    return (least * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(56)).astype(np.uint8).tobytes()


def minhashes(docs: DataFrame) -> DataFrame:
    """(node, words, sig, fp) of each row of (node, text): its number of shingles, MinHash bytes and SimHash fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = map(one, batch["text"])  # no text's shingles outlive it
            out = pd.DataFrame(rows, columns=["words", "sig", "fp"])
            out.insert(0, "node", batch["node"])
            yield out

    def one(text: str | None) -> tuple[int, bytes, int]:
        own = shingle_hashes(text)
        return len(own), minhash(own), signed(fingerprint(text))

    return docs.select("node", "text").mapInPandas(run, "node long, words long, sig binary, fp long")


def spanning(near, n: int) -> np.ndarray:
    """A label for each of n items; near(k) tells which items item k links to."""
    label, parts = np.arange(n), n
    for k in range(n):
        if parts == 1:
            break
        for old in np.unique(label[near(k)]):
            if old != label[k]:
                label[label == old] = label[k]
                parts -= 1
    return label


def centred(label: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Stars (least id, id) of each label."""
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return [(int(r), int(i)) for r, i in zip(least[label], ids, strict=True) if r != i]


def covered(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) among nodes (node, fp) that connect all whose fingerprints are within the radius, by covering masks.

    Nodes of one fingerprint are hung below the least of them, which then stands for all.
    """
    least = materialize(nodes.groupBy("fp").agg(F.min("node").alias("id")))
    found = links(least.select("id", "fp", F.lit(0).cast("long").alias("other")), radius)
    same = nodes.join(least, "fp").where("node != id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    return found.unionByName(same)


def candidates(nodes: DataFrame, bucket: int) -> DataFrame:
    """Links (a, b) among nodes (node, sig) that connect all pairs that may be near copies by MinHash.

    Two texts that are 0.8 alike agree in a band of BAND bytes with 0.26, so in one of BANDS with 0.9999,
    whatever the edit. Within a bucket half of the sketch must agree (0.8 alike: six deviations above that);
    a bucket of over bucket nodes is linked as a whole.
    """
    keys = F.array(*(F.xxhash64(F.substring("sig", 1 + BAND * k, BAND), F.lit(k)) for k in range(BANDS)))
    rows = nodes.select("node", F.explode(keys).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a")).where("n > 1")
    met = materialize(rows.join(counts, "key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for members in batch["members"]:
                ids = np.array([m["node"] for m in members], dtype=np.int64)
                sketch = np.frombuffer(b"".join(bytes(m["sketch"]) for m in members), dtype=np.uint8).reshape(len(ids), -1)
                out += centred(spanning(lambda k, x=sketch: (x == x[k]).sum(axis=1) * 2 >= SKETCH, len(ids)), ids)
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    small = met.where(F.col("n") <= bucket).select("node", "key").join(nodes.select("node", F.substring("sig", 1, SKETCH).alias("sketch")), "node")
    buckets = small.groupBy("key").agg(F.collect_list(F.struct("node", "sketch")).alias("members")).select("members")
    return buckets.mapInPandas(run, "a long, b long").unionByName(met.where((F.col("n") > bucket) & (F.col("node") != F.col("a"))).select("a", F.col("node").alias("b")))


class Shingled:
    """Texts as sets of shingles; near(k) tells which of them are near copies of text k by all their shingles."""

    def __init__(self, texts: list[str | None]):
        sets = [shingle_hashes(t) for t in texts]
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        self.vocab, self.place = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        self.first = np.cumsum(self.size) - self.size

    def near(self, k: int) -> np.ndarray:
        own = np.zeros(len(self.vocab), dtype=bool)
        own[self.place[self.first[k] : self.first[k] + self.size[k]]] = True
        both = np.bincount(self.owner[own[self.place]], minlength=len(self.size))
        return both * LIKE[1] >= (self.size + self.size[k] - both) * LIKE[0]


def exact_links(ids: np.ndarray, texts: list[str | None]) -> list[tuple[int, int]]:
    """The components of the pairs that are near copies, as stars (least id, id)."""
    return centred(spanning(Shingled(texts).near, len(ids)), ids)


def joining_links(ids: np.ndarray, texts: list[str | None], asked: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) of asked texts to others that join what has different labels; one for each two labels that meet."""
    shingled, out = Shingled(texts), []
    label = np.unique(labels, return_inverse=True)[1]
    for k in np.flatnonzero(asked):
        near = np.flatnonzero(shingled.near(k))
        for old in np.unique(label[near]):
            if old != label[k]:
                out.append((int(ids[k]), int(ids[near[label[near] == old][0]])))
                label[label == old] = label[k]
    return out


def verified(docs: DataFrame, groups: DataFrame, block_words: int) -> DataFrame:
    """Links (a, b) that connect the true near copies within candidate groups (node, root, id, words).

    docs: (node, id, text). A group of over block_words shingles is dealt into blocks. First each block is compared
    in itself and with the root's text; then what is not connected to the root, by blocks, with every block. So no
    pair of texts that are not connected yet is left out, no task holds a whole group, and a group of copies of one
    text costs work in proportion to its size.
    """
    sizes = groups.groupBy("root").agg(F.greatest(F.ceil(F.sum("words") / block_words), F.lit(1)).cast("int").alias("blocks"))
    placed = materialize(groups.join(sizes, "root").select("node", "id", "root", "words", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("own")))

    def texts(of: DataFrame) -> DataFrame:
        """of with the text of each of its nodes (which have an id each)."""
        d = docs.withColumnsRenamed({"node": "_node", "id": "_id"})
        return d.join(of, (F.col("_node") == F.col("node")) & F.col("_id").eqNullSafe(F.col("id"))).dropDuplicates(["node"]).drop("_node", "_id")

    def spread(rows: DataFrame, column: str, over: str) -> DataFrame:
        """Each row for every number under `over`."""
        return rows.withColumn(column, F.explode(F.sequence(F.lit(0), F.col(over) - 1)))

    own = texts(placed).select("root", "own", "node", "text")
    roots = spread(texts(placed.where((F.col("node") == F.col("root")) & (F.col("blocks") > 1))), "block", "blocks").where("block != own")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(exact_links(part["node"].to_numpy(), part["text"].tolist()), columns=["a", "b"], dtype=np.int64)

    first = own.unionByName(roots.select("root", F.col("block").alias("own"), "node", "text")).groupBy("root", "own").applyInPandas(compare, "a long, b long")
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return first
    first = materialize(first)
    of = components(first)
    label = large.join(of.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    label = materialize(label.join(label.where(F.col("node") == F.col("root")).select("root", F.col("label").alias("main")), "root"))
    apart = label.where(F.col("label") != F.col("main"))
    if apart.isEmpty():
        return first
    parts = apart.groupBy("root").agg(F.greatest(F.ceil(F.sum("words") / block_words), F.lit(1)).cast("int").alias("parts"))
    label = label.join(parts, "root")
    asked = spread(texts(label.where(F.col("label") != F.col("main")).withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), "parts").cast("int"))), "block", "blocks")
    others = spread(texts(label), "part", "parts").withColumn("block", F.col("own"))
    fields = ["root", "block", "part", "node", "label", "text"]
    both = asked.select(*fields, F.lit(True).alias("asked")).unionByName(others.select(*fields, F.lit(False).alias("asked")))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("asked", ascending=False, kind="stable").drop_duplicates("node")
        found = joining_links(part["node"].to_numpy(), part["text"].tolist(), part["asked"].to_numpy(), part["label"].to_numpy())
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return first.unionByName(both.groupBy("root", "block", "part").applyInPandas(join, "a long, b long"))


def text_hash(text="text"):
    """Stands for a text; null is the empty one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def representatives(docs: DataFrame, key: str = "doc_id", bucket: int = 16 * BUCKET, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(node, id, group, group_node) of each distinct text: its hash, its least key, and the key and text hash that stand for its group.

    Distinct texts link if their five-word shingles are 0.8 alike or more, which is checked on all shingles;
    groups are the components. The least key stands for a group (null only if all are null), of equal keys the least text hash.
    """
    rows = docs.select(F.col(key).alias("id"), text_hash().alias("node"), "text")
    least = rows.groupBy("node").agg(F.min("id").alias("id"))
    nodes = materialize(minhashes(rows).dropDuplicates(["node"]))
    # covering SimHash finds the nearest copies, MinHash bands those that its radius can't span
    roots = components(condensed(covered(nodes).unionByName(candidates(nodes, bucket))))
    groups = materialize(roots.join(nodes.select("node", "words"), "node").join(least, "node"))
    of = components(verified(rows, groups, block_words)).join(groups.select("node", "id"), "node")
    best = of.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best"))
    stand = of.join(best, "root").select("node", F.col("best.id").alias("group"), F.col("best.node").alias("group_node"))
    own = F.col("group_node").isNull()
    return least.join(stand, "node", "left").select(
        "node", "id", F.when(own, F.col("id")).otherwise(F.col("group")).alias("group"), F.when(own, F.col("node")).otherwise(F.col("group_node")).alias("group_node")
    )


def robust_groups(docs: DataFrame, key: str = "doc_id", bucket: int = 16 * BUCKET, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, node, group, group_node) of each row, by representatives()."""
    rows = docs.select(key, text_hash().alias("node"))
    return rows.join(representatives(docs, key, bucket, block_words).drop("id"), "node").select(key, "node", "group", "group_node")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
