"""Near-duplicate documents by min-max hashing.

Each permutation of the shingles gives two signature entries, its minimum and
its maximum, so a signature costs half the hash evaluations of plain MinHash
and estimates the similarity with lower variance. Bands of a signature name
buckets; documents of a bucket are compared by their full shingle sets.

Pairs are never formed all against all. Documents with equal sets are one
class. Where few of a bucket's members lie outside its largest component, those
few are compared with its members, which is linear in the bucket. In any other
bucket everyone is compared with one hub, the document that is met in most
buckets, and those that this leaves over with a second one. After that only
documents that link with few others are left apart. Their pairs come from buckets
with up to MANY members outside the largest component, but only those whose
difference a 1024-bit parity map of the sets does not prove too large. In buckets
beyond that hubs go on, and no pair is lost for it: what two members share is in
the hub or not, so what they have in common with the hub, and the shingles outside
it that other components have as well, bound their similarity. Most members cannot
reach the threshold with anyone by these numbers. The rest meet in new, smaller
buckets named by their rarest such shingles (a prefix filter with positions),
which are treated alike.
"""

from __future__ import annotations

import math
from functools import lru_cache
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Memo, map_arrow, materialise

#: Signature entries per band; even, as each permutation gives two.
ROWS = 6
#: Chance that a pair right at the threshold shares no bucket.
MISS = 1e-8
#: A bucket with at most so many members outside its largest component needs no
#: hub: in the first two rounds, and after them, where parity maps are looked at first.
FEW, MANY = 8, 4096
#: Bits of a parity map, in words of 64.
MAP_WORDS = 16
SEED = 20240229


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair at the threshold is missed with chance ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows))))


class Shingler:
    """Sets of hashed word shingles of a text given as UTF-8 bytes."""

    MEMO = 300_000

    def __init__(self, words: int):
        self.words = words
        self.hash = Memo(xxhash.xxh3_64_intdigest, self.MEMO)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Distinct shingles, sorted. A-Z are lower-cased; words end at ASCII white space.

        With fewer words than a shingle has, the whole sequence is one;
        without words there is none.
        """
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        h = np.fromiter(map(self.hash.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.words, len(words))
        out = np.full(len(words) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(words) - k + 1 + j]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


class MinMaxHasher:
    """Band keys of a shingle set, from minima and maxima under seeded permutations."""

    BLOCK = 2048

    def __init__(self, bands: int, rows: int = ROWS, seed: int = SEED):
        if rows % 2:
            raise ValueError("rows must be even: a permutation gives two entries")
        self.bands, self.rows = bands, rows
        n = bands * rows // 2
        draw = np.random.default_rng(seed)
        top = np.iinfo(np.uint64).max
        self.xor = draw.integers(0, top, n, dtype=np.uint64)[:, None]
        self.odd = draw.integers(0, top, n, dtype=np.uint64)[:, None] | np.uint64(1)
        self.fold = draw.integers(0, top, rows, dtype=np.uint64) | np.uint64(1)
        self.salt = draw.integers(0, top, bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """``[permutation, (min, max)]`` of a non-empty set; memory is bounded by BLOCK."""
        low = high = None
        for at in range(0, len(shingles), self.BLOCK):
            image = (shingles[at : at + self.BLOCK] ^ self.xor) * self.odd
            a, b = image.min(axis=1), image.max(axis=1)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        return np.stack([low, high], axis=1)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        entries = self.signature(shingles).reshape(self.bands, self.rows)
        out = self.salt.copy()
        for j in range(self.rows):
            out = (out ^ entries[:, j]) * self.fold[j]
            out ^= out >> np.uint64(31)
        return out.view(np.int64)


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """Bit i says whether an odd number of shingles has hash i: two sets differ in at least as many elements as their maps in bits."""
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % (64 * MAP_WORDS), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@lru_cache(maxsize=4)
def _shingler(words: int) -> Shingler:
    return Shingler(words)


def signatures(df: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int = ROWS) -> DataFrame:
    """``(id, n, key, buckets, map)`` per row: set size, digest of the whole set, band keys, parity map."""
    id_type = df.schema[id_col].dataType

    def run(batches):
        shingle, hasher = _shingler(words), MinMaxHasher(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, digests, keys, maps = [], [], [], []
                for text in part.column(1).to_pylist():
                    own = shingle(text)
                    sizes.append(len(own))
                    digests.append(blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    keys.append(hasher.keys(own) if len(own) else np.empty(0, dtype=np.int64))
                    maps.append(parity_map(own))
                ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(maps, pa.list_(pa.int64()))], ["id", "n", "key", "buckets", "map"])

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(slim, run, f"id {id_type.simpleString()}, n long, key binary, buckets array<long>, map array<long>")


def _merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting both sides: what is joined here grows with the data, so it is never broadcast."""
    return left.join(right.hint("merge"), on, how)


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs (a, b, ...)`` with both texts, the rows of one ``a`` together. Texts travel, not sets: they are smaller."""
    joined = _merged(pairs, texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    return _merged(joined, texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")


def _pairs_of_sets(batch, shingle, held: dict):
    """Both sets of each row; the set of ``a`` is built once for the rows that follow each other."""
    for x, left, right in zip(batch.column(0).to_pylist(), batch.column("left"), batch.column("right"), strict=True):
        text = left.as_py()
        if held.get("key") != (x, text):
            held.update(key=(x, text), set=shingle(text))
        yield held["set"], shingle(right.as_py())


def compare(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``(a, b, common, linked)`` of ``pairs (a, b)``, from the full sets."""
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("a", "b"))

    def run(batches):
        shingle, held = _shingler(words), {}
        for batch in batches:
            common, linked = [], []
            for p, q in _pairs_of_sets(batch, shingle, held):
                c = len(np.intersect1d(p, q, assume_unique=True))
                common.append(c)
                linked.append(c > 0 and 100 * c >= percent * (len(p) + len(q) - c))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "common", "linked"])

    return map_arrow(_with_texts(pairs, texts).select("a", "b", "left", "right"), run, f"{kinds}, common long, linked boolean")


def shared_parts(stars: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """For ``stars (a, b, within)``, hub and member: ``(a, b, outside, inside)``.

    ``outside`` names the shingles of the member that the hub lacks and, where
    ``within`` is true, ``inside`` those that both have. Names hold the hub, so
    equal names mean equal shingles beside the same hub.
    """
    kinds = [stars.schema[c].dataType.simpleString() for c in ("a", "b")]

    def run(batches):
        shingle, held = _shingler(words), {}
        for batch in batches:
            lists: tuple[list, list] = ([], [])
            for x, within, (p, q) in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _pairs_of_sets(batch, shingle, held), strict=True):
                salt = np.uint64(xxhash.xxh3_64_intdigest(repr(x)))
                name = lambda own, times, salt=salt: ((own ^ salt) * np.uint64(times)).view(np.int64)
                lists[0].append(name(np.setdiff1d(q, p, assume_unique=True), 0x94D049BB133111EB))
                lists[1].append(name(np.intersect1d(p, q, assume_unique=True), 0xBF58476D1CE4E5B9) if within else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.list_(pa.int64())) for x in lists]], ["a", "b", "outside", "inside"])

    return map_arrow(_with_texts(stars, texts).select("a", "b", "within", "left", "right"), run, f"a {kinds[0]}, b {kinds[1]}, outside array<long>, inside array<long>")


def narrowed(known: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """New buckets ``(bucket, rep, n, comp, c, rem)`` for the members of hubs that are not one component.

    ``known (hub, hub_n, rep, n, comp, common)`` has every member of a hub with
    what they have in common. Two members of different components share at most
    the lesser ``common`` in the hub, and outside it only shingles that several
    components have. Each member orders the latter from the rarest on and keeps
    so many that a partner must share one of them. Members that share nothing
    outside the hub can only be partners if one that is not linked with the
    hub has nearly all its shingles there: they meet by shingles of the hub.
    """
    full, part = 100 + percent, percent
    known = known.withColumn("need", F.expr(f"(n * {percent} + 99) div 100"))
    # Partners within the hub: common >= part / full * (n + n2) for both. Least n and greatest n2 that such a pair can have.
    loose = (full * F.col("common") < part * (F.col("n") + F.col("hub_n"))) & (F.col("common") >= F.col("need"))
    reach = F.expr(f"{full} * common div {part} - n")
    span = known.filter(loose).groupBy("hub").agg(F.min("n").alias("least"), F.max(reach).alias("most"))
    known = _merged(known, span, "hub", "left").withColumn("within", F.coalesce(loose | ((reach >= F.col("least")) & (F.col("n") <= F.col("most")) & (F.col("common") >= F.col("need"))), F.lit(False)))
    known = materialise(known.select("hub", "rep", "n", "comp", "common", "need", "within"), "members")
    lists = shared_parts(known.select(F.col("hub").alias("a"), F.col("rep").alias("b"), "within"), texts, words).withColumnsRenamed({"a": "hub", "b": "rep"})
    both = F.array(F.struct(F.lit(False).alias("inner"), F.col("outside").alias("keys")), F.struct(F.lit(True).alias("inner"), F.col("inside").alias("keys")))
    keys = lists.select("hub", "rep", F.inline(both)).select("hub", "rep", "inner", F.explode("keys").alias("bucket")).distinct()
    rows = materialise(_merged(keys, known.drop("within"), ["hub", "rep"]), "named-shingles")
    common = rows.groupBy("bucket").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket", "df")
    own = W.partitionBy("hub", "rep", "inner")
    # Shingles of the hub that a member has are as good as shared; outside, those of several components count.
    ranked = _merged(rows, common, "bucket").select("*", F.row_number().over(own.orderBy("df", "bucket")).alias("pos"), F.count("*").over(own).alias("all"))
    c = F.when(F.col("inner"), F.lit(0)).otherwise(F.col("common")).cast("long")
    kept = ranked.filter(F.col("pos") <= F.col("all") - F.greatest(F.lit(1), F.col("need") - c) + 1)
    return kept.select("bucket", "rep", "n", "comp", c.alias("c"), (F.col("all") - F.col("pos") + 1).cast("long").alias("rem"))


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)`` but the roots; root is the smallest node.

    Alternating large-star and small-star steps, each a grouped minimum joined
    back to the edges, so a hub's edges need no single task. Every round is
    written to the shared folder, which keeps the plan short.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    mark = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen["n"] == 0 or (seen["n"], seen["x"]) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (seen["n"], seen["x"])
        wide = both(edges)
        least = wide.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = wide.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialise(small.distinct(), tag)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row per row of ``df``: ``(id_col, n_shingles, component_id, kept)``.

    Documents are linked when 100 * intersection >= percent * union of their
    sets of word shingles; ``component_id`` is the smallest id reachable and
    ``kept`` marks it. A text without words (or null) has an empty set and no
    links. Rows that repeat an id count as one document. A null id takes no
    part: its component is null and it is kept. An empty table gives an empty
    result; extra columns are not read. A pair right at the threshold is missed
    with chance ``miss``, more similar ones less often.
    """
    own = materialise(signatures(df, id_col, text_col, words, bands_for(percent / 100, rows, miss), rows), "signatures")
    known = own.filter("key is not null and id is not null")
    classes = known.groupBy("key").agg(F.min("id").alias("rep"))
    # One document stands for all with the same set; (key, id) is even, so no key is hot here.
    stands = _merged(known, classes.withColumnRenamed("rep", "id"), ["key", "id"], "left_semi")
    buckets = stands.select(F.explode("buckets").alias("bucket"), F.col("id").alias("rep"), "n").distinct()
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket")
    # Of a pair's intersection, at most the lesser c and the lesser rem: here whatever the sizes allow.
    members = materialise(buckets.join(shared, "bucket", "left_semi").select("bucket", "rep", "n", F.col("rep").alias("comp"), F.lit(0).cast("long").alias("c"), F.col("n").alias("rem")), "buckets")
    # The texts of all that share a bucket, once: every comparison below reads these only.
    texts = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    texts = materialise(_merged(texts, members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "texts")
    maps = stands.select(F.col("id").alias("rep"), "map")
    labels, spent = None, members.select("rep").limit(0)
    for turn in count():
        counts = members.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
        size = counts.groupBy("bucket").agg(F.sum("k").alias("m"), F.max("k").alias("top"), F.max_by("comp", F.struct("k", "comp")).alias("major"), F.count("*").alias("comps"))
        active = _merged(members, size.filter("comps > 1").select("bucket", "m", "major", (F.col("m") - F.col("top")).alias("rest")), "bucket")
        active = materialise(active, "active")
        # Who has been a hub is none again, so the rounds come to an end; where nobody is left, the rest meets all.
        many = active.filter(F.col("rest") > (FEW if turn < 2 else MANY))
        if turn == 1:  # a second hub for those that the first left over
            many = many.filter(F.col("comp") != F.col("major"))
        met = _merged(many.groupBy("rep").agg(F.sum("m").alias("met")), spent.withColumn("spent", F.lit(1)), "rep", "left")
        hubs = _merged(many, met, "rep").groupBy("bucket").agg(F.min_by(F.struct("rep", "n", "spent"), F.struct(F.coalesce("spent", F.lit(0)), -F.col("met"), F.col("rep"))).alias("hub"))
        hubs = materialise(hubs, "hubs")
        stars = _merged(many, hubs.filter("hub.spent is null"), "bucket").filter(F.col("rep") != F.col("hub.rep")).select(F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"), "rep", "n").distinct()
        stars = materialise(stars, "stars")
        direct = _merged(active, hubs.filter("hub.spent is null").select("bucket"), "bucket", "left_anti")
        if turn > 1:
            direct = _merged(direct, maps, "rep")
        other = direct.filter(F.col("comp") != F.col("major")).select("bucket", *[F.col(x).alias(f"{x}2") for x in direct.columns if x not in ("bucket", "m", "major", "rest")])
        can = (F.col("comp") != F.col("comp2")) & ((100 + percent) * (F.least("c", "c2") + F.least("rem", "rem2")) >= percent * (F.col("n") + F.col("n2")))
        if turn > 1:
            apart = sum((F.bit_count(F.get("map", F.lit(i)).bitwiseXOR(F.get("map2", F.lit(i)))) for i in range(MAP_WORDS)), F.lit(0))
            can = can & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n2")))
        pairs = _merged(direct, other, "bucket").filter(can).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))
        pairs = pairs.unionByName(stars.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")))
        pairs = materialise(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            break
        checked = materialise(compare(pairs, texts, words, percent), "compared")
        links = checked.filter("linked").select("a", "b")
        labels = connected_components(links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if stars.isEmpty():
            break
        spent = spent.unionByName(stars.select(F.col("hub").alias("rep"))).distinct()
        if turn < 2:  # the same buckets again, with the components found
            open_buckets = _merged(members, hubs.filter("hub.spent is null").select("bucket"), "bucket", "left_semi").drop("comp")
            members = _merged(open_buckets, labels.select(F.col("node").alias("rep"), F.col("root").alias("comp")), "rep", "left")
            members = materialise(members.withColumn("comp", F.coalesce("comp", "rep")).select("bucket", "rep", "n", "comp", "c", "rem"), "buckets")
            continue
        # Hubs that still have members of other components: their members, with what each has in common with the hub.
        comp_of = lambda rows, col, name, roots=labels: _merged(rows, roots.select(F.col("node").alias(col), F.col("root").alias(name)), col, "left").withColumn(name, F.coalesce(name, col))
        known = comp_of(comp_of(stars, "rep", "comp"), "hub", "hub_comp")
        known = materialise(known.withColumn("a", F.least("hub", "rep")).withColumn("b", F.greatest("hub", "rep")), "starred")
        open_hubs = known.filter("comp <> hub_comp").select("hub").distinct()
        common = checked.groupBy("a", "b").agg(F.max("common").alias("common"))
        known = _merged(_merged(known, open_hubs, "hub", "left_semi"), common, ["a", "b"])
        members = materialise(narrowed(known.select("hub", "hub_n", "rep", "n", "comp", "common"), texts, words, percent), "buckets")
    if labels is None:
        final = classes.select("key", F.col("rep").alias("component_id"))
    else:
        final = _merged(classes, labels, classes["rep"] == labels["node"], "left").select("key", F.coalesce("root", "rep").alias("component_id"))
    # One row per distinct set on this side, so a hot set is split on the other (AQE skew join).
    # Rows without a set have keys of their own (of another length than a set's), so they do not gather either.
    final = final.withColumnRenamed("key", "set_key")
    out = _merged(own, final, F.coalesce("key", F.hex(F.xxhash64("id")).cast("binary")) == F.col("set_key"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the smallest id stays.

    Rows with a null id, or whose text is null or without words, stay. Rows that
    repeat an id share its fate; a text of any length is compared whole. Columns
    may have any names. An empty table stays empty.
    """
    gone = near_duplicates(df, id_col, text_col, **options).filter("not kept").select(F.col(id_col).alias("_gone_id")).distinct()
    return df.join(gone, df[id_col] == gone["_gone_id"], "left_anti")
