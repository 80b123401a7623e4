"""Near-duplicates by b-bit MinHash: bands of minima give candidates, packed low bits estimate, whole sets confirm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_classes, discard, fold_table, mix64, slices, word_hashes, written
from .components import connected_components

HASHES, ROWS, BITS = 256, 6, 2
BANDS = HASHES // ROWS
#: Members of one head that are confirmed in one group.
GROUP = 256
#: About the most classes, and shingles of them all, on one side of a block of pairs.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Slots of the bitmap of wanted texts: 1 MB in all, whatever the input.
SLOTS = 1 << 23
#: Names of classes that no id names lie above all ids.
ABOVE = 1 << 62
_KIND, _FOLD = byte_classes(punctuation=False), fold_table()
_MUL = mix64(np.arange(1, HASHES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_ADD = mix64(np.arange(10_001, HASHES + 10_001, dtype=np.uint64)).astype(np.uint32)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Each text's distinct shingles of `words` words as sorted 64-bit hashes; fewer words make one shingle, none make none."""
    counts, hashes = word_hashes(texts, _KIND, _FOLD)
    out, at = [], 0
    for n in counts.tolist():
        own = hashes[at : at + n]
        at += n
        if n == 0:
            out.append(own)
            continue
        k = min(n, words)
        made = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            made = mix64(made * np.uint64(0x9E3779B97F4A7C15) + own[i : n - k + 1 + i])
        out.append(np.unique(made))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the HASHES hash functions over a set, 32 bits each."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    step = 65_536 // HASHES
    for i in range(0, len(low), step):
        h = low[i : i + step, None] * _MUL
        h += _ADD
        h ^= h >> np.uint32(15)
        np.minimum(out, h.min(axis=0), out=out)
    return out


def packed(least: np.ndarray) -> bytes:
    """The low BITS bits of all minima, one plane of bits after another."""
    return b"".join(np.packbits((least >> np.uint32(b)) & np.uint32(1)).tobytes() for b in range(BITS))


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity estimated from packed signatures: share of agreeing minima, corrected for chance agreement of BITS bits."""
    differ = one ^ many
    planes = differ.reshape(*differ.shape[:-1], BITS, -1)
    wrong = np.bitwise_count(np.bitwise_or.reduce(planes, axis=-2)).sum(axis=-1)
    chance = 0.5**BITS
    return ((1 - wrong / (8 * planes.shape[-1])) - chance) / (1 - chance)


def passing(hashes: int, percent: int) -> float:
    """The least estimate that is passed on to the exact check: 4.5 standard errors under the threshold."""
    p, chance = percent / 100, 0.5**BITS
    agree = p + (1 - p) * chance
    return p - 4.5 * (agree * (1 - agree) / hashes) ** 0.5 / (1 - chance)


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, f1, f2, sig, bands): set size, a 128-bit name of the whole set, packed signature, band keys.

    th is a hash of the text. A null or empty text has an empty set, no signature and no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        mult = mix64(np.arange(2001, ROWS + 2001, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in slices(texts):
                n, f1, f2, sig, bands = [], [], [], [], []
                for s in shingle_sets(texts[lo:hi], words):
                    n.append(len(s))
                    f1.append(int(mix64(s).sum(dtype=np.uint64).astype(np.int64)))
                    f2.append(int(np.bitwise_xor.reduce(mix64(s + np.uint64(77)), initial=np.uint64(0)).astype(np.int64)))
                    if len(s):
                        least = minima(s)
                        sig.append(packed(least))
                        rows = least[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
                        bands.append(mix64((rows * mult).sum(axis=1, dtype=np.uint64) ^ salt).astype(np.int64))
                    else:
                        sig.append(None)
                        bands.append(np.empty(0, np.int64))
                ends = np.cumsum([0] + [len(b) for b in bands])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary()), lists],
                    names=["doc_id", "th", "n_shingles", "f1", "f2", "sig", "bands"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, th long, n_shingles long, f1 long, f2 long, sig binary, bands array<long>")


def _classes(full: DataFrame) -> DataFrame:
    """(f1, f2, n_shingles, doc_id, th, sig, bands, cls): a row for each distinct set; (doc_id, th) is one of its rows.

    The name cls is the class's least id. Classes without any id, and the further sets of an id that stands with several,
    are named by their hash, above all ids.
    """
    found = full.groupBy("f1", "f2", "n_shingles").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("r"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    found = written(found.select("f1", "f2", "n_shingles", "r.doc_id", "r.th", "sig", "bands"), "sets")
    own = F.struct("f1", "f2", "n_shingles")
    several = found.groupBy("doc_id").agg(F.min(own).alias("first"), F.max(own).alias("last")).filter("doc_id is not null and first != last")
    named = found.join(several.select("doc_id", "first"), "doc_id", "left")
    other = F.col("doc_id").isNull() | F.coalesce(F.col("first") != own, F.lit(False))
    cls = F.when(other, F.lit(ABOVE) + F.pmod(F.xxhash64("f1", "f2", "n_shingles"), F.lit(ABOVE - 1))).otherwise(F.col("doc_id"))
    made = written(named.select("f1", "f2", "n_shingles", "doc_id", "th", "sig", "bands", cls.alias("cls")), "classes")
    discard(found)
    return made


def _texts(need: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, text) of the classes in `need` (cls, doc_id, th), looked up in `docs` (doc_id, th, text).

    Hashes of the needed rows are gathered into bitmaps of a fixed size, so that few other texts are shuffled;
    past that size more texts pass, and none is lost.
    """
    slot = F.pmod(F.xxhash64("doc_id", "th"), F.lit(SLOTS))
    bits = need.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("_bits"))
    found = docs.withColumn("slot", slot).withColumns({"_bucket": F.expr("bitmap_bucket_number(slot)"), "_at": F.expr("bitmap_bit_position(slot)")})
    found = found.join(F.broadcast(bits), "_bucket")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = found.filter(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1).select("doc_id", "th", "text").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.th") == F.col("c.th"))
    return written(found.join(need.alias("c"), same).select("cls", "text").dropDuplicates(["cls"]), "class-texts")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (head, cls, salt) whose whole shingle sets reach the threshold.

    A head's members are confirmed in salted groups; its text is sent to each group once, and a task holds one head's set
    and one batch of members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.empty(0, np.uint64)
        for batch in batches:
            heads, others, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keep = []
            for lo, hi in slices(texts):
                for at, x in enumerate(shingle_sets(texts[lo:hi], words), lo):
                    if others[at] is None:
                        now, own = heads[at], x
                    elif now == heads[at]:
                        both = len(np.intersect1d(own, x, assume_unique=True))
                        if both and 100 * both >= percent * (len(own) + len(x) - both):
                            keep.append(at)
            found = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(found), batch.column(1).take(found)], names=["a", "b"])

    members = pairs.join(texts, "cls").select("head", "salt", "cls", "text")
    heads = pairs.select("head", "salt").distinct().join(texts.withColumnRenamed("cls", "head"), "head")
    both = heads.select("head", "salt", F.lit(None).cast("long").alias("cls"), "text").unionByName(members)
    dealt = both.repartition(_parts(pairs), "head", "salt").sortWithinPartitions("head", "salt", F.col("cls").asc_nulls_first())
    return dealt.select("head", "cls", "text").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs.

    Rows are linked if 100 * |intersection| >= percent * |union| of their shingle sets. Rows with equal sets form a class
    first. Classes that share a band's key are candidates. In each bucket the class that meets most others is the head: the
    others are compared with it. Where these links leave the rest of a bucket in several components, classes of different
    components are compared in blocks; a block returns a spanning forest of its links, so rows never grow with the square of
    a group. The packed signatures rule pairs out, and every link is confirmed on the whole sets. At a similarity of 0.8 a
    pair shares none of the 42 bands of 6 minima with a chance of 3 in a million.
    Null, empty and blank texts have empty sets, link with nothing and keep their own id. Rows with null ids take part but
    name no component: they get the least id that they reach, or null. An id with several texts takes part with each.
    Equal rows share a component. Ids are below 2^62. Tables between the steps are removed as soon as the next one is written; three
    narrow ones stay, from which the result is read.
    """
    rows = written(signatures(docs, words, id_col, text_col), "signatures")
    classes = _classes(rows.filter("n_shingles > 0"))
    own = written(rows.select("doc_id", "n_shingles", "f1", "f2"), "rows")
    discard(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    places = classes.select("cls", "doc_id", "th")

    keys = classes.select("cls", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(keys.join(shared, "key"), "buckets")
    # a text that others were edited from meets more texts than they meet each other, so it heads its buckets
    weight = members.groupBy("cls").agg(F.sum("n").alias("weight"))
    heads = members.join(weight, "cls").groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "cls")).alias("h"))
    starred = written(members.join(heads.select("key", F.col("h.cls").alias("head")), "key").filter("cls != head"), "stars")
    discard(members)
    stars = starred.groupBy("head", "cls").agg(F.max("n").alias("n"))
    pairs = written(_likely(stars, classes, percent), "pairs")
    ends = pairs.select(F.col("head").alias("cls")).union(pairs.select("cls")).distinct()
    whole = _texts(places.join(ends, "cls"), texts)
    links = written(_confirmed(pairs, whole, words, percent), "links")
    label = connected_components(links, "a", "b")
    for table in (pairs, whole, links):
        discard(table)

    # what the heads have not decided: buckets whose other members lie in several components, equal buckets once
    rest = starred.join(label, starred["cls"] == label["node"], "left").select("key", "cls", F.coalesce("component", "cls").alias("comp"))
    split = rest.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("s2"),
    ).filter("lo < hi")
    split = split.groupBy("n", "s1", "s2").agg(F.min("key").alias("key"))
    across = written(rest.join(split.select("key"), "key"), "across")
    discard(starred)
    if not across.isEmpty():
        whole = _texts(places.join(across.select("cls").distinct(), "cls"), texts)
        more = written(_across_links(across, classes, whole, words, percent), "more-links")
        discard(whole)
        if not more.isEmpty():
            label = connected_components(label.select("node", "component").union(more), "node", "component")
        discard(more)
    discard(across)
    named = written(classes.select("f1", "f2", "n_shingles", "doc_id", "cls"), "names")
    discard(classes)

    out = own.join(named.select("f1", "f2", "n_shingles", "cls"), ["f1", "f2", "n_shingles"], "left")
    out = out.join(label, out["cls"] == label["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "cls").alias("comp"))
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.when(F.col("comp") < ABOVE, F.col("comp")))
    # classes of hashed names count by their least ids
    hashed = named.filter(F.col("cls") >= ABOVE).select("cls", F.col("doc_id").alias("own"))
    if not hashed.isEmpty():
        least = hashed.join(label, hashed["cls"] == label["node"], "left").groupBy(F.coalesce("component", "cls").alias("comp")).agg(F.min("own").alias("least"))
        out = out.join(least, "comp", "left")
        component = F.least(component, "least")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _likely(stars: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(head, cls, salt): the pairs that packed signatures and set sizes do not rule out; salts are dealt by the bucket's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (3, 4))
                n, m = (batch.column(k).to_numpy() for k in (5, 6))
                keep = pa.array((estimate(x, y) >= passing(HASHES, percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1, 2)], names=["head", "cls", "salt"])

    left = classes.select(F.col("cls").alias("head"), F.col("sig").alias("x"), F.col("n_shingles").alias("nx"))
    right = classes.select("cls", F.col("sig").alias("y"), F.col("n_shingles").alias("ny"))
    salt = F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / GROUP))
    sides = stars.join(right, "cls").join(left, "head").select("head", "cls", salt.alias("salt"), "x", "y", "nx", "ny")
    return sides.mapInArrow(run, "head long, cls long, salt long")


class _Block:
    """The classes of one key and one pair of blocks."""

    def __init__(self, rows: dict[str, np.ndarray], sets: list[np.ndarray], percent: int):
        self.rows, self.sets, self.percent = rows, sets, percent

    def forest(self) -> Iterator[tuple[int, int]]:
        """Links between classes of different components, at most one fewer than there are components."""
        r, sizes = self.rows, np.array([len(s) for s in self.sets])
        names, comp = np.unique(r["comp"], return_inverse=True)
        lo, hi = r["pi"][0], r["pj"][0]
        least, flat, ends = passing(HASHES, self.percent), None, np.cumsum(sizes)
        for i in np.flatnonzero(r["block"] == lo):
            other = (r["block"] == hi) & (comp != comp[i]) & (100 * np.minimum(sizes, sizes[i]) >= self.percent * np.maximum(sizes, sizes[i]))
            if lo == hi:
                other[: i + 1] = False
            j = np.flatnonzero(other)
            j = j[estimate(r["sig"][i], r["sig"][j]) >= least] if len(j) else j
            if not len(j):
                continue
            same = (r["bands"][j] == r["bands"][i]) & (r["bands"][i] != 0)
            j = j[r["bands"][i][same.argmax(axis=1)] == r["key"][0]]  # a pair that shares several keys is compared at the first
            if not len(j):
                continue
            if flat is None:
                values, flat = np.unique(np.concatenate(self.sets), return_inverse=True)
                mark = np.zeros(len(values), bool)
            own = flat[ends[i] - sizes[i] : ends[i]]
            mark[own] = True
            for k in range(0, len(j), 64):
                some = j[k : k + 64]
                stop = np.cumsum(sizes[some])
                at = np.arange(stop[-1]) + np.repeat(ends[some] - stop, sizes[some])
                both = np.add.reduceat(mark[flat[at]].astype(np.int64), stop - sizes[some])
                for x in some[100 * both >= self.percent * (sizes[i] + sizes[some] - both)]:
                    if comp[x] != comp[i]:
                        comp[comp == comp[x]] = comp[i]
                        yield int(r["cls"][i]), int(r["cls"][x])
            mark[own] = False


def _across_links(across: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links between classes of one key but different components (key, cls, comp), a spanning forest of each block.

    A large bucket is cut into blocks by its classes and their shingles, and each pair of blocks is a group of its own, so no
    task holds a whole bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, sets = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "pi", "pj", "block", "cls", "comp")}
            rows["sig"] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            rows["bands"] = batch.column("bands").flatten().to_numpy().reshape(batch.num_rows, BANDS)
            whole = batch.column("text").to_pylist()
            for lo, hi in slices(whole):
                sets += shingle_sets(whole[lo:hi], words)
            if kept is not None:
                rows = {k: np.concatenate([kept[k], v]) for k, v in rows.items()}
            edge = np.flatnonzero((np.diff(rows["key"]) != 0) | (np.diff(rows["pi"]) != 0) | (np.diff(rows["pj"]) != 0)) + 1
            ends = [0, *edge.tolist()]
            yield from found(rows, sets, ends)
            kept, sets = {k: v[ends[-1] :] for k, v in rows.items()}, sets[ends[-1] :]
        if kept is not None:
            yield from found(kept, sets, [0, len(sets)])

    def found(rows: dict, sets: list, ends: list[int]) -> Iterator[pa.RecordBatch]:
        out = [x for s, e in zip(ends[:-1], ends[1:], strict=True) for x in _Block({k: v[s:e] for k, v in rows.items()}, sets[s:e], percent).forest()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    kept = across.groupBy("cls").agg(F.collect_list("key").alias("keys"))  # at most one for each band
    bands = F.transform("bands", lambda b: F.when(F.array_contains("keys", b), b).otherwise(F.lit(0).cast("long")))
    whole = kept.join(classes.select("cls", "n_shingles", "sig", "bands"), "cls").select("cls", "n_shingles", "sig", bands.alias("bands"))
    sized = across.join(whole.select("cls", "n_shingles"), "cls").groupBy("key").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    cut = across.join(sized, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("pi"), F.greatest("block", "other").alias("pj"), "block", "cls", "comp")
    sides = dealt.join(whole, "cls").join(texts, "cls").select("key", "pi", "pj", "block", "cls", "comp", "sig", "bands", "text")
    sides = sides.repartition(_parts(across), "key", "pi", "pj").sortWithinPartitions("key", "pi", "pj", "cls")
    return sides.mapInArrow(run, "a long, b long")
