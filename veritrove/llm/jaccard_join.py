"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct five-word shingles. Shingles have a global
order, rarest first; two sets of Jaccard similarity t or more share a shingle
among the first |x| - ceil(t |x|) + 1 of each (their prefixes).

1. Index. Shingle hashes go to buckets of the hash space, packed by document;
   a bucket knows how many documents have each of its shingles. Shingles of one
   document can't be shared, so they are left there; the others return to their
   documents with their frequency class.
2. Prefixes. A document whose prefix consists of unshared shingles has no
   partner. The rest are ordered and cut to prefixes. Documents of equal sets
   become one class, classes of equal prefix and size one group.
3. Group pairs. For each prefix shingle one group, the same for all shingles
   where possible, is paired with the others, filtered by size and position,
   and verified on the sets' members. Then classes that share a prefix shingle
   but are not in one component yet are paired, filtered and verified; those
   of one group share its whole prefix, so they meet at its first shingle even
   where no other group has it. A pair
   is thus skipped only where its ends are already connected, so components
   are those of all links, and a large group of copies costs a row for each
   member and not for each pair.
4. Verification works on the shared shingles only: unshared ones can't be in
   an intersection, and sizes are known.

Defined cases: null and empty texts have no shingles, no links and are their
own component; a text of fewer words than a shingle is one shingle of them
all; repeated rows and equal texts are linked; other columns are not read. Ids
must be integers that name a text: rows that share an id and a text are one
document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, sliced, stored, volume
from .words import FOLDED, distinct, mix, pack, pack_runs, text_bytes, unpack, unpack_runs, windows, word_hashes

SHINGLE = 5
#: Similarity t as a fraction.
NUMERATOR, DENOMINATOR = 75, 100
#: Text bytes per bucket of the index, and documents per bucket of the way back.
BUCKET_BYTES = 4 << 20
BUCKET_DOCS = 4096
#: A shingle's key: bucket number, then 40 bits of its hash.
LOW = np.uint64((1 << 40) - 1)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, sorted distinct shingle hashes) of each text."""
    offsets, hashes = word_hashes(texts, FOLDED)
    return distinct(*windows(hashes, offsets, k))


def least_overlap(n: np.ndarray) -> np.ndarray:
    """ceil(t n): fewer shared shingles than this can't link a set of n."""
    return -(-n * NUMERATOR // DENOMINATOR)


def _doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _parts(key: np.ndarray):
    """(value, slice) of each run of a sorted integer array."""
    if len(key):
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(key)).tolist(), strict=True):
            yield int(key[a]), slice(a, b)


def _blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "bucket", "data"])


def _to_index(shingle_buckets: int, doc_buckets: int):
    """Texts -> kind 0: (bucket of shingles: documents, low bits); kind 1: (bucket of documents: ids, set sizes)."""

    def run(batches):
        for batch in batches:
            ids_all = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            off, _ = text_bytes(batch.column(1))
            for a, b in sliced(off):
                bounds, hashes = shingle_sets(batch.column(1).slice(a, b - a))
                ids, n = ids_all[a:b], np.diff(bounds)
                docs = np.repeat(ids, n)
                bucket = ((hashes >> np.uint64(32)) * np.uint64(shingle_buckets) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                docs, hashes, rows = docs[order], hashes[order] & LOW, []
                for k, s in _parts(bucket[order]):
                    h = hashes[s]
                    rows.append((0, k, pack(*pack_runs(docs[s]), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint8))))
                home = _doc_bucket(ids, doc_buckets)
                order = np.argsort(home, kind="stable")
                ids, n = ids[order], n[order]
                rows += [(1, k, pack(ids[s], n[s])) for k, s in _parts(home[order])]
                yield _blob_batch(rows)

    return run


def _count(doc_buckets: int):
    """A bucket of shingles -> those of two or more documents, sent to the documents' buckets with a class of frequency."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        if table["kind"][0].as_py() == 1:
            return table.select(["kind", "bucket", "data"])
        bucket = table["bucket"][0].as_py()
        docs, keys = [], []
        for blob in table["data"].to_pylist():
            steps, runs, low, high = unpack(blob)
            docs.append(unpack_runs(steps, runs))
            keys.append(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
        docs, keys = np.concatenate(docs), np.concatenate(keys)
        order = np.lexsort((docs, keys))
        docs, keys = docs[order], keys[order]
        once = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))
        docs, keys = docs[once], keys[once]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        df = np.diff(np.append(first, len(keys)))
        level = np.repeat(np.floor(8 * np.log2(df)).astype(np.uint16), df)
        shared = np.repeat(df > 1, df)
        docs, keys, level = docs[shared], keys[shared], level[shared]
        home = _doc_bucket(docs, doc_buckets)
        order = np.lexsort((docs, home))
        docs, keys, level = docs[order], keys[order], level[order]
        for k, s in _parts(home[order]):
            h = keys[s]
            rows.append((1, k, pack(*pack_runs(docs[s]), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint8), level[s], np.array([bucket]))))
        return pa.Table.from_batches([_blob_batch(rows)])

    return run


SETS = "doc_id bigint, n bigint, alone bigint, prefix array<bigint>, shared binary, class_key binary, group_key binary"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shared", pa.binary()), ("class_key", pa.binary()), ("group_key", pa.binary())])


def _prefixes(table: pa.Table) -> pa.Table:
    """A bucket of documents -> each with its size and, if it can have a partner, its prefix and shared shingles."""
    ids, sizes, docs, keys, levels = [], [], [], [], []
    for blob in table["data"].to_pylist():
        a = unpack(blob)
        if len(a) == 2:
            ids.append(a[0].astype(np.int64))
            sizes.append(a[1].astype(np.int64))
        else:
            docs.append(unpack_runs(a[0], a[1]))
            keys.append(a[2].astype(np.uint64) | a[3].astype(np.uint64) << np.uint64(32) | a[5].astype(np.uint64)[0] << np.uint64(40))
            levels.append(a[4].astype(np.int64))
    ids, sizes = np.concatenate(ids), np.concatenate(sizes)
    unique, where = np.unique(ids, return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.maximum.at(total, where, sizes)
    out = {name: [] for name in _SETS_ARROW.names}

    def add(doc, n, alone, prefix, shared, class_key, group_key):
        for name, v in zip(_SETS_ARROW.names, (doc, n, alone, prefix, shared, class_key, group_key), strict=True):
            out[name].append(v)

    if docs:
        docs, keys, levels = np.concatenate(docs), np.concatenate(keys), np.concatenate(levels)
        order = np.lexsort((keys, levels, docs))
        docs, keys = docs[order], keys[order]
        left, right = np.searchsorted(docs, unique, "left"), np.searchsorted(docs, unique, "right")
    else:
        left = right = np.zeros(len(unique), np.int64)
    for doc, n, a, b in zip(unique.tolist(), total.tolist(), left.tolist(), right.tolist(), strict=True):
        alone = n - (b - a)
        length = n - int(least_overlap(np.int64(n))) + 1 - alone
        if n == 0 or length <= 0 or b == a:
            add(doc, n, alone, None, None, None, None)
            continue
        mine = keys[a:b]
        prefix = mine[:length]
        packed = np.sort(mine)
        head = b"" if alone == 0 else doc.to_bytes(8, "big", signed=True)
        digest = lambda x, head=head, n=n: xxhash.xxh3_128_digest(head + n.to_bytes(8, "big") + x.tobytes())
        add(doc, n, alone, prefix.view(np.int64), pack((packed & np.uint64(0xFFFFFFFF)).astype(np.uint32), packed >> np.uint64(32)), digest(packed), digest(prefix))
    return pa.Table.from_pydict(out, _SETS_ARROW)


def document_sets(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows, size = volume(documents, text_column)
    shingle_buckets, doc_buckets = max(1, -(-size // BUCKET_BYTES)), max(1, -(-rows // BUCKET_DOCS))
    blobs = "kind int, bucket int, data binary"
    texts = documents.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    index = texts.mapInArrow(_to_index(shingle_buckets, doc_buckets), blobs)
    back = index.groupBy("kind", "bucket").applyInArrow(_count(doc_buckets), blobs)
    return stored(back.groupBy("bucket").applyInArrow(_prefixes, SETS), "sets")


#: Pairs of one left class that one task verifies.
PAIRS_AT_ONCE = 512


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are linked. Each right side's shingles travel to the left side's once."""
    sets = classes.select(F.col("doc_id").alias("_i"), "n", "shared")
    parts = pairs.withColumn("_part", F.pmod(F.xxhash64("b"), F.ceil(F.count(F.lit(1)).over(_by("a")) / PAIRS_AT_ONCE)))
    right = parts.join(sets, F.col("b") == F.col("_i")).select("a", "_part", "b", "n", "shared")
    heads = parts.select("a", "_part").distinct()
    left = heads.join(sets, F.col("a") == F.col("_i")).select("a", "_part", F.lit(None).cast("bigint").alias("b"), "n", "shared")

    def check(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        set_of = lambda r: (lambda lo, hi: lo.astype(np.uint64) | hi.astype(np.uint64) << np.uint64(32))(*unpack(r["shared"]))
        head = next(r for r in rows if r["b"] is None)
        mine, linked = set_of(head), []
        for r in rows:
            if r["b"] is not None:
                both = len(np.intersect1d(mine, set_of(r), assume_unique=True))
                if DENOMINATOR * both >= NUMERATOR * (head["n"] + r["n"] - both):
                    linked.append(r["b"])
        return pa.Table.from_pydict({"a": pa.array([head["a"]] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return right.unionByName(left).groupBy("a", "_part").applyInArrow(check, "a bigint, b bigint")


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each id: doc_id, n_shingles, component_id, class_id (smallest id of the same set)."""
    sets = document_sets(documents, id_column, text_column)
    open_ = sets.where("class_key is not null").select("doc_id", "class_key", "group_key")
    # Written, so that the join is of plain exchanges and a large class can be split over tasks.
    by_class = stored(open_.groupBy(F.col("class_key").alias("_k")).agg(F.min("doc_id").alias("class_id")), "classes")
    member = stored(open_.join(by_class, F.col("class_key") == F.col("_k")).select("doc_id", "class_id", "group_key"), "members")
    reps = member.where("doc_id = class_id").select("class_id", "group_key")
    groups = stored(reps.join(reps.groupBy("group_key").agg(F.min("class_id").alias("group_id")), "group_key").select("class_id", "group_id"), "groups")
    heads = groups.where("class_id = group_id").select("group_id")
    prefix = (
        sets.select("doc_id", "n", "alone", "prefix").join(heads, F.col("doc_id") == F.col("group_id"), "left_semi")
        .select(F.col("doc_id").alias("c"), "n", "alone", F.posexplode("prefix").alias("at", "token")).withColumn("at", (F.col("at") + F.col("alone")).cast("bigint"))
    )

    def fits(x: str, y: str):
        """Sizes allow a link, and so do the shingles from here on if this is the first shared one."""
        room = F.least(F.col(f"{x}n") - F.col(f"{x}at"), F.col(f"{y}n") - F.col(f"{y}at"))
        both = F.col(f"{x}n") + F.col(f"{y}n")
        sizes = DENOMINATOR * F.least(f"{x}n", f"{y}n") >= NUMERATOR * F.greatest(f"{x}n", f"{y}n")
        return sizes & ((NUMERATOR + DENOMINATOR) * room >= NUMERATOR * both)

    # Round 1: for each shingle of several groups the one with the least share of shingles of its
    # own - the original rather than an edited copy - with every other; within groups, the first class with the rest.
    pivots = prefix.groupBy("token").agg(
        F.min(F.struct((F.col("alone") / F.col("n")).alias("r"), F.xxhash64("c").alias("h"), F.col("c").alias("pc"), F.col("n").alias("pn"), F.col("at").alias("pat"))).alias("p"), F.count(F.lit(1)).alias("m")
    ).where("m > 1").select(F.col("token").alias("ptoken"), "p.pc", "p.pn", "p.pat")
    entries = stored(prefix.join(pivots, F.col("token") == F.col("ptoken")).select("token", "c", "n", "at", "pc", "pn", "pat"), "entries")
    star = entries.where((F.col("c") != F.col("pc")) & fits("", "p")).select(F.col("pc").alias("a"), F.col("c").alias("b"))
    inside = groups.where("class_id <> group_id").select(F.col("group_id").alias("a"), F.col("class_id").alias("b"))
    first = stored(verified(star.unionByName(inside).distinct(), sets), "first")
    # Round 2: classes of different components that share a prefix shingle.
    label = components(first).withColumnRenamed("node", "_n")
    classes = groups.join(label, F.col("class_id") == F.col("_n"), "left").select("class_id", F.col("group_id").alias("_g"), F.coalesce("component", "class_id").alias("k"))
    # Classes of one group have all of its prefix in common and no shingles of their own.
    several = prefix.where("at = 0").join(inside.select("a").distinct(), F.col("c") == F.col("a"), "left_semi").select("token", "c", "n", "at")
    meeting = entries.select("token", "c", "n", "at").unionByName(several).distinct()
    named = meeting.join(classes, F.col("c") == F.col("_g")).select("token", F.col("class_id").alias("c"), "n", "at", "k")
    apart = named.groupBy("token").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("token")
    rest = stored(named.join(apart, "token", "left_semi"), "rest")
    x = rest.select(*[F.col(c).alias(f"x{c}") for c in rest.columns])
    y = rest.select(*[F.col(c).alias(f"y{c}") for c in rest.columns])
    pairs = x.join(y, (F.col("xtoken") == F.col("ytoken")) & (F.col("xk") < F.col("yk")) & fits("x", "y")).select(F.col("xc").alias("a"), F.col("yc").alias("b")).distinct()
    second = verified(pairs, sets)
    label = components(first.unionByName(second)).withColumnRenamed("node", "_n")
    discard(by_class, groups, entries, first, rest)
    # A component's smallest id is the smallest of its classes: a class is named by its smallest member.
    named = member.join(label, F.col("class_id") == F.col("_n"), "left").select(F.col("doc_id").alias("_d"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return sets.select("doc_id", "n").join(named, F.col("doc_id") == F.col("_d"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")
    )


def deduplicated(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns, with a row of the smallest id of each component; rows without an id stay.

    Of rows that share an id the one of the least text stays, null first.
    """
    keep = near_duplicates(documents, id_column, text_column).where("doc_id = component_id").select("doc_id")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    one = rows.where("id is not null").join(keep, F.col("id") == F.col("doc_id"), "left_semi").groupBy("id").agg(F.min_by("row", "text").alias("row"))
    return one.select("row.*").unionByName(documents.where(F.col(f"`{id_column}`").isNull()))
