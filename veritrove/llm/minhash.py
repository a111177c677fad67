"""MinHash near-dedup by a multi-index Hamming join.

1. Signatures. A document's set of distinct five-word shingles becomes VALUES
   MinHash values of BITS bits each. Two sets of similarity s differ in each
   value with a probability of 1 - s, so those that link differ in more than
   THRESHOLD values with a probability of at most MISS: 10^-7 where s is just
   0.85, below 10^-14 from 0.9 on.
2. Multi-index. A signature is split into THRESHOLD // 2 + 1 chunks. Of a pair
   within the threshold, one chunk at least has one error at most (pigeonhole),
   and each chunk's allowed errors are enumerated: a key for each place left
   out. So every pair within the threshold meets at a key.
3. Equal sets are one class, and one signature stands for it. Keys go to
   buckets, packed. Each key's classes are paired with one pivot, of PIVOTS
   orders by key; pairs beyond the signature distance go, the others are
   confirmed on the full sets of their texts. Then classes that share a key but
   are not in one component yet are open: their shingles are counted, and as one
   that no other open class has can't be in an intersection, most edited copies
   can't link any more. The rest are paired, at each key, with the class of which
   most is shared - the original rather than an edited copy. Those that are in
   different components even then are compared, signature by signature, inside
   tasks: pairs within the distance, with shared shingles enough, are confirmed
   on the full sets, each at the least key that it has in common. A pair is skipped only where its ends are already connected
   or can't link, so components are those of all links, and a group of copies
   costs a row for each member.
   Where a key has many classes they are dealt to blocks, and pairs of blocks
   to tasks, save pairs within the key's largest component.

Confirmation makes every link exact; what rests on probability is the bound of
step 1 alone.

Defined cases: null and empty texts and those without words have no shingles,
no links and are their own component; a text of fewer words than a shingle is
one shingle of them all; equal texts and sets are linked; rows without an id
are left out (near_copies) or stay (deduplicated); rows that share an id are
one document with all of their texts: it has the links of each, and the size of
the largest; an empty table gives an empty one; other columns, whatever their
names, aren't read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .jaccard_join import document_sets, shingle_sets
from .shared import discard, sliced, stored
from .words import mix, pack, pack_runs, text_bytes, unpack, unpack_runs

#: Similarity from which sets link, as a fraction.
NUMERATOR, DENOMINATOR = 85, 100
VALUES, BITS = 128, 16
#: Probability that a pair of sets of just that similarity lies beyond the threshold.
MISS = 1e-7


def signature_threshold(values: int = VALUES, similarity: float = NUMERATOR / DENOMINATOR, miss: float = MISS) -> int:
    """The least distance beyond which a linked pair lies with a probability below `miss`."""
    p, tail, r = 1 - similarity, 1.0, -1
    while tail > miss:
        r += 1
        tail -= comb(values, r) * p**r * (1 - p) ** (values - r)
    return r


THRESHOLD = signature_threshold()
CHUNKS = np.array_split(np.arange(VALUES), THRESHOLD // 2 + 1)
FACTORS = (mix(np.arange(1, VALUES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: Orders of pivots; keys take turns.
PIVOTS = 4
#: Signatures whose keys make a bucket, classes of a block, and shingles of the right sides that one task confirms.
BUCKET_SIGNATURES = 8192
BLOCK_CLASSES = 4096
#: Rows of keys that are compared in one batch, and pairs of them at once.
BATCH_ROWS, PAIRS_AT_ONCE = 16_384, 100_000
CONFIRMED_SHINGLES = 1 << 18
#: Bits of an open class's shingles, by which pairs that can't link are told before they leave a task.
MAP_BITS = 2048


def signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of VALUES 16-bit values for each set; empty sets have zeros."""
    out = np.zeros((len(offsets) - 1, VALUES), np.uint16)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        short, starts = (shingles >> np.uint64(32)).astype(np.uint32), offsets[:-1][filled]
        for j, f in enumerate(FACTORS):
            out[filled, j] = np.minimum.reduceat(short * f, starts).astype(np.uint16)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of each signature for every chunk and place left out of it."""
    keys, step = np.empty((len(signature), VALUES), np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for chunk in CHUNKS:
        for left_out in chunk:
            key = np.full(len(signature), left_out + 1, np.uint64)
            for j in chunk:
                if j != left_out:
                    key = key * step + signature[:, j]
            keys[:, left_out] = mix(key)
    return keys


def _as_signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), VALUES)


def signed(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, class_key, signature) of each row with an id; no key or signature where the set is empty."""

    def run(batches):
        for batch in batches:
            off, _ = text_bytes(batch.column(1))
            for a, b in sliced(off):
                bounds, shingles = shingle_sets(batch.column(1).slice(a, b - a))
                n, rows = np.diff(bounds), signatures(shingles, bounds)
                keys = [xxhash.xxh3_128_digest(shingles[x:y].tobytes()) if y > x else None for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                values = [rows[i].tobytes() if n[i] else None for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "n", "class_key", "signature"])

    texts = documents.where(F.col(f"`{id_column}`").isNotNull()).select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, n bigint, class_key binary, signature binary")


def _to_buckets(buckets: int):
    """(class_id, component, signature) -> (bucket, packed classes, components and keys)."""

    def run(batches):
        for batch in batches:
            ids, parts = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            keys = index_keys(_as_signatures(batch.column(2))).ravel()
            ids, parts = np.repeat(ids, VALUES), np.repeat(parts, VALUES)
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            ids, parts, keys, bucket = ids[order], parts[order], keys[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [(k, pack(*pack_runs(ids[a:b]), *pack_runs(parts[a:b]), keys[a:b])) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "data"])

    return run


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's (keys, classes, components, start of each entry's key), sorted by key and class, each entry once."""
    ids, parts, keys = [], [], []
    for blob in table["data"].to_pylist():
        a, b, c, d, k = unpack(blob)
        ids.append(unpack_runs(a, b))
        parts.append(unpack_runs(c, d))
        keys.append(k.astype(np.uint64))
    ids, parts, keys = np.concatenate(ids), np.concatenate(parts), np.concatenate(keys)
    order = np.lexsort((ids, keys))
    ids, parts, keys = ids[order], parts[order], keys[order]
    once = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
    ids, parts, keys = ids[once], parts[once], keys[once]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys, ids, parts, np.repeat(first, np.diff(np.append(first, len(keys))))


def _star(table: pa.Table) -> pa.Table:
    """A bucket -> pairs of each key's pivot with its other classes, each pair once."""
    keys, ids, _, start = _entries(table)
    turn = keys % np.uint64(PIVOTS)
    rank = mix(ids.view(np.uint64) * np.uint64(PIVOTS) + turn)
    order = np.lexsort((rank, start))
    pivot = np.empty(len(ids), np.int64)
    first = np.unique(start)
    pivot[:] = np.repeat(ids[order][first], np.diff(np.append(first, len(ids))))
    pairs = np.unique(np.stack([pivot, ids], 1)[pivot != ids], axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _open(table: pa.Table) -> pa.Table:
    """A bucket -> the entries of keys at which several components meet."""
    keys, ids, parts, start = _entries(table)
    first = np.unique(start)
    low, high = (np.repeat(f.reduceat(parts, first), np.diff(np.append(first, len(ids)))) for f in (np.minimum, np.maximum)) if len(first) else (parts, parts)
    keep = low != high
    return pa.table({"key": pa.array(keys[keep].view(np.int64), pa.int64()), "c": pa.array(ids[keep], pa.int64()), "k": pa.array(parts[keep], pa.int64())})


def meeting(classes: DataFrame, rows: int, in_bucket, schema: str) -> DataFrame:
    """What in_bucket finds among the keys of classes (class_id, component, signature), of which there are `rows`."""
    buckets = max(1, -(-rows // BUCKET_SIGNATURES))
    blobs = classes.select("class_id", "component", "signature").mapInArrow(_to_buckets(buckets), "bucket int, data binary")
    return blobs.groupBy("bucket").applyInArrow(in_bucket, schema)


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes within the signature distance whose sizes allow a link."""
    side = lambda x: classes.select(F.col("class_id").alias(f"_{x}"), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    both = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    both = both.where(DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb")).select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            close = (_as_signatures(batch.column(2)) != _as_signatures(batch.column(3))).sum(1) <= THRESHOLD
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(close)) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def confirmed(pairs: DataFrame, documents: DataFrame, sizes: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The pairs (a, b) of ids whose full sets link. The texts of all b of one a meet it in tasks of CONFIRMED_SHINGLES shingles."""
    pairs = stored(pairs.join(sizes.select(F.col("class_id").alias("_b"), F.col("n").alias("w")), F.col("b") == F.col("_b")).select("a", "b", "w"), "pairs")
    loads = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.sum("w") / CONFIRMED_SHINGLES).alias("parts"))
    dealt = stored(pairs.join(loads, F.col("a") == F.col("_a")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "dealt")
    wanted = dealt.select(F.col("b").alias("_i")).unionByName(dealt.select(F.col("a").alias("_i"))).distinct()
    texts = documents.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).where("text is not null")
    texts = stored(texts.join(wanted, F.col("id") == F.col("_i"), "left_semi"), "texts")
    right = dealt.join(texts, F.col("b") == F.col("id")).select("a", "part", "b", "text")
    left = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("id")).select("a", "part", F.lit(None).cast("bigint").alias("b"), "text")

    def check(table: pa.Table) -> pa.Table:
        others, linked = table["b"].to_pylist(), set()
        heads = [i for i, b in enumerate(others) if b is None]
        text = table["text"].combine_chunks()
        text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
        for k in heads:
            bounds, mine = shingle_sets(text.slice(k, 1))
            for a, b in sliced(text_bytes(text)[0]):
                bounds, shingles = shingle_sets(text.slice(a, b - a))
                for i in range(a, b):
                    if others[i] is not None and others[i] not in linked:
                        own = shingles[bounds[i - a] : bounds[i - a + 1]]
                        shared = len(np.intersect1d(mine, own, assume_unique=True))
                        if shared and DENOMINATOR * shared >= NUMERATOR * (len(mine) + len(own) - shared):
                            linked.add(others[i])
        return pa.table({"a": pa.array([table["a"][0].as_py()] * len(linked), pa.int64()), "b": pa.array(sorted(linked), pa.int64())})

    out = stored(right.unionByName(left).groupBy("a", "part").applyInArrow(check, "a bigint, b bigint"), "confirmed")
    discard(pairs, dealt, texts)
    return out


def shingle_bits(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of MAP_BITS bits, packed, for each set: those that its shingles hash to. A bit that another set lacks is a shingle that it lacks."""
    rows, out, at = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), [], mix(shingles) % np.uint64(MAP_BITS)
    for a in range(0, len(offsets) - 1, 4096):
        b = min(a + 4096, len(offsets) - 1)
        bits = np.zeros((b - a, MAP_BITS), bool)
        bits[rows[offsets[a] : offsets[b]] - a, at[offsets[a] : offsets[b]]] = True
        out.append(np.packbits(bits, axis=1))
    return np.concatenate(out) if out else np.zeros((0, MAP_BITS // 8), np.uint8)


def ruled_out(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Pairs of sets, by rows of their bits and sizes, that can't link: each bit of one alone is a shingle outside the intersection."""
    a, b = bits_a.view(np.uint64), bits_b.view(np.uint64)
    common = np.minimum(n_a - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), n_b - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
    return (NUMERATOR + DENOMINATOR) * common < NUMERATOR * (n_a + n_b)


def _mapped(batches):
    """(id, text) -> (id, bits)."""
    for batch in batches:
        off, _ = text_bytes(batch.column(1))
        for a, b in sliced(off):
            bounds, shingles = shingle_sets(batch.column(1).slice(a, b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in shingle_bits(shingles, bounds)], pa.binary())], names=["id", "bits"])


def _able(entries: DataFrame, classes: DataFrame, documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The entries (key, c, k, n, signature, shared, bits) of classes that can link yet: `shared` of their shingles occur in other open classes too."""
    wanted = entries.select(F.col("c").alias("_i")).distinct()
    texts = documents.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    texts = stored(texts.join(wanted, F.col("id") == F.col("_i"), "left_semi"), "open")
    sets = document_sets(texts, "id", "text")
    # An id of several texts has the shingles of all of them: no bound for one.
    rows = classes.groupBy(F.col("class_id").alias("_c")).agg(F.count(F.lit(1)).alias("texts"))
    shared = sets.select("doc_id", "n", "alone").join(rows, F.col("doc_id") == F.col("_c")).select("doc_id", F.when(F.col("texts") == 1, F.col("n") - F.col("alone")).alias("shared"))
    # Bits of several texts bound none of them.
    bits = texts.mapInArrow(_mapped, "id bigint, bits binary").groupBy("id").agg(F.when(F.count(F.lit(1)) == 1, F.first("bits")).alias("bits"))
    able = classes.join(shared, F.col("class_id") == F.col("doc_id")).withColumn("shared", F.coalesce("shared", "n")).where(DENOMINATOR * F.col("shared") >= NUMERATOR * F.col("n"))
    able = able.select("class_id", "n", "signature", "shared").join(bits, F.col("class_id") == F.col("id"), "left")
    out = stored(entries.join(able, F.col("c") == F.col("class_id")).select("key", "c", "k", "n", "signature", "shared", "bits"), "able")
    discard(texts, sets)
    return out


def _apart(entries: DataFrame) -> DataFrame:
    """Pairs of classes of different components that share a key, are within the signature distance and can link.

    A key's largest component has blocks of its own; every other class meets
    all blocks, so each pair of different components meets in one task.
    """
    sizes = entries.groupBy("key", "k").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("key").alias("_key")).agg(F.sum("n").alias("all"), F.max(F.struct("n", "k")).alias("top")).where(F.col("all") > F.col("top.n"))
    sizes = sizes.select("_key", F.col("top.k").alias("top"), F.ceil(F.col("top.n") / BLOCK_CLASSES).alias("tops"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK_CLASSES).alias("rests"))
    own, hashed = F.col("k") == F.col("top"), F.xxhash64("c")
    block = F.when(own, F.pmod(hashed, F.col("tops"))).otherwise(F.col("tops") + F.pmod(hashed, F.col("rests")))
    others = F.sequence(F.when(own, F.col("tops")).otherwise(F.lit(0)), F.col("tops") + F.col("rests") - 1)
    dealt = entries.join(sizes, F.col("key") == F.col("_key")).select("key", "c", "k", "n", "signature", "shared", "bits", block.alias("own"), F.explode(others).alias("other"))
    dealt = stored(dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "c", "k", "n", "signature", "shared", "bits"), "compared")

    # Many keys to a task's batch; those of one key and pair of blocks lie together.
    rows = dealt.count()
    batch = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(max(1, -(-rows // BATCH_ROWS))))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(x, "ascending") for x in ("key", "lo", "hi", "own")])
        key, lo, hi, own, c, k, n, shared = (table[x].to_numpy().astype(np.int64) for x in ("key", "lo", "hi", "own", "c", "k", "n", "shared"))
        signature, known = _as_signatures(table["signature"]), table["bits"].is_valid().to_numpy()
        bits = np.frombuffer(b"".join(b or bytes(MAP_BITS // 8) for b in table["bits"].to_pylist()), np.uint8).reshape(len(key), MAP_BITS // 8)
        last = np.append((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), True)
        # A row meets those after it in its group, and where two blocks meet those of the other block.
        here, end = np.arange(len(key)), np.flatnonzero(last)[np.cumsum(np.append(0, last[:-1]))]
        other = np.append(own[1:] != own[:-1], True) | last
        begin = np.where(lo == hi, here, np.flatnonzero(other)[np.cumsum(np.append(0, other[:-1]))]) + 1
        after = end + 1 - begin
        ends, at, found = np.cumsum(after), 0, []
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            many = after[at:to]
            x = np.repeat(np.arange(at, to), many)
            y = begin[x] + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
            fits = (k[x] != k[y]) & (DENOMINATOR * np.minimum(n[x], n[y]) >= NUMERATOR * np.maximum(n[x], n[y]))
            fits &= (NUMERATOR + DENOMINATOR) * np.minimum(shared[x], shared[y]) >= NUMERATOR * (n[x] + n[y])
            x, y = x[fits], y[fits]
            near = (signature[x] != signature[y]).sum(1) <= THRESHOLD
            x, y = x[near], y[near]
            fits = ~(known[x] & known[y] & ruled_out(bits[x], bits[y], n[x], n[y]))
            x, y = x[fits], y[fits]
            # A pair is told at the least key that it has in common.
            a, b = index_keys(signature[x]), index_keys(signature[y])
            first = np.where(a == b, a, np.uint64(0xFFFFFFFFFFFFFFFF)).min(1) == key[x].view(np.uint64) if len(x) else np.zeros(0, bool)
            found.append((np.minimum(c[x], c[y])[first], np.maximum(c[x], c[y])[first]))
            at = to
        return pa.table({"a": pa.array(np.concatenate([f[0] for f in found]), pa.int64()), "b": pa.array(np.concatenate([f[1] for f in found]), pa.int64())})

    return dealt.withColumn("batch", batch).groupBy("batch").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_copies(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each id: doc_id, n_shingles, component_id, class_id (smallest id of the same set)."""
    sets = stored(signed(documents, id_column, text_column), "signatures")
    least = F.min(F.struct("doc_id", "n", "signature"))
    classes = stored(sets.where("class_key is not null").groupBy("class_key").agg(least.alias("c")).select("class_key", F.col("c.doc_id").alias("class_id"), "c.n", "c.signature"), "classes")
    rows = classes.count()
    # Round 1: each key's classes with its pivot.
    star = stored(meeting(classes.withColumn("component", F.lit(0).cast("bigint")), rows, _star, "a bigint, b bigint").distinct(), "star")
    first = confirmed(_near(star, classes), documents, classes, id_column, text_column)
    # Round 2: classes of different components that share a key.
    label = components(first).withColumnRenamed("node", "_n")
    labelled = classes.join(label, F.col("class_id") == F.col("_n"), "left").select("class_id", F.coalesce("component", "class_id").alias("component"), "signature")
    entries = stored(meeting(labelled, rows, _open, "key bigint, c bigint, k bigint"), "entries")
    able = _able(entries, classes, documents, id_column, text_column)
    best = able.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("r"), "c", "k")).alias("p"))
    pulled = able.join(best, F.col("key") == F.col("_key")).where(F.col("k") != F.col("p.k")).select(F.col("p.c").alias("a"), F.col("c").alias("b")).distinct()
    pulled = confirmed(_near(stored(pulled, "pulled"), classes), documents, classes, id_column, text_column)
    label = components(first.unionByName(pulled)).withColumnRenamed("node", "_n")
    left = stored(able.drop("k").join(label, F.col("c") == F.col("_n"), "left").withColumn("k", F.coalesce("component", "c")).drop("_n", "component"), "left")
    second = confirmed(_apart(left), documents, classes, id_column, text_column).unionByName(pulled)
    # Ids of several texts connect the classes of these.
    named = sets.where("class_key is not null").select("doc_id", "class_key").join(classes.select(F.col("class_key").alias("_key"), "class_id"), F.col("class_key") == F.col("_key"))
    members = stored(named.select("doc_id", "class_id").distinct(), "members")
    several = members.groupBy(F.col("doc_id").alias("_d")).agg(F.min("class_id").alias("a"), F.max("class_id").alias("_b")).where("a <> _b")
    same = members.join(several, F.col("doc_id") == F.col("_d")).select("a", F.col("class_id").alias("b"))
    label = components(first.unionByName(second).unionByName(same)).withColumnRenamed("node", "_n")
    parts = members.join(label, F.col("class_id") == F.col("_n"), "left").groupBy(F.col("doc_id").alias("_d")).agg(F.min(F.coalesce("component", "class_id")).alias("component_id"), F.min("class_id").alias("class_id"))
    out = stored(sets.groupBy("doc_id").agg(F.max("n").alias("n_shingles")).join(parts, F.col("doc_id") == F.col("_d"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")), "near_copies")
    discard(sets, classes, star, first, entries, able, left, members)
    return out


def without_near_copies(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns, of the smallest id of each component; rows without an id stay, repeated rows too."""
    gone = near_copies(documents, id_column, text_column).where("doc_id <> component_id").select("doc_id")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(f"`{id_column}`").cast("bigint").alias("id"))
    return rows.join(gone, F.col("id") == F.col("doc_id"), "left_anti").select("row.*")
