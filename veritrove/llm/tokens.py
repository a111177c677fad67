"""Token ids as flat binary files.

Format, one folder:
  part-NNNNN.bin   ids of consecutive documents, little-endian unsigned
                   integers of `width` bytes (the narrowest that hold the vocabulary)
  part-NNNNN.idx   little-endian unsigned 64-bit: documents + 1 offsets, in ids
                   from the part's start; then the doc_ids, signed 64-bit
  manifest/        Parquet: part, docs, tokens, width, file

Documents are range-partitioned by id, or by another order that is asked for,
so parts in order hold ascending ids, or that order. A part's base - the ids before it - is the prefix sum of the parts' totals.
Files are memory-mapped where the folder is local and read whole otherwise.

Tokenising: white space always separates tokens of the word vocabulary, so a
text's ids are those of its words in order. Each distinct word of a batch is
encoded once, and a bounded cache keeps the words of earlier batches.

A task writes its files under a name of its own attempt and renames them, so a
lost executor's task can be run again.

Defined cases: null and empty texts are the end id only; repeated rows and
equal ids are documents of their own, in an unspecified order among equals;
rows without an id come first, are stored as the least 64-bit number and read
back as null; an empty table gives an empty folder and result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import TASK_BYTES, shared_dir, sliced, volume
from .words import FOLDED, PLAIN, Words, text_bytes

END_ID = 1
#: What the files have for a document without an id.
NO_ID = -(1 << 63)
#: Words kept by a worker's cache, over its tasks; beyond that the later half goes.
CACHE_WORDS = 250_000
#: Bytes of text encoded at once.
SLICE = 3 << 20
#: Words longer than this are encoded anew each time, to bound the cache's memory.
CACHE_WORD_BYTES = 64

MANIFEST = "part int, docs bigint, tokens bigint, width int, file string"


#: What opens a special token's string; one that stands between words that are encoded at once.
SPECIAL = b"<|"
PARTING = "<|startoftext|>"
#: ASCII marks but the apostrophe, which begins endings like 's.
MARKS = np.isin(np.arange(256), [c for c in range(33, 127) if not chr(c).isalnum() and c != 39])
PLAIN_ALNUM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: The last letter up to which lower-case letters are composed, so that the normaliser leaves words of them as they are.
PLAIN_MOST = "\u017f"
#: Words on which the model without normaliser and patterns must agree with the whole one, or it isn't used.
PROBES = ("a", "the", "tokenizer", "unverständlich", "garçon", "ñandú", "œuvre", "zzzzqxj", "ſtraße")
#: Marks at a word's end that are looked at; a word with more stays whole.
MOST_MARKS = 16


class Pieces(Words):
    """Words with A-Z folded, as the vocabulary's normaliser does it, and parted before the marks at their end.

    The pre-tokeniser parts a letter or digit and the marks after it whatever
    surrounds them, so ids of pieces follow each other. Words that may hold a
    special token's string, which isn't folded, stay as they are, and so do
    those with an apostrophe.
    """

    def __init__(self, column):
        super().__init__(column, PLAIN)

    @staticmethod
    def cut(raw, inside, starts, ends, of):
        folded = FOLDED.folded[raw]
        opens = np.flatnonzero((raw[:-1] == SPECIAL[0]) & (raw[1:] == SPECIAL[1]))
        special = np.unique(np.searchsorted(starts, opens, "right") - 1)
        for a, b in zip(starts[special].tolist(), ends[special].tolist(), strict=True):
            folded[a:b] = raw[a:b]
        whole = np.zeros(len(starts), bool)
        whole[special] = True
        whole[np.searchsorted(starts, np.flatnonzero(raw == 39), "right") - 1] = True
        left = np.flatnonzero(MARKS[folded[ends - 1]] & ~whole) if len(ends) else np.zeros(0, np.int64)
        at, first, found = ends[left] - 1, starts[left], []
        for _ in range(MOST_MARKS):
            on = at > first
            at, first = at[on] - 1, first[on]
            mark = MARKS[folded[at]]
            found.append(at[~mark & PLAIN_ALNUM[folded[at]]] + 1)
            at, first = at[mark], first[mark]
        parted = np.concatenate(found)
        return np.sort(np.append(starts, parted)), np.sort(np.append(ends, parted)), folded[inside]


class WordEncoder:
    """Token ids of texts, by the distinct pieces of their words."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.parting = self.tokenizer.token_to_id(PARTING)
        self.cache: dict[bytes, bytes] = {}
        # The same model without normaliser and patterns, for words that these leave whole.
        self.lean, self.ends = None, np.zeros(0, bool)
        parts = json.loads(tokenizer_json)
        suffix = parts["model"].get("end_of_word_suffix")
        if suffix:
            lean = Tokenizer.from_str(json.dumps({**parts, "normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
                {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}))
            if all(lean.encode(w, add_special_tokens=False).ids == self.tokenizer.encode(w, add_special_tokens=False).ids for w in PROBES):
                vocabulary = parts["model"]["vocab"]
                self.lean, self.ends = lean, np.zeros(max(vocabulary.values()) + 1, bool)
                self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True

    def leanly(self, words: list[str]) -> list[bytes]:
        """The ids of words of lower-case letters: a word's last token, and no other, ends one."""
        texts = [" ".join(words[a : a + 1000]) for a in range(0, len(words), 1000)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.lean.encode_batch_fast(texts, add_special_tokens=False)])
        data, ends = flat.tobytes(), np.flatnonzero(self.ends[flat]) + 1
        if len(ends) != len(words):
            raise ValueError("a word has no token that ends it")
        return [data[a:b] for a, b in zip((4 * np.append(0, ends[:-1])).tolist(), (4 * ends).tolist(), strict=True)]

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word: plain ones by the lean model, others many at a time with a special token between them where there is one."""
        if self.lean is not None:
            text = [w.decode("utf-8", "replace") for w in words]
            plain = [t.isalpha() and max(t) <= PLAIN_MOST and t == t.lower() for t in text]
            usual = iter(self.leanly([t for t, p in zip(text, plain, strict=True) if p]) if any(plain) else ())
            odd = [w for w, p in zip(words, plain, strict=True) if not p]
            others = iter(self.fully(odd) if odd else ())
            return [next(usual) if p else next(others) for p in plain]
        return self.fully(words)

    def fully(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word by the whole tokenizer."""
        if self.parting is None or any(SPECIAL in w for w in words):
            return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        texts = [PARTING.join([w.decode("utf-8", "replace") for w in words[a : a + 1000]]) + PARTING for a in range(0, len(words), 1000)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        data, ends = flat.tobytes(), np.flatnonzero(flat == self.parting)
        if len(ends) != len(words):
            raise ValueError("the vocabulary doesn't keep special tokens apart")
        return [data[a:b] for a, b in zip((4 * np.append(0, ends[:-1] + 1)).tolist(), (4 * ends).tolist(), strict=True)]

    def words(self, vocab: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the words."""
        ids = list(map(self.cache.get, vocab))
        new = [i for i, x in enumerate(ids) if x is None]
        odd = [i for i in new if SPECIAL in vocab[i]]
        usual = [i for i in new if SPECIAL not in vocab[i]] if odd else new
        for some in (usual[a : a + 20_000] for a in range(0, len(usual), 20_000)):
            for i, x in zip(some, self.encoded([vocab[i] for i in some]), strict=True):
                ids[i] = x
        for i, x in zip(odd, self.encoded([vocab[i] for i in odd]) if odd else (), strict=True):
            ids[i] = x
        self.cache.update((vocab[i], ids[i]) for i in new if len(vocab[i]) <= CACHE_WORD_BYTES)
        if len(self.cache) > CACHE_WORDS:  # the first to come are the most frequent
            self.cache = dict(islice(self.cache.items(), CACHE_WORDS // 2))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.append(0, np.cumsum(sizes)), np.frombuffer(b"".join(ids), np.uint32)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of documents, all ids), the end id after each document."""
        words = Pieces(texts)
        bounds, flat = self.words(words.vocab)
        begin, n = bounds[:-1].astype(np.int32), np.diff(bounds).astype(np.int32)[words.codes]
        # The end id is one more word, after each document's last.
        begin = np.insert(begin[words.codes], words.offsets[1:], len(flat))
        n = np.insert(n, words.offsets[1:], 1)
        total = np.cumsum(n, dtype=np.int64)
        offsets = np.append(0, total[words.offsets[1:] + np.arange(len(texts))])
        where = np.arange(offsets[-1], dtype=np.int64) + np.repeat(begin - (total - n), n)
        return offsets, np.append(flat, np.uint32(end_id))[where]


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer_json: str) -> WordEncoder:
    """The worker's encoder for a vocabulary; one at a time is kept."""
    name = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = WordEncoder(tokenizer_json)
    return _encoders[name]


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")


def write_tokens(documents: DataFrame, folder: str, tokenizer_json: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID, order: list[Column] | None = None) -> DataFrame:
    """Writes the folder and returns its manifest. Ascending ids, or the order of the columns `order`; parts of about TASK_BYTES * 4 of text."""
    spark = documents.sparkSession
    rows, size = volume(documents, text_column)
    parts = max(1, min(rows, -(-size // (4 * TASK_BYTES))))
    sc = spark.sparkContext
    shared = sc.broadcast(tokenizer_json)
    width = 2 if json.loads(tokenizer_json)["model"]["vocab"].__len__() + 1024 < 1 << 16 and end_id < 1 << 16 else 4
    schema = "part int, docs bigint, tokens bigint, width int, file string"

    def run(batches):
        encode, made = None, None
        fs, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        lengths, ids = [], []
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        out, tokens = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if encode is None:
                encode = encoder(shared.value)
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/_{name}.bin")
            off, _ = text_bytes(batch.column(1))
            for a, b in sliced(off, SLICE):
                bounds, flat = encode(batch.column(1).slice(a, b - a), end_id)
                if flat.max() >= 1 << (8 * width):
                    raise ValueError("a token id doesn't fit the file's width")
                out.write(flat.astype(f"<u{width}").tobytes())
                lengths.append(np.diff(bounds))
                tokens += int(bounds[-1])
            ids.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        lengths, ids = np.concatenate(lengths), np.concatenate(ids)
        with fs.open_output_stream(f"{root}/_{name}.idx") as f:
            f.write(np.append(0, np.cumsum(lengths)).astype("<u8").tobytes())
            f.write(ids.astype("<i8").tobytes())
        for kind in ("bin", "idx"):
            fs.move(f"{root}/_{name}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "docs": pa.array([len(ids)], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "width": pa.array([width], pa.int32()), "file": [name]}
        )

    by = ["id"] if order is None else [f"_order{i}" for i in range(len(order))]
    columns = [F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"), *[c.alias(n) for c, n in zip(order or (), by, strict=False)]]
    ordered = documents.select(*columns).repartitionByRange(parts, *by).sortWithinPartitions(*by).select("id", "text")
    ordered.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def read_part(folder: str, file: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, offsets, ids) of one part; ids are memory-mapped where the folder is local."""
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/{file}.idx") as f:
        idx = f.read()
    docs = (len(idx) // 8 - 1) // 2
    offsets = np.frombuffer(idx, "<u8", docs + 1)
    ids = np.frombuffer(idx, "<i8", docs, 8 * (docs + 1))
    if isinstance(fs, pafs.LocalFileSystem):
        flat = np.memmap(f"{root}/{file}.bin", f"<u{width}", "r") if offsets[-1] else np.zeros(0, f"<u{width}")
    else:
        with fs.open_input_file(f"{root}/{file}.bin") as f:
            flat = np.frombuffer(f.read(), f"<u{width}")
    return ids, offsets, flat


def bases(manifest: DataFrame) -> DataFrame:
    """The manifest with base: ids of all parts before. One row for each file, so a window over all of them is small."""
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids_crc32."""
    manifest = bases(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, offsets, flat = read_part(folder, r["file"], r["width"])
                off = offsets.astype(np.int64)
                for a in range(0, len(ids), 10_000):
                    b = min(len(ids), a + 10_000)
                    crc = [zlib.crc32(flat[s:e].astype("<u4").tobytes()) for s, e in zip(off[a:b], off[a + 1 : b + 1], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], mask=ids[a:b] == NO_ID), pa.array(off[a:b] + r["base"]), pa.array(np.diff(off[a : b + 1])), pa.array(crc, pa.int64())], schema=out)

    files = max(1, min(manifest.count(), 10_000))
    return manifest.repartition(files).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(documents: DataFrame, tokenizer_json: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the documents' token files (to a new shared folder, unless one is given) and reads them back."""
    folder = folder or f"{shared_dir(documents.sparkSession)}/tokens"
    write_tokens(documents, folder, tokenizer_json, **options)
    return read_tokens(documents.sparkSession, folder)
