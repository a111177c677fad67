"""A hierarchical Pitman-Yor language model of words in context, trained and applied in one exchange.

Restaurants. Every pair of words is a context with a restaurant of the words
that follow it; its parent is the restaurant of the pair's last word, and the
parent of those is the root, which serves words over a uniform base. A table of
a restaurant is a customer of its parent. Seating is Gibbs sampling of numbers
of tables: in each sweep every dish of a restaurant draws its number from the
conditional distribution given the restaurant's other tables and the parent's
probability (generalised Stirling numbers times what t new tables weigh; dishes
of one level move side by side, and dishes of more than STIRLING customers are
reseated in small groups). Probabilities of a token are averaged over the
samples kept, a text's score is the sum of their log10, and its perplexity
comes from that.

The root is seated first: its customers are one table for each word after each
different word before it, the state that the lower restaurants begin with.
Later sweeps below don't seat the root anew, which would take an exchange each.

Exchange. Tokens travel to buckets of their last context word, packed by slice,
so a bucket has all customers of that restaurant and of its children; the same
rows carry the counts of the base score. A word of over HOT_TOKENS training
tokens has several restaurants instead of one, by a class of the word before
it: children stay whole, every restaurant's probabilities add up to one, and no
restaurant outgrows a task. Each bucket returns one sum for each document.

Vocabulary. Counts of all words are taken over all training documents, and
every word is seated in the root, in parts of the hash space; between parts
only numbers of tables go round. Root probabilities of the ROOT_WORDS most
frequent words, at most, are broadcast (a bound of the broadcast, not of the
model); those of all others reach the buckets that have them by a join on the
word. Scores don't depend on which way a probability takes. Restaurants tell
words apart by 40 bits of their hash, and the words before a context word by 32;
counts and the base score rest on 64. Sums travel as multiples of 2^-40, under
10^-12.

Defined cases: null and empty texts are the end token only; without training
documents every token is unknown and the base score is that of counts of zero;
rows that share an id are taken for copies of one text and get a result each;
rows without an id are neither learnt from nor scored; ids must be integers;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, sliced, stored, volume
from .words import FOLDED, mix, pack, text_bytes, unpack, word_hashes

ROOT_WORDS = 500_000
#: Training text bytes whose words one part of the vocabulary should get.
PART_BYTES = 32 << 20
#: Text bytes whose tokens one bucket should get.
BUCKET_BYTES = 8 << 20
BUCKET_DOCS = 8192
#: Text bytes that are dealt at once: the more, the less often a word is sent.
SLICE = 8 << 20
#: Training tokens from which on a context word has several restaurants.
HOT_TOKENS = 500_000
#: Discounts and strengths of the root, of words and of pairs.
DISCOUNTS, STRENGTHS = (0.5, 0.75, 0.8), (1.0, 1.0, 1.0)
BURN_IN, SAMPLES = 1, 3
#: Customers of a dish up to which its tables are drawn from their exact distribution.
STIRLING = 96
#: The end token's number; words have hashes, and 0 stands before a text.
END = np.uint64(1)
START = np.uint64(0)
#: The bits of a word's number that restaurants know.
DISH = np.uint64((1 << 40) - 1)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, numbers) of the tokens of each text: its words, then the end."""
    bounds, numbers = word_hashes(texts, FOLDED)
    offsets = bounds + np.arange(len(bounds))
    out, word = np.full(offsets[-1], END), np.ones(offsets[-1], bool)
    word[offsets[1:] - 1] = False
    out[word] = np.maximum(numbers, np.uint64(2), out=numbers)
    return offsets, out


def before(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each token of its text, the nearer one first; START before a text."""
    near, far = np.empty_like(tokens), np.full_like(tokens, START)
    near[1:] = tokens[:-1]
    near[offsets[:-1]] = START
    far[1:] = near[:-1]
    far[offsets[:-1]] = START
    return near, far


def _parts(key: np.ndarray):
    if len(key):
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(key)).tolist(), strict=True):
            yield int(key[a]), slice(a, b)


def _rows(name: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=[name, "data"])


def _unpacked(blob: bytes, size: int) -> list[np.ndarray]:
    return unpack(pa.decompress(blob, size, codec="zstd", asbytes=True))


def _steps(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as differences, in their lower and upper bits."""
    steps = np.append(ascending[:1], np.diff(ascending)).astype(np.uint64)
    return (steps & np.uint64(0xFFFFFFFF)).astype(np.uint32), steps >> np.uint64(32)


def _climbed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.cumsum(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), dtype=np.uint64)


def _fixed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in multiples of 2^-40: lower 32 bits, and the rest."""
    n = np.round(x * 2.0**40).astype(np.int64)
    return (n & 0xFFFFFFFF).astype(np.uint32), n >> 32


def _unfixed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (low.astype(np.int64) | high.astype(np.int64) << 32) * 2.0**-40


def _scaled(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


# The root and what it is seated from.


def _pairs(buckets: int):
    """Training texts -> (bucket, different pairs of neighbours in a slice: a hash of the pair, the second word, their number)."""

    def run(batches):
        for batch in batches:
            off, _ = text_bytes(batch.column(0))
            for a, b in sliced(off, SLICE):
                bounds, word = tokens_of(batch.column(0).slice(a, b - a))
                near, _ = before(word, bounds)
                key = mix(mix(near) + word)
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                count, word, key = np.diff(np.append(first, len(key))), word[order[first]], key[first]
                bucket = _scaled(key, buckets)  # keys ascend, and so do buckets
                low = key & np.uint64(0xFFFFFFFF)
                middle = ((key >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
                yield _rows("bucket", [(k, pack(low[s].astype(np.uint32), middle[s], word[s], count[s])) for k, s in _parts(bucket)])

    return run


def _types(parts: int):
    """A bucket of pairs -> for each part of the vocabulary its words, how many different words stand before each, and how often it occurs."""

    def run(table: pa.Table) -> pa.Table:
        blobs = [unpack(b) for b in table["data"].to_pylist()]
        key = np.concatenate([b[0].astype(np.uint64) | b[1].astype(np.uint64) << np.uint64(32) for b in blobs])
        word, count = np.concatenate([b[2].astype(np.uint64) for b in blobs]), np.concatenate([b[3].astype(np.int64) for b in blobs])
        del blobs
        order = np.lexsort((key, word))
        key, word, count = key[order], word[order], count[order]
        new_word = np.append(True, word[1:] != word[:-1])
        new = new_word | np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new_word)
        word, contexts, count = word[first], np.add.reduceat(new.astype(np.int64), first), np.add.reduceat(count, first)
        part = (mix(word) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        word, contexts, count = word[order], contexts[order], count[order]
        return pa.Table.from_batches([_rows("part", [(k, pack(word[s], contexts[s], count[s])) for k, s in _parts(part[order])])])

    return run


def _merged(table: pa.Table) -> pa.Table:
    """A part's words, one row."""
    blobs = [unpack(b) for b in table["data"].to_pylist()]
    word, *counts = (np.concatenate([b[i].astype(k) for b in blobs]) for i, k in enumerate((np.uint64, np.int64, np.int64)))
    order = np.argsort(word)
    word = word[order]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    return pa.Table.from_arrays([table["part"][:1], pa.array([pack(word[first], *(np.add.reduceat(c[order], first) for c in counts))], pa.binary())], names=["part", "data"])


@cache
def stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: [c, t] says in how many weighted ways c customers sit at t tables."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, 0 : c + 1], np.log(np.maximum(c - discount * t, 0)) + out[c, 1 : c + 2])
    return out


def drawn_tables(customers: np.ndarray, tables: np.ndarray, of_restaurant: np.ndarray, parent: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """A Gibbs draw of every dish's number of tables, given the other tables of its restaurant and the parent's probability of it.

    of_restaurant: all tables of the dish's restaurant. A dish of one customer
    has one table; t tables have the weight S(c, t) * parent^t * the product of
    (strength + discount * (others + j)) for j < t.
    """
    out = np.minimum(customers, 1)
    some = np.flatnonzero((customers > 1) & (customers <= STIRLING))
    some = some[np.argsort(customers[some], kind="stable")]
    for c, s in _parts(customers[some]):
        of_size = stirling(discount, STIRLING)[c, 1 : c + 1]
        for i in np.split(some[s], range(65_536 // c, s.stop - s.start, max(1, 65_536 // c))):
            others = (of_restaurant[i] - tables[i])[:, None] + np.arange(c)
            weight = of_size + np.cumsum(np.log((strength + discount * others) * parent[i][:, None]), axis=1)
            share = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[i] = 1 + (share < (rng.random(len(i)) * share[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(customers > STIRLING)
    if len(many):
        out[many] = reseated(customers[many], (of_restaurant - tables)[many], parent[many], strength, discount, rng)
    return out


def reseated(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with many customers, who come one by one, and after the first 64 in groups of a 32nd of those seated."""
    out = np.ones(len(customers), np.int64)
    active, t, seated = np.arange(len(customers)), np.ones(len(customers)), 1
    while len(active):
        step = np.minimum(max(1, seated // 32) if seated >= 64 else 1, customers[active] - seated)
        new = (strength + discount * (others[active] + t)) * parent[active]
        t = t + rng.binomial(step, new / (new + np.maximum(seated - discount * t, 1e-12)))
        seated += max(1, seated // 32) if seated >= 64 else 1
        out[active] = t
        on = customers[active] > seated
        active, t = active[on], t[on]
    return out


@dataclass
class Root:
    """What every bucket needs of the whole corpus: ROOT_WORDS words at most, and 16 bytes for each hot one, of which there are fewer than tokens / HOT_TOKENS."""

    #: The most frequent words and their probabilities.
    words: np.ndarray
    probabilities: np.ndarray
    #: The probability of a word that isn't in the training texts.
    unseen: float
    tokens: int
    types: int
    ends: int
    #: Context words of several restaurants, sorted, and their training tokens; START has as many as there are texts.
    hot: np.ndarray
    hot_tokens: np.ndarray
    #: Training tokens that one restaurant should get.
    share: int

    def at(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in words, whether the number is there)."""
        if not len(self.words):
            return np.zeros(len(numbers), np.int64), np.zeros(len(numbers), bool)
        at = np.minimum(np.searchsorted(self.words, numbers), len(self.words) - 1)
        return at, self.words[at] == numbers

    def of(self, numbers: np.ndarray, rare: pa.Table | None) -> np.ndarray:
        """The root's probability of each word; rare has those of training words that aren't in `words`."""
        at, known = self.at(numbers)
        out = np.full(len(numbers), self.unseen)
        out[known] = self.probabilities[at[known]]
        if rare is not None and len(rare):
            words, first = np.unique(rare["word"].to_numpy().astype(np.int64).view(np.uint64), return_index=True)
            p = rare["p"].to_numpy()[first]
            at = np.minimum(np.searchsorted(words, numbers), len(words) - 1)
            known = words[at] == numbers
            out[known] = p[at[known]]
        return out


def restaurant(word: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The number of one of a hot word's restaurants."""
    return mix(word + np.uint64(0x9E3779B97F4A7C15) * (kind.astype(np.uint64) + np.uint64(1)))


def root_sweeps(contexts: np.ndarray, part: int, totals: list[int], base: float, seed: int):
    """The tables of a part's words after each sweep; totals has the root's tables before each."""
    tables, rng = np.minimum(contexts, 1), np.random.default_rng([seed, part])
    for total in totals:
        tables = drawn_tables(contexts, tables, np.full(len(contexts), total), np.full(len(contexts), base), STRENGTHS[0], DISCOUNTS[0], rng)
        yield tables


def vocabulary(training: DataFrame, text_column: str, size: int, seed: int, most: int = ROOT_WORDS, hot_tokens: int = HOT_TOKENS) -> tuple[Root, DataFrame | None]:
    """(the root, root probabilities (word, p) of all words that aren't in it).

    Each sweep draws all parts against the root's tables at its start. Parts
    draw the same numbers in each pass, so only sums of tables are kept.
    """
    buckets, parts = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // PART_BYTES))
    pairs = training.select(F.col(text_column).alias("t")).mapInArrow(_pairs(buckets), "bucket int, data binary")
    words = pairs.groupBy("bucket").applyInArrow(_types(parts), "part int, data binary")
    table = stored(words.groupBy("part").applyInArrow(_merged, "part int, data binary"), "vocabulary")

    def each(make, schema: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    word, contexts, count = unpack(blob)
                    yield make(part, word.astype(np.uint64), contexts.astype(np.int64), count.astype(np.int64))

        return table.mapInArrow(run, schema)

    def sums(part, word, contexts, count):
        levels, at = np.unique(np.floor(8 * np.log2(count)).astype(np.int64), return_inverse=True)
        least = np.full(len(levels), 1 << 62)
        np.minimum.at(least, at, count)
        columns = [levels, np.bincount(at), np.bincount(at, count).astype(np.int64), np.bincount(at, contexts).astype(np.int64), least]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["level", "n", "tokens", "contexts", "c"])

    by_size = each(sums, "level bigint, n bigint, tokens bigint, contexts bigint, c bigint").groupBy("level").agg(*[F.sum(c).alias(c) for c in ("n", "tokens", "contexts")], F.min("c").alias("c")).orderBy(F.desc("level")).collect()
    tokens, types, seats = (sum(r[k] for r in by_size) for k in ("tokens", "n", "contexts"))
    base, totals = 1.0 / (types + 1), [types]
    for _ in range(BURN_IN + SAMPLES):
        def tables(part, word, contexts, count, totals=tuple(totals)):
            *_, last = root_sweeps(contexts, part, totals, base, seed)
            return pa.RecordBatch.from_arrays([pa.array([int(last.sum())])], names=["t"])

        totals.append(int(each(tables, "t bigint").agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]))
    new = [(STRENGTHS[0] + DISCOUNTS[0] * t) * base for t in totals[1:]]

    def probabilities(part, word, contexts, count):
        p = np.zeros(len(word))
        for sweep, t in enumerate(root_sweeps(contexts, part, totals[:-1], base, seed)):
            if sweep >= BURN_IN:
                p += (contexts - DISCOUNTS[0] * t + new[sweep]) / (STRENGTHS[0] + seats)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count), pa.array(p / SAMPLES)], names=["word", "c", "p"])

    words = stored(each(probabilities, "word bigint, c bigint, p double"), "root")
    discard(table)
    # The least count with which at most `most` words are broadcast.
    least, n = 1 << 62, 0
    for r in by_size:
        if n + r.n > most:
            break
        least, n = r.c, n + r.n
    top = words.where(F.col("c") >= least).select("word", "p").toArrow()  # at most `most` rows of 16 bytes
    word, p = top["word"].to_numpy().astype(np.int64).view(np.uint64) & DISH, top["p"].to_numpy()
    order = np.argsort(word)
    # A corpus has fewer words of over hot_tokens tokens than tokens / hot_tokens.
    large = words.where((F.col("c") > hot_tokens) | (F.col("word") == F.lit(int(END)))).select("word", "c").toArrow()
    number, tokens_of_word = large["word"].to_numpy().astype(np.int64).view(np.uint64), large["c"].to_numpy().astype(np.int64)
    ends = int(tokens_of_word[number == END].sum())
    number, tokens_of_word = np.append(number, START), np.append(tokens_of_word, ends)
    many = np.flatnonzero((tokens_of_word > hot_tokens) & (number != END))
    many = many[np.argsort(number[many])]
    unseen = sum(new[BURN_IN:]) / SAMPLES / (STRENGTHS[0] + seats)
    root = Root(word[order], p[order], unseen, tokens, types, ends, number[many], tokens_of_word[many], hot_tokens)
    return root, words.where(F.col("c") < least).select(F.col("word").bitwiseAND(F.lit(int(DISH))).alias("word"), "p") if n < types else None


# Contexts.


def contexts_of(near: np.ndarray, far: np.ndarray, root: Root) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: key of the last context word's restaurant, 32 bits of the word before it, and the hot word's place from 1 on, or 0. Buckets ascend with keys."""
    before, place = (mix(far) >> np.uint64(32)).astype(np.uint32), np.zeros(len(near), np.int32)
    if len(root.hot):
        at = np.minimum(np.searchsorted(root.hot, near), len(root.hot) - 1)
        m = np.flatnonzero(root.hot[at] == near)
        place[m] = at[m] + 1
        parts = -(-root.hot_tokens[at[m]] // root.share)
        near = near.copy()
        near[m] = restaurant(near[m], before[m].astype(np.int64) % parts)
    return mix(near), before, place


def _deal(shared, buckets: int):
    """Texts -> (bucket, documents, contexts, words), sorted by context."""

    def run(batches):
        for batch in batches:
            ids_all = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            train_all = np.array(batch.column(2).to_pylist(), bool)
            off, _ = text_bytes(batch.column(1))
            for a, b in sliced(off, SLICE):
                bounds, word = tokens_of(batch.column(1).slice(a, b - a))
                context, far, place = contexts_of(*before(word, bounds), shared.value)
                word &= DISH
                order = np.argsort(context)
                doc = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(bounds))[order]
                # One by one: each old array goes before the next new one comes.
                context, rows = context[order], []
                far = far[order]
                place = place[order]
                word = word[order]
                del order
                for k, s in _parts(_scaled(context, buckets)):
                    first = np.flatnonzero(np.append(True, context[s][1:] != context[s][:-1]))
                    here, at = np.unique(doc[s], return_inverse=True)
                    ids = ids_all[a:b][here]
                    fars, far_at = np.unique(far[s], return_inverse=True)
                    words, word_at = np.unique(word[s], return_inverse=True)
                    blob = pack(
                        np.append(ids[:1], np.diff(ids)), train_all[a:b][here].astype(np.uint8), at, *_steps(context[s][first]), np.diff(np.append(first, s.stop - s.start)), place[s][first],
                        *_steps(fars), far_at, *_steps(words), word_at)
                    rows.append((k, len(blob), pa.compress(blob, codec="zstd", asbytes=True)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "size", "data"])

    return run


def _asked(shared, buckets: int):
    """Texts -> the (bucket, word) whose root probability isn't broadcast."""

    def run(batches):
        root: Root = shared.value
        for batch in batches:
            off, _ = text_bytes(batch.column(0))
            for a, b in sliced(off, SLICE):
                bounds, word = tokens_of(batch.column(0).slice(a, b - a))
                near, far = before(word, bounds)
                rare = np.flatnonzero(~root.at(word & DISH)[1])
                bucket, word = _scaled(contexts_of(near[rare], far[rare], root)[0], buckets), word[rare] & DISH
                order = np.lexsort((word, bucket))
                bucket, word = bucket[order], word[order]
                once = np.append(True, (bucket[1:] != bucket[:-1]) | (word[1:] != word[:-1]))[: len(word)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[once]), pa.array(word[once].view(np.int64))], names=["bucket", "word"])

    return run


def _renumbered(tables: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in tables of their own as places in one sorted table: (table, places)."""
    table, to = np.unique(np.concatenate(tables), return_inverse=True)
    to, starts = to.astype(np.int32), np.cumsum([0, *map(len, tables)])
    return table, np.concatenate([to[a : a + len(t)][p] for a, t, p in zip(starts, tables, places, strict=False)])


def _cells(context: np.ndarray, far: np.ndarray, word: np.ndarray, n_far: int, n_word: int):
    """Tokens in the order of (context, far, word): (order, cell of each, pair and word of each cell, context of each pair)."""
    pair = context.astype(np.int64) * n_far + far
    if int(pair.max(initial=0)) >= (1 << 62) // n_word:  # too many for one number: pairs are counted through first
        pairs, pair = np.unique(pair, return_inverse=True)
    else:
        pairs = None
    key = pair * n_word + word
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    cells = key[new]
    of_cell = cells // n_word
    new_pair = np.append(True, of_cell[1:] != of_cell[:-1])
    first = of_cell[new_pair] if pairs is None else pairs[of_cell[new_pair]]
    return order, np.cumsum(new, dtype=np.int32) - 1, np.cumsum(new_pair, dtype=np.int32) - 1, (cells % n_word).astype(np.int32), (first // n_far).astype(np.int32)


def predictive(cell_pair: np.ndarray, cell_dish: np.ndarray, dish_context: np.ndarray, customers: np.ndarray, root: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The averaged probability of each cell (a word after a pair of words), by Gibbs sampling.

    cell_pair: the pair's restaurant; cell_dish: the (context word, word) that
    the cell's tables are customers of; dish_context: that word's restaurant;
    customers: training tokens of each cell; root: the root's probability of
    each dish.
    """
    (_, d1, d2), (_, s1, s2) = DISCOUNTS, STRENGTHS
    n_pairs, n_contexts, n_dishes = (int(x.max(initial=-1)) + 1 for x in (cell_pair, dish_context, cell_dish))
    seated = np.bincount(cell_pair, customers, n_pairs)
    total = lambda at, x, n: np.bincount(at, x, n).astype(np.int64)
    upper = np.minimum(customers, 1)
    guests = total(cell_dish, upper, n_dishes)
    lower, mean = np.minimum(guests, 1), np.zeros(len(customers))

    def of_dish():
        tables = total(dish_context, lower, n_contexts)[dish_context]
        return (guests - d1 * lower + (s1 + d1 * tables) * root) / (s1 + total(dish_context, guests, n_contexts)[dish_context])

    for sweep in range(BURN_IN + SAMPLES):
        upper = drawn_tables(customers, upper, total(cell_pair, upper, n_pairs)[cell_pair], of_dish()[cell_dish], s2, d2, rng)
        guests = total(cell_dish, upper, n_dishes)
        lower = np.minimum(np.maximum(lower, guests > 0), guests)
        lower = drawn_tables(guests, lower, total(dish_context, lower, n_contexts)[dish_context], root, s1, d1, rng)
        if sweep >= BURN_IN:
            tables = total(cell_pair, upper, n_pairs)[cell_pair]
            mean += (customers - d2 * upper + (s2 + d2 * tables) * of_dish()[cell_dish]) / (s2 + seated[cell_pair])
    return mean / SAMPLES


def _score(shared, doc_buckets: int, seed: int):
    """A bucket of contexts, root probabilities of its rare words -> for each document the sums of its tokens here."""

    def run(table: pa.Table, rare: pa.Table | None) -> pa.Table:
        root: Root = shared.value
        bucket = table["bucket"][0].as_py()
        blobs = [_unpacked(*b) for b in zip(table["data"].to_pylist(), table["size"].to_pylist(), strict=True)]
        docs, doc = _renumbered([np.cumsum(b[0].astype(np.int64)) for b in blobs], [b[2] for b in blobs])
        train = np.concatenate([b[1].astype(bool)[b[2]] for b in blobs])
        contexts, context = _renumbered([_climbed(b[3], b[4]) for b in blobs], [np.repeat(np.arange(len(b[3]), dtype=np.int32), b[5].astype(np.int64)) for b in blobs])
        place = np.zeros(len(contexts), np.int64)
        for b in blobs:
            place[np.searchsorted(contexts, _climbed(b[3], b[4]))] = b[6]
        fars, far = _renumbered([_climbed(b[7], b[8]) for b in blobs], [b[9] for b in blobs])
        words, word = _renumbered([_climbed(b[10], b[11]) for b in blobs], [b[12] for b in blobs])
        del blobs
        # Cells are pairs of words with a word after them; their order is the tokens' from here on.
        order, cell, cell_pair, cell_word, pair_context = _cells(context, far, word, len(fars), len(words))
        del far, word
        doc = doc[order]
        train = train[order]
        context = context[order]
        del order
        dishes, cell_dish = np.unique(pair_context[cell_pair].astype(np.int64) * len(words) + cell_word, return_inverse=True)
        dish_context, dish_word = (dishes // len(words)).astype(np.int32), (dishes % len(words)).astype(np.int32)
        customers = np.bincount(cell, train, len(cell_pair)).astype(np.int64)
        p = predictive(cell_pair, cell_dish, dish_context, customers, root.of(words, rare)[dish_word], np.random.default_rng([seed, bucket]))
        del cell_pair, cell_word, cell_dish, dish_context, dish_word, customers, dishes
        logs = np.log10(np.maximum(p, 1e-300))[cell]
        # The word that is the context was a token too: its count is that of its customers, in all of its restaurants.
        count = np.bincount(context, train, len(contexts)).astype(np.int64)
        start = contexts == mix(np.array([START]))[0]
        several = np.flatnonzero(place)
        count[several] = root.hot_tokens[place[several] - 1]
        start[several] = root.hot[place[several] - 1] == START
        base, known = np.where(start, 0.0, np.log10(count + 0.5)), ~start & (count > 0)
        sums = [np.bincount(doc, minlength=len(docs)), *(np.bincount(doc, x, len(docs)) for x in (known[context], start[context], logs, base[context]))]
        to = (mix(docs.view(np.uint64)) % np.uint64(doc_buckets)).astype(np.int64)
        order = np.lexsort((docs, to))
        rows = []
        for k, s in _parts(to[order]):
            i = order[s]
            ids = docs[i]
            rows.append((k, pack(np.append(ids[:1], np.diff(ids)), *(x[i].astype(np.int64) for x in sums[:3]), *_fixed(sums[3][i]), *_fixed(sums[4][i]))))
        return pa.Table.from_batches([_rows("bucket", rows)])

    return run


TOTALS = "id bigint, copies bigint, n bigint, known bigint, score double, base double"


def _total(table: pa.Table) -> pa.Table:
    """A bucket of documents -> their sums; one start for each copy of a text."""
    blobs = [unpack(b) for b in table["data"].to_pylist()]
    ids = np.concatenate([np.cumsum(b[0].astype(np.int64)) for b in blobs])
    n, known, copies = (np.concatenate([b[i].astype(np.int64) for b in blobs]) for i in (1, 2, 3))
    score, base = (np.concatenate([_unfixed(b[i], b[i + 1]) for b in blobs]) for i in (4, 6))
    # In a set order, so that sums of floating-point numbers are the same in each run.
    order = np.lexsort((base, score, ids))
    cut = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1]))
    copies = np.add.reduceat(copies[order], cut)
    add = lambda x: np.add.reduceat(x[order], cut)
    columns = [ids[order][cut], copies, add(n) // copies, add(known) // copies, add(score) / copies, add(base) / copies]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=["id", "copies", "n", "known", "score", "base"])


def language_scores(documents: DataFrame, trains: Column, id_column: str = "doc_id", text_column: str = "text", seed: int = 11, root_words: int = ROOT_WORDS, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """One row for each row with an id: id, n_tokens, n_known, train_tokens, base_score, score (both log10) and perplexity.

    trains: whether a row's text is learnt from. Every text is scored.
    """
    sc = documents.sparkSession.sparkContext
    rows, size = volume(documents, text_column)
    buckets, doc_buckets = max(1, -(-size // BUCKET_BYTES)), max(1, -(-rows // BUCKET_DOCS))
    base = documents.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    root, others = vocabulary(base.where("trains"), "text", size, seed, root_words, hot_tokens)
    shared = sc.broadcast(root)
    dealt = base.mapInArrow(_deal(shared, buckets), "bucket int, size int, data binary")
    score = _score(shared, doc_buckets, seed)
    if others is None:
        sums = dealt.groupBy("bucket").applyInArrow(lambda table: score(table, None), "bucket int, data binary")
    else:
        rare = base.select("text").mapInArrow(_asked(shared, buckets), "bucket int, word bigint").join(others, "word").select("bucket", "word", "p")
        sums = dealt.groupBy("bucket").cogroup(rare.groupBy("bucket")).applyInArrow(lambda table, rare: score(table, rare), "bucket int, data binary")
    by_id = sums.groupBy("bucket").applyInArrow(_total, TOTALS).withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    # Each text's end token is no context: its count is added here.
    floor = F.log10(F.lit(root.tokens + 0.5 * (root.types + 1)))
    return by_id.select(
        "id", F.col("n").alias("n_tokens"), (F.col("known") + F.lit(1 if root.ends else 0)).alias("n_known"), F.lit(root.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.log10(F.lit(root.ends + 0.5)) - F.col("n") * floor).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n")).alias("perplexity"),
    )


__all__ = ["drawn_tables", "language_scores", "predictive", "stirling"]
