"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veritrove.llm import decontamination as D
from veritrove.llm import suffix_dedup as X
from veritrove.llm.components import components
from veritrove.llm.jaccard_join import deduplicated, near_duplicates
from veritrove.llm.licenses import TEMPLATES, license_scan, retrieval_probability
from veritrove.llm.mixing import curriculum, mixed, water_fill
from veritrove.llm.pitman_yor import language_scores
from veritrove.llm.quality import quality
from veritrove.llm.suffix_array import suffix_array
from veritrove.llm.tokens import token_files
from veritrove.llm.toxicity import fit, segments, toxicity
from veritrove.llm.warc import LoserTree, capture_index, url_key
from veritrove.llm import words as W
from veritrove.llm.words import ALNUM, FOLDED, PLAIN, Words, pack, unpack, windows, word_hashes

ALNUM_WORD = re.compile("[a-z0-9]+")
rng = random.Random(5)
LONG = " ".join(f"word{rng.randrange(5000)}" for _ in range(30_000))
SOME = " ".join(f"term{i}" for i in range(200))
TEXTS = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "one two"), (5, SOME), (5, SOME), (6, SOME + " more"), (7, LONG), (None, SOME), (8, "ünï ćode ünï ćode ünï ćode"), (9, "x" * 2000)]
EXTRA = "lang string, source string, n_chars bigint, row string, found string, size int, token int, component_id int, _x int"
SCHEMA = f"doc_id bigint, text string, {EXTRA}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None if k % 3 == 0 else f"s{k % 3}", k, "r", None, 1, 2, 3, None) for k, (i, t) in enumerate(TEXTS)], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (1, 3) and got[4] == (1, 3) and got[5] == (196, 5) and got[6] == (197, 5) and None not in got
    kept = deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 5, 7, 8, 9] and kept.where("doc_id is null").count() == 1
    assert near_duplicates(empty).count() == 0 and deduplicated(empty).count() == 0
    clashing = docs.unionByName(docs.where("doc_id = 9").withColumn("text", F.lit("a"))).withColumns({"_kept": F.lit(1), "id": F.lit("x"), "doc": F.lit(2)})
    kept = deduplicated(clashing)
    assert kept.columns == clashing.columns and {(r.id, r._kept) for r in kept.collect()} == {("x", 1)}
    assert [r.text for r in kept.where("doc_id = 9").collect()] == ["a"]


def test_jaccard_near_copies(spark):
    """A family of edited copies, a shared passage and unrelated texts, against all pairs."""
    r = random.Random(2)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base, passage, rows = words(120), words(60), []
    for i in range(60):
        t = list(base)
        for _ in range(r.randrange(5)):
            t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(60 + i, " ".join(passage + words(r.choice([0, 5, 12, 40])))) for i in range(40)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == label


def test_jaccard_links_inside_a_group(spark):
    """Three classes of one size and prefix, which no other document has in its prefix; the first links to neither of the others."""
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    passage, b = words("p", 19), words("b", 41)
    rests = [words("a", 41), b, [*b[:-1], "c"]]
    rows = [(i, " ".join(passage + rest)) for i, rest in enumerate(rests)]
    # Longer texts make all shingles of the rests shared, and more common than those of the passage.
    rows += [(10 * (i + 1) + j, " ".join(passage[-4:] + rest + words(f"own{i}x{j}x", 200))) for i, rest in enumerate(rests) for j in range(10)]
    got = {x.doc_id: (x.component_id, x.class_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: (1 if i == 2 else i, i) for i, _ in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_random_groups(spark, seed):
    """Texts of few passages and tails, edited or not, inside longer texts that make their shingles frequent, against all pairs."""
    r = random.Random(seed)
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    passages, tails = [words(f"p{k}x", r.randrange(12, 45)) for k in range(3)], [words(f"t{k}x", r.randrange(5, 60)) for k in range(6)]
    rows = []
    for i in range(70):
        t = [*r.choice(passages), *r.choice(tails), *(r.choice(tails)[: r.randrange(12)])]
        for _ in range(r.choice([0, 0, 1, 3])):
            t[r.randrange(len(t))] = f"e{r.randrange(30)}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join([*r.choice(passages)[-6:], *r.choice(tails), *words(f"own{i}x", 150)])) for i in range(25)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets} and len(set(label.values())) < len(rows) - 5


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (5, 5), (None, 3), (100, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[300] == 100
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality(docs).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept and got[2].n_words == 0
    assert got[8].n_repeat_words == 6 and got[8].word_chars == 21 and quality(empty).count() == 0 and quality(docs).count() == len(TEXTS)


@pytest.mark.parametrize(("most", "hot"), [(20_000, 100_000), (1, 100_000), (20_000, 2), (1, 1)])
def test_suffix_dedup(docs, empty, most, hot):
    got = [(r.row.doc_id, r.found.n_bytes, r.found.n_removed) for r in X.without_repeats(docs, keep=["doc_id", "row"], group_most=most, hot=hot).collect()]
    size = len(SOME)
    assert got.count((5, size, size)) == 2 and (6, size + 5, size) in got and (None, size, 0) in got and (0, 0, 0) in got and (9, 2000, 2000) in got
    assert X.without_repeats(empty).count() == 0


@pytest.mark.parametrize("small", [{}, {"BUCKET_BYTES": 2000, "BUCKET_DOCS": 3, "SLICE": 3000, "CONTEXT_BYTES": 500}])
def test_suffix_dedup_random(spark, monkeypatch, small):
    """Against every byte's window, with one bucket and with many."""
    for name, value in small.items():
        monkeypatch.setattr(X, name, value)
    r = random.Random(3)
    parts = ["".join(r.choice("abcdé ") for _ in range(r.randrange(150, 700))) for _ in range(12)]
    rows = [(i, "".join(r.choice(parts) + r.choice(["", "-", "—" * 3]) for _ in range(r.randrange(1, 4)))) for i in range(40)]
    seen: dict[bytes, int] = {}
    for _, t in rows:
        b = t.encode()
        for k in range(len(b) - 399):
            seen[b[k : k + 400]] = seen.get(b[k : k + 400], 0) + 1
    for x in X.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), with_text=True).collect():
        b = x.row.text.encode()
        gone = {p for k in range(len(b) - 399) if seen[b[k : k + 400]] > 1 for p in range(k, k + 400)}
        assert x.found.kept == bytes(c for p, c in enumerate(b) if p not in gone)


def test_suffix_array():
    r = random.Random(1)
    for _ in range(500):
        s = [r.randrange(r.choice([1, 2, 4, 20])) for _ in range(r.randrange(30))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_tokens(docs, empty):
    vocabulary = corpus_pipeline.word_vocabulary()
    rows = sorted(token_files(docs.where("doc_id is not null"), vocabulary).collect(), key=lambda r: (r.doc_id, r.start))
    assert [r.n_tokens for r in rows[:3]] == [1, 1, 1] and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert token_files(empty, vocabulary).count() == 0
    assert sorted(((r.start, r.doc_id) for r in token_files(docs.where("doc_id is null or doc_id = 5"), vocabulary).collect()))[0] == (0, None)


def test_tokens_of_any_text():
    """Ids by pieces are those of whole texts: marks, cases, special tokens, composed letters, U+0000 and odd white space."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from veritrove.llm.tokens import WordEncoder

    vocabulary = corpus_pipeline.word_vocabulary()
    whole, encode, r = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), WordEncoder(vocabulary), random.Random(8)
    parts = ["a", "B", "é", "É", "e\u0301", "\u0301", "'s", "'S", "!", "--", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", " ", "\n", "\x00", "\x0b", "\x1c", "\u00a0", "9", "don't", "ß", "İ", "日本", "x.y!", "?!?", "abc!!!", "\x7f"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(5000)] + ["x" + "!" * 40, "", None, "<|a!"]
    bounds, ids = encode(pa.array(texts, pa.string()), 1)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 1]


def test_warc(spark):
    rows = [(1, "http://www.A.example.com/x/", "same"), (2, "https://b.example.com", "same"), (3, None, None), (4, "", ""), (5, "http://[bad", "other"), (6, "http://a.example.com/x", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("range", F.lit(1)).withColumn("file", F.lit("f"))
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in capture_index(pages).collect()}
    assert got == {1: ("response", None, 4), 2: ("revisit", 1, 4), 3: ("response", None, 0), 4: ("revisit", 3, 0), 5: ("response", None, 5), 6: ("revisit", 1, 4)}
    assert capture_index(pages.where("page_id < 0")).count() == 0
    assert url_key("http://www.A.example.com:80/x/?b=2&a=1") == "com,example,a)/x?a=1&b=2" and url_key(None) == ""
    odd = spark.createDataFrame([(None, "http://z.org", "same"), (None, None, None), (2**50, "http://a.org", "b"), (-5, "http://a.org", "b"), (7, "x", "y"), (7, "x", "y")], "page_id bigint, url string, html string")
    got = sorted(((r.history, r.page_id, r.record_type, r.refers_to) for r in capture_index(odd, archive_bytes=1, range_rows=2).collect()))
    assert [r[0] for r in got] == list(range(6)) and {r[1:] for r in got} == {(None, "response", None), (-5, "response", None), (2**50, "revisit", -5), (7, "response", None)}
    runs = [sorted(rng.choices(range(9), k=k)) for k in (5, 0, 3, 8, 1)]
    assert list(LoserTree(runs, lambda v: v)) == sorted(sum(runs, []))


def test_licenses(spark, docs, empty):
    rows = [(1, f"Some words before. {TEMPLATES['MIT']}. And after; {TEMPLATES['GPL-3.0'].upper()}"), (2, "the license of the work under which"), (3, None)]
    got = [(r.row.doc_id, [m.license for m in r.found.matches]) for r in license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == [(1, ["MIT", "GPL-3.0"]), (2, []), (3, [])]
    assert license_scan(docs).count() == len(TEXTS) and license_scan(empty).count() == 0 and retrieval_probability(0.5) > 0.99


def test_license_recall():
    """Bands retrieve at least 0.99 of what an exact search of every window verifies, edited templates included."""
    import numpy as np

    from veritrove.llm.licenses import SHINGLE, Library, blocks, retrieved, verified

    r, library = random.Random(12), Library()
    texts = []
    for _ in range(600):
        words = ALNUM_WORD.findall(TEMPLATES[r.choice(library.names)].lower())
        for _ in range(r.choice([0, 0, 1, len(words) // 25, len(words) // 12])):
            words[r.randrange(len(words))] = f"edit{r.randrange(99)}"
        around = [[f"w{r.randrange(10**6)}" for _ in range(r.randrange(80))] for _ in range(2)]
        texts.append(" ".join(around[0] + words + around[1]))
    words_at, hashes = word_hashes(pa.array(texts), ALNUM)
    offsets, shingles = windows(hashes, words_at, SHINGLE)
    got, wanted = {(t, row) for t, row, a, b in retrieved(shingles, offsets, library) if verified(shingles[a:b], library.shingles[t])}, set()
    for size, members in library.classes:
        for start, row in zip(*(x.tolist() for x in blocks(offsets, size)[:2]), strict=True):
            part = shingles[start : min(start + 3 * size, offsets[row + 1])]
            wanted |= {(t, row) for t in members if np.isin(part, library.shingles[t]).sum() >= 0.8 * len(library.shingles[t]) and verified(part, library.shingles[t])}
    assert len(wanted) >= 600 * 0.7 and got <= wanted and len(got) >= 0.99 * len(wanted)


def test_mixing(docs, empty):
    rows = mixed(docs, keep=["doc_id", "size"]).collect()
    assert len(rows) == len(TEXTS) and all(r.taken <= 3 * r.size for r in rows) and sum(r.size for r in rows) == pytest.approx(sum(r.taken for r in rows), abs=3)
    assert curriculum(docs).columns == docs.columns and mixed(empty).count() == 0 and curriculum(empty).count() == 0
    assert sum(water_fill([("a", 5.0, 10), ("b", 1.0, 1000), ("c", 1.0, 0)], 1010.0, 3.0).values()) == pytest.approx(1010)


def test_mixing_schedules_every_copy(spark):
    """By each training time every source has used its schedule's share, one that is repeated max_repeats times too."""
    rows = [(k, " ".join(["w"] * 10), s) for k, s in enumerate(["a"] * 300 + ["b"] * 20 + ["c"] * 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixed(df).collect()
    target = {r.row.source: r.target for r in found}
    assert target["b"] == 600 and target["c"] == pytest.approx(2800 / 6)
    used = lambda t: {s: target[s] * (t * (1 + k) - k * t * t) for s, k in (("a", 0.5), ("b", 0.0), ("c", -0.5))}
    order = [r.source for r in curriculum(df).collect()]
    for t in (k / 12 for k in range(1, 13)):
        now = used(t)
        first = order[: round(sum(now.values()) / 10)]
        assert all(abs(10 * first.count(s) - n) <= 40 for s, n in now.items())
    assert all(len(r.positions) == 3 and r.positions[0] == r.position for r in found if r.row.source == "b")


def test_segments_are_linear():
    """Scores whose candidates never join cost no more for each token in a text that is 16 times as long."""
    import time

    import numpy as np

    def took(n):
        start = time.process_time()
        segments(np.tile([1.0, -2.0], n))
        return time.process_time() - start

    took(1000)
    assert took(160_000) < 64 * max(took(10_000), 0.005)


def test_toxicity(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.found.score for r in toxicity(docs, fit(docs, none)).collect()] == [0.0] * len(TEXTS)
    one = spark.createDataFrame([(5, 1), (7, 1), (77, 0), (3, None)], "doc_id bigint, toxic int")
    assert all(r.found.score == 1.0 for r in toxicity(docs, fit(docs, one)).collect()) and toxicity(empty, fit(empty, one)).count() == 0


def test_segments():
    def brute(s):
        """All maximal scoring segments: the best one, then the same left and right of it."""
        best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        a, b = best[3], best[4]
        return [*brute(s[:a]), (a, b), *[(x + b, y + b) for x, y in brute(s[b:])]]

    import numpy as np

    r = random.Random(4)
    for _ in range(300):
        s = [r.choice([-3.0, -1.0, 1.0, 2.0]) + r.random() / 7 for _ in range(r.randrange(12))]
        assert [(a, b) for a, b, _ in segments(np.array(s))] == brute(s)


@pytest.mark.parametrize("block", [1 << 24, 1])
def test_decontamination(spark, docs, empty, block):
    items = [(1, " ".join(f"Term{i}" for i in range(50, 65))), (2, "ONE, two!"), (3, None), (4, ""), (5, "word never there")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(r.row.doc_id): (r.found.n_hit, r.found.items) for r in D.contamination(docs, bench, block_bytes=block).collect()}
    assert got[5] == (15, ["1"]) and got[3] == (2, ["2"]) and got[0] == (0, []) and got[7] == (0, [])
    assert D.decontaminated(docs, bench).columns == docs.columns
    assert D.contamination(empty, bench).count() == 0 and D.contamination(docs, bench.where("false")).where("found.n_hit > 0").count() == 0
    assert D.longest_matches(pa.array([SOME]), [("1", items[0][1])]) == [(0, "1", 50, 0, 15)]
    twice = spark.createDataFrame([("a", items[0][1]), ("a", items[0][1]), ("a", items[0][1] + " y"), ("b", "Term1 term2")], "item_id string, text string")
    got = {(r.row.doc_id): (r.found.n_hit, r.found.items, r.found.longest) for r in D.contamination(docs, twice, block_bytes=block).collect()}
    assert got[5] == (17, ["a", "b"], 15) and got[0] == (0, [], 0)


def test_language_scores(docs, empty):
    for trains in (F.col("doc_id") < 7, F.lit(False)):
        rows = language_scores(docs, trains).collect()
        got = {r.id: r for r in rows}
        assert got[0].n_tokens == 1 and got[7].n_tokens == 30_001 and all(r.score <= 0 and r.perplexity >= 1 for r in rows)
        assert [r.n_tokens for r in rows if r.id == 5] == [201, 201] and len(rows) == len(TEXTS) - 1
    assert language_scores(empty, F.lit(True)).count() == 0


def test_language_hot_words(spark):
    """Words of several restaurants: the same counts, and scores that are still probabilities near those of one restaurant."""
    r = random.Random(9)
    rows = [(i, " ".join(f"w{int(40 * r.random() ** 3)}" for _ in range(60))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, several = ({x.id: x for x in language_scores(df, F.col("doc_id") < 60, hot_tokens=n).collect()} for n in (10**6, 100))
    for i, x in one.items():
        assert (x.n_tokens, x.n_known, x.train_tokens) == (several[i].n_tokens, several[i].n_known, several[i].train_tokens) and x.base_score == pytest.approx(several[i].base_score, rel=1e-12)
        assert x.score == pytest.approx(several[i].score, rel=0.2)


def test_language_model_sums_to_one():
    """The probabilities of all words after a pair add up to one, whatever is known of the pair and its last word."""
    import numpy as np

    from veritrove.llm.pitman_yor import predictive

    draw, words, pairs, contexts = np.random.default_rng(3), 30, 12, 4
    root = draw.dirichlet(np.ones(words))
    pair, word = np.repeat(np.arange(pairs), words), np.tile(np.arange(words), pairs)
    context = pair % contexts
    customers = draw.poisson(draw.choice([0.0, 0.3, 4.0, 200.0], pairs * words))
    customers[pair < 2] = 0
    p = predictive(pair, context * words + word, np.repeat(np.arange(contexts), words), customers, np.tile(root, contexts), draw)
    assert np.bincount(pair, p) == pytest.approx(np.ones(pairs), abs=1e-12) and (p > 0).all()


def test_language_seating_is_exact():
    """Draws of a dish's tables follow the distribution that all ways to seat its customers give."""
    import numpy as np

    from veritrove.llm.pitman_yor import drawn_tables, stirling

    def partitions(n):
        if n == 0:
            yield []
            return
        for rest in partitions(n - 1):
            yield [*rest, 1]
            for k in range(len(rest)):
                yield [*rest[:k], rest[k] + 1, *rest[k + 1 :]]

    c, d, strength, others, parent = 6, 0.75, 1.0, 3, 0.05
    weights, ways = np.zeros(c + 1), np.zeros(c + 1)
    for sizes in partitions(c):
        inside = np.prod([j - d for n in sizes for j in range(1, n)])
        ways[len(sizes)] += inside
        weights[len(sizes)] += inside * np.prod([(strength + d * (others + j)) * parent for j in range(len(sizes))])
    assert np.exp(stirling(d, 96)[c, 1 : c + 1]) == pytest.approx(ways[1:])
    n = 200_000
    drawn = drawn_tables(np.full(n, c), np.full(n, 2), np.full(n, others + 2), np.full(n, parent), strength, d, np.random.default_rng(1))
    assert np.bincount(drawn, minlength=c + 1) / n == pytest.approx(weights / weights.sum(), abs=0.005)


def test_language_scores_by_hand(spark):
    """Where every word occurs once all dishes have one table, and scores follow from counts alone."""
    import math

    from veritrove.llm.pitman_yor import DISCOUNTS, STRENGTHS

    train, rows = ["a b c", "d e", "f"], [(0, "a b c"), (1, "d e"), (2, "f"), (10, "a b x"), (11, "b c"), (12, ""), (13, "y d e")]
    seen, types, pairs, contexts = set(), set(), {}, {}
    for t in train:
        words = ["^", "^", *t.split(), "$"]
        for u, v, w in zip(words, words[1:], words[2:], strict=False):
            types.add(w)
            seen.add((v, w))
            pairs.setdefault((u, v), {}).setdefault(w, 0)
            pairs[u, v][w] += 1
    for (_, v), dishes in pairs.items():
        for w in dishes:
            contexts.setdefault(v, {}).setdefault(w, 0)
            contexts[v][w] += 1
    n1 = {w: sum(1 for _, x in seen if x == w) for w in types}
    (d0, d1, d2), (s0, s1, s2) = DISCOUNTS, STRENGTHS
    # The end stands after three words: its number of tables in the root is drawn, and the only one that is.
    base = 1 / (len(types) + 1)
    table_sums = []
    for ends in range(1, n1["$"] + 1):
        total = len(types) - 1 + ends
        table_sums.append({w: (n1.get(w, 0) - (0 if w not in types else d0 * (ends if w == "$" else 1)) + (s0 + d0 * total) * base) / (s0 + len(seen)) for w in [*types, "?"]})

    def score(t, root):
        total, words = 0.0, ["^", "^", *t.split(), "$"]
        for u, v, w in zip(words, words[1:], words[2:], strict=False):
            p = root.get(w, root["?"])
            for dishes, d, s in ((contexts.get(v, {}), d1, s1), (pairs.get((u, v), {}), d2, s2)):
                c = dishes.get(w, 0)
                p = (c - (d if c else 0) + (s + d * len(dishes)) * p) / (s + sum(dishes.values()))
            total += math.log10(p)
        return total

    got = {r.id: r.score for r in language_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") < 10).collect()}
    for i, t in rows:
        every = [score(t, root) for root in table_sums]
        assert min(every) - 1e-9 <= got[i] <= max(every) + 1e-9 and max(every) - min(every) < 0.5


def test_language_scores_at_mean_tables(spark):
    """Probabilities are averaged over the samples: where the end's tables in the root alone are drawn, all scores are those of one mean number of them, which needn't be whole."""
    import math

    from veritrove.llm.pitman_yor import DISCOUNTS, SAMPLES, STRENGTHS

    def triples(t):
        words = ["^", "^", *t.split(), "$"]
        return list(zip(words, words[1:], words[2:], strict=False))

    train, rows = ["a b c", "d e", "f"], [(0, "a b c"), (1, "d e"), (2, "f"), (10, "a b x"), (11, "b c"), (12, ""), (13, "y d e")]
    seen = {x for t in train for x in triples(t)}  # each once
    pairs, types = {(v, w) for _, v, w in seen}, {w for _, _, w in seen}
    (d0, d1, d2), (s0, s1, s2) = DISCOUNTS, STRENGTHS

    def score(t, ends):
        total = 0.0
        for u, v, w in triples(t):
            contexts = sum(x == w for _, x in pairs)
            p = (contexts - d0 * (ends if w == "$" else min(contexts, 1)) + (s0 + d0 * (len(types) - 1 + ends)) / (len(types) + 1)) / (s0 + len(pairs))
            for here, d, s in (({x for y, x in pairs if y == v}, d1, s1), ({x for a, y, x in seen if (a, y) == (u, v)}, d2, s2)):
                p = ((w in here) * (1 - d) + (s + d * len(here)) * p) / (s + len(here))
            total += math.log10(p)
        return total

    got = {r.id: r.score for r in language_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") < 10).collect()}
    assert any(all(abs(got[i] - score(t, n / SAMPLES)) < 1e-9 for i, t in rows) for n in range(SAMPLES, len(train) * SAMPLES + 1))


def test_language_root_has_every_word(spark):
    """A word's score doesn't depend on how many root probabilities are broadcast, and a rare word beats an unseen one."""
    r = random.Random(6)
    rows = [(i, " ".join(f"w{int(400 * r.random() ** 3)}" for _ in range(100))) for i in range(60)] + [(98, "once"), (100, "w399 once"), (101, "w399 never"), (102, "w0 w1 w2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [{x.id: x.score for x in language_scores(df, F.col("doc_id") < 100, root_words=n).collect()} for n in (500_000, 50, 0)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows) and all(g[100] > g[101] for g in got)


def test_kernels():
    w = Words(pa.array(["Ab, c-d", None, "", "É1  x"]), ALNUM)
    assert [w.vocab[c] for c in w.codes] == [b"ab", b"c", b"d", "É1".encode(), b"x"] and w.counts().tolist() == [3, 0, 0, 2]
    import re

    for of, pattern in ((PLAIN, rb"[^\x20\x09-\x0D]+"), (ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for byte in range(256):  # as binary: most bytes are no text of their own
            data = b"a" + bytes([byte]) + b"b " + bytes([byte])
            w = Words(pa.array([data], pa.binary()), of)
            folded = data.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) if of is ALNUM else data
            assert [w.vocab[c] for c in w.codes] == re.findall(rb"(?:(?![A-Z])" + pattern[:-1] + rb")+" if of is ALNUM else pattern, folded)
    p = Words(pa.array(["a b", "c"]).slice(1), PLAIN)
    assert p.vocab == [b"c"]
    off, h = windows(Words(pa.array(["a b c", "a b", "a"]), PLAIN).hashes()[[0, 1, 2, 0, 1, 0]], Words(pa.array(["a b c", "a b", "a"]), PLAIN).offsets, 2)
    assert off.tolist() == [0, 2, 3, 4] and h[0] == h[2] != h[3]
    assert [a.tolist() for a in unpack(pack(h, off))] == [h.tolist(), off.tolist()]


FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_near_duplicates(rows):
    """Ids that are the least of their components, by all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in links:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return {i for i, x in label.items() if i == x}


def brute_clean(rows, items):
    """Ids of texts that hold no window of an item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows_of = {}
    for t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows_of.setdefault(n, set()).add(tuple(w[k : k + n]))
    return {i for i, t in rows if not any(tuple(w[k : k + n]) in found for w in [words(t)] for n, found in windows_of.items() for k in range(len(w) - n + 1))}


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes wherever they stand, in whatever piece and case; different ones differ."""
    r = random.Random(4)
    texts = [None, "", *(" ".join(r.choice(["a", "Ab", "aB", "ba", "x" * 90, "x" * 91, "é", "z\0"]) for _ in range(r.randrange(40))) for _ in range(50))]
    for most in (W.HASH_BYTES, 64):
        monkeypatch.setattr(W, "HASH_BYTES", most)
        W._powers.cache_clear()
        for of in (PLAIN, FOLDED, ALNUM):
            words, (offsets, hashes) = Words(pa.array(texts), of), word_hashes(pa.array(texts), of)
            assert offsets.tolist() == words.offsets.tolist() and len(set(zip(words.codes.tolist(), hashes.tolist(), strict=True))) == len(set(words.codes.tolist())) == len(set(hashes.tolist()))
    W._powers.cache_clear()


def test_pipeline_stages(spark, tmp_path):
    """Every stage against brute force on what the one before kept, on the smallest tables and on an empty one."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for where in ("true", "false"):
        now = docs.where(where)
        for name, stage in corpus_pipeline.STAGES:
            rows, out = [(r.doc_id, r.text) for r in now.collect()], stage(spark, now, sf)
            if name != "token_files":
                assert out.columns == docs.columns
            got = [r.doc_id for r in out.collect()]
            if name == "near_duplicates":
                assert set(got) == brute_near_duplicates(rows) and len(got) == len(set(got))
            elif name == "decontamination":
                assert set(got) == brute_clean(rows, items)
            elif name == "toxicity":
                assert set(got) <= {i for i, _ in rows} and len(got) >= 0.8 * len(rows)
            elif name == "mixing":
                size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows}
                assert sum(size[i] for i in got) == pytest.approx(sum(size.values()), rel=0.1) and all(got.count(i) <= 3 for i in set(got))
                order = got
            path = str(tmp_path / f"{name}-{where}")
            out.write.parquet(path)
            now = spark.read.schema(out.schema).parquet(path)
        assert [r.doc_id for r in now.orderBy("start").collect()] == order  # token files hold the training order
        assert (now.count() > 0) == (where == "true")
