"""Filter audit, prefix trie and MinHash near-dedup against brute force, with their edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veritrove.llm import filter_audit as A
from veritrove.llm import minhash as M
from veritrove.llm import prefix_trie as P

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id bigint, text string, source string, id string, mask int, part int, n int, good int, _id int"
WORDS = [f"w{i}" for i in range(400)]


def audit_rows(seed):
    r, rows = random.Random(seed), []
    texts = [None, "", " \n ", "short", "UP " * 60, "same word " * 40, " ".join(WORDS[:80]), " ".join(WORDS[:80]) + " #", " ".join(WORDS[10:200]).upper(), "é" * 30 + " " + " ".join(WORDS[:60]), "A&B " * 30, " ".join(WORDS * 30)]
    for i in range(120):
        rows.append((None if r.random() < 0.1 else r.randrange(60), r.choice(texts), r.choice([None, "", "a", "b"]), "x", 1, 2, 3, 4, 5))
    return rows


def audited(rows, labels):
    ids = collections.defaultdict(lambda: 1 << 70)
    for d, t, *_ in rows:
        ids[t or ""] = min(ids[t or ""], 1 << 65 if d is None else d)
    of = collections.defaultdict(lambda: collections.Counter())
    for d, t, s, *_ in rows:
        t = t or ""
        w = SPACE.findall(t)
        bad = "".join(f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), bool(set(t) & set("#$%&*|")), (1 << 65 if d is None else d) > ids[t]), strict=True) if x)
        y = labels.get(d, (0, 0)) if d is not None else (0, 0)
        of[s or ""][bad, y] += 1
    out = set()
    for part, docs in of.items():
        removed = collections.Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                count = lambda keep: sum(n for (bad, y), n in docs.items() if keep(bad, y))  # noqa: B023, E731
                here = lambda bad, k=k, f=f, order=order: f in bad and not set(order[:k]) & set(bad)
                gone = count(lambda bad, y: here(bad))
                removed[f] += gone
                steps.append((part, "".join(order), k + 1, count(lambda bad, y, k=k, order=order: not set(order[: k + 1]) & set(bad)), gone, count(lambda bad, y, f=f: f in bad and not here(bad)), count(lambda bad, y, f=f: bad == f),
                              count(lambda bad, y: here(bad) and y[0] == 1), count(lambda bad, y: here(bad) and y[1] == 1), f))
        out |= {(*s[:-1], removed[s[-1]]) for s in steps}
    return out


@pytest.mark.parametrize("slice_bytes", [16 << 20, 500])
def test_audit(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(A, "SLICE_BYTES", slice_bytes)
    rows = audit_rows(slice_bytes)
    labels = {i: (i % 2, i % 3 == 0) for i in range(0, 60, 2)}
    table = spark.createDataFrame([(i, q, int(t)) for i, (q, t) in labels.items()] + [(0, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = A.filter_audit(spark.createDataFrame(rows, DOCS).repartition(5), table)
    assert {tuple(r) for r in got.collect()} == audited(rows, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert A.filter_audit(spark.createDataFrame([], DOCS), labels).count() == 0
    one = A.filter_audit(spark.createDataFrame([(1, None, None, *"x12345")][:0] + [(1, None, None, "x", 1, 2, 3, 4, 5)], DOCS), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}


def test_chains_of_one_fingerprint():
    """Different texts of one fingerprint stay apart, and the smallest id of each stays, in any order."""
    for order in itertools.permutations([(b"x", 3), (b"x", 1), (b"y", 2), (b"y", 5), (b"x", 1)]):
        chains, out = A.Chains(), []
        for raw, doc in order:
            if found := chains.add(7, raw, doc, 0, {"p": 1}):
                out.append((found[0], sum(found[2].values())))
        assert sorted((raw, doc, parts["p"]) for _, raw, doc, _, parts in chains.rows()) == [(b"x", 1, 2), (b"y", 2, 1)]
        assert sorted(d for d, _ in out) == [3, 5]


def test_later_copies(spark):
    rows = [(3, "a", "s"), (1, "a", "s"), (2, None, "s"), (4, "", "s"), (None, "a", "s"), (1, "a", "t"), (9, "b", "s")]
    got = A.later_copies(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert sorted(got.collect(), key=repr) == sorted([(3,), (4,), (None,)], key=repr)


CONV = "conv_id bigint, turn bigint, role string, text string, d int, k1 int, c string, e string"


def trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    seq = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, s in seq.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(seq.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])[:h] + s[h:])
    members = collections.defaultdict(set)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    out = set()
    for node, cs in members.items():
        kids = [k for k in members if len(k) == len(node) + 1 and k[:-1] == node]
        below = [k for k in members if k[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(c for c in cs if full[c] == node))
        saved = sum((len(members[k]) - 1) * len(SPACE.findall(k[-1][1])) for k in below if k)
        leaves = sum(not any(len(x) == len(k) + 1 and x[:-1] == k for x in members) for k in below)
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 2)])
def test_trie(spark, monkeypatch, seed, block):
    monkeypatch.setattr(P, "BLOCK", block)
    r, rows = random.Random(seed), []
    for c in [*range(0, 130, 3), *range(200, 224), 21, 41, 61, -3, -40, 10**15]:
        for turn in range(r.randrange(1, 7)):
            rows.append((c, None if r.random() < 0.05 else turn, r.choice(["user", None]), r.choice(["a b", "a  b", "", None, "x y z"]), 1, 2, "c", "e"))
    rows += [(500, t % 3, "u", f"t {t % 7}", 1, 2, "c", "e") for t in range(60)]
    rows += [(None, 0, "u", "x", 1, 2, "c", "e"), (0, 0, "user", "a b", 1, 2, "c", "e"), (0, 0, "user", "a b", 1, 2, "c", "e")]
    got = P.prefix_trie(spark.createDataFrame(rows, CONV).repartition(3)).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(x) for x in got} == trie(rows)


def test_trie_of_little(spark):
    assert P.prefix_trie(spark.createDataFrame([], CONV)).count() == 0
    # A conversation that loses its only turn and whose family has no first one: the root is a leaf.
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    got = P.prefix_trie(spark.createDataFrame([(c, 0, "u", "x", 1, 2, "c", "e")], CONV)).collect()
    assert [tuple(x) for x in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def shingles(text):
    w = SPACE.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(texts):
    sets = [(d, shingles(t)) for d, t in texts if d is not None]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    size = {}
    for d, s in sets:
        size[d] = max(size.get(d, 0), len(s))
    return {(d, n, root(d)) for d, n in size.items()}


def family(r, base, edits):
    t = list(base)
    for _ in range(edits):
        t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
    return " ".join(t)


def test_near_copies(spark, monkeypatch, seed=2, block=5):
    """Families of edited copies around the threshold, a passage that many share, exact copies and odd texts, against all pairs."""
    monkeypatch.setattr(M, "BLOCK_CLASSES", block)
    monkeypatch.setattr(M, "BUCKET_SIGNATURES", 60)
    r = random.Random(seed)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts, passage = [None, "", " \t", "one", "ONE", "one two", "a b c d e", "A b c d e", "x " * 3000], words(150)
    for size in (40, 120, 400):
        base = words(size)
        texts += [family(r, base, r.randrange(6)) for _ in range(25)] + [" ".join(base)] * 3 + [" ".join(base[: size - k]) for k in range(1, size // 6, 3)]
    texts += [" ".join(passage + words(r.randrange(10, 60))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (30, texts[60]), (31, texts[31])]
    r.shuffle(rows)
    table = spark.createDataFrame([(*x, "s", "k", 1, 2) for x in rows], "doc_id bigint, text string, class_id string, key string, component int, n int").repartition(4)
    got = M.near_copies(table).select("doc_id", "n_shingles", "component_id").collect()
    assert len(got) == len({x.doc_id for x in got}) and {tuple(x) for x in got} == near(rows)
    kept = M.without_near_copies(table)
    want = {d for d, _, c in near(rows) if d == c}
    assert kept.columns == table.columns and {x.doc_id for x in kept.collect()} == want | {None}
    assert M.without_near_copies(table.where("false")).count() == 0


def test_signature_join_guarantee():
    """Any two signatures within the threshold have a key in common; a linked pair beyond it is rarer than MISS."""
    r = np.random.default_rng(5)
    assert sum(len(c) for c in M.CHUNKS) == M.VALUES and len(M.CHUNKS) * 2 > M.THRESHOLD
    base = r.integers(0, 1 << 16, (300, M.VALUES)).astype(np.uint16)
    other = base.copy()
    for i, row in enumerate(other):
        # As evenly over the chunks as it can be: the hardest case.
        for t in range(M.THRESHOLD):
            row[M.CHUNKS[(i + t) % len(M.CHUNKS)][t // len(M.CHUNKS)]] ^= 1
    assert ((base != other).sum(1) == M.THRESHOLD).all()
    assert (M.index_keys(base) == M.index_keys(other)).any(1).all()
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(words[:2600] + [f"x{i}" for i in range(59)])]
    bounds, s = M.shingle_sets(pa.array(texts))
    a, b = M.signatures(s, bounds)
    share = len(np.intersect1d(s[: bounds[1]], s[bounds[1] :])) / len(np.unique(s))
    assert abs((a != b).mean() - (1 - share)) < 0.12 and 0 < M.THRESHOLD < M.VALUES * 0.4


def test_pairs_ruled_out_by_bits():
    """No pair that links is ruled out; of pairs below the similarity, nearly all are before they leave a task."""
    import numpy as np

    from veritrove.llm import minhash as M

    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = [np.concatenate([base[k:], r.integers(0, 1 << 63, k).astype(np.uint64)]) for k in range(0, 40)] + [r.integers(0, 1 << 63, 9000).astype(np.uint64)]
    n = np.array([len(s) for s in sets])
    bits = M.shingle_bits(np.concatenate(sets), np.append(0, np.cumsum(n)))
    x, y = np.triu_indices(len(sets), 1)
    gone = M.ruled_out(bits[x], bits[y], n[x], n[y])
    common = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y, strict=True)])
    links = 100 * common >= 85 * (n[x] + n[y] - common)
    assert links.sum() > 50 and not (gone & links).any()
    assert (~links & ~gone).sum() < 0.2 * (~links).sum()
