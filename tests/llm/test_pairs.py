"""Hard negatives, cross-tokenizer alignment and odd sketches, against brute force."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import alignment, minhash, negatives
from trailmark.llm.jaccard import shingle_set

from test_corpus import brute_components, corpus, table

# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, v STRING, score STRING, rank STRING"  # names that the operator uses itself


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, c, "v", "s", "r") for i, e, c in rows], VECTORS)


def brute_negatives(rows, every=100):
    kept = {}
    for i, e, c in rows:
        if i is None or e is None or c is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in e]
        row = ((c + 1) % 10 if i % 7 == 0 else c, v)
        kept[i] = min(kept.get(i, row), row)
    out = set()
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, c) for i, (c, w) in kept.items() if i != a)
        for minus, p, _ in [s for s in scored if s[2] == label][:5]:
            score = -minus
            hard = [(i, -s) for s, i, c in scored if c != label and 80 * score <= 100 * -s <= 100 * score][:5]
            out |= {(a, p, rank, i, score, s) for rank, (i, s) in enumerate(hard, 1)}
    return out


def random_vectors(seed, n=900, tight=False):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, 12))
    rows = []
    for i in range(n):
        x = centres[rnd.integers(6)] + rnd.normal(size=12) * 0.05 if tight else rnd.normal(size=12)
        rows.append((i * 5 % (n * 4), (x / np.linalg.norm(x)).tolist(), int(rnd.integers(4))))
    hot = rows[0][1]
    rows += [(n * 4 + i, hot, i % 3) for i in range(150)]  # one very common vector: ties by vec_id
    return rows


@pytest.mark.parametrize(("seed", "tight", "block"), [(1, False, negatives.BLOCK), (2, True, negatives.BLOCK), (3, True, 60)])
def test_hard_negatives_against_brute_force(spark, seed, tight, block):
    rows = random_vectors(seed, tight=tight)
    got = negatives.hard_negatives(vectors(spark, rows).repartition(5), block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows)


def test_hard_negatives_odd_rows(spark):
    good = [(i, [1.0, 0.1 * (i % 7), -0.2], i % 3) for i in range(0, 330, 3)]
    odd = [
        (None, [1.0, 0.0, 0.0], 1), (100, None, 1), (200, [1.0, 0.0, 0.0], None), (201, [1.0, None, 0.0], 1), (202, [math.nan, 0.0, 0.0], 1), (204, [math.inf, 0.0, 0.0], 1),
        (205, [], 1), (206, [1.0], 2), (206, [1.0], 2), (300, [0.5, 0.5, 0.5], 1), (208, [0.9, 0.9, 0.9, 0.9], 2), (400, [0.0, 0.0, 0.0], 1), (500, [-1.0, 0.0, 0.0], 9),
    ]
    pad = lambda e: e if e is None or len(e) >= 4 or any(x is None for x in e) else [*e, *[0.0] * (4 - len(e))]
    rows = good + odd
    got = {tuple(r) for r in negatives.hard_negatives(vectors(spark, rows)).collect()}
    assert got == brute_negatives([(i, pad(e), c) for i, e, c in rows]) and got
    assert negatives.hard_negatives(vectors(spark, [])).count() == 0


def test_walks_end_early():
    """Tight clusters: members leave the list where the bound says so."""
    rnd = np.random.default_rng(5)
    centres = np.eye(8)
    x = np.floor(256 * (np.repeat(centres, 40, axis=0) + rnd.normal(size=(320, 8)) * 0.01)).astype(np.int64)
    block = negatives.Anchors(np.arange(32), np.zeros(32, np.int64), x[::10])
    rows = np.floor(256 * (np.repeat(centres, 2000, axis=0) + rnd.normal(size=(16000, 8)) * 0.01)).astype(np.int64)
    seen = 0
    for c, (members, *_) in enumerate(block.clusters):
        best = negatives.Best(len(members), 5)

        def visit(live, part, scores, best=best):
            nonlocal seen
            seen += scores.size
            i, j = np.indices(scores.shape)
            best.add(live[i.ravel()], scores.ravel(), part[j.ravel()])

        block.walk(c, rows, lambda best=best: best.least, visit)
        want = -np.sort(-negatives.products(block.vectors[members], rows), axis=1)[:, :5]
        assert (best.score.reshape(-1, 5) == want).all()
    assert seen < 32 * 16000 / 4


def test_products_are_exact():
    big = np.array([[2**40, -(2**40)], [3, 5]])
    assert negatives.products(big, big)[1, 1] == 34 and negatives.products(big, big)[0, 0] == negatives.MOST
    wide = np.array([[2**30 + 1, 7]])
    assert negatives.products(wide, wide)[0, 0] == (2**30 + 1) ** 2 + 49


# ---------------------------------------------------------------- alignment


def test_aligned_against_sets():
    rnd = random.Random(1)
    for _ in range(3000):
        n, k = rnd.randint(1, 60), rnd.choice([0.1, 0.5, 0.95, 1])
        a = sorted({x for x in range(1, n) if rnd.random() < k} | {n})
        b = sorted({x for x in (a if rnd.random() < 0.6 else range(1, n)) if rnd.random() < k} | {n})
        runs, others = (list(zip(*[iter(x)] * m, strict=True)) for x, m in zip(alignment.aligned(a, b), (3, 4), strict=True))
        ends = sorted([(i + d, j + d) for i, j, m in runs for d in range(m)] + [(i, j) for _, _, i, j in others])
        assert ends == [(a.index(c), b.index(c)) for c in sorted(set(a) & set(b))]


def test_runs_are_skipped_by_doubling():
    class Counted(list):
        looks = 0

        def __getitem__(self, at):
            Counted.looks += 1
            return super().__getitem__(at)

    n = 100_000
    a = Counted(range(1, n + 1))
    runs, others = alignment.aligned(a, [*range(1, n // 2), *range(n // 2 + 1, n + 1)])
    assert runs == [0, 0, n // 2 - 1, n // 2 + 1, n // 2, n // 2 - 1] and others == [n // 2 - 1, n // 2 - 1, n // 2, n // 2 - 1]
    assert Counted.looks < 200


TEXTS = [
    None, "", " ", "  ", "\n", "a", "Hello, world! It's 12,345.67 units.", "two  spaces   three\t\ttabs\r\n\r\nend ", " leading", "trailing ", "naïve café — “quoted”", "日本語の文章。テスト", "🙂🙃 emoji 👩‍👩‍👧",
    "<|endoftext|> is text, <s> and </s>, <unk> and <0x0A> too", "a▁b and ▁ alone", "a▁ b", "é é   nbsp em", "\x00\x01\x1c x", "ß" * 400, "word " * 3000, "x" * 5000, "Hello, world! It's 12,345.67 units.", "ﬁ ligature ①",
]


def brute_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known = alignment.byte_table(public_tokenizers.path("byte_bpe_50k.json"))
    found, counts = [], Counter()
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        left = [known[i] for i in x]
        right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or b"".join(left) != (" " + t).encode() or b"".join(right) != (" " + t).encode():
            found.append(None)
            continue
        p, q = np.cumsum([len(w) for w in left]).tolist(), np.cumsum([len(w) for w in right]).tolist()
        links = [(x[i], y[j]) for i, (s, e) in enumerate(zip([0, *p], p)) for j, (u, v) in enumerate(zip([0, *q], q)) if s < v and u < e]
        groups, i, j = [], 0, 0
        for c in sorted(set(p) & set(q)):
            m, n = p.index(c) + 1, q.index(c) + 1
            groups.append(",".join(map(str, x[i:m])) + "|" + ",".join(map(str, y[j:n])))
            i, j = m, n
        counts.update(set(links))
        found.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (*f[:3], len(f[3]), sum(counts[k] == best[k[0]] for k in f[3]), sum(counts[k] for k in f[3]), f[4]) if f else (0, 0, 0, 0, 0, 0, "") for f in found
    ]


def test_alignment_against_brute_force(spark):
    import public_tokenizers

    texts = [*TEXTS, *corpus(7, 40)[:30]]
    ids = [*range(len(texts) - 1), None]
    made = alignment.Alignments(table(spark, texts, ids).repartition(3), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((i, *r) for i, r in zip(ids, brute_alignment(texts), strict=True))
    assert made.documents().columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in made.documents().collect()) == want
    assert Counter(tuple(r) for r in made.documents(sent=0).collect()) == want  # counts by shuffle
    empty = alignment.Alignments(table(spark, []), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert empty.documents().count() == 0


def test_memos_and_whole_texts_agree(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(alignment, "MEMO", 3)
    texts = [t for t in TEXTS if t]
    cut = alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    whole = alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert cut.parted
    whole.parted = False
    assert [r for t in texts for r in cut.documents([t])] == whole.documents(texts)


def test_known_stretches_are_not_spelled_again(monkeypatch):
    import public_tokenizers

    spelled, join = [], alignment.Entries.join
    monkeypatch.setattr(alignment.Entries, "join", lambda self, ids: spelled.append(len(ids)) or join(self, ids))
    pair = alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    plain = ["Hello, world! It's 12,345.67 units.", "word " * 300 + "end", "naïve café"]
    first = pair.documents(plain)
    spelled.clear()
    assert pair.documents(plain) == first and pair.documents(plain[::-1]) == first[::-1] and not spelled
    odd = ["ﬁ ligature ①", "x" * 500 + " is too long to stay", None, "ﬁ Hello,"]  # one that a side changes is compared as a whole
    assert pair.documents(odd * 2) == [r for t in odd * 2 for r in pair.documents([t])] and spelled
    assert not [s for s in pair.new.numbers if len(s) > alignment.MEMO_CHARS]


# ---------------------------------------------------------------- odd sketches


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 2, 80), (2, 5, 80)])
def test_odd_sketches_against_brute_force(spark, seed, n, num):
    texts = corpus(seed, 200)
    ids = [i * 7 % 1009 for i in range(len(texts))]
    ids[12] = None
    join = minhash.OddSketchJoin(table(spark, texts, ids), n, num, 100)
    want = brute_components(ids, texts, n, num, 100)
    assert Counter(tuple(r) for r in join.documents().collect()) == Counter({(i, s, c, i == c): k for (i, s, c), k in want.items()})


def test_odd_sketches_of_a_near_threshold_group(spark):
    """Copies of one text that hardly link with one another: groups are joined again until all pairs are decided."""
    rnd = random.Random(4)
    body = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        copy = list(body)
        for _ in range(3):
            copy[rnd.randrange(60)] = f"x{rnd.randrange(40)}"
        texts.append(" ".join(copy))
    ids = list(range(150))
    want = brute_components(ids, texts, 2, 80, 100)
    assert 1 < len({c for *_, c in want}) < 150
    got = minhash.OddSketchJoin(table(spark, texts), 2, 80, 100).documents()
    assert Counter((r[0], r[1], r[2]) for r in got.collect()) == want


def test_odd_sketch_edges(spark):
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, None), (None, None), (None, "only here")]
    got = minhash.OddSketchJoin(table(spark, [t for _, t in rows], [i for i, _ in rows]), 2).documents().collect()
    assert Counter(map(tuple, got)) == Counter([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True), (None, 0, None, True), (None, 1, None, True)])
    assert minhash.OddSketchJoin(table(spark, []), 2).documents().count() == 0


def test_sketches_estimate_similarity(spark):
    """Near the threshold the estimate is close; no linked pair exceeds the bound, of small sets by necessity."""
    rnd = np.random.default_rng(1)
    off, rows = [], []
    for n, share in itertools.product((10, 200, 1000, 5000), (1.0, 0.9, 0.8, 0.7)):
        for _ in range(20):
            both = np.unique(rnd.integers(0, 2**64, 2 * n, dtype=np.uint64))
            differ = math.ceil(n * (1 - share) / (1 + share) - 1e-9) if share < 0.8 else math.floor(n * (1 - share) / (1 + share) + 1e-9)
            both = rnd.permutation(both)[: n + differ]
            x, y = np.sort(both[:n]), np.sort(both[differ:])
            truth = (n - differ) / (n + differ)
            count = int(np.bitwise_count((minhash.sample_sketch(x) ^ minhash.sample_sketch(y)).view(np.uint64)).sum())
            rows.append((n, truth, count))
            if 100 <= n <= minhash.SAMPLES:
                off.append(minhash.estimate(count, n, n) - truth)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.02
    judged = spark.createDataFrame(rows, "n INT, truth DOUBLE, count INT").withColumn("passed", F.col("count") <= minhash.most_bits(F.col("n"), F.col("n"), 80, 100))
    assert judged.where("truth >= 0.8 and not passed").count() == 0
    assert judged.where("truth < 0.75 and passed and n in (200, 1000)").count() == 0


def test_long_sets_in_blocks(monkeypatch):
    f = minhash.functions(20)
    s = shingle_set(" ".join(f"w{i}" for i in range(5000)), 2)
    whole = minhash.samples(s, *f)
    monkeypatch.setattr(minhash, "BLOCK", 777)
    assert (minhash.samples(s, *f) == whole).all()


def test_nodes_that_share_half_a_hash(spark):
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 1), (5, None, None)], "doc_id LONG, low LONG, high LONG")
    node = {r.doc_id: r.node for r in minhash.numbered(rows).collect()}
    assert node[1] == node[3] != node[2] and node[4] == 8 and node[5] is None
