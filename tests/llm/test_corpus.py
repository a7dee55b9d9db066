"""Operators that compare texts with one another, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import fingerprints, jaccard, lines, mixing, repeats
from trailmark.llm.common import stored

SCHEMA = "doc_id LONG, text STRING, source STRING, node STRING, bucket STRING, hash STRING"  # names that the operators use themselves


def table(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, s, "n", "b", "h") for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


def corpus(seed, n=120, vocabulary=3000):
    """Originals, exact copies, near copies at all distances, a shared passage, odd texts."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(vocabulary)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", " \t\n", "one", "one two", "ONE two", "a b c d", "a b c d", "z " * 3000]
    while len(texts) < n:
        body = [word() for _ in range(rnd.randrange(3, 250))]
        if rnd.random() < 0.3:
            body[len(body) // 2 : len(body) // 2] = passage
        texts.append(" ".join(body))
        for _ in range(rnd.choice([0, 0, 1, 3, 8])):
            copy = list(body)
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 9])):
                copy[rnd.randrange(len(copy))] = word()
            cut = rnd.choice([0, 0, 1, 5])
            texts.append(rnd.choice([" ", "\n"]).join(copy[cut:]))
    return texts


# ---------------------------------------------------------------- Jaccard join


def brute_components(ids, texts, n, num, den):
    sets = []
    for t in texts:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = i if least[r] is None else least[r] if i is None else min(i, least[r])
    return Counter((i, len(s), least[find(k)]) for k, (i, s) in enumerate(zip(ids, sets, strict=True)))


@pytest.mark.parametrize(("seed", "n", "num", "den"), [(1, 4, 85, 100), (2, 5, 80, 100)])
def test_jaccard_against_brute_force(spark, seed, n, num, den):
    texts = corpus(seed, 200)
    ids = [i * 7 % 1009 for i in range(len(texts))]
    ids[12] = None
    join = jaccard.JaccardJoin(table(spark, texts, ids), n, num, den)
    assert Counter(tuple(r) for r in join.documents().collect()) == brute_components(ids, texts, n, num, den)


def test_chains_link_through_the_middle(spark):
    """Neighbours link, ends don't: components need more than each region's first pivot."""
    rnd = random.Random(5)
    body = [f"v{i}" for i in range(200)]
    texts = []
    for _ in range(25):
        texts.append(" ".join(body))
        for _ in range(2):
            body[rnd.randrange(200)] = f"v{rnd.randrange(10**6)}"
    texts += [" ".join(body[:150] + [f"u{k}_{i}" for i in range(50)]) for k in range(12)]  # alike but not linked
    join = jaccard.JaccardJoin(table(spark, texts), 4, 85, 100)
    assert Counter(tuple(r) for r in join.documents().collect()) == brute_components(range(len(texts)), texts, 4, 85, 100)


def test_parts_always_meet():
    """The pigeonhole: any two sets at the threshold share a part's content."""
    rng = np.random.default_rng(6)
    for size in (7, 8, 13, 40, 97, 333, 1000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            for drop in range(0, size // 5 + 1, max(1, size // 40)):
                y = np.unique(np.concatenate((x[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64))))
                shared = len(np.intersect1d(x, y))
                if 100 * shared >= 85 * (len(x) + len(y) - shared) and shared < max(len(x), len(y)):
                    assert np.intersect1d(jaccard.part_contents(x, 85, 100), jaccard.part_contents(y, 85, 100)).size


def test_one_of_each_group_stays(spark):
    texts = corpus(7, 120)
    docs = table(spark, texts)
    repeated = docs.unionByName(docs.where("doc_id in (20, 30)"))
    got = jaccard.near_copies_removed(spark, repeated, "")
    assert got.columns == docs.columns
    want = brute_components(range(len(texts)), texts, 5, 80, 100)
    keep = sorted(i for i, n, c in want if i == c)
    assert sorted(r.doc_id for r in got.collect()) == keep


# ---------------------------------------------------------------- repeats


def brute_repeats(ids, texts, size=13):
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    key = lambda i: 1 << 62 if i is None else i
    for i, w in zip(ids, rows, strict=True):
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, 1 << 63), key(i))
    out = Counter()
    for i, w in zip(ids, rows, strict=True):
        gone = {p for s in range(len(w) - size + 1) if first[tuple(w[s : s + size])] < key(i) for p in range(s, s + size)}
        out[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    return out


@pytest.mark.parametrize("seed", [11, 12])
def test_repeats_against_brute_force(spark, seed):
    texts = corpus(seed, 150, 40) + ["z " * 40, "y " + "z " * 20]  # a small vocabulary makes many short repeats
    ids = [i * 5 % 1013 for i in range(len(texts))]
    ids[15] = ids[16] = None
    ids[20] = ids[21]
    got = Counter(tuple(r) for r in repeats.repeats_removed(table(spark, texts, ids)).collect())
    assert got == brute_repeats(ids, texts)


# ---------------------------------------------------------------- mixing


def brute_mix(rows, weights=(5, 2, 1), most=3):
    """rows: (doc_id, source, text)."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = Counter()
    for _, s, t in rows:
        size[s] += count(t)
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, left, target = set(order), float(sum(size.values())), {}
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * size[s]}
        if not over:
            return size, target | share
        for s in over:
            target[s] = float(most * size[s])
            left -= target[s]
            free.discard(s)


def test_mix(spark):
    rnd = random.Random(21)
    sources = ["b", "a", None, "ä", "Z", "empty"]
    weights = [40, 3, 10, 1, 30, 1]
    rows = []
    for i in range(900):
        s = rnd.choices(sources, weights)[0]
        rows.append((i if i % 50 else None, s, None if s == "empty" else " ".join(["x"] * rnd.randrange(0, 30)) + f" d{i}"))
    docs = table(spark, [t for *_, t in rows], [i for i, *_ in rows], [s for _, s, _ in rows])
    got = mixing.mix(docs).collect()
    size, target = brute_mix(rows)
    taken, by_size = Counter(), {}
    source_of = defaultdict(list)
    for i, s, t in rows:
        source_of[i].append(s)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        if r.doc_id is not None:
            (s,) = source_of[r.doc_id]
            taken[s] += r.taken
            by_size[s] = (r.source_size, r.target)
    for s, (n, goal) in by_size.items():
        assert n == size[s] and goal == pytest.approx(target[s])
    plan = {(r.source, r.full, r["last"], r.also) for r in mixing.thresholds(docs.select("source", mixing.size_of().alias("size"), mixing.hash_of().alias("hash")), stored(mixing.targets(docs.select("source", mixing.size_of().alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))))).collect()}
    assert len(plan) == len({s for _, s, _ in rows})
    assert sorted((r.doc_id or -1, r.taken) for r in mixing.mix(docs.repartition(9)).collect()) == sorted((r.doc_id or -1, r.taken) for r in got)
    total = Counter()
    for r in mixing.mixed_documents(docs).collect():
        total[r.source] += len((r.text or "").split())
    for s in target:
        assert abs(total[s] - target[s]) <= 31
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mix_of_one_source_takes_all(spark):
    docs = table(spark, ["a b", "c", None])
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(docs).collect()) == [(0, 2, 3.0, 2), (1, 1, 3.0, 1), (2, 0, 3.0, 0)]


# ---------------------------------------------------------------- fingerprints


def test_canonical_forms(spark):
    same = ["Straße  Éa", "  STRASSE\nÉA", "strasse Éa", "Ｓtrasse éa "]
    other = ["strasse ea", "strasseéa", None, "", "  "]
    rows = table(spark, same + other)
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprinted(rows).collect()}
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(4, 9)}) == 3 and got[6] == got[7] == got[8]
    groups = {r.doc_id: r.group_id for r in fingerprints.exact_groups(rows).collect()}
    assert groups == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 6, 7: 6, 8: 6}


def test_collisions_get_their_own_names(spark, monkeypatch):
    """With a useless hash every text shares one bucket; the byte comparison alone must tell them apart."""
    monkeypatch.setattr(fingerprints, "_hashes", lambda form, prefix="__h": {f"{prefix}1": F.lit(1).cast("long"), f"{prefix}2": F.lit(2).cast("long")})
    got = [r.fingerprint for r in fingerprints.fingerprinted(table(spark, ["b", "a", "A ", "c"])).orderBy("doc_id").collect()]
    assert got[1] == got[2] and len(set(got)) == 3
    likeness = {r.doc_id: r.near_next for r in fingerprints.edit_likeness(table(spark, ["b", "a", "A ", "c"])).collect()}
    assert likeness == {3: 0.0, 2: 1.0, 1: 0.0, 0: 0.0}


def test_next_documents_and_edits(spark):
    rnd = random.Random(31)
    texts = ["".join(rnd.choice("ab é日\n") for _ in range(rnd.randrange(0, 40))) for _ in range(60)] + [None, "x", "x"]
    ids = [rnd.randrange(10**rnd.choice([2, 9])) * 3 + k % 3 for k, _ in enumerate(texts)]
    ids[5] = None
    assert len(set(ids)) == len(ids)
    docs = table(spark, texts, ids)
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, -(ids[k] or 0)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for stretch in (1, 7, 2000):
        got = {r.doc_id: r["__next"] for r in fingerprints.with_next(rows, stretch).collect()}
        for at, k in enumerate(order):
            assert got[ids[k]] == (texts[order[(at + 1) % len(order)]] or "")
    out = {r.doc_id: r for r in fingerprints.edit_likeness(docs).collect()}
    for at, k in enumerate(order):
        t, nxt = texts[k] or "", texts[order[(at + 1) % len(order)]] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        r = out[ids[k]]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.near_edited == float(r.fingerprint == r.edited_fingerprint)


def test_next_document_at_any_ids(spark):
    """Ids at the ends of 64 bits, in one crowd beside a far one, and hash-like."""
    rnd = random.Random(33)
    for ids in ([-(1 << 63), 5, (1 << 63) - 1], [*range(300), 10**15], [rnd.getrandbits(64) - (1 << 63) for _ in range(300)]):
        docs = table(spark, [f"text {i}" for i in ids], ids)
        for stretch in (1, 40):
            got = {r.doc_id: r["__next"] for r in fingerprints.with_next(docs.select("doc_id", "text"), stretch).collect()}
            down = sorted(ids, reverse=True)
            assert got == {i: f"text {n}" for i, n in zip(down, [*down[1:], down[0]], strict=True)}
        assert fingerprints.edit_likeness(docs).count() == len(ids)


def test_stretches_are_even_at_any_ids(spark):
    keys = [f"{k:08d}" for k in range(1000)]
    firsts = keys[::7]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").withColumn("s", fingerprints._stretch_of("k", firsts)).collect()
    assert all(r.s == int(r.k) // 7 for r in rows)


def test_single_and_no_document(spark):
    (r,) = fingerprints.edit_likeness(table(spark, ["abcdef"])).collect()
    assert (r.near_next, r.n_chars) == (1.0, 6) and r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.edit_likeness(table(spark, ["x"]).limit(0)).count() == 0
    assert fingerprints.edit_likeness(table(spark, ["same", "same"], [4, 4])).count() == 2


def test_clashing_names(spark):
    docs = table(spark, ["a b c d e f", "x y z w v u"]).withColumns({"fingerprint": F.lit(1), "score": F.lit(2), "size": F.lit(3), "template": F.lit(4), "target": F.lit(5), "n_chars": F.lit(0)})
    assert fingerprints.fingerprinted(docs).where("fingerprint = '1'").count() == 0
    from trailmark.llm import toxicity

    machine = toxicity.fit([], np.zeros(0))
    stages = [toxicity.scored(docs, machine, tuple(docs.columns), "__score"), lines.lines_removed(spark, docs, ""), jaccard.near_copies_removed(spark, docs, ""), mixing.mixed_documents(docs)]
    for df in stages:
        assert df.select(*docs.columns).where("score = 2 and size = 3 and template = 4 and target = 5").count() == 2


def test_empty_tables(spark):
    none = table(spark, ["x"]).limit(0)
    assert jaccard.JaccardJoin(none, 4, 85, 100).documents().count() == repeats.repeats_removed(none).count() == jaccard.near_copies_removed(spark, none, "").count() == 0
    assert fingerprints.exact_groups(none).count() == 0


# ---------------------------------------------------------------- lines


def brute_templates(line):
    """A line's templates, by the rule and without hashes or a tree: its own, and those with one or two steps as fields."""
    tokens = re.findall(r"[^\x20\x09-\x0D]+", line)
    general = ["<*>" if re.search("[0-9@]", t) else t for t in tokens]
    if len(tokens) < 4 and set(general) == {"<*>"}:
        general = tokens
    n = len(general)
    found = {tuple(general)} if n else set()
    k = min(n, 6)
    steps = [tuple(general[i * n // k : (i + 1) * n // k]) for i in range(k)]
    steps = ["*" if set(x) == {"<*>"} else x for x in steps]
    fixed = [i for i in range(k) if steps[i] != "*"]
    for size in (0, 1, 2):
        for fields in combinations(fixed, size):
            if n > 3 and len(fixed) - size >= 3:
                found.add((n, *("*" if i in fields else x for i, x in enumerate(steps))))
    return found


def brute_lines(texts, family, least):
    """(kept text, lines, dropped) of every text; ``family``: what each counts as."""
    holders = defaultdict(set)
    for t, f in zip(texts, family, strict=True):
        for line in (t or "").split("\n"):
            for k in brute_templates(line):
                holders[k].add(f)
    out = []
    for t in texts:
        rows = [] if t is None else t.split("\n")
        kept = [x for x in rows if not any(len(holders[k]) >= least for k in brute_templates(x))]
        out.append((None if t is None else "\n".join(kept), len(rows), len(rows) - len(kept)))
    return out


def got_lines(df):
    return [(r.text, r["__lines"], r["__dropped"]) for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("least", [3, 10])
def test_lines_against_brute_force(spark, least):
    rnd = random.Random(47)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=6))
    pool = ["user {} logged in today", "Share this page with {} and {} at once", "All rights reserved.", "Of.", "{}", "run {} at 10:{}", "7", "x@{} y@{}", "Page 3", "one two {} four five six seven eight", "by {} in {} then", "a {} b c", "p q {} 5 r s {} t u v", "p q 6 7 r s {} t u v", " \t", "", "{} two three four five six"]
    texts, family = [None, "", "\n\n", "é\r\n"], [0, 1, 2, 3]
    for i in range(80):
        rows = [word() + " " + word() for _ in range(30)]
        for line in rnd.sample(pool, 4):
            rows.insert(rnd.randrange(len(rows)), line.format(word(), word()))
        copies = rnd.choice([1, 1, 1, 2])
        texts += ["\n".join(rows)] * copies
        family += [4 + i] * copies
    assert got_lines(lines.without_recurring(table(spark, texts), min_documents=least)) == brute_lines(texts, family, least)


def test_recurring_templates_go(spark):
    rnd = random.Random(41)
    texts, kept = [], []
    for i in range(15):
        a, b = own_lines(rnd, 6), own_lines(rnd, 6)
        texts.append("\n".join([*a, f"Build {i} finished at 10:{i:02d} today", "All of it", f"user {a[0].split()[0]} logged in today", *b]))
        kept.append("\n".join([*a, *b]))
    story = "\n".join(own_lines(rnd, 8))
    texts += [story] * 30 + [story.replace("\n", "\nx ", 1), None, "", "Build 9 finished at 11:00 today"]
    kept += texts[15:48] + [""]
    assert [t for t, *_ in got_lines(lines.without_recurring(table(spark, texts)))] == kept  # copies are one document
    assert lines.without_recurring(table(spark, texts).limit(0)).count() == 0


def test_templates():
    t = lambda line: lines.parsed(line)[0]
    assert t(b" \t") is None and t(b"run 1 of many jobs") == t(b"run  22 of many\tjobs") != t(b"run 1 of many tasks")
    assert t(b"x y z 1 mail a@b.c") == t(b"x y z 77 mail q@r.s") and t(b"one two three four") != t(b"one two three four five")
    assert t(b"7") != t(b"8") and t(b"Page 7") == t(b"Page 8")


@pytest.mark.parametrize("line, goes", [
    ("user {} logged in", True), ("logged in today as {}", True), ("welcome to the shop {}", True), ("Posted by {} in {}", True),
    ("the order of {} was sent to {} by our shop", True), ("{} and {} went {} together home", False), ("Contact {}", False),
])
def test_named_fields(spark, line, goes):
    """Fields that vary by name alone: up to two of a line, where three steps stay fixed; a line of two tokens is its own template."""
    rnd = random.Random(53)
    texts = []
    for _ in range(12):
        own = own_lines(rnd, 6)
        texts.append("\n".join([*own, line.format(*(x.split()[0] for x in own[:3]))]))
    assert [d for *_, d in got_lines(lines.without_recurring(table(spark, texts)))] == [int(goes)] * 12
    few = texts[:9] + texts[:1] * 5  # nine documents, one of them copied
    assert [d for *_, d in got_lines(lines.without_recurring(table(spark, few)))] == [0] * 14


def test_a_long_text_of_many_lines(spark):
    """Whole texts: the last lines of a text of 100,000 lines go like others."""
    rnd = random.Random(49)
    texts = ["\n".join([*own_lines(rnd, 5), "This footer stands everywhere"]) for _ in range(12)]
    long = "\n".join([f"line{rnd.random()}x a{i} b{i}c d" for i in range(100_000)] + ["This footer stands everywhere"])
    got = got_lines(lines.without_recurring(table(spark, [*texts, long])))
    assert [d for *_, d in got] == [1] * 13  # its numbered lines share one template, but one document holds it


def own_lines(rnd, n=5):
    return [" ".join(rnd.choice("abcdefghijklmnopqrst") + str.join("", rnd.choices("aeioukst", k=6)) for _ in range(7)) for _ in range(n)]


def test_short_lines_go_in_the_pipeline(spark):
    rnd = random.Random(43)
    texts = []
    for i in range(15):
        a, b, c, d = own_lines(rnd, 4)
        texts.append("\n".join([a, "All rights reserved.", b, f"Page {i}", c, f"{i}", d]))
    rows = {r.doc_id: r.text for r in lines.lines_removed(spark, table(spark, texts), "").collect()}
    for i, t in enumerate(texts):  # a short line of nothing but a number stands for itself alone
        assert rows[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in (1, 3))


def test_lines_with_fixed_neighbours_go_in_the_pipeline(spark):
    rnd = random.Random(44)
    notice = ["This notice covers the whole work below", "no part of it may be copied", "or sold without leave of the holders", "whose names stand at the end"]
    kept, texts = [], []
    for _ in range(60):  # inner lines of a notice have one context
        own = own_lines(rnd, 8)
        kept.append("\n".join(own))
        texts.append("\n".join(own[:4] + notice + own[4:]))
    for _ in range(30):  # a line between blank ones
        a, b, c, d = own_lines(rnd, 4)
        kept.append("\n\n".join([a, b]) + "\n\n\n" + "\n\n".join([c, d]))
        texts.append("\n\n".join([a, b, "Subscribe to our weekly letter today", c, d]))
    for i in range(120):  # a line between others that take few forms: 9 contexts
        own = own_lines(rnd, 6)
        kept.append("\n".join(own))
        texts.append("\n".join([*own, f"the {'abc'[i % 3]} header of every page", "Share this page with your friends", f"the {'xyz'[i // 3 % 3]} footer of every page"]))
    story = own_lines(rnd, 20)
    for i in range(200):  # copies of one document, each with one line of its own
        texts.append("\n".join([*story[: i % 20], own_lines(rnd, 1)[0], *story[i % 20 + 1 :]]))
        kept.append(texts[-1])
    got = {r.doc_id: r.text for r in lines.lines_removed(spark, table(spark, texts), "").collect()}
    assert [got[i] for i in range(len(texts))] == kept


@pytest.mark.parametrize("copies", [200])
def test_jaccard_compares_few_pairs_near_the_threshold(spark, monkeypatch, copies):
    """Copies of one text with three words changed in each: few pairs link, and sketches leave few others to be compared."""
    rnd = random.Random(5)
    body = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(copies):
        copy = list(body)
        for at in rnd.sample(range(200), 3):
            copy[at] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    compared = []
    plain = jaccard.JaccardJoin._distances
    monkeypatch.setattr(jaccard.JaccardJoin, "_distances", lambda self, pairs: compared.append(pairs.count()) or plain(self, pairs))
    join = jaccard.JaccardJoin(table(spark, texts), 4, 85, 100)
    assert Counter(tuple(r) for r in join.documents().collect()) == brute_components(list(range(copies)), texts, 4, 85, 100)
    assert sum(compared) < copies * 20
