"""Exact top-k search, the prefix trie and importance resampling against plain loops, on hard rows too."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from lodestone.llm import exacttopk, importance, prefixtrie

EXTRA = ", score double, rank int, words int, a long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1.0, 2, 3, 4) for i, v in rows], f"vec_id long, embedding array<double>{EXTRA}")


def plain_top(rows, every, k):
    """Best rows of each query row, by exact whole numbers."""
    seen, out = set(), []
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            x = tuple(math.floor(256 * c) for c in v)
            if sum(c * c for c in x) < 2**63:
                seen.add((i, x))
    for i, x in seen:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in seen if j != i and len(y) == len(x))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_topk_of_random_vectors(spark):
    rng = np.random.default_rng(3)
    rows = list(enumerate(rng.normal(size=(400, 7)).tolist()))
    want = plain_top(rows, 20, 5)
    for lists in (1, 2, 3):
        assert found(exacttopk.search(vectors(spark, rows), every=20, lists=lists, depth=8)) == want
    assert found(exacttopk.search(vectors(spark, rows), every=20, query_rows=6)) == want


def test_topk_of_hard_rows(spark):
    copies = [(i, [1.5, -2.0, 0.25]) for i in range(60)]
    odd = [(100, [0.0, 0.0, 0.0]), (150, None), (200, [None, 1.0, 1.0]), (250, [float("nan"), 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0]), (350, [1.0, 2.0]), (351, [-1.0, 2.0]), (400, []), (401, []), (450, [2.0]), (500, [1e300, 0.0, 0.0]), (None, [9.0, 9.0, 9.0])]
    large = [(550, [1e6, 1e6, -1e6]), (551, [1e6, 1e6, 1e6]), (552, [-(2.0**22), 2.0**22, 2.0**22])]
    twice = [(50, [1.5, -2.0, 0.25]), (50, [0.5, 0.5, 0.5]), (7, [1.0, 1.0, 1.0])]
    rows = copies + odd + large + twice
    assert found(exacttopk.search(vectors(spark, rows), every=50, depth=5)) == plain_top(rows, 50, 5)
    assert exacttopk.search(vectors(spark, rows).limit(0)).count() == 0
    few = [(0, [1.0, 1.0]), (1, [2.0, 0.0])]
    assert found(exacttopk.search(vectors(spark, few))) == plain_top(few, 50, 5)
    assert found(exacttopk.search(vectors(spark, [(0, [1.0])]))) == [] and found(exacttopk.search(vectors(spark, [(1, [1.0])]))) == []


def plain_trie(rows, span=20, heads=4):
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            content = f"{len(role)}:{role}{text}"
            said.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(content.encode()).hexdigest()[:32], (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in said.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = own.get(c - int(math.fmod(c, span)), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        todo, all_of = [node], []
        while todo:
            n = todo.pop()
            all_of.append(n)
            todo += children.get(n, [])
        return all_of

    out = []
    for node, convs in members.items():
        tree = below(node)
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in tree if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])), sum(n not in children for n in tree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2, 3, 4) for r in rows], f"conv_id long, turn long, role string, text string{EXTRA}")


def nodes(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_trie(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(c), t, ["user", "assistant"][t % 2], ["hi", "a b  c", "x\ty\nz", ""][int(rng.integers(4))]) for c in range(0, 130) if c % 40 != 20 for t in range(int(rng.integers(1, 9)))]
    rows += [(None, 1, "user", "x"), (500, None, None, None), (500, 2, None, "a"), (500, 2, None, "a"), (500, 2, "b", "a"), (-7, 1, "user", "hi"), (-20, 0, "user", "hi"), (900, 1, "user", "w " * 4000)]
    want = plain_trie(rows)
    assert nodes(prefixtrie.trie(talks(spark, rows))) == want
    monkeypatch.setattr(prefixtrie, "MANY", 2)
    monkeypatch.setattr(prefixtrie, "STRETCH", 2)
    monkeypatch.setattr(prefixtrie, "ENDS", 3)
    assert nodes(prefixtrie.trie(talks(spark, rows))) == want
    assert nodes(prefixtrie.trie(talks(spark, rows[:1]).limit(0))) == []


def test_trie_of_a_deep_conversation(spark):
    rows = [(c, t, "user", f"{t} word") for c in (0, 1, 2) for t in range(70)] + [(3, 0, "user", "")]
    assert nodes(prefixtrie.trie(talks(spark, rows))) == plain_trie(rows)


def plain_draw(docs, target, buckets=10_000, least=20, percent=25, seed=7):
    def parts(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets, dtype=int), np.zeros(buckets, dtype=int)
    for _, text in docs:
        for f in parts(text)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in parts(text)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (float(s.sum()) + buckets) / ((int(s[b]) + 1) * (float(t.sum()) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, fs = parts(text)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2, 3, 4) for r in rows], f"doc_id long, text string{EXTRA}")


def drawn(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_draw(spark):
    rng = np.random.default_rng(5)
    words = ["The", "cat", "naïve", "über", "7up", "x" * 200, "日本語", "a", "Zq"]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "a,b;c d-e" * 30), (1003, "word " * 60000), (1004, "é" * 5000 + " x" * 30), (None, "the cat " * 20), (-5, "the cat " * 20)]
    target = ["The cat sat", "naïve über cat", None, ""]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    want = plain_draw(docs, target)
    assert drawn(importance.resample(documents(spark, docs), t)) == want
    assert drawn(importance.resample(documents(spark, docs).repartition(7), t, range_rows=5)) == want
    assert drawn(importance.resample(documents(spark, docs).limit(0), t)) == []
    assert drawn(importance.resample(documents(spark, docs[:30]), t.limit(0))) == plain_draw(docs[:30], [])


def test_draw_of_repeated_ids(spark):
    """A third of the rows have one id and one score: every rank is given once, and equal rows follow each other."""
    docs = [(7, "the cat " * 15)] * 200 + [(i, "the cat " * 15 + str(i)) for i in range(400)]
    t = spark.createDataFrame([("the cat",)], "text string")
    for rows in (8, 1 << 18):
        got = importance.resample(documents(spark, docs).repartition(5), t, importance.Draw(percent=60), range_rows=rows).collect()
        ranked = sorted((r["rank"], -r.score, r.doc_id) for r in got if r["rank"] is not None)
        assert [r[0] for r in ranked] == list(range(1, 361)) and [r[1:] for r in ranked] == sorted(r[1:] for r in ranked)
        assert len(got) == 600 and max(r.score for r in got if r["rank"] is None) <= -ranked[-1][1]


def test_crc_of_features():
    texts = ["Foo bar" + "y" * 90, None, "", " a-b ", "ü 1" + "z" * 64 + "Q"]
    n, text, bucket = importance.features(pa.array(["skipped", *texts]).slice(1), 10_000)
    assert n.tolist() == [2, 0, 0, 2, 2] and np.bincount(text, minlength=5).tolist() == [3, 0, 0, 3, 3]
    want = ["foo", "bar" + "y" * 90, "a", "b", "ü", "1" + "z" * 64 + "q"]
    want += [f"{want[0]} {want[1]}", "a b", f"ü {want[5]}"]
    assert bucket.tolist() == [zlib.crc32(w.encode()) % 10_000 for w in want]


def test_tournament():
    rng = np.random.default_rng(6)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted((int(v), i) for v in rng.integers(0, 50, int(rng.integers(1, 30)))) for i in range(k)]
        rest = [iter(r) for r in runs]
        tree, out = importance.Tournament([next(r) for r in rest]), []
        while tree.heads[tree.winner] != importance.END:
            out.append(tree.heads[tree.winner])
            tree.replace(next(rest[tree.winner], importance.END))
        assert out == sorted(x for r in runs for x in r)
