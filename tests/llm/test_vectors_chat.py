"""Nearest neighbours and quotation links."""

import numpy as np

from lodestone.llm import ann, chat


def plain_search(rows, every, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        out[int(ids[i])] = sorted(((float(v), int(j)) for v, j in zip(s, ids) if j != ids[i]), key=lambda p: (-p[0], p[1]))[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, score double, rank int")


def test_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x.tolist()))
    got = ann.search(table(spark, rows), every=40, group_rows=700, query_rows=40, list_rows=64).collect()
    want = plain_search([(i, np.float32(v)) for i, v in rows], 40, 20)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert found.keys() == want.keys()
    assert np.mean([len({j for _, j in found[q]} & {j for _, j in want[q]}) / 20 for q in want]) >= 0.9
    for q, f in found.items():
        assert len(f) == 20 and f == sorted(f, key=lambda p: (-p[0], p[1])) and all(j != q for _, j in f)
        true = dict((j, s) for s, j in [(float(np.float64(np.float32(x[j])) @ np.float64(np.float32(x[q]))), j) for _, j in f])
        assert all(abs(true[j] - s) < 1e-12 for s, j in f)


def test_copies_ties_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=8)
    rows = [(i, x.tolist()) for i in range(0, 300)] + [(400, [0.0] * 8), (500, None), (600, [None] + [1.0] * 7), (700, [float("nan")] + [1.0] * 7), (800, [1.0, 2.0]), (901, (2 * x).tolist()), (902, (-x).tolist()), (None, x.tolist())]
    got = {}
    for r in ann.search(table(spark, rows), every=20, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(got) == list(range(0, 300, 20))
    for q, f in got.items():
        assert [v for _, v in sorted(f)] == [901, *[i for i in range(300) if i != q][:19]]


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(6)
    long, short = rng.normal(size=(90, 8)).tolist(), rng.normal(size=(30, 3)).tolist()
    rows = list(enumerate(long)) + [(1000 + i, v) for i, v in enumerate(short)]
    got = {}
    for r in ann.search(table(spark, rows), every=20, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for part in (list(enumerate(long)), [(1000 + i, v) for i, v in enumerate(short)]):
        for q, want in plain_search([(i, np.float32(v)) for i, v in part], 20, 20).items():
            assert [v for _, v in sorted(got[q])] == [j for _, j in want]


def test_few_rows(spark):
    assert ann.search(table(spark, [(0, [1.0, 2.0])]).limit(0)).count() == 0
    assert ann.search(table(spark, [(0, [1.0, 2.0])])).count() == 0
    got = ann.search(table(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [5.0, 1.0])])).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 2), (0, 1)]


def test_repeated_query_row(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(100, 8)).tolist())]
    got = {}
    for r in ann.search(table(spark, rows + rows[:1] * 3 + rows[21:22] * 2), every=20, k=20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got) == list(range(0, 100, 20))
    assert all(len(f) == 20 and len(set(f)) == 20 for f in got.values())


TALK = [
    (1, 0, "user", "Hello there everyone.\n\nHow do we build the thing?"),
    (1, 1, "assistant", "You take the first box and open it.\nThen the second one follows."),
    (1, 2, "user", "On Monday someone wrote:\n> You take the first box\n> and open it.\nI did not find the box here."),
    (1, 3, "user", "> Hello there everyone.\nAn answer to the very first message."),
    (1, 4, "assistant", ">> You take the first box and open it.\n> I did not find the box here.\nLook on the shelf again please."),
    (1, 5, "user", "> Look on the  SHELF again please.\nThanks a lot, found it now."),
    (2, 0, "user", None), (2, 0, "user", None), (2, 1, None, "> Hello there everyone.\nother talk"), (None, None, "x", "> quoting nothing at all"), (None, 4, "y", "next"),
]


def talk(spark, rows=TALK):
    return spark.createDataFrame([(*r, "a", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, key int")


def test_links(spark):
    got = {(r.conv_id, r.turn): r for r in chat.link(talk(spark), keep_text=True).collect() if r.conv_id == 1}
    assert {t: r.parent_turn for (_, t), r in got.items()} == {0: None, 1: 0, 2: 1, 3: 0, 4: 2, 5: 4}
    assert [got[1, t].link for t in range(6)] == ["start", "order", "quote", "quote", "quote", "quote"]
    assert [got[1, t].depth for t in range(6)] == [0, 1, 2, 1, 3, 4]
    assert got[1, 2].own_text == "I did not find the box here." and got[1, 4].own_text == "Look on the shelf again please."
    order = sorted(got.values(), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(6))
    seen = set()
    for r in order:
        assert r.parent_turn is None or r.parent_turn in seen
        seen.add(r.turn)


def test_hard_rows(spark):
    got = chat.link(talk(spark)).collect()
    assert len(got) == len(TALK)
    two = sorted((r for r in got if r.conv_id == 2), key=lambda r: r.position)
    assert [r.position for r in two] == [0, 1, 2] and two[2].link == "order" and two[2].parent_turn == 0
    none = {r.turn: r for r in got if r.conv_id is None}
    assert none[None].link == "start" and none[4].parent_turn is None and none[4].link == "order" and none[4].depth == 1
    assert chat.link(talk(spark).limit(0)).count() == 0


def test_long_thread(spark):
    rows = [(1, i, "user", f"message number {i} of a long thread" + (f"\n> message number {i - 1} of a long thread" if i else "")) for i in range(70)]
    got = {r.turn: r for r in chat.link(talk(spark, rows)).collect()}
    assert all(got[i].depth == i and got[i].position == i and got[i].link == ("quote" if i else "start") for i in range(70))


def test_short_quotes(spark):
    rows = [
        (1, 0, "user", "Agreed"), (1, 1, "assistant", "A longer message in between."), (1, 2, "user", "> agreed\nSo be it."),
        (2, 0, "user", "\u6211\u4eec\u660e\u5929\u89c1\u9762\u3002"), (2, 1, "user", "Thanks"), (2, 2, "user", "> \u6211\u4eec\u660e\u5929\u89c1\u9762\u3002\nok"), (2, 3, "user", "> Thanks\n> A passage nobody wrote."),
        (3, 0, "user", "Yes\nThis is the longer passage."), (3, 1, "user", "Yes"), (3, 2, "user", "> Yes\n> This is the longer passage."), (3, 3, "user", ">\n> \nnothing quoted"),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.link(talk(spark, rows)).collect()}
    assert {k: got[k].parent_turn for k in [(1, 2), (2, 2), (2, 3), (3, 2), (3, 3)]} == {(1, 2): 0, (2, 2): 0, (2, 3): 1, (3, 2): 0, (3, 3): 2}
    assert [got[k].link for k in [(1, 2), (2, 2), (2, 3), (3, 2), (3, 3)]] == ["quote"] * 4 + ["order"]
    assert got[1, 2].n_quotes == 1 and got[2, 2].n_quotes == 1 and got[3, 3].n_quotes == 0


def test_levels():
    assert chat.levels("a\n> b\n> > c\n>>d\n  > e") == [(0, "a"), (1, "b"), (2, "c"), (2, "d"), (1, "e")]


def plain_links(rows):
    """(conv, turn) to parent, depth and link of every message, by plain loops over each conversation."""
    talks = {}
    for conv, turn, _, text in rows:
        talks.setdefault(conv, {}).setdefault(turn, []).append(chat.parse(text)[1])
    out = {}
    for conv, turns in talks.items():
        order = sorted(turns)
        wrote = {t: {h for found in turns[t] for level, h, _ in found if level == 0} for t in order}
        for k, t in enumerate(order):
            options = []
            for level, h, n in (p for found in turns[t] for p in found if p[0] > 0):
                origin = max((e for e in order[:k] if h in wrote[e]), default=None)
                if origin is not None:
                    options.append((-level, n, origin))
            parent = max(options)[2] if options else order[k - 1] if k else None
            depth = out[conv, parent][1] + 1 if parent is not None else 0
            out[conv, t] = (parent, depth, "quote" if options else "order" if k else "start")
    return out


def random_talks():
    """Conversations whose messages quote earlier ones, whole or in part, at several levels, some lines being common."""
    rng, rows = np.random.default_rng(8), []
    for conv in range(12):
        said = []
        for turn in range(int(rng.integers(3, 14))):
            own = [" ".join(f"w{rng.integers(30)}" for _ in range(rng.integers(1, 6))) for _ in range(rng.integers(1, 4))]
            lines = ["Agreed"] if rng.random() < 0.3 else []
            for _ in range(int(rng.integers(0, 3)) if said else 0):
                quoted = said[rng.integers(len(said))].split("\n")
                a = rng.integers(len(quoted))
                lines += ["> " * int(rng.integers(1, 3)) + x.upper() for x in quoted[a : a + 1 + rng.integers(3)]] + ([""] if rng.random() < 0.5 else [])
            said.append("\n".join(lines + own))
            rows.append((conv, turn, "user", said[-1]))
            if rng.random() < 0.1:
                rows.append((conv, turn, "user", "> agreed\nagain"))
    return rows


def test_links_against_plain_loops(spark):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for rows, stretch in ((random_talks(), 4096), (random_talks(), 2), (given, 4096)):
        got = chat.link(talk(spark, rows), stretch=stretch).collect()
        want = plain_links(rows)
        assert len(got) == len(rows)
        assert {((r.conv_id, r.turn), (r.parent_turn, r.depth, r.link)) for r in got} == set(want.items())
        quotes = sum(w[2] == "quote" for w in want.values())
        assert rows is given or quotes > 30


def test_very_long_message_and_one_hot_line(spark):
    long = "\n".join(f"line {i} of it" for i in range(20_000))
    rows = [(1, 0, "u", long), (1, 1, "u", "> line 19999 of it\nyes")] + [(2, t, "u", "Thanks" if t % 2 == 0 else "> thanks\nok") for t in range(400)]
    got = {(r.conv_id, r.turn): r for r in chat.link(talk(spark, rows)).collect()}
    assert got[1, 1].parent_turn == 0 and got[1, 1].link == "quote"
    assert all(got[2, t].parent_turn == t - 1 for t in range(1, 400, 2)) and len(got) == 402
