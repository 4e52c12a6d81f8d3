"""The corpus operators against plain versions of their contracts, on fixtures with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing column names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size long, kept boolean, _rid string, slot int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """(doc_id, text, source) with copies, near copies, shared passages, junk, long and empty texts."""
    rng = random.Random(7)
    passage = " ".join(words(rng, 120))
    base = [words(rng, rng.randrange(60, 300)) for _ in range(12)]
    texts = [" ".join(w) for w in base]
    texts += [texts[0], texts[0], texts[1].upper(), "\n".join(base[2])]
    for k in range(8):  # near copies in a chain
        w = list(base[3])
        for _ in range(1 + k):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += [f"{' '.join(words(rng, 40))} {passage} {' '.join(words(rng, 40))}" for _ in range(4)]
    texts += [passage + " " + passage, "same line here\n" * 40, "a b c", "a b c", "A B", "ü ß é", "", None, " \n\t ", "x" * 5000, "na " * 3000, " ".join(words(rng, 4000, 50_000))]
    texts += ["#%$&|<>* " * 60, "one\ntwo words\none\n\n\none", "mail a.b@c-d.org, ..x@y.z. ip 1.2.3.4 and 256.1.1.1 or 010.0.0.255 card 4111 1111-1111 1111 and 4111111111111112 tel +1 (555) 010-9999 +123 a@b..c a@b.c_d@e.f 1.2.3.4.5.6.7.8"]
    return [(i, t, rng.choice(["a", "b", None, "é"])) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 5, True, "z", 1) for i, t, s in rows], DOCS)


def doubled(spark):
    """A repeated row and null ids."""
    rows = corpus()
    return rows + [rows[0], (None, rows[5][1], "a"), (None, rows[5][1], "a"), (None, None, None)]


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1
def repeats(rows, spark):
    from plotline.llm.suffix_dedup import remove_repeats

    out = remove_repeats(frame(spark, rows)).collect()
    return Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out)


def test_suffix_dedup(spark):
    for rows in (corpus(), doubled(spark)):
        want = brute.removed([t for _, t, _ in rows])
        assert repeats(rows, spark) == Counter((d, *w) for (d, _, _), w in zip(rows, want))
    assert repeats([], spark) == Counter()


def test_suffix_dedup_hot_minimizers_and_groups(spark, monkeypatch):
    from plotline.llm import suffix_dedup as M

    rng = random.Random(5)
    line = "".join(rng.choice("abcdefghij ") for _ in range(90))
    rows = [(i, "".join(rng.choice("abcdefg ") for _ in range(700)) + line + "".join(rng.choice("abcdefg ") for _ in range(700)), "s") for i in range(40)]
    rows += [(40, rows[0][1][300:1200], "s"), (41, rows[1][1][650:] + rows[0][1][:500], "s")]
    want = brute.removed([t for _, t, _ in rows])
    assert repeats(rows, spark) == Counter((d, *w) for (d, _, _), w in zip(rows, want))
    for hot in (3, 1):
        monkeypatch.setattr(M, "HOT", hot)
        assert repeats(rows, spark) == Counter((d, *w) for (d, _, _), w in zip(rows, want))
    monkeypatch.undo()


def test_suffix_dedup_joins_a_block_once(spark, monkeypatch):
    from plotline.llm import suffix_dedup as M

    rng = random.Random(6)
    text = words(rng, 250, 10**6)
    rows = []
    for i in range(40):  # near copies: many classes under each minimizer
        w = list(text)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(w), "s"), (2 * i + 1, rows[-1][1] if rows and i % 4 == 0 else " ".join(w[5:]), "s")]
    texts = M._rows(frame(spark, rows), "doc_id", "text")
    blocks = M._find_blocks(texts, 400).count()
    want = brute.removed([t for _, t, _ in rows])
    for hot in (256, 8, 1):
        monkeypatch.setattr(M, "HOT", hot)
        assert 0 < M._occurrences(texts, 400, False).count() <= blocks
        assert repeats(rows, spark) == Counter((d, *w) for (d, _, _), w in zip(rows, want))


def test_suffix_dedup_memory_of_near_copies():
    import tracemalloc

    import pyarrow as pa

    from plotline.llm import suffix_dedup as M

    rng = random.Random(15)
    texts = []
    for _ in range(8):
        text = [rng.choice("abcdefgh ") for _ in range(736)]
        for _ in range(250):  # just under HOT; their repeats lie in each other
            at = rng.randrange(736)
            texts.append("".join(text[:at] + ["X"] + text[at + 1 :]).encode())
    twice = [False] * len(texts)
    given = lambda *c: pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=[str(i) for i in range(len(c))])
    mh, bh = [i // 250 for i in range(len(texts))], list(range(len(texts)))
    tracemalloc.start()
    try:
        found = [r for b in M._suffix_runs(iter([given(mh, bh, texts, twice)]), 400, False) for r in b.to_pylist()]
        assert tracemalloc.get_traced_memory()[1] < 120e6  # of 1.5 MB of text
    finally:
        tracemalloc.stop()
    gone = Counter()
    for r in found:
        gone[r["bh"]] += r["end"] - r["start"]
    assert [gone[i] for i in bh] == [n for _, n, *_ in brute.removed([t.decode() for t in texts])]
    # a batch of classes does not come out as one batch of all its parts
    parts = [b for b in M._parts(iter([given(mh, bh, [350] * len(texts), texts, twice)]), 400, 6)]
    assert max(b.num_rows for b in parts) <= M.ROWS < sum(b.num_rows for b in parts) / 4


def test_suffix_dedup_long_text(spark):
    rng = random.Random(11)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(1_300_000))
    rows = [(1, long, "s"), (2, long[1_000_000:1_200_000], "s"), (3, "ü" * 700 + long[1_048_400:1_048_900], "s")]
    got = repeats(rows, spark)
    assert {(d, n, gone) for d, n, gone, _, _ in got} == {(1, 1_300_000, 200_000), (2, 200_000, 200_000), (3, 1900, 1900)}


def groups_of(spark, rows, length):
    from plotline.llm.suffix_dedup import repeat_groups

    found = defaultdict(list)
    for r in repeat_groups(frame(spark, rows), length=length).collect():
        found[r.repeat, r.length].append((r.doc_id, r.start))
    return found


def test_repeat_groups(spark, monkeypatch):
    from plotline.llm import suffix_dedup as M

    rng = random.Random(12)
    piece = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c, line = piece(300), piece(180), piece(260), piece(60)
    rows = [(0, piece(50) + a + b + c + piece(40)), (1, a + b + c), (2, piece(30) + b + piece(90) + c), (3, c), (4, c), (5, piece(70) + b), (6, "na " * 60), (7, None), (8, a[:200] + piece(9) + a)]
    rows += [(10 + i, piece(90) + line + piece(80)) for i in range(12)]
    rows = [(d, t, "s") for d, t in rows]
    texts = {d: (t or "").encode() for d, t, _ in rows}
    for hot, length in ((256, 40), (3, 40), (1, 100)):
        want = brute.repeat_groups(texts, length)
        monkeypatch.setattr(M, "HOT", hot)
        got = {}
        for (_, n), places in groups_of(spark, rows, length).items():
            d, s = places[0]
            string = texts[d][s : s + n]
            assert string not in got  # no string has two groups
            got[string] = sorted(places)
        assert all(places == brute.places(texts, w) for w, places in got.items())
        assert all(got.get(w) == places for w, places in want.items())


def test_shared_passages(spark):
    from plotline.llm.suffix_dedup import remove_repeats

    rng = random.Random(14)
    passages = [words(rng, 51, 10**6) for _ in range(40)] + [words(rng, 20, 10**6)]
    rows = []
    for k, p in enumerate(passages):
        for _ in range(2):
            rows.append((len(rows), " ".join([*words(rng, rng.randrange(90), 10**6), *p, *words(rng, rng.randrange(90), 10**6)]), k))
    rows += [(1000, None, -1), (1001, "", -1), (1002, " ".join(words(rng, 3000, 10**6)), -1)]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, k int")).collect()
    assert {r.doc_id for r in out if r.n_shared} == {d for d, _, k in rows if 0 <= k < 40} and len(out) == len(rows)


def test_suffix_array_and_maximal_repeats():
    from plotline.llm.suffix import maximal_repeats, suffix_array

    rng = np.random.default_rng(2)
    for _ in range(30):
        parts = [rng.integers(0, 3, rng.integers(1, 30)) for _ in range(3)]
        u = np.concatenate(parts)
        offs = np.cumsum([0, *map(len, parts)])
        ends = np.repeat(offs[1:], np.diff(offs))
        sa, lcp = suffix_array(u, ends, 30)
        s = [tuple(u[p : ends[p]]) for p in sa]
        assert s == sorted(s)
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert list(lcp[1:]) == [common(a, b) for a, b in zip(s, s[1:])]
        left = np.where(np.isin(np.arange(len(u)), offs[:-1]), 100 + np.arange(len(u)), np.roll(u, 1))
        found, best = maximal_repeats(sa, lcp, left, 2)
        # a maximal repeat occurs twice, with different neighbours on both sides
        at = defaultdict(list)
        for p in range(len(u)):
            for n in range(2, ends[p] - p + 1):
                at[tuple(u[p : p + n])].append(p)
        want = {}
        for t, ps in at.items():
            right = {u[p + len(t)] if p + len(t) < ends[p] else -1 - p for p in ps}
            if len(ps) > 1 and len({left[p] for p in ps}) > 1 and len(right) > 1:
                want[t] = sorted(ps)
        assert {tuple(u[sa[lo] : sa[lo] + n]): sorted(sa[lo : hi + 1].tolist()) for lo, hi, n in found} == want
        for j, b in enumerate(best):
            assert b == max([len(t) for t, ps in want.items() if sa[j] in ps], default=0)


# 2
def test_mixing(spark):
    from plotline.llm.mixing import mix_documents, mix_sources

    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(900)]
    rows += [(900, None, "a"), (901, "", "only empty"), (902, "w w", "Z")]
    df = frame(spark, rows)
    out = mix_sources(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = brute.targets(sizes)
    taken = Counter()
    for r in out:
        s = None if r.src_null else r.src
        assert abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken[s] += r.taken
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert Counter(map(tuple, mix_sources(df.repartition(3)).collect())) == Counter(map(tuple, out))
    copies = {r.doc_id: r.copies for r in out}
    mixed = mix_documents(df)
    assert mixed.columns == df.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({d: c for d, c in copies.items() if c})
    assert mix_sources(empty(spark)).count() == 0 and mix_documents(empty(spark)).count() == 0
    # repeated and null ids: every row has its result, whatever the partitioning
    again = frame(spark, doubled(spark) + rows[:300] + rows[:40] + [(None, "w w w", "a")] * 30)
    one, other = (Counter(map(tuple, mix_sources(again.repartition(*n)).collect())) for n in ((7,), (3, "doc_id")))
    assert one == other and sum(one.values()) == again.count()
    one, other = (Counter(map(tuple, mix_documents(again.repartition(*n)).collect())) for n in ((7,), (3, "doc_id")))
    assert one == other


# 3
def test_personal_data(spark):
    from plotline.llm.pii import find_personal, sanitize

    more = [(1000, "@" * 50 + "a" * 3000 + "@b.c" + ".d" * 3000 + " " + "1 2" * 4000 + " 1.1.1.1" * 50 + "+1" * 100, "a"), (1001, "😀 +1 555 0100 99 é x@y.zz,4111111111111111", "b"), (1002, "﷐a﷐@b.c.﷐d .@a.b", "b")]
    for rows in (corpus() + more, doubled(spark)):
        want = Counter((d, *brute.personal(t)[0], brute.personal(t)[1]) for d, t, _ in rows)
        out = find_personal(frame(spark, rows)).collect()
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base) for r in out) == want
    df = frame(spark, corpus() + more)
    clean = {r.doc_id: r for r in sanitize(df).collect()}
    for d, t, s in corpus() + more:
        counts, _ = brute.personal(t)
        if not sum(counts):
            assert clean[d].text == t
        assert clean[d].source == s and sum(brute.personal(clean[d].text)[0]) == 0
    assert sanitize(df).columns == df.columns
    assert find_personal(empty(spark)).count() == 0 and sanitize(empty(spark)).count() == 0


def test_disclosing_terms_are_generalised(spark):
    from plotline.llm.pii import find_personal, sanitize

    rng = random.Random(1)
    rows = [(i, " ".join(["alpha", "beta", *words(rng, 5)]) + " filler", "a") for i in range(60)]
    rows += [(100 + i, f"common note {i}: the Zorblax director writes to boss@zor.org about alpha beta {i}", "a") for i in range(5)]
    out = {r.doc_id: r for r in find_personal(frame(spark, rows)).collect()}
    text = rows[60][1]
    at = text.index("Zorblax")
    assert any(s in out[100].spans for s in (f"remove:{at}:{at + 7}", f"generalise:{at}:{at + 7}")) and "email:" in out[100].spans
    kept = text.index("alpha")
    assert f":{kept}:{kept + 5}" not in out[100].spans and out[0].spans == ""
    clean = {r.doc_id: r.text for r in sanitize(frame(spark, rows)).collect()}
    assert "Zorblax" not in clean[100] and "boss@zor.org" not in clean[100] and "alpha beta" in clean[100]


def test_disclosing_terms_are_weighed_over_whole_documents(spark):
    from plotline.llm.pii import find_personal, sanitize

    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = [(i, f"{filler(30)} alpha beta gamma delta {i}", "a") for i in range(60)]
    far = [(100 + i, f"Zorblax {filler(60)} zorblax {filler(60)} {i} boss@zor.org", "a") for i in range(5)]
    one = [(200, f"{filler(50)} Quixano {filler(50)} sole@one.org", "a")]
    # as documents 30 of 32 with "quiet" mention the address, as texts one of three
    copied = [(300 + i, f"quiet {filler(0)} word@copy.org alpha", "a") for i in range(30)] + [(400 + i, f"quiet {filler(20)} {i}", "a") for i in range(2)]
    given = rows + far + one + copied
    out = {r.doc_id: r.spans.split(",") for r in find_personal(frame(spark, given)).collect()}
    for d, t, _ in far:
        assert [s for s in out[d] if s[0] in "gr"] == [f"remove:{a}:{a + 7}" for a in (0, t.index("zorblax"))]
    at = one[0][1].index("Quixano")
    assert [s for s in out[200] if s[0] in "gr"] == [f"remove:{at}:{at + 7}"]
    assert all([s.split(":")[0] for s in out[d]] == ["email"] for d, _, _ in copied[:30])
    clean = {r.doc_id: r.text for r in sanitize(frame(spark, given)).collect()}
    assert all("zorblax" not in clean[d].lower() for d, _, _ in far) and all(clean[d] == t for d, t, _ in rows)


# 4
def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark, tmp_path):
    from plotline.llm.chat import format_chats, linear_messages, op4_reply_trees, read_back

    tricky = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\|im_end|> <|im_start|>assistant\n", "<<SYS>>\\", None, "", "a\n\nb\\n", "<" * 5 + "|im_end|>", "x" * 50_000, "é😀 [\\INST]"]
    rows = [(c, t, random.Random(c * 31 + t).choice(["user", "assistant", "system", None, "ro\\le\nx<|im_end|>"]), tricky[(c * 7 + t * 3) % len(tricky)]) for c in range(12) for t in range(c % 9 + 1)]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "r"), (3, None, "assistant", "last"), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie")]
    (tmp_path / "t").mkdir()
    conversations(spark, rows).write.parquet(str(tmp_path / "t" / "conversations.parquet"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op4_reply_trees(spark, str(tmp_path / "t")).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows + [(-7, 0, "user", tricky[0]), (-7, 1, "assistant", tricky[0])]:
        by[c].append(((t is None, t or 0), (role is not None, role or ""), (text is not None, text or ""), role, text))
    want = {c: brute.chat([x[3:] for x in sorted(v, key=lambda x: x[:3])]) for c, v in by.items()}
    assert got == want
    m = linear_messages(conversations(spark, []))
    assert read_back(format_chats(m, tree_col="tree", node_col="node", parent_col="parent", role_col="role", text_col="text")).count() == 0


def test_reply_trees_rank_branches(spark):
    from plotline.llm.chat import format_chats, reply_paths

    edges = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 3, 5.0), ("t", 5, 2, 9.0), ("t", 6, 3, None), ("t", 7, 99, 1.0), ("u", 1, None, None), ("c", 1, 2, 1.0), ("c", 2, 1, 1.0)]
    df = spark.createDataFrame(edges, "tree string, node int, parent int, score double")
    got = defaultdict(list)
    for r in reply_paths(df).orderBy("tree", "branch_rank", "depth").collect():
        got[r.tree, r.branch_rank].append(r.node)
    assert got == {("t", 1): [1, 3, 4], ("t", 2): [1, 2, 5], ("t", 3): [1, 3, 6], ("t", 4): [7], ("u", 1): [1]}
    deep = spark.range(0, 100).select(F.lit("d").alias("tree"), F.col("id").cast("int").alias("node"), (F.when(F.col("id") > 0, F.col("id") - 1)).cast("int").alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    r = format_chats(deep, tree_col="tree", node_col="node", parent_col="parent", role_col="role", text_col="text", best=1).first()
    assert r.n_turns == 100 and r.formatted.index("\n3<") < r.formatted.index("\n40<") and r.loss == []


# 5
def test_near_duplicates(spark):
    from plotline.llm.minhash import drop_near_duplicates, near_duplicates

    rows = corpus()
    for size in (4, 5):
        want = brute.near([r[:2] for r in rows], size)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), size=size).collect()}
        assert got == want
    df = frame(spark, rows)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, (_, c) in want.items() if d == c}
    out = near_duplicates(frame(spark, doubled(spark))).collect()
    assert len(out) == len(doubled(spark)) and sum(r.kept for r in out if r.n_shingles and r.component_id == 0) == 1
    assert near_duplicates(empty(spark)).count() == 0


def test_near_duplicate_clusters_without_a_common_leader(spark, monkeypatch):
    """Many different near copies, with links only between some of them, in buckets of many blocks."""
    from plotline.llm import minhash as M
    from plotline.llm.minhash import near_duplicates

    monkeypatch.setattr(M, "BLOCK", 20)

    rng = random.Random(11)
    base, rows = words(rng, 120), []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(1, 5)):
            w[k] = f"y{rng.randrange(1000)}"
        rows.append((i, " ".join(w), "a"))
    want = brute.near([r[:2] for r in rows], 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()} == want


def test_estimate_is_corrected_for_chance():
    from plotline.llm.minhash import HASHES, signatures

    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.0, 0.3, 0.8):
        errors = []
        for _ in range(20):
            n = int(1000 * 2 * share / (1 + share))
            p = rng.permutation(pool)
            a, b = p[:1000], np.concatenate([p[:n], p[1000 : 2000 - n]])
            _, _, packed = signatures(np.concatenate([a, b]), np.array([1000, 1000]))
            x = packed[:, 0] ^ packed[:, 1]
            m = HASHES - int(np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
            errors.append((m / HASHES - 0.25) / 0.75 - share)
        assert abs(np.mean(errors)) < 0.05


# 6
def test_nearest(spark):
    from plotline.llm.ann import nearest, visit_cells

    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16))
    rows = [(i, [float(v) for v in x[i]], "z") for i in range(700)]
    rows += [(1000 + i, rows[100][1], "z") for i in range(30)] + [(2000, None, "z"), (2100, [0.0] * 16, "z"), (2200, [float("nan")] * 16, "z"), (2300, [1.0] * 3, "z"), (2400, [None] * 16, "z"), (None, rows[1][1], "z"), (2500, [float("inf")] * 16, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    got = defaultdict(list)
    for r in nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    hits = total = 0
    assert set(got) == {i for i, _ in good if i % 100 == 0}
    for q, v in good:
        if q % 100 == 0:
            best = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q)[:10]
            hits, total = hits + len({i for _, i in best} & {i for i, _ in got[q]}), total + 10
            assert all(abs(s - np.sqrt(((dict(good)[i] - v) ** 2).sum())) < 1e-12 for i, s in got[q])
            assert got[q] == sorted(got[q], key=lambda z: (z[1], z[0]))
    assert hits / total >= 0.9
    assert [i for i, _ in got[100]][:10] == list(range(1000, 1010))
    assert nearest(df.limit(0)).count() == 0
    order = visit_cells(np.array([3.0, 1.0]), np.array([0.0, 5.0]), np.ones(4, int), 4)
    assert order == [2, 0, 3, 1]


def recall(df, rows, **how):
    from plotline.llm.ann import nearest

    got = defaultdict(set)
    for r in nearest(df, **how).collect():
        got[r.query_id].add(r.vec_id)
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = []
    for q in np.flatnonzero(ids % 100 == 0):
        gap = ((m - m[q]) ** 2).sum(1)
        gap[ids == ids[q]] = np.inf
        hits.append(len(got[ids[q]] & set(ids[np.lexsort((ids, gap))[:10]].tolist())) / 10)
    return np.mean(hits)


def test_nearest_recall_and_small_blocks(spark, monkeypatch):
    from plotline.llm import ann as M

    rng = np.random.default_rng(9)
    clustered = rng.normal(size=(40, 24))[rng.integers(0, 40, 6000)] + 0.1 * rng.normal(size=(6000, 24))
    clustered[rng.permutation(6000)[:2000]] = clustered[0]  # a third of all rows are one vector
    shapeless = rng.normal(size=(6000, 24))
    monkeypatch.setattr(M, "BLOCK_ROWS", 300)
    monkeypatch.setattr(M, "ASKED_ROWS", 7)
    for x, least in ((shapeless, 0.9), (clustered, 0.9)):
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert recall(df, rows, sample=3000) >= least
    long = [(i, rng.normal(size=3000).tolist()) for i in range(300)]
    assert recall(spark.createDataFrame(long, "vec_id long, embedding array<double>"), long) >= 0.9


def test_visit_share_falls_with_rows_and_likeness():
    from plotline.llm.ann import visit_share

    assert visit_share(10, 10, 0.5) == 1.0
    for a, b in ((100, 1000), (10**4, 10**6), (10**6, 10**9)):
        assert visit_share(a, 10, 0.5) > visit_share(b, 10, 0.5)
    assert visit_share(10**6, 10, 0.3) > visit_share(10**6, 10, 0.6) > visit_share(10**6, 10, 0.95)


# 7
PAGES = [
    ("https://a.org/1", '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav><div class="cookie-notice">Accept?</div><article><h1>One &amp;\n two</h1><p>First <b>bold<br><p>Second&nbsp;x &lt;p&gt;<aside>ad</aside></article><section class="comments"><p>me too</p></section><footer>&copy;</footer><script>var a="</p>";</script></body></html>', "One & two\nFirst bold\nSecond x <p>"),
    ("https://a.org/2", "<p>no article<div>two<div class='ad'>buy</div>three", "no article\ntwo\nthree"),
    (None, None, ""), ("x", "", ""), ("https://a.org/3", "plain text only", "plain text only"), ("https://a.org/4", "<!-- only a comment", ""), ("https://a.org/5", "<div title='a>b'>q</div><form><p>f</form>", "q"),
]


def test_html(spark):
    from plotline.llm.html_extract import extract_pages, parse

    for _, page, text in PAGES:
        assert parse(page or "") == text
    schema = "page_id long, url string, html string, text int, host string"
    df = spark.createDataFrame([(i, u, h, 1, "z") for i, (u, h, _) in enumerate(PAGES)] + [(0, *PAGES[0][:2], 1, "z"), (None, *PAGES[1][:2], 1, "z")], schema)
    out = Counter((r.page_id, r.text, r.n_chars) for r in extract_pages(df).collect())
    assert out == Counter([(i, t, len(t)) for i, (_, _, t) in enumerate(PAGES)] + [(0, PAGES[0][2], len(PAGES[0][2])), (None, PAGES[1][2], len(PAGES[1][2]))])
    assert extract_pages(df.limit(0)).count() == 0
    assert parse("<div>" * 3000 + "deep") == "deep" and len(parse("<p>" + "word " * 200_000)) == 999_999


def test_template_subtrees_are_removed(spark):
    from plotline.llm.html_extract import extract_pages

    rng = random.Random(1)
    page = lambda i, n: f"<body><div><p>Site slogan</p><table><tr><td>links</table></div><div><p>{' '.join(words(rng, 20))} {i}</p></div><div><p>seldom {i % 20}</p></div>"
    rows = [(i, f"http://h{n}.org/{i}", page(i, n), n) for n in (0, 1) for i in range(n * 100, n * 100 + 30)] + [(999, "http://alone.org/", page(1, 2), 2)]
    out = {r.page_id: r.text for r in extract_pages(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert all("slogan" not in t and "links" not in t and "seldom" in t for i, t in out.items() if i < 999) and "slogan" in out[999]
    same = [(i, "http://c.org/x", "<nav>n</nav><article><p>copied page</p></article>") for i in range(40)]
    assert {r.text for r in extract_pages(spark.createDataFrame(same, "page_id long, url string, html string")).collect()} == {"copied page"}


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_template_subtrees_inside_the_article_are_removed(spark, tag):
    from plotline.llm.html_extract import extract_pages

    rng = random.Random(4)
    letter = "<div><p>Get our letter every week</p><p>It is free</p></div>"
    page = lambda i, extra: f"<body><{tag}><div><p>{' '.join(words(rng, 20))}</p>{extra}<p>{' '.join(words(rng, 9))} {i}</p></div></{tag}></body>"
    # 6 of 200 pages hold the block: a share of the host's pages would miss it
    rows = [(i, f"http://h.org/{i}", page(i, letter if i < 6 else "")) for i in range(200)]
    rows += [(300 + i, f"http://few.org/{i}", page(i, letter)) for i in range(4)]
    copied = page(0, letter)
    rows += [(400 + i, f"http://copies.org/{i}", copied) for i in range(30)]
    out = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("letter" not in out[i] and "free" not in out[i] and len(out[i].split()) == 30 for i in range(200))
    assert all("Get our letter every week\nIt is free" in t and len(t.split()) == 38 for i, t in out.items() if i >= 300)


def test_pages_against_a_plain_version(spark):
    from plotline.llm import html_extract as M

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("page_id", "html", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).collect()
    got = {r.page_id: r.text for r in M.extract_pages(pages).collect()}
    assert got == dict(zip([r.page_id for r in rows], brute.main_texts([(r.host, r.html) for r in rows], M, M.MIN_PAGES)))
    # the same pages with blocks of their sites, one in a container and one a paragraph on every other page
    put = lambda r: r.html.replace("</article>", f"<div><p>More on {r.host}</p><ul><li>here</ul></div>{'<p>Write to us' * (r.page_id % 2)}</article>")
    more = [(r.page_id, f"http://{r.host}/", put(r), r.host) for r in rows if r.html]
    out = M.extract_pages(spark.createDataFrame([r[:3] for r in more], "page_id long, url string, html string")).collect()
    want = dict(zip([r[0] for r in more], brute.main_texts([(h, x) for _, _, x, h in more], M, M.MIN_PAGES)))
    assert {r.page_id: r.text for r in out} == want
    assert 0 < sum("More on" in t for t in want.values()) < 150 and sum("Write to us" in t for t in want.values()) > 50


def test_an_article_of_templates_does_not_let_outside_text_in():
    from plotline.llm.html_extract import parse

    page, hashes = "<article><p>template</p></article><div>outside</div>", set()
    assert parse(page, hashes=hashes) == "template" and parse(page, hashes) == ""


def test_phrases_that_authors_repeat_stay(spark):
    from plotline.llm.html_extract import extract_pages

    rng = random.Random(6)
    page = lambda i: f"<article><p>{' '.join(words(rng, 20))} {i}</p>{'<p>All rights reserved.</p>' * (i < 12)}<p>Sent by the site</p></article>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(40)]
    out = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(("All rights reserved." in t) == (i < 12) and "Sent by" not in t for i, t in out.items())


# 8
def test_shards(spark):
    from plotline.llm.sharding import rebalance, shard_records, slot_stats

    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(0, 200), "a") for i in range(3000)] + [(None, None, "a")] * 3 + [(5, "x", "a")]
    placed, chart = shard_records(frame(spark, rows), shards=7, slots=256)
    out = placed.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    totals = [sum(r.size for r in v) for v in by.values()]
    assert len(by) == 7 and max(totals) / min(totals) < 1.02 and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    old = {r.vslot: r.shard for r in chart.collect()}
    new = {r.vslot: (r.shard, r.version) for r in rebalance(chart, slot_stats(placed, 256), 8).collect()}
    assert set(new) == set(old) and {v for _, v in new.values()} == {2}
    moved = [s for s in old if new[s][0] != old[s]]
    assert len(moved) < 80 and 7 in {s for s, _ in new.values()}
    loads = Counter()
    for r in out:
        loads[new[r.vslot][0]] += r.size
    assert max(loads.values()) / min(loads.values()) < 1.2
    assert shard_records(empty(spark))[0].count() == 0


# 9
def test_quality(spark):
    from plotline.llm.quality import quality_rules

    rows = doubled(spark)
    out = quality_rules(frame(spark, rows).withColumn("n_words", F.lit("clash"))).collect()
    want = Counter()
    for d, t, _ in rows:
        f = brute.rules(t)
        extra = brute.covered_words(t) if len(t or "") < 5000 else None
        want[(d, *f, extra)] += 1
    got = Counter()
    for r in out:
        small = len(r.text or "") < 5000
        got[(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, (r.covered_words, r.longest_repeat) if small else None)] += 1
        assert r.kept == (not r.base_failed and r.covered_words <= 0.3 * r.n_words and r.longest_repeat <= 300)
    assert got == want and quality_rules(empty(spark)).count() == 0


# 10
def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from plotline.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    odd = ["It's we'LL I'd Ünïcödé straße ΟΔΟΣ ǅ İstanbul é  x y 12a3 <|endoftext|> a", "x\x1cy\x0bz\x85w", "don't 's 'S ª² ½ …ſt ﬁ", "tab\tline\r\nnext"]
    rng = random.Random(8)
    signs = "aAbBzZ éÉÿŸıİſßªº²½×÷\xad\xa0\x85\u0301's'll're 01239.,!?<|>-_\n\t\r\x0b日本ñÑœŒŉ\x7f\x1fĲĳ"
    odd += ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(300)]
    odd += ["".join(f"long{rng.randrange(10**6)} " for _ in range(150_000))]  # over a megabyte
    rows = doubled(spark) + [(5000 + i, t, "a") for i, t in enumerate(odd)]
    out = pack(frame(spark, rows), vocabulary=path, group=16).collect()
    want = Counter()
    for d, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[(d, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert pack(empty(spark), vocabulary=path).count() == 0


def test_packing_remembers_few_parts_and_other_vocabularies(monkeypatch, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    from plotline.llm import packing as M

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [t or "" for _, t, _ in corpus()]
    raw = [t.encode() for t in texts]
    block = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(M, "PARTS_KEPT", 40)
    known = M.WordTokenizer(path)
    for _ in range(2):
        assert not known.plain and [x.tolist() for x in known.ids(*block)] == want
    other = json.loads(plain.to_str())
    other["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(other))
    known = M.WordTokenizer(str(tmp_path / "other.json"))
    plain = Tokenizer.from_file(str(tmp_path / "other.json"))
    assert known.plain and [x.tolist() for x in known.ids(*block)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_vector_best_fit_limits():
    from plotline.llm.packing import vector_best_fit

    rng = np.random.default_rng(0)
    n = rng.integers(1, 2049, 3000)
    bins, _ = vector_best_fit(n, 2048, 2048, 2048.0**2)
    assert len(set(bins)) <= 1.03 * n.sum() / 2048
    scalar, _ = vector_best_fit(n, 2048, 2048, 2048.0**2, (1.0, 0.0, 0.0))
    assert len(set(scalar)) >= len(set(bins)) and (scalar != bins).any()  # the other dimensions change the choice
    bins, _ = vector_best_fit(n, 2048, 3, 1024.0**2 + 2048.0**2 / 2)
    ok = n.astype(float) ** 2 <= 1024.0**2 + 2048.0**2 / 2
    for b in set(bins):
        own = n[bins == b]
        assert len(own) <= 3 and own.sum() <= 2048 and ((own.astype(float) ** 2).sum() <= 1024.0**2 + 2048.0**2 / 2 or not ok[bins == b].all())


# the pipeline and the registered queries
def test_pipeline(spark):
    import corpus_pipeline as P

    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, kept = given, [given.count()]
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, SMALL)
        if k < 4:
            assert docs.columns == given.columns
            docs = docs.cache()
            kept.append(docs.count())
        if k == 0:
            texts = {r.doc_id: r.text for r in given.collect()}
            assert {r.doc_id for r in docs.collect()} == {d for d, t in texts.items() if not brute.rules(t)[5]}
        if k == 2:
            assert all(sum(brute.personal(r.text)[0]) == 0 and r.n_chars == len(r.text) for r in docs.collect())
    assert kept[0] >= kept[1] >= kept[2] == kept[3] and docs.where("length > 2048").count() == 0
    assert P.run(spark, SMALL).count() > 0
    spark.catalog.clearCache()


def test_pipeline_with_empty_tables_and_clashing_names(spark):
    import corpus_pipeline as P

    for rows in ([], corpus()[:14]):
        docs = spark.createDataFrame([(i, t, s, 5, False, "z", 1) for i, t, s in rows], DOCS)
        names = docs.columns
        for k, (_, stage) in enumerate(P.STAGES):
            docs = stage(spark, docs, SMALL)
            if k < 4:
                assert docs.columns == names and docs.where("kept or size <> 5 or _rid <> 'z'").count() == 0
        assert (docs.count() > 0) == bool(rows)


@pytest.mark.parametrize("name", ["op4_reply_trees", "op5_bbit_minhash", "op9_suffix_repetition"])
def test_oracles(spark, name):
    from plotline.llm import queries as Q

    assert compare.difference(Q.queries()[name](spark, SMALL), compare.connect(SMALL), Q.oracle_sql()[name]) is None


def test_common_prints_count_repeats():
    from plotline.llm.minhash import common_prints

    rng = np.random.default_rng(6)
    rows = [np.sort(rng.integers(0, 40, rng.integers(0, 60)).astype(np.uint16)) for _ in range(30)]
    p, q = np.triu_indices(30, 1)
    want = [sum((Counter(rows[a].tolist()) & Counter(rows[b].tolist())).values()) for a, b in zip(p, q)]
    prints = [r.tobytes() for r in rows]
    assert common_prints(prints, p, q).tolist() == want
    assert common_prints(prints, p[:20], q[:20]).tolist() == want[:20]


# 11
VECTORS = "vec_id long, embedding array<float>, component int, n long, _v string, label int"


def plain_whitening(vectors, k=4):
    """The contract with numpy: (fit size, deviations, whitened, shares) of the usable vectors."""
    x = np.floor(np.array(vectors, np.float64) * 256).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-12 * e.sum()).sum()))
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ (v[:, :k] / np.sqrt(e[:k])), e[:k] / e.sum()


def whitened(spark, rows):
    from plotline.llm.whitening import whiten

    return whiten(spark.createDataFrame([(i, v, 7, 7, "z", 1) for i, v in rows], VECTORS))


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 24)) * np.linspace(1, 2, 24) @ np.linalg.qr(rng.normal(size=(24, 24)))[0] / 8
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (7, rows[7][1]), (None, rows[9][1]), (302, [0.0] * 24), (303, [-1e-9] * 24)]  # ties, repeated rows, a null id
    bad = [(400, None), (401, [float("nan")] + [0.0] * 23), (402, [float("inf")] + [0.0] * 23), (403, [None] + [0.0] * 23), (404, []), (405, [1.0] * 5)]
    out = whitened(spark, rows + bad)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    n, deviation, want, shares = plain_whitening([v for _, v in rows])
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10
    signs = {}
    for j in range(4):
        mine = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == j + 1)
        sign = np.sign(sum(r.whitened * want[[i for i, _ in rows].index(r.vec_id), j] for r in got if r.component == j + 1))
        plain = sorted((str(i), int(d), sign * w) for (i, _), d, w in zip(rows, deviation, want[:, j]))
        signs[j] = sign
        assert [m[:2] for m in mine] == [p[:2] for p in plain] and np.allclose([m[2] for m in mine], [p[2] for p in plain], atol=1e-9)
        assert np.allclose([r.explained for r in got if r.component == j + 1], shares[j], rtol=1e-9)


def test_whitening_edges(spark):
    assert whitened(spark, []).count() == whitened(spark, [(1, None)]).count() == whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0
    flat = whitened(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]).collect()  # variance in one direction only
    assert {r.component for r in flat} == {1} and all(r.explained == pytest.approx(1) for r in flat)
    few = whitened(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])]).collect()
    assert {r.component for r in few} == {1, 2} and {r.identity_error < 1e-10 for r in few} == {True}
    same = whitened(spark, [(2 * i + s, [float((1 - 2 * s) * (j == i)) for j in range(6)]) for i in range(6) for s in (0, 1)]).collect()  # all eigenvalues equal
    assert {r.component for r in same} == {1, 2, 3, 4} and max(r.identity_error for r in same) < 1e-10
    far = lambda step: [(i, [float((-1) ** i * step + i), float(i % 3)]) for i in range(50)]
    x = [[int((-1) ** i * 2**25 + 256 * i), 256 * (i % 3)] for i in range(50)]  # deviations of up to 62 bits are exact
    total = [sum(v) for v in zip(*x)]
    assert all(r.deviation == sum((50 * a - b) ** 2 for a, b in zip(x[r.vec_id], total)) for r in whitened(spark, far(2.0**17)).collect())
    with pytest.raises(Exception):
        whitened(spark, far(2.0**24)).collect()


# 12
LANGS = "doc_id long, text string, lang string, rank long, a long, size int, phrase string"


def plain_collocations(rows, least, top, most=5):
    """The contract with dictionaries."""
    import re

    count, n, pieces = Counter(), Counter(), []
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                for i in range(len(w) - m + 1):
                    count[lang, tuple(w[i : i + m])] += 1
    frequent = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    hidden = {(lang, p[i : i + m]): True for (lang, p), a in frequent.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if a >= frequent[lang, p[i : i + m]]}
    out = defaultdict(list)
    for (lang, p), a in frequent.items():
        if (lang, p) not in hidden:
            s, _, l, r = min((1000 * a * n[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-s, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


def phrases(spark, rows, **how):
    from plotline.llm.collocations import collocations

    df = spark.createDataFrame([(i, t, g, 1, 1, 1, "z") for i, t, g in rows], LANGS)
    return {tuple(r) for r in collocations(df, **how).collect()}


def phrase_corpus():
    rng = random.Random(11)
    stock = [" ".join(words(rng, rng.randrange(2, 8), 30)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(stock) if rng.random() < 0.5 else " ".join(words(rng, rng.randrange(1, 6), 60)) for _ in range(rng.randrange(1, 12))]
        text = "".join(p + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "?! "]) for p in parts)
        rows.append((i, text.upper() if i % 9 == 0 else text, rng.choice(["en", "de", None, "und"])))
    rows += [(200, "", "en"), (201, None, "en"), (202, ".,;", "fr"), (203, "na " * 5000, "en"), (204, "É é É é " * 30, "fr"), (205, "x" * 9000, "xx"), rows[3], rows[3], (None, rows[4][1], rows[4][2])]
    return rows


@pytest.mark.parametrize("least,top", [(5, 2000), (12, 7), (2, 40)])
def test_collocations(spark, least, top):
    rows = phrase_corpus()
    assert phrases(spark, rows, min_count=least, top=top) == plain_collocations(rows, least, top)


def test_collocations_burst_spill_and_partitions(spark, monkeypatch):
    from plotline.llm import collocations as M

    rows = phrase_corpus()
    want = plain_collocations(rows, 6, 2000)
    monkeypatch.setattr(M, "BURST_ROWS", 8)
    monkeypatch.setattr(M, "TRIE_BYTES", 3000)
    monkeypatch.setattr(M, "BLOCK", 2000)
    monkeypatch.setattr(M, "PART_WORDS", 1)
    assert phrases(spark, rows, min_count=6) == want
    for filters, most in ((1, 3), (2, 5), (4, 5), (3, 2)):
        monkeypatch.setattr(M, "FILTERS", filters)
        assert phrases(spark, rows, min_count=6, max_words=most) == plain_collocations(rows, 6, 2000, most)
    assert phrases(spark, []) == phrases(spark, [(1, None, None)]) == set()


def test_trie_spills_everything_once():
    from plotline.llm import collocations as M

    rng = np.random.default_rng(3)
    key = rng.integers(0, 5000, 60_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    trie, runs = M.Trie(), []
    for part in np.array_split(key, 30):
        part, count = np.unique(part, return_counts=True)
        trie.add(M.Rows(part, (part >> np.uint64(52)).astype(np.uint16), count))
        runs += list(trie.spill())
    runs += list(trie.runs())
    total = Counter()
    for r in runs:
        assert (r.key[1:] > r.key[:-1]).all()  # sorted, each key once
        total.update(dict(zip(r.key.tolist(), r.count.tolist())))
    assert total == Counter(key.tolist())


def test_scores_pass_64_bits(spark):
    rows = [(i, "a b " * 40, "en") for i in range(50)]
    (lang, rank, phrase, a, l, r, n, score), *_ = sorted(phrases(spark, rows, min_count=100), key=lambda x: x[1])
    assert score == 1000 * a * n // (l * r)
    exact = spark.sql("select cast(1000 * cast(9223372036854775807 as decimal(19,0)) as decimal(22,0)) * cast(999999999999999 as decimal(16,0)) div (cast(9223372036854775807 as decimal(19,0)) * cast(1000000007 as decimal(19,0))) as s").first().s
    assert exact == 1000 * 9223372036854775807 * 999999999999999 // (9223372036854775807 * 1000000007)


# 13
def trigrams(texts):
    """Costs of a language model of some texts, by the operator's formula, over counted dictionaries."""
    from plotline.llm import toxicity as M

    counts = np.zeros(M.N**3)
    for t in texts:
        s = [int(M.SYMBOL[b]) for b in t.encode()]
        s = [x for i, x in enumerate(s) if i == 0 or x or s[i - 1]]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[(a * M.N + b) * M.N + c] += 1
    three = counts.reshape(M.N, M.N, M.N)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    w3, w2, w1, w0 = M.MIXED
    p = w1 * one / max(one.sum(), 1) + w0 / M.N + w2 * two[None] / np.maximum(two.sum(axis=1), 1)[None, :, None] + w3 * three / np.maximum(three.sum(axis=2), 1)[..., None]
    return (-np.log(p)).astype(np.float32).ravel()


PLAIN = ["the idiot said that the moron is a loser and that stupid trash is worthless ", "a clown is pathetic and the scum of the earth is disgusting the letters of the cat tell all "] * 20


def test_language_model(spark):
    from plotline.llm.toxicity import language_model

    got = language_model(spark.createDataFrame([(t,) for t in [*PLAIN, "", None, "1d10t looooser a.b.c"]], "text string"))
    assert np.allclose(got, trigrams([*PLAIN, "                    "]), atol=1e-5)


def every_reading(unit, costs):
    """The likeliest reading by trying all."""
    from itertools import product

    from plotline.llm import toxicity as M

    cuts = [0, *(i for i in range(1, len(unit)) if unit[i] != unit[i - 1]), len(unit)]
    part = [False, *(bool(M.LETTER[unit[i]] or M.SIGNED[unit[i]]) for i in cuts[:-1]), False]
    options = []
    for j in range(1, len(cuts)):
        lone = (part[j - 1] and (j < 3 or not part[j - 2])) or (part[j + 1] and (j + 2 >= len(part) or not part[j + 2]))
        options.append(M._options(unit[cuts[j - 1]], cuts[j] - cuts[j - 1], part[j - 1] and part[j + 1], lone))
    best = (np.inf, b"")
    for path in product(*options):
        cost, a, b = 0.0, 0, 0
        for symbols, more, _ in path:
            cost += more
            for s in symbols:
                if s or b:
                    cost += costs[(a * M.N + b) * M.N + s]
                    a, b = b, s
        cost += costs[(a * M.N + b) * M.N] if b else 0.0
        if cost < best[0] - 1e-9:
            best = (cost, b"".join(t for _, _, t in path))
    return best


def test_viterbi_finds_the_likeliest_reading():
    from plotline.llm.toxicity import decode

    costs = trigrams(PLAIN)
    view = memoryview(costs)
    wanted = {b"1d10t": b"idiot", b"m0r0n": b"moron", b"$tup1d": b"stupid", b"l o s e r": b"loser", b"s.c.u.m": b"scum", b"tr@sh": b"trash", b"l00ser": b"loser", b"w0rth1e55": b"worthless", b"cl0wn!!!": b"clown!!!", b"idi0t.": b"idiot.", b"t e l l": b"tell"}
    for unit, text in wanted.items():
        assert decode(unit, view) == text, unit
    rng = random.Random(4)
    for _ in range(150):
        unit = "".join(rng.choice("idot1050$@!.- aes") for _ in range(rng.randrange(1, 9))).encode()
        cost, text = every_reading(unit, costs)
        assert decode(unit, view) == text or abs(every_reading(unit, costs)[0] - cost) < 1e-6


def test_units_and_restoring(spark):
    from plotline.llm import toxicity as M

    texts = ["plain words, only. 1984 is a number! ok", "an 1d10t here", "so looooong", "i d i o t", "a b", "x-y-z w", "1 2 3 4", "thinly$$$", "", "été c'est", "e" * 5000]
    data = "".join(texts).encode()
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    s, e = M.units(np.frombuffer(data, np.uint8), offs)
    assert [data[a:b].decode() for a, b in zip(s, e)] == ["1d10t", "looooong", "i d i o t", "x-y-z", "thinly$$$", "e" * 5000]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*texts, None, "An 1D10T, l o s e r É"])], "score long, text string, predicted string")
    out = {r.score: r.text for r in M.deobfuscate(df, trigrams(PLAIN)).collect()}
    assert out[0] == texts[0] and out[1] == "an idiot here" and out[8] == out[11] == "" and out[9] == texts[9] and out[12] == "an idiot, loser é"
    assert M.deobfuscate(df, trigrams(PLAIN)).columns == df.columns


def toxic_corpus():
    rng = random.Random(9)
    bad = ["idiot", "moron", "loser", "trash"]
    hide = [lambda w: w, lambda w: w, lambda w: w, lambda w: w.replace("o", "0").replace("i", "1"), lambda w: " ".join(w), lambda w: w[0] + w[1] * 4 + w[2:], lambda w: w.upper()]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 5 == 0
        w = words(rng, rng.randrange(30, 120), 900)
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(hide)(rng.choice(bad)))
        rows.append((i, " ".join(w), rng.choice(["en", None]), "s", 1.0))
        if i % 10 < 8:
            labels.append((i, int(toxic), 1))
    rows += [(5000, "", None, None, 1.0), (5001, None, "en", "s", 1.0), (5002, "word " * 60_000 + "idiot", "en", "s", 1.0), (None, "idiot moron", "en", "s", 1.0), rows[0], rows[0]]
    labels += [(3, None, 1), (4, 0, 1), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def scored(spark, rows, labels):
    from plotline.llm.toxicity import toxicity

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    return toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    out = scored(spark, rows, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1200]
    toxic = [r for r in held if r.doc_id % 5 == 0]
    assert len(toxic) > 30 and np.mean([r.predicted for r in toxic]) > 0.95 and np.mean([r.predicted for r in held if r.doc_id % 5]) < 0.02
    one = {r.doc_id: r.score for r in got}
    assert one[5000] == one[5001] < 0.3 < one[5002] and one[None] > 0.3
    # labels of held-out rows, languages and sources change nothing; nor do reruns
    flipped = [(i, 1 - t if t is not None and i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else t, q) for i, t, q in labels]
    again = scored(spark, [(i, t, "de", "other", 2.0) for i, t, *_ in rows], flipped).collect()
    assert np.allclose(sorted(r.score for r in again), sorted(r.score for r in got), atol=1e-9)


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = toxic_corpus()
    assert scored(spark, [], labels).count() == 0
    for some in ([], [x for x in labels if x[1] == 0]):
        got = scored(spark, rows[:20], some).collect()
        assert len(got) == 20 and len({r.score for r in got}) == 1
