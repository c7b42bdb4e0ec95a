"""Joins, near-duplicates, packing, decontamination and the pipeline, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pulsegrid.llm import common, packing, projection_forest, signature_tree, suffix_decontamination, textcodes, tokens

DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def grouped(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = grouped({x for e in edges for x in e}, edges)
    assert got == {i: want[i] for i in {x for a, b in edges if a != b for x in (a, b)}}


def test_codes_of_a_long_text_are_those_of_its_words(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 90]))) for _ in range(400)]
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end = textcodes.words(buf, textcodes.SPACED)
    whole = textcodes.codes(buf, start, end)
    monkeypatch.setattr(textcodes, "PIECE_BYTES", 50)
    assert (textcodes.codes(buf, start, end) == whole).all() and len(whole) == 400
    assert len(set(whole.tolist())) == len(set(words))


# Signature trees


def near_copies(n, seed, size=(4, 60)):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(*size))]
        texts.append(words)
        for _ in range(rng.randrange(4)):
            copy = list(texts[-1] if rng.random() < 0.5 else words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    texts += [texts[0]] * 30 + [["w1"], ["W1"], ["w1", "w2"], ["w1", "w2", "w3"]]
    return [(i, "\t".join(w) + " ") for i, w in enumerate(texts)]


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("size", [(4, 60), (150, 700)])
def test_join_is_the_join_of_all_pairs(spark, monkeypatch, words, percent, size):
    monkeypatch.setattr(signature_tree, "BLOCK", 16)
    rows = near_copies(60 if size[0] < 100 else 25, 5, size) + [(9000, None), (9001, ""), (9002, " \t\n"), (9003, None)]
    sets = {}
    for i, t in rows:
        w = lowered(t).split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    ids = [i for i, _ in rows]
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[:k]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = grouped(ids, links)
    got = {r.doc_id: r for r in signature_tree.jaccard_components(frame(spark, rows), words=words, percent=percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want and len(links) > 50
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_a_large_group_is_joined_whole(spark, monkeypatch):
    """A chain of links in which few sets link with those of the first block."""
    monkeypatch.setattr(signature_tree, "BLOCK", 2)
    rng = random.Random(4)
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 200])) for i in range(40)]
    rows += [(100 + i, " ".join(words[:100] + [f"d{rng.random()}" for _ in range(25)])) for i in range(12)]
    got = {r.doc_id: r.component_id for r in signature_tree.jaccard_components(frame(spark, rows), words=3, percent=80).collect()}
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows for w in [t.split()]}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert got == grouped(sets, links) and len(set(got.values())) < len(rows) - 30


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_common_lines_do_not_chain_groups(spark, monkeypatch, words, percent):
    """Texts that share lines only are not compared; more copies than a group is left whole with stay together."""
    monkeypatch.setattr(signature_tree, "WHOLE", 8, raising=False)
    made = {}
    write = signature_tree.written
    monkeypatch.setattr(signature_tree, "written", lambda df, name: made.setdefault(name, write(df, name)) if name == "members" else write(df, name))
    rng = random.Random(11)
    own = lambda n: [f"w{rng.random()}" for _ in range(n)]
    lines = [own(9) for _ in range(3)]
    bases = [rng.choice(lines) + rng.choice(lines) + own(12 + i % 9) + rng.choice(lines) for i in range(60)]
    texts = [w for b in bases for w in (b, [*b, "end"], b[:-1])]
    texts += [[*bases[0], f"end{i}"] for i in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets = {i: {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} for i, w in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in signature_tree.jaccard_components(frame(spark, rows), words=words, percent=percent).collect()}
    assert got == grouped(sets, links) and len(set(got.values())) < 70
    assert max(r["count"] for r in made["members"].groupBy("group").count().collect()) <= 16


def test_sets_without_an_id_are_joined(spark):
    rng = random.Random(6)
    base = [f"w{rng.random()}" for _ in range(40)]
    texts = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 40, 13)] + ["quite another text of some words"]
    got = signature_tree.jaccard_components(frame(spark, [(None, t) for t in texts] + [(7, " ".join(base)), (None, " ".join(base))]), words=3, percent=80).collect()
    assert sorted((r.component_id or 0) for r in got) == [0] + [7] * 6
    with pytest.raises(ValueError):
        signature_tree.jaccard_components(frame(spark, []), percent=100)


def test_rows_that_share_an_id_keep_their_texts(spark):
    texts = ["a b c d e f g h", "other words stand in this text", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h"]
    rows = [(5, texts[0]), (5, texts[1]), (7, texts[1]), (8, texts[2]), (4, texts[2]), (5, None), (6, texts[3])]
    got = signature_tree.keep_one(frame(spark, rows), words=5, percent=80).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted([(5, texts[0]), (5, texts[1]), (4, texts[2]), (5, "")])


def test_linked_sets_have_a_key_in_common():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for n in (4, 9, 12, 30, 100, 1000, 20_000):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            d = int(len(a) * (100 - percent) / (100 + percent))
            b = np.unique(np.concatenate((a[d:], rng.integers(0, 2**63, d, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if both == len(a) == len(b) or 100 * both < percent * (len(a) + len(b) - both):
                continue  # equal sets are one class already
            which, key = signature_tree.keys([a, b], percent)
            assert len(np.intersect1d(key[which == 0], key[which == 1])) > 0


def test_keys_of_empty_parts_are_rare():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (10, 13, 25, 50, 90, 300, 3100, 9000, 15_000, 60_000) for _ in range(4)]
    for percent in (80, 90):
        which, key = signature_tree.keys(sets, percent)
        assert len(np.unique(key)) == len(key)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_as_many_keys_as_they_need(percent):
    rng = np.random.default_rng(13)
    for n in [*range(4, 40), 63, 64, 65, 130, 257, 700, 3000] * 3:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        gone = rng.integers(0, len(a) + 1)
        for new in range(0, len(a), max(1, len(a) // 12)):
            b = np.unique(np.concatenate((a[gone * (100 - percent) // 100 :], rng.integers(0, 2**63, new, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if both == len(a) == len(b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            which, key, need = signature_tree.keys_and_needs([a, b], percent)
            shared = np.intersect1d(key[which == 0], key[which == 1])
            for k in (0, 1):
                marks = need[(which == k) & np.isin(key, shared)]
                assert len(marks) and any((marks == m).sum() >= m >> 1 for m in np.unique(marks))


def test_keep_one(spark):
    rows = [(3, "a b c d e f g h", "x"), (1, "a b c d e f g h", "y"), (2, "other words stand in this text", "z"), (5, None, "n"), (6, "", "e"), (None, "a b c d e f g h", "k"), (2, "other words stand in this text", "z")]
    got = signature_tree.keep_one(frame(spark, rows, f"{DOCS}, code string"), words=5, percent=80)
    assert got.columns == ["doc_id", "text", "code"]
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 2, 5, 6]
    assert signature_tree.jaccard_components(frame(spark, [])).count() == 0


# Projection trees


def vectors(n=700, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 24))
    near = base[:200] + rng.normal(size=(200, 24)) * 0.15
    return np.concatenate((base, near, base[:5], near[:80] + rng.normal(size=(80, 24)) * 0.1))


def test_forest_recall_and_no_false_links(spark, monkeypatch):
    monkeypatch.setattr(projection_forest, "LEAF", 60)
    monkeypatch.setattr(projection_forest, "BLOCK", 40)
    x = vectors()
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] + [1.0] * 23), (5003, [None] + [1.0] * 23), (5004, [float("inf")] + [1.0] * 23), (5005, []), (3, rows[3][1])]
    # vectors of other lengths, few and many, with very large and small components
    rows += [(6000, [1.0, 2.0, 3.0]), (6001, [1e300, 2e300, 3.1e300]), (6002, [-3.0, 0.0, 1.0]), (6003, [1e-300, 2e-300, 3e-300])]
    rows += [(6100 + i, [float(np.cos(i // 2)), float(np.sin(i // 2 + 0.01 * (i % 2)))]) for i in range(40)]
    got = projection_forest.near_duplicates(frame(spark, rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    u = np.concatenate((x, x[3:4]))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [*range(len(x)), 3]
    want = grouped(range(len(x)), [(ids[a], ids[b]) for a, b in np.argwhere(near)])
    by = {r.vec_id: r for r in got}
    assert sum(by[i].n_links for i in range(len(x))) >= 0.9 * near[: len(x)].sum()
    assert all(by[i].n_links <= near[i].sum() for i in range(len(x)))
    assert all(want[by[i].component_id] == want[i] for i in range(len(x)))
    assert np.mean([by[i].component_id == want[i] for i in range(len(x))]) > 0.95
    assert all(by[i].n_links == 0 and by[i].kept for i in range(5000, 5006))
    assert {by[i].component_id for i in (6000, 6001, 6003)} == {6000} and by[6000].n_links == 2 and by[6002].n_links == 0
    assert all(by[6100 + i].n_links >= 1 and by[6100 + i].component_id >= 6100 for i in range(40))
    assert projection_forest.near_duplicates(frame(spark, [], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("rows", [5_000, 50_000_000])
def test_pairs_at_the_threshold_share_a_leaf(rows):
    rng = np.random.default_rng(9)
    x = projection_forest.unit(rng.normal(size=(4000, 48)))
    forest = projection_forest.Forest(x[:2000], rows)
    one, aside = x[2000:], rng.normal(size=(2000, 48))
    aside -= (aside * one).sum(1, keepdims=True) * one
    other = 0.951 * one + np.sqrt(1 - 0.951**2) * projection_forest.unit(aside)
    (r, a), (q, b) = forest.leaves(one), forest.leaves(other)
    met = {i for i, _ in set(zip(r.tolist(), a.tolist())) & set(zip(q.tolist(), b.tolist()))}
    assert len(met) >= 0.95 * 2000 and len(np.unique(a)) > (10 if rows < 10**6 else 1000)


# Packing


def check_packed(rows, counts, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(rows) == sum(counts.values())
    return len(by)


def test_packing_is_a_round_trip(spark):
    random.seed(7)
    words = ["lorem", "ipsum's", "don't", "DOLOR", "12", "345", "é", "naïve", "  ", "\n\n", "??!", "汉字", " ", "ß", "x" * 40, "<|endoftext|>", "\xa0", "ÃÂ"]
    texts = [" ".join(random.choice(words) for _ in range(random.choice([1, 5, 40, 300, 1500]))) for _ in range(120)] + [None, "", "a", "a"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    got = packing.pack(frame(spark, rows)).collect()
    tokenizer = tokens.Ids(tokens.default_path()).tokenizer
    want, counts = [], {}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        n = -(-len(ids) // 1024)
        cuts = [0, *[len(ids) - (n - 1 - k) * 1024 for k in range(n)]]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            counts[b - a] = counts.get(b - a, 0) + 1
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    used = check_packed(got, counts, 1024)
    assert used <= -(-sum(n * c for n, c in counts.items()) // 1024) + 2


def test_numbering_on_two_levels_and_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 3)
    monkeypatch.setattr(packing, "PARTS", 2)
    rng = random.Random(3)
    rows = [(i, " ".join(["a"] * rng.choice([1, 2, 3, 40]))) for i in range(150)]
    got = packing.place(common.written(packing.pieces(frame(spark, rows), capacity=16, keep_ids=True), "pieces"), 16).collect()
    counts = {}
    for r in got:
        counts[r.length] = counts.get(r.length, 0) + 1
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert counts[16] == sum(c == 16 for c in [x.length for x in got]) > 10
    check_packed(got, counts, 16)
    assert sorted({(r.doc_id, r.start) for r in got}) == sorted((r.doc_id, r.start) for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_all_pieces(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 1025): rng.randrange(1, 400) for _ in range(rng.choice([1, 10, 200]))}
    left = dict(counts)
    for n, lengths in packing.plan(counts):
        assert sum(lengths) <= 1024
        for x in lengths:
            left[x] -= n
    assert not any(left.values())


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, [])).count() == 0


# Decontamination


def plain_report(rows, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    queries = [(str(i), word.findall(lowered(t))) for i, t in items]
    out = {}
    for i, t in rows:
        w = word.findall(lowered(t))
        hit, names = set(), set()
        for name, q in queries:
            n = min(10, len(q))
            windows = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if q else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names.add(name)
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination_is_the_plain_search(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"q{i}" for i in range(30)]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(rng.choice([3, 10, 25, 60])))) for k in range(25)] + [("null", None), ("none", ""), ("i3", "q1 q1 q1 q1 q2")]
    rows = []
    for i in range(150):
        body = [rng.choice(words) for _ in range(rng.choice([0, 5, 80, 400]))]
        if i % 3 == 0:
            part = rng.choice(items[:25])[1].split()
            s = rng.randrange(len(part))
            body[len(body) // 2 : len(body) // 2] = part[s : s + rng.randrange(1, 40)]
        rows.append((i, rng.choice([" ", ", ", "\n", "-"]).join(body).upper() if i % 2 else " ".join(body)))
    rows += [(900, None), (901, "é!! Ünï-q1")]
    benchmark = frame(spark, items, "item_id string, text string")
    want = plain_report(rows, items)
    for block in (8_000_000, 900):
        monkeypatch.setattr(suffix_decontamination, "BLOCK_BYTES", block)
        got = suffix_decontamination.contamination_report(frame(spark, rows), benchmark).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    kept = suffix_decontamination.decontaminate(frame(spark, [(*r, i) for i, r in enumerate(rows)], f"{DOCS}, n_words int"), benchmark)
    assert kept.columns == ["doc_id", "text", "n_words"]
    assert {r.doc_id: r.n_words for r in kept.collect()} == {r[0]: i for i, r in enumerate(rows) if not want[r[0]][4]}
    empty = suffix_decontamination.contamination_report(frame(spark, rows[:3]), benchmark.limit(0)).collect()
    assert [r.n_hit for r in empty] == [0, 0, 0]


@pytest.mark.parametrize("window", [3, 10, 20, 40])
def test_windows_of_any_length(spark, monkeypatch, window):
    monkeypatch.setattr(suffix_decontamination, "BLOCK_BYTES", 700)
    monkeypatch.setattr(suffix_decontamination, "BLOCKS", 2)
    rng = random.Random(window)
    words = ["u", "v", "w"]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(60))) for k in range(20)]
    texts = [" ".join([*[rng.choice(words) for _ in range(30)], *items[i % 20][1].split()[5 : 5 + rng.randrange(2, 55)]]) for i in range(40)]
    got = suffix_decontamination.find_matches(frame(spark, [*enumerate(texts)]), frame(spark, items, "item_id string, text string"), window=window)
    have = {tuple(w[k : k + window]) for _, t in items for w in [t.split()] for k in range(61 - window)}
    for r in got.collect():
        w = texts[r.doc_id].split()
        hit = {p for k in range(len(w) - window + 1) if tuple(w[k : k + window]) in have for p in range(k, k + window)}
        assert r.n_hit == len(hit)
    assert suffix_decontamination.contamination_report(frame(spark, []), frame(spark, items, "item_id string, text string")).count() == 0


def test_longest_matches_have_their_places(spark):
    item = " ".join(f"a{i}" for i in range(30))
    docs = frame(spark, [(1, f"x y {' '.join(f'a{i}' for i in range(5, 25))} z")])
    got = suffix_decontamination.find_matches(docs, frame(spark, [("b", item)], "item_id string, text string")).first()
    assert [tuple(m) for m in got.matches] == [("b", 5, 2, 20)]


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ein", "ung"]}
    prose = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(2, 6))) for _ in range(n))
    item = " ".join(f"bench{k}" for k in range(20))
    rows = [(i, prose("ab"[i % 2] * 2, 60), "ab"[i % 2] * 2, "s", 0) for i in range(80)]
    copy = rows[10][1].split()
    copy[30] = "changed"
    rows += [(100, " ".join(copy), "aa", "s", 0), (101, rows[3][1], "bb", "s", 0), (102, f"{prose('aa', 30)} {item}", "aa", "s", 0), (103, "1234 !!", None, "s", 0), (104, None, None, "s", 0), (105, f"{prose('bb', 30)} me@mail.example", "bb", "s", 0)]
    docs = frame(spark, rows, f"{DOCS}, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [("b", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), "stage")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "best-fit packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "PII":
            assert "[EMAIL]" in {r.doc_id: r.text for r in docs.collect()}[105]
    every = {r[0] for r in rows}
    assert seen[0] == every - {103, 104}
    assert seen[1] == seen[0] - {100, 101}
    assert seen[2] == seen[1] - {102}
    assert seen[3] == seen[4] == seen[2]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[4]
