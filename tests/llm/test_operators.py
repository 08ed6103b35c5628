"""Each operator against plain Python, on tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import chat, common, decontamination, embeddings, hmm, jaccard, licenses, mixing, pii, repeats, suffixes, tokens, toxicity
from tests.llm import brute as B

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, h string, cls string, left string"


def frame(spark, rows):
    """Documents (doc_id, text, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", "y", "z", "l") for d, t, s in rows], SCHEMA).repartition(3)


def prose(r, n):
    return " ".join(r.choice(["the", "of"]) if r.random() < 0.3 else "".join(r.choice(["an", "er", "ti", "ö", "sh"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    texts = [prose(r, r.choice([3, 40, 120, 300])) for _ in range(60)]
    shared = prose(r, 130)
    long = prose(r, 6000)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[3], "s0") for i in range(20)]  # copies: a large group
    rows += [(200 + i, texts[4] + f" tail{i}", "s1") for i in range(8)] + [(220, texts[4].replace(" ", "  "), "s1")]
    rows += [(300 + i, prose(r, 60) + "\n" + shared + "\n" + prose(r, 10 * i), "s0") for i in range(6)]
    rows += [(400, long, "s2"), (401, long[:20000] + " x " + long[20000:], "s2"), (402, "na " * 700, "s2"), (403, "x" * 3000, "s2")]
    rows += [(500, None, "s0"), (501, "", None), (502, None, None), (503, " \n\t ", "s1"), (504, "one", "s1"), (505, "one", "s1")]
    rows += [(600, texts[5], "s1"), (600, texts[5], "s1"), (600, texts[6] + " other", "s1"), (None, texts[7], "s1"), (None, None, None)]
    return rows


def test_decontamination(spark, corpus):
    r = random.Random(6)
    bench = [(1, corpus[40][1]), (2, prose(r, 30)), (3, " ".join(prose(r, 30).split()[:4])), (4, None), (5, ""), (6, "ONE"), (7, corpus[40][1]), (None, prose(r, 12))]
    docs = [*corpus, (700, "A " + bench[1][1].upper() + ", z", "s0"), (701, " ".join(bench[1][1].split()[5:15]), "s0"), (702, f"{bench[2][1]}! {bench[2][1]} {bench[7][1]}", "s0")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontamination.decontaminate(spark, frame(spark, docs), b).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(B.decontaminate([(d, t) for d, t, _ in docs], bench), key=key)
    dirty = {(d, t) for d, t, _ in docs if B.decontaminate([(d, t)], bench)[0][5]}
    kept = decontamination.clean(spark, frame(spark, docs), b)
    assert kept.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")]
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((d or -1, t or "") for d, t, _ in docs if (d, t) not in dirty)


def test_decontamination_without_broadcast(spark, corpus, monkeypatch):
    b = spark.createDataFrame([(1, corpus[40][1])], "item_id long, text string")
    want = sorted(map(str, decontamination.decontaminate(spark, frame(spark, corpus), b).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, decontamination.decontaminate(spark, frame(spark, corpus), b).collect())) == want


def test_empty_tables(spark):
    docs, none = frame(spark, []), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        decontamination.decontaminate(spark, docs, none), mixing.mix(spark, docs), licenses.scan(docs), pii.report(spark, docs), jaccard.link_documents(spark, docs),
        repeats.remove_repeats(spark, docs), hmm.lm_scores(spark, docs), toxicity.score(spark, docs, labels), embeddings.link_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")),
        chat.digest(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))), jaccard.keep_one(spark, docs), pii.redact(spark, docs),
    ):
        assert out.count() == 0


def water(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, total, out, left = {s: weights[i % 3] for i, s in enumerate(names)}, sum(sizes.values()), {}, set(sizes)
    while left:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left.remove(s)
    return out


def test_mixing(spark, corpus):
    rows = [*corpus, *[(1000 + i, "w " * 7, "tiny") for i in range(3)], *[(2000, "same row again", "many")] * 30, *[(3000 + i, prose(random.Random(i), 50), "aaa") for i in range(40)]]
    got = mixing.mix(spark, frame(spark, rows)).collect()
    again = mixing.mix(spark, frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, most = {}, {}
    for _, t, s in rows:
        n = len(B.RUN.findall(t or ""))
        sizes[s] = sizes.get(s, 0) + n
        most[s] = max(most.get(s, 0), n)
    want = water(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert sum(r.size for r in own) == sizes[s] and all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= most[s] / 2 + 1
    assert all(r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size for r in got)


def test_licenses(spark):
    rows = [(1, "Some text.\nLicensed under the Apache License, Version 2.0.\nmore", None), (2, "LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.!!", None), (3, "Released under the MIT License.", None), (4, "a license to think", None), (5, None, None), (6, "", None),
            (7, "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nhttp", None),
            (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. x. The software is provided \"as is\", without warranty of any kind, express or implied.\nAll rights reserved.", None),
            (9, "x\n" * 5000 + "Licensed under CC BY-NC 4.0.", None)]
    got = {r.doc_id: (r.n_known, r.licences) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: (1, "Apache-2.0"), 2: (1, "Apache-2.0"), 3: (1, "MIT"), 4: (0, ""), 5: (0, ""), 6: (0, ""), 7: (2, "Apache-2.0"), 8: (3, "MIT,Proprietary"), 9: (1, "CC-BY-NC-4.0")}


HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\[INST] ", " [/INST]", "[ROLE] a [SAYS] b", "<s>", "\\\\<", "", "plain [1] < 2", "é\n[OUT] x [/OUT]", " [/OUT] ", "a\\", "$1 \\$2", "[NONE] ", " "]


def test_chat(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool [SAYS] x", "", None, "a\\"]), r.choice(HOSTILE) + r.choice(HOSTILE)) for c in range(60) for t in range(r.randint(1, 6))]
    rows += [(99, 0, "user", None), (99, 0, "user", None), (99, None, "assistant", "late"), (None, 1, "assistant", "x" * 50000), (98, 1, "b", "2"), (98, 1, "a", "2"), (98, 1, "a", "1")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.digest(chat.format_turns(turns)).collect()}
    assert got == B.turns(rows)
    f = chat.format_turns(turns).filter("conv_id = 99").first().formatted
    assert f == "<s>[OUT] late [/OUT][INST]  [/INST][INST]  [/INST]</s>"


def test_chat_escapes_what_comes_back_changed(spark, monkeypatch):
    """Turns that the first rendering leaves plain by mistake are escaped when the whole is read again."""
    monkeypatch.setattr(chat, "one", lambda role, text: F.lit(True))
    rows = [(1, 0, "user", "a [/INST][OUT] b"), (1, 1, "assistant", "plain"), (2, 0, "user", "plain [1]")]
    out = {x.conv_id: x for x in chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[2].formatted == "<s>[INST] plain [1] [/INST]</s>" and "\\[/INST]" in out[1].formatted
    got = chat.digest(spark.createDataFrame(list(out.values()))).collect()
    assert {x.conv_id: x.n_turns for x in got} == {1: 2, 2: 1}


def test_pii_base(spark):
    r = random.Random(2)
    bits = ["a@b.co", "x.y+z@mail-1.example.com", "a@b", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+1234", "+12 34 56 78 90 12 34 56", "@", "é", " ", "-", ".", "_q@w.e", "12", "\n", "4111-1111-1111-1111", "+"]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " ", "x"]) for _ in range(r.randint(0, 25))), None) for i in range(400)]
    rows += [(1000, None, None), (1001, "", None), (1002, "a" * 60000 + " " + "9" * 60000, None), (1003, "a@" + "b." * 20000 + "c", None), (1004, "+1" + "(" * 50000, None), (1005, "1 " * 30000, None), (1, "dup a@b.co", None), (1, "dup a@b.co", None)]
    got = sorted((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in pii.report(spark, frame(spark, rows)).collect())
    want = []
    for d, t, _ in rows:
        s = B.pii(t) if d != 1002 else B.pii("9" * 60000)
        want.append((d, *(sum(x[0] == k for x in s) for k in B.KINDS), B.sha(",".join(f"{k}:{a}:{z}" for k, a, z in s))))
    assert got == sorted(want)


def test_pii_bootstrap(spark):
    r = random.Random(3)
    rows = [(i, f"{prose(r, 20)} account number: {40 * str(i)[:1] if False else '%040x' % r.getrandbits(160)} {prose(r, 5)}", None) for i in range(12)]
    rows += [(50 + i, f"{prose(r, 20)} account number: ZX-{1000 + i}-77 {prose(r, 5)}", None) for i in range(3)]
    rows += [(80 + i, f"{prose(r, 10)} in the year2024 of {prose(r, 10)}", None) for i in range(5)]
    got = {x.doc_id: x.n_new for x in pii.report(spark, frame(spark, rows)).collect()}
    assert all(got[50 + i] == 1 for i in range(3)) and all(got[80 + i] == 0 for i in range(5))
    out = pii.redact(spark, frame(spark, [*rows, (90, "mail a@b.co, +1 (555) 123-4567.", None), (91, None, None)]))
    text = {x.doc_id: (x.text, x.n_chars) for x in out.collect()}
    assert all((x._k1, x.h) == ("x", "y") for x in out.collect())
    clash = frame(spark, rows).withColumns({"_p1": F.lit(1), "_spans": F.lit(2)})
    assert all((x._p1, x._spans) == (1, 2) for x in pii.redact(spark, clash).collect())
    assert text[90] == ("mail [EMAIL], [PHONE].", 22) and text[91][0] is None and "ZX-1000" not in text[50][0] and out.columns[0] == "doc_id"


def test_pii_found_instances_bring_patterns(spark):
    """Tokens of an unseen shape are found by a seeded pattern and bring in a second one, which finds a third shape; a list
    with one-word keys is a pattern as well."""
    r = random.Random(6)
    key = lambda: "%040x" % r.getrandbits(160)
    far = prose(r, 40)  # context lies in the words next to the token, whatever stands before
    rows = [(i, f"{far} access code: {key()} end", None) for i in range(6)]
    rows += [(20 + i, f"{far} access code: QX-{100 + i}-Z end", None) for i in range(4)] + [(30 + i, f"{far} badge no. QX-{100 + i}-Z end", None) for i in range(4)]
    rows += [(40, f"{far} badge no. 77/ab/9001 end", None), (50, "token: " + " token: ".join([key(), key(), key(), key(), key(), key(), "Y12345"]), None)]
    got = {x.doc_id: x.n_new for x in pii.report(spark, frame(spark, rows)).collect()}
    assert got[20] == 1 and got[30] == 1 and got[40] == 1 and got[50] >= 5


def test_pii_support_does_not_grow(spark):
    """Three seeds make a pattern among 7,000 others as well."""
    r = random.Random(4)
    key = lambda: "%040x" % r.getrandbits(160)
    rows = [(i, f"{prose(r, 5)} account number: {key()} end", None) for i in range(3)] + [(50, f"{prose(r, 5)} account number: ZX-1000-77 end", None)]
    few = {x.doc_id: x.n_new for x in pii.report(spark, frame(spark, rows)).collect()}
    many = [*rows, *[(100 + i, " ".join(f"w{chr(97 + j % 26)}{prose(r, 1)} {prose(r, 1)} {key()}" for j in range(100)), None) for i in range(70)]]
    got = {x.doc_id: x.n_new for x in pii.report(spark, frame(spark, many)).collect()}
    assert few[50] == got[50] == 1


def test_pii_occurrences(spark):
    import re

    r = random.Random(5)
    bits = ["Key", "is:", "no", "(#", "(#x1", "é", "--9", "no", "a.b", "#é1"]
    texts = [r.choice([" ", "\n", ""]) + r.choice([" ", " \t"]).join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(200)]
    want = {}
    for t in texts:
        w = re.findall(r"[^ \t\n\x0b\f\r]+", t.lower())
        for a, b, c in zip(w, w[1:], w[2:]):  # noqa: B905
            k = (a, b, re.match("[^A-Za-z0-9]*", c)[0])
            want[k] = want.get(k, 0) + 1
    docs, wanted = frame(spark, [(i, t, None) for i, t in enumerate(texts)]), spark.createDataFrame(list(want), "w1 string, w2 string, pre string")
    assert {(x.w1, x.w2, x.pre): x.seen for x in pii.occurrences(docs, wanted).collect()} == want


def components(n, pairs, ids):
    p = list(range(n))

    def f(x):
        while p[x] != x:
            x = p[x]
        return x

    links = [0] * n
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        a, b = f(a), f(b)
        p[max(a, b)] = min(a, b)
    low = {}
    for i in range(n):
        low[f(i)] = min(low.get(f(i), ids[i]), ids[i])
    return sorted((ids[i], links[i], low[f(i)]) for i in range(n))


@pytest.mark.parametrize("tile", [512, 4])
def test_jaccard(spark, corpus, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = [x for x in corpus if x[0] is not None]
    sets = []
    for _, t, _ in rows:
        w = B.words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = jaccard.link_documents(spark, frame(spark, rows)).collect()
    want = components(len(rows), pairs, [d for d, _, _ in rows])
    assert sorted((x.doc_id, x.n_links, x.component_id) for x in got) == want
    if tile == 512:
        kept = jaccard.keep_one(spark, frame(spark, rows)).collect()
        groups = {c for (_, n, c) in want if n}
        alone = sum(1 for _, n, _ in want if not n)
        assert len(kept) == len(groups) + alone and all(x._k1 == "x" for x in kept)
        clash = jaccard.keep_one(spark, frame(spark, rows).withColumns({"_p1": F.lit(1), "_again": F.lit("z")})).collect()
        assert len(clash) == len(kept) and all((x._p1, x._again) == (1, "z") for x in clash)


@pytest.mark.parametrize("others", [0, 1])
def test_jaccard_long_ties(others):
    """Texts at exactly 0.8 are linked, however long and whatever else is in their cluster."""
    import pyarrow as pa

    for n in range(1152, 1352, 4):  # shared shingles
        shared = [f"w{i}" for i in range(n + 4)]
        texts = [" ".join([*shared, *(f"{x}{i}" for i in range(n // 8))]) for x in "ab"] + ["p q r s t"] * others
        got = jaccard.linked([bytes([i]) for i in range(len(texts))], np.ones(len(texts), int), np.zeros(len(texts), int), pa.array(texts), 0.8)
        assert got == [(b"\0", b"\0", 1), (b"\1", b"\0", 1)]


def test_jaccard_one_tile_of_a_pair():
    """Rows of one tile only, in a group of two tiles, count nothing again."""
    import pyarrow as pa

    for n in (2, 3):
        text = [" ".join(f"w{i}" for i in range(400)) + " x" * k for k in range(n)]
        links = []
        for a, b, tile in ((0, 0, 0), (0, 1, 0), (1, 1, 1), (0, 1, 1)):
            t = pa.table({"cluster": [7] * n, "a": [a] * n, "b": [b] * n, "tile": [tile] * n, "cls": [bytes([k]) for k in range(n)], "mult": [1] * n, "text": text})
            links.append(sum(sum(x.column("links").to_pylist()) for x in jaccard.verify_batches(0.8)(iter(t.to_batches()))))
        assert links == [n * (n - 1), 0, n * (n - 1), 0]


def test_forest_recall():
    d = jaccard.prefix_depth(32, 10, 0.8, 0.9995)
    assert jaccard.recall(d, 32, 0.8) >= 0.9995 > jaccard.recall(d + 1, 32, 0.8)


@pytest.mark.parametrize("tile", [4096, 16])
def test_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 24))
    x = [*base, *(base[i] + r.normal(size=24) * s for i in range(12) for s in (0.05, 0.2, 0.3)), *[base[0]] * 15, base[1] * 1e-30, base[2] * 1e30, np.zeros(24)]
    rows = [(i, [float(v) for v in np.float32(y)]) for i, y in enumerate(x)] + [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan")] * 24), (904, [1.0, 2.0]), (905, [2.0, 4.0])]
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {i: (y := np.array(rows[i][1], np.float64) / np.abs(rows[i][1]).max()) / np.sqrt((y * y).sum()) for i in ok}
    pairs = [(i, j) for j in ok for i in ok if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    got = embeddings.link_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cls", F.lit(1)).repartition(3)).collect()
    assert sorted((y.vec_id, y.n_links, y.component_id) for y in got) == components(len(rows), pairs, [i for i, _ in rows])
    assert all(y.kept == (y.vec_id == y.component_id) for y in got)


def test_embeddings_shuffle_no_pairs(spark, monkeypatch):
    """Each vector is shuffled a bounded number of times, however many tiles there are; clusters across tiles stay whole."""
    monkeypatch.setattr(embeddings, "TILE", 16)
    monkeypatch.setattr(embeddings, "BAND", 5)
    r = np.random.default_rng(6)
    x = np.float32(np.repeat(r.normal(size=(400, 32)), 4, 0) + r.normal(size=(1600, 32)) * 0.15)
    frame = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "vec_id long, embedding array<float>")
    stages = lambda: spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    seen = {(s.stageId(), s.attemptId()) for s in (stages().apply(i) for i in range(stages().size()))}
    got = embeddings.link_vectors(spark, frame).collect()
    now = stages()
    written = sum(s.shuffleWriteBytes() for s in (now.apply(i) for i in range(now.size())) if (s.stageId(), s.attemptId()) not in seen)
    assert written < 12 * x.nbytes  # the components' rounds included
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    u, v = np.nonzero(unit @ unit.T >= 0.95)
    pairs = [(i, j) for i, j in zip(u.tolist(), v.tolist(), strict=True) if i < j]
    assert sorted((y.vec_id, y.n_links, y.component_id) for y in got) == components(len(x), pairs, range(len(x)))


def test_quantisation_bound():
    r = np.random.default_rng(9)
    x = r.normal(size=(300, 64))
    y, q, s, e = embeddings.pack(x)
    bound = e[:, None] * (1 + e) + e * (1 + e[:, None]) + e[:, None] * e
    assert (np.abs(y @ y.T - (s[:, None] * q) @ (s[:, None] * q).T) <= bound + 1e-5).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 60)] + [(900, 900)]
    r = random.Random(1)
    r.shuffle(edges)
    got = {x.node: x.component for x in common.components(common.Scratch(spark), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[500 + i] == 500 for i in range(60)) and got[900] == 900


def test_common_prefixes(monkeypatch):
    """Which sorted neighbours agree in their first bytes, against plain comparison; long repeats are not read byte by byte again."""
    r = random.Random(3)
    reads, made = [], suffixes.words_at

    class Counted(np.ndarray):
        def __getitem__(self, k):
            reads.append(np.size(k))
            return np.asarray(self)[k]

    monkeypatch.setattr(suffixes, "words_at", lambda b: made(b).view(Counted))
    for depth in (8, 16, 48):
        for _ in range(60):
            part = bytes(r.choice(b"ab") for _ in range(70))
            raw = b"".join(part[: r.randint(0, 70)] + bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(6)) + bytes(depth)
            order = np.array(sorted(range(len(raw) - depth), key=lambda i: raw[i : i + depth + r.randint(0, 1)]), np.int64)
            want = [raw[i : i + depth] == raw[j : j + depth] for i, j in zip(order, order[1:], strict=False)]
            assert suffixes.common(raw, order, depth).tolist() == want
    assert suffixes.common(b"x" * 400, np.zeros(0, np.int64), 400).tolist() == []
    raw, reads[:] = r.randbytes(3000) * 2, []
    order = np.array([k for i in range(2600) for k in (i, 3000 + i)], np.int64)
    assert suffixes.common(raw, order, 400).tolist() == [i % 2 == 0 for i in range(len(order) - 1)]
    assert sum(reads) < 10 * len(order)


def test_suffix_order():
    r = random.Random(1)
    for _ in range(200):
        strings = [bytes(r.choice(b"abc\0") for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 8))]
        size = np.array([len(s) for s in strings])
        raw = b"\0".join(strings) + b"\0"
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        last = begin + size - 1 - np.array([r.randint(0, 4) for _ in strings])
        order = suffixes.suffix_order(raw, begin, begin + size, last, 8)
        want = [p for b, z in zip(begin, last, strict=True) for p in range(b, z + 1)]
        assert sorted(order.tolist()) == sorted(want)
        end = begin + size
        keys = [raw[p : min(end[np.searchsorted(begin, p, "right") - 1], p + 8)] for p in order]
        assert keys == sorted(keys)


@pytest.mark.parametrize("crowd", [4000, 1])
def test_repeats(spark, corpus, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CONTEXTS", crowd)
    rows = [*corpus, (800, "é" * 300 + "tail one", "s0"), (801, "x" + "é" * 300 + "tail two", "s0")]
    got = sorted(((x.doc_id is None, x.doc_id or 0), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.remove_repeats(spark, frame(spark, rows)).collect())
    want = []
    for (d, _, _), (raw, cover) in zip(rows, B.repeats([t for _, t, _ in rows]), strict=True):
        kept = bytes(x for x, y in zip(raw, cover, strict=True) if not y)
        want.append(((d is None, d or 0), len(raw), sum(cover), sum(1 for i in range(len(cover)) if cover[i] and (i == 0 or not cover[i - 1])), B.sha(kept)))
    assert got == sorted(want)


def test_passages(spark):
    """51 words that two documents share are found wherever they stand and however short; 39 are not."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(40):
        shared = text(51 if i % 2 else 39)
        rows += [(10 * i, f"{text(r.randint(0, 200))}. {shared}, {text(r.randint(0, 90))}", None), (10 * i + 1, f"{text(r.randint(0, 90))} {shared.upper()} {text(60)}", None)]
    rows += [(1000, None, None), (1001, text(51), None), (1001, rows[0][1], None)]
    got = {(x.doc_id, x.n_bytes): x.n_passages for x in repeats.remove_repeats(spark, frame(spark, rows)).collect()}
    assert all((n > 0) == (d // 10 % 2 == 1) for (d, _), n in got.items() if 1 < d < 1000)
    assert got[1000, 0] == 0 and got[1001, len(rows[0][1])] > 0


def test_forward_is_exact():
    r = np.random.default_rng(3)
    pi, a, b = r.dirichlet([1] * 3), r.dirichlet([1] * 3, 3), r.dirichlet([1] * 5, 3).T
    seqs = [r.integers(0, 5, n) for n in (1, 4, 6, 6, 2)]
    length = np.array([len(s) for s in seqs])
    codes, off = np.concatenate(seqs), np.concatenate(([0], np.cumsum(length)[:-1]))
    order = next(hmm.stretches(length))
    x, at = hmm.laid(codes, off[order], length[order])
    like = hmm.forward(x, at, pi, a, b)

    def brute(s):
        p = 0.0
        for path in np.ndindex(*[3] * len(s)):
            q = pi[path[0]] * b[s[0], path[0]]
            for t in range(1, len(s)):
                q *= a[path[t - 1], path[t]] * b[s[t], path[t]]
            p += q
        return np.log(p)

    assert np.allclose(like, [brute(seqs[i]) for i in order])
    before = None
    for _ in range(6):  # the likelihood never falls
        f, m, o, total = hmm.expected(x, at, pi, a, b)
        assert before is None or total >= before - 1e-9
        pi, a, b, before = f / f.sum(), m / m.sum(1, keepdims=True), (o + 1e-12) / (o + 1e-12).sum(0), total


def test_expected_counts_are_exact():
    """Against sums over all paths, for blocks of any length."""
    r = np.random.default_rng(5)
    pi, a, b = r.dirichlet([1] * 2), r.dirichlet([1] * 2, 2), r.dirichlet([1] * 4, 2).T
    seqs = sorted((r.integers(0, 4, n) for n in (7, 5, 5, 1)), key=len, reverse=True)
    first, moves, out = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for s in seqs:
        paths = list(np.ndindex(*[2] * len(s)))
        p = np.array([pi[q[0]] * b[s[0], q[0]] * np.prod([a[x, y] * b[c, y] for x, y, c in zip(q, q[1:], s[1:])]) for q in paths])  # noqa: B905
        for q, w in zip(paths, p / p.sum(), strict=True):
            first[q[0]] += w
            for i, c in enumerate(s):
                out[c, q[i]] += w
                if i:
                    moves[q[i - 1], q[i]] += w
    length = np.array([len(s) for s in seqs])
    x, at = hmm.laid(np.concatenate(seqs), np.concatenate(([0], np.cumsum(length)[:-1])), length)
    for block in (1, 2, 3, 5, 100):
        f, m, o, _ = hmm.expected(x, at, pi, a, b, block)
        assert np.allclose(f, first) and np.allclose(m, moves) and np.allclose(o, out)


@pytest.mark.parametrize("frequent", [400_000, 20])
def test_lm_scores(spark, corpus, monkeypatch, frequent):
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    import math
    from collections import Counter

    tokens_ = [(d, [*B.RUN.findall((t or "").translate(B.LOWER)), None]) for d, t, _ in corpus]
    c = Counter(w for d, t in tokens_ if B.rem(d, 5) != 1 for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((d or -1, B.rem(d, 5) == 1, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for d, t in tokens_)
    got = hmm.lm_scores(spark, frame(spark, corpus), states=3, rounds=2).collect()
    assert sorted((x.doc_id or -1, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    assert all(x.score < 0 and math.isfinite(x.score) for x in got)
    assert sum(x.score for x in got) > sum(x.base_score for x in got)


def test_toxicity(spark):
    r = random.Random(8)
    bad = ["vilewordx", "nastyterm", "foulthing"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        t = prose(r, 60)
        rows.append((i, f"{t} {r.choice(bad)} {prose(r, 20)} {r.choice(bad)}" if toxic else t, None))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None), (1001, "", None), (1002, "vilewordx nastyterm foulthing " * 3000, None), (1, rows[1][1], None)]
    labels += [(1, 1, 0), (1002, 1, None), (None, 1, 1)]
    out = toxicity.score(spark, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 and x.held_out == (B.rem(x.doc_id, 3) == 1) for x in out)
    held = [x for x in out if x.held_out and x.doc_id < 600]
    assert np.mean([(x.predicted == 1) == (x.doc_id % 4 == 0) for x in held]) > 0.95
    assert next(x for x in out if x.doc_id == 1002).predicted == 1


def test_toxicity_learns_from_no_held_out_label(spark):
    """Other labels of held-out rows change no score."""
    r = random.Random(12)
    rows = [(i, prose(r, 30) + (" vilewordx" if i % 3 == 0 else ""), None) for i in range(120)]
    first = [(i, 1, int(i % 3 == 0)) for i in range(120)]
    other = [(i, q, 1 - t if B.rem(i, 3) == 1 else t) for i, q, t in first]
    got = [sorted((x.doc_id, x.score, x.evidence) for x in toxicity.score(spark, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()) for labels in (first, other)]
    assert got[0] == got[1]


def test_toxicity_weighs_all_terms(spark):
    """A word of a single example finds it."""
    r = random.Random(9)
    rows = [(i, prose(r, 20) + (f" vilewordx only{i}" if i % 4 == 0 else f" only{i}"), None) for i in range(80)]
    learn = [i for i in range(80) if B.rem(i, 3) != 1]
    one = learn[3]
    rows.append((1000, f"zz only{one}", None))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.evidence for x in toxicity.score(spark, frame(spark, rows), labels).collect()}
    assert got[1000].split(",")[0] == str(one)


def test_nearest_is_exact():
    r = np.random.default_rng(2)
    terms = [np.sort(r.choice(40, r.integers(1, 8), replace=False)) for _ in range(300)]
    tf = [r.integers(1, 5, len(t)).astype(float) for t in terms]
    index = toxicity.Index(terms, tf, r.integers(0, 2, 300), r.uniform(0.5, 3, 40), (3.0, 1.0))
    dense = np.zeros((300, 40))
    for e, (t, w) in enumerate(index.own):
        dense[e, t] = w
    for e in range(0, 300, 7):
        ids, cos = index.nearest(*index.own[e], 10)
        want = np.sort(dense @ dense[e])[::-1][:10]
        assert np.allclose(cos, want, atol=1e-6) and np.allclose((dense @ dense[e])[ids], cos, atol=1e-6)


def test_block_bounds_skip_blocks(monkeypatch):
    """Blocks are left out, and what is found is what a plain product finds."""
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    r = np.random.default_rng(4)
    terms = [np.sort(np.concatenate((r.choice(5, 2, replace=False), 5 + e // 20 * 10 + r.choice(10, 4, replace=False)))) for e in range(200)]
    index = toxicity.Index(terms, [np.ones(6) for _ in terms], r.integers(0, 2, 200), np.concatenate((np.full(5, 0.05), r.uniform(1, 3, 100))), (3.0, 1.0))
    dense = np.zeros((200, 105))
    for e, (t, w) in enumerate(index.own):
        dense[e, t] = w
    index.skipped = 0
    for e in range(200):
        ids, cos = index.nearest(*index.own[e], 5)
        assert np.allclose(cos, np.sort(dense @ dense[e])[::-1][:5], atol=1e-6) and np.allclose((dense @ dense[e])[ids], cos, atol=1e-6)
    assert index.skipped > 0


def test_words():
    import pyarrow as pa

    texts = ["Ab c1-é", "", "x", "é é", "a" * 10, "B"]
    (i, j, b, off), *_ = tokens.chunks(pa.array(texts))
    h, first = tokens.word_hashes(b, off)
    assert np.diff(first).tolist() == [len(B.words(t)) for t in texts] and h[first[3]] == h[first[3] + 1]
    assert tokens.word_hashes(*tokens_of("ab"))[0][0] == h[0]


def tokens_of(text):
    import pyarrow as pa

    (_, _, b, off), *_ = tokens.chunks(pa.array([text]))
    return b, off
