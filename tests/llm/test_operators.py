"""Training-data operators against brute force, round trips and held-out accuracy; nulls, blanks, ties, repeats."""

import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lineloom.llm import chat, decontaminate, jaccard_join, language_id, license_scan, lm_scoring, quality_classifier, quality_rules, queries, sentencepiece_nbest, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, cell string, items string"
ODD = [(1, None, "x", "y"), (2, "", "x", "y"), (3, " \n\t ", None, None), (None, "some words here", "x", "y"), (4, "a" * 5000, "x", "y"), (5, "same text", "x", "y"), (5, "same text", "x", "y")]


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, groups=4, copies=9, words=60):
    r, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{r.randrange(500)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randrange(4)):
                text[r.randrange(words)] = f"e{r.randrange(10**6)}"
            base = text if r.random() < 0.5 else base
            out.append(" ".join(text[: words - r.randrange(3)]))
    return list(enumerate(out))


@pytest.mark.parametrize("kwargs", [{}, {"max_docs": 3, "pivots": 2}, {"max_docs": 5, "pivots": 4}])
def test_jaccard_join_equals_brute_force(spark, kwargs):
    rows = near_copies(3) + [(100, "one two"), (101, "one two"), (102, "one"), (103, "")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=85, den=100, **kwargs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, 4, 85, 100)


@pytest.mark.parametrize("kwargs", [{}, {"max_docs": 3, "pivots": 2}, {"max_docs": 8, "pivots": 4}, {"max_items": 300, "pivots": 3}])
def test_link_counts_equal_brute_force(spark, kwargs):
    rows = near_copies(3) + near_copies(8, groups=6, copies=5)
    rows = [(i, t) for i, (_, t) in enumerate(rows + rows[:7])] + [(200, "one two"), (201, "one two"), (202, "one"), (203, "")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=85, den=100, **kwargs).collect()
    sets = {i: shingles(t, 4) for i, t in rows}
    link = lambda x, y: bool(x & y) and 100 * len(x & y) >= 85 * len(x | y)
    assert {r.doc_id: r.n_links for r in got} == {i: sum(link(x, y) for j, y in sets.items() if i != j) for i, x in sets.items()}


def test_link_counts_in_pivot_cells(spark):
    docs = [jaccard_join.shingle_set(t.encode().split(), 4) for _, t in near_copies(11, groups=3, copies=20)]
    sets = list({x.tobytes(): x for x in docs}.values())
    link = lambda x, y: 185 * len(np.intersect1d(x, y)) >= 85 * (len(x) + len(y))
    want = {i: sum(1 + j % 3 for j, y in enumerate(sets) if i != j and link(x, y)) for i, x in enumerate(sets)}
    divided = 0
    for pivots in (3, 4, 5):
        scratch = jaccard_join.Scratch(spark, "test")
        members = scratch.keep(spark.createDataFrame([("c", i, 1 + i % 3, bytearray(x.tobytes())) for i, x in enumerate(sets)], "cell string, f1 long, n_copies long, items binary"))
        got = jaccard_join.count_links(scratch, members, 85, 100, max_docs=len(sets) - 1, max_items=10**6, pivots=pivots).groupBy("f").agg(F.sum("links").alias("n")).collect()
        assert {i: n for i, n in want.items() if n} == {r.f: r.n for r in got if r.n}
        divided += scratch.n > 6  # not in blocks at once
    assert divided


def test_one_id_with_several_texts_links_each(spark):
    base = [[f"v{g}w{i}" for i in range(60)] for g in range(4)]
    near = lambda ws: " ".join([*ws[:-1], "changed"])
    # the texts of one id meet in one coarse class through it
    rows = [(1, " ".join(ws)) for ws in base] + [(10 + g, near(ws)) for g, ws in enumerate(base)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=85, den=100).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == sorted((i, 1, 1) for i, _ in rows)


@pytest.mark.parametrize("often", [2, 16])
def test_intersections(often):
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    own = np.array([0, 4, 29])
    got = jaccard_join.intersections(sets, own, often=often, width=8)
    assert all(got[i, j] == len(np.intersect1d(sets[a], b)) for i, a in enumerate(own) for j, b in enumerate(sets) if a != j)


def test_class_signatures_lose_no_linked_pair():
    r = np.random.default_rng(5)
    levels = jaccard_join.Levels(85, 100)
    for n in [*range(1, 60), 200, 1000]:
        x = np.unique(r.integers(1, 2**63, n, dtype=np.uint64))
        worst = int(3 * 2 * n / 37)
        for d in range(worst + 1):
            y = np.unique(np.concatenate((x[d // 2 :], r.integers(1, 2**63, d - d // 2, dtype=np.uint64))))
            both = len(np.intersect1d(x, y))
            if len(y) and 185 * both >= 85 * (len(x) + len(y)):
                i, s = jaccard_join.class_signatures([x, y], levels)
                assert set(s[i == 0].tolist()) & set(s[i == 1].tolist()), (n, d)


def test_odd_rows_everywhere(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    assert jaccard_join.jaccard_components(docs).count() == len(ODD)
    assert sentencepiece_nbest.encode(docs).where("lossless").count() == len(ODD)
    assert lm_scoring.score(docs.select("doc_id", "text"), docs).count() == len(ODD)
    assert language_id.identify(docs, {"en": " some words here "}).where("lang_pred = 'und'").count() == 3
    assert decontaminate.spans(docs, spark.createDataFrame([(1, "same text"), (2, None), (None, "x")], "item_id long, text string")).where("n_hit > 0").count() == 2
    assert license_scan.scan(docs).count() == 0
    labels = spark.createDataFrame([(5, 1), (None, 0), (4, None)], "doc_id long, quality int")
    assert quality_rules.judge(docs, quality_rules.fit(docs, labels)).where("kept").count() == 0
    assert quality_classifier.scores(docs, labels).count() == len(ODD)
    said = spark.createDataFrame([(1, 0, None, None, "x"), (1, 1, "assistant", "", "x"), (1, 1, "assistant", "", "x"), (None, None, "user", "a" * 5000, None), (None, 1, "assistant", " </turn>", None)], "conv_id long, turn long, role string, text string, cell string")
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in chat.digest(chat.conversations(chat.linear(said))).collect()} == {(1, 3, 0), (None, 2, 8)}
    pages = [(i, "u", t) for i, t, *_ in ODD]
    got = warc.archive(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, items string"))
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got.collect()) == warc_brute(pages)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.jaccard_components(docs).count() == 0
    assert license_scan.scan(docs).count() == 0
    assert language_id.training_texts(docs.withColumn("lang", F.lit("x"))) == {} and language_id.identify(docs, {}).count() == 0
    assert sentencepiece_nbest.encode(docs).count() == 0
    assert lm_scoring.score(docs, docs).count() == 0
    assert decontaminate.spans(docs, bench).count() == 0
    assert quality_classifier.scores(docs, labels).count() == 0
    assert quality_rules.judge(docs, quality_rules.fit(docs, labels)).count() == 0
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.digest(chat.conversations(chat.linear(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0


def test_rule_statistics_equal_brute_force(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["a", "b", "#c", "d|", "é", "\n", "\n\n x", "\t"]) for _ in range(r.randrange(40))) for _ in range(60)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("s", quality_rules.statistics(F.col("text"))).collect()
    for row in rows:
        t = row.text or ""
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert (row.s.n_words, row.s.word_chars, row.s.n_symbols, row.s.n_dup_lines, row.s.n_repeat_words) == want, t


@pytest.mark.parametrize("junk", ["0123456789", "!?;:\"'()[]{}@^~`\\/_=+-"])
def test_rules_learn_digits_and_marks(spark, junk):
    r = random.Random(6)
    word = lambda chars: "".join(r.choice(chars) for _ in range(6))
    rows = [(i, " ".join(word(junk if i % 3 == 0 else "abcdefghij") for _ in range(80))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = quality_rules.fit(docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int"))
    assert {x.doc_id: x.kept for x in quality_rules.judge(docs, rules).collect()} == {i: i % 3 > 0 for i in range(120)}


def test_base_score_equals_brute_force(spark):
    import math
    from collections import Counter

    docs = [(i, t) for i, t in enumerate(["The cat the dog", "a cat", None, "zebra THE"])]
    train = docs[:3]
    c = Counter(w for _, t in train for w in [*(t or "").lower().split(), "<end>"])
    n, v = sum(c.values()), len(c)
    for top in (1, 1 << 19):
        got = lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(train, "doc_id long, text string"), top=top).collect()
        for r in got:
            ws = [*(dict(docs)[r.doc_id] or "").lower().split(), "<end>"]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in c for w in ws), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))


def test_windows_score_each_token_once_and_sum_to_one():
    net = lm_scoring.Attention()
    kind, within = lm_scoring.frequency_classes(np.random.default_rng(0).integers(0, 50, 32000).astype(float))
    assert 10 ** within[kind == 3] @ np.ones((kind == 3).sum()) == pytest.approx(1)
    ids, size = np.random.default_rng(1).integers(0, 32000, 90), np.array([1, 24, 65])
    got = lm_scoring.score_tokens(net, ids, size, kind, within)
    for k, lo in enumerate([0, 1, 25]):
        own = kind[ids[lo : lo + size[k]]]
        before = np.concatenate(([lm_scoring.CLASSES], own[:-1]))
        total = 0.0
        for i in range(len(own)):
            start = 0 if i < lm_scoring.WINDOW else ((i - lm_scoring.WINDOW) // lm_scoring.STRIDE + 1) * lm_scoring.STRIDE
            window = np.full(lm_scoring.WINDOW, 0)
            window[: i - start + 1] = before[start : i + 1]
            log = net.forward(window[None])[0][0, i - start]
            assert np.exp(log).sum() == pytest.approx(1, abs=1e-4)
            total += log[own[i]] / np.log(10) + within[ids[lo + i]]
        assert got[k] == pytest.approx(total, rel=1e-4)


def test_scores_look_back_as_far_as_stated():
    net = lm_scoring.Attention()
    kind, within = lm_scoring.frequency_classes(np.random.default_rng(0).integers(0, 50, 32000).astype(float))
    assert net.width == 16
    single = np.flatnonzero(kind < 2)[:2]
    last = lambda ids: lm_scoring.score_tokens(net, ids, np.array([len(ids)]), kind, within)[0] - lm_scoring.score_tokens(net, ids[:-1], np.array([len(ids) - 1]), kind, within)[0]
    ids = np.random.default_rng(1).integers(0, 32000, 33)
    # the 32nd id is scored after all 31 before it; the 33rd, first of a later window, after the 9 before it
    for size, reach in ((32, 31), (33, 9)):
        other = ids[:size].copy()
        other[size - 1 - reach] = single[int(kind[other[size - 1 - reach]] == kind[single[0]])]
        assert abs(last(ids[:size]) - last(other)) > 1e-5


def test_training_windows_hold_every_id(spark):
    texts = ["w%d x " % i * n for i, n in enumerate([1, 40, 700])] + [None, "end"]
    got = lm_scoring.gather(spark.createDataFrame([(t,) for t in texts], "text string"), lm_scoring.MODEL).collect()
    w = lm_scoring.Words(lm_scoring.MODEL)
    want = {tuple(w.tokens(w.look_up([(t or "").encode().split()])[0])[0].tolist()) for t in texts}
    found, whole = set(), []
    for r in got:
        if r.kind == 2:
            before, *ids = np.frombuffer(r.ids, lm_scoring.piece_type(w.size)).tolist()
            if before == w.size:
                found.add(tuple(whole))
                whole = []
            else:
                assert before == whole[-1]
            assert 0 < len(ids) <= lm_scoring.WINDOW
            whole += ids
    assert (found | {tuple(whole)}) - {()} == want
    kind = np.arange(w.size) % lm_scoring.CLASSES
    before, now, valid = lm_scoring._windows(lm_scoring.cut(np.arange(40), w.size), kind)
    assert now[valid].tolist() == kind[:40].tolist() and before[valid].tolist() == [lm_scoring.CLASSES, *kind[:39]]


def test_attention_gradient():
    net, r = lm_scoring.Attention(classes=5, width=4, window=6), np.random.default_rng(3)
    before, now, valid = r.integers(0, 6, (3, 6)), r.integers(0, 5, (3, 6)), np.ones((3, 6), bool)
    loss, grad = net.gradient(before, now, valid)
    for k in grad:
        at = tuple(r.integers(0, s) for s in net.p[k].shape)
        net.p[k][at] += 1e-2
        more = net.gradient(before, now, valid)[0]
        net.p[k][at] -= 2e-2
        less = net.gradient(before, now, valid)[0]
        net.p[k][at] += 1e-2
        assert (more - less) / 2e-2 == pytest.approx(grad[k][at], abs=2e-3)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op5_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def test_phrases_are_greedy_longest_matches():
    a = language_id.SuffixAutomaton("abcabd")
    text = "abdabcxxcab"
    want, at = 0, 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in "abcabd":
            size += 1
        at, want = at + max(1, size), want + 1
    assert a.phrases(text) == want


@pytest.mark.parametrize("few", [1, 3, 10**9])
def test_languages_equal_brute_force(spark, monkeypatch, few):
    """Fewest bits of a greedy parse by substring search, over whole texts, words and blanks alike."""
    monkeypatch.setattr(language_id, "FEW", few)
    train = {"de": " der alte fluss ging weiter ", "en": " the old river went on and on ", "th": " \u0e01\u0e33\u0e41\u0e1e\u0e07 "}
    r = random.Random(4)
    texts = [" ".join(r.choices("the der alte old xx went ging river fluss \u0e01\u0e33 12 . on".split(), k=r.randrange(1, 40))) for _ in range(30)]
    texts += [None, "", "\u00bd \u00b2 _ 7", "\u0301", "q", "The OLD river", "der alte fluss ging weiter " * 30]

    def bits(text, known):
        n = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in known:
                size += 1
            at, n = at + size, n + 1
        return n * np.log2(len(known))

    def want(text):
        ws = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()).split()
        ws = [w for w in ws if any(unicodedata.category(c)[0] == "L" for c in w)]
        if not ws:
            return "und", 0.0
        cost = sorted((bits(f" {' '.join(ws)} ", known), lang) for lang, known in train.items())
        return cost[0][1], cost[1][0] / (cost[0][0] + cost[1][0])

    got = language_id.Model(train).predict(texts)
    assert [(x, round(y, 9)) for x, y in got] == [(x, round(y, 9)) for x, y in map(want, texts)]


def test_training_texts_reach_their_bound_with_short_texts_and_texts_without_letters(spark):
    rows = [(i, "12 34", "aa") for i in range(600)] + [(1000 + i, f"wort {i} drei", "aa") for i in range(900)] + [(5000 + i, "." * 3000 + "x", "bb") for i in range(900)]
    got = language_id.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_chars=5000)
    assert 5000 <= len(got["aa"]) < 5020 and len(got["bb"].split()) == 900


def test_training_texts_of_repeated_ids_and_hot_languages(spark):
    rows = [(1, "one text", "en")] * 50 + [(1, "another text", "en")] * 50 + [(i, f"w{'x' * (i % 7)} y", "en") for i in range(2, 900)] + [(None, "none", "en"), (5, None, "en"), (6, "ohne", None)]
    got = language_id.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_chars=4000)
    assert set(got) == {"en"} and got["en"].count("text") <= 1 and 1000 < len(got["en"]) <= 4100 and "none" not in got["en"]


def test_chat_round_trip():
    r = random.Random(1)
    piece = ["#", "###", "\\", "</", "</turn>", "\n", "a", "<", "### a:\n", ":"]
    for _ in range(500):
        turns = [("".join(r.choices(piece, k=r.randrange(4))), "".join(r.choices(piece, k=r.randrange(9)))) for _ in range(r.randrange(5))]
        text, spans = chat.render(turns, trained="a")
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "a"]


def test_reply_trees_rank_branches(spark):
    rows = [("r", None, "t", "user", "q", 0.0), ("a", "r", "t", "assistant", "bad", 0.1), ("b", "r", "t", "assistant", "good", 0.9), ("c", "b", "t", "user", "more", 0.9), ("lone", "gone", "u", "user", "x", 0.0)]
    got = chat.conversations(spark.createDataFrame(rows, "id string, parent string, tree string, role string, text string, score double"), best=2).collect()
    found = {(r.tree, r["rank"]): [t for _, t in chat.parse(r.formatted)] for r in got}
    assert found == {("t", 1): ["q", "good", "more"], ("t", 2): ["q", "bad"], ("u", 1): ["x"]}


def test_nbest_equals_brute_force():
    lat = sentencepiece_nbest.Lattice()

    def every(s, at, score):
        if at == 0:
            return [score]
        return [x for a, _, w in edges[at] for x in every(s, a, score + w)]

    for text in ["hi  to an", "a▁b \n\x00 é", "日本𝄞"]:
        whole = "▁" + text.replace("▁", sentencepiece_nbest._ESCAPED).replace(" ", "▁")
        edges = lat.edges(whole)
        ways = lat.encode(text, 5)
        assert [w for w, _ in ways] == pytest.approx(sorted(every(whole, len(whole), 0.0), reverse=True)[:5])
        assert all(lat.decode(ids) == text for _, ids in ways)
        segments = lat.segments(text)
        ids, start, score, loss = lat.best_all(segments)
        assert [(tuple(ids[start[i] : start[i + 1]]), score[i], loss[i]) for i in range(len(segments))] == [lat.best(s) for s in segments]


def test_nbest_ids_of_the_table_equal_encode(spark):
    texts = ["the grey river went past the mill", "unbelievable  tokens!", "", None, "ab" * 40, "\u2581 odd \U0001f600"]
    got = sentencepiece_nbest.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=4)
    lat = sentencepiece_nbest.lattice(sentencepiece_nbest.MODEL)
    for r in got.withColumn("all", sentencepiece_nbest.nbest_ids()).collect():
        want = lat.encode(texts[r.doc_id], 4)
        assert [list(x) for x in r.all] == [ids for _, ids in want]
        assert all(lat.decode(x) == (texts[r.doc_id] or "") for x in r.all)
        assert np.allclose([0, *r.losses], [want[0][0] - s for s, _ in want])


def test_classifier_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op8_quality_classifier(spark, SF).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)


def test_suffix_array_and_search_of_a_whole_shard():
    r = np.random.default_rng(3)
    part = r.integers(1, 4, 40)
    seq = np.concatenate([x for _ in range(6) for x in (part, r.integers(1, 5, r.integers(0, 9)), [0])])
    index = decontaminate.FMIndex(seq)
    ends = np.flatnonzero(seq == 0)
    suffix = lambda i: [*seq[i : ends[ends >= i][0]].tolist(), -1, int(ends[ends >= i][0])]
    order = sorted(range(len(seq)), key=lambda i: [(0, x, 0) if x < 0 else (1, x, 0) for x in suffix(i)[:-1]] + [(2, suffix(i)[-1], 0)])
    assert decontaminate.FMIndex.suffixes(seq).tolist() == order
    for n in (1, 2, 3, 7, 40):
        for i in range(0, len(seq) - n, 5):
            word = seq[i : i + n]
            if (word > 0).all():
                lo, hi = index.search(word[None], np.array([n]))
                want = [j for j in range(len(seq) - n + 1) if (seq[j : j + n] == word).all()]
                assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def brute_hits(ws, items, window=13):
    hit, found = set(), set()
    for name, iw in items:
        k = min(window, len(iw))
        for j in range(len(iw) - k + 1 if k else 0):
            for i in range(len(ws) - k + 1):
                if ws[i : i + k] == iw[j : j + k]:
                    hit |= set(range(i, i + k))
                    found.add(name)
    return hit, found


@pytest.mark.parametrize("letters", [1, 2, 5, 4000])
def test_short_shards_equal_brute_force(letters):
    r = random.Random(letters)
    word = lambda: b"w%d" % r.randrange(letters)
    for n in range(1, 71):
        doc = [word() for _ in range(n)]
        items = [("a", doc[: r.choice([1, 2, 14])]), ("b", [word() for _ in range(3)]), ("c", doc[-20:])]
        for docs in ([doc], [[], doc, []], [doc[:1], doc]):
            for ws, (spans, found) in zip(docs, decontaminate.scan_shard(decontaminate.Patterns(items, 13), docs)):
                hit, names = brute_hits(ws, items)
                assert ({i for a, b in spans for i in range(a, b)}, found) == (hit, names), (n, docs)


def test_documents_alone_in_their_partitions(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 4))) for i in range(12)], "doc_id long, text string").repartition(12, "doc_id")
    items = spark.createDataFrame([(1, "W1"), (2, "w0 w1 w2")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.report(decontaminate.spans(docs, items)).collect()}
    assert got == {i: ((0, 0), (0, 0), (1, 1), (3, 2))[i % 4] for i in range(12)}


@pytest.mark.parametrize("block_words", [30, 10**6])
def test_decontamination_equals_brute_force(spark, block_words):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(12)}"
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 13, 20])))) for i in range(8)] + [(8, "")]
    docs = []
    for i in range(40):
        ws = [word() for _ in range(r.randrange(60))]
        if i % 2:
            at = r.randrange(len(ws) + 1)
            ws[at:at] = items[i % 8][1].upper().split()
        docs.append((i, ", ".join(ws)))
    got = decontaminate.spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    for row in got:
        ws = decontaminate.words(dict(docs)[row.doc_id].encode())
        hit, found = brute_hits(ws, [(str(i), decontaminate.words(t.encode())) for i, t in items])
        assert (row.n_words, row.n_hit, sorted(row["items"])) == (len(ws), len(hit), sorted(found))
    assert decontaminate.remove_spans("A b, C d!", [(1, 3)]) == "A  d!"


def warc_brute(pages):
    import base64
    import hashlib

    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in pages:
        data, f = (h or "").encode(), first.get(h or "")
        again = i is not None and i > f
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("chunk", [16, 1 << 18])
def test_warc_round_trip(spark, tmp_path, chunk):
    mark = "WARC/1.1\r\nWARC-Type: x\r\n\r\né" * 9
    pages = [(1, "http://a", "x" * 50), (2, None, "x" * 50), (3, "http://c/WARC/1.html", mark), (3, "http://c", mark), (4, "http://d", None), (None, "http://e", "y"), (7, "u", "long ü " * 9000), (8, "u", "long ü " * 9000)]
    # one id with several payloads, of which some are copies
    pages += [(11, "u", "XX"), (12, "u", "YY"), (13, "u", "XX"), (13, "u", "YY"), (21, "u", "ZZ"), (23, "u", "ZZ"), (23, "u", "WWWWW")]
    df = spark.createDataFrame([(*p, "n", 0) for p in pages], "page_id long, url string, html string, record string, chunk int")
    got = warc.archive(df, chunk=chunk, path=str(tmp_path / "w")).collect()
    assert sorted(repr(tuple(r)) for r in got) == warc_brute(pages)
    read = warc.read_warc(spark, str(tmp_path / "w")).where("record_type = 'response'").select("record").collect()
    assert len(read) == len(set(read)) == sum("'response'" in x for x in warc_brute(pages))


def test_warc_of_others_and_damage(spark, tmp_path):
    import gzip

    record = lambda v, head, block: f"WARC/{v}\r\n{head}Content-Length:{len(block)}\r\n\r\n{block}\r\n\r\n".encode()
    http = "HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    with open(tmp_path / "x.warc.gz", "wb") as f:
        f.write(gzip.compress(record("1.0", "WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\n", "a: b")))
        f.write(gzip.compress(record("1.0", "WARC-Type: response\r\nWARC-Record-ID:<urn:uuid:1>\r\nContent-Type: application/http;msgtype=response\r\n", http + "tells of WARC/1.1\r\n\r\nfiles")))
        f.write(gzip.compress(record("1.1", "WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: text/plain\r\n", "plain")))
    rows = warc.read_warc(spark, str(tmp_path / "x.warc.gz"))
    assert sorted((r.record, r.page_id, bytes(r.data)) for r in rows.collect()) == [("urn:uuid:1", None, b"tells of WARC/1.1\r\n\r\nfiles"), ("urn:uuid:2", None, b"plain")]
    assert sorted(r.payload_bytes for r in warc.verify(rows).collect()) == [5, 26]
    df = spark.createDataFrame([(1, "u", "abcdefgh" * 9)], "page_id long, url string, payload string")
    warc.write_warc(df, str(tmp_path / "d"), chunk=16)
    with pytest.raises(Exception, match="missing or damaged"):
        warc.verify(warc.read_warc(spark, str(tmp_path / "d")).where("chunk <> 2")).collect()


def test_licenses(spark):
    docs = [(1, "prose\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, "This work is licensed under the GNU General Public\nLicense, version 3."), (4, "a license to walk"), (5, "Licensed under the Apache License, Version 2.0.")]
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "MIT"), (2, "CC-BY-NC-4.0"), (3, "GPL-3.0"), (5, "Apache-2.0")}


def test_every_license_notice_of_a_line(spark):
    prose = lambda n: "so the grey river went on past the mill and over the hill " * n
    notice = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "CC-BY-4.0": "Licensed under CC BY 4.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.", "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3."}
    changed = "This work is licensed under the GNU Affero General Public Licence, version 3."
    docs = [(1, prose(30) + notice["Apache-2.0"] + " " + prose(40)), (2, (" " + prose(2)).join(notice.values())), (3, notice["MIT"] + " " + changed), (4, notice["MIT"] + "\nThis work is licensed under the GNU General Public\nLicense, version 2.")]
    docs += [(5, notice["MIT"] + " or " + notice["MIT"]), (6, "apache license " + prose(3) + "version 2.0")]
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.line, r.license) for r in got) == sorted([(1, 0, "Apache-2.0"), *((2, 0, x) for x in notice), (3, 0, "AGPL-3.0"), (3, 0, "MIT"), (4, 0, "MIT"), (4, 1, "GPL-2.0"), (5, 0, "MIT"), (5, 0, "MIT")])
    assert all(r.missing + r.between == (r.license == "AGPL-3.0") * 2 for r in got)


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on all that the one before kept, with null ids, repeated ids and clashing columns among the documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    long = next(t for _, t in rows if t and len(t.split()) > 120 and t.split("\n")[0])
    more = [(None, long), (None, long + " end"), (7_000_001, long.upper()), (7_000_001, long.upper()), (7_000_002, None), (None, "")]
    names = ["_s", "kept", "n_words", "n_hit", "items", "spans", "row", "x", "f1", "rep", "cell"]
    kind = "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame([(*r, *("mine" for _ in names)) for r in rows + more], kind)
    docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stages")
    docs, kept = spark.read.parquet(path), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{i}-{random.random()}")
        after = [tuple(r) for r in spark.read.parquet(path).collect()]
        kept[name] = before, after
        assert all(r[2:] == ("mine",) * len(names) for r in after) and set(after) <= set(before)
        docs = spark.read.parquet(path)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = kept["quality rules"]
    stats = quality_rules.judge(spark.createDataFrame([r[:2] for r in before], "doc_id long, text string"), quality_rules.fit(spark.createDataFrame([r[:2] for r in before], "doc_id long, text string"), labels))
    assert sorted(repr(r[:2]) for r in after) == sorted(repr((r.doc_id, r.text)) for r in stats.where("kept").collect())
    before, after = kept["quality classifier"]
    quality = [(r.doc_id, r.quality) for r in labels.collect() if r.quality is not None]
    of = {}
    for r in before:
        of.setdefault(r[0], []).append(quality_classifier.statistics((r[1] or "").encode()))
    x = spark.createDataFrame([(q, v) for i, q in quality if i is not None for v in of.get(i, [])], "quality int, x array<double>")
    score = quality_classifier.fit(x).score(np.array([quality_classifier.statistics((r[1] or "").encode()) for r in before]))
    assert sorted(map(repr, after)) == sorted(repr(r) for r, s in zip(before, score) if s >= 0.3)
    before, after = kept["n-gram Jaccard join"]
    sets = [shingles(r[1], 5) for r in before]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(before)), key=lambda i: (before[i][0] is None, before[i][0] or 0))
    place = {i: n for n, i in enumerate(order)}
    for a, b in itertools.combinations(order, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)), key=place.get)
            root[y] = x
    want = [before[find(i)] for i in range(len(before)) if find(i) == i]
    assert sorted(map(repr, after)) == sorted(map(repr, want)) and len(after) < len(before)
    before, after = kept["benchmark decontamination"]
    items = [decontaminate.words((r.text or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in items if w for i in range(max(1, len(w) - 12))}

    def clean(text):
        ws, hit = decontaminate.words((text or "").encode()), set()
        for n in {len(w) for w in windows}:
            hit |= {i + j for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows for j in range(n)}
        return not (hit and 20 * len(hit) >= len(ws))

    assert sorted(map(repr, after)) == sorted(repr(r) for r in before if clean(r[1]))
    got = corpus_pipeline.to_pieces(spark, docs, SF).collect()
    assert len(got) == len(after) and all(r.lossless for r in got)


def test_pivots_place_the_documents_of_a_table(spark):
    """At default settings, regions of three sets or more are divided by pivots."""
    sets = list({x.tobytes(): x for _, t in near_copies(11, groups=12, copies=9) for x in [jaccard_join.shingle_set(t.encode().split(), 4)]}.values())
    seen: dict = {}
    x, y = jaccard_join.voronoi_links(sets, np.arange(len(sets)), 85, 100, seen)
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 185 * len(np.intersect1d(a, b)) >= 85 * (len(a) + len(b))}
    assert set(zip(x.tolist(), y.tolist())) == want and len(x) == len(want)
    assert seen["placed"] >= len(sets)


def test_null_ids_link_and_bridge(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join("zz" if i in at else w for i, w in enumerate(base))
    # 1 and the null row link, the null row and 9 link, 1 and 9 don't
    rows = [(1, near()), (None, near(0, 59)), (9, near(0, 59, 1)), (None, "one two three"), (None, "one two three"), (4, "other words")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=91, den=100).collect()
    link = lambda x, y: 191 * len(x & y) >= 91 * (len(x) + len(y))
    sets = [shingles(t, 4) for _, t in rows]
    assert link(sets[0], sets[1]) and link(sets[1], sets[2]) and not link(sets[0], sets[2])
    assert sorted(repr((r.doc_id, r.component_id, r.n_links)) for r in got) == sorted(map(repr, [(1, 1, 1), (None, 1, 2), (9, 1, 1), (None, None, 1), (None, None, 1), (4, 4, 0)]))
