"""The training-text operators against brute force, round trips and odd inputs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill import session
from proofmill.llm import encoding, frequency, leakage, neardup, overlap, packing, pieces, queries, sentences, splits
from proofmill.llm.words import words

VOCABULARY = [f"w{i}" for i in range(400)]


def made(n, seed=1, size=60):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(VOCABULARY, size)) for _ in range(n)]


def runs(t, k=3):
    w = words(t or "")
    return set(zip(*(w[i:] for i in range(k))))


def frame(spark, texts, split=None):
    rows = [(i, t, (split or ["train"])[i % len(split or ["train"])], "x") for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "labeled_id bigint, text string, split_name string, rep string")  # a clashing extra column


@pytest.fixture(scope="module")
def near(spark):
    base = made(12)
    rng = np.random.default_rng(5)
    out = list(base)
    for t in base:
        for edits in (1, 2, 4, 9):
            w = t.split()
            for k in rng.integers(0, len(w), edits):
                w[k] = "edit"
            out.append(" ".join(w))
    out += [base[0], base[0].upper(), None, "", "   ", "one two", "w1 " * 5000]
    return out


def test_near_duplicates_against_brute_force(spark, near):
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(frame(spark, near), "labeled_id", "text", 0.7, 3).collect()}
    sets = {i: runs(t) for i, t in enumerate(near, 1)}
    want = {(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    assert got == want
    groups = {r.id: (r.group_id, r.n_links, r.n_copies) for r in neardup.near_duplicate_groups(frame(spark, near), "labeled_id", "text", 0.7, 3).collect()}
    assert set(groups) == set(sets) and all(groups[i][0] == groups[j][0] for i, j in want)
    assert groups[1][2] == 2


def test_overlaps_against_brute_force(spark, near):
    d = frame(spark, near, ["train", "dev", "train", "test", None])
    got = {(r.held_id, r.train_id) for r in overlap.cross_split_overlaps(d, "labeled_id", "text", "split_name").collect()}
    split = {r.labeled_id: r.split_name for r in d.collect()}
    sets = {i: runs(t) for i, t in enumerate(near, 1)}
    want = {(i, j) for i in sets for j in sets if split[i] in ("dev", "test") and split[j] == "train" and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i])}
    assert got == want and want


def test_overlaps_that_chunks_do_not_meet(spark):
    rng = np.random.default_rng(11)
    train = made(150, 12, 40)
    held = [" ".join(t.split()[k : k + 7]) for t in train for k in rng.integers(1, 32, 2).tolist()]
    for t in train:  # the end of a passage changed: 4 runs of 5 are left
        w = t.split()[10:17]
        held.append(" ".join([*w[:-1], "edit"]))
    texts = train + held
    d = spark.createDataFrame([(i, t, "train" if i < len(train) else "test") for i, t in enumerate(texts)], "labeled_id bigint, text string, split_name string")
    got = {(r.held_id, r.train_id) for r in overlap.cross_split_overlaps(d, "labeled_id", "text", "split_name").collect()}
    sets = [runs(t) for t in texts]
    want = {(i, j) for i in range(len(train), len(texts)) for j in range(len(train)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i])}
    assert got == want and len(want) >= len(held)


def test_overlaps_need_little_disk(spark, tmp_path):
    d = frame(spark, [*made(3000, 21, 150), "w1 " * 40], ["train", "dev", "train", "test"])
    d.select("labeled_id", "text", "split_name").write.parquet(f"{tmp_path}/in")
    size = lambda top: sum(os.path.getsize(os.path.join(a, f)) for a, _, names in os.walk(top) for f in names if f.endswith(".parquet"))

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite() + size(session.shared_dir(spark).removeprefix("file:"))

    before, d = written(), spark.read.parquet(f"{tmp_path}/in")
    assert overlap.cross_split_overlaps(d, "labeled_id", "text", "split_name").count() == 0
    assert written() - before < 6 * size(tmp_path)
    assert overlap.cross_split_overlaps(d.limit(0), "labeled_id", "text", "split_name").count() == 0


def test_leaks_against_brute_force(spark):
    docs, items = made(30, 3, 120), made(8, 4, 40)
    docs += [docs[0] + " " + items[0].upper() + " x", " ".join(items[1].split()[5:19]), " ".join(items[1].split()[5:16]), None, "", items[2] * 2]
    d = spark.createDataFrame(list(enumerate(docs, 1)), "doc_id bigint, text string")
    e = spark.createDataFrame([*enumerate(items, 1), (99, None), (98, "short")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, e).collect()}
    want = {(i, j) for i, t in enumerate(docs, 1) for j, x in enumerate(items, 1) if runs(t, 12) & runs(x, 12)}
    assert got == want and len(want) == 3
    span = leakage.leaked_spans(d, e).where("doc_id = 31").first()
    assert docs[30][span.span_start : span.span_end] == items[0].upper()
    assert leakage.leaked_items(d.limit(0), e).count() == 0 and leakage.leaked_items(d, e.limit(0)).count() == 0


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 400).astype(np.int32)
    index = leakage.FMIndex(text, 4)
    phrases = rng.integers(0, 4, (40, 4)).astype(np.int32)
    live, lo, hi = index.search(phrases)
    found = {(int(p), int(x)) for p, a, b in zip(live, lo, hi) for x in index.locate(np.arange(a, b))}
    assert found == {(p, i) for p in range(40) for i in range(len(text) - 3) if (text[i : i + 4] == phrases[p]).all()}


def test_suffix_array_of_repetitions():
    for text in (np.zeros(50, np.int64), np.tile([1, 2, 3], 20), np.array([3])):
        t = np.append(text + 1, 0)
        assert leakage.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_pieces_round_trip(spark):
    long = "\n\n".join("Sentence number %d ends here. And more follows." % i for i in range(200))
    rows = [
        (1, long, ["B-a", "I-a"] + ["O"] * (len(long) - 2), [(0, 2, "a"), (2395, 2405, "b"), (10**6, 10**6 + 3, "c")]),
        (2, "x" * 5000, None, None), (3, None, None, None), (4, "", [], []), (5, "short", ["O"], [(3, 1, "q")]), (6, "y" * 2400, None, None),
    ]
    d = spark.createDataFrame(rows, "labeled_id bigint, text string, bio_tags array<string>, spans array<struct<span_start:int,span_end:int,rule_id:string>>")
    got = pieces.cut_pieces(d).orderBy("labeled_id", "piece_no").collect()
    for i, text in ((1, long), (2, "x" * 5000)):
        p = [r for r in got if r.labeled_id == i]
        assert all(len(r.text) <= 2400 and r.text == text[r.piece_start : r.piece_end] for r in p)
        assert all(b.piece_start == a.piece_end - 200 for a, b in zip(p, p[1:])) and p[0].piece_start == 0 and p[-1].piece_end == len(text)
    assert {r.cut_at for r in got if r.labeled_id == 1} == {"paragraph", "end"}
    assert sum(len([s for s in r.spans if s.rule_id == "b"]) for r in got if r.labeled_id == 1) >= 1
    assert [r.n_pieces for r in got if r.labeled_id > 2] == [1, 1, 1, 1]
    assert {(r.labeled_id, r.kind) for r in pieces.oversized(d).collect()} == {(1, "oversized"), (2, "oversized"), (2, "long_run")}
    assert pieces.cut_pieces(d.limit(0)).count() == 0


def test_oversized_cuts_tags_and_spans_too(spark, monkeypatch):
    given = []
    whole = pieces.cut_pieces
    monkeypatch.setattr(pieces, "cut_pieces", lambda *a, **k: given.append(whole(*a, **k)) or given[-1])
    d = spark.createDataFrame([(1, "word " * 1000, ["B-a"] + ["I-a"] * 4999, [(2300, 2500, "a")])], "labeled_id bigint, text string, bio_tags array<string>, spans array<struct<span_start:int,span_end:int,rule_id:string>>")
    assert [tuple(r) for r in pieces.oversized(d).collect()] == [(1, "oversized")]
    got = given[0].orderBy("piece_no").collect()
    assert len(got) > 1 and all(len(r.bio_tags) == r.piece_end - r.piece_start and r.bio_tags[0] == "B-a" for r in got)
    assert any(r.spans for r in got)


def test_term_frequencies_divide_and_agree(spark):
    rows = [("hot" if i % 3 else f"t{i % 40}", None if i % 11 == 0 else f"f{i % 90}") for i in range(3000)] + [(None, "f1"), ("", "f2")]
    d = spark.createDataFrame(rows, "term string, file string")
    want = {}
    for t, f in rows:
        if t is not None:
            n, files = want.setdefault(t, [0, set()])
            want[t][0] += 1
            files.update([f] if f else [])
    for most in (2_000_000, 20):
        got = {r.term: (r.n_rows, r.n_files) for r in frequency.term_frequencies(d, {"term": F.col("term")}, F.col("file"), most=most).collect()}
        assert got == {k: (n, len(f)) for k, (n, f) in want.items()}
    assert frequency.term_frequencies(d.limit(0), {"term": F.col("term")}, F.col("file")).count() == 0


def test_allocation_meets_quotas():
    for bundles in ([(1, 1000)], [(3, 40), (2, 17), (1, 5)], [(500, 1), (30, 3), (1, 200)], []):
        shares = [0.7, 0.15, 0.15]
        flow = splits.allocate(bundles, shares)
        assert all(sum(f) == k for f, (_, k) in zip(flow, bundles))
        if bundles and max(s for s, _ in bundles) < 10:
            total = sum(s * k for s, k in bundles)
            for j, x in enumerate(shares):
                assert abs(sum(s * f[j] for f, (s, _) in zip(flow, bundles)) - x * total) <= max(s for s, _ in bundles)


def test_flow_of_least_cost_against_brute_force():
    import itertools

    rng = np.random.default_rng(3)
    shares = [0.7, 0.15, 0.15]

    def cost(bundles, flow):
        total = sum(s * k for s, k in bundles)
        quota = sum(max(0.0, sum(s * f[j] for (s, _), f in zip(bundles, flow)) - total * x) for j, x in enumerate(shares))
        return splits.QUOTA_COST * quota + splits.BUNDLE_COST * sum(s * max(0.0, f[j] - k * x) for (s, k), f in zip(bundles, flow) for j, x in enumerate(shares))

    ways = lambda k: [(a, b, k - a - b) for a in range(k + 1) for b in range(k + 1 - a)]
    for _ in range(60):
        # bundles of one size are one flow, whose optimum is whole
        size, numbers = int(rng.integers(1, 9)), rng.integers(1, 6, int(rng.integers(1, 4))).tolist()
        same = [(size, k) for k in numbers]
        least = min(cost(same, f) for f in itertools.product(*map(ways, numbers)))
        assert cost(same, splits.allocate(same, shares)) <= least + 1e-6
    worse = 0
    for _ in range(60):
        mixed = [(int(s), int(k)) for s, k in zip(rng.choice(np.arange(1, 40), 4, replace=False), rng.integers(1, 4, 4))]
        least = min(cost(mixed, f) for f in itertools.product(*(ways(k) for _, k in mixed)))
        got = cost(mixed, splits.allocate(mixed, shares))
        worse += got > least + 1e-6
        assert got <= 2 * least + 1e-6
    assert worse <= 20
    # only a swap gets the quotas right
    flow = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    bundles, room = [(7, 1), (5, 1), (4, 1)], [-2.0, 2.0, 0.0]
    assert splits._exchange(bundles, shares, flow, room) and min(room) > -2


def test_grouped_splits_cover_every_group(spark):
    d = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 300).cast("string")).alias("k"), F.when(F.col("id") % 2 == 0, "train").otherwise("dev").alias("s"), (F.col("id") % 5 == 0).alias("p"))
    g = splits.group_profiles(d, F.col("k"), F.col("s"), F.col("p"))
    out = splits.grouped_splits(g).collect()
    assert len({r.entity_key for r in out}) == len(out) == g.count() and sum(r.n_rows for r in out) == 2000
    assert {r.entity_key for r in splits.broken_groups(g).collect()} == {r.entity_key for r in g.collect() if r.n_splits > 1}
    assert splits.grouped_splits(g.limit(0)).count() == 0


def test_broken_groups_come_from_the_allocation(spark, monkeypatch, tmp_path):
    labeled = [(f"f{i % 20}", "dev" if i == 0 else "train", ["r"]) for i in range(60)]
    rules = [(f"r{i % 9}", 1 if i == 3 else 0, 1) for i in range(40)] + [(None, 0, 0)]
    spark.createDataFrame(labeled, "file string, split_name string, rule_ids array<string>").write.parquet(f"{tmp_path}/labeled_documents.parquet")
    spark.createDataFrame(rules, "rule_id string, rule_fold int, label int").write.parquet(f"{tmp_path}/candidates.parquet")
    placed = []
    grouped = splits.grouped_splits
    monkeypatch.setattr(splits, "grouped_splits", lambda *a, **k: placed.append(grouped(*a, **k)) or placed[-1])
    got = {tuple(r) for r in queries.p6_found(spark, str(tmp_path)).collect()}
    assert got == {("file", "f0"), ("rule", "R3")}
    assert [x.count() for x in placed] == [20, 9]


def test_packing(spark):
    pytest.importorskip("tiktoken")
    texts = [t for t in made(300, 8, 200)] + [" ".join(made(1, 9, 3000)), None, "", "  \n a\n% note\nb", "日本語の文。"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = packing.pack_documents(d, segments=5).collect()
    count = packing.counter()
    for i, t in enumerate(texts):
        n = len(count.encode(t)) if t else 0
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece_no)
        assert sum(r.n_tokens for r in mine) == n and (n > 2048 or len(mine) == 1) and (n > 0) == (mine[0].container_id is not None)
    fill = {}
    for r in got:
        if r.container_id is not None:
            a = fill.setdefault(r.container_id, [0, 0])
            a[0] += r.n_tokens
            a[1] += 1
    assert max(a for a, _ in fill.values()) <= 2048 and max(b for _, b in fill.values()) <= 5
    assert packing.pack_documents(d.limit(0)).count() == 0


def test_packing_is_tight():
    rng = np.random.default_rng(1)
    sizes = np.stack([t := rng.integers(1, 900, 4000), np.ones(4000, int), t], axis=1)
    boxes = packing.pack_vectors(sizes, (2048, 64, 2048))
    assert np.bincount(boxes, weights=sizes[:, 0]).max() <= 2048
    assert boxes.max() + 1 <= -(-sizes[:, 0].sum() // 2048) * 1.01 + 1


def test_encodings(spark):
    clean = ["Für schmale Seiten prüft die Größe", "L'épreuve réduit la théorie déjà élargie", "Шрифт второго издания меняет абзац", "załącznik strony tytułowej wyrównuje spis", "a “quoted” word — naïve"] * 60
    bad = [clean[0].encode().decode("latin-1"), clean[1].encode().decode("cp1252", "replace"), clean[1].encode().decode("mac_roman"), clean[2].encode("cp1251").decode("latin-1"), clean[0].encode().decode("latin-1").encode().decode("latin-1"), "ein �bel"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(clean + bad + [None, "", "ascii only"])], "labeled_id bigint, text string")
    model = encoding.train(d.select("text"))
    got = {r.record_id: r.restored for r in encoding.garbled_texts(d, "labeled_id", "text", model).collect()}
    assert set(got) == set(range(len(clean), len(clean) + len(bad)))
    assert got[len(clean)] == clean[0] and got[len(clean) + 2] == clean[1] and got[len(clean) + 3] == clean[2] and got[len(clean) + 4] == clean[0]
    windows = [list(clean[0].encode()[:30]) + [0] * 9, list("Größe prüft".encode("latin-1")), list(clean[2].encode()[1:40]), [], None, list(bad[0].encode())]
    b = spark.createDataFrame(list(enumerate(windows)), "candidate_id bigint, bytes array<int>")
    assert {r.record_id for r in encoding.garbled_bytes(b, "candidate_id", "bytes", model).collect()} == {1, 5}


def test_garbled_words_that_the_corpus_repeats(spark):
    clean = ["błąd książki porządkuje rozdział", "Größe prüft Änderung", "раздел сборника меняет абзац"] * 700
    polish, russian = "błąd rozdział".encode("iso8859-2").decode("latin-1"), "сборника".encode("koi8-r").decode("cp1251")
    texts = clean + [polish, russian] * 2
    d = spark.createDataFrame(list(enumerate(texts)), "labeled_id bigint, text string")
    model = encoding.train(d.select("text"))
    got = {r.record_id: r.restored for r in encoding.garbled_texts(d, "labeled_id", "text", model).collect()}
    n = len(clean)
    assert got == {n: "błąd rozdział", n + 1: "сборника", n + 2: "błąd rozdział", n + 3: "сборника"}
    assert model.margin == encoding.MARGIN and not any("³" in g for g in model.counts)


def test_fragments_at_the_edges_of_windows(spark):
    clean = ["Für schmale Seiten prüft die Größe", "L'épreuve réduit la théorie déjà élargie — « là »", "Шрифт второго издания меняет абзац с полем", "正文的章节数算了索引，公式的标题。"] * 300
    bad = [t.encode().decode("latin-1") for t in clean[:4]] * 3
    d = spark.createDataFrame(list(enumerate(clean + bad)), "labeled_id bigint, text string")
    judge = encoding.Judge(encoding.train(d.select("text")))
    window = lambda b: encoding.judge_bytes(judge, b)
    cut = clean[2].encode()
    # words cut to a letter or two are no case, wherever the window begins and ends, within a character too
    assert not any(window(cut[a:b])[0] for a in range(0, 40) for b in range(a + 24, len(cut)))
    assert not any(window(x[:k])[0] for x in (clean[0].encode(), clean[1].encode()) for k in range(4, len(x)))
    # a wrongly read sequence of which the window shows a part
    assert window("ludrim prÃ".encode())[0] and window("©duit la ludrim".encode())[0] and not window("réduit la".encode())[0]
    # the last byte is a letter of a one-byte encoding, not the first of an ideograph
    assert window("déjà thé".encode("utf-8")[:-2] + b"\xe9")[0] and not window("，公式的标".encode()[:-2])[0]
    part = clean[3].encode("gbk").decode("latin-1")
    assert window(part[1:].encode())[0] and judge.text("正文的" + part[6:])[1].endswith("算了索引，公式的标题。")


def test_floor_and_margin_come_from_every_clean_word(spark):
    # 9 of 6,000 words look like another reading, the last in the order of hashes; one in a thousand sets the margin
    rng = np.random.default_rng(4)
    other = spark.range(400).select(F.concat(F.lit("zzÃ©"), F.translate(F.col("id").cast("string"), "0123456789", "ghijklmnop")).alias("w"))
    given = ["é" + "".join(rng.choice(list("abcdefgh"), 9)) for _ in range(5991)] + [r.w for r in other.orderBy(F.xxhash64("w").desc()).limit(9).collect()]
    model = encoding.CharModel({"a": 50, "é": 40, "z": 20, "b": 30}, floor=-1.0)
    scores = {w: model.score(w) for w in given}
    floor = min(-1.0, float(np.quantile([scores[w] / (len(w) + 1) for w in given], 0.001)))
    bare = encoding.CharModel(model.counts, floor=floor)
    gains = [max(-1e9, max((x for x, _, _ in bare.options(w)), default=-np.inf) - scores[w]) for w in given]
    got = encoding.validated(model, spark.createDataFrame([(w, 1) for w in given], "word string, n bigint"))
    assert got.floor == pytest.approx(floor) and got.margin == pytest.approx(max(encoding.MARGIN, float(np.quantile(gains, 0.999))))
    assert got.margin > encoding.MARGIN
    empty = encoding.validated(encoding.CharModel({}), spark.createDataFrame([], "word string, n bigint"))
    assert (empty.floor, empty.margin) == (-6.0, encoding.MARGIN)


def test_ngrams_of_long_words(spark):
    long = "".join(chr(0x4E00 + i * 7 % 900) for i in range(1237))
    given = {long: 2, "Größe": 3, "é": 1, "é" + "x" * 396: 5}
    want = {}
    for w, n in given.items():
        s = "\x02" * 3 + w + "\x03"
        for g in (s[i : i + k] for k in range(1, 5) for i in range(len(s) - k + 1)):
            want[g] = want.get(g, 0) + n
    got = encoding._ngrams(spark.createDataFrame(list(given.items()), "word string, n bigint")).collect()
    assert {r.gram: r.n for r in got} == want
    texts = spark.createDataFrame([(long,), ("Größe prüft",)], "text string")
    assert long[600:604] in encoding.train(texts).counts


def test_sentence_model_counts_the_whole_corpus(spark):
    word = F.when(F.col("id") % 400 < 30, F.concat(F.lit("abbr"), F.translate((F.col("id") % 400).cast("string"), "0123456789", "abcdefghij"))).otherwise("end")
    d = spark.range(60_000).where("id % 400 >= 30 or id < 1600").select(F.col("id").alias("doc_id"), F.concat(F.lit("See "), word, F.lit(". more here.")).alias("text"))
    model = sentences.train(d)
    assert sum(k.startswith("abbr") for k in model.before) == 30  # four documents each


def test_sentences(spark):
    text = "\\section{No. 3}\nThe first one ends here. See Dr. Abel etc. The last (it is). Why? “Stop!” said he. (A whole one.)\n% note. Not prose!\n\\begin{equation}\nx = 1. y\n\\end{equation}\n\\begin{itemize}\n  \\item One thing.\n  \\item Two\nlines.\n\\end{itemize}\n第一句。第二句！\n\nประโยคหนึ่ง ประโยคสอง\n"
    corpus = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(corpus):
        pytest.skip("no corpus to train on")
    model = sentences.train(spark.read.parquet(corpus))
    d = spark.createDataFrame([(i, t) for i, t in enumerate([text, None, "", "  \n", "\ufeff"])], "doc_id bigint, text string")
    got = sorted((r.sent_start, r.sent_end) for r in sentences.split_sentences(d, model).where("doc_id = 0").collect())
    said = [text[a:b] for a, b in got]
    assert said == ["The first one ends here.", "See Dr. Abel etc.", "The last (it is).", "Why?", "“Stop!” said he.", "(A whole one.)", "One thing.", "Two\nlines.", "第一句。", "第二句！", "ประโยคหนึ่ง", "ประโยคสอง"]
    assert sentences.split_sentences(d.where("doc_id > 0"), model).count() == 0
