"""The training-data operators against plain versions, and on odd rows."""

from __future__ import annotations

import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lattica.llm import queries as q
from lattica.llm.common import slices
from lattica.llm.components import connected_components
from lattica.llm.decontaminate import find_leaks
from lattica.llm.fst import Transducer, _class_table, transducer
from lattica.llm.html_extract import attributes, extract, features, main_text, parse
from lattica.llm.jaccard import jaccard_components
from lattica.llm.labelled_pages import labelled_pages, trained_model
from lattica.llm.langid import BiGru, fit_languages, predict_languages
from lattica.llm.merges import MergeMachine, load
from lattica.llm.packing import pack
from lattica.llm.sharding import histogram_shards
from lattica.llm.token_count import count_tokens
from lattica.llm.topk import exact_top_k, quantise, usable
from lattica.llm.toxicity import Lexicon, fit_toxicity, foldings, score_toxicity
from lattica.llm.warc import audit, layout

SF = "/root/testdata/sf0.001"
LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = "doc_id long, text string, lang string, part int, n string, open string, `row` string, shift string, cell string"


def odd(spark, rows):
    """A documents-like table with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, 1, "n", "o", "r", "s", "c") for i, t, lang in rows], ODD)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été"]) for _ in range(60_000))
    return odd(spark, [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "One two three.", "en"), (4, "One two three.", "en"), (5, "one TWO three.", None),
                       (6, long, "fr"), (7, long + " tail", "fr"), (8, "<|endoftext|> it's ÉTÉ 12 ''s", "fr"), (9, "你好 世界 Straße", "de"), (10, "!!! 123", "en")])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, none):
    got = sorted(map(tuple, count_tokens(docs).collect()))
    want = sorted((r.doc_id, len((r.text or "").encode()), len(ids_of(r.text))) for r in docs.collect())
    assert got == want
    assert count_tokens(none).count() == 0


def test_token_counts_random_strings(spark):
    rng, alphabet = random.Random(2), "abstmdrvle''' \t\n129!?.éßΣİ你ñ́̇\x00\x1c\xa0😀Ⅷ_-"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))) for i in range(2000)]
    got = {r.doc_id: r.n_tokens for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: len(ids_of(t)) for i, t in rows}


def check_packing(pieces, texts, size=4096):
    p = pd.DataFrame([r.asDict() for r in pieces])
    assert (p.groupby("sequence_id").length.sum() <= size).all()
    p = p.sort_values(["sequence_id", "offset"])
    assert ((p.groupby("sequence_id").length.cumsum() - p.length) == p.offset).all()
    for i, t in texts.items():
        ids = np.array([*ids_of(t), 2], "<i4")
        own = p[p.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids)
        assert (own.doc_tokens == len(ids)).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
    return p


def test_packing(docs, none):
    single = docs.dropDuplicates(["doc_id"])
    check_packing(pack(single).collect(), {r.doc_id: r.text for r in single.collect()})
    assert pack(none).count() == 0
    assert pack(docs).where("doc_id = 4").count() == 2


def test_packing_query_has_little_padding(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    p = check_packing(q.op2_packing(spark, SF).collect(), {r.doc_id: r.text for r in d.collect()})
    used = p.groupby("sequence_id").length.sum()
    assert used.sum() / (4096 * len(used)) > 0.9


def test_topk_query_matches_brute_force(spark):
    pdf = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    v = np.stack([np.floor(256 * np.asarray(x, float)) for x in pdf.embedding]).astype(int)
    ids, want = pdf.vec_id.to_numpy(), []
    for i in np.flatnonzero(ids % 50 == 0):
        s = v @ v[i]
        best = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != i)[:5]
        want += [(ids[i], r + 1, b[1], -b[0]) for r, b in enumerate(best)]
    assert sorted(map(tuple, q.op3_exact_topk(spark, SF).collect())) == sorted(want)


def test_topk_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [3.0]), (8, [9e17, 9e17])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = df.where(usable(df.embedding)).select("vec_id", quantise(df.embedding, 1).alias("vec"))
    got = sorted(map(tuple, exact_top_k(v.where("vec_id = 0"), v, k=2, block_bytes=16, shard_rows=2, fan_in=2).collect()))
    assert got == [(0, 1, 8, 900000000000000000), (0, 2, 1, 1)]
    assert exact_top_k(v.where("false"), v).count() == 0
    assert exact_top_k(v.where("vec_id = 7"), v).count() == 0


def check_shards(rows, n=16, even=0.03):
    p = pd.DataFrame([r.asDict() for r in rows])
    for _, own in p.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sizes = p.groupby("shard")["size"].sum()
    assert len(sizes) == n and sizes.max() <= sizes.mean() * (1 + even) + p["size"].max()
    return p


def test_sharding(spark, docs, none):
    rows = [(i, "same text" if i % 3 else f"text {i} " * (i % 7)) for i in range(9000)]
    p = check_shards(histogram_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    same = p[p.text_crc32 == zlib.crc32(b"same text")]
    assert len(same) == 6000 and same.shard.nunique() == same.shard.max() - same.shard.min() + 1
    odd_rows = histogram_shards(docs).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in odd_rows) == sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert histogram_shards(none).count() == 0


def shingles(text, k):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0d]+", b)
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def test_jaccard_matches_brute_force(spark):
    rng = random.Random(4)
    rows, base = [], [f"w{rng.randrange(400)}" for _ in range(60)]
    for i in range(200):
        w = list(base) if i % 3 else [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 70))]
        for _ in range(rng.randrange(0, 4)):
            if w:
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, k=k, percent=percent, pivots=24).collect())
        assert got == brute_components(rows, k, percent)


def test_jaccard_odd_rows(spark, docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (1, 4) and got[5] == (1, 4)
    assert got[7][1] == 6 and jaccard_components(docs).where("doc_id = 4").count() == 2
    assert jaccard_components(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (300, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 150: 100, 200: 100}


def test_decontamination(spark, none):
    item = "On Monday Alice paid 12 dollars for 3 kg of apples at the market and 5 minutes later she sold them"
    filler = "nothing here is like the question at all but words go on and on without an end"
    rows = [
        (1, f"{filler}. {item}. {filler}", "en"),
        (2, f"{filler}. {item.replace('Alice', 'Robert').replace('12', '40').replace('3 kg', '7 km').replace('Monday', 'Friday')}. {filler}", "en"),
        (3, filler, "en"), (4, None, "en"), (5, "", "en"), (6, item, "en"), (6, item, "en"),
        (7, " ".join(item.split()[:7]) + " " + filler, "en"),
    ]
    bench = spark.createDataFrame([(70, item), (71, None), (72, "Two words"), (73, ""), (None, item), (74, "12 34 56 78 90 12 34 56 78")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in find_leaks(odd(spark, rows), bench).collect()}
    assert got == {(1, 70): False, (2, 70): True, (6, 70): False}
    clash = odd(spark, [(1, "Alice met Bob and then again met Bob near the old stone bridge in town today", "en")])
    item2 = spark.createDataFrame([(1, "we saw Carl met Dora and then again met Carl near the old stone bridge in town today")], "item_id long, text string")
    assert find_leaks(clash, item2).count() == 0  # one name of the document stands for two of the item
    assert find_leaks(none, bench).count() == 0 and find_leaks(clash, bench.where("false")).count() == 0


def test_language_network_gradients():
    rng = np.random.default_rng(3)
    net = BiGru.fresh(["a", "b", "c"], 3, 5, 1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    x, y, w = rng.integers(97, 100, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones((5, 4), np.float32)
    loss, grad = net.gradients(x, y, w)
    for name in ("tf", "ub", "vf", "c"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        net.params[name][at] += 1e-2
        up = net.gradients(x, y, w)[0]
        net.params[name][at] -= 2e-2
        down = net.gradients(x, y, w)[0]
        net.params[name][at] += 1e-2
        assert abs((up - down) / 2e-2 - grad[name][at]) < 2e-3 * max(1, abs(grad[name][at]))


def test_language_held_out_accuracy(spark, docs, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = fit_languages(d, per_label=100, windows=4000, steps=250)
    p = predict_languages(d, net).join(d.select("doc_id", "lang"), "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").toPandas()
    assert (p.lang == p.lang_pred).mean() > 0.97 and p.score.between(0, 1).all()
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(docs, net).collect()}
    assert got[1] == got[2] == got[10] == ("und", 0.0) and got[4][0] in net.labels
    assert predict_languages(none, net).count() == 0 and fit_languages(none) is None
    assert {r.lang_pred for r in predict_languages(docs, None).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    lexicon = fit_toxicity(d, labels, per_label=1500)
    s = score_toxicity(d, lexicon).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").toPandas()
    hit = s.score >= 0.3
    assert (hit & (s.toxic == 1)).sum() / (s.toxic == 1).sum() > 0.85 and (hit & (s.toxic == 0)).mean() < 0.02
    auto = lexicon.automaton()
    score = lambda t: lexicon.score(lexicon.features(auto, t))
    plain = score("you are an idiot")
    assert plain > 0.5 and score("you are an 1d10t") == score("you are an іdіоt") == plain
    assert {r.doc_id for r in score_toxicity(docs, lexicon).where("score < 0.3").collect()} >= {1, 2, 3}
    assert score_toxicity(none, lexicon).count() == 0 and fit_toxicity(none, labels).stems == {}


def test_toxicity_exceptions():
    lexicon = Lexicon({"trash": 2.0, "lose": 1.0}, ("trash can",), (-2.0, 3.0, 0.0))
    auto = lexicon.automaton()
    assert lexicon.features(auto, "the trash can") == (0.0, 0.0)
    assert lexicon.features(auto, "the trash")[0] > 0 and lexicon.features(auto, "1oser")[0] > 0
    assert len(foldings("a 1")) == 2 and lexicon.features(auto, None) == (0.0, 0.0)


def test_html_model_on_unseen_layouts():
    model, right, total = trained_model(), 0, 0
    for page, y in labelled_pages(150, 99):
        guess = model.marginals(features(page), page.parent)[0] >= 0.5
        for block in {b for b, s, _ in page.runs if s.strip()}:
            right, total = right + (guess[block] == y[block]), total + 1
    assert right / total > 0.97


def test_html_marginals_match_enumeration():
    from itertools import product

    model = trained_model(40, steps=10)
    page, _ = labelled_pages(30, 5)[3]
    x, n = features(page)[:6], 6
    parent = page.parent[:6]
    kinds, total, mass = x[:, :24].argmax(1), 0.0, np.zeros(n)
    for y in product((0, 1), repeat=n):
        e = np.exp(sum(x[i] @ model.node * y[i] for i in range(n)) + sum(model.edge[kinds[i], y[parent[i]], y[i]] for i in range(1, n)))
        total, mass = total + e, mass + e * np.array(y)
    assert np.allclose(model.marginals(x, parent)[0], mass / total)


def test_html_extraction(spark):
    model = trained_model()
    page = "<html><body><nav><a href=x>Home</a> <a href=y>News</a></nav><article><h1>A &amp; B</h1><p>One\n two <b>th</b>ree.<p>Four &lt;i&gt;.<script>var t='</p>'</script></article><div id=comments><p>So good. I agree.</p></div><footer>&copy; me</footer>"
    assert main_text(page, model) == "A & B One two three. Four <i>."
    rows = [(1, "u", page, "x", 1), (2, None, None, "x", 1), (3, "u", "", "x", 1), (4, "u", "<<<>>&&; <p <div", "x", 1), (5, "u", "<article><p>" + "long text. " * 50_000, "x", 1), (1, "u", page, "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract(df, model).toPandas()
    assert len(got) == 6 and (got.n_chars == got.text.str.len()).all()
    assert got[got.page_id == 5].text.iloc[0] == ("long text. " * 50_000).strip()
    assert got[got.page_id.isin([2, 3])].text.tolist() == ["", ""]
    assert extract(df.where("false"), model).count() == 0


def test_html_query_equals_articles(spark):
    import html

    got = {r.page_id: r.text for r in q.op7_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())


def test_warc_audit(spark):
    rows = [(i, f"http://h/{i}", "x" * (i % 50)) for i in range(1000)] + [(None, None, None), (7, "http://h/7", "x" * 7)]
    a = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = layout(a)
    assert audit(whole, layout(a)).count() == 0
    b = spark.createDataFrame([(i, u, ("y" + h[1:]) if i == 501 else h) for i, u, h in rows], a.schema)
    got = audit(whole, layout(b), range_bytes=512, fan_out=2).collect()
    assert [(r.id, r.kind) for r in got] == [(501, "altered")]
    lost = audit(whole, layout(a).where("archive <> 2")).collect()
    assert {r.kind for r in lost} == {"missing"} and sorted(r.id for r in lost) == list(range(512, 768))
    empty = layout(a.where("false"))
    assert audit(empty, empty).count() == 0 and audit(empty, whole).where("kind = 'surplus'").count() == 1002


def test_leaks_with_clashing_parameters(spark):
    one = lambda text: spark.createDataFrame([(1, text)], "item_id long, text string")
    leaks = lambda item, text: [tuple(r)[2:] for r in find_leaks(odd(spark, [(1, text, "en")]), one(item)).collect()]
    loaves = "the baker sold {} loaves of bread to the school and then {} loaves more to the old inn by the river"
    assert leaks(loaves.format(3, 5), loaves.format(4, 4)) == [(15, 15, True)]  # two parameters take one value
    walk = "the walk took them {} over the hill and after a long rest another {} down to the sea again"
    assert leaks(walk.format("1 hour", "5 hours"), walk.format("2 hours", "5 hours")) == [(15, 15, True)]
    tail = " and so the whole company went on along the winding road until the night had come at last"
    got = leaks(loaves.format(5, 5) + tail, loaves.format(5, 6) + tail)  # one of two equal numbers altered
    assert got == [(25, 33, False)]  # the eight windows that hold the altered number are lost


def test_leaks_of_items_rich_in_slots(spark):
    items = ["Add 12 and 15.", "Who was Marie Curie?", "Compute 12 + 7 * 3 - 4 / 2 and 5."]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"We were asked: {i} Nobody knew." for i in items] + ["Add 13 and 15, or 12 and 15.", "Who was Pierre Curie? Compute 12 + 7 * 3 - 4 / 2 and 6."]
    got = find_leaks(odd(spark, [(i, t, "en") for i, t in enumerate(texts)]), bench).collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 1, 1, False), (1, 1, 1, 1, False), (2, 2, 1, 1, False)]


def test_jaccard_counts_all_links(spark):
    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(90)], []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(100, "one two three four five six"), (101, "one two three four five six"), (102, "")]
    sets = {i: frozenset(shingles(t, 4)) for i, t in rows}
    linked = lambda a, b: a != b and a and b and 100 * len(a & b) >= 85 * len(a | b)
    want = {i: len({b for b in sets.values() if linked(a, b)}) for i, a in sets.items()}
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), pivots=4, block=16).collect()
    assert {r.doc_id: r.n_links for r in out} == want
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(rows, 4, 85)
    assert len(set(want.values())) > 5


def test_merge_machine_equals_library():
    machine, _ = load(public_tokenizers.path("word_bpe_49k.json"))
    rng, names = random.Random(1), list(LIB.get_vocab())
    words = ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randrange(1, 25))) for _ in range(2000)]
    words += [re.sub("</w>|[^a-z]", "", "".join(rng.choice(names) for _ in range(3))) or "a" for _ in range(4000)]
    words += ["".join(rng.choice("!?.-_#*=+~@&%$") for _ in range(rng.randrange(1, 40))) for _ in range(1000)] + ["ab" * 4000, "ñandú", "e" * 700]
    counts, ids = machine.words([w.encode() for w in words])
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [ids_of(w) for w in words]
    small, _ = load(public_tokenizers.path("word_bpe_49k.json"))
    small.max_states = 10  # starts anew all the time
    assert small.words([w.encode() for w in words[:300]])[1].tolist() == ids[: counts[:300].sum()].tolist()


def test_tokenizer_memory_is_small():
    """Two workers compile new words all the time beside the engine: the pipeline's packing broke an executor's memory."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefghinorst") for _ in range(rng.randrange(3, 10))) for _ in range(8_000)) for _ in range(4)]
    tracemalloc.start()
    _class_table.__wrapped__()
    classes = tracemalloc.get_traced_memory()[1]
    machine = Transducer(public_tokenizers.path("word_bpe_49k.json"))
    start, got = tracemalloc.get_traced_memory()[0], []
    for t in texts:
        got += machine.run([t], want_ids=True)[1]
    held = tracemalloc.get_traced_memory()[0] - start - sum(g.nbytes for g in got)
    tracemalloc.stop()
    assert (classes < 20e6, held < 30e6) == (True, True)
    assert got[0].tolist() == ids_of(texts[0])
    machine.max_words = 10  # starts anew with every text
    assert [machine.run([t], want_ids=True)[1][0].tolist() for t in texts] == [g.tolist() for g in got]


def test_merge_machine_is_the_merges_as_defined():
    vocab = {c: i for i, c in enumerate("abc")} | {c + "</w>": 3 + i for i, c in enumerate("abc")}
    merges = [("a", "b"), ("b", "c</w>"), ("ab", "ab"), ("a", "a"), ("aa", "b</w>"), ("c", "ab")]
    for a, b in merges:
        vocab[a + b] = len(vocab)
    machine, rng = MergeMachine(vocab, merges), random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))).encode() for _ in range(400)]
    counts, ids = machine.words(words)
    for w, got in zip(words, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == machine.merge([machine.unit[s] for s in (*w[:-1], w[-1] + 256)])


def test_every_code_point_counts_as_in_the_library():
    """All planes that hold letters, before and after the contractions; letters newer than this Python's tables too."""
    points = [c for c in [*range(1, 0xD800), *range(0xE000, 0x323B0), *range(0xE0000, 0xE0200)]]
    texts = ["".join(f"{chr(c)}'s a{chr(c)}'re1{chr(c)}2 {chr(c)}{chr(c)}! " for c in points[lo : lo + 64]) for lo in range(0, len(points), 64)]
    _, ids = transducer(public_tokenizers.path("word_bpe_49k.json")).run(texts, want_ids=True)
    assert all(got.tolist() == ids_of(t) for got, t in zip(ids, texts))


def test_special_strings_and_unknown_letters(spark):
    texts = ["Ƛ's", "a<|endoftext|>'s Ƛ <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "<|endoftext|>" * 3, "x" * 5000]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.n_tokens for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: len(ids_of(t)) for i, t in rows}


def test_packing_keeps_ids_beside_nulls(spark):
    rows = [(2**60 + 1, "one two"), (None, "three"), (-(2**62) - 3, "four five six")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got) == sorted((i or 0, len(ids_of(t)) + 1) for i, t in rows)


def test_slices_bound_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (3, 3, 3, 50, 1, 0)] + [None])], ["t"])
    assert [p.num_rows for p in slices(batch, 0, rows=4, size=9)] == [3, 1, 3]
    assert [p.num_rows for p in slices(batch.slice(1, 5), 0, rows=2, size=100)] == [2, 2, 1] and not list(slices(batch.slice(0, 0), 0))


def test_html_time_grows_with_length_only():
    model = trained_model()
    pages = ["<div>" * 200_000, "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 800 + "<li>x" * 40_000, "<a " * 300_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 100_000, "<table><tr>" + "<td>x" * 100_000,
             "<p " + "='" * 200_000, "<script>" * 50_000, "</p>" * 200_000, "<a x=\"" * 100_001, "<ul><li>y" * 50_000, "<" * 500_000, "<select><option>" * 20_000]
    for page in pages:
        began = time.process_time()
        main_text(page + "<article><p>One two three. " + "Four five six. " * 20, model)
        assert time.process_time() - began < 30, page[:40]


def test_html_attributes_and_misnesting():
    assert attributes(' title="the hidden garden" CLASS=\'a b\' id=x hidden') == {"title": "the hidden garden", "class": "a b", "id": "x", "hidden": ""}
    page = parse('<div title="the hidden garden"><p hidden>a</p><p>b<p>c</div><b>d<div>e</b>f</div><ul><li>g<ul><li>h</ul><li>i</ul>')
    assert ["\0" in n for n in page.names] == [False, False, True, False, False, False, False, False, False, False, False][: len(page.names)]
    assert page.tag == ["html", "div", "p", "p", "p", "div", "ul", "li", "ul", "li", "li"] and page.parent == [-1, 0, 1, 1, 1, 0, 0, 6, 7, 8, 6]
    assert [(page.tag[b], t) for b, t, _ in page.runs] == [("p", "a"), ("p", "b"), ("p", "c"), ("html", "d"), ("div", "e"), ("div", "f"), ("li", "g"), ("li", "h"), ("li", "i")]


def test_jaccard_of_repeated_and_null_ids(spark):
    rng = random.Random(6)
    a = [f"a{rng.randrange(900)}" for _ in range(80)]
    b = [f"b{rng.randrange(900)}" for _ in range(80)]
    a2 = a[:-1] + ["other"]
    rows = [(3, " ".join(b)), (5, " ".join(a)), (5, " ".join(b)), (9, " ".join(a2)), (None, " ".join(a)), (None, "alone in the table with its words"), (7, None), (9, " ".join(a2))]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(3, 3, 0, True), (5, 5, 1, True), (5, 3, 0, False), (9, 5, 1, False), (None, 5, 1, False), (None, None, 0, True), (7, 7, 0, True), (9, 5, 1, False)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.component_id, r.n_links, r.first)) for r in got)
    plain = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), count_links=False).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id, r.first) for r in got))) == sorted(map(str, ((r.doc_id, r.component_id, r.first) for r in plain)))


def test_topk_blocks_shards_and_ties(spark):
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-3, 4) for _ in range(4)]) for i in range(300)] + [(7, [3, 3, 3, 3]), (None, [9, 9, 9, 9]), (400, None), (401, [1, None, 2, 3]), (402, [])]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>").repartition(5)
    got = sorted(tuple(r) for r in exact_top_k(df.where("vec_id % 9 = 7"), df, k=4, block_bytes=500, shard_rows=16, fan_in=2).collect())
    whole, want = [(i, v) for i, v in rows if i is not None and v and None not in v], []
    for q in sorted({i for i, _ in whole if i % 9 == 7}):
        own = min(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q)[:4]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def naive_score(lexicon, text):
    """The lexicon's score by looking at every position of the folded text."""
    best = (0.0, 0.0)
    for f in foldings(text or ""):
        safe = {i for e in lexicon.exceptions for m in range(len(f)) if f.startswith(f" {e} ", m) for i in range(m, m + len(e) + 1)}
        weight = 0.0
        for at in range(len(f)):
            held = [x for x in lexicon.stems if f.startswith(f" {x}", at)]
            if held and at not in safe:
                weight += lexicon.stems[max(held, key=len)]
        if weight and text:
            best = max(best, (math.log1p(weight), 100 * weight / max(f.count(" ") - 1, 1)))
    return lexicon.score(best)


def test_toxicity_query_equals_naive_matcher(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = fit_toxicity(d, labels)
    got = {r.doc_id: r for r in q.op8_toxicity(spark, SF).collect()}
    rows = d.collect()
    assert len(got) == len(rows)
    for r in rows[:120]:
        want = naive_score(lexicon, r.text)
        assert abs(got[r.doc_id].score - want) < 1e-12 and got[r.doc_id].predicted == int(want >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_query_equals_step_by_step_network(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    net = fit_languages(d)
    got = {r.doc_id: r for r in q.op4_language_id(spark, SF).collect()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    rows = d.collect()
    assert len(got) == len(rows)
    for r in rows[:25]:
        raw, total, n = (r.text or "").encode(), np.zeros(len(net.labels)), 0
        for lo in range(0, len(raw), net.window):
            x = list(raw[lo : lo + net.window].ljust(net.window, b"\0"))
            logits = np.tile(net.params["c"].astype(float), (net.window, 1))
            for way, steps in (("f", range(net.window)), ("b", range(net.window - 1, -1, -1))):
                h, k = np.zeros(net.hidden), net.hidden
                for t in steps:
                    a, u = net.params[f"t{way}"][x[t]].astype(float), net.params[f"u{way}"].astype(float)
                    z, g = sigmoid(a[:k] + h @ u[:, :k]), sigmoid(a[k : 2 * k] + h @ u[:, k : 2 * k])
                    h = (1 - z) * h + z * np.tanh(a[2 * k :] + (g * h) @ u[:, 2 * k :])
                    logits[t] += h @ net.params[f"v{way}"].astype(float)
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for t in range(net.window):
                if 65 <= x[t] <= 90 or 97 <= x[t] <= 122 or x[t] >= 128:
                    total, n = total + p[t], n + 1
        if n and any(map(str.isalpha, r.text)):
            assert got[r.doc_id].lang_pred == net.labels[int(total.argmax())] and abs(got[r.doc_id].score - total.max() / n) < 1e-3
        else:
            assert got[r.doc_id].lang_pred == "und"


def test_sharding_query_keeps_its_law(spark):
    rows = q.op5_sharding(spark, SF).collect()
    p = check_shards(rows)
    want = {r.doc_id: ((r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in want.items()}
    # sorted by the hash of the text: equal texts lie side by side, and a group spans neighbouring shards only
    place = p.sort_values(["shard", "slot"]).reset_index(drop=True)
    text = place["doc_id"].map(want)
    for _, at in text.groupby(text).groups.items():
        assert max(at) - min(at) == len(at) - 1
