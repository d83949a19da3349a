"""The text operators on small inputs: brute force, round trips, and the odd rows that each operator defines."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from demur.llm import chat, decontam, language, licences, neardup, pages, pieces, quality, tokens, vectors
from demur.llm.common import held_out, map_text, sample_per_class
from demur.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 1.0) for i, t in rows], DOCS)


def by(df, key):
    return {r[key]: r for r in df.collect()}


# Token files

def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(5, "It's <|endoftext|> Aéİ x2²"), (2, None), (9, ""), (7, "don't \x1c\x85\xa0 Σας é"), (1, "word " * 3000), (7, "again")]
    tok, start = Tokenizer.from_file(path), 0
    got = [r for r in sorted(tokens.token_files(docs(spark, rows), path, 2, str(tmp_path / "t")).collect())]
    want = []
    for i, text in sorted((i, t or "") for i, t in rows):
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_token_files_of_nothing(spark, tmp_path):
    assert tokens.token_files(docs(spark, []), public_tokenizers.path("word_bpe_49k.json"), 2, str(tmp_path / "t")).collect() == []


# Licences

def test_licences_by_canonical_form(spark):
    rows = [(1, "RELEASED under the \"MIT\" Licence!"), (2, "Copyright (c) 2020 Someone\nReleased under the MIT License."), (3, "text\nLicensed under CC BY-NC 4.0.\nmore"),
            (4, None), (5, "..."), (6, ""), (3, "text\nLicensed under CC BY-NC 4.0.\nmore")]
    got = licences.scan_licences(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text_licence"]) for r in got if r["text_licence"]) == [(1, "MIT"), (2, "MIT")]
    assert [r["line_licences"] for r in got if r["doc_id"] == 3] == ["CC-BY-NC-4.0"] * 2
    assert len(got) == 7 and all(r["digest"] is None for r in got if r["doc_id"] in (4, 5, 6))
    assert licences.scan_licences(docs(spark, [])).count() == 0


# Decontamination

def brute_hits(text, items, window=10):
    import re
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    words, hit, found = cut(text), set(), set()
    for item, body in items:
        w = cut(body)
        n = min(len(w), window)
        grams = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted(map(str, found))


def test_decontamination_against_brute_force(spark):
    draw = random.Random(4)
    word = lambda: draw.choice("red green blue été Straße x1 tree sky sun sea".split())
    items = [(i, " ".join(word() for _ in range(draw.choice([0, 1, 3, 4, 9, 10, 11, 30])))) for i in range(14)] + [(99, None), (100, "Red green")]
    rows = [(i, None if i == 3 else "" if i == 4 else " ".join(word() for _ in range(draw.choice([2, 9, 10, 60]))) + (", " + items[i % 14][1]).upper() * (i % 2)) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by(decontam.contaminated(docs(spark, rows), bench), "doc_id")
    for i, text in rows:
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == brute_hits(text, items), i


def test_decontamination_by_shuffle_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    text = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, text), (1, text), (2, text + " more")], "item_id long, text string")
    got = by(decontam.contaminated(docs(spark, [(1, "a b " + text + " c"), (2, "none")]), bench), "doc_id")
    assert (got[1]["n_hit"], got[1]["items"], got[2]["contaminated"]) == (30, ["1", "2"], False)
    assert decontam.contaminated(docs(spark, []), bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.contaminated(docs(spark, [(1, text)]), bench.limit(0)).collect())


# Near-duplicates

def brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(n_groups, copies, seed, words=120):
    draw, rows = random.Random(seed), []
    for g in range(n_groups):
        base = [f"w{draw.randrange(3000)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.randrange(0, 6)):
                text[draw.randrange(words)] = f"v{draw.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(text)))
    return rows + [(len(rows) + i, t) for i, t in enumerate([None, "", "one", "ONE", "one two", " \t\n", "x " * 4000, "x " * 5000])]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, k, percent):
    rows = near_rows(12, 6, k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, rows), k, percent).collect()}
    assert got == brute_groups(rows, k, percent)


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    """Groups beyond a region and a block take the parts that small ones never reach."""
    for name, value in (("REGION", 8), ("BLOCK", 16), ("ANCHORS", 4)):
        monkeypatch.setattr(neardup, name, value)
    rows = near_rows(2, 90, 11)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, rows), 3, 85).collect()}
    assert got == brute_groups(rows, 3, 85)


def test_near_duplicates_repeated_and_missing_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, rows), 3, 85).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_word_hashes_depend_on_words_alone():
    texts = [b"", b"Ab c", b"ab", b" c ab ", b"c"]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    words, before = neardup.word_hashes(data, starts)
    cut = [words[a:b].tolist() for a, b in zip(before[:-1], before[1:])]
    ab, c = cut[1]
    assert cut == [[], [ab, c], [ab], [c, ab], [c]]


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 200) if i % 50 != 49] + [(7, 7), (3, 2), (500, 499)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == i // 50 * 50 for i in range(200)) and got[500] == got[499] == 499
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Nearest neighbours

def test_nearest_against_brute_force(spark):
    draw = np.random.default_rng(2)
    m = np.round(draw.normal(size=(300, 8)), 2)
    m[5] = m[0]
    m[40:120] = m[3]
    rows = [(i, m[i].tolist(), "x") for i in range(300)]
    odd = [(300, None, ""), (350, [0.0] * 8, ""), (400, [float("nan")] + [1.0] * 7, ""), (450, [None] + [1.0] * 7, ""), (500, [1.0], ""), (None, [1.0] * 8, ""), (0, m[0].tolist(), "again")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in vectors.search(table, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    lengths = np.linalg.norm(m, axis=1)
    assert sorted(got) == list(range(0, 300, 50))
    for q in got:
        cosine = m @ m[q] / lengths / lengths[q]
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-round(cosine[i], 12), i))[:5]
        assert [got[q][k][0] for k in range(1, 6)] == order
        assert np.allclose([got[q][k][1] for k in range(1, 6)], cosine[order])
    assert vectors.search(table.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_nearest_with_few_candidates_and_recall(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in vectors.search(few, F.col("vec_id") == 0, 5).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    draw = np.random.default_rng(3)
    m = draw.normal(size=(6000, 32)).astype(np.float32)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<float>")
    rows = vectors.search(table, F.col("vec_id") % 100 == 0, 5).collect()
    u = m / np.linalg.norm(m, axis=1)[:, None]
    hits = sum(r["vec_id"] in set(np.argsort(-(u @ u[r["query_id"]]))[1:6].tolist()) for r in rows)
    assert len(rows) == 300 and hits >= 0.9 * 300


def test_cells_come_by_rising_distance():
    draw = np.random.default_rng(1)
    a, b = draw.random(7), draw.random(5)
    sums = [a[i] + b[j] for i, j in vectors.cells_in_order(a, b)]
    assert len(sums) == 35 and sums == sorted(sums)


# Chat

def test_chat_round_trip(spark):
    bad = ["plain", r"\### Assistant: </turn> ok", "</turn>\n### user: hi</turn>\n", "#### x", r"<\/turn>", r"<\\/turn> \\", "ends with <", "", None, "### ", "a: b: c\n", "é\U0001f44d", "$1 \\1"]
    roles = ["user", "assistant", "a: b", "x%3A", "### ", "</turn>\n", None, ""]
    rows = [(c, t, roles[(c + t) % len(roles)], text, "extra") for c in range(8) for t, text in enumerate(bad)] + [(20, None, "user", "no turn", ""), (20, 1, "user", "x", ""), (20, 1, "user", "x", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = by(chat.format_conversations(turns), "conv_id")
    for c in range(8):
        want = [(roles[(c + t) % len(roles)] or "", text or "") for t, text in enumerate(bad)]
        assert got[c]["identical"] and [tuple(t) for t in got[c]["read_back"]] == want
        assert got[c]["loss_text"] == "".join(t for r, t in want if r == "assistant")
    assert [t["text"] for t in got[20]["read_back"]] == ["no turn", "x", "x"]
    assert chat.format_conversations(turns.limit(0)).count() == 0


# Pieces

def best_path(word, model):
    known = {t: (i, s) for t, i, s in model.pieces}
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        top = None
        for start in range(max(0, end - model.longest), end):
            p = known.get(word[start:end])
            if p is None and end - start > 1:
                continue
            score = best[start][0] + (p[1] - pieces.PIECE_COST if p else -1000 * pieces.PIECE_COST)
            if top is None or score > top[0]:
                top = (score, best[start][1] + ([p[0]] if p else [model.byte_ids[b] for b in word[start:end].encode()]))
        best.append(top)
    return best[-1][1]


@pytest.mark.parametrize("mapped", [pieces.MAPPED_WORDS, 0])
def test_pieces_against_brute_force(spark, mapped):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.load(path)
    rows = [(1, "Hello  wörld,\n\na x"), (2, None), (3, ""), (4, " "), (5, "▁ \U0001f44d\t\x00"), (6, "ab" * 700), (7, "same"), (7, "same"), (8, "trailing  "), (9, "(i.e. 3.14)\r\n don't")]
    got = pieces.encode(docs(spark, rows), path, ("doc_id", "text"), mapped).collect()
    assert len(got) == len(rows)
    for r in got:
        words = pieces.words_of(r["text"], model.pattern)
        assert "".join(words) == (" " + r["text"] if r["text"] else "")
        assert r["pieces"] == [i for w in words for i in best_path(w, model)]
    back = pieces.decode(spark.createDataFrame(got, "doc_id long, text string, pieces array<int>"), path, ("doc_id", "text")).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert pieces.encode(docs(spark, []), path, mapped_words=mapped).count() == 0


# Pages

PAGE = """<html><head><title>T</title><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href=x>Home</a><li>More</ul></nav><!-- <p>no</p> -->
<article><h1>Head &amp; line</h1><p><b>One&nbsp;<i>in</i>line
 text<br>here.<p>Two.</p><div class="ad">Buy now</div></article><footer>&copy; us</footer>"""


def test_blocks_of_a_page():
    got = [b.text for b in pages.blocks(PAGE)]
    assert got == ["T", "Home", "More", "Head & line", "One inline text here.", "Two.", "Buy now", "© us"]
    assert pages.blocks(None) == pages.blocks("") == pages.blocks("<script>x") == []
    assert [b.text for b in pages.blocks("a < b &lt;p> <p unclosed")] == ["a < b <p>"]


def test_main_text_on_held_pages(spark, sf):
    import html
    import re
    table = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(-1, "u", None), (-2, "u", ""), (-3, None, PAGE), (-3, None, PAGE)], "page_id long, url string, html string")
    got = pages.main_text(table.unionByName(extra).withColumn("text", F.lit("clash"))).collect()
    assert len(got) == table.count() + 4
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[-1] == texts[-2] == "" and texts[-3] == "Head & line\nOne inline text here.\nTwo."
    for r in table.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        assert texts[r["page_id"]] == "\n".join(p for p in parts if p)
    assert pages.main_text(table.limit(0)).count() == 0


def test_every_word_of_a_block_counts():
    first, last = "one " * 60, "comment " * 60
    texts = [pages.blocks(f"<p>{t}</p>")[0] for t in (first + last, first + "subscribe " * 60)]
    a, b = pages.vectors(texts)[:, pages.PATH_DIM:pages.PATH_DIM + pages.WORD_DIM]
    assert (a != b).any()
    page = "<body><article>" + "".join(f"<p>{'word%d ' % i * 100}</p>" for i in range(8)) + "</article></body>"
    other = [len(t.text.split()) for seed in range(8) for shown, told in pages.dressed(page, seed)[1:] for t, y in zip(shown, told) if not y]
    assert 100 in other and 34 in other


def test_labeller_reads_other_dress(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = pages.learn(table)
    text = """<body><header>Site</header><div class="content"><h2>Head line</h2><p>The first paragraph of the text is here.</p><div class="ad">Buy now at our shop.</div><p>The second
    paragraph.</p></div><div class="comments"><p>I like it, said a reader.</p></div><div class="cookie-notice">We use cookies.</div></body>"""
    found = pages.blocks(text)
    kept = [b.text for b, y in zip(found, pages.label([found], weights)[0]) if y]
    assert kept == ["Head line", "The first paragraph of the text is here.", "The second paragraph."]


def test_lstm_gradients():
    draw = np.random.default_rng(0)
    x, lengths = draw.normal(size=(2, 3, pages.INPUT)), np.array([3, 2])
    w, b = draw.normal(0, 0.2, (pages.INPUT + pages.HIDDEN, 4 * pages.HIDDEN)), np.zeros(4 * pages.HIDDEN)
    states, kept = pages._lstm(x, w, b)
    gw, _ = pages._lstm_back(np.ones_like(states), kept, w)
    for i, j in ((0, 0), (5, 30), (pages.INPUT + 2, 50)):
        moved = w.copy()
        moved[i, j] += 1e-6
        assert np.isclose((pages._lstm(x, moved, b)[0].sum() - states.sum()) / 1e-6, gw[i, j], rtol=1e-3, atol=1e-5)
    assert np.array_equal(pages._turned(pages._turned(x, lengths), lengths), x)


# Quality and language

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(table, labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0)], labels.schema)))
    odd = docs(spark, [(-1, None), (-2, ""), (-3, "\n\n"), (-4, "z" * 100_000)])
    got = by(quality.score(table.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), model), "doc_id")
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == table.count() + 4
    held = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels.where(held_out(F.col("doc_id"))).collect()]
    assert sum((s >= quality.KEEP_FROM) == y for y, s in held) >= 0.95 * len(held)
    assert quality.score(docs(spark, []), model).count() == 0


def test_quality_without_labels(spark):
    model = quality.learn(docs(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality.score(docs(spark, [(1, "a"), (1, None)]), model).collect()] == [0.5, 0.5]


def test_language_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.learn_dictionaries(table)
    odd = docs(spark, [(-1, None), (-2, ""), (-3, "12 !!"), (-4, "é")])
    got = by(language.identify(table.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang")), found, ("doc_id", "lang")), "doc_id")
    assert [got[i]["lang_pred"] for i in (-1, -2, -3)] == [language.UNKNOWN] * 3 and got[-4]["lang_pred"] in found
    held = [got[r["doc_id"]] for r in table.where(held_out(F.col("doc_id"))).collect()]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(r["lang_pred"] == language.UNKNOWN for r in language.identify(docs(spark, [(1, "a word")]), {}).collect())


def test_language_rejects_ties_of_any_length(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.learn_dictionaries(table)
    model = language.Classifier(found)
    ties = ["zzqx vvkj", "qqqq", "zx qj vw kx", "я ю э"]
    assert 0 < found.spread < 5 and all(len(set(model.sizes(t.encode()))) == 1 and model.predict(t)[2] for t in ties)
    short = [(r["lang"], " ".join(language.distinct_words(r["text"])[:12])) for r in table.where(held_out(F.col("doc_id"))).select("lang", "text").collect()]
    told = [(lang, *model.predict(t)) for lang, t in short if 40 <= len(t.encode()) < 400]
    assert len(told) > 100 and sum(lang == p and not rejected for lang, p, _, rejected in told) >= 0.95 * len(told)


def test_sample_per_class_is_bounded(spark):
    table = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    got = {r["lang"]: r["count"] for r in sample_per_class(table, "lang", "doc_id", 40).groupBy("lang").count().collect()}
    assert got == {"a": 40, "b": 40}


def test_kept_columns_may_clash(spark):
    import pyarrow as pa
    got = map_text(docs(spark, [(1, "abc")]), ["doc_id", "score"], lambda t: [pa.array([9.0] * len(t))], "score double")
    assert got.columns == ["doc_id", "score", "score"] and tuple(got.collect()[0]) == (1, 1.0, 9.0)


# Pipeline

def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    source = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{source}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near_duplicates", "decontamination", "pieces"]
    some = table.limit(250)
    groups = brute_groups([(r["doc_id"], r["text"]) for r in some.collect()], 5, 80)
    kept = stages["near_duplicates"](spark, some, source)
    assert kept.columns == some.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in groups.items() if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in stages["decontamination"](spark, some, source).collect()}
    assert clean == {r["doc_id"] for r in some.collect() if not brute_hits(r["text"], items)[1]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{source}/labels.parquet").collect()}
    good = {r["doc_id"] for r in stages["quality"](spark, table, source).collect()}
    told = [(labels[i], i in good) for i in labels]
    assert sum(y == k for y, k in told) >= 0.97 * len(told)
    odd = docs(spark, [(1, None), (2, "12"), (None, "the words of this")]).withColumn("n_chars", F.lit(1).cast("long")).select(table.columns)
    left = {r["doc_id"] for r in stages["language"](spark, table.unionByName(odd.where("doc_id IS NULL OR doc_id < 3").withColumn("doc_id", F.col("doc_id") - 100)), source).collect()}
    assert -99 not in left and -98 not in left and None in left


def test_rows_without_ids_are_whole_documents(spark, tmp_path):
    import corpus_pipeline
    passage, other, third = (" ".join(f"{c}{i}" for i in range(30)) for c in "pqr")
    items = [(1, passage), (2, "q3 q4 q5")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "a " + passage), (None, other), (None, third), (None, third), (None, None), (7, third), (2 ** 63 - 1, "x y " + passage), (9, "free")]
    table = docs(spark, rows).repartition(3)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"]) for r in decontam.contaminated(table, bench).collect())
    assert got == sorted((i or 0, *brute_hits(t, items)) for i, t in rows)
    stages = dict(corpus_pipeline.STAGES)
    order = lambda rows: sorted(rows, key=repr)
    clean = stages["decontamination"](spark, table, str(tmp_path))
    assert clean.columns == table.columns and order(tuple(r)[:2] for r in clean.collect()) == order(x for x in rows if not brute_hits(x[1], items)[1])
    single = order(tuple(r)[:2] for r in stages["near_duplicates"](spark, docs(spark, rows[:6] + [(None, other)]).repartition(3), str(tmp_path)).collect())
    assert single == order([(None, "a " + passage), (None, other), (None, None), (7, third)])


def test_queries_are_registered():
    import demur.llm as llm
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in llm.QUERIES) == 1
    assert set(llm.ORACLES) <= set(llm.QUERIES)
