"""Very long texts and pages: bounded memory, the same results as a plain reading, and scores against a brute-force classifier."""

import resource

import numpy as np
from pyspark.sql import functions as F

from demur.llm import pages, quality


def _peak_mb():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def test_deep_page_is_read_in_order():
    found = pages.blocks("<div class='part'>x" * 20_000)
    assert len(found) == 20_000 and all(f.level.numbers is found[1].level.numbers for f in found[1:])


def test_levels_close_what_they_opened():
    page = "<main class='a b'>one<div class='a c'>two</div>three</main><div class='c'>four</div>"
    one, two, three, four = pages.vectors(pages.blocks(page))[:, :pages.PATH_DIM]

    def plain(names, last):
        out = np.zeros(pages.PATH_DIM, np.float32)
        for name in [*names, "last " + last]:
            at, sign = pages._hashed(name, pages.PATH_DIM, {})
            out[at] += sign
        return out

    assert np.array_equal(one, plain(["main", ".a", ".b"], ".b")) and np.array_equal(three, one)
    assert np.array_equal(two, plain(["main", ".a", ".b", "div", ".c"], ".c"))
    assert np.array_equal(four, plain(["div", ".c"], ".c"))


def test_one_long_page_among_short_ones():
    draw = np.random.default_rng(1)
    weights = []
    for _ in range(2):
        weights += [draw.normal(0, 0.15, (pages.INPUT + pages.HIDDEN, 4 * pages.HIDDEN)), np.zeros(4 * pages.HIDDEN)]
    weights += [draw.normal(0, 0.2, 2 * pages.HIDDEN), np.zeros(1)]
    short = [pages.blocks(f"<p>page {i}<p>" + "more <p>" * (i % 7)) for i in range(63)]
    long = pages.blocks("<table>" + "<tr><td>a cell</td></tr>" * 20_000)
    alone = pages.label(short, weights)
    before = _peak_mb()
    together = pages.label([long, *short], weights)
    assert _peak_mb() - before < 400
    assert len(together[0]) == 20_000 and all(np.array_equal(a, b) for a, b in zip(alone, together[1:]))


def test_parts_of_a_text_give_what_the_whole_gives(monkeypatch):
    text = "".join(f"word{i % 17} same same, line {i % 5}!\n" for i in range(400))
    whole = quality.Pooler({"same": np.ones(quality.DIM, np.float32)}).pool(text)
    for part in (1, 2, 7, 100):
        monkeypatch.setattr(quality, "PART", part)
        got = quality.Pooler({"same": np.ones(quality.DIM, np.float32)}).pool(text)
        assert np.allclose(got, whole, atol=1e-5)
    assert quality.line_counts("") == (1, 1) and quality.line_counts("a\nb\na\n") == (4, 3) == (len("a\nb\na\n".split("\n")), 3)


def test_long_text_in_bounded_memory():
    pooler = quality.Pooler({})
    text = "alpha beta, x1 " * 1_200_000
    before = _peak_mb()
    pooler.pool(text)
    assert _peak_mb() - before < 300


def test_scores_equal_brute_force(spark):
    """Every score again, one token and one hidden unit at a time, from the model's numbers alone."""
    import math
    import re
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = quality.learn(table, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in quality.score(table, model).collect()}

    def plain(text):
        found = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")
        if not found:
            return quality.index_vector(quality.EMPTY)
        total = np.zeros(quality.DIM)
        for i, t in enumerate(found):
            form = quality.index_vector(quality.shape(t))
            total += model.vocabulary[t] + form if t in model.vocabulary else form
            if i and found[i - 1] == t:
                total += quality.index_vector(quality.REPEATED)
            if t in found[:i]:
                total += quality.index_vector(quality.SEEN_BEFORE)
        lines = text.split("\n")
        again = sum(line in lines[:i] for i, line in enumerate(lines))
        return (total + again * len(found) / len(lines) * quality.index_vector(quality.SAME_LINE)) / len(found)

    rows = table.where(F.length("text") < 4000).collect()
    assert len(rows) > 30
    for r in rows:
        x = (plain(r["text"]) - model.mean) / model.scale
        hidden = [math.tanh(sum(x[i] * model.weights[0][i, j] for i in range(quality.DIM)) + model.weights[1][j]) for j in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, model.weights[2])) + model.weights[3][0]
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-logit / model.temperature))) < 1e-4
