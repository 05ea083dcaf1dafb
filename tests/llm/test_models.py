"""Language (6), toxicity (4), quality (2) and page text (1)."""
import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import byte_gru as BG
from riskloom.llm import html_blocks as HB
from riskloom.llm import quality_rules as QR
from riskloom.llm import toxicity_fst as TX
from riskloom.llm.queries import R
from riskloom.sources.tables import read_table

SMALL = "/root/testdata/sf0.001"


def numeric_gradients(model, parameters, loss, gradients, picks, eps=1e-3):
    for p, g in zip(parameters, gradients):
        flat = np.argsort(-np.abs(g), axis=None)[:picks]
        for at in flat:
            i = np.unravel_index(at, p.shape)
            old = p[i]
            p[i] = old + eps
            up = loss()
            p[i] = old - eps
            down = loss()
            p[i] = old
            assert (up - down) / (2 * eps) == pytest.approx(float(g[i]), rel=0.08, abs=2e-4)


def test_gru_backpropagation():
    m = BG.ByteTagger(3, hidden=4)
    runs, y = [b"abc", b"x", b"hello", "né".encode()], np.array([0, 1, 2, 1])
    _, grads = m.gradients(runs, y)
    numeric_gradients(m, m.parameters, lambda: m.gradients(runs, y)[0], grads, 3)


def test_gru_padding_does_not_matter():
    m = BG.ByteTagger(3, hidden=4)
    runs = [b"abc", b"a", b"some longer run here"]
    together = m.run_sums(runs)
    alone = np.concatenate([m.run_sums([r]) for r in runs])
    assert np.allclose(together, alone, atol=1e-5) and together[:, -1].tolist() == [3, 1, 20]


def test_language(spark, sf, edge_docs, no_docs):
    got = R.queries["op6_byte_gru"](spark, sf).join(read_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    model, names = BG.fit_language_model(edge_docs)
    rows = BG.predict_language(edge_docs, model, names, edge_docs.columns)
    assert rows.columns == [*edge_docs.columns, "lang_pred", "score"]
    for r in rows.select("doc_id", "text", "lang_pred").collect():
        assert r.lang_pred == ("en" if any(c.isalpha() for c in r.text or "") else "und"), r.text
    assert BG.predict_language(no_docs, model, names, ["doc_id"]).count() == 0
    none, empty = BG.fit_language_model(no_docs)
    assert {r.lang_pred for r in BG.predict_language(edge_docs, none, empty, ["doc_id"]).collect()} == {"und"}


def test_held_out_rows():
    import zlib
    from riskloom.session import get_spark
    spark = get_spark()
    got = [r[0] for r in spark.range(200).select(F.col("id").alias("doc_id")).select(BG.held_out(4, 2)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)]
    assert spark.createDataFrame([(None,)], "doc_id long").select(BG.held_out(3, 1)).first()[0] is False


def reader(**words):
    return TX.ClauseReader(TX.Lexicon(words, {"vequ": 2.0}))


def kinds(text):
    return [round(float(x), 3) for x in reader(idiot=3.0)([text])[0][:5]]


def test_clause_grammar():
    w = round(float(np.log1p(3.0)), 3)
    assert kinds("an idiot walked by.") == [w, 0, 0, 0, 0]
    assert kinds("You are an idiot!") == [0, w, 0, 0, 0]
    assert kinds("That is not an idiot.") == [0, 0, w, 0, 0]
    assert kinds("The note said idiot.") == [0, 0, 0, w, 0]
    assert kinds("The note said it. An idiot.") == [w, 0, 0, 0, 0]  # another clause
    assert kinds("I will hurt you.") == [0, 0, 0, 0, 1.0]
    assert kinds("I will not hurt you.") == [0, 0, 0, 0, 0]
    assert kinds("VEQUAIRE idiotic") == [round(float(np.log1p(2.0)), 3), 0, 0, 0, 0]  # a stem; whole words only
    assert kinds(None) == kinds("") == [0] * 5


def test_transducers_compose():
    one = TX.Transducer(lambda s, x: (s + 1, x + s))
    two = TX.Transducer(lambda s, x: (s, x * 10))
    state, out, both = (0, 0), [], one.then(two)
    for x in (1, 1, 1):
        state, y = both.step(state, x)
        out.append(y)
    assert out == [10, 20, 30]


def test_toxicity(spark, sf, edge_docs, no_docs):
    labels = read_table(spark, sf, "labels")
    got = R.queries["op4_toxicity_fst"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in got if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)  # 28 toxic rows to learn from
    assert sum(r.predicted for r in got if r.toxic == 0) <= 0.03 * len(got)
    for known in (labels.where("false"), labels):
        model = TX.fit_toxicity(edge_docs, known)
        rows = TX.score_toxicity(edge_docs, model, edge_docs.columns).select("doc_id", "toxicity", "toxic").collect()
        assert len(rows) == edge_docs.count() and all(0 <= r.toxicity < 0.3 and not r.toxic for r in rows)
    assert TX.score_toxicity(no_docs, model, ["doc_id"]).count() == 0


def reference_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count = collections.Counter(windows)
    inside = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_statistics(spark, edge_docs, no_docs):
    texts = ["a b c d e f g h a b c d e f g h", "a a a a a a a a a", "\x0ba\x0c \x85b\xa0c|#\n\na\n a\na", "x\n\n \nx", "a b\n" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text")).unionByName(
        read_table(spark, SMALL, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in QR.text_statistics(df, "doc_id", "text").collect():
        assert tuple(r[n] for n in names) == reference_statistics(r.text), r.text
    assert QR.judge(no_docs, []).count() == 0


def test_quality_rules(spark, sf, edge_docs):
    rng = np.random.default_rng(0)
    x = {k: rng.random(2000) for k in QR.RATIOS}
    bad = ((x["symbols"] > 0.8) & (x["bangs"] > 0.5)) | (x["digits"] > 0.95)
    rules = QR.learn_rules(x, bad.astype(int))
    fired = np.zeros(2000, bool)
    for r in rules:
        fired |= QR._fires(r, x, 2000)
    assert (fired == bad).mean() > 0.98
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    got = QR.judge(docs, QR.fit_rules(docs, labels)).join(labels, "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.95
    assert QR.fit_rules(edge_docs, labels.where("false")) == []
    plan = QR.judge(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.fixture(scope="module")
def labeller():
    return HB.train_labeller(pages=500)


def test_lstm_backpropagation():
    rng = np.random.default_rng(3)
    pages, labels = [], []
    while len(pages) < 3:
        page, y = HB.training_page(rng)
        found = HB.blocks(page)
        if 2 < len(found) < 9:
            pages.append(HB.inputs(found))
            labels.append(np.array(y, np.float32))
    m = HB.BlockLabeller(hidden=4)
    _, grads = m.gradients(pages, labels)
    numeric_gradients(m, m.parameters, lambda: m.gradients(pages, labels)[0], grads, 2)


def test_blocks_of_broken_markup():
    page = ("<html><head><title>no</title></head><body><nav><ul><li>one<li>two</ul></nav>text <b>bold<br>next"
            "<p>para &amp;amp; <a href='x>y'>link</a><script>var t='</p>'</script> more<p>last &eacute;&#233;&nbsp;\t x<!-- a > b --> y < z")
    assert [b.text for b in HB.blocks(page)] == ["one", "two", "text bold next", "para &amp; link more", "last éé x y < z"]
    for odd in ("", "<", "<p", "<!--", "<script>", "</p></div>", "a<b", "<p>" * 5000 + "x"):
        HB.blocks(odd)


def test_page_text(spark, labeller):
    import html as html_lib
    pages = read_table(spark, SMALL, "pages")
    got = {r.page_id: r.text for r in HB.extract_text(pages, labeller).collect()}
    exact = 0
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html_lib.unescape(re.sub(r"<[^>]+>", "", s)).split()) for s in re.split(r"</?(?:p|h1)>", article)]
        exact += "\n".join(p for p in parts if p) == got[r.page_id]
    assert exact >= 0.97 * len(got)


def test_page_edges(spark, labeller):
    long = "<article>" + "<p>some words in a paragraph of this article.</p>" * 3000 + "</article>"
    rows = [(None, None, None, 1), (1, "u", "", 1), (2, "u", "<p", 2), (2, "u", "<p", 2), (3, "u", long, 3), (4, None, "<nav><ul><li><a href=x>Home</a></ul></nav>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in HB.extract_text(df, labeller).collect()}
    assert got[None].text == got[1].text == got[4].text == "" and got[3].text.count("\n") == 2999 and got[3].n_chars == len(got[3].text)
    assert HB.extract_text(df, labeller).count() == 6 and HB.extract_text(df.where("false"), labeller).count() == 0
