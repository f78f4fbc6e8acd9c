"""Models, extraction and pieces: held-out accuracy, exact round trips, brute force, edge cases."""

import html as entities
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import html, langid, pieces, quality, toxicity
from assay.llm.shared import fold, pieces as parts_of

SYLLABLES = {"aa": "ka lo mi ne tu".split(), "bb": "sch ung ber ver keit".split()}


def prose(rng, lang, n=60, extra=()):
    words = ["".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n)] + list(extra)
    rng.shuffle(words)
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(11)
    docs, labels = [], []
    for i in range(400):
        lang = ("aa", "bb")[i % 2]
        toxic, junk = i % 5 == 1, i % 7 == 2
        text = prose(rng, lang, 60, ["grumbo", "vilka"] if toxic else ())
        if junk:
            text = " ".join(w + "$$$" for w in text.split())
        docs.append((i, text, lang))
        labels.append((i, int(not junk), int(toxic)))
    odd = [(1000, None, None), (1001, "", "aa"), (1002, "123 !!!", "bb"), (None, "kalomi netu", None), (1003, "mine " * 40_000, "aa"), (1003, "mine " * 40_000, "aa")]
    docs = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("id", F.lit(0)).withColumn("x", F.lit(0))
    return docs.cache(), spark.createDataFrame([*labels, (None, None, None)], "doc_id long, quality int, toxic int").cache()


def test_language(spark, corpus):
    docs, _ = corpus
    chain = langid.train_langid(docs.where(fold(F.col("doc_id"), 4) != 2))
    got = {r["id"]: r for r in langid.identify(docs, chain).collect()}
    assert len(got) == 405
    held = [i for i in range(400) if got[i]["lang_pred"] == ("aa", "bb")[i % 2]]
    assert len(held) == 400
    for i in (1000, 1001, 1002):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[1003]["lang_pred"] == "aa" and got[1003]["n_words"] == 40_000
    assert all(0 <= r["score"] <= 1 for r in got.values())
    mixed = "kalomi netumi lokane " * 5 + "verungkeit berschung keitver " * 2
    assert langid.label_texts([mixed], chain)[0] == ["aa"] and 0.5 < langid.label_texts([mixed], chain)[1][0] < 0.95
    assert langid.train_langid(docs.limit(0)).langs == []
    assert [r["lang_pred"] for r in langid.identify(docs.limit(1), langid.fit([])).collect()] == ["und"]
    assert langid.identify(docs.limit(0), chain).count() == 0


@pytest.mark.parametrize("run", [64, 3, 2, 1])
def test_forward_backward_equals_enumeration(monkeypatch, run):
    """A text is one chain whatever the length of the runs it is computed in."""
    from itertools import product

    monkeypatch.setattr(langid, "CHAIN", run)

    rng = np.random.default_rng(0)
    chain = langid.Chain(["a", "b", "c"])
    e, moves, texts = rng.normal(size=(10, 3)), rng.normal(size=(3, 3)), np.array([6, 0, 1, 3])
    got, moved = chain.marginals(e, texts, moves, pairs=True)
    want = np.zeros((3, 3))
    for at, n in ((0, 6), (6, 1), (7, 3)):
        p, pair = np.zeros((n, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=n):
            w = np.exp(sum(e[at + i, s] for i, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            for i, s in enumerate(path):
                p[i, s] += w
                if i:
                    pair[path[i - 1], s] += w
        assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True))
        want += pair / p[0].sum()
    assert np.allclose(moved, want)


def test_words_are_runs_of_letters():
    letters, lengths = langid.words_of("Ab1é_𐐀 ß日本")
    assert lengths.tolist() == [2, 1, 1, 3] and "".join(map(chr, letters[:3])) == "abé"


def test_quality(spark, corpus):
    docs, labels = corpus
    model = quality.train_quality(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    got = {r["id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 7 != 2) for i in range(400)) and all(0 <= s <= 1 for s in got.values())
    assert quality.score_quality(docs.limit(0), model).count() == 0
    assert 0 <= quality.score_quality(docs.limit(1), quality.train_quality(docs.limit(0), labels)).first()["score"] <= 1


def test_trees_in_arrays_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    t = quality.grow(x, y, trees=30, depth=3)
    assert (((t.predict(x) > 0.5) == y).mean()) > 0.97
    inner = t.feature.shape[1]
    for row in x[:20]:
        m = t.base
        for f, c, v in zip(t.feature, t.threshold, t.value, strict=True):
            k = 0
            while k < inner:
                k = 2 * k + 1 + (row[f[k]] > c[k])
            m += v[k - inner]
        assert abs(m - t.margin(row[None])[0]) < 1e-9


def test_toxicity(spark, corpus):
    docs, labels = corpus
    fitted = toxicity.train_toxicity(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    got = {r["id"]: r["score"] for r in toxicity.score_toxicity(docs, fitted).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 1) for i in range(400)) and all(0 <= s <= 1 for s in got.values())
    assert got[1000] == got[1001] < 0.5
    # an inflected form nobody has seen is told by its stem
    assert fitted.model.ratio("grumboka") > fitted.model.ratio("kalomine") + 1
    kept = toxicity.drop_toxic(docs, fitted)
    assert kept.columns == docs.columns and kept.count() == 406 - 80
    assert toxicity.drop_toxic(docs.limit(0), fitted).count() == 0
    none = toxicity.train_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs.limit(2), none).count() == 2


def test_toxicity_counts_every_word_type(spark, monkeypatch):
    rows = [(i, f"plain {'grumbo' if i % 2 else 'kalo'}{chr(97 + i // 26)}{chr(97 + i % 26)}", i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "PART", 50)
    got = toxicity.train_toxicity(docs, labels).model
    words = sorted({w for _, t, _ in rows for w in t.split()})
    want = toxicity.KneserNey(words, *[[sum(w in t.split() and y == label for _, t, y in rows) for w in words] for label in (1, 0)])
    assert got.seen.keys() == want.seen.keys() and got.missing.keys() == want.missing.keys()
    assert all(got.seen[g] == pytest.approx(want.seen[g]) for g in want.seen)
    assert got.ratio("grumbozz") > 1 > -1 > got.ratio("kalozz")


def test_class_models_are_distributions():
    model = toxicity.KneserNey(["bad", "bat", "cat"], [3, 0, 1], [0, 4, 4])
    assert model.ratio("bad") > 0 > model.ratio("cat") and model.ratio("qqq") == pytest.approx(model.ratio("qqz"))


def naive_ratio(words, toxic, ordinary):
    """log P(word | toxic) - log P(word | ordinary), straight from the definition of interpolated Kneser-Ney."""
    places = [(f"\x02{w}\x03", i) for w in words for i in range(1, len(w) + 2)]
    histories = [(s[max(0, i - 5) : i], s[i]) for s, i in places]
    followers = Counter((h[k:], x) for h, x in histories for k in range(len(h) + 1))
    letters = {x for _, x in histories}

    def shared(h, x):
        lower = shared(h[1:], x) if h else 1 / (len(letters) + 1)
        after = [n for (g, _), n in followers.items() if g == h]
        return (max(followers[h, x] - 0.75, 0) + 0.75 * len(after) * lower) / sum(after) if after else lower

    def chance(counts, h, x):
        n = Counter()
        for word, c in zip(words, counts, strict=True):
            s = f"\x02{word}\x03"
            for i in range(1, len(s)):
                n[s[max(0, i - 5) : i], s[i]] += c
        after = [c for (g, _), c in n.items() if g == h and c]
        return (max(n[h, x] - 0.75, 0) + sum(min(c, 0.75) for c in after) * shared(h[1:], x)) / sum(after) if after else shared(h[1:], x)

    def ratio(word):
        s = f"\x02{word}\x03"
        return sum(np.log(chance(toxic, s[max(0, i - 5) : i], s[i])) - np.log(chance(ordinary, s[max(0, i - 5) : i], s[i])) for i in range(1, len(s)))

    return ratio


def test_class_models_equal_the_definition():
    words, toxic, ordinary = ["grumbo", "grumbly", "stone", "tone", "a", "grumbo's".replace("'", ""), "überall"], [4, 1, 0, 2, 3, 1, 0], [0, 1, 5, 2, 9, 0, 1]
    model, want = toxicity.KneserNey(words, toxic, ordinary), naive_ratio(words, toxic, ordinary)
    for w in [*words, "grumbling", "stoned", "zzz", "grumboo" * 3, "tonal", "g"]:
        assert model.ratio(w) == pytest.approx(want(w), abs=1e-9)


def test_scores_equal_the_definition(spark):
    """Training, then every score, by hand from the definition: log ratios of all words and of the 1, 3 and 8 largest."""
    rows = [(i, f"alpha beta {'gruk' + 'aeiou'[i % 5] if i % 3 == 0 else 'rest'} gamma {'x' * (i % 4)}", int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(90, "Grukel ÄLPHA2beta"), (91, None), (92, "12 !")], "doc_id long, text string")
    fitted = toxicity.train_toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    find = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    words = sorted({w for _, t, _ in rows for w in find(t)})
    ratio = naive_ratio(words, *[[sum(w in find(t) for _, t, y in rows if y == label) for w in words] for label in (1, 0)])
    got = {r["id"]: r["score"] for r in toxicity.score_toxicity(docs, fitted).collect()}
    for i, t in [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] % 7 in (0, 6)] + [(90, "Grukel ÄLPHA2beta"), (91, None), (92, "12 !")]:
        v = sorted((ratio(w) for w in find(t)), reverse=True)
        x = [np.mean(v) if v else 0.0, *[np.mean(v[:k]) if v else 0.0 for k in (1, 3, 8)], np.log1p(len(v))]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(fitted.weights[0] + np.dot(fitted.weights[1:], x)))), abs=1e-9)
    assert got[90] > 0.5


PAGE = "<html><body><nav><a href='/'>Home</a></nav><div class='cookie-banner'>We use cookies</div><div class='{c}'><h1>{t} &amp; more</h1><p>First <b>bo</b>ld<br>line.<p>Second &#8212; 5 < 6.{x}</div><div id='comments'><p>{long}</p></div><footer>foot</footer><script>var a='<p>no</p>';</script></body></html>"


def test_extraction(spark):
    want = "T0 & more First bold line. Second — 5 < 6."
    rows = [(i, f"http://Host{i % 2}.example.org:80/p{i}", PAGE.format(c="story12", t=f"T{i}", x="", long="word " * 200)) for i in range(6)]
    rows += [(10, "http://host0.example.org/x", None), (11, None, ""), (12, "http://lonely.net", "<p>only words &copy;"), (13, "nonsense", "text < with > no tags"), (0, rows[0][1], rows[0][2]), (14, "http://host0.example.org/deep", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("text", F.lit(1)).withColumn("host", F.lit(2))
    got = [(r["id"], r["text"]) for r in html.extract_main_text(pages).collect()]
    assert len(got) == len(rows) and got.count((0, want)) == 2
    got = dict(got)
    assert got[3] == want.replace("T0", "T3") and got[10] == got[11] == "" and got[12] == "only words ©" and got[13] == "text < with > no tags" and got[14] == "deep"
    assert html.extract_main_text(pages.limit(0)).count() == 0


def test_a_host_outvotes_a_page():
    long = "<body><main><p>Story text that is the article.</p></main><div class='x1'><p>" + "Other words on one page only. " * 30 + "</p></div></body>"
    assert html.extract(long, ["/body/main"]) == html.extract(long, ["/body/gone", "/body/main"]) == "Story text that is the article."
    assert html.extract(long, ["/body/main", "/body/div.x"]).startswith("Other words")  # its own path is a winner too
    assert html.extract(long, ["/body/gone"]).startswith("Other words") and html.best_path(html.parse(long)[0])[0] == "/body/div.x"


@pytest.mark.parametrize("broken", ["<a href=\"x", "<<<>>>", "</p></p>", "<!-- never closed", "<script>never closed", "&#xZZ; &bogus; &#1114112;", "<p" * 2000, "a<br/>b<hr/>c", "<table><tr><td>1<td>2<tr><td>3</table>", "<ul><li>a<ul><li>b</ul><li>c</ul>"])
def test_broken_markup_is_read(broken):
    assert isinstance(html.extract(broken, None), str)


def test_text_of_tables_and_lists():
    assert html.extract("<table><tr><td>1<td>2<tr><td>3</table><ul><li>a<ul><li>b</ul><li>c</ul>", None) == "1 2 3 a b c"
    assert html.extract("<p>x&nbsp;&nbsp; y\n z<i>w</i></p>", None) == " ".join(entities.unescape("x&nbsp;&nbsp; y z").split()) + "w"


def test_long_paths_keep_their_descendants():
    names = " ".join(f"utility-{chr(97 + i)}" for i in range(26))
    page = f"<body><div class='{names}'><p>{'First words. ' * 9}</p><div class='{names} inner'><p>nested</p><section><p>deeper</p></section></div></div><div class='other'><p>away</p></div></body>"
    got = html.extract(page, [html.best_path(html.parse(page)[0])[0]])
    assert got.endswith("First words. nested deeper") and all(len(c.path) <= 200 for c in html.parse(page)[0])


def test_articles_of_several_containers_are_whole():
    nested = "<body><article><h1>Title</h1><div class='lead'>The lead.</div><div class='text'><p>Long words of the text.</p><p>More.</p></div></article><div class='x'>away</div></body>"
    assert html.extract(nested, None) == "Title The lead. Long words of the text. More."
    assert html.best_path(html.parse(nested)[0])[0] == "/body/article"
    siblings = "<body><div class='post'><section class='a'>One part.</section><section class='b'>Another, longer part.</section></div><div class='x'>away</div></body>"
    assert html.extract(siblings, [html.best_path(html.parse(siblings)[0])[0]]) == "One part. Another, longer part."


def planted_page(rng, template: int) -> tuple[str, str]:
    """A page and the text of its article, which is known as the page is put together."""
    say = lambda n: " ".join(rng.choice(SYLLABLES["aa"]) + rng.choice(SYLLABLES["aa"]) for _ in range(n)).capitalize() + "."
    junk = [
        lambda: f"<nav><ul><li><a href='/a'>{say(2)}</a></li></ul></nav>", lambda: f"<div class='cookie-notice'><p>{say(6)}</p></div>", lambda: f"<aside class='sidebar'><p>{say(30)}</p></aside>",
        lambda: f"<div class='ad-slot ad{rng.integers(9)}'>{say(8)}</div>", lambda: f"<form><label>{say(2)}</label><input></form>", lambda: f"<ul class='shareButtons'><li>{say(1)}</li></ul>",
        lambda: f"<section id='comments'><div class='comment'><p>{say(60)}</p></div></section>", lambda: f"<script>var x = '<p>{say(3)}</p>';</script>", lambda: f"<div role='banner'>{say(4)}</div>",
        lambda: f"<div class='related-posts'><p>{say(9)}</p></div>", lambda: f"<div style='display: none'>{say(5)}</div>", lambda: "<!-- <p>away</p> -->",
    ]
    maybe = lambda: junk[rng.integers(len(junk))]() if rng.random() < 0.5 else ""
    title, parts = say(4), [say(int(rng.integers(12, 40))) for _ in range(int(rng.integers(3, 7)))]
    shapes = ["<p>{}</p>", "<p class='related-work'>{}</p>", "<section id='search-algorithms'><p>{}</p></section>", "<div class='lead'>{}</div>", "<figure><figcaption>{}</figcaption></figure>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<fieldset>{}</fieldset>", "<p>{}<br>"]
    inner = "".join(shapes[rng.integers(len(shapes))].format(x) + (maybe() if template != 2 else "") for x in parts)
    head = f"<header><h1>{title}</h1></header>" if template == 0 else f"<h1>{title}</h1>"
    open_, close = (("<article>", "</article>"), ("<main class='m{}'><div class='story-body'>".format(rng.integers(9)), "</div></main>"), ("<div class='post-content'>", "</div>"))[template]
    page = f"<html><head><title>{title}</title></head><body><header><p>{say(5)}</p></header>{maybe()}{open_}{head}{inner}{close}{maybe()}<footer>{say(7)}</footer></body></html>"
    return page, " ".join([title, *parts])


def test_planted_articles_are_found_whole(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i in range(240):
        page, want[i] = planted_page(rng, int(rng.choice([i % 3, (i + 1) % 3], p=[0.8, 0.2])))
        rows.append((i, f"https://h{i % 3}.example.com/{i}", page))
    got = {r["id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, (rows[wrong[0]][2], got[wrong[0]], want[wrong[0]])


def test_names_tell_boilerplate():
    bad = "ad ad-1 adSlot cookie-banner comment-list related-posts share_buttons site-footer newsletter-signup sidebar widget-area".split()
    good = "related-work search-algorithms advice comment-ca-va notice-period-law navier-stokes shared lead body-text address menuet".split()
    assert all(html._boilerplate_name(x, True) for x in bad) and not any(html._boilerplate_name(x, False) for x in good)
    assert html._boilerplate_name("page-header", False) and not html._boilerplate_name("page-header", True)


needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="the public tokenizer files are not installed")
TEXTS = ["", None, " a", "  a\t\nb ", "▁x", "日本語😀 ▁▁", "hello   world", " ", "  x", "x" * 5000, "The quick brown fox. " * 50, "<s> </s> <0x41>"]


@needs_model
def test_pieces_round_trip(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "no key"), (3, "twice"), (3, "twice")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_pieces", F.lit(0))
    got = pieces.encode_pieces(docs)
    rows = got.collect()
    assert all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in rows) and len(rows) == len(TEXTS) + 3
    assert len({tuple(r["ids"]) for r in rows if r["text"] == "twice"}) == 1
    again = {(r["doc_id"], r["text"]): r["ids"] for r in pieces.encode_pieces(docs.repartition(5)).collect()}
    assert all(again[r["doc_id"], r["text"]] == r["ids"] for r in rows)
    other = pieces.encode_pieces(docs, seed=2).collect()
    assert any(again[r["doc_id"], r["text"]] != r["ids"] for r in other)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(got.where("n_pieces >= 0").drop("text")).where("doc_id < 3 or doc_id > 3").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS) if i != 3)
    assert pieces.encode_pieces(docs.limit(0)).count() == 0


@needs_model
def test_samples_follow_the_lattice():
    v = pieces.Vocabulary(pieces.read_model(pieces.MODEL), alpha=0.3)

    def segmentations(w):
        if not w:
            yield (), 0.0
        for i in range(1, len(w) + 1):
            if w[:i] in v.piece_id:
                for rest, x in segmentations(w[i:]):
                    yield (v.piece_id[w[:i]], *rest), x + v.weight[w[:i]]

    want = dict(segmentations(" anda"))
    total, n = sum(np.exp(x) for x in want.values()), 60_000
    s = pieces.Sampler(v)
    with np.errstate(over="ignore"):
        ids, per = s.sample([" anda"] * n, np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ends = np.cumsum(per)
    seen: dict = {}
    for a, b in zip(ends - per, ends, strict=True):
        seen[tuple(ids[a:b].tolist())] = seen.get(tuple(ids[a:b].tolist()), 0) + 1
    assert set(seen) <= set(want)
    assert max(abs(seen.get(k, 0) / n - np.exp(x) / total) for k, x in want.items()) < 0.01


@needs_model
def test_samples_of_texts_use_every_piece():
    """Whole texts with runs of spaces, other white space and carriage returns against all segmentations of the text."""
    v = pieces.Vocabulary(pieces.read_model(pieces.MODEL), alpha=0.3)
    for text in ("a    b", "  i;\r\n", "x\t  y"):
        padded = " " + text

        def segmentations(at, padded=padded):
            if at == len(padded):
                yield (), 0.0
            for i in range(at + 1, len(padded) + 1):
                w = padded[at:i]
                ids, x = ((v.piece_id[w],), v.weight[w]) if w in v.piece_id else (tuple(v.byte[b] for b in w.encode()), v.byte_weight * len(w.encode())) if len(w) == 1 else (None, 0.0)
                if ids:
                    for rest, y in segmentations(i):
                        yield (*ids, *rest), x + y

        want: dict = {}
        for k, x in segmentations(0):
            want[k] = want.get(k, 0.0) + np.exp(x)
        total, n = sum(want.values()), 40_000
        seen = Counter(tuple(x.tolist()) for x in pieces.Sampler(v).encode(list(range(n)), [text] * n))
        assert set(seen) <= set(want) and max(abs(seen[k] / n - x / total) for k, x in want.items()) < 0.01
        assert all(pieces.decode_ids(k, v.raw) == text for k in seen)


@needs_model
def test_keys_of_any_type_and_numbered_copies(spark):
    text = "The quick brown fox jumps over the lazy dog. " * 5 + "ab" * 700
    docs = spark.createDataFrame([("k1", text), ("k1", text), ("k1", text), ("k2", text), (None, text)], "doc_id string, text string").coalesce(1)
    plain, numbered = (pieces.encode_pieces(docs, number_copies=flag).collect() for flag in (False, True))
    assert len({tuple(r["ids"]) for r in plain}) == 3 and len({tuple(r["ids"]) for r in numbered}) == 5 and all(r["lossless"] for r in plain + numbered)
    assert numbered[0]["ids"] == plain[0]["ids"] and [r["ids"] for r in numbered] == [r["ids"] for r in pieces.encode_pieces(docs, number_copies=True).collect()]


def test_pieces_of_a_text_lose_nothing():
    text = "ab cd ef " * 100
    assert "".join(parts_of(text, 17)) == text and max(map(len, parts_of(text, 17))) < 40
    assert list(parts_of("")) == []
    spaced = "a" + " " * 50 + "b" * 30 + " c"
    assert list(parts_of(spaced, 5)) == ["a" + " " * 50 + "b" * 30, " c"] and list(parts_of("a\nb c", 1, only=" ")) == ["a\nb", " c"]
