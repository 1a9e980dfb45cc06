"""Pages, personal data, language and toxicity."""

import hashlib
import html
import random
import re
import zlib

from shoplytics.llm import language, pages, pii, toxicity
from tests.llm.frames import docs, rows, wider

SF = "/root/testdata/sf0.01"
PAGE = "page_id long, url string, html string"


def text_of(page):
    return pages.trained().text(page)


def test_pages_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in pages.main_text(table).collect()}
    for r in table.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", article))
        want = " ".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_pages_other_layouts():
    page = """<html><head><title>T</title><script>if (a < b) { document.write("<p>no</p>"); }</script></head><body>
    <div class="cookie-banner">We use cookies.</div><header class="top"><a href="/">Logo</a></header>
    <nav><a href="/a">A</a><a href="/b">B</a></nav><div id="page"><main><h1>The&nbsp;title &amp; more</h1>
    <p>First <b>bold</b><i>er</i> words<br>and &#228; line with    blanks that goes on.</p>
    <aside class="sidebar">Other news today.</aside><p>Second paragraph, a short one.</p><p>Ok.</p>
    <div class="advert">Buy now.</div><form action="/s"><p>Your name</p><input name="q"></form></main>
    <section class="comments" id="comments"><h2>Comments</h2><p>I liked this very much, and I say so at length here.</p></section></div>
    <footer>Imprint, 2020</footer><noscript>Turn it on</noscript></body></html>"""
    assert text_of(page) == "The title & more First bolder words and ä line with blanks that goes on. Second paragraph, a short one. Ok."


def test_pages_broken_empty_deep_and_long(spark):
    assert text_of(None) == text_of("") == ""
    assert text_of("<article><p>One<p>Two <b>three") == "One Two three"
    assert text_of("<article>" + "<div>" * 30_000 + "x y z" + "</i></td></div>" * 30_000 + "<li>" * 9) is not None
    long = "word " * 100_000
    assert text_of(f"<article><h1>T</h1><p>{long}</p></article>") == "T " + long.strip()
    for bad in ("<", "<a", "</", "<p", "&", "&#xFFFFFF;", "<!--", "<script>", "\x00", "a < b > c", "<p class='", "<" * 5000):
        assert isinstance(text_of(bad), str)
    df = spark.createDataFrame([(1, None, None), (None, "u", "<article><p>a</p></article>"), (1, None, None)], PAGE)
    got = rows(pages.main_text(wider(df, text="x", n_chars=1, HTML="y")))
    assert sorted((r["n_chars"], r["text"]) for r in got) == [(0, ""), (0, ""), (1, "a")]
    assert rows(pages.main_text(spark.createDataFrame([], PAGE))) == []


# --- personal data

def plain_spans(text):
    """The base kinds straight from their patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c in "0123456789"]
        if 14 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_pii_against_the_patterns():
    rng = random.Random(9)
    bits = ["a@b.c", "@", ".", "x.y", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "256.1.1.1", "10.0.0.1.7", "+1 (319) 555-5132", "+", " ",
            "-", "0", "12", "a", "é", "\n", "b@c", ".d", "%", "300.", "+4930123456", "5500005555555559", "004.010.1.255"]
    for _ in range(4000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == plain_spans(t), t


def test_pii_iban_and_scores():
    t = "my bank account: DE89 3704 0044 0532 0130 00, thanks"
    assert ("iban", 17, 44) in pii.spans(t)
    assert not any(s[0] == "iban" for s in pii.spans(t.replace("89", "88")))
    near, far = "call me at +1 319 555 5132", "x" * 60 + " +1 319 555 5132"
    assert pii.score(near, *pii.spans(near)[0]) > pii.score(far, *pii.spans(far)[0])
    assert pii.score("order no. 4111111111111111", "card", 10, 26) < 0.5


def test_pii_iban_beside_other_upper_case_words():
    es, at, de = "ES9121000418450200051332", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00"
    for t, want in ((f"{es} BIC X", [es]), (f"{at} BIC", [at]), (f"{at} HELLO 1234", [at]), (f"AT611904300234573201 IBAN {at}", ["AT611904300234573201", at]),
                    (f"{at} {de}", [at, de]), (f"REF AB12 CDEF GHIJ {de}", [de]), (f"{at.replace('61', '62')} BIC", [])):
        assert [t[a:b] for k, a, b in pii.spans(t) if k == "iban"] == want, t


def test_pii_many_starts_of_ibans_are_linear():
    pii.spans("AB12 " * 100_000)


def test_pii_long_texts_are_linear():
    for t in ("a" * 500_000, "1" * 500_000, "a." * 200_000 + "@", "+1" * 200_000, "1 " * 200_000, "@a" * 200_000, "+1" + "-" * 400_000):
        pii.spans(t)


def test_pii_rows(spark):
    df = docs(spark, [(1, "x a@b.de +1 319 555 5132"), (1, "x a@b.de +1 319 555 5132"), (None, None), (2, "")], spans="q", found=1, Text="z")
    got = sorted(rows(pii.find_pii(df)), key=lambda r: r["spans"])
    assert [(r["n_email"], r["n_phone"], r["spans"]) for r in got] == [(0, 0, "")] * 2 + [(1, 1, "email:2:8,phone:9:24")] * 2
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows(pii.find_pii(docs(spark, []))) == []
    clean = rows(pii.redacted(docs(spark, [(1, "x a@b.de, +1 319 555 5132!"), (2, None)], found=1)).orderBy("doc_id"))
    assert pii.redacted(docs(spark, [(1, "a")], TEXT="b")).columns[-1] == "TEXT"
    assert (clean[0]["text"], clean[0]["n_chars"], clean[1]["text"]) == ("x [EMAIL], [PHONE]!", 19, None)


def test_pii_over_the_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in rows(pii.find_pii(table)):
        base = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


# --- language

def test_language_on_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lang = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    held = [r for r in rows(language.predict_languages(table)) if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in held if lang[r["doc_id"]]]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_cases(spark):
    made = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 3, None, "en" if i % 2 else "de") for i in range(60)]
    made += [(100, None, None, "en"), (101, "123 !", None, "en"), (102, "", None, None), (103, "the " * 50_000, None, None), (None, "der die", None, "de"), (103, "the", None, None)]
    got = rows(language.predict_languages(docs(spark, made, score=1, lang_pred="x", LANG="q")))
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [by[i][0]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and by[100][0]["score"] == 0
    assert {r["lang_pred"] for r in by[103]} == {"en"} and by[None][0]["lang_pred"] == "de"
    assert len(got) == len(made)
    assert rows(language.predict_languages(docs(spark, []))) == []
    assert [r["lang_pred"] for r in rows(language.predict_languages(docs(spark, [(1, "no labels")])))] == ["und"]


def test_language_takes_letters_beyond_the_basic_plane_only():
    assert language.grams("\U0001F600 \U0001F680\U0001F680") is None
    assert language.grams("\U00010400") is not None and language.grams("\U00020000") is not None
    assert (language.grams("the cat \U0001F600") == language.grams("the cat ")).all()
    model = language.Centroids(["the cat and the dog"] * 5, ["en"] * 5)
    assert model.predict("\U0001F600")[0] == language.UNKNOWN


def test_language_rejects_far_texts():
    model = language.Centroids(["the cat and the dog"] * 5 + ["der hund und die katze"] * 5, ["en"] * 5 + ["de"] * 5)
    assert model.predict("the cat and the dog")[2] is False
    assert model.predict("щука плавает")[2] is True


# --- toxicity

def test_toxicity_on_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score(table, toxicity.fit(table, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / max(1, sum(r.toxic for r in got)) > 0.9
    assert hit / max(1, sum(r.predicted for r in got)) > 0.9


def grammar():
    g = toxicity.Grammar({"idiot": 6.0, "scum": 6.0})
    g.factor = {c: g.prior(c) for c in g.factor}
    return g


def test_grammar_scores_clauses_not_words():
    g = grammar()
    plain, negated = g.score("you are an idiot."), g.score("you are not an idiot.")
    reported, quoted = g.score('she said you are an idiot.'), g.score('the word "idiot" is old.')
    assert plain > max(negated, reported, quoted)
    assert g.score("you are not here. you are an idiot.") == plain  # the negation ends with its clause
    assert g.score("i will kill you.") > g.score("the frost will kill plants.") == g.score("") == g.score(None)
    assert g.score("idiotically, idiots") > g.score("subidiot")


def test_contractions_are_negations():
    g = grammar()
    for a, b in (("he isn't an idiot", "he is not an idiot"), ("they aren’t scum", "they are not scum"), ("i won't kill you", "i will not kill you")):
        assert g.score(a) == g.score(b) < g.score(b.replace("not ", ""))
    assert list(g.read("the ant's idiot")) == [((0, 0, 0, 0), 6.0)]


def _contexts(tokens, stems):
    """The matches of a clause, each from all that stands before it."""
    out = []
    targeted = any(t in toxicity.TARGETS for t in tokens)
    special = toxicity.QUOTES | toxicity.NEGATORS | toxicity.REPORTING | toxicity.ARMING
    for i, t in enumerate(tokens):
        before = tokens[:i]
        context = (int(any(b in toxicity.NEGATORS for b in before)),
                   int(any(b in toxicity.REPORTING for b in before) or sum(b in toxicity.QUOTES for b in before) % 2), int(targeted))
        if t in special:
            continue
        if t in toxicity.THREATS and targeted and any(b in toxicity.ARMING for b in before):
            out.append(((1, *context), toxicity.THREAT_WEIGHT))
        elif any(t.startswith(s) for s in stems):
            out.append(((0, *context), max(w for s, w in stems.items() if t.startswith(s))))
    return out


def test_the_composed_machine_equals_its_definition():
    stems = {"idiot": 6.0, "crush": 2.0, "you": 1.0}
    g = toxicity.Grammar(stems)
    words = ["idiots", "crush", "kill", "you", "not", "said", '"', "i", "will", "stone", "never", "them"]
    rng = random.Random(7)
    for _ in range(3000):
        tokens = [rng.choice(words) for _ in range(rng.randrange(9))]
        assert list(g.read(" ".join(tokens))) == _contexts(tokens, stems)


def test_composition_is_one_machine_after_the_other():
    machines = (toxicity.threat_machine(), toxicity.insult_machine(), toxicity.negation_machine(), toxicity.reported_machine())
    rng = random.Random(8)
    for _ in range(500):
        symbols = [rng.choice((toxicity.TARGETED, toxicity.UNTARGETED))] + [rng.choice(toxicity.WORDS) for _ in range(10)]
        states, whole = [(0, 0), (), 0, (0, 0, 0)], toxicity.START
        for x in symbols:
            whole, got = toxicity.GRAMMAR[whole][x]
            for i, m in enumerate(machines):
                states[i], x = m[states[i]][x]
            assert x == got


def test_personal_data_query_returns_scores(spark):
    from shoplytics.llm import queries
    got = queries.QUERIES["op6_pii"](spark, "/root/testdata/sf0.001").collect()
    assert all(len(r.scores) == (len(r.spans.split(",")) if r.spans else 0) for r in got) and any(r.scores for r in got)


def test_toxicity_cases(spark):
    made = [(i, f"you utter snark{'abc'[i % 3]} and fool of words number{i}" if i % 3 == 0 else f"a kind text with words number{i}") for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(5, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    df = docs(spark, made + [(200, None), (201, ""), (202, "fine " * 50_000), (None, "you utter snarka"), (0, made[0][1])], score=2, toxic=7, Text="x")
    g = toxicity.fit(df, labels)
    got = rows(toxicity.score(df, g))
    assert len(got) == 125 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert all(by[i] == (i % 3 == 0) for i in range(120)) and by[200] == by[201] == by[202] == 0 and by[None] == 1
    left = toxicity.clean(docs(spark, made), labels)
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(120) if i % 3]
    assert {r["score"] for r in rows(toxicity.score(df, toxicity.fit(df, labels.limit(0))))} == {0.0}
    assert rows(toxicity.score(docs(spark, []), g)) == []


def _text(page):
    return " ".join("".join(p) for _, p in pages.Dom(page).runs)


def test_pages_without_a_closed_head():
    article = "<article><h1>Title here</h1><p>" + "Words of the article go on and on. " * 8 + "</p></article>"
    for page in (f"<html><head><title>t</title>{article}", f"<html><head><meta charset=x><style>p</style>{article}</html>",
                 f"<head><title>t</title><body>{article}", f"<title>t</title>{article}", f"<html><head><title>t</title></head>{article}"):
        assert "Title here" in _text(page) and "on and on" in _text(page) and "charset" not in _text(page), page


def test_dropped_elements_without_an_end():
    for tag in ("button", "select", "object", "svg", "canvas"):
        page = f"<body><div><{tag} class=x>Buy now</div><p>First words.</p><{tag}>inner <p>gone</p></{tag}><p>Last words.</p></body>"
        got = _text(page)
        assert "First words." in got and "Last words." in got and "Buy" not in got and "gone" not in got, (tag, got)


def test_stray_quotes_stay_in_their_tag():
    assert _text("<p title=O'Brien>He said</p><p>it's</p>").split() == ["He", "said", "it's"]
    assert _text("<p title=\"a > b\" data-x='<i>'>Text</p>").strip() == "Text"
    assert _text("<p title=\"open>Text</p><p>More</p>").split() == ["Text", "More"]
