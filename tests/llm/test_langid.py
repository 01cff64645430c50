import random
import zlib

from llm_cases import odd_rows

from curbscope.llm import langid

SYLLABLES = {"en": "the ing tion and er wh ou", "de": "sch ung keit der ein ver ä", "fr": "eau tion é ê les ou ç", "es": "ción ado ez ñ que los ar"}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(40)]
        rows.append((i, " ".join(words), lang if rng.random() < 0.9 else None, "s"))
    return rows


def slow_predict(model, text):
    """The definition, without caches: known words, else the longest n-grams
    that are known."""
    import math

    best = []
    words = langid.WORD.findall((text or "").lower())
    for k, lang in enumerate(model.languages):
        total = 0.0
        for w in words:
            if w in model.logs[0]:
                total += model.logs[0][w][k]
                continue
            for n in range(5, 0, -1):
                own = [model.logs[n][g][k] for g in langid.grams(w, n) if g in model.logs[n]]
                if own:
                    total += sum(own) / len(own)
                    break
        best.append(total)
    if not words or not best:
        return "und", 0.0
    top = max(best)
    return model.languages[best.index(top)], 1 / sum(math.exp(b - top) for b in best)


def test_held_out_accuracy_and_definition(make_docs):
    rows = corpus()
    docs = make_docs(rows)
    got = langid.language_id(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    model = langid.train(docs.where("lang is not null").where(~langid.held_out(docs.doc_id)))
    texts = {i: (t, lang) for i, t, lang, _ in rows}
    right = held = 0
    for r in got.collect():
        text, lang = texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        name, score = slow_predict(model, text)
        assert r.lang_pred == name and abs(r.score - score) < 1e-6 and 0 <= r.score <= 1
        if r.held_out and lang:
            held += 1
            right += r.lang_pred == lang
    assert held > 30 and right / held > 0.97


def test_counts_of_the_model(make_docs):
    model = langid.train(make_docs([(1, "aa aa bb", "x", "s"), (2, "aa cc cc", "y", "s"), (3, None, "x", "s"), (4, "zz", None, "s")]))
    assert model.languages == ["x", "y"]
    assert set(model.logs[0]) == {"aa", "cc"}  # words that occur more than once
    assert model.logs[0]["aa"][0] > model.logs[0]["aa"][1]
    assert {"<aa", "aa>"} <= set(model.logs[3]) and "a" in model.logs[1]


def test_odd_rows(make_docs):
    rows = odd_rows() + [(i + 100, *r) for i, *r in corpus(80)]
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.language_id(make_docs(rows)).collect()}
    for i in (2, 3, 4, 7):
        assert (i, "und", 0.0) in got
    assert langid.language_id(make_docs(rows)).count() == len(rows)
    assert langid.language_id(make_docs([])).count() == 0
    none = langid.language_id(make_docs([(1, "word", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    kept = langid.known_language(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    want = [t for _, t, _, _ in rows if t and langid.words(t)]
    assert sorted(r.text for r in kept.collect()) == sorted(want)


def test_numerals_are_no_letters():
    model = langid.Model(["en"], {0: {"the": [5.0]}})
    assert model.predict("½ ① ² 12") == ("und", 0.0)
    assert model.predict("½ x²")[0] == "en" and model.predict("日本")[0] == "en"


def test_the_stage_keeps_texts_with_letters_when_nothing_can_be_learned(make_docs):
    rows = [(1, "words here", None, "s"), (2, "日本", None, "s"), (3, "12 ½", None, "s"), (4, None, None, "s"), (5, "", None, "s")]
    docs = make_docs(rows)
    out = langid.known_language(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_the_stage_names_the_language_of_rows_without_one(make_docs):
    words = {"en": "the house and the garden are green", "de": "das haus und der garten sind gruen"}
    rows = [(i, words["en" if i % 2 else "de"] + f" w{i}", "en" if i % 2 else "de", "s") for i in range(80)]
    rows += [(100, "the garden and the house", None, "s"), (101, "der garten und das haus", None, "s"), (102, "...", None, "s")]
    docs = make_docs(rows)
    out = langid.known_language(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r.doc_id: r.lang for r in out.collect()}
    assert got == {**{r[0]: r[2] for r in rows[:80]}, 100: "en", 101: "de"}
