import re

from pyspark.sql import functions as F

from gridmine.llm import line_rules as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p for at in grams.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_base_figures(docs, rows):
    got = L.quality_digest(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(d), *plain(t)) for d, t, _ in rows)


def test_longer_texts_sort_pairs(docs, rows, monkeypatch):
    monkeypatch.setattr(L, "_PACKED_BITS", 4)
    got = L.quality_digest(docs).select("doc_id", "n_repeat_words").collect()
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(d), plain(t)[4]) for d, t, _ in rows)


def test_rules(spark):
    lines = {
        "A plain sentence that simply ends as it should.": None,
        "A long line without any mark at its end stays": None,
        "Home": "navigation",
        "Home | News | About | Contact us here.": "navigation",
        "Buy ### now *** cheap $$$ fast &&&": "symbols",
        "WOW!! SO!! GOOD!! YES!!": "shouting",
        "All rights reserved by someone or other.": "boilerplate",
        "word word word word word word.": "monotony",
        "Short but done.": None,
        "«Ja.»": None,
    }
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    got = df.select("line", L.failed_rule(F.col("line"), L.words(F.col("line"))).alias("rule")).collect()
    assert {r["line"]: r["rule"] for r in got} == lines


def test_cleaning(spark):
    good = " ".join(f"word{k}" for k in range(60)) + "."
    menu = "\n".join(f"Menu | item{k} | x | y" for k in range(30))
    df = spark.createDataFrame([(1, f"Home\n{good}\n\nAll rights reserved.", "a"), (2, f"{good}\n{menu}", "b"), (3, good, "c"), (4, None, "d"), (5, "few words.", "e")], "doc_id long, text string, _judged string")
    kept = {r["doc_id"]: r["text"] for r in L.cleaned_documents(df.drop("_judged")).collect()}
    assert kept == {1: good, 3: good}
    assert L.cleaned_documents(df.drop("_judged")).columns == ["doc_id", "text"]


def test_empty_table(no_docs):
    assert L.quality_digest(no_docs).collect() == []


def test_equal_hashes_of_unlike_windows(docs, rows, monkeypatch):
    monkeypatch.setattr(L, "_PACKED_BITS", 57)  # seven bits of the hash are left
    got = L.quality_digest(docs).select("doc_id", "n_repeat_words").collect()
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(d), plain(t)[4]) for d, t, _ in rows)
