"""Readability: syllables and counts on known texts, cut points, held-out accuracy, odd inputs."""

import statistics

import numpy as np
import pytest

from keyweave.llm import readability as R


WORDS = {
    "en": "house 1 table 2 little 2 rejected 3 funded 2 places 2 agency 3 constitutional 5 appropriation 5 the 1 made 1 shared 1 people 2 society 4 "
    "science 2 patience 2 quiet 2 language 2 various 3 being 2 safely 2 government 3 create 2 reality 4 annual 3 equal 2 medium 3 beyond 2 year 1 "
    "united 3 boxes 2 churches 2 worked 1 economic 4 area 3 region 2 special 2 experience 4 statement 2 easier 3 rhythm 1 nth 1",
    "fr": "école 2 travaux 2 communes 2 gardent 1 subsidiarité 5 nation 2 année 2 réalité 4 maïs 2 ouvrier 3 voyage 2 gouvernement 4 vie 1 théâtre 2 que 1 eau 1",
    "de": "schule 2 brücke 2 räume 2 verhältnismäßigkeit 6 arbeit 2 familie 3 nation 3 ministerium 5 quelle 2 beurteilen 4 haus 1 bauen 2 theater 3 boot 1 universität 5",
}


@pytest.mark.parametrize("language", WORDS)
def test_syllables(language):
    words = WORDS[language].split()
    assert {w: R.syllables(w, language) for w in words[::2]} == {w: int(n) for w, n in zip(words[::2], words[1::2])}


def test_measure_leaves_out_labels_and_interruptions_only():
    m = R.measure("Mx Fen: We like the park. (Several Members: No!) See Art. 12 para. 3. The fee is 3.4 per cent [sic].\nHe said (twice) it is “indemnification”!")
    assert m == R.measure("We like the park. See Art 12 para 3. The fee is 34 per cent. He said twice it is indemnification!")
    assert (m.language, m.n_sentences, m.n_words) == ("en", 4, 18)
    assert R.measure("*** noise in the gallery *** [Mx Harstane: Never!] (Beifall) (Rires)") == R.measure("")


@pytest.mark.parametrize("a,b", ["“”", "()", "«»", "„“", "[]"])
def test_a_quoted_text_is_graded_as_one_without_quotes(a, b):
    text = "The fiduciary subsidiarity of contingent instruments attenuates the equalisation of delegated expenditure. It is so."
    assert R.measure(a + text + b) == R.measure(text)


def test_formulas_on_a_counted_text():
    m = R.Measures("en", 5, 100, 150, 10, 20, 450)
    want = [0.39 * 20 + 11.8 * 1.5 - 15.59, 0.4 * 30, 1.043 * (30 * 0.1 * 20) ** 0.5 + 3.1291, 4.71 * 4.5 + 10 - 21.43, 5.88 * 4.5 - 1.48 - 15.8, 9, 9 + 0.3 / 0.8]
    assert R.grades(m) == pytest.approx(want)
    assert R.median_grade(m) == pytest.approx(statistics.median(want))


def test_cut_points():
    none = R.fit_cuts([], [], [])
    assert all(none[x] == pytest.approx(R.SCHOOL_CUTS, abs=0.26) for x in R.LANGUAGES)
    n = 300
    grade = [30 * i / n for i in range(n)]
    given = [[int(k == min(4, int(g // 6))) for k in range(5)] for g in grade]
    fitted = R.fit_cuts(["de"] * n, grade, given)
    assert fitted["de"] == pytest.approx((6, 12, 18, 24), abs=0.2) and fitted["en"] == none["en"]
    assert R.best_cut(np.array([1.0, 1, 1, 2]), np.array([0, 1, 1, 1.0]), np.ones(4)) == 0.0


def test_odd_texts(spark):
    texts = [None, "", "...", "42", "Ja.", "word " * 100_000, "(" * 5_000, "“" * 5_000 + "a b c.", "日本語のテキスト", "a.b.c" * 10_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as level", "'x' as m")
    got = {r.doc_id: r for r in R.levels(df, R.fit_cuts([], [], [])).collect()}
    assert len(got) == len(texts) and all(1 <= r.level <= 5 for r in got.values())
    assert all(got[i].level == 1 and got[i].median_grade == 0 for i in (0, 1, 2, 3))
    prof = {r.doc_id: r for r in R.profile(df).collect()}
    assert prof[5].n_words == 100_000 and prof[0].n_words == 0
    for i, r in prof.items():
        assert r.median_grade == pytest.approx(got[i].median_grade)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, grader string, grade int, graded_at timestamp")
    cuts = R.fit_levels(docs, labels)
    assert cuts == R.fit_cuts([], [], [])
    assert R.levels(docs, cuts).collect() == [] and R.profile(docs).collect() == []


def test_held_out_accuracy(spark):
    """Fitted on two thirds of the labelled documents, tested on the rest."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    model = R.fit_levels(docs, labels.filter("doc_id % 3 <> 0"))
    held = labels.filter("doc_id % 3 = 0 AND grade IS NOT NULL").select("doc_id", "grader", "grade").distinct()
    given = {}
    for r in held.collect():
        given.setdefault(r.doc_id, []).append(r.grade)
    got = {r.doc_id: r.level for r in R.levels(docs.join(held.select("doc_id").distinct(), "doc_id"), model).collect()}
    sure = [i for i, g in given.items() if len(g) > 1 and len(set(g)) == 1]
    assert len(sure) > 80
    assert np.mean([(got[i] >= 4) == (given[i][0] >= 4) for i in sure]) >= 0.96
    assert np.mean([got[i] == given[i][0] for i in sure]) >= 0.75
    hard = [i for i in sure if given[i][0] >= 4]
    assert np.mean([got[i] >= 4 for i in hard]) >= 0.85  # short words of law look easy to every formula


def test_labels_are_cleaned(spark):
    docs = spark.createDataFrame([(i, "The cat sat here. " * (i + 1), "x", 1) for i in range(4)], "doc_id long, text string, grade string, id int")
    rows = [(0, "a", 1), (0, "a", 1), (1, "a", None), (2, "b", 9), (3, None, 2), (7, "a", 3)]
    labels = spark.createDataFrame(rows, "doc_id long, grader string, grade int")
    clean = spark.createDataFrame([(0, "a", 1), (3, "c", 2)], "doc_id long, grader string, grade int")
    assert R.fit_levels(docs, labels) == R.fit_levels(docs, clean)
