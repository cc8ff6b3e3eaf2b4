"""Reading level of each document: classic readability formulas and the median of their grades.

Sentences, words, letters and syllables of the whole text are counted; syllables come from
hyphenation-style patterns of its language, which is guessed from its function words (the language
column is not trusted). Seven published formulas give a school grade each; their median is the
document's grade, which no single formula can move. Cut points on the median grade, one set per
language, turn it into levels 1 to 5; where graders' labels exist, :func:`fit_cuts` places them.

Only what is no prose of the speaker is left out of a text: the speaker's label, and bracketed notes
that record an interruption. Quotations and other brackets are read like the rest.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the cut points are fitted on at most.
MAX_LABELLED = 4_000
#: Weight, in labelled documents, of the school grades that the fitted cut points start from.
PRIOR_WEIGHT = 6.0

# Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": (
        "the of and to is for in that be not by with as it which this are was have has had will would can at from or but an on they we "
        "their there been all no if so its"
    ).split(),
    "fr": (
        "le la les des du et en un une dans pour que ne pas est sur au aux ce cette ces qui par plus avec nous vous il elle ils sont ont "
        "été être leur leurs mais ou se sa son ses"
    ).split(),
    "de": (
        "der die das und den dem des nicht ist mit für von zu im ein eine auf wird werden wurde hat haben sind war als auch an aus bei "
        "nach noch nur oder sich sie wir er es einer einen einem dass"
    ).split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)
# Abbreviations after which a dot ends no sentence.
ABBREVIATIONS = (
    "abs al art bd bzw ca cf ch co doc dok dr drs etc ff fig hon jr ltd mgr mr mrs ms mx nr no nos op p para pp prof "
    "rn s sec sect sen sr st usw v vgl vol vs voir z ziff"
).split()
# What bracketed notes of an interruption say.
INTERRUPTIONS = (
    "applause|laughter|interruption|interjection|noise|disorder|cheers|hear, hear|calls? (?:of|for)|several members|a member|asked to sit down|"
    "point of order|sic|revised transcript|corrected reissue|"
    "applaudissements|rires|brouhaha|exclamations|protestations|mouvements divers|interruptions?|"
    "beifall|heiterkeit|zurufe?|zwischenrufe?|widerspruch|unruhe|lachen"
)
# School grade of LIX and RIX scores, the lowest score of grades 2, 3, ... 13 (Anderson 1983).
LIX_GRADES = (10, 15, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56)
RIX_GRADES = (0.2, 0.5, 0.8, 1.3, 1.8, 2.4, 3.0, 3.7, 4.5, 5.3, 6.2, 7.2)
#: Last school grades of levels 1 to 4: primary, middle and high school, college.
SCHOOL_CUTS = (4.0, 8.0, 12.0, 16.0)

# Syllables, as hyphenation patterns tell them: a digit before a vowel says whether a syllable's nucleus
# starts there (odd) or not (even), the highest digit of all patterns that match wins, a dot is the word's
# edge, C any consonant and V any vowel. Without a pattern the first vowel of a run starts a nucleus.
VOWELS = {"en": "aeiouyàâäéèêëîïôöùûüœæ", "fr": "aeiouyàâäéèêëîïôöùûüœæ", "de": "aeiouyäöüàâéèêëîïôùûœæ"}
PATTERNS = {
    "en": """
        i1a i1o i1u i1i u1a u1o u1u e1o e1u a1o y1a y1e y1i y1o
        ti2a ti2o si2a si2o ci2a ci2o gi2o gi2a xi2o ti2e ci2e sci3ence soci3et e2opl e2ous i1ous. ti2ous. ci2ous. gi2ous.
        qu2a qu2e qu2i qu2o gu2a gu2e gu2i u1ent u1ence u1ity ru1in flu1id
        .2y3a .2y3e .2y3i .2y3o .2y3u
        e1ing. o1ing. i1er. i1est. i1ence i1ety i1et. cre1at e1ality e1ate. o1opera po1e de1a. re1a.
        C4e. bl5e. cl5e. dl5e. fl5e. gl5e. kl5e. pl5e. tl5e. zl5e. C2ed. t3ed. d3ed. C2es. s3es. z3es. x3es. g3es. c3es. h3es. bl5es. pl5es. tl5es.
        C2ely. C2eless C2eness g2ement. at2ement.""",
    "fr": """
        é1a é1â é1o é1i é1u a1ï o1ï a1ë o1ë a1é o1é u1é y1a y1e y1é y1o bri1e cri1e dri1e fri1e gri1e pri1e tri1e vri1e bli1e cli1e pli1e
        C2e. C2es. C2ent. m3ent. i2e. i2es. é2e. é2es.""",
    "de": "i1o i1a i1u q2u3a q2u3e q2u3i q2u3o .be3ur be3ende ge3ä ge3ehr i3elle i3ent i3enz",
}
#: Vowel pairs of one German syllable; its other pairs are two.
DIGRAPHS = "ei ai ey ay au eu äu ie aa ee oo".split()

_LETTER = "a-zß-öø-ɏͰ-ԯ"  # lower-cased Latin, Greek and Cyrillic
_SPEAKER = re.compile(r"\A\s*(?:[A-ZÀ-Þ][\w.'’-]*,?\s+){0,3}[A-ZÀ-Þ][\w.'’-]*\s*(?:\([^()\n]{1,60}\)\s*)?:\s")
_NOTE = rf"[^()\[\]]*\b(?:{INTERRUPTIONS})\b[^()\[\]]*"
_ASIDE = re.compile(rf"\({_NOTE}\)|\[{_NOTE}\]|\[\s*(?:[^\s\[\]:]+\s+){{0,3}}[^\s\[\]:]+:[^\[\]]*\]|\*\*\*[^*\n]*\*\*\*")
_END = re.compile(r"[.!?…]+(?!\w)")
_WORD = re.compile(rf"[{_LETTER}]+(?:[-'’][{_LETTER}]+)*")

FORMULAS = ("flesch_kincaid", "gunning_fog", "smog", "automated", "coleman_liau", "lix", "rix")


class Measures(NamedTuple):
    language: str
    n_sentences: int
    n_words: int
    n_syllables: int
    n_long_syllabic: int
    n_long: int
    n_chars: int


@cache
def _points(language: str) -> tuple[dict[str, tuple[tuple[int, int], ...]], int]:
    """The patterns of a language by their letters, with classes spelled out, and the longest one."""
    vowels = VOWELS[language]
    consonants = [c for c in "abcdefghijklmnopqrstuvwxyzßçñ" if c not in vowels]
    patterns = PATTERNS[language].split()
    if language == "de":
        patterns += [f"{a}1{b}" for a in vowels for b in vowels if a + b not in DIGRAPHS]
    table: dict[str, tuple[tuple[int, int], ...]] = {}
    for p in patterns:
        for letters in consonants if "C" in p else vowels if "V" in p else [""]:
            spelled = p.replace("C", letters).replace("V", letters)
            bare = re.sub(r"\d", "", spelled)
            at = tuple((m.start() - i, int(m[0])) for i, m in enumerate(re.finditer(r"\d", spelled)))
            table[bare] = table.get(bare, ()) + at
    return table, max(map(len, table))


def syllables(word: str, language: str) -> int:
    """Syllables of a lower-case word: its nuclei by the language's patterns, at least one."""
    vowels, (table, longest) = VOWELS[language], _points(language)
    w = f".{word}."
    starts = [0] * len(w)
    for i in range(1, len(w) - 1):
        if w[i] in vowels and w[i - 1] not in vowels:
            starts[i] = 1
    for i in range(len(w)):
        for j in range(i + 2, min(len(w), i + longest) + 1):
            for k, digit in table.get(w[i:j], ()):
                starts[i + k] = max(starts[i + k], digit)
    return max(1, sum(s & 1 for s, c in zip(starts, w) if c in vowels))


_abbreviated, _function_words = frozenset(ABBREVIATIONS), {x: frozenset(w) for x, w in FUNCTION_WORDS.items()}
#: Per language: (syllables, three or more of them, more than six letters, letters) of words met before.
_known: dict[str, dict[str, tuple[int, bool, bool, int]]] = {x: {} for x in LANGUAGES}


def _sentences(prose: str) -> int:
    """Stretches between sentence ends that have a word. A line's end is one too; a dot after an
    abbreviation, between letters (e.g.) or digits is none."""
    n, open_ = 0, False
    for s in _END.split(prose.replace("\n", ".\n")):
        last = s.rsplit(None, 1)[-1:]
        if last:
            open_ = open_ or _WORD.search(s) is not None
            if open_ and last[0] not in _abbreviated and "." not in last[0].strip("."):
                n, open_ = n + 1, False
    return n + open_


def measure(text: str | None) -> Measures:
    """Counts of a whole text; null, empty and wordless texts count nothing and are called ``en``."""
    prose = text or ""
    if ":" in prose[:200]:
        prose = _SPEAKER.sub(" ", prose, count=1)
    prose = prose.lower()
    if "(" in prose or "[" in prose or "*" in prose:
        prose = _ASIDE.sub(" ", prose)
    seen = Counter(_WORD.findall(prose))
    language = max(LANGUAGES, key=lambda x: sum(seen[w] for w in _function_words[x] if w in seen))
    known = _known[language]
    if len(known) > 500_000:
        known.clear()
    n_words = n_syl = n_poly = n_long = n_chars = 0
    for w, n in seen.items():
        k = known.get(w)
        if k is None:
            s = syllables(w, language)
            k = known[w] = (s, s >= 3, len(w) > 6, len(w))
        n_words += n
        n_syl += n * k[0]
        n_poly += n * k[1]
        n_long += n * k[2]
        n_chars += n * k[3]
    return Measures(language, _sentences(prose), n_words, n_syl, n_poly, n_long, n_chars)


def _scale(score: float, bounds: tuple[float, ...]) -> float:
    """School grade of a score whose grades 2, 3, ... begin at ``bounds``: linear in between, and beyond
    the ends as steep as in the last grade there."""
    i = min(max(bisect_right(bounds, score), 1), len(bounds) - 1)
    return i + 1 + (score - bounds[i - 1]) / (bounds[i] - bounds[i - 1])


def grades(m: Measures) -> list[float]:
    """School grades by the seven formulas, in the order of FORMULAS; 0 for a text without words."""
    if not m.n_words:
        return [0.0] * len(FORMULAS)
    n_sentences = max(1, m.n_sentences)
    per_sentence, per_word = m.n_words / n_sentences, m.n_syllables / m.n_words
    poly, long_, chars = m.n_long_syllabic / m.n_words, m.n_long / m.n_words, m.n_chars / m.n_words
    return [
        0.39 * per_sentence + 11.8 * per_word - 15.59,
        0.4 * (per_sentence + 100 * poly),
        1.043 * math.sqrt(30 * poly * per_sentence) + 3.1291,
        4.71 * chars + 0.5 * per_sentence - 21.43,
        5.88 * chars - 29.6 / per_sentence - 15.8,
        _scale(per_sentence + 100 * long_, LIX_GRADES),
        _scale(m.n_long / n_sentences, RIX_GRADES),
    ]


def median_grade(m: Measures) -> float:
    return sorted(grades(m))[len(FORMULAS) // 2]


PROFILE = "language string, n_sentences int, n_words int, n_syllables int, " + ", ".join(f"{f} double" for f in FORMULAS) + ", median_grade double"


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` with counts, the seven grades and their median for every row of ``docs``."""

    @F.pandas_udf(PROFILE)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PROFILE.split(", ")]
        for texts in batches:
            rows = []
            for t in texts:
                m = measure(t)
                rows.append((m.language, m.n_sentences, m.n_words, m.n_syllables, *grades(m), median_grade(m)))
            yield pd.DataFrame(rows, columns=names)

    once = measured.asNondeterministic()
    return docs.select(F.col(id_col), once(F.col(text_col)).alias("m")).select(id_col, "m.*")


#: Per language the four median grades above which levels 2, 3, 4 and 5 begin.
Cuts = dict[str, tuple[float, ...]]


def best_cut(grade: np.ndarray, above: np.ndarray, weight: np.ndarray) -> float:
    """The grade at which cutting puts the least weight on the wrong side: ``above`` is the share of a
    text's graders who put it above. Of equally good places the middle one is taken."""
    order = np.argsort(grade, kind="stable")
    g, a, w = grade[order], above[order], weight[order]
    wrong = np.concatenate([[0.0], np.cumsum(w * a)]) + np.concatenate([np.cumsum((w * (1 - a))[::-1])[::-1], [0.0]])
    edges = np.concatenate([[g[0] - 1], (g[1:] + g[:-1]) / 2, [g[-1] + 1]])
    possible = np.concatenate([[True], g[1:] > g[:-1], [True]])
    best = np.flatnonzero(possible & (wrong <= wrong[possible].min() + 1e-9))
    return float(edges[best[len(best) // 2]])


def fit_cuts(languages: list[str], medians: list[float], counts: list[list[int]], prior_weight: float = PRIOR_WEIGHT) -> Cuts:
    """Cut points from labelled texts: their language, median grade, and how often each of the grades 1
    to 5 was given to them. A text weighs the same however many graders it had.

    Every language starts from evenly spread texts of the school grades 0 to 20, graded by SCHOOL_CUTS,
    of ``prior_weight`` together; the rule is the same with many labels, few, or none.
    """
    base = np.arange(0.25, 20, 0.5)
    language, median = np.array(languages, dtype=object), np.array(medians, dtype=float)
    given = np.array(counts, dtype=float).reshape(len(languages), 5)
    share = given / np.maximum(given.sum(1, keepdims=True), 1)
    cuts: Cuts = {}
    for x in LANGUAGES:
        mine = (language == x) & (given.sum(1) > 0)
        grade = np.concatenate([base, median[mine]])
        weight = np.concatenate([np.full(len(base), prior_weight / len(base)), np.ones(int(mine.sum()))])
        found = [best_cut(grade, np.concatenate([base > SCHOOL_CUTS[j], share[mine, j + 1 :].sum(1)]), weight) for j in range(4)]
        cuts[x] = tuple(float(c) for c in np.maximum.accumulate(found))
    return cuts


def level_of(m: Measures, cuts: Cuts) -> int:
    """Level 1 to 5; a text without words is level 1."""
    return 1 + sum(median_grade(m) > c for c in cuts[m.language]) if m.n_words else 1


def fit_levels(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED
) -> Cuts:
    """Cut points from the labels (``doc_id, grader, grade``): repeated rows count once, null grades and
    grades outside 1 to 5 not at all. Of the labelled documents ``max_labelled`` are used, chosen by a
    hash of their id; only their language and median grade are collected. Texts without words are left out."""
    given = labels.filter("grade BETWEEN 1 AND 5").select(F.col("doc_id").alias("id"), "grader", "grade").distinct()
    per_doc = given.groupBy("id").agg(F.array(*[F.count_if(F.col("grade") == g) for g in range(1, 6)]).alias("grades"))
    chosen = per_doc.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id")  # max_labelled rows

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ms = [measure(t) for t in pdf.t]
            out = pd.DataFrame({"id": pdf.id, "language": [m.language for m in ms], "median": [median_grade(m) for m in ms], "grades": pdf.grades})
            yield out[[m.n_words > 0 for m in ms]]

    sample = sorted(rows.mapInPandas(measured, "id long, language string, median double, grades array<long>").collect(), key=lambda r: r.id)
    return fit_cuts([r.language for r in sample], [r.median for r in sample], [list(r.grades) for r in sample])


def levels(docs: DataFrame, cuts: Cuts, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, language, median_grade, level`` for every row of ``docs``; one pass over the texts.

    Null, empty and wordless texts have grade 0 and level 1; repeated rows are rows of their own."""

    @F.pandas_udf("language string, median_grade double, n_words int")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            ms = [measure(t) for t in texts]
            yield pd.DataFrame({"language": [m.language for m in ms], "median_grade": [median_grade(m) for m in ms], "n_words": [m.n_words for m in ms]})

    # Not deterministic for the optimizer: a filter on the level must not run the function twice.
    once = measured.asNondeterministic()
    rows = docs.select(F.col(id_col), once(F.col(text_col)).alias("m")).select(id_col, "m.language", "m.median_grade", "m.n_words")
    above = lambda x: sum(((F.col("median_grade") > F.lit(c)).cast("int") for c in cuts[x]), F.lit(1))
    level = F.lit(1)
    for x in LANGUAGES:
        level = F.when(F.col("language") == x, above(x)).otherwise(level)
    return rows.select(id_col, "language", "median_grade", F.when(F.col("n_words") > 0, level).otherwise(1).alias("level"))
