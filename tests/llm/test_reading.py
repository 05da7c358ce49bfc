"""What prints, and held-out accuracy of the levels."""

import numpy as np

from treeline.llm import prose, reading

SOURCE = r"""\documentclass{article} % comment with words that never print
\newcommand{\kw}[1]{\textbf{#1}}
\newcommand{\obj}{lamps}
\title{A title that is no prose}
\begin{document}
\begin{abstract}
The \kw{old} \obj{} held the stones~\cite{a,b}. Caf\'e {\it walls} were
warm ($x = \frac{1}{2}$). Die Stra\ss{}e f\"uhrte nach M\'{\i}lan.
\end{abstract}
\section{Heading that is no prose}
\begin{equation} never words here \end{equation}
\iffalse
Words that are off.
\fi
\begin{comment}
More words that are off.
\end{comment}
\begin{thebibliography}{9}\bibitem{a} Some names and words.\end{thebibliography}
\end{document}
Words after the end.
"""


def test_prose():
    s = [" ".join(x) for x in prose.sentences(SOURCE)]
    assert s == ["the old lamps held the stones", "café walls were warm", "die straße führte nach mílan"]
    for t in (None, "", "  \n", r"\input{a} \include{b}", r"\begin{table}\begin{tabular}{rr}1 & 2\end{tabular}\end{table}", "$$x$$ \\[ y \\]"):
        assert prose.sentences(t) == []
    assert prose.sentences("plain words stand here. And 5\\% of them {\\bf are bold") == [["plain", "words", "stand", "here"], ["and", "of", "them", "are", "bold"]]
    assert prose.sentences(SOURCE.replace("\n", "\r\n")) == prose.sentences(SOURCE)


def test_short_sentences_and_long_words():
    assert prose.sentences("I run. You? 12. Fig 3\n\nFine!") == [["i", "run"], ["you"], ["fine"]]
    assert prose.sentences("\\label{x} ab") == []
    long = "a" * 70
    assert set(reading.grams(long + "bcd")) != set(reading.grams(long + "xyz"))


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "Some words stand here. " * (1 + i)) for i in range(20)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "r", 1 + i % 4) for i in range(20)], "doc_id long, rater string, level int")
    all_docs, ratings = reading.rated_sample(docs, labels)
    assert len(all_docs) == 20 and ratings.shape == (20, 4)
    assert len(reading.rated_sample(docs, labels, 5)[0]) == 5
    few, _ = reading.rated_sample(docs, labels, 20, 100)
    assert 0 < sum(len(s) for d in few for s in d) <= 100


def test_fit_in_tasks_is_the_fit(spark):
    rng = np.random.default_rng(1)
    docs = [[words(rng, i % 4) for _ in range(5)] for i in range(24)]
    target = np.eye(4)[np.arange(24) % 4]
    a, b = reading.fit(docs, target), reading.fit(docs, target, reading.in_tasks(spark, docs, target))
    assert np.allclose(a[0].chars, b[0].chars) and np.allclose(a[1].weights, b[1].weights) and set(a[0].words) == set(b[0].words)


def words(rng, level):
    pool = [[f"{a}{b}" for a in "bcd" for b in ("at", "og", "un")], [f"{a}or{b}" for a in ("m", "s") for b in ("ning", "den", "ter")], [f"re{a}or" for a in ("act", "sist", "fract")], [f"electro{a}ization" for a in ("polar", "oxid", "crystal")]]
    return [str(rng.choice(pool[min(3, max(0, level + d))])) for d in rng.choice([-1, 0, 0, 0, 1], size=rng.integers(4, 8 + 2 * level))]


def test_accuracy_and_tables(spark):
    rng = np.random.default_rng(0)
    level = {i: int(rng.integers(4)) for i in range(400)}
    text = {i: " ".join(" ".join(words(rng, v)).capitalize() + "." for _ in range(12)) for i, v in level.items()}
    docs = spark.createDataFrame([*[(i, t, 9) for i, t in text.items()], (900, None, 9), (901, " ", 9), (902, "$$x$$", 9)], "doc_id long, text string, level int")
    labels = spark.createDataFrame([(i, "r", v + 1) for i, v in level.items() if i < 200] + [(5, "s", level[5] + 1), (7, "r", 99), (9999, "r", 1), (None, "r", None)], "doc_id long, rater string, level int")
    got = {r.doc_id: r for r in reading.reading_levels(docs, labels).collect()}
    assert set(got) == set(level)
    assert np.mean([got[i].level == level[i] + 1 for i in range(200, 400)]) > 0.9
    assert reading.reading_levels(docs, labels.limit(0)).count() == 0 and reading.reading_levels(docs.limit(0), labels).count() == 0
