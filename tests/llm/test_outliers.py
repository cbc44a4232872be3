import random
from collections import Counter

import numpy as np

from glyphgrid.llm import outliers


def brute_counts(text):
    words = outliers.WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if outliers.WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_counts():
    rng = random.Random(1)
    for text in ["", " \n", "a", "a b c a b c"] + ["".join(rng.choice(["a ", "b ", "c", "\n", "\t", "#", "é "]) for _ in range(60)) for _ in range(200)]:
        assert outliers.counts(text) == brute_counts(text)


def test_chi_square():
    assert abs(outliers.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3


def test_mcd_ignores_a_far_minority():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(10, 2, (400, 5)).round(), np.full((100, 5), 23.0)])
    cells, weight = np.unique(x, axis=0, return_counts=True)
    centre, _ = outliers.mcd(cells, weight)
    assert np.abs(centre - 10).max() < 1


def test_documents(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(80)), "en", "s", 1) for i in range(300)]
    rows += [(900 + i, " ".join(word() + "$$$" for _ in range(80)), "en", "s", 1) for i in range(20)]
    rows += [(1000, None, None, None, 1), (1001, "", "en", None, 1), (1002, "a b " * 5000, "en", "s", 1), (None, " ".join(word() for _ in range(60)), "xx", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: r for r in outliers.verdicts(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(300)) and not any(got[900 + i].kept for i in range(20))
    assert all(got[i].base_failed for i in (1000, 1001, 1002)) and got[None].kept
    for i, text, *_ in rows:
        assert tuple(got[i][c] for c in outliers.COUNTS) == brute_counts(text or "")
    assert outliers.verdicts(docs.limit(0)).count() == 0


def test_long_words_are_told_apart(spark):
    """Mean word lengths over 14 characters, as of scripts without spaces, are levels of their own."""
    text = lambda i, size: " ".join(f"{chr(0x4E00 + (37 * i + k) % 5000)}{i}x{k}".ljust(size + (i + k) % 5, chr(0x4E00 + i)) for k in range(60))
    rows = [(i, text(i, 28), "zh", "s") for i in range(120)] + [(120, text(120, 900), "zh", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.verdicts(docs).collect()}
    assert not got[120].base_failed and not got[120].kept and all(got[i].kept for i in range(120))
    assert outliers.points([outliers.cell(text(120, 900), outliers.counts(text(120, 900)))])[0][0] == 58


def test_verdicts_against_a_plain_fit(spark):
    """The whole rule over again in numpy: cells, estimates that lean on their language's, distances, the quantile."""
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 5 + k)))
    rows = []
    for i in range(420):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("de", "a"), (None, "c"), ("fr", None)])
        words = [word(len(source or "xxx") * 2) + rng.choice(["", "", "", ".", "$$", "7"]) for _ in range(70)]
        rows.append((i, " ".join(words), lang, source))
    rows += [(900 + i, " ".join(word(3) + "$#%&" * 6 for _ in range(60)), "en", "a") for i in range(6)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted((r.doc_id, r.kept) for r in outliers.verdicts(docs).collect())
    cells = [(r, outliers.cell(r[1], outliers.counts(r[1]))) for r in rows]

    def fit(part):
        values, weight = np.unique([c for _, c in part], return_counts=True)
        return (*outliers.mcd(outliers.points(values), weight), len(part))

    blend = lambda own, over: tuple(own[2] / (own[2] + outliers.LEAN) * o + outliers.LEAN / (own[2] + outliers.LEAN) * p for o, p in zip(own[:2], over[:2]))
    whole = fit(cells)
    limit = outliers.chi_square_quantile(1 - outliers.TAIL, outliers.DIMS)
    expected = []
    for row, c in cells:
        lang = fit([x for x in cells if x[0][2] == row[2]])
        own = fit([x for x in cells if x[0][2:] == row[2:]])
        centre, cov = blend(own, blend(lang, whole))
        off = outliers.points([c])[0] - centre
        expected.append((row[0], bool(round(off @ np.linalg.inv(cov) @ off, 6) <= limit)))
    assert got == sorted(expected) and not all(k for _, k in expected)
