import random

import pytest

WORDS = {
    "en": "the of and thing nation with house over under ring shelter morning would north weather length breath".split(),
    "de": "der die und schule zwischen über straße mädchen nicht haus zeitung schnee recht übung freiheit".split(),
}


def prose(rng, lang, n):
    """Made-up text: common words, and words put together of two of them."""
    own = WORDS[lang]
    out = []
    for i in range(n):
        w = rng.choice(own) if rng.random() < 0.4 else rng.choice(own) + rng.choice(own)
        out.append(w.capitalize() if i % 9 == 0 else w)
        if i % 9 == 8:
            out[-1] += "." + ("\n" if rng.random() < 0.3 else "")
    return " ".join(out)


def make_rows(seed=3, n=60):
    """(doc_id, text, lang, source, extra columns whose names the operators use themselves)."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        rows.append([i, prose(rng, lang, rng.choice((6, 40, 150))), lang, f"src{0 if i % 2 else i % 7}"])
    shared = "This line is found in many of the documents, word for word."
    for i in range(10, 17):
        rows[i][1] += f"\n  {shared if i % 2 else shared.upper()}\t\nlast"
    rows[20][1] = rows[21][1] = rows[22][1]  # exact copies
    base = rows[30][1] = prose(rng, "en", 400)
    near = base.split(" ")
    for k, at in enumerate((17, 205, 333)):
        near[at] = "changed"
        rows[31 + k][1] = " ".join(near)  # near copies
    for i in (20, 21, 22, 30, 31, 32, 33):
        rows[i][2] = "en"
    rows[40][1] = prose(rng, "en", 30000)  # a very long text
    rows[41][1], rows[42][1], rows[43][1] = None, "", "  \n\t "
    rows[44][1] = "--- 12 34 !!!"
    rows[45][2] = rows[46][3] = None
    rows.append(list(rows[5]))  # a repeated row
    rows.append([None, "a row without a number", "en", "src1"])
    rows.append([5, "another text under a number that is taken", "en", "src1"])
    return [(*r, 1, "x", 2.0) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, id int, node string, size double"


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
