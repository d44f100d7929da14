import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavelattice.llm import leaks
from wavelattice.llm.leaks import Page, Passages, find_leaks, leaks_in, myers, passage_of

PASSAGE = (
    "During the harvest of that remarkable season the travelling merchants from Brindlewick purchased nineteen copper kettles, because nobody in the valley "
    "had remembered to polish the brass ones before the festival of lanterns began beside the crooked river."
)
OTHER = "The committee postponed its meeting until the chairman had recovered from a long illness and the roads were dry again."


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(0, 6))
def test_myers(a, b, most):
    d = levenshtein(a, b)
    assert myers(a, b, most) == (d if d <= most else most + 1)


def test_passage_of():
    assert passage_of("Read the passage below and choose the best answer. " + PASSAGE + "\nQuestion: What?\n(A) x (B) y") == PASSAGE
    assert passage_of("Why did they leave? " + PASSAGE) == PASSAGE and passage_of("Passage: " + PASSAGE) == PASSAGE
    assert passage_of(None) == "" and passage_of("Use only the text to answer.\nQuestion: Why?") == ""


def test_question_inside_passage():
    inner = "The mill stood empty for eleven winters before the brothers bought it. Who would have guessed that the river carried gold past its wheel? Every farmer in the county came to look at the water that spring."
    assert passage_of(inner + "\nQuestion: Who came?\n(A) x") == inner and passage_of("Use only the text to answer. " + inner + " What did they buy?") == inner
    found = Passages([(1, inner + "\nQuestion: Who came?")], 18, 4, 3)
    assert leaked(found, inner) == [1] and leaked(found, " ".join(inner.split()[:25])) == [1] and leaked(found, " ".join(inner.split()[9:27])) == [1]
    begins = "Choose the text below with care, said the old printer to the boy who swept the floor of his shop by the river. " + inner
    assert leaked(Passages([(1, "Passage: " + begins.replace("Choose", "He chose") + "\nQuestion: Who?")], 18, 4, 3), begins.replace("Choose", "He chose")) == [1]


def test_far_apart(passages):
    rows = lines(WORDS[:24])
    rows[2:2] = lines((OTHER * 20).split())  # some eighty lines of other matter
    assert leaked(passages, "\n".join(rows)) == [1, 2]


def test_columns_run_together(passages):
    left, right = lines((OTHER * 2).split(), 4), lines(WORDS, 4)
    page = [f"{a:<40}   {b}" if b else a for a, b in zip(left, [*right, *[""] * len(left)])]
    assert leaked(passages, "\n".join(page)) == [1, 2]
    at = [100 + 20 * i for i in range(len(page))]
    assert leaked(passages, "\n".join(page), [40] * len(page), at) == [1, 2]


@pytest.fixture(scope="module")
def passages():
    return Passages([(1, PASSAGE + "\nQuestion: Why?"), (2, PASSAGE), (3, OTHER.replace("the", "some").replace("committee", "regiment") * 3)], 18, 4, 3)


def lines(words, width=5, sign=None):
    return [" ".join(words[i : i + width]) for i in range(0, len(words), width)]


def leaked(passages, text, x=None, y=None):
    return sorted(leaks_in(passages, text, x, y, 1))


WORDS = PASSAGE.split()


def test_runs(passages):
    head = "Our correspondent writes as follows."
    assert leaked(passages, "\n".join([head, *lines(WORDS)])) == [1, 2]
    assert leaked(passages, "\n".join([head, *lines(WORDS[3:21]), OTHER])) == [1, 2]
    assert leaked(passages, "\n".join([head, *lines(WORDS[3:20]), OTHER])) == []  # seventeen words
    assert leaked(passages, "\n".join(lines([w.upper() for w in WORDS]))) == [1, 2]
    assert leaked(passages, OTHER) == [] and leaked(passages, "") == []


def test_damage(passages):
    misread = [w.replace("e", "c", 1) if i % 4 == 0 else w for i, w in enumerate(WORDS)]
    assert leaked(passages, "\n".join(lines(misread))) == [1, 2]
    one = WORDS[:]
    one[14] = "hundred"
    assert leaked(passages, "\n".join(lines(one[2:24]))) == [1, 2]
    two = WORDS[:24]
    two[8:10] = ["several", "peasants"]
    assert leaked(passages, "\n".join(lines(two))) == []
    broken = "\n".join(["During the harvest of that remar-", "kable season the travel­", "ling merchants from Brindle¬", "wick purchased nineteen copper kettles, because nobody in the val=", "ley had remembered"])
    assert leaked(passages, broken) == [1, 2]


def test_other_matter(passages):
    ad = ["* * * SOAP * * *", "Try it today!", "9s. 4d."]
    rows = lines(WORDS[:24])
    for k in range(len(rows) - 1, 0, -1):
        rows[k:k] = ad
    assert leaked(passages, "\n".join(rows)) == [1, 2]


def test_columns(passages):
    left, right = lines(WORDS, 4), lines((OTHER * 2).split(), 4)
    text, x, y = [], [], []
    for k in range(max(len(left), len(right))):
        for col, side in ((40, left), (400, right)):
            if k < len(side):
                text.append(side[k])
                x.append(col + k % 3)
                y.append(100 + 20 * k)
    assert leaked(passages, "\n".join(text), x, y) == [1, 2]
    assert leaked(passages, "\n".join(text)) == [1, 2]  # boxes missing: lines of other matter in between


def test_query(spark):
    rng = random.Random(1)
    noise = [" ".join(rng.choices(OTHER.split(), k=400)) for _ in range(30)]
    docs = [(10 + i, t, None) for i, t in enumerate(noise)] + [(100, "x " + PASSAGE, None), (100, PASSAGE, None), (101, None, None), (102, "", None), (103, " ".join([OTHER] * 3_000) + PASSAGE, None), (None, PASSAGE, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(1, PASSAGE, 3), (2, None, 3), (3, "short", 3), (None, PASSAGE, 3)], "item_id long, text string, doc_id int")
    got = sorted((r.item_id, r.doc_id) for r in find_leaks(i, d).collect())
    assert got == [(1, 100), (1, 100), (1, 103)]
    assert sorted((r.item_id, r.doc_id) for r in find_leaks(i, d, block_chars=100).collect()) == got  # in blocks
    assert find_leaks(i.limit(0), d).count() == 0 and find_leaks(i, d.limit(0)).count() == 0


def test_each_token_is_read_once(monkeypatch):
    """The letters of a token, and what they may be, are worked out once, however often and on however many pages it stands."""
    words, calls = PASSAGE.split(), []
    passages = Passages([(1, PASSAGE)], 18, 5, 3)
    monkeypatch.setattr(leaks, "letters", lambda token, whole=leaks.letters: calls.append(token) or whole(token))
    for _ in range(3):
        page = Page(passages, [PASSAGE] * 40)
        assert page.words == [[w.lower().strip(",.") for w in words]] * 40 and page.may_hold(0)
    assert sorted(calls) == sorted(set(words))
