from hypothesis import given, settings
from hypothesis import strategies as st

from loomstore.functions import fts
from loomstore.functions.stem import stem
from loomstore.operators.extract import timed_rows
from loomstore.plans import render


@given(st.text(alphabet='abAND OR NOT"()*:_é.', max_size=30))
@settings(max_examples=400, deadline=None)
def test_any_query_is_read_or_refused(text):
    try:
        tree = fts.parse(text)
    except ValueError:
        return
    assert (tree is None) == (not text.strip())
    if tree is not None:
        assert all(p.terms for p in fts.phrases(tree))


@given(st.text(max_size=40))
def test_free_text_never_breaks_a_query(text):
    words = fts.words_query(text)
    assert words is None or fts.parse(words) is not None


@given(st.text(alphabet="abcdefghilmnoprstuvyz", min_size=1, max_size=15))
def test_a_stem_is_no_longer_than_its_word(word):
    assert 0 < len(stem(word)) <= len(word) + 1


@given(st.text(max_size=80))
@settings(deadline=None)
def test_any_text_gives_a_file_node(text):
    rows, _ = timed_rows("a/b.py", text, 10)
    assert rows[0][0]["kind"] == "File" and all((n is None) != (e is None) for n, e in rows)


@given(st.text(max_size=200), st.integers(1, 20))
def test_trimmed_texts_fit(text, tokens):
    cut = render.trim(text, tokens)
    assert cut == text if len(text) <= 4 * tokens else len(cut) <= 4 * tokens + 20
