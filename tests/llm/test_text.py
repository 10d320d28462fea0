import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import text as T
from tests.llm.common import ODD, words


def _each(texts, limit):
    out = []
    for i, j, raw, offs in T.text_blocks(pa.array(texts, pa.string()), limit):
        w, first = T.words(raw, offs)
        s, begin = T.shingles(w, first, 5)
        out += [(w[first[d] : first[d + 1]], s[begin[d] : begin[d + 1]]) for d in range(j - i)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab AB\t\n\x0b\x1c é日", max_size=40)), max_size=12), st.sampled_from([1, 7, 1 << 20]))
def test_words_and_shingles_agree_with_the_definition(texts, limit):
    word, run = {}, {}
    for t, (w, s) in zip(texts, _each(texts, limit), strict=True):
        mine = words(t)
        assert len(w) == len(mine)
        runs = [tuple(mine[i : i + 5]) for i in range(len(mine) - 4)] if len(mine) >= 5 else [tuple(mine)] * bool(mine)
        assert len(s) == len(runs)
        for seen, keys, hashes in ((word, mine, w), (run, runs, s)):
            for k, h in zip(keys, hashes.tolist(), strict=True):
                assert seen.setdefault(k, h) == h
    for seen in (word, run):
        assert len(set(seen.values())) == len(seen)


def test_blocks_do_not_change_hashes():
    one, many = _each(ODD, 1 << 22), _each(ODD, 50)
    assert all(np.array_equal(a, c) and np.array_equal(b, d) for (a, b), (c, d) in zip(one, many, strict=True))


def test_slices_of_arrow_arrays_keep_their_place():
    texts = pa.array(["a b", None, "c d e", "f"], pa.string()).slice(1)
    assert [len(w) for i, j, raw, offs in T.text_blocks(texts) for w in np.split(*(lambda w, f: (w, f[1:-1]))(*T.words(raw, offs)))] == [0, 3, 1]


def test_words_with_equal_polynomials_have_their_own_hashes():
    for n in (64, 1024, 2048, 4096):
        one = "".join("ab"[k.bit_count() & 1] for k in range(n))
        two = one.translate({97: "b", 98: "a"})
        (w, s), = _each([f"{one} {two}"], 1 << 20)
        assert w[0] != w[1]
        (_, s), (_, z) = _each([" ".join(one), " ".join(two)], 1 << 20)
        assert len(np.unique(s)) == len({one[k : k + 5] for k in range(n - 4)}) == len(np.intersect1d(s, z))
