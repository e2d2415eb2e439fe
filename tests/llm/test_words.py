import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakmoes.llm import scan


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",), exclude_characters="\0"), max_size=60), max_size=5))
def test_words_like_a_pattern(texts):
    h, owner, start, end = scan.words(texts)
    joined = "\0".join(texts) + "\0"
    want = [(i, m[0]) for i, t in enumerate(texts) for m in re.finditer(r"[^\W_]+", t)]
    assert [(int(o), joined[a:b]) for o, a, b in zip(owner, start, end)] == want
    same = {}
    for x, (_, w) in zip(h.tolist(), want):
        key = "".join(c.lower() for c in w)
        assert same.setdefault(key, x) == x
    assert len(set(same.values())) == len(same)


def test_accents_and_windows():
    a, *_ = scan.words(["Één CAFÉ", "een cafe", "éen café"], accents=True)
    assert a[:2].tolist() == a[2:4].tolist() == a[4:].tolist()
    h, o, *_ = scan.words(["a b c", "b c d"])
    w, wo = scan.windows(h, o, 2)
    assert len(w) == 4 and w[1] == w[2] and wo.tolist() == [0, 0, 1, 1]
    assert len(scan.windows(h, o, 9)[0]) == 0 and len(scan.words([""])[0]) == 0


def test_blocks_keep_order():
    texts = ["x" * random.Random(i).randrange(50) for i in range(40)] + [None]
    assert [t for _, b in scan.blocks(texts, 100) for t in b] == [t or "" for t in texts]
    assert [lo for lo, _ in scan.blocks(["a" * 500], 100)] == [0]
    assert np.array_equal(scan.mix64(np.arange(3, dtype=np.uint64)), scan.mix64(np.arange(3, dtype=np.uint64)))
