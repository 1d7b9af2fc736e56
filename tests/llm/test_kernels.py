import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import kernels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.none() | st.text(alphabet=st.sampled_from("abAé \n\t. \x0b"), max_size=60), max_size=8)


def plain_shingles(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_sets_agree_with_plain_code(texts):
    w = kernels.Words(texts)
    for i, text in enumerate(texts):
        own = [bytes(w.buf[a:b]).decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
        assert own == WORD.findall(text or "")
        assert w.chars()[w.first[i] : w.first[i + 1]].tolist() == [len(x) for x in own]
    sets = kernels.shingle_sets(texts, 5)
    plain = [plain_shingles(t) for t in texts]
    for a in range(len(texts)):
        assert len(sets[a]) == len(plain[a])
        for b in range(a):
            assert len(np.intersect1d(sets[a], sets[b])) == len(plain[a] & plain[b])


def test_hashes_do_not_depend_on_place_or_block(monkeypatch):
    text = " ".join(f"word{i}" for i in range(300))
    whole = kernels.Words([text]).hashes()
    assert len(np.unique(whole)) == 300
    assert (kernels.Words(["x " * 40, text]).hashes()[40:] == whole).all()
    monkeypatch.setattr(kernels, "BLOCK_BYTES", 64)
    assert (kernels.Words([text]).hashes() == whole).all()
    assert list(kernels.blocks(["a" * 60, "b" * 60, None, "c"])) == [(0, 1), (1, 4)]
    assert list(kernels.blocks([])) == []
