import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from semlattice.llm import bytewords as bw

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("abAB 01.é\n\t数\x0b", max_size=40)), max_size=8), st.sampled_from([1, 16, 1 << 20]))
def test_words_and_shingles_are_those_of_a_plain_split(texts, limit):
    for lut, pattern in ((bw.NON_SPACE, r"[^\x20\x09-\x0D]+"), (bw.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = [re.findall(pattern, (t or "").translate(LOW)) for t in texts]
        seen = {}
        for s in bw.slices(pa.array(texts, pa.string()), lut, limit):
            h, (sets, at) = s.hashes(), bw.shingles(s, 3)
            for i, r in enumerate(range(s.rows.start, s.rows.stop)):
                mine = h[s.first[i] : s.first[i + 1]].tolist()
                assert len(mine) == len(words[r])
                for w, x in zip(words[r], mine, strict=True):
                    assert seen.setdefault(w, x) == x
                expected = {tuple(words[r][k : k + 3]) for k in range(len(words[r]) - 2)} or ({tuple(words[r])} if words[r] else set())
                assert at[i + 1] - at[i] == len(expected)
        assert len(set(seen.values())) == len(seen)


def test_power_tables_and_slices_agree():
    text = "alpha beta " * 5000
    one = np.concatenate([s.hashes() for s in bw.slices(pa.array([text, "alpha"]), bw.NON_SPACE, 100)])
    assert len(set(one.tolist())) == 2 and one[-1] == one[0] == bw.word_hash("ALPHA")
