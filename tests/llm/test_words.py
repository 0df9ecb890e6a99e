import random
import re

import numpy as np
import pyarrow as pa

from rillmark.llm import words as W


def test_words_equal_the_regex_and_hash_alike():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAZ \t\n.é²9 Ω") for _ in range(rng.randint(0, 30))) for _ in range(600)] + [None, "", None, " ", "x" * 10000]
    for is_word, pattern in ((W.NON_SPACE, rb"[^\x20\x09-\x0D]+"), (W.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen: dict[bytes, int] = {}
        for i, j, w in W.of_column(pa.array(texts), is_word, 500):
            for k in range(i, j):
                at = range(w.first[k - i], w.first[k - i + 1])
                assert [w.word(x) for x in at] == re.findall(pattern, (texts[k] or "").encode().lower())
                for x in at:
                    assert seen.setdefault(w.word(x), w.hash[x]) == w.hash[x]
        assert len(set(map(int, seen.values()))) == len(seen)


def test_empty_columns_and_slices():
    assert list(W.of_column(pa.array([], pa.string()))) == []
    part = pa.array(["ab c", None, "d"]).slice(1)
    ((i, j, w),) = W.of_column(part)
    assert (i, j, w.counts.tolist()) == (0, 2, [0, 1])
    h, at = W.ngrams(w, 2)
    assert len(h) == len(at) == 0 and isinstance(at, np.ndarray)
