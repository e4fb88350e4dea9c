import random

import numpy as np

from corpuskiln.llm import languages as I


def test_short_cut_equals_segments():
    plain = I.Identifier({}, I.Families(np.eye(4)), {})
    rng = random.Random(4)
    texts = ["나는 매일 저녁에 밥을 먹는다. I like 김치 very much.", "a'b'c 가나"]
    texts += ["".join(rng.choice(["가", "나 ", "김치 ", "I ", "like ", "it's ", "don’t", ". ", ", ", "(", "1", "\n", " - ", "ㅋ"]) for _ in range(rng.randint(1, 24))) for _ in range(5000)]
    for t in texts:
        assert plain.languages(t) == sorted({s.lang for s in plain.segments(I.prepared(t))}), t
    assert plain.languages(texts[0]) == ["de", "ko"]
