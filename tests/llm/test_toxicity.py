import random

import numpy as np

from lynceus.llm import toxicity


def test_chinese_japanese_korean_and_fullwidth_letters_count():
    rng = random.Random(1)
    for first, last, insult in ((0x4E00, 0x9000, "愚蠢无耻混蛋"), (0x3041, 0x3094, "ばかやろうめ"), (0xAC00, 0xD700, "멍청한놈아꺼져"), (0x20000, 0x2A000, "𠀀𠀁𠀂𠀃𠀄𠀅")):
        prose = lambda n: "".join(chr(rng.randint(first, last)) for _ in range(n))  # noqa: B023, E731
        clean, toxic = [prose(100) for _ in range(80)], [prose(40) + insult + prose(60 - len(insult)) for _ in range(80)]
        model = toxicity.fit(clean[:60] + toxic[:60], [0] * 60 + [1] * 60)
        low, high = model.probabilities(clean[60:]), model.probabilities(toxic[60:])
        assert (low < 0.5).mean() > 0.9 and (high >= 0.5).mean() > 0.9


def test_fullwidth_text_scores_like_its_ascii_twin():
    words = "the river runs along old stone walls near quiet fields".split()
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choices(words, k=8))
    model = toxicity.fit([prose() for _ in range(40)] + [prose() + " you stupid idiot" for _ in range(40)], [0] * 40 + [1] * 40)
    text = "you stupid idiot"
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in text)
    plain, same, upper, other = model.probabilities([text, wide, wide.upper(), "near quiet fields"])
    assert plain > 0.5 > other and np.allclose([same, upper], plain)
