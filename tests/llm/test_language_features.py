"""Features of many words at once against one word at a time."""

import random
import zlib

from tessera.llm import language


def plain(word):
    w = word.lower().strip(".,;:!?\"'()[]|*&%$#")
    if not any(map(str.isalpha, w)):
        return []
    b = f"<{w}>".encode()
    parts = [b"w" + b, b"p" + b[:3], b"p" + b[:4], b"s" + b[-3:], b"s" + b[-4:], *(b[i : i + n] for n in (2, 3) for i in range(len(b) + 1 - n))]
    return [zlib.crc32(x) & (language.DIMENSIONS - 1) for x in parts]


def test_features_of_many_words():
    rng = random.Random(3)
    words = ["a", "A.", "(\u00e9)", "ab", "...", "12", "1a", "\u039f\u0394\u039f\u03a3", "\u03a3", "\u0130x", "\u4e2d\u6587", "it's", "x" * 300, "\U0001f600", "\u00aa", "-", "\u0000b"]
    words += ["".join(rng.choice("abAB\u00df\u03a3\u0301\u4e2d-.9'") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    row, col = language.word_features(words)
    got = [[] for _ in words]
    for i, f in zip(row.tolist(), col.tolist(), strict=True):
        got[i].append(f)
    assert got == [plain(w) for w in words]
    assert [len(x) for x in language.word_features([])] == [len(x) for x in language.word_features(["..."])] == [0, 0]
