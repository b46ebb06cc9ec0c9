"""The encoder against the library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomcount.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzthereinganderéàüßñ"
    out = ["", " ", "it's they'really '''re ''' don't 'something I'LL", "a<|endoftext|>b <|startoftext|>", "İstanbul ŉ ſ ÅÉ", "été 日本語 ١٢٣ Ω ώ", "x²½ 12,345.67€ – “q” \x1c\x1f\x85\xa0y", "!!!???***" * 40, " a　b"]
    out += ["".join(rng.choice(letters) for _ in range(n)) for n in (127, 128, 129, 1000, 5000)]
    out += [" ".join("".join(rng.choice(letters + "'!9") for _ in range(rng.randint(1, 9))) for _ in range(3000)), "aaaa" * 900, "'s" * 700, "the" * 500 + "'s" + "re" * 300 + " end"]
    other = ["日本語", "ώΣΑΣ", "e\u0301", "\u0301", "한\u1161", "१२", "don't", "<|endoftext|>", "“q”", "K", "ﬁ", "'s", "x²", "'", "\u1112\u1161"]
    out += ["".join(rng.choice(other) + rng.choice(["", " ", "\n", ". ", "。", ",", "'", "\u00a0", "　", "!?"]) for _ in range(800)) for _ in range(6)]
    out += ["字" * 700, "。".join("字" * rng.randint(1, 9) for _ in range(200))]
    return out


def test_texts(lib):
    c = bpe.Codec(PATH)
    for t in texts():
        want = lib.encode(t, add_special_tokens=False).ids
        ids, decoded = c.encode(t)
        assert ids == " ".join(map(str, want)), t[:80]
        assert decoded == lib.decode(want, skip_special_tokens=False)


def test_tree_is_merge():
    c, rng = bpe.Codec(PATH), random.Random(5)
    for n in (129, 300, 777, 2048):
        for alphabet in ("ab", "theran", "lo", "abcdefghijklmnopqrstuvwxyz"):
            s = c.symbols("".join(rng.choice(alphabet) for _ in range(n)), True)
            assert c.tree(s) == c.merge(s)


def test_texts_of_other_scripts_are_cut():
    long = "一二三。" * 20_000 + "Ω ώ " * 20_000
    made = bpe.cut(long, 1000)
    assert "".join(p for p, _, _ in made) == long and max(len(p) for p, _, _ in made) < 1010
    assert not any(a or b for _, a, b in made)


def test_query(spark, lib):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (50, None), (51, "twice"), (51, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as n_tokens")
    got = sorted(map(tuple, bpe.encode(df, PATH, bpe.DIGESTS, split_chars=200).collect()), key=str)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode(df.limit(0), PATH).count() == 0
