import base64
import random

import tiktoken

from quillstone.llm import bpe

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    return tiktoken.Encoding("t", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_exact_encoder_on_random_text():
    rng = random.Random(4)
    letters = "abcdefghij klmnopqrstuvwxyz æøåÆØÅß\n\t ​0123456789.,;'’—👩‍⚖️漢字'll"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(500)] + ["a" * 4000, "<|endoftext|>", " \n  ", "x" + " " * 900]
    codec, exact = bpe.Codec.load(PATH), reference()
    flat, at = codec.encode_batch(texts)
    assert [flat[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [exact.encode_ordinary(t) for t in texts]
    assert 0 < codec.failed < codec.tested


def test_bounded_table_of_pieces():
    codec, exact = bpe.Codec.load(PATH), reference()
    codec.most_pieces = 3
    for t in ("one two three four five", "two six seven", "one"):
        flat, _ = codec.encode_batch([t])
        assert flat.tolist() == exact.encode_ordinary(t)


def test_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hei på deg", "x"), (3, "Hei på deg", "x"), (4, " ", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode(df).collect())
    exact = reference()
    assert got == [(1, []), (2, []), (3, exact.encode_ordinary("Hei på deg")), (3, exact.encode_ordinary("Hei på deg")), (4, exact.encode_ordinary(" "))]
    assert bpe.encode(df.limit(0)).count() == 0


def test_plain_pattern_cuts_like_the_full_one():
    import regex

    rng, full = random.Random(1), regex.compile(bpe.PIECES)
    chars = [c for c in map(chr, [*range(9, 14), *range(28, 127), *range(0xA0, 0x250), *range(0x2010, 0x205F)]) if not bpe._NOT_PLAIN.search(c)]
    for _ in range(5000):
        t = "".join(rng.choice(chars) for _ in range(rng.randint(1, 12)))
        assert full.findall(t) == bpe._PLAIN_PIECES.findall(t)


def test_very_long_pieces():
    rng, codec = random.Random(2), bpe.Codec.load(PATH)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    flat, at = codec.encode_batch([long, "ab" * 500_000])
    assert flat[: at[1]].tolist() == reference().encode_ordinary(long)
    assert b"".join(codec.bytes_of[i] for i in flat[at[1] :].tolist()) == b"ab" * 500_000
