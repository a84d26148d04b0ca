import random

import public_tokenizers
import pytest
import tiktoken

from shelfspark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.parse_ranks(bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def coder(ranks):
    return bpe.TextEncoder(bpe.Vocabulary(ranks), PATTERN)


@pytest.fixture(scope="module")
def exact(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    letters = "abcdeé ñ  \n\t'sß中文０９²①٣  　 \x1c!?\U0001f600\r_-"
    made = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(3000)]
    return [*made, "", " ", "  ", "a ", " a", "it's  we'll\n\n x", "a" * 3000, "ab" * 2000, " " * 700, "\n" * 300, "thethethe" * 300, "<|endoftext|>"]


def test_equals_reference_encoder(coder, exact):
    table = bpe.token_bytes(bpe.read_ranks(PATH))
    for t in texts():
        ids = list(memoryview(coder.encode(t)).cast("i")) if t else []
        assert ids == exact.encode_ordinary(t), t
        assert bpe.decode(ids, table) == t.encode()


def test_appends_and_edits_are_exact(coder, ranks):
    rng = random.Random(2)
    vocabulary = coder.vocabulary
    held = bpe.PrefixEncoding(vocabulary)
    for part in [b"un", b"believ", b"able", b"the" * 50]:
        before = list(held.last)
        held.append(part)
        assert held.last[: len(before)] == before
        assert held.tokens() == bpe.PrefixEncoding(vocabulary, held.data).tokens()
    for _ in range(200):
        a = rng.randint(0, len(held.data))
        b = min(len(held.data), a + rng.randint(0, 4))
        new = rng.choice([b"", b"x", b"ing", b"\xff"])
        want = held.data[:a] + new + held.data[b:]
        held.edit(a, b, new)
        assert held.data == want
        assert held.last == bpe.PrefixEncoding(vocabulary, want).last


def test_an_edit_in_a_long_piece_recomputes_little(coder):
    held = bpe.PrefixEncoding(coder.vocabulary, b"abcdefgh" * 2000)
    assert held.edit(100, 101, b"z") < 500


def test_columns(spark, exact):
    rows = [(1, None, "x", 5), (2, "", "y", 6), (2, "Hello  world", "z", 7), (2, "Hello  world", "z", 7), (None, "é" * 20000, "w", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, decoded int")
    out = bpe.encode_documents(df, PATH, PATTERN)
    assert out.columns == ["doc_id", "text", "decoded", "token_ids"]
    back = bpe.decode_documents(out, PATH).collect()
    for r in back:
        assert list(r.token_ids) == exact.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert len(back) == 5
    assert bpe.encode_documents(df.limit(0), PATH, PATTERN).collect() == []
    none = spark.createDataFrame([(None,)], "token_ids array<int>")
    assert bytes(bpe.decode_documents(none, PATH).first().decoded) == b""
