import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from changetrail.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_ids_equal_the_tokenizer_library(docs, rows, reference):
    found = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    texts = {}
    for row in rows:
        texts.setdefault(row[0], set()).add(row[1] or "")
    for r in found.collect():
        expected = [reference.encode_ordinary(t) for t in texts[r["doc_id"]]]
        assert r["ids"] in expected and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], dtype="<u4").tobytes()).hexdigest()
    back = byte_bpe.decode_documents(found, RANKS, public_tokenizers.PATTERN)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in back.collect()) == \
        sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows)


def test_clashing_columns_and_empty_table(clashing, docs, empty):
    encode = lambda frame: byte_bpe.encode_documents(
        frame, RANKS, public_tokenizers.PATTERN, with_ids=False)
    assert sorted(map(str, encode(clashing).collect())) == sorted(map(str, encode(docs).collect()))
    assert encode(empty).count() == 0


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 130, "é" * 128, "abc" * 100 + " " * 300])
def test_long_pieces_have_equal_ids(text, reference):
    coder = byte_bpe.codec(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    ids, counts = coder.encode_texts([text, "", text])
    expected = reference.encode_ordinary(text)
    assert ids.tolist() == expected * 2 and counts.tolist() == [len(expected), 0, len(expected)]
    assert coder.decode(np.array(expected)) == text.encode()


@pytest.mark.parametrize("seed", range(6))
def test_long_rows_with_tokens_in_any_order_of_ranks(seed):
    """Ranks in no order of training, so that a merge can make a pair of a lesser rank."""
    rnd = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    while len(tokens) < 330:
        tokens.add(bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 7))))
    longer = [t for t in tokens if len(t) > 1]
    rnd.shuffle(longer)
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(longer)}
    lines = b"".join(base64.b64encode(t) + b" " + str(i).encode() + b"\n" for t, i in ranks.items())
    coder = byte_bpe.Codec(lines, r"(?s).+")
    other = tiktoken.Encoding("odd", pat_str=r"(?s:.)+", mergeable_ranks=ranks, special_tokens={})
    for size in (300, 500, 1000, 3000):
        text = "".join(rnd.choice("aab" if size == 500 else "abc") for _ in range(size))
        assert coder.encode_texts([text])[0].tolist() == other.encode_ordinary(text)


def test_chunks_hold_every_row_once():
    column = pa.array(["a" * 400_000, None, "b" * 200_000, "", "c" * 2_000_000, "d", "é" * 524_288])
    chunks = list(byte_bpe.chunks_by_length(column))
    assert [begin for begin, _ in chunks] == [0, 2, 4, 5, 6]
    assert sum((texts for _, texts in chunks), []) == [t or "" for t in column.to_pylist()]
