"""Token ids against the tokenizers library: all letters before marks, added tokens in other cases, streaming, and both queries on Spark."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import bpe_stream, token_store

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CASES = [
    None, "", " ", "\n\n", "İ.", "क़, ড়. שׁ, ὐ", "J̌ T̈. ǰ", "ΑΣ. ας", "<|ENDOFTEXT|> a", "a<|endoftext|>, <|StartOfText|>.", "x" * 300 + ".", "it's 'll don't,", "a  b \t c\n",
    "señor, Élan; 12,5.", "<|endoftext", "ab" * 5000, " " * 3000 + "x", "é" * 700 + "!!!'s",
]


def ids_of(path, text):
    library = tokenizers.Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    return library.encode(text or "", add_special_tokens=False).ids


def test_word_ids_of_all_letters_before_marks():
    machine = token_store.Encoder(WORDS)
    library = machine.tokenizer
    letters = [c for c in map(chr, range(0x20, 0x3000)) if c.isalpha()] + [chr(c) for c in (*range(0xFB00, 0xFB50), 0x4E2D, 0xAC00, 0x1D400)]
    for c in letters:
        for text in (f"{c},", f"a{c}.", f"J{c}) {c}'s {c.lower()}!"):
            assert np.frombuffer(machine.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_word_ids_of_mixed_texts():
    machine, r = token_store.Encoder(WORDS), random.Random(8)
    cases = CASES + ["".join(r.choice("aAéÉßİΣσςJ̌Tŉ'’.,;!$<|>_0٣ \n\tendofxt") for _ in range(r.randrange(30))) for _ in range(2000)]
    for text in cases:
        assert np.frombuffer(machine.encode(text), dtype="<u4").tolist() == machine.tokenizer.encode(text or "", add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize("slice_", [3, 17])
def test_byte_ids_don_t_depend_on_slices(slice_):
    machine = bpe_stream.Transducer(BYTES, slice_)
    library = tokenizers.Tokenizer.from_file(BYTES)
    for text in CASES:
        want = library.encode(text or "", add_special_tokens=False).ids
        ids = list(machine.stream(text))
        assert np.frombuffer(b"".join(ids), dtype="<u4").tolist() == want
        assert "".join(machine.decoded(ids)) == library.decode(want, skip_special_tokens=False)


def test_most_tokens_leave_before_the_text_ends():
    r = random.Random(2)
    text = " ".join("".join(r.choice("etaoinsrh") for _ in range(r.randrange(1, 9))) for _ in range(20_000))
    machine = bpe_stream.Transducer(BYTES)
    state, early = bpe_stream.Encoding(machine), 0
    for at in range(0, len(text), bpe_stream.SLICE):
        early += sum(map(len, state.feed(text[at : at + bpe_stream.SLICE])))
    late = sum(map(len, state.finish()))
    assert early > 1000 * late and early + late == 4 * len(ids_of(BYTES, text))


@pytest.mark.parametrize(("kind", "size"), [("words", 50_000_000), ("letters", 200_000), ("blanks", 200_000)])
def test_state_stays_small_on_a_long_text(kind, size):
    """Neither a piece without an end nor many pieces are gathered."""
    part = {"words": "these are some words ", "letters": "letters", "blanks": " \n"}[kind] * 1000
    machine = bpe_stream.Transducer(BYTES)
    state, n = bpe_stream.Encoding(machine), 0
    for _ in range(size // len(part)):
        n += sum(map(len, state.feed(part)))
        assert len(state.rest) + len(state.open) < machine.slice + len(part) + machine.lookahead + 1024
    assert n > size // 10 and len(machine.pieces) + len(machine.chunks) < 100


def test_both_queries_on_spark(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(3, CASES[3]), (5, CASES[5]), (5, "other"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "start", "part", "decoded_sha256")}).repartition(5)
    library = tokenizers.Tokenizer.from_file(BYTES)
    want = []
    for i, t in rows:
        ids = ids_of(BYTES, t)
        raw, back = np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)
        want.append(str((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest())))
    assert sorted(str(tuple(r)) for r in bpe_stream.bpe_digest(df, BYTES).collect()) == sorted(want)
    checked = bpe_stream.encode_checked(df, BYTES)
    assert sorted(str((r[0], r[1], hashlib.sha256(r[2]).hexdigest(), r[3])) for r in checked.collect()) == sorted(want)
    decoded = bpe_stream.decode_documents(bpe_stream.encode_documents(df, BYTES), BYTES)
    assert sorted(str((r["doc_id"], r["text"])) for r in decoded.collect()) == sorted(str((i, t or "")) for i, t in rows)
    for empty in (bpe_stream.bpe_digest(df.limit(0), BYTES), token_store.token_digest(df.limit(0), WORDS)):
        assert empty.count() == 0
    start, sizes = 0, []
    for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], np.array([*ids_of(WORDS, r[1]), 1], dtype="<u2").tobytes())):
        ids = [*ids_of(WORDS, t), 1]
        sizes.append(str((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))))
        start += len(ids)
    assert sorted(str(tuple(r)) for r in token_store.token_digest(df, WORDS).collect()) == sorted(sizes)
