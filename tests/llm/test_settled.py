"""The transducer's one rule: ids leave once nothing behind them can change them, and all ids of the query leave by it."""

import random

import numpy as np
import pytest
from docquarry.llm import bpe_stream

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BYTES)


class Counting(bpe_stream.Transducer):
    """Counts the ids that stable() lets go, and those it does before their piece's end is read."""

    def __init__(self, path: str, slice_: int = bpe_stream.SLICE) -> None:
        super().__init__(path, slice_)
        self.let_go = self.early = self.most = 0

    def stable(self, data, ended):
        ids, rest = super().stable(data, ended)
        self.let_go += len(ids)
        self.early += 0 if ended else len(ids)
        self.most = max(self.most, len(data))
        return ids, rest


def test_lookaheads_by_definition():
    """Over a small merge list: whatever follows `need` bytes behind a token's end, the end stays."""
    merges = [(b"b", b"c"), (b"a", b"b"), (b"c", b"a"), (b"ab", b"ca"), (b"c", b"d"), (b"d", b"a"), (b"bc", b"a")]
    ranks = {pair: i for i, pair in enumerate(merges)}

    def encode(data: bytes) -> list[bytes]:
        parts = [bytes([x]) for x in data]
        while found := [(ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]:  # noqa: B905
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    need, r, undone = bpe_stream.lookaheads(merges), random.Random(1), 0
    for _ in range(20_000):
        data = bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 14)))
        longer = data + bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 9)))
        ends, end = set(np.cumsum([len(x) for x in encode(longer)]).tolist()), 0
        for token in encode(data):
            end += len(token)
            if len(data) - end >= need.get(token, 0):
                assert end in ends, (data, longer, token)
            undone += end not in ends
    assert undone > 1000 and max(need.values()) < 10


@pytest.mark.parametrize("feed", [1, 2, 7, 64])
def test_ids_do_not_depend_on_what_is_fed(library, monkeypatch, feed):
    monkeypatch.setattr(bpe_stream, "FEED", feed)
    machine, r = Counting(BYTES, 40), random.Random(feed)
    tokens = [t.decode(errors="ignore") for t in list(machine.bytes_of.values()) if t.isalpha()]
    texts = ["".join(r.choice(tokens) for _ in range(r.choice([2, 30, 120]))) for _ in range(60)] + ["".join(r.choice("etaoinsrhldcumETAOé") for _ in range(r.choice([30, 900]))) for _ in range(60)]
    texts += ["".join(r.choice(a) for _ in range(r.choice([50, 700]))) for a in ("-=", "=_*#", "0123456789", "\n \t", "ÃÂ©", "aA", "日本語の") for _ in range(12)]
    for text in texts:
        assert np.frombuffer(machine.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert machine.early > 3 * (machine.let_go - machine.early) * (feed < 64)
    assert machine.most <= machine.lookahead + feed + 64  # the longest token


def test_all_ids_of_documents_are_let_go_by_the_rule(spark, library, monkeypatch):
    """With nothing remembered every id of the table passes through stable(); with the tables ids are the same."""
    monkeypatch.setattr(bpe_stream, "LONGEST", -1)
    bare, n = Counting(BYTES), 0
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()
    for (text,) in rows:
        ids = bare.encode(text)
        n += len(ids) // 4
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert bare.let_go == n > 100_000 and not bare.pieces and not bare.chunks
