"""The training-data operators against brute force, round trips and held-out accuracy, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docquarry.llm import bpe_stream, chat_hmm, components, decontam, langid_hd, line_bitmaps, media_jpeg, simhash_golay, suffix_bcr, token_store, url_links

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "this line is long enough to be a key of the line dedup "


def texts():
    r = random.Random(5)
    words = [("".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))) for _ in range(60)]
    base = " ".join(r.choice(words) for _ in range(220))
    near = [base.replace(words[i], "zz", 1) for i in range(12)]
    passage = " ".join(r.choice(words) for _ in range(90))
    own = [" ".join(r.choice(words) for _ in range(r.choice([1, 2, 40, 300]))) for _ in range(20)]
    shared = [f"{w} {passage} {w}{w}" for w in words[:8]]
    lines = [f"head {i}\n {LONG}{'ABC'[i % 3]}\t\n{LONG}{'abc'[i % 3]}\ntail" for i in range(18)]
    return [None, "", "   ", "\n", "a" * 700, "1234 !!", *own, base, base, *near, *shared, *lines, "Ünïcode Straße ΣΑΣ İ 'll don't  two\t\tx", "ab" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    made = [(i, t, "x" if i % 2 else "y", "s", len(t or "")) for i, t in enumerate(texts())]
    made += [made[30], (None, LONG + "A", None, None, None)]
    # further columns with names that the operators use themselves
    df = spark.createDataFrame(made, SCHEMA).withColumns({c: F.lit(1) for c in ("fp", "rk", "h", "n", "keep", "t1", "media", "ids")})
    return df.repartition(7), made


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_golay_keys_meet_within_two_errors():
    tables = simhash_golay.golay_tables()
    errors = np.array([0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)])
    assert all(len(set(x)) in (1, 6) for x in tables[1].tolist())
    for low_part in range(2048):
        word = np.full(len(errors), low_part)
        a, b = simhash_golay.codeword_indices(word, tables), simhash_golay.codeword_indices(word ^ errors, tables)
        assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).all()


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("most", [48, 2])
def test_simhash_components(spark, docs, monkeypatch, most):
    monkeypatch.setattr(simhash_golay, "PAIRS_UP_TO", most)
    df, rows = docs
    fp = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 2) for i in range(len(rows))]
    least = defaultdict(list)
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            least[g].append(r[0])
    want = sorted((str(r[0]), f"{f:016x}", str(min(least[g])) if least[g] else "None") for r, f, g in zip(rows, fp, group, strict=True))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash_golay.near_duplicates(df).collect())
    assert got == want
    assert simhash_golay.near_duplicates(df.limit(0)).count() == 0


def test_fingerprint_links_of_a_dense_group(spark):
    r = random.Random(1)
    fps = {r.getrandbits(64) ^ (1 << r.randrange(64)) for _ in range(30)} | {0xABCDEF ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = {tuple(x) for x in simhash_golay.fingerprint_links(spark.createDataFrame(signed, "fp long")).collect()}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
    root = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(sorted(links), "a long, b long"), "a", "b").collect()}
    want = {x[0]: x[0] for x in signed}
    for _ in range(8):
        want = {a: min(want[b] for b in want if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2) for a in want}
    assert {x[0]: root.get(x[0], x[0]) for x in signed} == want


def test_components_of_a_chain(spark):
    got = components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long"), "a", "b")
    assert {(r["node"], r["root"]) for r in got.collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("parts", ["2", "40"])
def test_line_dedup(spark, docs, parts):
    df, rows = docs
    holders = defaultdict(set)
    key = lambda x: low(x.strip(" \t\n\v\f\r"))
    for r in rows:
        for x in (r[1] or "").split("\n"):
            holders[key(x)].add(-1 if r[0] is None else r[0])
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != (-1 if r[0] is None else r[0]))]
        want.append((str(r[0]), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [(str(r[0]), *r[1:]) for r in line_bitmaps.line_digest(df).collect()]
        assert sorted(got) == sorted(want) and sum(x[2] for x in want) > 20
        assert line_bitmaps.line_digest(df.limit(0)).count() == 0
        assert line_bitmaps.drop_repeated_lines(df).columns == df.columns
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_variable_length_coding():
    v = np.array([0, 1, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7], dtype=np.uint32)
    for n in range(len(v) + 1):
        control, data = token_store.pack(v[:n])
        assert len(control) == -(-n // 4) and token_store.unpack(control, data, n).tolist() == v[:n].tolist()


def test_token_store(spark, docs, monkeypatch):
    from tokenizers import Tokenizer

    df, rows = docs
    monkeypatch.setattr(token_store, "BLOCK_IDS", 100)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, start, want = Tokenizer.from_file(path), 0, []
    for r in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, (tuple(r) for r in token_store.token_digest(df, path).collect()))) == sorted(map(str, want))
    assert token_store.token_digest(df.limit(0), path).count() == 0


def test_language_id(spark):
    words = {"aa": "the of and this with", "bb": "der die und nicht mit", "cc": "les des est dans pour"}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(words[k].split()) for _ in range(r.randrange(3, 40))), k) for i, k in enumerate(r.choice(sorted(words)) for _ in range(400))]
    rows += [(1000, None, "aa"), (1001, "123 ?!", "bb"), (1002, "the of", None), (None, "der die", "bb"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = langid_hd.identify(df).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == "und" and by[1000]["score"] == 0.0
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got if x["doc_id"] is not None)
    truth = {x[0]: x[2] for x in rows}
    held = [x for x in got if x["held_out"] and x["doc_id"] < 1000]
    assert sum(x["lang_pred"] == truth[x["doc_id"]] for x in held) >= 0.95 * len(held)
    assert langid_hd.identify(df.limit(0)).count() == 0
    assert {x["doc_id"] for x in langid_hd.keep_identified(df, langid_hd.prototypes(df)).collect()} == {x[0] for x in rows} - {1000, 1001}


def test_column_wise_construction():
    r = random.Random(3)
    for _ in range(150):
        strings = [bytes(r.choice(b"ab"[: r.choice([1, 2])]) for _ in range(r.randrange(1, 14))) for _ in range(r.randrange(1, 8))]
        bwt, lcp, places = suffix_bcr.column_wise(strings)
        at = {places[k, i]: s[i:] for k, s in enumerate(strings) for i in range(len(s) + 1)}
        order = [at[i] for i in range(len(bwt))]
        assert order == sorted(order)
        for i in range(1, len(order)):
            a, b = order[i - 1], order[i]
            assert lcp[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


@pytest.mark.parametrize("spread", [4000, 2])
def test_repeated_strings(spark, docs, monkeypatch, spread):
    monkeypatch.setattr(suffix_bcr, "SPREAD", spread)
    monkeypatch.setattr(suffix_bcr, "BUCKET", 40)
    df, rows = docs
    length, seen = 60, defaultdict(int)
    raw = [(r[1] or "").encode() for r in rows]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    want = []
    for r, b in zip(rows, raw, strict=True):
        hit = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = True
        runs = int((np.diff(hit.astype(int), prepend=0) == 1).sum())
        want.append((str(r[0]), len(b), int(hit.sum()), runs, hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=False) if not h)).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in suffix_bcr.repeats_digest(df, length).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_bcr.repeats_digest(df.limit(0), length).count() == 0


def test_media_round_trip(spark, docs):
    df, rows = docs
    got = media_jpeg.media_digest(df).collect()
    want = {}
    for r in rows:
        n, payload = media_jpeg.padded(r[1])
        want[str(r[0])] = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len(got) == len(rows)
    assert {str(r["doc_id"]): tuple(r[1:5]) for r in got} == want
    of_text = defaultdict(set)
    for r in got:
        of_text[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in of_text.values())
    shapes = media_jpeg.with_tensors(media_jpeg.with_media(df)).select(F.length("rgb") == F.col("height") * F.col("width") * 3).distinct().collect()
    assert [r[0] for r in shapes] == [True]


def test_jpeg_pixels_follow_the_definition():
    r = random.Random(4)
    payload = bytes(r.randrange(256) for _ in range(576 * 3))
    (image, coefficients), = media_jpeg.decode_images(media_jpeg.encode_images([payload]))
    block = np.zeros(64)
    block[media_jpeg.ZIGZAG] = coefficients[0]
    block = block.reshape(8, 8)
    k = np.arange(8)
    c = np.where(k == 0, 0.5**0.5, 1.0)[:, None] / 2 * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    want = np.clip(np.rint(np.einsum("uv,ux,vy->xy", block, c, c)) + 128, 0, 255)
    pixels = (coefficients[0].astype(float) @ media_jpeg.basis() + 1024) // 2048 + 128
    assert np.abs(np.clip(pixels.reshape(8, 8), 0, 255) - want).max() <= 1


def test_decontamination(spark, docs):
    df, rows = docs
    items = [(1, " ".join((rows[8][1] or "").split()[:3])), (2, rows[26][1]), (3, None), (4, "!!"), (5, "not there at all"), (None, "x"), (2, rows[26][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(low(t or ""))
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    want = {}
    for r in rows:
        w, hit, ids = word.findall(low(r[1] or "")), set(), set()
        for x, held in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    ids |= held
        want[str(r[0])] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    assert {str(r[0]): tuple(r[1:]) for r in decontam.contamination_digest(df, bench).collect()} == want
    assert {str(r[0]): (r[1], r[2]) for r in decontam.contamination(df, bench, pass_chars=4000).collect()} == {k: v[:2] for k, v in want.items()}
    assert len(list(decontam._passes(bench, "item_id", "text", 10, 4000))) > 1
    for chars in (4000, 1 << 25):
        assert sorted(str(r[0]) for r in decontam.drop_contaminated(df, bench, pass_chars=chars).collect()) == sorted(str(r[0]) for r in rows if not want[str(r[0])][4])
    for r in decontam.contamination(df, bench).where("n_hit > 0").join(df.select("doc_id", "text"), "doc_id").collect():
        assert sum(len(word.findall(low(r["text"][a:b]))) for a, b in r["spans"]) == r["n_hit"]
    assert not any(r[-1] for r in decontam.contamination_digest(df, bench.limit(0)).collect())


@pytest.mark.parametrize("slice_", [1, 5, 1024])
def test_bpe_equals_the_library(slice_):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, machine, r = Tokenizer.from_file(path), bpe_stream.Transducer(path, slice_), random.Random(6)
    cases = [t or "" for t in texts()] + ["<|endoftext|>a <|endoftext|>", "a  b \n\n c\t d ", "é" * 900, "ab" * 2000]
    cases += ["".join(r.choice(a) for _ in range(r.choice([3, 40, 1500]))) for a in ("ab", "the andioLI ng", "aA  \n\t.,19é ü '") for _ in range(60)]
    for t in cases:
        want = library.encode(t, add_special_tokens=False).ids
        ids = machine.encode(t)
        assert np.frombuffer(ids, dtype="<u4").tolist() == want
        assert machine.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_decodes_broken_bytes_as_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, machine = Tokenizer.from_file(path), bpe_stream.Transducer(path)
    for ids in ([220, 188, 104], [161, 254], [50256, 10, 200]):
        assert machine.decode(np.array(ids, dtype="<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_url_rules_and_propagation(spark):
    rows = [
        (0, "http://GOOD.com/x?q", '<a href="https://far.org/a">'), (1, "https://bad.net/es/1", ""), (2, "https://bad.net/es/2#t", ""), (3, "https://linker.org/p", "<a href='//bad.net/es/1'><a href=//bad.net/zz>"),
        (4, "https://other.org", "<a href='http://linker.org/'>"), (5, None, None), (6, "no scheme", ""), (7, "https://a.example.com/en/", ""), (8, "https://www.example.com/en/", ""), (8, "https://www.example.com/en/", ""), (None, "x://far.org?p", ""),
    ]
    rules = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = [tuple(r) for r in url_links.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict", F.round("distrust", 4)).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r[1:] for r in got}
    assert by[0][:4] == ("good.com", "/x", "com/", "allow") and by[1][:4] == ("bad.net", "/es/1", "net/es/", "block")
    assert by[3] == ("linker.org", "/p", None, "block", 0.85) and by[4] == ("other.org", "", None, "block", 0.7225)
    assert by[5][:4] == by[6][:4] == ("", "", None, "allow") and by[7][2:4] == ("example.com/en/", "block") and by[8][2:4] == ("www.example.com/en/", "allow") and by[None][:4] == ("far.org", "", None, "allow")
    assert url_links.judge(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("parts", ["1", "12"])
def test_chat_parsing_equals_one_viterbi(spark, parts):
    r = random.Random(8)
    rows = [(7 if r.random() < 0.5 else r.choice([1, 2, None]), t, r.choice(["user", "assistant", "system", None]), r.choice(["User: hi?", "AI: fine\nmore words", "- thing", "\nplain\n\nlines", "", None])) for t in range(120)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat_hmm.fit(df)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(x) for x in chat_hmm.parse_transcripts(df, model).collect()]
        assert chat_hmm.parse_transcripts(df.limit(0), model).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = defaultdict(list)
    for c, t, h, x in df.select("conv_id", "turn", F.xxhash64("text"), "text").collect():
        groups[c].append((t, h, x))
    want = []
    for c, held in groups.items():
        held.sort(key=lambda x: x[:2])
        lines = [[chat_hmm.read_line(y) for y in (x or "").split("\n")] for _, _, x in held]
        path = chat_hmm.viterbi(model, [o for row in lines for o, _ in row])
        want += [(c, x[0], role, len(row), n, said) for x, row, (role, n, said) in zip(held, lines, chat_hmm.render(lines, path, False, True), strict=True)]
    assert sorted(map(str, got)) == sorted(map(str, want))
