"""Second computations of op1, op6 and op8: all paths of short transcripts, vectors bound letter by letter, another JPEG decoder."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from docquarry.llm import chat_hmm, langid_hd, media_jpeg


def test_viterbi_is_the_best_of_all_paths():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 5):
        for _ in range(4):
            model = chat_hmm.Model(r.integers(-900, 0, chat_hmm.STATES), r.integers(-900, 0, (chat_hmm.STATES,) * 2), r.integers(-900, 0, (chat_hmm.OBSERVATIONS, chat_hmm.STATES)))
            seen = r.integers(0, chat_hmm.OBSERVATIONS, n).tolist()

            def score(path):
                first = model.start[path[0]] + model.emit[seen[0], path[0]]
                return first + sum(model.move[a, b] + model.emit[o, b] for a, b, o in zip(path, path[1:], seen[1:], strict=False))

            ranked = sorted(itertools.product(range(chat_hmm.STATES), repeat=n), key=score)
            found = chat_hmm.viterbi(model, seen)
            assert score(found) == score(ranked[-1]) and (n == 1 or score(ranked[-2]) == score(ranked[-1]) or tuple(found) == ranked[-1])


def test_parsing_ignores_further_columns(spark):
    rows = [(i % 3, i, "user" if i % 2 else "assistant", f"User: hi {i}?\nAI: yes") for i in range(12)] + [(1, 4, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat_hmm.fit(df)
    wide = df.withColumns({c: F.lit("x") for c in ("h", "part", "own", "grid", "role_pred", "n_lines", "rendered")})
    assert sorted(map(str, chat_hmm.parse_transcripts(wide, model).collect())) == sorted(map(str, chat_hmm.parse_transcripts(df, model).collect()))


def test_bundles_are_sums_of_bound_letters():
    letters, symbols = langid_hd.letter_vectors().astype(np.int64), langid_hd.symbol_table()
    for text in ("the cat, the Hat", "é", "Straße 12 ßx", "a" * 50, "x y  z"):
        runs = "".join(c if c.isalpha() else " " for c in text.lower())
        codes = [symbols[ord(c)] for c in " " + " ".join(runs.split()) + " "]
        total = np.zeros(langid_hd.SIZE, dtype=np.int64)
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            bound = np.ones(langid_hd.SIZE, dtype=np.int64)
            for place, letter in enumerate((a, b, c)):
                bound *= np.roll(letters[letter], 2 - place)  # permuted once for every place before the last
            total += bound
        want = total / np.linalg.norm(total)
        assert np.abs(langid_hd.Profiler().unit(text) - want).max() < 1e-5


def test_another_decoder_shows_the_same_picture(spark):
    """The JVM's own JPEG reader.  It smooths chroma where ours repeats it, so single pixels are compared by brightness, colours by their means."""
    r = random.Random(6)
    for spread in ((0, 0), (-4, 4), (0, 9)):
        payload = bytes(media_jpeg.CENTRE + r.randint(*spread) for _ in range(576 * 40))
        media = media_jpeg.encode_images([payload])
        ((image, coefficients),) = media_jpeg.decode_images(media)
        assert media_jpeg.read_payload(image, coefficients)[: len(payload)] == payload
        own = np.asarray(media_jpeg.tensor(image, coefficients)).reshape(image.height, image.width, 3).astype(float)
        jvm = spark._jvm
        shown = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(media[0])))
        assert (shown.getHeight(), shown.getWidth()) == (image.height, image.width)
        flat = np.array(list(shown.getRGB(0, 0, image.width, image.height, None, 0, image.width)), dtype=np.int64) & 0xFFFFFF
        other = np.stack((flat >> 16, flat >> 8 & 255, flat & 255), axis=1).reshape(own.shape).astype(float)
        assert np.abs(own.mean(axis=(0, 1)) - other.mean(axis=(0, 1))).max() < 1
        bright = np.array([0.299, 0.587, 0.114])
        assert np.abs(own @ bright - other @ bright).max() < 3 and np.abs(own @ bright - other @ bright).mean() < 0.8


def test_media_of_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert media_jpeg.media_digest(df).count() == 0 and media_jpeg.with_tensors(media_jpeg.with_media(df)).count() == 0


def test_equal_rows_have_equal_media(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (2, "same"), (None, None), (3, "")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("media", "payload", "feature", "n_bytes")})
    rows = media_jpeg.media_digest(df).collect()
    assert len(rows) == 5 and len({tuple(r[1:]) for r in rows}) == 2
