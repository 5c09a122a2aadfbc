import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import SCHEMA, odd_documents, prose
from priorfield.llm import idfiles, packing
from priorfield.llm.tokens import Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library(file):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
def test_cached_encoding_equals_the_library(file):
    rng = random.Random(1)
    parts = list("aZbé'ñ  \n\t.,$-_!09²Ⅷßﬀ́̈=≮​　\xa0…“”中文😀ΣςkKİ\x1c") + ["'s", "'re", " the", " don't", "***", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, "", prose(rng, 3000)]
    encoder, whole = Encoder(public_tokenizers.path(file), words=300, pieces=500), library(file)
    for i in range(0, len(texts), 50):
        for text, ids in zip(texts[i:i + 50], encoder.encode(texts[i:i + 50])):
            assert ids.tolist() == whole(text), text


@pytest.mark.parametrize("file", FILES)
def test_control_characters_stay_with_their_marks(file):
    """Terminal codes, NUL and DEL behind and before punctuation, then texts over all of ASCII."""
    rng, ascii_ = random.Random(2), list(map(chr, range(128)))
    control = [c for c in ascii_ if not c.isspace() and (c < " " or c == "\x7f")]
    texts = [" end.\x07", ".\x1b[0m", ")\x00", ".\x7f"] + [f"{a}{b}{c}" for a in ["", "a", " .", "9)", "é-"] for b in control for c in ["", "a", ".[", "'s", "\n"]]
    texts += ["".join(rng.choice(p) for _ in range(rng.randrange(1, 30))) for p in (ascii_, control + list(".)- aé9'")) for _ in range(3000)]
    encoder, whole = Encoder(public_tokenizers.path(file), words=300, pieces=500), library(file)
    for i in range(0, len(texts), 50):
        for text, ids in zip(texts[i:i + 50], encoder.encode(texts[i:i + 50])):
            assert ids.tolist() == whole(text), repr(text)


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_round_trip(bits, tmp_path):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (idfiles.from_planes(idfiles.to_planes(ids, bits), n, bits) == ids).all()
    file = idfiles._File(f"{tmp_path}/x", 100, bits)
    docs = [(i if i % 7 else None, rng.integers(0, 50_000, n, dtype=np.uint32)) for i, n in enumerate((3, 0, 250, 100, 1, 99, 1000))]
    for doc_id, ids in docs:
        file.add(doc_id, ids)
    assert file.close() == (7, sum(len(x) for _, x in docs))
    got = list(idfiles.read_file(f"{tmp_path}/x"))
    assert [g[0] for g in got] == [d[0] for d in docs] and all((a[1] == b[1]).all() for a, b in zip(got, docs))


def test_files_of_odd_documents(spark):
    rows, whole = odd_documents(), library(FILES[0])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = idfiles.new_folder(spark)
    idfiles.write_ids(docs, path, public_tokenizers.path(FILES[0]), end_id=0, block=1000, bits=1)
    got = sorted(idfiles.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert (r.start, len(r.ids)) == (at, 4 * r.n_tokens)
        at += r.n_tokens
    want = sorted((str(i), [*whole(t), 0]) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, dtype="<u4").tolist()) for r in got) == want
    empty = idfiles.new_folder(spark)
    idfiles.write_ids(docs.limit(0), empty, public_tokenizers.path(FILES[0]), end_id=0)
    assert idfiles.read_ids(spark, empty).count() == 0


def test_hilbert_curve_visits_neighbours():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dimensions)).reshape(dimensions, -1).T
        key = packing.hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_packed_pieces(spark):
    rows, whole = [r for r in odd_documents() if r[0] is not None], library(FILES[1])
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path(FILES[1]), size=256).toPandas()
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append(np.array([*whole(t), 2], dtype="<u4"))
    assert got.length.sum() == sum(len(x) for v in ids.values() for x in v)
    for r in got.itertuples():  # repeated rows have equal ids
        x = next(x for x in ids[r.doc_id] if len(x) == r.doc_tokens)
        assert zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    for _, pieces in got.groupby("sequence_id"):
        pieces, n = pieces.sort_values("offset"), int(pieces.length.sum())
        assert (pieces.offset.to_numpy() == np.concatenate([[0], np.cumsum(pieces.length)[:-1]])).all()
        assert n <= 256 and n & (n - 1) == 0
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), public_tokenizers.path(FILES[1])).count() == 0


def test_alike_documents_are_neighbours(spark):
    rng = random.Random(3)
    base = [prose(rng, 200) for _ in range(40)]
    docs = [(i * 2 + k, t + " tail" * k, None, None) for i, t in enumerate(base) for k in (0, 1)]
    keys = {r.doc_id: r.key for r in packing.curve_order(spark.createDataFrame(docs, SCHEMA)).collect()}
    place = {i: n for n, i in enumerate(sorted(keys, key=keys.get))}
    near = np.median([abs(place[2 * i] - place[2 * i + 1]) for i in range(40)])
    assert near <= 8  # at random: about 27


@pytest.mark.parametrize("cache, most", [((500_000, 1_000_000), 2), ((100_000, 200_000), 5)])
def test_groups_of_texts_are_as_large_as_the_caches_allow(monkeypatch, cache, most):
    import pyarrow as pa

    texts = ["one word after the other " * 4_000 + str(i) for i in range(25)]
    e, calls = Encoder(public_tokenizers.path("word_bpe_49k.json"), *cache), []
    encode = e.encode
    monkeypatch.setattr(e, "encode", lambda some: calls.append(len(some)) or encode(some))
    got = list(e.encode_column(pa.array(texts)))
    assert len(calls) == most and [x.tolist() for x in got] == [e.library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("file", FILES)
def test_new_words_go_to_the_library_together(file):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdeghioß") for _ in range(rng.randrange(1, 9))) for _ in range(3_000)})
    texts = [" ".join(words), "It's " + " ".join(w + rng.choice(["", ",", "7", "###", "'s"]) for w in words)]
    e = Encoder(public_tokenizers.path(file))

    class Counted:
        calls = 0

        def encode(self, text, **kind):
            Counted.calls += 1
            return e_library.encode(text, **kind)

        def encode_batch_fast(self, some, **kind):
            Counted.calls += len(some)
            return e_library.encode_batch_fast(some, **kind)

    e_library, e.library = e.library, Counted()
    whole = library(file)
    assert [x.tolist() for x in e.encode(texts[:1])] == [whole(texts[0])] and Counted.calls < len(words) / 50
    assert [x.tolist() for x in e.encode(texts)] == [whole(t) for t in texts]


def test_keys_are_computed_once_for_each_text(spark):
    """The ranges are taken from stored keys: the plan that is sorted holds no Python."""
    docs = spark.createDataFrame([(i, f"text {i}", None, None) for i in range(20)], SCHEMA)
    plan = packing.pack_documents(docs, public_tokenizers.path(FILES[1]))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
