import hashlib
import random
import re

import pytest

from helpers import SCHEMA, odd_documents, prose
from priorfield.llm import fim


def plain(doc_id, text, seed=1, plain_from=90, spm_below=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_below:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def key(row):
    return tuple((x is None, str(x)) for x in row)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("frame", [1, 3, 7, fim.FRAME])
def test_against_plain(spark, frame):
    rng = random.Random(3)
    alphabet = "abZ  é中😀<PSM>1.\n\t\x00"
    docs = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))), "en", "s") for i in range(150)]
    docs += [(i, t, "en", "s") for i, t in enumerate(["<P>", "a<M>b", "<S", "<P" * 9, "x" * 200, "é" * 50, "a"], 500)]
    docs += [(900 + i, prose(rng, 4000), "de", "s") for i in range(6)]
    if frame < 7:
        docs = [d for d in docs if len(d[1]) < 1000]
    out = fim.fill_in_middle(spark.createDataFrame(docs, SCHEMA).repartition(3), frame=frame)
    want = [plain(d[0], d[1]) for d in docs]
    assert sorted(map(tuple, fim.output_texts(out).collect()), key=key) == sorted(want, key=key)
    texts = {d[0]: d[1] for d in docs}
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    got = fim.digests(out).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((*w[:5], sha(w[5])) for w in want), key=key)
    assert all(r.restored_sha256 == sha(texts[r.doc_id]) for r in got)


def test_odd_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_documents(), SCHEMA).withColumn("n", F.lit("x")).withColumn("form", F.lit(3)).withColumn("output", F.lit(1)).withColumn("frames", F.lit(2))
    out = fim.fill_in_middle(docs, seed=4, plain_from=100, spm_below=50)
    want = [plain(d[0], d[1], 4, 100, 50) for d in odd_documents()]
    assert sorted(map(tuple, fim.output_texts(out).collect()), key=key) == sorted(want, key=key)
    got = sorted((r.restored_sha256 for r in fim.digests(out).collect()))
    assert got == sorted(sha(d[1] or "") for d in odd_documents())
    assert fim.digests(fim.fill_in_middle(docs.limit(0))).count() == 0


def test_only_cut_frames_are_opened():
    import zstandard

    pack, opened = zstandard.ZstdCompressor(), []

    class Unpack:
        def decompress(self, frame):
            opened.append(frame)
            return zstandard.ZstdDecompressor().decompress(frame)

    rng = random.Random(8)
    text = prose(rng, 9000).encode()
    frames, units, chars = fim.to_frames(text, 1000, pack)
    for doc_id in range(30):
        opened.clear()
        row = fim.cut_text(doc_id, frames, units, chars, False, 1, 100, 20, pack, Unpack())
        assert len(opened) <= 2 and len(frames) > 60
        assert sum(f in frames for f in row[-1]) >= len(frames) - 2
        whole = zstandard.ZstdDecompressor().stream_reader(b"".join(row[-1]), read_across_frames=True).read()
        assert whole.decode() == plain(doc_id, text.decode(), 1, 100, 20)[-1]


def test_sentinels_across_pieces():
    text = b"<P>ab<<P<S>cd<M<M>ef<"
    for size in range(1, len(text) + 1):
        pieces = [text[i:i + size] for i in range(0, len(text), size)]
        assert b"".join(fim.restored("psm", pieces)) == b"ab<<Pef<cd<M"
    with pytest.raises(ValueError):
        list(fim.restored("psm", [b"<P>no other"]))
