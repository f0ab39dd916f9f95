"""Secrets in every compressed format, and in escapes that go on beyond a window."""

import base64
import bz2
import gzip
import io
import lzma
import random
import zipfile
import zlib

import pytest
from caseload.llm import secrets

SECRET = "password=abcdef0123456789zz"


def zipped(method, name="a/b.txt"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("first.txt", "nothing here " * 9)
        z.writestr(name, f"some text {SECRET} " * 3)
    return out.getvalue()


def deflated(window, data=SECRET):
    box = zlib.compressobj(9, zlib.DEFLATED, window)
    return box.compress(data.encode()) + box.flush()


PACKED = {
    "bzip2": bz2.compress(SECRET.encode()),
    "two bzip2": bz2.compress(b"one") + bz2.compress(SECRET.encode()),
    "xz": lzma.compress(SECRET.encode()),
    "lzma": lzma.compress(SECRET.encode(), format=lzma.FORMAT_ALONE),
    "zip": zipped(zipfile.ZIP_DEFLATED),
    "zip, bzip2": zipped(zipfile.ZIP_BZIP2),
    "zip, lzma": zipped(zipfile.ZIP_LZMA),
    "zip, stored": zipped(zipfile.ZIP_STORED),
    "raw deflate": deflated(-15),
    **{f"zlib, window {w}": deflated(w) for w in range(9, 16)},
    "cut short": gzip.compress(SECRET.encode() + random.Random(1).randbytes(9000), mtime=0)[:4000],
    "bzip2 in gzip": gzip.compress(b"x " + bz2.compress(SECRET.encode()), mtime=0),
}


@pytest.mark.parametrize("name", PACKED)
def test_every_format_is_read(name):
    wrapped = base64.b64encode(PACKED[name]).decode()
    _, more, _ = secrets.scan(f"éé see {wrapped} end")
    assert any(k == "assign" and 7 <= a < b <= 7 + len(wrapped) for k, a, b in more), name
    _, more, _ = secrets.scan("see " + "".join(f"%{b:02x}" for b in PACKED[name]) + " end")
    assert any(k == "assign" for k, _, _ in more), name


ESCAPES = {"percent": lambda data: "".join(f"%{b:02x}" for b in data), "unicode": lambda data: "".join(f"\\u{b:04x}" for b in data), "entities": lambda data: "".join(f"&#{b};" for b in data)}


@pytest.mark.parametrize("escape", ESCAPES)
@pytest.mark.parametrize("lead", [0, 3000, 3700, 4090, 4096, 5000])
def test_escapes_beyond_a_window_are_read(monkeypatch, escape, lead):
    rng = random.Random(lead)
    noise = lambda n: "".join(rng.choice("ghijklmnop .") for _ in range(n))
    inner = ESCAPES[escape](gzip.compress((noise(4000) + " " + SECRET + " " + noise(900)).encode(), mtime=0))
    content = noise(lead) + " " + inner + " " + noise(500)
    assert len(inner) > 4096
    wrapped = base64.b64encode(gzip.compress(content.encode(), mtime=0)).decode()
    want = [("assign", 4, 4 + len(wrapped.rstrip("=")))]
    for window, overlap in ((4096, 512), (1 << 24, 1 << 20)):
        monkeypatch.setattr(secrets, "WINDOW", window)
        monkeypatch.setattr(secrets, "OVERLAP", overlap)
        monkeypatch.setattr(secrets, "PIECE", window // 4)
        _, more, _ = secrets.scan(f"see {wrapped} end")
        assert [f for f in more if f[0] == "assign"] == want, window


def test_escapes_that_begin_beyond_a_window(monkeypatch):
    plain = "A" * 6000
    content = "x " + plain + "".join(f"%{ord(c):02x}" for c in " " + SECRET) + " y" * 3000
    wrapped = base64.b64encode(gzip.compress(content.encode(), mtime=0)).decode()
    monkeypatch.setattr(secrets, "WINDOW", 4096)
    monkeypatch.setattr(secrets, "OVERLAP", 512)
    monkeypatch.setattr(secrets, "PIECE", 1024)
    _, more, _ = secrets.scan(f"see {wrapped} end")
    assert any(k == "assign" for k, _, _ in more)


def test_a_long_token_is_read_once(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 4096)
    monkeypatch.setattr(secrets, "OVERLAP", 512)
    monkeypatch.setattr(secrets, "PIECE", 1024)
    content = "".join(f"%{b:02x}" for b in b"plain text without a find. " * 4000)
    _, more, layers = secrets.scan(f"see {base64.b64encode(gzip.compress(content.encode(), mtime=0)).decode()} end")
    assert more == [] and layers < 250  # windows of the content and of what it says, not of each rest


def test_ordinary_words_give_no_finds():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzXHK8") for _ in range(rng.randrange(2, 30))) for _ in range(3000)]
    base, more, _ = secrets.scan(" ".join(words))
    assert base == [] and more == []


def test_sums_of_many_byte_tables_do_not_overflow(spark):
    import numpy as np
    from caseload.llm import anisotropic
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 3072)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = anisotropic.search(rows, F.col("vec_id") % 20 == 0, k=5, cell_rows=1000, rerank=60).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    exact = vectors.astype(np.float64) @ vectors.T.astype(np.float64)
    np.fill_diagonal(exact, -np.inf)
    hits = sum(len(found[q] & set(np.argsort(-exact[q])[:5].tolist())) for q in found)
    assert len(found) == 15 and hits >= 0.85 * 75
