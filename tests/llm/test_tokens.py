import hashlib
import json
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from wayquad.llm import binary, bpe

PATH = bpe.vocabulary()
TEXTS = [
    None,
    "",
    " ",
    "a",
    "  two  spaces ",
    "line\nline\n\n  indented\tTab \r\n end ",
    "<|endoftext|>",
    "x <|endoftext|> y<|endoftext|>",
    "don't I'll we've it's 'quoted'",
    "aaaaaaaaaaaa aaaaaaa",
    "É è ñ ß 漢字 かな 😀😀  　 \x85 \x1c",
    "1234567 89,10 $$$&&& |||| ...",
    " leading space",
    "long " + "thentione, ouanan. " * 3000,
    "wordwithoutanyspace" * 4000,
    "̀́ combining",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode_as_the_library(spark, library):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(3, "a", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = bpe.encode(docs, PATH, decoded="decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == expected(library, r["text"])
        assert r["decoded"] == (r["text"] or "")
        assert r["n_tokens"] == "clash"
    again = bpe.decode(bpe.encode(docs, PATH).drop("text"), PATH).collect()
    assert sorted((r["doc_id"], r["decoded"]) for r in again) == sorted((i, t or "") for i, t, _ in rows)
    one = {r["doc_id"]: r for r in bpe.digests(bpe.encode(docs.drop("n_tokens"), PATH, decoded="decoded")).collect()}
    assert one[9]["ids_sha256"] == hashlib.sha256(",".join(map(str, expected(library, TEXTS[9]))).encode()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH).collect() == []
    assert bpe.encode(docs, PATH, into="n_tokens").columns == ["doc_id", "text", "n_tokens"]


def test_memory_that_is_emptied_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe.Cutter, "limit", 3)
    model = bpe.PairIndexBpe(PATH)
    for _ in range(3):
        for t in TEXTS[1:]:
            assert np.frombuffer(model.encode([t])[0], "<i4").tolist() == expected(library, t)


def test_all_characters_beside_blanks(library):
    text = "".join(f"a{chr(c)} {chr(c)}b  {chr(c)}\n" for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    assert np.frombuffer(bpe.model(PATH).encode([text])[0], "<i4").tolist() == expected(library, text)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}, {"model": {"type": "Unigram"}}])
def test_other_tokenizer_files_are_refused(change):
    spec = {"model": {"type": "BPE"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "decoder": {"type": "ByteLevel"}}
    bpe.check(spec)
    with pytest.raises(ValueError, match="not followed"):
        bpe.check({**spec, **change})


def test_invalid_bytes_decode_as_the_library(library):
    ids = [i for i in range(100, 260)]
    assert bpe.model(PATH).decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_files_round_trip(spark, library, tmp_path):
    rows = [(k * 7, t, 1.5) for k, t in enumerate(TEXTS)] + [(7, "again", 0.0), (None, "no id", 0.0), (None, None, 0.0), (14, TEXTS[2], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids double").repartition(4)
    folder = str(tmp_path / "set")
    manifest = binary.write(docs, folder, PATH, parts=3)
    assert manifest["id_bytes"] == 2
    assert json.loads((tmp_path / "set" / "manifest.json").read_text())["parts"] == manifest["parts"]
    want, start = [], 0
    first = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), r[1] is not None, r[1] or "")
    for key, text, _ in sorted(rows, key=first):
        ids = [*expected(library, text), 2]
        want.append((key, start, len(ids), ids))
        start += len(ids)
    got = sorted((tuple(r) for r in binary.ids_of(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    total = sum(p["ids"] for p in manifest["parts"])
    assert total == start
    flat = np.concatenate([binary.open_part(folder, p["name"], 2)[0] for p in manifest["parts"]])
    assert zlib.crc32(flat.astype("<u4").tobytes()) == zlib.crc32(np.array([i for w in want for i in w[3]], "<u4").tobytes())


def test_no_rows_and_only_null_ids(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert binary.write(empty, str(tmp_path / "a"), PATH)["parts"] == []
    assert binary.ids_of(spark, str(tmp_path / "a")).collect() == []
    binary.write(spark.createDataFrame([(None, "x")], "doc_id long, text string"), str(tmp_path / "b"), PATH, parts=1)
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in binary.ids_of(spark, str(tmp_path / "b")).collect()] == [(None, 0, 2)]


def test_queries(spark, library, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for r in bpe.op2(spark, str(tmp_path)).collect():
        ids = expected(library, TEXTS[r["doc_id"]])
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    start = 0
    for r in sorted(binary.op8(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"]):
        ids = [*expected(library, TEXTS[r["doc_id"]]), 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_cut_equals_the_published_pattern():
    """Every character by itself, doubled, and beside letters, digits, marks and spaces, within and beyond U+FFFF."""
    m = bpe.model(PATH)
    chars = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x10000), 0x10000, 0x10400, 0x1D7CE, 0x1F600, 0x20000)]
    for c in chars:
        text = f"a{c} {c}b1{c}{c} .{c}\n{c}"
        assert m.cut(text) == m.pre.findall(text)
    whole = "".join(chars)
    assert m.cut(whole) == m.pre.findall(whole)
    assert m.cut(whole[:60_000]) == m.pre.findall(whole[:60_000])
